"""Languages of web pages: text, declared language, address suffix and what is known of the host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.hashing import gram_buckets
from brindle.llm.skew import join_per_key
from brindle.session import Scratch, ship

BITS = 14
#: Labelled documents of a language from which byte trigrams are counted, at most (about); chosen by a hash of the id.
LABELLED_ROWS = 2000
#: Trigrams whose evidence counts in full; that of longer texts is scaled down to as many, as they aren't independent.
FULL_GRAMS = 60
#: How often a declared language is right, and how many pages a prior weighs as.
DECLARED_RIGHT, HOST_WEIGHT, SUFFIX_WEIGHT = 0.9, 10.0, 50.0
SPACES = re.compile(r"\s+")
HIDDEN = re.compile(r"(?i)<(script|style)\b|<!--")
ENDS = {"script": re.compile(r"(?i)</script\s*>"), "style": re.compile(r"(?i)</style\s*>"), None: re.compile("-->")}
TAG = re.compile(r"<[^<>]*>")


def without_hidden(page: str) -> str:
    """A page with a space for each script, style and comment. One that isn't closed stays, and is looked for once only."""
    out, at, look, endless = [], 0, 0, set()
    while m := HIDDEN.search(page, look):
        kind = m[1] and m[1].lower()
        end = None if kind in endless else ENDS[kind].search(page, m.end())
        if end is None:
            endless.add(kind)
            look = m.end()
            continue
        out += [page[at : m.start()], " "]
        at = look = end.end()
    return "".join([*out, page[at:]])


def visible_text(page: str | None) -> str:
    """The text of a page with single spaces and no markup. The work is linear in the page, whatever is in it."""
    return SPACES.sub(" ", html.unescape(TAG.sub(" ", without_hidden(page or "")))).strip()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the log probability of each bucket of trigrams in them, from a bounded sample of documents.

    Every language that a document with text has is one; the driver gets 2 ** BITS counts for each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.lower(lang_col).alias("lang")).where("lang is not null and text is not null")
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return [], np.zeros((0, 1 << BITS))
    rates = docs.sparkSession.createDataFrame([(x, min(1.0, LABELLED_ROWS / found[x])) for x in langs], "lang string, rate double")
    sample = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), 1 << BITS), np.int64)
        place = {x: i for i, x in enumerate(langs)}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for grams in gram_buckets(SPACES.sub(" ", text), BITS):
                    sums[place[lang]] += np.bincount(grams, minlength=1 << BITS)
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(sums[at])], names=["lang", "bucket", "n"])

    ship(docs.sparkSession)
    counts = np.zeros((len(langs), 1 << BITS))
    got = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts[got.column("lang").to_numpy(), got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return langs, np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1]))


def _normal(values: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def text_logs(text: str, logs: np.ndarray) -> np.ndarray:
    """Log evidence of a text for each language; that of more than FULL_GRAMS trigrams is scaled down to as many."""
    out, n = np.zeros(len(logs)), 0
    for grams in gram_buckets(text, BITS) if text else ():
        n += len(grams)
        for i in range(0, len(grams), 4096):
            out += logs[:, grams[i : i + 4096]].sum(axis=1)
    return out * min(1.0, FULL_GRAMS / max(1, n))


def identify(pages: DataFrame, docs: DataFrame, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, lang, probability, text_lang, declared.

    Log evidence is added up: of the text (byte trigrams of documents of known lang), of the declared
    language (the lang attribute of the html element) and of the host. The host's prior is its pages'
    text probabilities, smoothed by those of its address suffix, which are smoothed by those of all
    pages; a page's own share is taken out of each, so that it doesn't count twice. These sums are
    grouped aggregations; joins bring them back. Pages without text, declaration or address lack that evidence;
    a page with none gets the most frequent language. Ties go to the language first in order.
    Every language of the documents takes part. Documents without any language give null. Repeated rows,
    and null ids, stay; an empty table gives no rows. Other columns are ignored.
    """
    langs, logs = train(docs)
    k = len(langs)
    url = F.col(url_col).cast("string")
    if not k:
        none = F.lit(None).cast("string")
        return pages.select(F.col(page_col).cast("long").alias("page_id"), none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), none.alias("declared"))
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"^(www|m)\.", ""))
    declared = F.lower(F.regexp_extract(F.col(html_col), r"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    rows = pages.select(F.col(page_col).cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(declared, F.lit("")).alias("declared"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [text_logs(visible_text(page), logs).tolist() for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("declared"), pa.array(out, pa.list_(pa.float64()))], names=["page_id", "host", "declared", "logs"])

    ship(pages.sparkSession)
    read = rows.mapInArrow(run, "page_id long, host string, declared string, logs array<double>")
    suffix = F.substring_index("host", ".", -1)
    scratch = Scratch(pages.sparkSession, "language")
    scored = scratch.save(read.withColumns({"suffix": suffix, "p": _normal(F.col("logs"))}))
    sums = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(k)]
    grouped = lambda key, name: scratch.save(scored.groupBy(key).agg(*sums, F.count("*").alias("n")).select(key, F.array(*[f"s{i}" for i in range(k)]).alias(name), "n"))
    total = scored.agg(*sums, F.count("*").alias("n")).first()
    world = F.array(*[F.lit((total[f"s{i}"] or 0.0) + 1.0 / k) for i in range(k)])
    size = F.lit(float(total["n"] + 1))
    joined = join_per_key(scored, ["host"], grouped("host", "hs"), total["n"]).withColumnRenamed("n", "hn")
    joined = join_per_key(joined, ["suffix"], grouped("suffix", "ss"), total["n"]).withColumnRenamed("n", "sn")
    base = F.transform(F.arrays_zip(world.alias("w"), F.col("p").alias("p")), lambda x: F.greatest(x["w"] - x["p"], F.lit(1e-6)) / size)
    joined = joined.withColumn("base", base)
    by_suffix = F.transform(F.arrays_zip("ss", "p", "base"), lambda x: (F.greatest(x["ss"] - x["p"], F.lit(0.0)) + SUFFIX_WEIGHT * x["base"]) / (F.col("sn") - 1 + SUFFIX_WEIGHT))
    joined = joined.withColumn("near", F.when(F.col("suffix") == "", F.col("base")).otherwise(by_suffix))
    by_host = F.transform(F.arrays_zip("hs", "p", "near"), lambda x: (F.greatest(x["hs"] - x["p"], F.lit(0.0)) + HOST_WEIGHT * x["near"]) / (F.col("hn") - 1 + HOST_WEIGHT))
    joined = joined.withColumn("prior", F.when(F.col("host") == "", F.col("near")).otherwise(by_host))
    names = F.array(*[F.lit(x) for x in langs])
    said = F.array_contains(names, F.col("declared"))
    hint = F.transform(names, lambda x: F.when(~said, 0.0).when(x == F.col("declared"), float(np.log(DECLARED_RIGHT))).otherwise(float(np.log((1 - DECLARED_RIGHT) / max(1, k - 1)))))
    fused = F.transform(F.arrays_zip(F.col("logs").alias("t"), hint.alias("h"), F.col("prior").alias("q")), lambda x: x["t"] + x["h"] + F.log(x["q"]))
    joined = joined.withColumn("posterior", _normal(fused))
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    text_lang = F.when(F.exists("logs", lambda x: x != 0), best(F.col("logs")))
    return joined.select("page_id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("probability"), text_lang.alias("text_lang"), F.when(F.col("declared") != "", F.col("declared")).alias("declared"))
