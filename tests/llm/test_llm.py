"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from brindle.llm import bpe, chat, embedding_dedup, gbt, graph, language_id, line_dedup, mixing, quality, simhash, skew, spm, token_count, toxicity
from brindle.session import Scratch

random.seed(7)
WORDS = [f"{a}{b}" for a in ("ban", "cor", "del", "fim", "gost", "hul") for b in ("a", "er", "ish", "ol", "um", "we")]
BASE = [" ".join(random.choice(WORDS) for _ in range(80)) for _ in range(6)]
TEXTS = [None, "", " \n\t", "one", "L'été 😀 a's  123 ½\x00 ▁▁ x\r\n 日本語", *BASE, BASE[0], BASE[1].replace(" ", "  ", 1), BASE[2] + " extra", "x\n" + BASE[3], "ab " * 60000]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, component_id string, fp int, domain string"
ROWS = [(i if i != 3 else None, t, "en" if i % 2 else None, "s", None, 1.0, 5, "c", 2, "d") for i, t in enumerate(TEXTS)]
ROWS += [ROWS[5], ROWS[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 6 else i % 2, i % 3 == 0 and 1 or 0) for i in range(len(TEXTS))] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def components(n, linked):
    root = list(range(n))
    for _ in range(n):
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(1, None), (2, 2)]
    found = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    root = components(60, [e for e in edges if None not in e])
    assert found == {i: r for i, r in enumerate(root) if i != r}


def test_simhash(docs):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    fps = [simhash.fingerprint(r[1]) for r in ROWS]
    root = components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    low = defaultdict(list)
    for r, row in zip(root, ROWS):
        low[r].append(row[0])
    want = sorted((str(row[0]), fp, str(min((x for x in low[r] if x is not None), default=None))) for row, fp, r in zip(ROWS, fps, root))
    assert sorted((str(r["id"]), r["fp"] % 2**64, str(r["component_id"])) for r in rows) == want


def test_simhash_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    base, rng = 0x123456789ABCDEF, random.Random(3)
    fps = list({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)})
    edges = simhash.links(spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")).collect()
    place = {simhash._signed(x): i for i, x in enumerate(fps)}
    assert components(len(fps), [(place[e["a"]], place[e["b"]]) for e in edges]) == components(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 8)) * 0.15, x[:5]])
    rows = [(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)] + [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 0), (203, [1.0, None], 0), (204, x[0].tolist(), None), (205, [], 1)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = [(a, b) for a in range(len(x)) for b in range(a) if a % 2 == b % 2 and u[a] @ u[b] >= 0.93]
    root = components(len(x), linked)
    for i in range(len(x)):
        assert out[i] == (sum(i in e for e in linked), root[i], root[i] == i)
    assert all(out[i] == (0, i, True) for i in range(200, 206))


def vectors_by_hand(rows, threshold):
    """(n_links, component, kept) of each row, from all pairs."""
    unit = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) / max(map(abs, v)) if ok else None
        unit.append(x / np.sqrt((x**2).sum()) if ok else None)
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and (unit[a] * unit[b]).sum() >= threshold]
    root = components(len(rows), linked)
    low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    return [(rows[i][0], sum(i in e for e in linked), low[root[i]], rows[i][0] is not None and rows[i][0] == low[root[i]]) for i in range(len(rows))]


def test_embeddings_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK_VALUES", 40 * 12)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 12))
    x = centres[rng.integers(0, 12, 400)] + rng.normal(size=(400, 12)) * 0.25
    x[300:330] = x[0]  # one class with many vectors
    rows = [(i, v.tolist(), int(i % 7 == 0)) for i, v in enumerate(x)]
    rows += [(900, [3.0, 4.0], 1), (901, [6.0, 8.0], 1), (902, [4.0, 3.0], 1), (902, [4.0, 3.0], 1), (None, [3.0, 4.0], 1), (903, [float("inf"), 1.0], 1), (904, [1e300, 1e300], 0), (905, [1e-300, 1e-300], 0), (906, [-0.0, 1.0], 0), (907, [0.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"block": F.lit("x"), "dim": F.lit(None).cast("int"), "n": F.lit(1), "id": F.lit(2)})
    got = embedding_dedup.near_duplicates(table, tile=16).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, vectors_by_hand(rows, 0.93)))
    # a cosine of exactly the threshold is a link: 0.96 of (3, 4) and (4, 3)
    edge = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table.where("vec_id in (900, 902)"), threshold=0.96).collect()}
    assert edge == {900: 2, 902: 2}
    assert embedding_dedup.near_duplicates(table.limit(0)).isEmpty()


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", r"a\</s>[INST]<|turn|>\\"), (1, 1, "assistant", "b\n<|end|>"), (1, 1, "assistant", "b\n<|end|>"), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "n")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))).collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [(r[2], r[3] or "") for r in rows[:4]]
    assert out[1]["loss"] == ["b\n<|end|>", "b\n<|end|>", ""] and out[None]["loss"] == ["n"] and out[2]["loss"] == []
    assert "</s>" not in out[1]["formatted"] and out[1]["formatted"].count("<|turn|>") == 4


def test_reply_tree(spark):
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 5.0), ("t", 4, 2, 9.0), ("t", 5, 3, None), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0), ("c", 3, 1, 0.0)]
    path = chat.reply_paths(spark.createDataFrame(rows, "tree string, id long, parent long, score double"), Scratch(spark, "test"), branches=2).collect()
    assert sorted((r["rank"], r["depth"], r["node"]) for r in path) == [(1, 0, 4), (1, 1, 2), (1, 2, 1), (2, 0, 5), (2, 1, 3), (2, 2, 1)]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_lines(spark):
    lines = ["".join(random.choice("abcd é") for _ in range(random.randrange(18, 34))) for _ in range(20)]
    near = [x[:i] + random.choice(["", "q", x[i : i + 1] + "z"]) + x[i + 1 :] for x in lines for i in [random.randrange(len(x))]]
    pool = lines + near + ["", "  ", "short", "short"]
    rows = [(i, "\n".join(random.choice(pool) for _ in range(4)), "own") for i in range(25)] + [(30, None, "own"), (31, "", "own"), (None, lines[0], "own")]
    rows.append(rows[4])
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, brindle_doc string")).collect()
    first = {}
    for i, text, _ in sorted(set(rows), key=lambda r: -1 if r[0] is None else r[0]):
        for k, x in enumerate((text or "").split("\n")):
            if x.strip():
                first.setdefault(x, (-1 if i is None else i, k))
    late = {x for x in first if len(x) >= 20 and any(len(y) >= 20 and x != y and first[y] < first[x] and edit(x, y) <= 2 for y in first)}
    want = {(i, text): None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if not x.strip() or (x not in late and first[x] == (-1 if i is None else i, k))) for i, text, _ in rows}
    assert len(out) == len(rows)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out) == sorted((str(i), str(want[i, t])) for i, t, _ in rows)


def test_banded(spark):
    rng = random.Random(11)
    pairs = [("a" * 64, "a" * 64), ("a" * 64, "a" * 65), ("a" * 128, "b" + "a" * 127), ("x" * 63 + "yz", "x" * 63 + "zy"), ("", "ab"), ("", "abc")]
    for _ in range(500):
        a = "".join(rng.choice("abé\U0001f600") for _ in range(rng.choice((3, 9, 30, 63, 64, 65, 127, 130, 200))))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "c", "ab", "漢"])
        pairs.append((a, "".join(b)))
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", F.length("a").alias("na"), F.length("b").alias("nb"), line_dedup.pack(F.col("a"), F.length("a")).alias("pa"), line_dedup.pack(F.col("b"), F.length("b")).alias("pb"))
    for k in (1, 2, 3):
        found = {r["i"]: r["w"] for r in table.select("i", line_dedup.within(F.col("pa"), F.col("na"), F.col("pb"), F.col("nb"), k).alias("w")).collect()}
        assert [found[i] for i in range(len(pairs))] == [edit(a, b) <= k for a, b in pairs]


def test_lines_are_judged_by_the_band(spark, monkeypatch):
    rows = [(1, "a line of more than twenty characters"), (2, "a line of more than twenty charakters"), (3, "a line of fewer than thirty characters")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()} == {1: rows[0][1], 2: "", 3: rows[2][1]}
    monkeypatch.setattr(line_dedup, "within", lambda *_: F.lit(False))
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(table).collect()} == dict(rows)


def test_lines_of_one_long_document(spark):
    text = "\n".join(["the same line again and again"] * 60000 + ["another"])
    rows = [(1, text, "x"), (2, "another", "y")]
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, pos string"), counts="near").collect()}
    assert out[1]["text"] == "the same line again and again\nanother" and tuple(out[1]["near"]) == (60001, 59999, 0)
    assert out[2]["text"] == "" and out[2]["pos"] == "y"
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, pos string"), counts="pos")


def test_bpe(docs):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for row in ROWS:
        ids = np.array(own.encode_ordinary(row[1] or ""), "<u4").tobytes()
        want.append((str(row[0]), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert sorted((str(r["id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs).collect()) == sorted(want)


def test_token_counts(docs):
    model = spm.load(spm.unigram_model(public_tokenizers.path(token_count.VOCABULARY)))
    assert sorted((str(r["id"]), r["n_tokens"]) for r in token_count.token_counts(docs).collect()) == sorted((str(r[0]), len(model.encode(r[1] or ""))) for r in ROWS)


def test_statistics_by_hand():
    rng = random.Random(4)
    long = "word " * 300_000 + "\n" + "x" * 3_000_000 + " end"
    texts = ["".join(rng.choice(["a", "b", "é", " ", " ", "\n", "\t", "#", "\u00a0", "\x0b", "\x1c"]) for _ in range(rng.randrange(120))) for _ in range(300)]
    for text in [*texts, "a b c", "a a a a", "a b c d", long]:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        windows = defaultdict(list)
        for i in range(len(words) - 2):
            windows[tuple(words[i : i + 3])].append(i)
        inside = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if line.strip("\x20\x09\x0a\x0b\x0c\x0d"):
                dup += line in seen
                seen.add(line)
        assert quality.statistics(text)[:5] == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside))


def test_base_rules(spark):
    texts = [" ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)), "a b c " * 20 + " ".join(f"w{i}" for i in range(60)), "a b c " * 20 + " ".join(f"w{i}" for i in range(59)), None, ""]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("own"))
    out = {r["id"]: r for r in quality.quality(table, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert [out[i]["base_failed"] for i in range(6)] == [True, False, False, True, True, True]
    assert [out[i]["kept"] for i in range(6)] == [False, True, True, False, False, False]
    # the trees decide the rest: labels make texts with symbols bad
    words = lambda i: " ".join(f"w{(i * 31 + k * 7) % 997}" + ("#|" if i % 2 else "") for k in range(60))
    many = spark.createDataFrame([(i, words(i)) for i in range(200)], "doc_id long, text string")
    kept = {r["id"]: r["kept"] for r in quality.quality(many, many.select("doc_id", (F.col("doc_id") % 2 == 0).cast("int").alias("quality")).union(many.select("doc_id", F.lit(None).cast("int")))).collect()}
    assert kept == {i: i % 2 == 0 for i in range(200)}


def test_statistics():
    assert quality.statistics("a b c a b c\nx #|\nx #|")[:5] == (10, 12, 4, 1, 6)
    assert quality.statistics(None)[:5] == (0, 0, 0, 0, 0)


def test_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 2))
    y = (x[:, 0] + np.sin(3 * x[:, 1]) + rng.normal(size=600) * 0.3 < 0).astype(float)
    trees = gbt.fit(x, y, (-1, 0))
    for v in (-1.0, 0.0, 1.0):
        assert (np.diff(trees.margin(np.column_stack([np.linspace(-3, 3, 50), np.full(50, v)]))) <= 1e-12).all()
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.9


def test_lexicon():
    words = toxicity.Lexicon(["idiot", "lowei*"])
    assert [words.kind(w) for w in ("idiot", "id1ot", "idot", "idiott", "lowei", "loweiung", "lowaiung", "other", "idiots")] == [2, 1, 1, 1, 1, 2, 1, 0, 1]
    assert words.features('he said "idiot" to him')[1] > 0 and words.features("you idiot")[0] > 0


def test_lexicon_by_hand():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    terms = [word(rng.randrange(3, 9)) + ("*" if rng.random() < 0.4 else "") for _ in range(25)]
    lexicon = toxicity.Lexicon(terms)
    for w in [word(rng.randrange(1, 14)) for _ in range(3000)] + ["a" * 100_000]:
        exact = any(w.startswith(t[:-1]) and len(w) > len(t) - 1 if t.endswith("*") else w == t for t in terms)
        long = [t for t in terms if len(t.rstrip("*")) >= toxicity.FUZZY_FROM]
        close = len(w) >= toxicity.FUZZY_FROM - 1 and any(min(edit(w[:k], t[:-1]) for k in range(len(t) - 2, len(t) + 1)) <= 1 if t.endswith("*") else len(w) < 20 and edit(w, t) <= 1 for t in long)
        assert lexicon.kind(w) == (2 if exact else 1 if close else 0), w


@pytest.mark.parametrize("opening, closing", ["“”", "„“", "„”", "«»", "»«", "‹›", "›‹", '""'])
def test_quotations(opening, closing):
    words = toxicity.Lexicon(["idiot"])
    quoted, plain = words.features(f"er sagte {opening}ein idiot{closing} dazu"), words.features(f"er sagte {opening}gut{closing}, du idiot, {opening}bye{closing}")
    assert quoted[0] == 0 < quoted[1] and plain[1] == 0 < plain[0]
    assert words.features(f"er sagte {opening}gut, du idiot\n{closing}")[1] == 0
    far = " ".join(["wort"] * 12)
    assert words.features(f"{opening}{far} idiot {far}{closing}")[1] == 0


def test_nested_quotations():
    assert toxicity.quotations("„a »b« c“ “d") == [(3, 5), (0, 8)]
    assert toxicity.quotations("") == [] and toxicity.quotations("”a”") == []


def test_toxicity_is_the_same_each_time(spark):
    rows = [(i % 150, " ".join(f"w{(i * 13 + k * k) % 40}" for k in range(9)) + (" vilword" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    learned = [toxicity.learn(t.select("doc_id", "text"), t.select("doc_id", "toxic"), "doc_id", "text") for t in (table, table.orderBy(F.desc("text")))]
    assert learned[0][0] == learned[1][0] and learned[0][1] == pytest.approx(learned[1][1])


def test_toxicity_without_text(spark):
    rows = [(1, None), (2, ""), (3, "plain words"), (None, "vilword"), (4, "vilword " * 50000), (4, "vilword " * 50000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("own"), "half": F.lit(1)})
    learn = spark.createDataFrame([(i, f"w{i} w{i + 1}" + (" vilword" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(10, 200)], "doc_id long, text string, toxic int")
    out = toxicity.toxicity(table.select("doc_id", "text").union(learn.select("doc_id", "text")), learn.select("doc_id", "toxic")).collect()
    got = defaultdict(list)
    for r in out:
        got[r["id"]].append(r)
    assert len(out) == 196 and got[1][0]["score"] == got[2][0]["score"] == got[3][0]["score"] < 0.7
    assert [r["predicted"] for r in got[4]] == [1, 1] and got[None][0]["held_out"] is False


def test_toxicity_held_out(spark):
    rows = [(i, " ".join(f"w{random.randrange(3000)}" for _ in range(60)) + (" vilword nastyterm" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = {r["id"]: r for r in toxicity.toxicity(table.select("doc_id", "text"), table.select("doc_id", "toxic")).collect()}
    held = [(out[i]["predicted"], t) for i, _, t in rows if out[i]["held_out"]]
    assert len(held) > 80 and all(p == t for p, t in held)


def test_language_fusion_by_hand(spark):
    rng = random.Random(2)
    said = {"en": ["the", "and", "with", "that", "which"], "de": ["der", "und", "mit", "nicht", "eine"], "fr": ["le", "et", "avec", "que", "une"]}
    docs = spark.createDataFrame([(i, " ".join(rng.choice(said[x]) for _ in range(40)), x) for i, x in enumerate(["en", "de", "fr"] * 8)], "doc_id long, text string, lang string")
    words = lambda x, n: " ".join(rng.choice(said[x]) for _ in range(n))
    page = lambda lang, body: f"<html lang='{lang}'><script>der und</script><p>{body}</p></html>" if lang else f"<p>{body}</p>"
    rows = [(i, f"https://www.a.de/{i}", page("de", words("de", 30))) for i in range(12)]
    rows += [(20, "http://m.a.de/x", page(None, "mit le")), (21, "https://b.de/", page("fr", "avec")), (22, "https://c.fr", page("de", words("fr", 30))), (23, None, page("en", "")), (24, "https://a.de/y", ""), (25, "nonsense", None), (25, "nonsense", None), (None, "https://d.fr/", page("xx", words("en", 3)))]
    got = {}
    for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)), docs).collect():
        got.setdefault(r["page_id"], []).append((r["lang"], r["probability"], r["text_lang"], r["declared"]))
    assert sum(map(len, got.values())) == len(rows)
    langs, logs = language_id.train(docs)
    assert langs == ["de", "en", "fr"]
    normal = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    facts = []
    for i, url, body in rows:
        host = (url or "").partition("://")[2].partition("/")[0]
        host = host.removeprefix("www.").removeprefix("m.")
        z = language_id.text_logs(language_id.visible_text(body), logs)
        declared = (body or "").partition("lang='")[2].partition("'")[0]
        facts.append((i, host, host.rpartition(".")[2], declared, z, normal(z)))
    for i, host, suffix, declared, z, p in facts:
        world = np.maximum(sum(f[5] for f in facts) + 1 / 3 - p, 1e-6) / (len(facts) + 1)
        of = lambda k, v: (np.maximum(sum(f[5] for f in facts if f[k] == v) - p, 0), sum(f[k] == v for f in facts) - 1)  # noqa: B023, E731
        s, n = of(2, suffix)
        near = (s + 50 * world) / (n + 50) if suffix else world
        s, n = of(1, host)
        prior = (s + 10 * near) / (n + 10) if host else near
        hint = np.array([0.0 if declared not in langs else np.log(0.9) if x == declared else np.log(0.05) for x in langs])
        want = normal(z + hint + np.log(prior))
        for lang, probability, text_lang, said_lang in got[i]:
            assert probability == pytest.approx(want.max(), abs=1e-9) and lang == langs[int(want.argmax())]
            assert text_lang == (langs[int(z.argmax())] if z.any() else None) and said_lang == (declared or None)
    assert got[0][0][0] == "de" and got[22][0][0] == "fr" and got[21][0][0] == "fr" and got[24][0][0] == "de"


def test_joins_of_hot_keys(spark, monkeypatch):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).alias("k"), "id").where("id % 2 = 0")
    table = Scratch(spark, "test").save(rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s")))
    found = [sorted(map(tuple, skew.join_per_key(rows, ["k"], table, 1500).select("k", "id", "s").collect()))]
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(skew, "HOT", 100)
    found.append(sorted(map(tuple, skew.join_per_key(rows, ["k"], table, 1500).select("k", "id", "s").collect())))
    assert found[0] == found[1] and len(found[0]) == 1500 and found[0][0] == (7, 0, sum(range(0, 1000, 2)))


def test_markup_in_linear_time():
    import time

    began = time.time()
    for junk in ("<script ", "<!--", "<", "<style>", "<html "):
        language_id.visible_text(junk * 200_000)
    assert time.time() - began < 20
    assert language_id.visible_text("a<SCRIPT x>b</script >c<!-- d --><style>e</style>f<script>g") == "a c f g"
    logs = np.random.default_rng(0).normal(size=(2, 1 << language_id.BITS))
    long = "abc " * 700_000
    assert np.isfinite(language_id.text_logs(long, logs)).all() and language_id.text_logs("", logs).tolist() == [0.0, 0.0]


def test_edges_and_empty(spark, docs, labels):
    pages = spark.createDataFrame([(1, None, None), (None, "http://a.example.com/x", "<html lang='en'>" + BASE[0]), (2, "bad", ""), (2, "bad", "")], "page_id long, url string, html string")
    assert language_id.identify(pages, docs).count() == 4
    assert toxicity.toxicity(docs, labels).count() == quality.quality(docs, labels).count() == len(ROWS)
    assert mixing.mix(docs, labels).where("rate < 0 or copies < 0 or rate is null").isEmpty()
    none = docs.limit(0)
    results = [simhash.near_duplicates(none), line_dedup.dedup_lines(none), bpe.encode(none), token_count.token_counts(none), quality.quality(none, labels.limit(0)), toxicity.toxicity(none, labels.limit(0)), mixing.mix(none, labels.limit(0)), language_id.identify(pages.limit(0), none)]
    assert all(r.isEmpty() for r in results)


def test_mixing_targets(spark):
    kind = lambda i: ("bad" if i % 3 else "fine")
    rows = [(i, " ".join(f"{kind(i)}{random.randrange(30)}" for _ in range(40)), int(i % 3 == 0)) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = mixing.mix(table.select("doc_id", "text"), table.select("doc_id", "quality", F.lit(0).alias("toxic")), targets={"clean": 0.8, "low_quality": 0.2, "toxic": 0.0}).toPandas()
    got = [(out.rate * out.n_tokens * out[f"p{i}"]).sum() for i in (0, 1)]
    assert got[0] / sum(got) == pytest.approx(0.8, abs=0.01)


def solved(p, n, goal, floor):
    """Rates by plain projected gradient on the same squares, to the end."""
    scale = np.where(goal > 0, 1 / np.maximum(goal, 1e-9), 0)
    a = (p * n[:, None]) * scale
    r, step = np.maximum(floor, 1.0), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20000):
        r = np.maximum(floor, r - step * a @ (a.T @ r - (goal > 0)))
    return r, np.linalg.norm(a.T @ r - (goal > 0))


@pytest.mark.parametrize("targets, keep", [({"clean": 0.7, "low_quality": 0.2, "toxic": 0.1}, None), ({"clean": 0.2, "low_quality": 0.8, "toxic": 0.0}, None), ({"clean": 0.9, "low_quality": 0.1, "toxic": 0.0}, "clean"), ({"clean": 0.6, "low_quality": 0.3, "toxic": 0.1}, "clean"), ({"clean": 0.02, "low_quality": 0.98, "toxic": 0.0}, "clean")])
def test_rates_by_hand(spark, targets, keep):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([2.0, 0.7, 0.3], size=200)
    n = rng.integers(1, 300, 200)
    members = spark.createDataFrame([(int(i), int(m), *map(float, x)) for i, (m, x) in enumerate(zip(n, p))], "id long, n_tokens long, p0 double, p1 double, p2 double")
    fit = mixing.fit_rates(members, targets, keep)
    got = np.array([r["rate"] for r in members.withColumn("rate", fit.rate()).orderBy("id").collect()])
    assert got == pytest.approx(fit.rates(p))
    floor = np.where(p[:, 0] >= p.max(axis=1), 1.0, 0.0) if keep else np.zeros(200)
    assert (got >= floor).all()
    want = np.array([targets[d] for d in mixing.DOMAINS])
    held = (p * (n * floor)[:, None]).sum(axis=0)
    goal = max((p * n[:, None]).sum(), *(x / w for x, w in zip(held, want / want.sum()) if w)) * want / want.sum()
    _, best = solved(p, n.astype(float), goal, floor)
    missed = np.linalg.norm(np.where(goal > 0, ((p * n[:, None]).T @ got - goal) / np.maximum(goal, 1e-9), 0))
    assert missed <= best + 0.03
    assert max(map(abs, fit.missed.values())) == pytest.approx(np.abs(np.where(goal > 0, ((p * n[:, None]).T @ got - goal) / np.maximum(goal, 1e-9), 0)).max())


def test_missed_targets_are_told(spark):
    members = spark.createDataFrame([(1, 10, 0.5, 0.4, 0.1), (2, 20, 0.5, 0.4, 0.1)], "id long, n_tokens long, p0 double, p1 double, p2 double")
    with pytest.warns(UserWarning, match="missed"):
        fit = mixing.fit_rates(members, {"clean": 0.9, "low_quality": 0.1, "toxic": 0.0})
    assert max(map(abs, fit.missed.values())) > 0.1


def test_reply_trees_by_hand(spark):
    rng, rows = random.Random(9), []
    for t in range(6):
        for i in range(1, 40):
            rows.append((f"t{t}", i, rng.choice([None, 99, *range(1, i)]) if i > 1 else None, rng.choice([None, 0.5, 1.0, -1.0])))
    parent, score = {(t, i): p for t, i, p, _ in rows}, {(t, i): s or 0.0 for t, i, _, s in rows}
    held = {(t, p) for t, _, p, _ in rows}
    want = []
    chains = defaultdict(list)
    for t, i, _, _ in rows:
        if (t, i) not in held:
            chain = [i]
            while parent.get((t, chain[-1])) is not None and (t, parent[t, chain[-1]]) in parent:
                chain.append(parent[t, chain[-1]])
            chains[t, chain[-1]].append((-sum(score[t, x] for x in chain), i, chain))
    for (t, _), found in chains.items():
        for rank, (_, leaf, chain) in enumerate(sorted(found)[:2], 1):
            want += [(t, leaf, rank, x, depth) for depth, x in enumerate(chain)]
    got = chat.reply_paths(spark.createDataFrame(rows, "tree string, id long, parent long, score double"), Scratch(spark, "test"), branches=2)
    assert sorted((r["tree"], r["leaf"], r["rank"], r["node"], r["depth"]) for r in got.collect()) == sorted(want)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert chat.format_conversations(none).isEmpty()
    long = "[INST]\\ " * 40000
    out = chat.format_conversations(spark.createDataFrame([(1, 0, "assistant", long), (1, 1, "user", None)], schema).withColumns({"tree": F.lit(1), "id": F.lit(2), "loss": F.lit("own")})).first()
    assert out["loss"] == [long] and [tuple(t) for t in out["turns"]] == [("assistant", long), ("user", "")]


def test_clashing_columns(spark, docs):
    clash = docs.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(("key", "gone", "place", "brindle_id", "pos", "doc", "row"))])
    for found in (simhash.keep_first(clash), line_dedup.dedup_lines(clash, counts="counted"), mixing.apply(clash, clash.selectExpr("doc_id", "cast(pos % 2 as int) quality", "0 toxic"), keep="clean")):
        row = found.first()
        assert [row[c] for c in ("key", "gone", "place", "brindle_id", "pos", "doc", "row")] == list(range(7))
    assert sorted(str(r["doc_id"]) for r in simhash.keep_first(docs.select("doc_id", "text")).collect()) == sorted(str(r["doc_id"]) for r in simhash.keep_first(clash).collect())


def test_pipeline(spark, docs, labels, tmp_path):
    """run() gives what its stages do one after the other, and its last stage decodes to the texts that reach it."""
    import corpus_pipeline

    rng = random.Random(12)
    body = lambda: " ".join(rng.choice(WORDS) for _ in range(60))
    shared = "a passage of many words that stands in two documents alone"
    rows = [(i, body() + ("\n" + shared if i in (5, 6) else "") + (" vilword nastyterm" if i % 5 == 0 else ""), "en", "s", None) for i in range(1, 120)]
    rows += [(200, rows[1][1], "en", "s", 3), (201, None, "en", "s", None), (202, "", None, None, 0), (None, body(), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("vilword" in (r[1] or ""))) for r in rows[:119]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in out}
    # of the two documents with the passage the first is toxic and goes before lines are compared
    assert not kept & {i for i in range(5, 120, 5)} and {i for i in range(1, 120) if i % 5} <= kept
    assert 200 not in kept and None in kept and {201, 202} & kept == {201}
    texts = {r[0]: r[1] for r in rows} | {5: rows[4][1]}
    for r in out:
        want = texts[r["doc_id"]] or ""
        assert r["decoded_sha256"] == hashlib.sha256(want.encode()).hexdigest() and r["n_tokens"] == len(r["ids"]) // 4


def test_stages_keep_columns(spark, docs, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns, name
    assert rows.count() > 0
