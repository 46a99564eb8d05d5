"""Document rates that bring soft domains to target shares of the tokens."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.hashing import word_buckets
from brindle.llm.names import unused
from brindle.session import Scratch, ship

#: Domains by the labels of a document, and the share of tokens that each should have.
DOMAINS = ("clean", "low_quality", "toxic")
TARGETS = {"clean": 0.93, "low_quality": 0.05, "toxic": 0.02}
BITS = 17
TEMPERATURES = (0.03, 0.06, 0.12, 0.25, 0.5, 1.0)
ROUNDS, TOLERANCE = 20, 1e-3
#: Documents that a bucket's overall share weighs as.
SMOOTHING = 5.0


def domain_of(quality: Column, toxic: Column) -> Column:
    """The place in DOMAINS of a labelled document."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


class Posterior:
    """Naive Bayes over hashed words, tempered.

    Each distinct bucket of a document counts once. Evidence of a document is divided by a power of
    its number of buckets that suits held-back labelled rows best, as words are no independent witnesses.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, temperature: float = 1.0):
        # a bucket's share in a domain is drawn towards its share in all, so that rare ones favour none
        overall = (counts.sum(axis=0) + 0.5) / (sizes.sum() + 1.0)
        share = (counts + SMOOTHING * overall) / (sizes[:, None] + SMOOTHING)
        rest = np.log1p(-np.minimum(share, 1 - 1e-9))
        self.weights = (np.log(share) - rest).T.copy()
        self.weights -= self.weights.mean(axis=1, keepdims=True)
        self.prior = np.log((sizes + 1.0) / (sizes.sum() + len(sizes)))
        self.temperature = temperature

    def evidence(self, buckets: np.ndarray) -> np.ndarray:
        return self.weights[np.unique(buckets)].sum(axis=0)

    def probabilities(self, evidence: np.ndarray, temperature: float | None = None) -> np.ndarray:
        z = self.prior + evidence * (self.temperature if temperature is None else temperature)
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and domain probabilities of each text."""
        buckets = [word_buckets(t, BITS) for t in texts.to_pylist()]
        evidence = np.array([self.evidence(x) for x in buckets]).reshape(-1, len(self.prior))
        return np.array([len(x) for x in buckets], np.int64), self.probabilities(evidence)


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Posterior:
    """The classifier, from all labelled documents: its prior is their mix at every size.

    Half of them give bucket counts and the other half the temperature; what comes to the driver
    are 2 ** BITS counts a domain and a loss for each temperature.
    """
    ship(docs.sparkSession)
    scratch, k = Scratch(docs.sparkSession, "mixing_train"), len(DOMAINS)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("id is not null and domain is not null").groupBy("id").agg(F.max("domain").alias("domain"))
    known = known.withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int"))
    # labels grow with the documents: they are merged at every size
    rows = scratch.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(known.hint("merge"), "id").select("text", "domain", "half"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, k, (1 << BITS) + 1), np.int64)
        for b in batches:
            for text, domain, half in zip(*(b.column(c).to_pylist() for c in ("text", "domain", "half"))):
                sums[half, domain, np.unique(word_buckets(text, BITS))] += 1
                sums[half, domain, -1] += 1
        at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in at] + [pa.array(sums[at])], names=["half", "domain", "bucket", "n"])

    try:
        sums = np.zeros((2, k, (1 << BITS) + 1))
        counted = rows.mapInArrow(count, "half int, domain int, bucket int, n long").groupBy("half", "domain", "bucket").agg(F.sum("n").alias("n")).toArrow()
        sums[tuple(counted.column(c).to_numpy() for c in ("half", "domain", "bucket"))] = counted.column("n").to_numpy()
        model = Posterior(sums[0, :, :-1], sums[0, :, -1])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss = np.zeros(len(TEMPERATURES))
            for b in batches:
                for text, domain, half in zip(*(b.column(c).to_pylist() for c in ("text", "domain", "half"))):
                    if half:
                        e = model.evidence(word_buckets(text, BITS))
                        loss -= [np.log(model.probabilities(e, t)[domain] + 1e-12) for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loss), dtype=np.int32)), pa.array(loss)], names=["t", "loss"])

        losses = {r["t"]: r["loss"] for r in rows.mapInArrow(judge, "t int, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).collect()}
    finally:
        scratch.drop(rows)
    best = min(range(len(TEMPERATURES)), key=lambda t: (losses.get(t, 0.0), t))
    return Posterior(sums[:, :, :-1].sum(axis=0), sums[:, :, -1].sum(axis=0), TEMPERATURES[best])


def memberships(docs: DataFrame, model: Posterior, id_col: str, text_col: str) -> DataFrame:
    """(id, th, n_tokens, p0, p1, ...): words and domain probabilities of each document; th is a hash of the text."""
    k = len(DOMAINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, p = model.of(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(n), *(pa.array(c) for c in p.T)], names=["id", "th", "n_tokens", *(f"p{i}" for i in range(k))])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, th long, n_tokens long, " + ", ".join(f"p{i} double" for i in range(k)))


@dataclass
class Fit:
    """Rates as projected steps from 1, and what they miss.

    A document's rate gains from each step the product of the step and its probabilities, and is then at
    least its floor: 1 if `keep` is its likeliest domain, else 0. missed: what each domain's tokens lack or
    have too much, as a part of its target.
    """

    steps: list[list[float]]
    missed: dict[str, float]
    keep: str | None = None

    def floor(self) -> Column:
        p = [F.col(f"p{i}") for i in range(len(DOMAINS))]
        return F.lit(0.0) if self.keep is None else F.when(p[DOMAINS.index(self.keep)] >= F.greatest(*p), 1.0).otherwise(0.0)

    def rate(self, free: bool = False) -> Column:
        """The rate; with free, as the last step leaves it, even below the floor."""
        r = F.lit(1.0)
        for i, s in enumerate(self.steps):
            r = r + sum((F.col(f"p{d}") * F.lit(float(x)) for d, x in enumerate(s)), F.lit(0.0))
            if not (free and i == len(self.steps) - 1):
                r = F.greatest(self.floor(), r)
        return r

    def rates(self, p: np.ndarray) -> np.ndarray:
        """rate() of rows of probabilities."""
        floor = 0.0 if self.keep is None else (p[:, DOMAINS.index(self.keep)] >= p.max(axis=1)).astype(float)
        r = np.ones(len(p))
        for s in self.steps:
            r = np.maximum(floor, r + p @ np.array(s))
        return r


def fit_rates(members: DataFrame, targets: dict[str, float], keep: str | None = None) -> Fit:
    """Steps to nonnegative document rates, by projected-gradient least squares.

    A document gives a domain rate * n_tokens * probability. The rates minimise the squares of what
    domains miss, relative to their targets. The gradient is scaled by the inverse of the domains'
    matrix of products over documents that their floor doesn't hold, so that overlapping domains don't slow the
    descent, and taken in the metric that weighs documents by tokens; it starts from 1, so among all
    solutions a near one is found. After a step that would make the miss larger the scaling is damped, which
    turns the next towards the plain gradient and shortens it. Each round needs a few numbers for each
    pair of domains from all documents, and nothing else comes to the driver.
    Domains without tokens or with a target of 0 are left out and the other targets scaled up. Targets
    that no rates reach, or not in ROUNDS rounds, are told by `missed` and a warning.
    """
    k = len(DOMAINS)
    n, p = F.col("n_tokens"), [F.col(f"p{i}") for i in range(k)]

    def measure(steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each domain, and the matrix of products of the documents in play."""
        fit = Fit(steps, {}, keep)
        rate = fit.rate()
        active = F.when((fit.rate(free=True) > fit.floor()) | F.lit(not steps), n).otherwise(0)
        row = members.agg(*[F.sum(n * p[i] * rate).alias(f"s{i}") for i in range(k)], *[F.sum(active * p[i] * p[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
        return np.array([row[f"s{i}"] or 0.0 for i in range(k)]), m

    total, m = measure([])
    want = np.array([targets[d] for d in DOMAINS]) * (total > 0)
    if not want.sum():
        return Fit([], {}, keep)
    want = want / want.sum()
    # what documents at their floor hold may be more than a domain's share of all tokens: the mix is then larger
    least = [members.agg(F.sum(n * x * Fit([], {}, keep).floor())).first()[0] or 0.0 for x in p] if keep else [0.0] * k
    goal = max(total.sum(), *(x / w for x, w in zip(least, want) if w > 0)) * want
    scale = np.where(goal > 0, 1 / np.maximum(goal, 1e-9), 0)
    used = np.flatnonzero(goal > 0)
    steps, miss, damping = [], (total - goal) * scale, 0.0
    for _ in range(ROUNDS):
        if np.abs(miss).max() < TOLERANCE:
            break
        scaled = (m * scale[:, None] * scale[None, :])[np.ix_(used, used)]
        weights = np.linalg.pinv(scaled + damping * np.trace(scaled) * np.eye(len(used)), rcond=1e-9, hermitian=True)
        step = np.zeros(k)
        step[used] = -(weights @ miss[used]) * scale[used]
        after, m_after = measure([*steps, step.tolist()])
        if np.linalg.norm((after - goal) * scale) < np.linalg.norm(miss):
            steps.append(step.tolist())
            miss, m, damping = (after - goal) * scale, m_after, damping / 4 if damping > 1e-6 else 0.0
        else:
            damping = max(4 * damping, 1e-4)
    missed = {d: float(x) for d, x, g in zip(DOMAINS, miss, goal) if g > 0}
    if np.abs(miss).max() >= TOLERANCE:
        warnings.warn(f"mixing targets are missed by {missed}", stacklevel=2)
    return Fit(steps, missed, keep)


def mix(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, keep: str | None = None) -> DataFrame:
    """One row per document: id, th, n_tokens (words), p0.. (probabilities of DOMAINS), rate, copies, missed.

    copies is rate rounded down or up by a hash of id and text, so that its expectation is rate: how
    often the document is taken. missed is the same in all rows: the largest part of a target by which its
    domain is off, 0 if there are none. With keep, documents whose likeliest domain that is have a rate of 1
    at least. Null and empty texts have no tokens and the prior probabilities; a rate is theirs all the
    same. Labels other than 0 and 1 are ignored; a domain without labelled rows keeps a small prior.
    Repeated rows get equal values and each counts; null ids stay. Other columns are ignored. An empty
    table gives no rows.
    """
    members, _, fit = _fitted(docs, labels, id_col, text_col, targets, keep)
    worst = max(map(abs, fit.missed.values()), default=0.0)
    return members.withColumn("rate", fit.rate()).withColumn("copies", F.floor(F.col("rate") + _place(F.col("id"), F.col("th"))).cast("long")).withColumn("missed", F.lit(worst))


def _place(id_: Column, th: Column) -> Column:
    """Where a document lies between 0 and 1 for rounding its rate."""
    return F.pmod(F.xxhash64(id_, th, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, targets: dict[str, float] | None, keep: str | None) -> tuple[DataFrame, Posterior, Fit]:
    ship(docs.sparkSession)
    model = train(docs, labels, id_col, text_col)
    members = Scratch(docs.sparkSession, "mixing").save(memberships(docs, model, id_col, text_col))
    return members, model, fit_rates(members, targets or TARGETS, keep)


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None, keep: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, each as often as mix() says. Rows are repeated where they are read."""
    _, model, fit = _fitted(docs, labels, id_col, text_col, targets, keep)
    at, place = docs.columns.index(text_col), unused("place", docs.columns)
    placed = docs.select(*docs.columns, _place(F.col(id_col).cast("long"), F.xxhash64(text_col)).alias(place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, p = model.of(b.column(at))
            copies = np.floor(fit.rates(p) + b.column(b.num_columns - 1).to_numpy()).astype(int)
            rows = pa.array(np.repeat(np.arange(len(p)), copies))
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in b.columns[:-1]], schema=pa.schema([b.schema.field(i) for i in range(b.num_columns - 1)]))

    return placed.mapInArrow(run, docs.schema)
