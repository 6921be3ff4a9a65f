"""Toxicity scores with a factorization machine over hashed terms.

A document's terms are its distinct words and their stems (the first letters of
longer words), hashed into buckets; the value of a bucket is the logarithm of how
many distinct words fell into it. The machine adds a bias, a weight per bucket
and, for each pair of buckets, the product of their factors and values: so a pair
such as an insult and a group's name can count for more (or less) than the sum
of both. It is fitted on a bounded sample of labelled rows; all rows are scored.

Terms that say nothing about the label only add noise, so the machine runs over the
buckets that do: those whose presence goes with the label by a chi-square test, and those of
two words that tell together what neither tells alone: for every pair of common words,
the chi-square of the four cases of their presence, beyond that of each word. Both are
tests at a level of significance; nothing is cut by rank or number.

A null text has no terms. Null ids and labels are not learnt from; of several documents
with one id the sample takes that with the smallest hash of its text; equal texts score
alike; an empty table gives an empty result, and no label at all a score of 0.25. Other
columns are not read.
"""

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.llm.common import stored

#: Hash buckets of the terms; lengths of the stems.
BUCKETS = 1 << 20
STEMS = (4, 5, 6, 7)
#: Labelled rows in the training sample, at most (those with the smallest hash of the id).
MAX_TRAIN = 20_000
#: Buckets that the machine uses: in at least so many training rows, with at least this
#: chi-square (about one in a million by chance).
LEAST_ROWS, LEAST_CHI = 5, 24.0
#: Pairs that are tested: of words in at least this share of the training rows; and their
#: least chi-square beyond that of the words, of which there may be millions (p about 1e-12).
PAIR_SHARE, PAIR_CHI = 0.05, 60.0
FACTORS = 8
EPOCHS, RATE = 200, 0.05
#: L2 penalties of weights and factors on the summed loss, so they count for less the more rows there are.
WEIGHT_DECAY, FACTOR_DECAY = 0.05, 1.0
SEED = 7
#: Words whose buckets a task remembers.
CACHE = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def buckets(word: str) -> list[int]:
    """Buckets of the word and its stems."""
    parts = [word] + [word[:k] + "-" for k in STEMS if k < len(word)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Machine:
    """``places`` maps a bucket to its row in ``weight`` and ``factors``."""

    def __init__(self, places: dict[int, int], bias: float = 0.0, weight: np.ndarray | None = None, factors: np.ndarray | None = None):
        self.places, self.bias, self.weight, self.factors = places, bias, weight, factors
        self.known: dict[str, tuple] = {}

    def features(self, text: str | None) -> tuple[list[int], list[float]]:
        """Rows of the text's buckets and their values."""
        if len(self.known) > CACHE:
            self.known.clear()
        known, places, out = self.known, self.places, Counter()
        for w in words(text):
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(places[b] for b in buckets(w) if b in places)
            if at:
                out.update(at)
        rows = sorted(out)
        return rows, [float(np.log2(1 + out[r])) for r in rows]

    def score(self, text: str | None) -> float:
        rows, values = self.features(text)
        x = np.array(values)
        v = self.factors[rows] * x[:, None]
        s = v.sum(axis=0)
        margin = self.bias + self.weight[rows] @ x + 0.5 * (s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(rows: list[list[int]], values: list[list[float]], labels: np.ndarray, n: int, factors: int = FACTORS, seed: int = SEED):
    """Bias, weights and factors by full-batch Adam on the logistic loss."""
    labels = np.asarray(labels, np.float64)
    prior = (labels.sum() + 0.5) / (len(labels) + 2)
    rng = np.random.default_rng(seed)
    p = np.concatenate(([np.log(prior / (1 - prior))], np.zeros(n), rng.normal(0, 0.05, n * factors)))
    if not n or not len(labels):
        return float(p[0]), p[1:1 + n], p[1 + n:].reshape(n, factors)
    at = np.concatenate([np.asarray(r, np.int64) for r in rows])
    x = np.concatenate([np.asarray(v, np.float64) for v in values])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])

    def by_row(a):
        return np.bincount(row, a, len(rows))

    m1, m2 = np.zeros_like(p), np.zeros_like(p)
    for epoch in range(1, EPOCHS + 1):
        w, v = p[1:1 + n], p[1 + n:].reshape(n, factors)
        own = v[at] * x[:, None]
        s = np.stack([by_row(own[:, f]) for f in range(factors)], axis=1)
        margin = p[0] + by_row(w[at] * x) + 0.5 * ((s * s).sum(axis=1) - by_row((own * own).sum(axis=1)))
        d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(labels)
        dx = d[row] * x
        by = dx[:, None] * (s[row] - own)
        grad = np.concatenate((
            [d.sum()], np.bincount(at, dx, n) + WEIGHT_DECAY / len(labels) * w,
            (np.stack([np.bincount(at, by[:, f], n) for f in range(factors)], axis=1) + FACTOR_DECAY / len(labels) * v).ravel()))
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        p = p - RATE * (m1 / (1 - 0.9 ** epoch)) / (np.sqrt(m2 / (1 - 0.999 ** epoch)) + 1e-8)
    return float(p[0]), p[1:1 + n], p[1 + n:].reshape(n, factors)


def _bucket_counts(batches):
    """Rows, toxic rows and rows with a whole word per bucket, added up over the task's rows."""
    rows, toxic, whole = (np.zeros(BUCKETS, np.int64) for _ in range(3))
    for batch in batches:
        for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
            found = [buckets(w) for w in words(text)]
            own = list({b for f in found for b in f})
            rows[own] += 1
            whole[list({f[0] for f in found})] += 1
            if y:
                toxic[own] += 1
    at = np.flatnonzero(rows)
    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (at, rows[at], toxic[at], whole[at])], names=["bucket", "rows", "toxic", "words"])


def telling_pairs(rows: list[np.ndarray], labels: np.ndarray, n: int) -> np.ndarray:
    """Of words 0 to n - 1, those that belong to a pair which tells more than its words do.

    ``rows`` holds the words of each row. Pairs are counted by matrix products over a few
    thousand rows at a time.
    """
    y = np.asarray(labels, bool)
    both, toxic = np.zeros((n, n), np.float32), np.zeros((n, n), np.float32)
    for start in range(0, len(rows), 2048):
        part = rows[start:start + 2048]
        x = np.zeros((len(part), n), np.float32)
        for i, r in enumerate(part):
            x[i, r] = 1
        both += x.T @ x
        x = x[y[start:start + 2048]]
        toxic += x.T @ x
    total, rate = len(rows), y.mean() if len(rows) else 0.0
    if not 0 < rate < 1:
        return np.zeros(0, np.int64)

    def off(count, hits):
        """Chi-square of cases against the common rate."""
        return (hits - count * rate) ** 2 / np.maximum(count * rate * (1 - rate), 1)

    one, hit = both.diagonal().astype(np.float64), toxic.diagonal().astype(np.float64)
    alone = off(one, hit) + off(total - one, y.sum() - hit)
    found = np.zeros(n, bool)
    for i in range(n):
        c, t = both[i].astype(np.float64), toxic[i].astype(np.float64)
        joint = (off(c, t) + off(one[i] - c, hit[i] - t) + off(one - c, hit - t)
                 + off(total - one[i] - one + c, y.sum() - hit[i] - hit + t))
        far = joint - alone[i] - alone >= PAIR_CHI
        far[i] = False
        found |= far
    return np.flatnonzero(found)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
          max_train: int = MAX_TRAIN) -> Machine:
    """A machine fitted on at most ``max_train`` labelled rows (null labels are left out).

    The sample of ids and labels is bounded, so it is broadcast, and each of its rows takes
    one document. The driver gets, for each sampled row, its common words (for the
    pairs) and then the chosen buckets. Without any label every text scores 0.25.
    """
    sample = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter(
        "id is not null and y is not null").distinct().orderBy(F.xxhash64("id", F.lit(SEED)), "id", "y").limit(max_train)
    d = docs.select(F.col(f"`{doc_id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    one = d.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = stored(one.select("id", "y", "text"), "toxicity-sample")
    n, n_toxic = found.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    each = stored(found.select("y", "text").mapInArrow(_bucket_counts, "bucket bigint, rows bigint, toxic bigint, words bigint").groupBy("bucket").agg(
        F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"), F.sum("words").alias("words")).filter(F.col("rows") >= LEAST_ROWS), "toxicity-buckets")
    want = F.col("rows") * (n_toxic / max(n, 1))
    chi = F.pow(F.col("toxic") - want, 2) / F.greatest(want * (1 - F.col("rows") / (n + 1)), F.lit(1e-9))
    chosen = {r.bucket for r in each.filter(chi >= LEAST_CHI).select("bucket").collect()}
    common = sorted(r.bucket for r in each.filter(F.col("words") >= max(LEAST_ROWS, PAIR_SHARE * n)).select("bucket").collect())
    at = {b: i for i, b in enumerate(common)}

    @F.pandas_udf("array<int>")
    def common_words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({at[b] for w in words(t) if (b := buckets(w)[0]) in at}) for t in texts])

    seen = found.select("y", common_words("text").alias("at")).collect() if at else []
    pairs = telling_pairs([np.asarray(r["at"], np.int64) for r in seen], np.array([r.y for r in seen]), len(common))
    chosen |= {common[i] for i in pairs}
    places = {b: i for i, b in enumerate(sorted(chosen))}
    machine = Machine(places)

    @F.pandas_udf("rows array<int>, x array<double>")
    def features(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([machine.features(t) for t in texts], columns=["rows", "x"])

    rows = found.select("id", "y", features("text").alias("f")).select("id", "y", "f.rows", "f.x").collect()
    rows.sort(key=lambda r: (r.id, r.y))
    return Machine(places, *fit([r.rows for r in rows], [r.x for r in rows], np.array([r.y for r in rows]), len(places)))


def scored(text: Column, machine: Machine) -> Column:
    """Probability of the label 1; a null text scores as an empty one."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([machine.score(t) for t in texts], dtype="float64")

    return of(text)


def toxicity(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score``."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), scored(F.col(f"`{text}`").cast("string"), machine).alias("score"))
