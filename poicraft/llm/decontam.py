"""Benchmark decontamination: BM25 over an inverted index of test items, searched
with block-max WAND.

The index holds the test items, each impact divided by the sum of its item's
impacts: a passage that has every term of an item scores 1 on it, whatever the
item's length. Items stand in order of length and are cut into blocks of
neighbours; each posting list keeps its largest impact per block. Every document
is cut into overlapping passages, long enough that each occurrence of an item
lies whole in one of them; every passage is a query that retrieves all items at or
above the threshold: the block maxima of its terms bound the scores of a block's
items, blocks below the threshold are skipped, and within the others WAND moves
the posting lists from pivot to pivot. Each hit is then verified: shingles of the
item's question and of its answer must occur in the passage.

An item of fewer than ``LEAST_ITEM`` tokens says too little to convict a text that shares
them: it is left out (``short_items`` lists these). A part shorter than a shingle never
convicts alone: it must occur as an uninterrupted run beside the verified other part, and
where both are that short the whole item must occur by its shingles.

An index holds items up to a bounded size of text; a larger benchmark gives
several indexes, which are searched one after the other. Document frequencies
are those of all items.
"""

from bisect import bisect_left
from collections import Counter
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.llm.common import stored

THRESHOLD = 0.5
OVERLAP = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
#: Tokens that an item must have to be searched for.
LEAST_ITEM = 8
#: Items per block of an index.
BLOCK = 2
#: Words that are searched at once, about, and bounds (passages times blocks).
WORDS, BOUNDS = 1 << 18, 1 << 20
#: Bytes of item text that one index holds, about.
INDEX_BYTES = 8 << 20
#: A passage is at least twice as many tokens.
LEAST_STRIDE = 32

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

MATCHES = "array<struct<item_id:bigint,passages:int,score:double,question_overlap:double,answer_overlap:double>>"


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """Tokens of the question and the answer of an item given as one text.

    The last sentence is the answer; of a single sentence, the second half.
    """
    sentences = [t for t in map(tokens, _SENTENCE.split(text or "")) if t]
    if len(sentences) > 1:
        return [t for s in sentences[:-1] for t in s], sentences[-1]
    words = sentences[0] if sentences else []
    half = (len(words) + 1) // 2
    return words[:half], words[half:]


def _shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


class Index:
    """Inverted index of some items, with block maxima.

    ``items`` are ``(item_id, question tokens, answer tokens)``; ``df`` has the
    document frequency of their terms among ``n_items`` items of mean length ``mean``.
    """

    def __init__(self, items: list[tuple], df: dict[str, int], n_items: int, mean: float, whole: bool = False):
        #: Whether enough shingles of question and answer together also make a match.
        self.whole = whole
        self.items = sorted((x for x in items if x[1] or x[2]), key=lambda x: (len(x[1]) + len(x[2]), x[0]))
        self.term: dict[str, int] = {}
        post: list[list[tuple[int, float]]] = []
        for k, (_, q, a) in enumerate(self.items):
            tf = Counter(q + a)
            size = K1 * (1 - B + B * (len(q) + len(a)) / mean)
            impact = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + size) for t, n in tf.items()}
            mass = sum(impact.values())
            for t, w in impact.items():
                at = self.term.setdefault(t, len(post))
                if at == len(post):
                    post.append([])
                post[at].append((k, w / mass))
        self.ids = [[k for k, _ in p] for p in post]
        self.impacts = [[w for _, w in p] for p in post]
        self.stride = max([LEAST_STRIDE, *(len(q) + len(a) for _, q, a in self.items)])
        self.n_blocks = -(-len(self.items) // BLOCK)
        self.tops: list[dict[int, float]] = []  # largest impact by block, per term
        for p in post:
            top: dict[int, float] = {}
            for k, w in p:
                top[k // BLOCK] = max(w, top.get(k // BLOCK, 0.0))
            self.tops.append(top)
        # Terms of many blocks as rows of a matrix; the block lists of the others end to end.
        self.dense = np.full(len(post), -1)
        wide = [t for t, top in enumerate(self.tops) if len(top) * 8 > self.n_blocks]
        self.dense[wide] = np.arange(len(wide))
        self.matrix = np.zeros((len(wide), self.n_blocks))
        for row, t in enumerate(wide):
            self.matrix[row, list(self.tops[t])] = list(self.tops[t].values())
        self.count = np.array([0 if self.dense[t] >= 0 else len(top) for t, top in enumerate(self.tops)], np.int64)
        self.start = np.cumsum(self.count) - self.count
        rare = [self.tops[t] for t in range(len(post)) if self.dense[t] < 0]
        self.block = np.array([b for top in rare for b in top], np.int64)
        self.top = np.array([w for top in rare for w in top.values()])

    def _bounds(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Upper bound of the scores by passage and block, from pairs of passage and term."""
        row = self.dense[term]
        has = np.zeros((n, len(self.matrix)))
        has[passage[row >= 0], row[row >= 0]] = 1
        passage, term = passage[row < 0], term[row < 0]
        count = self.count[term]
        at = np.arange(count.sum()) + np.repeat(self.start[term] - (np.cumsum(count) - count), count)
        rare = np.bincount(np.repeat(passage, count) * self.n_blocks + self.block[at], self.top[at], n * self.n_blocks)
        return has @ self.matrix + rare.reshape(n, self.n_blocks)

    def passages(self, texts: list[list[str]], threshold: float):
        """``(text, first word, end, terms, blocks)`` of the passages that may reach the threshold in some blocks.

        A passage is two neighbouring stretches of ``stride`` words of one text.
        """
        known, get, stride = self.term.keys(), self.term.get, self.stride
        terms, counts, before, after, own = [], [], [], [], []  # per stretch: its terms and the two passages it is in
        for i, words in enumerate(texts):
            n = max(1, (len(words) - 1) // stride)
            first = len(own)
            for k, a in enumerate(range(0, len(words), stride)):
                held = known & set(words[a:a + stride])
                terms.extend(map(get, held))
                counts.append(len(held))
                before.append(first + k - 1 if k else -1)
                after.append(first + k if k < n else -1)
            own.extend((i, k * stride) for k in range(n if words else 0))
        n_terms, term = len(self.ids), np.array(terms, np.int64)
        passage = np.concatenate((np.repeat(np.array(before, np.int64), counts), np.repeat(np.array(after, np.int64), counts)))
        pairs = np.unique((passage * n_terms + np.concatenate((term, term)))[passage >= 0])
        passage, term = pairs // n_terms, pairs % n_terms
        step = max(1, BOUNDS // self.n_blocks)
        for first in range(0, len(own), step):
            lo, hi = np.searchsorted(passage, (first, first + step))
            reach = self._bounds(passage[lo:hi] - first, term[lo:hi], min(step, len(own) - first)) >= threshold - 1e-9
            for k in np.flatnonzero(reach.any(axis=1)).tolist():
                i, at = own[first + k]
                a, b = np.searchsorted(passage, (first + k, first + k + 1))
                yield i, at, at + 2 * stride, term[a:b].tolist(), np.flatnonzero(reach[k]).tolist()

    def search(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All ``(item, score)`` of the block at or above the threshold for a passage with these terms."""
        least, end, found = threshold - 1e-9, (block + 1) * BLOCK, []
        open_ = []  # item, place in the list, term, largest impact in the block
        for t in terms:
            if block in self.tops[t]:
                at = bisect_left(self.ids[t], block * BLOCK)
                open_.append([self.ids[t][at], at, t, self.tops[t][block]])
        while open_:
            open_.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(open_):
                bound += c[3]
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = open_[pivot][0]
            if open_[0][0] == item:
                score = sum(self.impacts[c[2]][c[1]] for c in open_ if c[0] == item)
                if score >= least:
                    found.append((item, score))
                item += 1
            for c in open_:
                if c[0] < item:
                    ids = self.ids[c[2]]
                    c[1] = bisect_left(ids, item, c[1])
                    c[0] = ids[c[1]] if c[1] < len(ids) else end
            open_ = [c for c in open_ if c[0] < end]
        return found

    def matches(self, texts: list[str | None], threshold: float, overlap: float, shingle: int) -> list[list[tuple]]:
        """For each text ``(item_id, passages, score, question overlap, answer overlap)`` of the items that it holds."""
        out: list[dict] = []
        some: list[list[str]] = []
        size = 0
        for text in texts:
            some.append(tokens(text))
            size += len(some[-1])
            if size >= WORDS:
                out += self._matches(some, threshold, overlap, shingle)
                some, size = [], 0
        out += self._matches(some, threshold, overlap, shingle)
        return [[(i, *v) for i, v in sorted(found.items())] for found in out]

    def _matches(self, texts: list[list[str]], threshold: float, overlap: float, shingle: int) -> list[dict]:
        out: list[dict] = [{} for _ in texts]
        for i, a, b, terms, blocks in self.passages(texts, threshold):
            hits = [hit for block in blocks for hit in self.search(terms, block, threshold)]
            passage, grams = texts[i][a:b] if hits else [], {}

            def held(part):
                n = min(shingle, len(part))
                if not n:
                    return 1.0
                if n not in grams:
                    grams[n] = _shingles(passage, n)
                own = _shingles(part, n)
                return len(own & grams[n]) / len(own)

            for k, score in hits:
                item_id, question, answer = self.items[k]
                q, r = held(question), held(answer)
                alone = max(len(question), len(answer)) >= shingle
                if alone and q >= overlap and r >= overlap or (self.whole or not alone) and held(question + answer) >= overlap:
                    n, s, q0, r0 = out[i].get(item_id, (0, 0.0, 0.0, 0.0))
                    out[i][item_id] = (n + 1, max(s, score), max(q, q0), max(r, r0))
        return out


def _parted(items: DataFrame, item_id: str, text: str, answer: str | None) -> DataFrame:
    """``item_id, q, a``: the tokens of every item's question and answer."""

    @F.pandas_udf("struct<q:array<string>,a:array<string>>")
    def split_item(text: pd.Series, other: pd.Series) -> pd.DataFrame:
        split = [question_answer(t) if answer is None else (tokens(t), tokens(o)) for t, o in zip(text, other)]
        return pd.DataFrame({"q": [q for q, _ in split], "a": [a for _, a in split]})

    own, other = (F.col(f"`{c}`").cast("string") for c in (text, answer or text))
    return items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), split_item(own, other).alias("p")).select("item_id", "p.q", "p.a")


def short_items(items: DataFrame, item_id: str = "item_id", text: str = "text", answer: str | None = None) -> DataFrame:
    """``item_id, n_tokens`` of the items that are too short to be searched for."""
    return _parted(items, item_id, text, answer).select("item_id", (F.size("q") + F.size("a")).alias("n_tokens")).filter(f"n_tokens < {LEAST_ITEM}")


def build_indexes(items: DataFrame, item_id: str = "item_id", text: str = "text", answer: str | None = None,
                  index_bytes: int = INDEX_BYTES) -> list[Index]:
    """Indexes that together hold all items. Items without an id or of fewer than ``LEAST_ITEM`` tokens are left out.

    With ``answer``, ``text`` is the question and that column the answer. Without,
    the last sentence counts as the answer, and an item is also held by a text that
    has enough of the whole item's shingles.
    """

    n_bytes = items.agg(F.sum(F.octet_length(F.col(f"`{text}`").cast("string")))).first()[0] or 0
    parts = max(1, math.ceil(n_bytes / index_bytes))
    rows = stored(_parted(items, item_id, text, answer).filter(f"item_id is not null and size(q) + size(a) >= {LEAST_ITEM}").select(
        "item_id", "q", "a", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")).distinct(), "decontam-items")
    n_items, mean = rows.agg(F.count("*"), F.avg(F.size("q") + F.size("a"))).first()
    terms = rows.select("part", F.explode(F.array_distinct(F.concat("q", "a"))).alias("term"))
    df = terms.groupBy("term").count()
    out = []
    for b in range(parts):
        some = [(r.item_id, r.q, r.a) for r in rows.filter(F.col("part") == b).orderBy("item_id", "q", "a").collect()]
        if some:
            its = terms.filter(F.col("part") == b).select("term").distinct() if parts > 1 else None
            counts = dict(map(tuple, (df.join(its, "term") if its else df).select("term", "count").collect()))
            out.append(Index(some, counts, n_items, mean, answer is None))
    return out


def contamination(spark, text: Column, index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                  shingle: int = SHINGLE) -> Column:
    """The items of one index that a text holds, as an array of structs (``MATCHES``)."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf(MATCHES)
    def of(texts: pd.Series) -> pd.Series:
        index = shared.value
        names = ("item_id", "passages", "score", "question_overlap", "answer_overlap")
        return pd.Series([[dict(zip(names, m)) for m in found] for found in index.matches(list(texts), threshold, overlap, shingle)])

    return of(text)


def contaminated(docs: DataFrame, indexes: list[Index], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and test item that it holds: ``doc_id, item_id, passages,
    score, question_overlap, answer_overlap``. Null and empty texts hold no item."""
    own, spark = F.col(f"`{text}`").cast("string"), docs.sparkSession
    each = [contamination(spark, own, index) for index in indexes] or [F.array().cast(MATCHES)]
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.explode(F.concat(*each)).alias("m")).select("doc_id", "m.*")


def decontaminate(docs: DataFrame, indexes: list[Index], text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no test item. Null and empty texts hold none and stay; repeated
    rows stay or go together; without items, or on an empty table, nothing goes. Other columns are only passed on."""
    for index in indexes:
        docs = docs.filter(F.size(contamination(docs.sparkSession, F.col(f"`{text}`").cast("string"), index)) == 0)
    return docs
