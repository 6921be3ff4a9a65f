"""Exact dedup through an index of cuckoo filters over the digests of live texts.

Two texts are equal when they are identical after every run of white space is
replaced by one space; the digest is the SHA-256 of that. The index consists of

* ``content``: one row per digest, batch and salt with the number of live rows, the
  smallest id and where it stands (what a hit is verified against);
* ``rows``: one row per live document;
* ``filters``: per shard of the digests one cuckoo filter (buckets of 4 fingerprints of
  16 bits) holding one entry per live digest.

A batch is first reduced to its distinct (digest, salt) pairs, so a group of copies,
however large, sends at most ``SALTS`` rows per map task. Within its shard each pair
then asks the filter in order of id: a miss proves that the text is new and enters it;
a hit may be a copy, or another text with the same fingerprint, and is verified against
the content of its digest. Only hits, and the new rows that were hit, take part in that.
A filter that overflows is built again at twice the size from the stored digests of its
shard. A deleted text leaves the filter with its last live row.

No text leaves its scan task, and a task holds one shard of digests at a time, whose
number grows with the input.

Null texts count as empty. Repeated rows are rows of one group, of which exactly one is
kept; a null id names a group only if all of its ids are null. An empty table gives an
empty index and an empty result. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poicraft.llm.common import stored, text_of

#: Fingerprints of a bucket, bits of a fingerprint, and the share of a new filter that is filled.
SLOTS, BITS, LOAD = 4, 16, 0.8
#: Rounds of evictions after which a filter counts as full.
KICKS = 200
#: Batches of an index; beyond that, insert its documents into a new one.
BATCHES = 256
#: Digests per shard aimed at, and parts over which the rows of one digest are spread.
SHARD_KEYS, SALTS = 1 << 17, 64

_PAIR = "shard int, digest binary, salt int, n bigint, first bigint, first_rid bigint, any_rid bigint"
_STATE = "shard int, buckets bigint, slots binary, overflow boolean"


# ---------------------------------------------------------------- one filter


def _mix(fp: np.ndarray) -> np.ndarray:
    """Offset between the two buckets of a fingerprint."""
    return (fp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)


class Cuckoo:
    """Partial-key cuckoo filter; all operations take whole arrays."""

    def __init__(self, buckets: int, slots: bytes | None = None):
        self.m = buckets  # a power of two
        self.slots = (np.zeros((buckets, SLOTS), np.uint16) if slots is None
                      else np.frombuffer(slots, np.uint16).reshape(buckets, SLOTS).copy())

    @classmethod
    def sized(cls, keys: int) -> "Cuckoo":
        return cls(1 << max(0, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD))))))

    def key(self, digests: np.ndarray):
        """``fingerprint, bucket`` of digests (n x 32 bytes)."""
        words = digests.view("<u8")
        fp = (words[:, 1] % np.uint64((1 << BITS) - 1) + np.uint64(1)).astype(np.uint16)
        return fp, (words[:, 0] & np.uint64(self.m - 1)).astype(np.int64)

    def other(self, fp: np.ndarray, b: np.ndarray) -> np.ndarray:
        return b ^ (_mix(fp) & np.uint64(self.m - 1)).astype(np.int64)

    def same(self, fp: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number shared by exactly the keys that the filter can't tell apart."""
        return (np.minimum(b, self.other(fp, b)).astype(np.uint64) << np.uint64(16)) | fp

    def has(self, fp: np.ndarray, b: np.ndarray) -> np.ndarray:
        f = fp[:, None]
        return (self.slots[b] == f).any(1) | (self.slots[self.other(fp, b)] == f).any(1)

    def _place(self, fp: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Puts what finds a free slot of its bucket; returns where that failed."""
        order = np.argsort(b, kind="stable")
        at = b[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        free = (self.slots[at] == 0).cumsum(1)
        fits = free[:, -1] > rank
        slot = (free[fits] > rank[fits, None]).argmax(1)
        self.slots[at[fits], slot] = fp[order][fits]
        left = np.ones(len(b), bool)
        left[order[fits]] = False
        return left

    def insert(self, fp: np.ndarray, b: np.ndarray) -> bool:
        """Enters every key; False if the filter is too full, which loses entries."""
        left = self._place(fp, b)
        fp, b = fp[left], self.other(fp, b)[left]
        for turn in range(KICKS):
            left = self._place(fp, b)
            fp, b = fp[left], b[left]
            if not len(fp):
                return True
            # one key per full bucket takes the place of another, which moves on to its own other bucket
            _, win = np.unique(b, return_index=True)
            slot = (_mix(fp[win]) >> np.uint64(turn % 32)).astype(np.int64) % SLOTS
            out = self.slots[b[win], slot]
            self.slots[b[win], slot] = fp[win]
            fp[win], b[win] = out, self.other(out, b[win])
        return False

    def delete(self, fp: np.ndarray, b: np.ndarray) -> None:
        """Removes one entry per key; the keys must have been entered."""
        while len(fp):
            _, once = np.unique(self.same(fp, b), return_index=True)
            f, at = fp[once], b[once]
            at = np.where((self.slots[at] == f[:, None]).any(1), at, self.other(f, at))
            hit = self.slots[at] == f[:, None]
            found = hit.any(1)
            self.slots[at[found], hit.argmax(1)[found]] = 0
            rest = np.ones(len(fp), bool)
            rest[once] = False
            fp, b = fp[rest], b[rest]

    def state(self, shard: int, overflow: bool = False) -> pa.Table:
        return pa.table({"shard": pa.array([shard], pa.int32()), "buckets": pa.array([self.m], pa.int64()),
                         "slots": [self.slots.tobytes()], "overflow": [overflow]})


def _bytes(digests: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(digests["digest"].to_pylist()), np.uint8).reshape(-1, 32)


def _open(filters: pa.Table, keys: int, buckets: int | None = None) -> Cuckoo:
    if filters.num_rows:
        return Cuckoo(filters["buckets"][0].as_py(), filters["slots"][0].as_py())
    return Cuckoo(buckets) if buckets else Cuckoo.sized(keys)


def _shard_of(key) -> int:
    return key[0].as_py()


def _probe(buckets: int | None):
    """Per shard: the pairs ask and enter the filter in order of id."""

    def run(key, pairs: pa.Table, filters: pa.Table) -> pa.Table:
        pairs = pairs.sort_by([("first", "ascending"), ("digest", "ascending"), ("salt", "ascending")])  # nulls last
        index = _open(filters, pairs.num_rows, buckets)
        fp, b = index.key(_bytes(pairs))
        known = index.has(fp, b)
        _, start, group, size = np.unique(index.same(fp, b), return_index=True, return_inverse=True, return_counts=True)
        miss = np.zeros(len(fp), bool)
        miss[start] = True
        miss &= ~known
        full = not index.insert(fp[miss], b[miss])
        asked = pairs.append_column("suspect", pa.array(known | (size[group] > 1))).append_column("entered", pa.array(miss))
        return pa.concat_tables([asked, index.state(_shard_of(key), full)], promote_options="default")

    return run


def _enter(key, digests: pa.Table, filters: pa.Table) -> pa.Table:
    """Per shard: enters further digests."""
    index = _open(filters, digests.num_rows)
    full = filters.num_rows > 0 and filters["overflow"][0].as_py()
    return index.state(_shard_of(key), full or not index.insert(*index.key(_bytes(digests))))


def _leave(key, digests: pa.Table, filters: pa.Table) -> pa.Table:
    """Per shard: removes the entries of digests that are no longer live."""
    index = _open(filters, 1)
    index.delete(*index.key(_bytes(digests)))
    return index.state(_shard_of(key))


def _rebuild(key, digests: pa.Table, filters: pa.Table) -> pa.Table:
    """Per shard that overflowed: a filter of at least twice the size from the stored digests."""
    buckets = 2 * filters["buckets"][0].as_py()
    while not (index := Cuckoo(buckets)).insert(*index.key(_bytes(digests))):
        buckets *= 2
    return index.state(_shard_of(key))


def _ask(key, digests: pa.Table, filters: pa.Table) -> pa.Table:
    index = _open(filters, 1)
    return digests.append_column("hit", pa.array(index.has(*index.key(_bytes(digests)))))


# ---------------------------------------------------------------- the index


@dataclass(frozen=True)
class Index:
    """A version of the index; every change returns a new one."""

    rows: DataFrame      # digest binary, salt int, doc_id bigint, rid bigint
    content: DataFrame   # _PAIR
    filters: DataFrame   # _STATE
    shards: int
    batches: int = 0


def empty(spark: SparkSession, shards: int) -> Index:
    return Index(spark.createDataFrame([], "digest binary, salt int, doc_id bigint, rid bigint"),
                 spark.createDataFrame([], _PAIR), spark.createDataFrame([], _STATE), shards)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest`` of every row."""
    normal = F.regexp_replace(text_of(text), "[\\x20\\x09-\\x0D]+", " ")
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def _shard(n: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")


def _pairs(rows: DataFrame, shards: int) -> DataFrame:
    """Rows by digest and salt; all buffers have a fixed width, so nothing is sorted."""
    return rows.groupBy("digest", "salt").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("first"), F.min_by("rid", "doc_id").alias("first_rid"),
        F.min("rid").alias("any_rid")).select(_shard(shards).alias("shard"), "digest", "salt", "n", "first", "first_rid", "any_rid")


def _groups(pairs: DataFrame) -> DataFrame:
    """``digest, keep_id, keep_rid, group_size`` of pairs (at most ``SALTS`` rows per digest and batch)."""
    return pairs.groupBy("digest").agg(
        F.min("first").alias("keep_id"), F.coalesce(F.min_by("first_rid", "first"), F.min("any_rid")).alias("keep_rid"),
        F.sum("n").alias("group_size"))


def _by_shard(df: DataFrame, filters: DataFrame, step, schema: str) -> DataFrame:
    return df.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(step, schema)


def _mended(filters: DataFrame, content: DataFrame) -> DataFrame:
    """Filters that overflowed built again from the live digests of their shards."""
    full = filters.filter("overflow")
    if full.isEmpty():
        return filters
    keys = content.join(full.select("shard"), "shard", "left_semi").select("shard", "digest").distinct()
    return stored(filters.filter("not overflow").unionByName(_by_shard(keys, full, _rebuild, _STATE)), "cuckoo-filters")


def insert(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           buckets: int | None = None) -> tuple[Index, DataFrame]:
    """The index with the rows of ``docs`` live, and for each of them ``doc_id, digest,
    keep_id, group_size, kept`` among all live rows.

    ``buckets`` (a power of two) sizes the filter of a shard that has none yet, by
    default to hold the batch.
    """
    if index.batches >= BATCHES:
        raise ValueError(f"an index holds {BATCHES} batches: insert its documents into a new one")
    # A row's place in its batch tells repeated rows apart and spreads a hot group.
    place = F.monotonically_increasing_id()
    rows = stored(digests(docs, doc_id, text).select(
        "digest", F.pmod(place, F.lit(SALTS)).cast("int").alias("salt"), "doc_id",
        (place * F.lit(BATCHES) + F.lit(index.batches)).alias("rid")), "cuckoo-rows")
    probed = stored(_by_shard(_pairs(rows, index.shards), index.filters, _probe(buckets),
                              f"{_PAIR}, suspect boolean, entered boolean, buckets bigint, slots binary, overflow boolean"), "cuckoo-probed")
    pairs = probed.filter("digest is not null").drop("buckets", "slots", "overflow")
    filters = probed.filter("digest is null").select("shard", "buckets", "slots", "overflow")
    content = index.content.unionByName(pairs.drop("suspect", "entered"))
    # Hits are verified against the content of their digest.
    suspects = pairs.filter("suspect")
    old = index.content.join(suspects.select("digest").distinct(), "digest", "left_semi").withColumn("entered", F.lit(True))
    evidence = suspects.drop("suspect").unionByName(old)
    verified = stored(_groups(evidence).join(
        evidence.groupBy("digest").agg(F.max("shard").alias("shard"), F.max("entered").alias("entered")), "digest"), "cuckoo-verified")
    # Texts that only shared a fingerprint get an entry of their own.
    further = verified.filter("not entered").select("shard", "digest")
    filters = _mended(stored(_by_shard(further, filters, _enter, _STATE), "cuckoo-filters"), content)
    alone = pairs.filter("not suspect").select("digest", "salt", F.col("first").alias("keep_id"),
                                               F.coalesce("first_rid", "any_rid").alias("keep_rid"), F.col("n").alias("group_size"))
    copies = suspects.select("digest", "salt").join(verified.drop("shard", "entered"), "digest")
    out = rows.join(alone.unionByName(copies.select(*alone.columns)), ["digest", "salt"]).select(
        "doc_id", "digest", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"))
    return Index(index.rows.unionByName(rows), content, filters, index.shards, index.batches + 1), out


def delete(index: Index, ids: DataFrame, doc_id: str = "doc_id") -> Index:
    """The index without the rows whose id is in ``ids``; unknown and null ids delete nothing."""
    gone = ids.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id")).distinct()
    rows = stored(index.rows.join(gone, "doc_id", "left_anti"), "cuckoo-rows")
    content = stored(_pairs(rows, index.shards), "cuckoo-content")
    key = ["shard", "digest"]
    dead = index.content.select(*key).distinct().join(content.select(*key), key, "left_anti")
    filters = stored(_by_shard(dead, index.filters, _leave, _STATE), "cuckoo-filters")
    return replace(index, rows=rows.select("digest", "salt", "doc_id", "rid"), content=content, filters=filters)


def lookup(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, keep_id, group_size`` of every row, the last two null where no live text is equal.

    The filters answer for most texts that are not live; hits are verified against the content.
    """
    rows = stored(digests(docs, doc_id, text).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "cuckoo-asked")
    pairs = rows.select("digest", "salt").distinct().withColumn("shard", _shard(index.shards))
    asked = stored(_by_shard(pairs, index.filters, _ask, "digest binary, salt int, shard int, hit boolean").filter("hit"), "cuckoo-hits")
    live = _groups(index.content.join(asked.select("digest").distinct(), "digest", "left_semi")).drop("keep_rid")
    return rows.join(asked.join(live, "digest").drop("hit", "shard"), ["digest", "salt"], "left").select(
        "doc_id", "digest", "keep_id", "group_size")


def shards_for(docs: DataFrame) -> int:
    """Shards for an index of a table of this size: at least two per shuffle partition."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * parts, -(-docs.count() // SHARD_KEYS))


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, digest, keep_id, group_size, kept`` of every row of a whole table."""
    return insert(empty(docs.sparkSession, shards_for(docs)), docs, doc_id, text)[1]

