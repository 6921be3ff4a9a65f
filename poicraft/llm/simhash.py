"""SimHash near-duplicates by tiled exact comparison.

Every document gets a 64-bit fingerprint of its word shingles. Two fingerprints
are linked if at most ``radius`` bits differ. Links are found by comparing tiles
(bounded blocks of fingerprints) exactly with numpy exclusive-or and bit counts;
a pair of rows or tiles whose population counts differ beyond the radius cannot
be linked and is skipped.

Comparing every tile with every other costs the square of the corpus, so tiles are
cut within *keys*: the 64 bits are divided into ``SEGMENTS`` segments, of which at
least ``SEGMENTS - radius`` agree between any two linked fingerprints; one key per
choice of that many segments therefore brings each linked pair together at least
once, and no link is lost. The rows of all keys are range-partitioned by key,
population count and fingerprint. A key that holds very many fingerprints
spreads over many tasks; its tiles are stored and compared pairwise in a second
pass. Within a tile only a spanning forest of the links is returned, never all
pairs of a group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.llm.common import rows_by_id, stored
from poicraft.llm.components import smallest_reachable

SHINGLE = 4
SEED = 42
RADIUS = 4
#: The bits are cut into this many segments; it must be over the radius.
SEGMENTS = 6
#: Rows of a tile, at most.
TILE = 2048
#: Keys of up to this many rows are compared by shifting the whole chunk.
SHORT = 128
#: Rows that a task gathers before it compares them.
CHUNK = 1 << 18


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of one text: bit set if it is set in over half the shingle hashes.

    A-Z are lower-cased, words are what ASCII white space separates, repeated
    shingles count each time; fewer words than a shingle give the whole sequence
    as the only shingle, no word gives zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed=seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed=seed) for a, b in zip(first, ends[shingle - 1:].tolist())),
                         "<u8", len(first))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        part = hashes[k:k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a bigint with the same bits."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        prints = [simhash(None if t is None else t.encode(), shingle, seed) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))

    return of(text)


def _segments(n: int) -> list[int]:
    """Masks of n segments that cover 64 bits."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def _keyed(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """``part, key, ones, fp, rep``: a row for each fingerprint and choice of segments."""
    masks = [sum(c) for c in combinations(_segments(segments), segments - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key"))
                     for i, m in enumerate(signed)])
    return prints.select("fp", "rep", F.bit_count("fp").alias("ones"), F.explode(keys).alias("k")).select(
        "k.part", "k.key", "ones", "fp", "rep")


class _Forest:
    """Union-find over the rows of one comparison; keeps the links that join two trees."""

    def __init__(self, n: int):
        self.up, self.links = np.arange(n), []

    def _find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        new = self.up[a] != self.up[b]  # after the last call, up holds roots
        if not new.any():
            return
        for i, j in zip(a[new].tolist(), b[new].tolist()):
            x, y = self._find(i), self._find(j)
            if x != y:
                self.up[max(x, y)] = min(x, y)
                self.links.append((i, j))
        while (self.up != (up := self.up[self.up])).any():
            self.up = up


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= radius


def _compare(fa: np.ndarray, fb: np.ndarray, ra: np.ndarray, rb: np.ndarray, radius: int, same: bool) -> list:
    """Forest of the links between two tiles, each sorted by population count.

    Blocks of rows of one tile meet only the stretch of the other whose
    population counts are within the radius.
    """
    fa, fb = fa.view(np.uint64), fb.view(np.uint64)
    ones_a, ones_b = np.bitwise_count(fa).astype(np.int16), np.bitwise_count(fb).astype(np.int16)
    n = len(fa)
    forest = _Forest(n if same else n + len(fb))
    step = 16
    for i in range(0, n, step):
        block = fa[i:i + step]
        lo, hi = ones_a[i:i + step].min() - radius, ones_a[i:i + step].max() + radius
        x = max(i if same else 0, int(np.searchsorted(ones_b, lo, "left")))
        y = int(np.searchsorted(ones_b, hi, "right"))
        r, c = np.nonzero(_near(block[:, None], fb[None, x:y], radius))
        r, c = r + i, c + x
        if same:
            r, c = r[r < c], c[r < c]
        forest.add(r, c if same else c + n)
    ids = ra if same else np.concatenate((ra, rb))
    return [(int(ids[i]), int(ids[j])) for i, j in forest.links]


def _compare_short(fp: np.ndarray, rep: np.ndarray, key: np.ndarray, size: np.ndarray, radius: int) -> list:
    """Forest of the links within many short keys at once: each row meets the row
    ``d`` places on, for every d below the longest key."""
    fp, forest = fp.view(np.uint64), _Forest(len(fp))
    place = np.arange(len(fp))
    for d in range(1, int(size.max(initial=1))):
        place = place[place + d < len(fp)]
        place = place[key[place] == key[place + d]]  # keys are runs
        if not len(place):
            break
        hit = place[_near(fp[place], fp[place + d], radius)]
        forest.add(hit, hit + d)
    return [(int(rep[i]), int(rep[j])) for i, j in forest.links]


FOUND = "a bigint, b bigint, tile bigint, part int, key bigint, low int, high int, fps binary, reps binary"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tile", pa.int64()), ("part", pa.int32()), ("key", pa.int64()),
                    ("low", pa.int32()), ("high", pa.int32()), ("fps", pa.binary()), ("reps", pa.binary())])


def _edge_batch(edges: list) -> pa.RecordBatch:
    a, b = (np.array(x, np.int64) for x in (zip(*edges) if edges else ((), ())))
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)] + [pa.nulls(n, f.type) for f in list(_FOUND)[2:]], schema=_FOUND)


def _scan_sorted(radius: int, tile: int):
    """Task over rows sorted by part, key, ones, fp: links within its tiles, and the
    tiles of keys that have more than one tile or may go on in another task."""

    def scan(batches):
        task, made = TaskContext.get().partitionId(), 0
        held: list = []  # columns of rows not yet compared
        split = True  # the first held key may have rows elsewhere: in the task before, or in tiles already written

        def tiles(part, key, fp, rep):
            nonlocal made
            out, edges = [], []
            for i in range(0, len(fp), tile):
                f, r = fp[i:i + tile], rep[i:i + tile]
                edges += _compare(f, f, r, r, radius, True)
                ones = np.bitwise_count(f.view(np.uint64))
                out.append((None, None, (task << 32) + made, int(part), int(key), int(ones.min()), int(ones.max()),
                            f.tobytes(), r.tobytes()))
                made += 1
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)
            return [rows, _edge_batch(edges)]

        def work(cols, last):
            """Compare the keys that are complete; give back the rows of the open one."""
            nonlocal split
            part, key, fp, rep = cols
            starts = np.concatenate(([0], np.flatnonzero((part[1:] != part[:-1]) | (key[1:] != key[:-1])) + 1))
            sizes = np.diff(np.concatenate((starts, [len(fp)])))
            as_tiles, rest, out = sizes > tile, None, []
            as_tiles[0] |= split
            if last:
                as_tiles[-1] = True  # it may go on in the next task
            else:
                s, n = int(starts[-1]), int(sizes[-1])
                whole = n // tile * tile if n >= CHUNK else 0
                if whole:
                    out += tiles(part[s], key[s], fp[s:s + whole], rep[s:s + whole])
                split = split and len(starts) == 1 or whole > 0
                rest = tuple(c[s + whole:] for c in cols) if whole < n else None
                starts, sizes, as_tiles = starts[:-1], sizes[:-1], as_tiles[:-1]
            short = ~as_tiles & (sizes > 1) & (sizes <= SHORT)
            rows = np.flatnonzero(np.repeat(short, sizes))
            if len(rows):
                run = np.repeat(np.arange(len(sizes)), sizes)[rows]
                out.append(_edge_batch(_compare_short(fp[rows], rep[rows], run, sizes[short], radius)))
            for i in np.flatnonzero(as_tiles | (sizes > SHORT)).tolist():
                f, r = (c[starts[i]:starts[i] + sizes[i]] for c in (fp, rep))
                out += (tiles(part[starts[i]], key[starts[i]], f, r) if as_tiles[i]
                        else [_edge_batch(_compare(f, f, r, r, radius, True))])
            return out, rest

        def joined():
            return tuple(np.concatenate(c) for c in zip(*held))

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("part", "key", "fp", "rep")))
            if sum(len(h[0]) for h in held) >= CHUNK:
                done, rest = work(joined(), False)
                held = [rest] if rest is not None else []
                yield from done
        if held:
            yield from work(joined(), True)[0]

    return scan


def _pair_links(radius: int):
    def link(batches):
        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("fps", "reps", "fps2", "reps2")]
            edges = []
            for row in zip(*cols):
                fa, ra, fb, rb = (np.frombuffer(x, np.int64) for x in row)
                edges += _compare(fa, fb, ra, rb, radius, False)
            a, b = (np.array(x, np.int64) for x in (zip(*edges) if edges else ((), ())))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return link


def near_links(prints: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, tile: int = TILE) -> DataFrame:
    """``a, b``: links between the ``rep`` of different fingerprints of ``prints (fp, rep)``.

    ``fp`` is unique and ``rep`` a non-null integer. Every two fingerprints
    within the radius are joined by a path of links.
    """
    if not 0 <= radius < segments:
        raise ValueError("segments must be over the radius")
    spark = prints.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("part", "key", "ones", "fp")
    dealt = _keyed(prints, radius, segments).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(_scan_sorted(radius, tile), FOUND), "simhash-tiles")
    tiles = found.filter("tile is not null")
    small = tiles.select("tile", "part", "key", "low", "high")
    other = small.select(F.col("tile").alias("tile2"), "part", "key", F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = small.join(other, ["part", "key"]).filter(
        (F.col("tile") < F.col("tile2")) & (F.col("low2") - F.col("high") <= radius) & (F.col("low") - F.col("high2") <= radius))
    blobs = tiles.select("tile", "fps", "reps")
    pairs = (pairs.select("tile", "tile2").join(blobs, "tile")
             .join(blobs.select(F.col("tile").alias("tile2"), F.col("fps").alias("fps2"), F.col("reps").alias("reps2")), "tile2"))
    crossed = pairs.select("fps", "reps", "fps2", "reps2").repartition(parts).mapInArrow(_pair_links(radius), "a bigint, b bigint")
    return found.filter("a is not null").select("a", "b").union(crossed)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id, n_copies``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, itself
    included; ``n_copies`` counts the rows of the same fingerprint. Texts without
    words (also null) have fingerprint zero, linked like any other. A row without
    ``doc_id`` gets its fingerprint and counts as a copy but names no component.
    """
    rows = stored(docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"),
                              fingerprint(F.col(f"`{text}`").cast("string"), shingle).alias("fp")), "simhash-rows")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")), "simhash-prints")
    roots = smallest_reachable(near_links(prints.filter("rep is not null").select("fp", "rep"), radius))
    named = stored(prints.join(roots, prints.rep == roots.node, "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id"), "n_copies"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "n_copies")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                         radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component stays.

    It is the one with the smallest id; of rows that repeat this id, the smallest
    text stays. Rows without an id always stay.
    """
    found = near_duplicates(docs, doc_id, text, shingle, radius)
    first = stored(found.filter("doc_id = component_id").groupBy("doc_id").count(), "simhash-first")
    kept = rows_by_id(docs, first, doc_id, "doc_id", "left_semi").unionByName(docs.filter(F.col(f"`{doc_id}`").isNull()))
    again = first.filter("count > 1")
    if again.isEmpty():
        return kept
    names = docs.columns
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.col(f"`{text}`"))
    once = rows_by_id(kept, again, doc_id, "doc_id", "left_anti")
    more = (rows_by_id(docs, again, doc_id, "doc_id", "left_semi").groupBy(F.col(f"`{doc_id}`").alias("_id"))
            .agg(row.alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in names]))
    return once.unionByName(more)
