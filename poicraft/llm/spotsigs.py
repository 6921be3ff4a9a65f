"""SpotSigs fingerprints (DataFrame functions only).

A signature is an anchor, one of the commonest words, with the chain of the next
content words (words that are no anchor). Where anchors follow each other, the
last one counts. The set of a text's signatures is its fingerprint: it follows
the prose, and not the navigation and lists around it. A text without a whole
chain has one signature, made of all its words.

Two sets are compared by Jaccard likeness, pruned by their lengths: a set can't
be more alike to another than the ratio of their lengths. For near-duplicate
matches, sets are partitioned by length so that only neighbouring partitions can
hold a match, and indexed by their rarer signatures only. Links inside a large group
of near copies are counted by their distances from the group's centre, without a row
for each pair.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poicraft.llm.common import stored, text_of

#: Anchors (fixed values): very common words of English, German, French and Spanish.
ANCHORS = tuple(
    "the a of and to in is that it for as was with be by on are this from or"
    " der die das und ist von zu mit den ein im des"
    " le la les de et un une en que qui dans pour"
    " el los las y es del se con por al".split())
CHAIN = 3


#: Documents of one block of the order by id, about, and blocks at most.
BLOCK_ROWS, MAX_BLOCKS = 2000, 16_384
#: Buckets of the signatures' frequencies.
LEVELS = 1 << 18
#: Cuts between blocks that are searched together.
CUTS = 128
#: Sets of one low signature and length partition from which a centre is sought, rows it is
#: fitted on at least (below twice as many on average), and low signatures of a set that lead to centres.
GROUP, FITTED, LOWEST = 64, 32, 4
#: Level from which a signature is common, and common first signatures of a set by which a pair met before is known.
COMMON, BEFORE = 6, 4
#: A length partition of the index is so many ratios ``1 / least`` wide.
WIDE = 3


def with_signatures(df: DataFrame, text: str, out: str, anchors=ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the sorted set of the text's signature hashes as a new column ``out``."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    any_ = "(?:" + "|".join(sorted(anchors)) + ")"
    # The word behind an anchor becomes anchor^word; the anchors before that one go. Java's
    # regular expressions recurse on a repeated group, so a run of anchors is not one match.
    marked = F.regexp_replace(words, f" ({any_}) (?!{any_} )", " $1^")
    marked = F.regexp_replace(marked, f" {any_}(?= )", "")
    content = F.filter(F.split(F.trim(marked), " "), lambda w: ~w.endswith("^"))
    df = df.select("*", content.alias(f"{out}_words"))
    words = F.col(f"{out}_words")
    bare = lambda i, k: F.substring_index(F.element_at(words, i + 1 + k), "^", -1)
    chains = F.transform(words, lambda w, i: F.when(
        (F.instr(w, "^") > 0) & (i + chain <= F.size(words)), F.xxhash64(w, *[bare(i, k) for k in range(1, chain)])))
    df = df.select("*", F.array_sort(F.array_distinct(F.filter(chains, lambda h: h.isNotNull()))).alias(f"{out}_found"))
    found = F.col(f"{out}_found")
    return df.select("*", F.when(F.size(found) > 0, found).otherwise(
        F.array(F.xxhash64(F.array_join(words, " ")))).alias(out)).drop(f"{out}_words", f"{out}_found")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets, 0 where their lengths rule out ``least``."""
    ratio = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when(ratio >= least, shared / (F.size(a) + F.size(b) - shared)).otherwise(F.lit(0.0))


def fingerprint(signatures: Column) -> Column:
    """A set's digest: its length and the SHA-256 of its sorted hashes."""
    return F.concat_ws(":", F.size(signatures).cast("string"), F.sha2(F.array_join(F.transform(
        signatures, lambda h: h.cast("string")), ","), 256))


def _block(value: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the value, found in two steps; -1 for null."""
    def numbers(some):
        return F.split(F.lit(",".join(map(str, some))), ",").cast("array<bigint>")

    def below(array):
        return F.size(F.filter(array, lambda c: c <= value))

    if not cuts:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    group = below(numbers(cuts[::CUTS]))  # of the groups of cuts, those that begin at or below
    inner = F.greatest(group - 1, F.lit(0)) * CUTS
    return F.when(value.isNull(), F.lit(-1)).otherwise(inner + below(F.slice(numbers(cuts), inner + 1, F.lit(CUTS))))


def with_next(docs: DataFrame, doc_id: str, text: str, out: str) -> DataFrame:
    """``doc_id, text, <out>, next_text, next_<out>``: each row with its signatures and the
    row that follows it in descending order of id; the first row follows the last.

    Rows of one id stand in order of a hash of the text, rows without id come last.
    The order is cut into blocks of ids of about ``BLOCK_ROWS`` rows, by
    approximate quantiles; each block also gets a copy of the first row of the
    block after it, so a window within blocks finds every row's successor.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text")).select("*", F.xxhash64("text").alias("tie"))
    n = docs.count()
    blocks = max(1, min(MAX_BLOCKS, n // BLOCK_ROWS))
    found = rows.agg(F.percentile_approx("doc_id", [k / blocks for k in range(1, blocks)] or [0.5], 10 * MAX_BLOCKS)).first()[0]
    block = _block(F.col("doc_id"), sorted(set(found or [])) if blocks > 1 else [])
    rows = rows.select("*", block.alias("block"))
    # One row per block: at most MAX_BLOCKS + 1, so small enough for one task and a broadcast.
    order = Window.orderBy(F.col("block").desc())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = rows.groupBy("block").agg(F.max("doc_id").alias("top")).select(
        "block", "top", F.coalesce(F.lag("block").over(order), F.min("block").over(every)).alias("to"))
    t = F.broadcast(tops.select(F.col("block").alias("of"), "top", "to"))
    heads = rows.join(t, (F.col("block") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")))
    first = heads.groupBy("of").agg(F.min("tie").alias("first"))
    heads = heads.join(F.broadcast(first), "of").filter("tie = first").select("doc_id", "text", "tie", F.col("to").alias("block"), F.lit(1).alias("copy"))
    both = rows.select("doc_id", "text", "tie", "block", F.lit(0).alias("copy")).unionByName(heads)
    both = with_signatures(both.repartition(blocks, "block"), "text", out)
    w = Window.partitionBy("block").orderBy("copy", F.col("doc_id").desc_nulls_last(), "tie")
    return both.select("doc_id", "text", out, "copy", F.lead("text").over(w).alias("next_text"), F.lead(out).over(w).alias(f"next_{out}")).filter(
        "copy = 0").drop("copy")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_chars, edited, sigs, edited_sigs, next_sigs``.

    ``edited`` is the text with its second half (rounded down, in code points)
    replaced by the first as many code points of the next document, in
    descending order of id. A null text is empty.
    """
    rows = with_next(docs, doc_id, text, "sigs")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sigs", "next_sigs", edited.alias("edited"))
    return with_signatures(rows, "edited", "edited_sigs")


def signature_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, sigs`` for every input row; a null text is empty."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    return with_signatures(rows, "text", "sigs").select("doc_id", "sigs")


def _sets(prints: DataFrame) -> DataFrame:
    """``sigs, id, doc_id, copies``: the distinct sets of the rows with an id, each with its number of rows.

    ``doc_id`` is the smallest of the rows. As it may be repeated with another text, a set
    also has a number of its own, ``id``, which is fixed as the sets are stored.
    """
    return stored(prints.filter("doc_id is not null").groupBy("sigs").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select(
        "sigs", F.monotonically_increasing_id().alias("id"), "doc_id", "copies"), "spot-sets")


def _levels(sets: DataFrame) -> bytearray:
    """By bucket of the signatures' hash: the logarithm of how many more signatures it has than a bucket without a common one.

    Counted by bucket before the shuffle, so that not every signature travels."""
    found = sets.select(F.explode("sigs").alias("s")).groupBy(F.pmod("s", F.lit(LEVELS)).cast("int").alias("at")).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(LEVELS)
    counts[found["at"].to_numpy()] = found["n"].to_numpy()
    usual = np.median(counts)
    more = np.maximum(counts - usual - 4 * np.sqrt(usual), 1)
    return bytearray(np.log2(more).astype(np.uint8).tobytes())


def _part(n: Column, least: float) -> Column:
    """Partition of a set's length: a match lies in the same or the next one."""
    return F.floor(F.log(n) / F.log(F.lit(1 / least)) + 1e-9)


def _weights(least: float) -> tuple[int, int]:
    """``least`` as a fraction, so that likenesses are compared in whole numbers."""
    part = Fraction(least).limit_denominator(1_000_000)
    return part.numerator, part.denominator


def _centres(keys: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``s, part, m, centre, g``: centres of the keys (a low signature and a length partition) of many sets.

    A centre holds the signatures that most of a key's sets have, by a sample of them of about
    ``FITTED`` rows. Keys whose sets are far from it on average are left out, those up to twice
    as far as a link allows not yet, as half of their sets may be near. Which centres
    there are decides the work, not the result; ``g`` is the hash of the centre.
    """
    num, den = _weights(least)
    many = stored(keys.groupBy("s", "part").agg(F.count("*").alias("m")).filter(F.col("m") >= GROUP), "spot-many")
    every = F.greatest(F.lit(1), F.floor(F.col("m") / FITTED))
    fitted = stored(keys.join(many, ["s", "part"]).filter(F.pmod(F.xxhash64("id", "s"), every) == 0), "spot-fitted")
    held = fitted.join(sets.select("id", "sigs"), "id").select("s", "part", "m", F.explode("sigs").alias("e"))
    counted = held.groupBy("s", "part", "m", "e").agg(F.count("*").alias("c"))
    counted = counted.join(fitted.groupBy("s", "part").agg(F.count("*").alias("k")), ["s", "part"])
    most = F.col("c") * 2 > F.col("k")
    found = counted.groupBy("s", "part", "m", "k").agg(
        F.sort_array(F.collect_list(F.when(most, F.col("e")))).alias("centre"),
        F.sum(F.when(most, den * (F.col("k") - F.col("c"))).otherwise(num * F.col("c"))).alias("far"))
    found = found.filter(F.col("far") <= F.col("k") * F.size("centre") * (den - num) * 2)
    return found.select("s", "part", "m", "centre", F.xxhash64("centre").alias("g"))


def _near(sets: DataFrame, least: float) -> DataFrame:
    """``id, copies, g, w, room``: the sets near a centre ``g`` of a large group of near copies.

    A set that lacks r signatures of the centre c and has a others shares with another such
    set |c| - r - r' of the centre's signatures at least, so the two have a likeness of
    num/den or more if w + w' is within (den - num) |c|, where w = den r + num a. ``room``
    is that bound less ``w``: of two sets of one ``g``, each ``w`` is within the other's room, or neither is.
    """
    num, den = _weights(least)
    keys = stored(sets.select("id", _part(F.size("sigs"), least).alias("part"), F.explode(F.slice("sigs", 1, LOWEST)).alias("s")), "spot-keys")
    centres = stored(_centres(keys, sets, least), "spot-centres")
    # Stored, so that the plan knows how few these rows are and leaves the sets where they lie.
    own = stored(keys.join(centres.select("s", "part", "g"), ["s", "part"]).select("id", "g").distinct(), "spot-own")
    rows = sets.join(own, "id").join(centres.groupBy("g").agg(F.first("centre").alias("centre")), "g")
    shared, centre = F.size(F.array_intersect("sigs", "centre")), F.size("centre").cast("bigint")
    w = (centre - shared) * den + (F.size("sigs") - shared).cast("bigint") * num
    rows = rows.select("id", "copies", "g", w.alias("w"), (centre * (den - num) - w).alias("room")).filter("room >= 0")
    nearest = rows.groupBy("id").agg(F.max(F.struct("room", "g", "w", "copies")).alias("x"))
    return stored(nearest.select("id", "x.copies", "x.g", "x.w", "x.room"), "spot-near")


def _near_links(near: DataFrame) -> DataFrame:
    """``id, linked``: the rows of the other sets of the same centre within the set's room.

    Counted by distinct values of ``w``, of which a centre has at most a few times its size.
    """
    sums = near.groupBy("g", "w", "room").agg(F.sum("copies").alias("c"))
    points = sums.select("g", "w", F.col("w").alias("at"), F.lit(0).alias("asks"), "c").unionByName(
        sums.select("g", "w", F.col("room").alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("bigint").alias("c")))
    order = Window.partitionBy("g").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = points.select("g", "w", "asks", F.sum("c").over(order).alias("rows")).filter("asks = 1").drop("asks")
    own = F.when(F.col("w") <= F.col("room"), F.col("copies")).otherwise(F.lit(0))
    return near.join(within, ["g", "w"]).select("id", (F.col("rows") - own).alias("linked"))


def _sketch(signatures: str) -> list[Column]:
    """128 bits of a set, each the parity of the signatures hashed to it: two sketches differ
    in no more bits than the sets in signatures."""
    one = F.lit(1).cast("bigint")
    bit = lambda s: F.call_function("shiftleft", one, s.bitwiseAND(F.lit(63)).cast("int"))
    return [F.aggregate(F.filter(signatures, lambda s: s.bitwiseAND(F.lit(64)) == 64 * k), F.lit(0).cast("bigint"),
                        lambda x, s: x.bitwiseXOR(bit(s))).alias(f"bits{k}") for k in (0, 1)]


def _candidates(sets: DataFrame, least: float, near: DataFrame | None = None) -> DataFrame:
    """``a, b``: pairs of ``sets (id, sigs)``, among them every one with a likeness of ``least`` or more,
    but for those that ``near`` (``_near``) proves; a pair may come more than once.

    ``a`` is the smaller set, of equally large ones that with the smaller number.

    Sets are partitioned by the logarithm of their length, so a match lies in one
    partition or two neighbouring ones. The signatures of every set stand in one
    order, rare ones first (by ``_levels``, then by value); of two alike sets the
    first few share one, so only these are indexed, and words that very many sets
    share lead to no candidates. The order decides the work, not the result. A
    candidate's shared signature taken for their first, the signatures behind it
    bound what the two can share; their sketches bound in how many they differ. Where
    both hold one of the other's first common signatures, they have met there and
    don't meet again at a later one.
    """
    num, den = _weights(least)
    levels = F.lit(_levels(sets))
    ordered = F.array_sort(F.transform("sigs", lambda s: F.struct(
        F.substr(levels, F.pmod(s, F.lit(LEVELS)).cast("int") + 1, F.lit(1)).alias("level"), s.alias("s"))))
    rows = sets.select("id", F.size("sigs").cast("bigint").alias("n"), *_sketch("sigs"), ordered.alias("ordered"))
    if near is None:
        rows = rows.select("*", F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("bigint").alias("over"))
    else:
        rows = rows.join(near.select("id", "g", (F.col("w") - F.col("room")).alias("over")), "id", "left")
    length = lambda n: _part(n, least ** WIDE).cast("int")
    first = F.slice("ordered", 1, (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int"))
    rows = rows.select("id", "n", "bits0", "bits1", "g", "over", first.alias("first"))
    rare = F.size(F.filter("first", lambda x: x["level"] < F.lit(bytearray([COMMON]))))
    rows = rows.select("id", "n", "bits0", "bits1", "g", "over", F.transform("first", lambda x: x["s"]).alias("first"), rare.alias("rare"))
    rows = rows.select("*", F.posexplode("first").alias("at", "s"))
    before = F.when(F.col("at") > F.col("rare"), F.slice("first", F.col("rare") + 1, F.least(F.col("at") - F.col("rare"), F.lit(BEFORE))))
    index = stored(rows.select("id", "n", "bits0", "bits1", "g", "over", length(F.col("n")).alias("part"), "s",
                               (F.col("n") - F.col("at")).alias("rest"), before.alias("before")), "spot-index")
    # The smaller of two alike sets shares more of its signatures, so fewer of its first are
    # needed; the signatures behind one bound how long the other set can be.
    longest = F.floor((F.col("rest") * (den + num) - F.col("n") * num) / num)
    small = index.filter(F.col("rest") * (den + num) >= F.col("n") * 2 * num).withColumn(
        "part", F.explode(F.sequence(F.col("part"), length(longest))))
    side = lambda rows, k: rows.select("s", "part", *[F.col(c).alias(f"{k}_{c}") for c in index.columns if c not in ("s", "part")])
    c = F.col
    smaller = (c("x_n") < c("y_n")) | (c("x_n") == c("y_n")) & (c("x_id") < c("y_id"))
    enough = F.least("x_rest", "y_rest") * (den + num) >= (c("x_n") + c("y_n")) * num
    apart = F.bit_count(c("x_bits0").bitwiseXOR(c("y_bits0"))) + F.bit_count(c("x_bits1").bitwiseXOR(c("y_bits1")))
    close = apart * (den + num) <= (c("x_n") + c("y_n")) * (den - num)
    proven = F.coalesce((c("x_g") == c("y_g")) & (c("x_over") + c("y_over") <= 0), F.lit(False))
    met_before = F.coalesce(F.arrays_overlap("x_before", "y_before"), F.lit(False))
    met = side(small, "x").join(side(index, "y"), ["s", "part"]).filter(smaller & enough & close & ~proven & ~met_before)
    return met.select(c("x_id").alias("a"), c("y_id").alias("b"))


def _pairs(sets: DataFrame, least: float, near: DataFrame | None = None) -> DataFrame:
    """``a, b, likeness``: the ``_candidates`` with a likeness of ``least`` or more, each once."""
    pairs = _candidates(sets, least, near).distinct()
    own = sets.select("id", "sigs")
    pairs = (pairs.join(own.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a")
             .join(own.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b"))
    return pairs.select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("likeness")).filter(F.col("likeness") >= least)


def matches(prints: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate matches of ``prints (doc_id, sigs)``: ``(pairs, members)``.

    ``members`` (``doc_id, class_id``) puts rows of one set into one class, named
    after its smallest id; ``pairs`` (``a, b, likeness``) are the pairs of
    different classes with a likeness of ``least`` or more, each once. Rows without
    an id are left out.
    """
    sets = _sets(prints)
    members = prints.filter("doc_id is not null").join(sets.select("sigs", F.col("doc_id").alias("class_id")), "sigs").select("doc_id", "class_id")
    own = lambda k: sets.select(F.col("id").alias(k), F.struct(F.size("sigs"), "doc_id").alias(f"of_{k}"))
    pairs = _pairs(sets, least).join(own("a"), "a").join(own("b"), "b")
    return pairs.select(F.least("of_a", "of_b")["doc_id"].alias("a"), F.greatest("of_a", "of_b")["doc_id"].alias("b"), "likeness"), members


def with_links(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """``prints (doc_id, sigs, ...)`` with, instead of ``sigs``, ``class_id`` and ``n_links``, the number of other
    rows with a likeness of ``least`` or more; both are null for a row without an id.

    A link of two sets that their distances from a common centre prove is counted there, every other one as a pair."""
    sets = _sets(prints)
    near = _near(sets, least)
    pairs = stored(_pairs(sets, least, near).select("a", "b"), "spot-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(sets.select(F.col("id").alias("b"), "copies"), "b").select("a", "copies").unionByName(
        _near_links(near).select(F.col("id").alias("a"), F.col("linked").alias("copies"))).groupBy("a").agg(F.sum("copies").alias("far"))
    links = stored(sets.select(fingerprint(F.col("sigs")).alias("set"), "id", "doc_id", "copies").join(far, F.col("id") == F.col("a"), "left").select(
        "set", F.col("doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")), "spot-links")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    rows = prints.select("*", fingerprint(F.col("sigs")).alias("set")).drop("sigs")
    return rows.join(links, "set", "left").select(*[c for c in prints.columns if c != "sigs"], own("class_id"), own("n_links"))
