"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Method: every candidate credential (the values found by the base patterns, and
bare tokens that look like keys) is hashed; its hash is aggregated over the whole
corpus by distinct repositories and distinct owners. A value that only a few
owners hold is *owner-specific* (live-looking); a value that many owners hold is
a *widely copied* example. Bare tokens become spans only if they are
owner-specific; base spans always stay, and are counted by class.

Spans are ``[start, end)`` in code points of the whole text. The span of an
assignment is that of the assigned value (group 2 of its pattern), without the
keyword; matches are found leftmost and without overlap all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.llm.common import prefix_sums, stored, text_of

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("assign", "access", "hex", "token")
#: Base patterns. A run shorter than the limit can hold no match, so the limits of
#: ``access`` and ``hex`` stand in the pattern; that of ``assign`` is tested after
#: the match, because a failing match still uses up its characters.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_MIN = 6
#: Bare tokens: runs of 20 or more characters with a digit, a capital and a small letter.
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: A value that more owners hold than this is a widely copied example.
MAX_OWNERS = 2

SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(found: Column, gaps: Column, rank: int, value) -> Column:
    """Spans from the matches and the texts around them (one more than matches)."""
    gap = F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda g: F.length(g).cast("bigint"))
    before = prefix_sums(F.zip_with(gap, found, lambda g, m: g + F.length(m)))
    starts = F.zip_with(before, gap, lambda b, g: b + g)
    ends = F.zip_with(starts, found, lambda s, m: s + F.length(m))
    return F.zip_with(ends, F.transform(found, value), lambda e, v: F.struct(  # a value stands at the end of its match
        (e - F.length(v)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), v.alias("value")))


def _whole(match: Column) -> Column:
    return match


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, ASSIGN, 2)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
               repo: str | None = None) -> DataFrame:
    """``doc_id, tkey, owner, repo, base, bare``: per row the base spans and the bare tokens.

    ``tkey`` is a hash of the text; rows that agree in ``doc_id`` and ``tkey``
    are repeated rows. ``repo`` defaults to the document. The kind of a span is
    its place in ``KINDS``.
    """
    none = F.array().cast("array<string>")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"), text_of(owner).alias("owner"),
        text_of(repo or doc_id).alias("repo"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    rows = rows.select("*", F.xxhash64("text").alias("tkey"),
                       *[_found(F.col("text"), p).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select(
        "doc_id", "tkey", "owner", "repo", *[f"m_{k}" for k in patterns],
        *[F.when(F.size(f"m_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"g_{k}")
          for k, p in patterns.items()])
    rows = rows.select("doc_id", "tkey", "owner", "repo", *[
        _spans(F.col(f"m_{k}"), F.col(f"g_{k}"), i, _assigned if k == "assign" else _whole).alias(k)
        for i, k in enumerate(KINDS)])
    base = F.concat(F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGN_MIN), F.col("access"), F.col("hex"))
    rows = rows.select("doc_id", "tkey", "owner", "repo", F.sort_array(base).alias("base"), "token")
    bare = F.filter("token", lambda t: t["value"].rlike("[0-9]") & t["value"].rlike("[A-Z]") & t["value"].rlike("[a-z]")
                    & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"),
        F.sha2(s["value"], 256).alias("hash")))
    return (rows.select("doc_id", "tkey", "owner", "repo", "base", bare.alias("bare"))
            .select("doc_id", "tkey", "owner", "repo", hashed(F.col("base")).alias("base"),
                    hashed(F.col("bare")).alias("bare")))


def ownership(rows: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """``hash, n_repos, n_owners, n_spans, live`` over all candidates of ``candidates()``.

    Three partial aggregations (by repository, by owner, by value): a value held
    by a third of all documents is reduced to one row per map task each time.
    """
    spans = rows.select("owner", "repo", F.explode(F.concat("base", "bare")).alias("s"))
    by_repo = spans.groupBy(F.col("s.hash").alias("hash"), "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_spans")).select(
        "*", (F.col("n_owners") <= max_owners).alias("live"))


def secret_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
                repo: str | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row per input row: ``doc_id, base, bare, live``.

    ``base`` and ``bare`` are spans (``start, rank, end, hash``) sorted by start;
    ``bare`` holds only owner-specific tokens; ``live`` is the set of
    owner-specific hashes of the row. A null text has no spans; a null owner
    counts as one owner, the empty name; repeated rows get the same result.
    """
    rows = stored(candidates(docs, doc_id, text, owner, repo), "secrets-rows")
    verdicts = stored(ownership(rows, max_owners).filter("live").select("hash"), "secrets-live")
    # The live values of each row that has any; both sides come from files, so the
    # adaptive plan can split a value that very many rows hold.
    with_any = rows.filter(F.size("base") + F.size("bare") > 0)
    held = with_any.select("doc_id", "tkey", F.explode(F.array_distinct(F.transform(
        F.concat("base", "bare"), lambda s: s["hash"]))).alias("hash"))
    live = held.join(verdicts, "hash").groupBy("doc_id", "tkey").agg(F.collect_set("hash").alias("live"))
    r, v = rows.alias("r"), live.alias("v")
    none = F.array().cast("array<string>")
    joined = r.join(v, F.col("r.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("r.tkey") == F.col("v.tkey")), "left")
    return joined.select(
        "r.doc_id", "r.base", "r.bare", F.coalesce("v.live", none).alias("live")).select(
        "doc_id", "base", F.filter("bare", lambda s: F.array_contains("live", s["hash"])).alias("bare"), "live")


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in order of start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
