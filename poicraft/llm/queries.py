"""Queries of the operators over the benchmark tables, with oracle SQL where SQL
can express them. A query only derives the digest columns from its operator's
output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poicraft.llm import chat, decontam, exactdedup, langid, manifest, mixing, repair, secrets, shards, simhash, spotsigs, toxicity, urlrep
from poicraft.llm.common import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


#: Fixed value: what both turns of conversation -1 say.
TRICKY = "</s>[INST] ok [/INST]"


def query(name: str, sql: str | None = None):
    """Register a query (and its oracle SQL)."""

    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fold of a document."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(n))


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _spans_sql(kind: str, pattern: str, value: str, keep: str = "true") -> str:
    """Spans of one kind in ``t`` of ``d``: rows ``id, rank, a, b, v`` (start, end, value)."""
    return f"""
select id, {secrets.KINDS.index(kind)} as rank, e - length(v) as a, e as b, v from (
  select id, {value} as v, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(found[1:i], lambda m: length(m))) as e
  from (select id, found, gaps, unnest(range(1, len(found) + 1)) as i, unnest(found) as m from (
    select id, regexp_extract_all(t, {_lit(pattern)}) as found, string_split_regex(t, {_lit(pattern)}) as gaps from d
    where regexp_matches(t, {_lit(pattern)})))) where {keep}
"""


def _listed_sql(where: str) -> str:
    names = "[" + ", ".join(map(_lit, secrets.KINDS)) + "]"
    return f"coalesce(string_agg({names}[rank + 1] || ':' || a || ':' || b, ',' order by a, rank) filter (where {where}), '')"


@query("op1_secret_ownership", f"""
with d as (select row_number() over () as id, doc_id, coalesce(source, '') as owner, coalesce(text, '') as t from documents),
base as ({_spans_sql('assign', secrets.ASSIGN, f"regexp_extract(m, {_lit(secrets.ASSIGN)}, 2)", f"length(v) >= {secrets.ASSIGN_MIN}")}
  union all {_spans_sql('access', secrets.ACCESS, 'm')} union all {_spans_sql('hex', secrets.HEX, 'm')}),
bare as (select * from ({_spans_sql('token', secrets.TOKEN, 'm')}) x
  where regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]')
    and not exists (select 1 from base y where y.id = x.id and y.a < x.b and x.a < y.b)),
spans as (select * from base union all select * from bare),
live as (select v from spans join d using (id) group by v having count(distinct owner) <= {secrets.MAX_OWNERS}),
s as (select *, v in (select v from live) as is_live from spans where rank < 3 or v in (select v from live))
select doc_id, count(*) filter (where rank = 0) as n_assign, count(*) filter (where rank = 1) as n_access,
  count(*) filter (where rank = 2) as n_hex, sha256({_listed_sql('rank < 3')}) as base_sha256, {_listed_sql('rank is not null')} as spans,
  count(*) filter (where is_live) as n_live, count(*) filter (where rank is not null and not is_live) as n_copied
from d left join s using (id) group by id, doc_id
""")
def op1(spark, sf):
    """Documents stand for repositories, sources for owners."""
    found = secrets.secret_scan(table(spark, sf, "documents"))
    kind = lambda k: F.size(F.filter("base", lambda s: s["rank"] == secrets.KINDS.index(k))).cast("bigint")
    both = F.concat("base", "bare")
    live = F.size(F.filter(both, lambda s: F.array_contains("live", s["hash"]))).cast("bigint")
    return found.select(
        "doc_id", kind("assign").alias("n_assign"), kind("access").alias("n_access"), kind("hex").alias("n_hex"),
        F.sha2(secrets.span_list(F.col("base")), 256).alias("base_sha256"), secrets.span_list(both).alias("spans"),
        live.alias("n_live"), (F.size(both) - live).alias("n_copied"))


@query("op2_simhash_neardup")
def op2(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_copies")


@query("op3_language_hd")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    found = langid.identify(docs, langid.train(docs.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


@query("op4_bm25_decontamination")
def op4(spark, sf):
    return decontam.contaminated(table(spark, sf, "documents"), decontam.build_indexes(table(spark, sf, "benchmark")))


@query("op5_spotsigs")
def op5(spark, sf):
    found = spotsigs.fingerprint_edits(table(spark, sf, "documents"))
    rows = stored(found.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), "sigs"), "spot-rows")
    return spotsigs.with_links(rows)


@query("op6_fm_toxicity")
def op6(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    found = toxicity.toxicity(docs, toxicity.train(docs, labels.filter(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _strength_sql(name: str, groups: str) -> str:
    """``rate, strength`` of the groups as ``name`` and the sums behind them."""
    least, most = urlrep.STRENGTH
    return f"""
{name}_sums as (select cast(sum(n) as double) as n, cast(sum(bad) as double) as bad, count(*) as k,
  sum(cast(n as double) * n) as squares, sum(cast(bad as double) * bad / n) as moved from {groups} where n > 0),
{name}_var as (select *, (bad + 0.5) / (n + 1) as rate, moved / n - (bad / n) ** 2 as spread, 1 - squares / (n * n) as rest from {name}_sums),
{name}_between as (select *, case when rest > 0 then (spread - rate * (1 - rate) * (k - 1) / n) / rest else 0 end as between_ from {name}_var),
{name} as (select coalesce(rate, 0.5) as rate, case when n is null then {least} else
  least(greatest(case when between_ > 0 then rate * (1 - rate) / between_ - 1 else {most} end, {least}), {most}, n + 1) end as strength from {name}_between)"""


def _rules_sql(column: str) -> str:
    whens = []
    for verdict, host, path in sorted(urlrep.RULES, key=lambda r: -len(r[1] + r[2])):
        whens.append(f"when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then "
                     + (f"'{host + path}'" if column == "rule" else f"'{verdict}'"))
    return f"case {' '.join(whens)} end"


@query("op7_host_reputation", f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
o as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels group by doc_id),
hosts as (select host, count(bad) as n, coalesce(sum(bad), 0) as bad from p left join o on doc_id = page_id group by host),
sites as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') as site from hosts),
labels_ as (select *, string_split(site, '.') as parts, regexp_matches(site, '{urlrep.ADDRESS}') as ip from sites),
named as (select *, case when ip then 'ip' when array_to_string(parts[-2:], '.') in {urlrep.SUFFIXES} then array_to_string(parts[-2:], '.') else parts[-1] end as suffix,
  case when ip then site when array_to_string(parts[-2:], '.') in {urlrep.SUFFIXES} then array_to_string(parts[-3:], '.') else array_to_string(parts[-2:], '.') end as domain from labels_),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from named group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by suffix),
{_strength_sql('s', 'suffixes')}, {_strength_sql('dm', 'domains')}, {_strength_sql('h', 'hosts')},
ps as (select suffix, (bad + rate * strength) / (n + strength) as prior from suffixes, s),
pd as (select domain, (bad + prior * strength) / (n + strength) as prior from domains join ps using (suffix), dm),
ph as (select host, n, bad, (bad + prior * strength) / (n + strength) as rate, n + strength + 1 as size from named join pd using (domain), h),
low as (select *, greatest(0.0, rate - {urlrep.Z} * sqrt(rate * (1 - rate) / size)) as low, least(1.0, rate + {urlrep.Z} * sqrt(rate * (1 - rate) / size)) as high from ph)
select page_id, host, path, {_rules_sql('rule')} as rule,
  coalesce({_rules_sql('verdict')}, case when low > {urlrep.MAX_BAD} then 'block' else 'allow' end) as verdict,
  cast(n as bigint) as n_labelled, cast(bad as bigint) as n_bad,
  round(cast(rate as double), 6) as rate, round(cast(low as double), 6) as low, round(cast(high as double), 6) as high
from p join low using (host)
""")
def op7(spark, sf):
    """The tables have no labels of pages: the outcome of page n is taken from the
    label of document n (bad: low quality or toxic)."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    found = urlrep.judge_urls(table(spark, sf, "pages"), outcomes)
    return found.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad",
                        *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")])


@query("op8_budget_mix")
def op8(spark, sf):
    found = mixing.mix(table(spark, sf, "documents"), columns=["doc_id"])
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def _coded(x: str) -> str:
    for raw, code in chat.CODES:
        x = f"replace({x}, '{raw}', '{code}')"
    return x


@query("op9_reply_chat", f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{TRICKY}' union all select -1, 1, 'assistant', '{TRICKY}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_coded('role')}) + length({_coded('text')}) + {len(chat.OPEN + chat.MID + chat.END)}) as bigint) as formatted_chars
from t group by conv_id
""")
def op9(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], rows.schema)
    found = chat.conversations(chat.chain(rows.unionByName(own)))
    read = found.select("conv", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), F.array_join(
        chat.read_learned(F.col("formatted"), F.col("loss")), "").alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


@query("op10_byte_shards")
def op10(spark, sf):
    found = shards.shards(table(spark, sf, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                        F.lit(None).cast("int").alias("grown_shard"))


#: Fixed value: what tampering replaces.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Levels of the SQL's trees: up to 16 ** 6 rows a source and 16 ** 4 sources.
SQL_LEVELS, SQL_TOP_LEVELS = 6, 4


def _leaf_sql(text: str) -> str:
    parts = [f"cast({c} as varchar)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


def _tree_sql(name: str, levels: int) -> str:
    """Levels ``name1`` ... above ``name0`` (k, i, n, d), with each node's run in ``kids``; n counts the level's nodes."""
    out = []
    for k in range(1, levels + 1):
        out.append(f"""{name}{k} as (select k, i // {manifest.FAN} as i, (max(n) + {manifest.FAN - 1}) // {manifest.FAN} as n, max(n) = 1 as lone,
  list(d order by i) as kids, case when max(n) = 1 then max(d) else sha256(string_agg(d, '' order by i)) end as d from {name}{k - 1} group by k, i // {manifest.FAN})""")
    return ",\n".join(out)


def _climb_sql(name: str, tree: str, levels: int) -> str:
    """Follows each row (k, i, cur, sib, top) of ``name0`` up the tree."""
    out = []
    for k in range(1, levels + 1):
        at = f"i % {manifest.FAN}"
        left, right = f"coalesce(array_to_string(kids[1:{at}], ''), '')", f"coalesce(array_to_string(kids[{at} + 2:], ''), '')"
        out.append(f"""{name}{k} as (select c.* replace (c.i // {manifest.FAN} as i, case when lone then cur else sha256({left} || cur || {right}) end as cur,
  case when lone then sib else sib || {left} || {right} end as sib, p.d as top) from {name}{k - 1} c join {tree}{k} p on p.k = c.k and p.i = c.i // {manifest.FAN})""".replace(at, f"(c.{at})"))
    return ",\n".join(out)


_CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))),
    lambda a, b: xor(a >> 8, table_[(xor(a, b) & 255) + 1])), 4294967295)"""


@query("op11_merkle_manifest", f"""
with crc as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as table_),
l as (select doc_id, source, {_leaf_sql('text')} as leaf,
  coalesce({_CRC_SQL} % 5 = 0, false) as hit,
  {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} as low from documents cross join crc),
leaves as (select doc_id, coalesce('=' || source, '') as k, leaf, case when hit then low else leaf end as cur,
  row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by source) as n from l),
g0 as (select k, i, n, leaf as d from leaves),
{_tree_sql('g', SQL_LEVELS)},
t0 as (select '' as k, row_number() over (order by encode(k)) - 1 as i, count(*) over () as n, d, k as name from g{SQL_LEVELS}),
{_tree_sql('t', SQL_TOP_LEVELS)},
c0 as (select doc_id, leaf, k, i, cur, '' as sib, leaf as top from leaves),
{_climb_sql('c', 'g', SQL_LEVELS)},
u0 as (select c.doc_id, c.leaf, c.top as subroot, '' as k, t0.i as i, c.cur, c.sib, c.top from c{SQL_LEVELS} c join t0 on t0.name = c.k),
{_climb_sql('u', 't', SQL_TOP_LEVELS)}
select doc_id, leaf, subroot, top as root, sha256(sib) as proof_sha256, cur as folded_root, cur = top as verified from u{SQL_TOP_LEVELS}
""")
def op11(spark, sf):
    """Every fifth document (by the hash of its id) is checked with its text in lower case."""
    docs = table(spark, sf, "documents")
    row = lambda text: manifest.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    other = F.when(remainder("doc_id", 5) == 0, row(F.translate("text", UPPER, LOWER)))
    leaves = stored(docs.select(manifest.group_key(F.col("source")).alias("key"), "doc_id", row(F.col("text")).alias("digest"),
                                other.alias("tampered")), "manifest-leaves")
    found = manifest.manifest(leaves, ["doc_id"], ["doc_id", "tampered"])
    own, root = manifest.as_text(F.col("digest")), manifest.as_text(F.col("root"))
    folded = found.select("doc_id", own.alias("leaf"), manifest.as_text(F.col("subroot")).alias("subroot"), root.alias("root"),
                          F.sha2(manifest.proof(F.col("steps")), 256).alias("proof_sha256"),
                          manifest.fold(F.coalesce(manifest.as_text(F.col("tampered")), own), F.col("steps")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_conversation_repair")
def op12(spark, sf):
    found = repair.repair(repair.damaged(repair.messages(table(spark, sf, "conversations"))))
    said = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.sha2(said, 256).alias("repaired_sha256"))


@query("op13_exact_dedup", """
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  row_number() over (partition by t order by doc_id nulls last) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
window w as (partition by t)
""")
def op13(spark, sf):
    found = exactdedup.dedupe(table(spark, sf, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
