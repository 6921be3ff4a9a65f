"""Merkle manifest: against a plain recursive tree, at every size around the fan; tampering; odd rows; SQL."""

import hashlib

import duckdb
import pytest
from cases import SF, no_docs, odd_docs, odd_rows
from pyspark.sql import functions as F

from poicraft.llm import manifest as M
from poicraft.llm.queries import ORACLE_SQL, QUERIES, op11


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fan=16):
    """Levels from the leaves to the root."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([H(*row[i:i + fan]) for i in range(0, len(row), fan)])
    return levels


def siblings(levels, i, fan=16):
    out = []
    for row in levels[:-1]:
        run = i // fan * fan
        out.append((row[run:i], row[i + 1:run + fan]))
        i //= fan
    return out


def brute(rows):
    """(leaf, subroot, root, proof) per (group, order, leaf) row."""
    groups = {}
    for g, order, leaf in rows:
        groups.setdefault(g, []).append((order is not None, order or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, (known, order, leaf) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], i) + siblings(top, j)
            out.append((order if known else None, leaf, trees[g][-1][0], top[-1][0], H(*[d for a, b in path for d in a + b])))
    return sorted(out, key=repr)


def found(df):
    text = lambda c: M.as_text(F.col(c))
    rows = df.select("id", text("digest"), text("subroot"), text("root"), F.sha2(M.proof(F.col("steps")), 256),
                     M.fold(text("digest"), F.col("steps")).alias("folded")).collect()
    assert all(r.folded == r[3] for r in rows)
    return sorted((tuple(r)[:5] for r in rows), key=repr)


def leaves(spark, rows):
    df = spark.createDataFrame(rows, "g string, id bigint, leaf string")
    return df.select(M.group_key(F.col("g")).alias("key"), "id", F.unhex("leaf").alias("digest")).repartition(5)


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [255, 1, 16], [256, 257, 15], [1] * 20, [5000, 3, 300]])
def test_sizes_around_the_fan(spark, sizes):
    names = [None, "", "é", "z", "Z", "aa"] + [f"s{i}" for i in range(20)]
    rows = [(g, (i * 7) % n if n % 7 else i, H(f"{g}-{i}")) for g, n in zip(names, sizes) for i in range(n)]
    assert found(M.manifest(leaves(spark, rows), ["id"], ["id"])) == brute(rows)


def test_ties_and_missing_ids(spark):
    rows = [("a", 3, H("x"))] * 3 + [("a", 3, H("w")), ("a", None, H("y")), ("a", None, H("y")), (None, None, H("v"))]
    assert found(M.manifest(leaves(spark, rows), ["id"], ["id"])) == brute(rows)


def test_leaf_encoding(spark):
    df = spark.createDataFrame([(5, None, "", "né😀")], "a bigint, b string, c string, d string")
    assert df.select(M.as_text(M.leaf(*map(F.col, "abcd")))).first()[0] == H("1:5", "-", "0:", "7:né😀")


def test_odd_rows_and_empty_table(spark, tmp_path):
    odd_docs(spark).withColumns({c: F.lit("clash") for c in ("digest", "rank", "n", "lo", "hi", "kids", "steps", "root", "group", "place", "tampered")}) \
        .write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = op11(spark, f"{tmp_path}/a").collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = brute([(s, i, H(*map(enc, (i, s, lang, n, t)))) for i, t, lang, s, n in odd_rows()])
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in rows), key=repr) == want
    no_docs(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    empty = op11(spark, f"{tmp_path}/b")
    assert empty.count() == 0 and empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_oracle_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(ORACLE_SQL["op11_merkle_manifest"])
    names = [d[0] for d in want.description]
    got = sorted(tuple(r[n] for n in names) for r in QUERIES["op11_merkle_manifest"](spark, SF).collect())
    assert got == sorted(want.fetchall())
    assert 0 < sum(not r[names.index("verified")] for r in got) < len(got) / 2


def test_buckets_bound_every_join(spark):
    """No join key of the descent meets more than a run of nodes."""
    rows = [("hot", i, H(str(i))) for i in range(2000)]
    t = M.grow(M.ranked(leaves(spark, rows), ["id", "digest"]), ["id"])
    for level in t.levels:
        assert level.agg(F.max(F.size("kids"))).first()[0] <= M.FAN
