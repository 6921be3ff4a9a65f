"""Chat formatting: exact round trips, trees with branches, odd rows."""

import hashlib

import pytest
from cases import SF, table
from pyspark.sql import functions as F

from poicraft.llm import chat as C
from poicraft.llm.queries import ORACLE_SQL, QUERIES


def test_query(spark):
    rows = {r.conv_id: r for r in QUERIES["op9_reply_chat"](spark, SF).collect()}
    turns = {}
    for r in table("conversations").sort_values(["conv_id", "turn"]).itertuples():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert rows.keys() == turns.keys()
    for k, t in turns.items():
        said, learned = "".join(f"{a}\n{b}\n" for a, b in t), "".join(b for a, b in t if a == "assistant")
        r = rows[k]
        assert (r.n_turns, r.turns_sha256) == (len(t), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


HARD = ["", "\\", "\\s", "\\l\\b\\s", "[INST]", "[/INST]x</s>", "<s>[INST]user[/INST]", "a\n\nb\n", "😀[😀<", "\\[\\<", "</s></s>"]


def test_round_trip_of_hard_texts(spark):
    rows = [(1, i, "assistant" if i % 2 else HARD[-i], t) for i, t in enumerate(HARD)] + [(2, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv: r for r in C.conversations(C.chain(df)).select("conv", "formatted", "loss", C.read_turns(F.col("formatted")).alias("t"),
                                                                   C.read_learned(F.col("formatted"), F.col("loss")).alias("l")).collect()}
    assert [(x.role, x.text) for x in got[1].t] == [(r, t) for _, _, r, t in rows[:-1]]
    assert got[1].l == [t for _, _, r, t in rows[:-1] if r == "assistant"]
    assert got[1].formatted.count("</s>") == got[1].formatted.count("[INST]") == len(HARD)
    assert [(x.role, x.text) for x in got[2].t] == [("", "")] and got[2].l == []


def tree(spark, rows):
    return spark.createDataFrame([(1, "1", n, p, "assistant" if n % 2 else "user", f"m{n}", float(s)) for n, p, s in rows],
                                 "conv bigint, tree string, node bigint, parent bigint, role string, text string, score double")


def test_branches_are_ranked_by_score(spark):
    m = tree(spark, [(1, None, 1), (2, 1, 1), (3, 1, 5), (4, 2, 9), (5, 3, 1), (6, 3, 1), (7, 77, 2), (8, 8, 20)])
    got = sorted((r.rank, [x.text for x in r.t]) for r in C.conversations(m, None).select("rank", C.read_turns(F.col("formatted")).alias("t")).collect())
    assert got == [(1, ["m8"]), (2, ["m1", "m2", "m4"]), (3, ["m1", "m3", "m5"]), (4, ["m1", "m3", "m6"]), (5, ["m7"])]
    assert [r.rank for r in C.conversations(m, 2).orderBy("rank").collect()] == [1, 2]


def test_long_chain_and_circle(spark):
    m = tree(spark, [(i, i - 1 if i else None, 1) for i in range(100)])
    r = C.conversations(m).select(C.read_turns(F.col("formatted")).alias("t")).first()
    assert [x.text for x in r.t] == [f"m{i}" for i in range(100)]
    with pytest.raises(ValueError):
        C.paths(tree(spark, [(1, 2, 1), (2, 1, 1)]))


def test_odd_rows_and_empty_table(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", None), (1, 2, "user", "b"), (1, None, "system", "first"), (None, 1, "assistant", "x" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for c in ("conv", "tree", "node", "parent", "score", "leaf", "up"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r.conv: [(x.role, x.text) for x in r.t] for r in C.conversations(C.chain(df)).select("conv", C.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got[1] == [("system", "first"), ("user", ""), ("user", "b"), ("user", "b")] and got[None] == [("assistant", "x" * 300_000)]
    assert C.conversations(C.chain(df.limit(0))).count() == 0


def test_oracle_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{SF}/conversations.parquet')")
    want = con.execute(ORACLE_SQL["op9_reply_chat"])
    names = [d[0] for d in want.description]
    got = sorted(tuple(r[n] for n in names) for r in QUERIES["op9_reply_chat"](spark, SF).collect())
    assert got == sorted(want.fetchall())
