"""Keyword and mapping tables (F1, F3, P5, P6) against the predicates and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from poicraft.functions import abbreviate_label, address_keyword_pred, any_keyword_pred, reduce_name
from poicraft.operators import keywords as K
from poicraft.plans.evidence import physical_plan, written_plans

WORDS = ["calle", "Av.", "niño", "a", "ab", "", "😀b", "x\ny", "insurgentes", "norte", "aaa", "aaaa", "%", "a.b", "None", "ÑANDÚ"]


def texts(spark, seed, n=200):
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choice(["a", "b", "c", "é", "Ñ", " ", "😀", "\n", "calle", "NORTE", "x", "."]) for _ in range(rng.randint(0, 12)))
    rows = [(i, rng.choice([None, piece(), piece()]), piece()) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, a string, b string"), rows


def words(spark, seed, n):
    rng = random.Random(seed)
    drawn = ["".join(rng.choice("abcéñ .x") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    return [w for w in drawn + WORDS if w]


def table(spark, keys):
    rows = [(k, f"<{i}>", i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "keyword string, value string, rank bigint")


@pytest.mark.parametrize("seed", range(3))
def test_any_keyword_equals_contains(spark, seed):
    df, rows = texts(spark, seed)
    keys = words(spark, seed, 30)
    want = sorted(i for i, a, b in rows if any(k.lower() in str(t).lower() for k in keys for t in (a, b)))
    keywords = table(spark, [*keys, keys[0], None])
    assert sorted(r.id for r in K.any_keyword_rows(df, ["a", "b"], keywords, key=["id"]).collect()) == want
    assert sorted(r.id for r in K.any_keyword_rows(df, ["a", "b"], keywords).collect()) == want
    assert 0 < len(want)
    few = table(spark, ["😀b", "x\ny", "ñé"])
    got = {r.id for r in K.any_keyword_rows(df, ["b"], few, key=["id"]).collect()}
    assert got == {i for i, _, b in rows if any(k in b.lower() for k in ("😀b", "x\ny", "ñé"))}


def test_empty_keyword_empty_list_and_null_text(spark):
    df, rows = texts(spark, 9, 40)
    assert K.any_keyword_rows(df, ["a"], table(spark, [""]), key=["id"]).count() == 40
    assert K.any_keyword_rows(df, ["a"], table(spark, [""]), key=["id"], null_text=None).count() == sum(a is not None for _, a, _ in rows)
    assert K.any_keyword_rows(df, ["a"], table(spark, ["x"]).limit(0), key=["id"]).count() == 0
    assert K.all_keyword_rows(df, "a", table(spark, ["x"]).limit(0), key=["id"]).count() == 40
    assert {r.id for r in K.any_keyword_rows(df, ["a"], table(spark, ["none"]), key=["id"]).collect()} == {i for i, a, _ in rows if a is None}
    assert K.any_keyword_rows(df.limit(0), ["a"], table(spark, ["x"])).count() == 0


def test_all_keywords_equal_the_predicate(spark):
    df, rows = texts(spark, 5)
    keys = ["A", "b", "É", "a"]
    want = sorted(i for i, _, b in rows if all(k.lower() in b.lower() for k in keys))
    assert sorted(r.id for r in K.all_keyword_rows(df, "b", table(spark, keys), key=["id"]).collect()) == want and want


@pytest.mark.parametrize("seed", range(3))
def test_first_match_wins_in_mappings(spark, seed):
    df, rows = texts(spark, seed + 20)
    keys = list(dict.fromkeys(words(spark, seed, 25)))
    mapping = {k: f"<{i}>" for i, k in enumerate(keys)}
    got = {r.id: (r.short, r.label) for r in K.abbreviate_by_table(
        K.reduce_name_by_table(df, "a", table(spark, keys), "short", key=["id"]), "a", table(spark, keys), "label", key=["id"]).collect()}
    want = {r.id: (r.short, r.label) for r in df.select("id", reduce_name("a", mapping).alias("short"), abbreviate_label("a", mapping).alias("label")).collect()}
    assert got == want and any(s != str(a) for (i, a, _), (s, _) in zip(rows, (got[i] for i, *_ in rows)))


def test_plan_does_not_grow_with_the_list(spark):
    df, _ = texts(spark, 3)
    size = []
    for n in (10, 20_000):
        keys = spark.range(n).select(F.concat(F.lit("word "), F.col("id").cast("string")).alias("keyword"))
        with written_plans() as plans:
            out = physical_plan(K.any_keyword_rows(df, ["a", "b"], keys, key=["id"]))
        assert not any(x in p for p in [*plans, out] for x in ("NestedLoop", "Cartesian"))
        size.append(sum(map(len, plans)) + len(out))
    assert abs(size[1] - size[0]) < 2_000


def test_large_index_is_joined_by_shuffle(spark, monkeypatch):
    from poicraft.operators import joins
    monkeypatch.setattr(joins.lookup_join, "__defaults__", tuple(-1 if d == joins.BROADCAST_BYTES else d for d in joins.lookup_join.__defaults__))
    df, rows = texts(spark, 1)
    keys = words(spark, 1, 30)
    want = sorted(i for i, a, b in rows if any(k.lower() in str(t).lower() for k in keys for t in (a, b)))
    assert sorted(r.id for r in K.any_keyword_rows(df, ["a", "b"], table(spark, keys), key=["id"]).collect()) == want


def test_long_lists_in_predicates(spark):
    df, rows = texts(spark, 7)
    keys = [f"none such {i}" for i in range(3000)] + ["É", "calle"]
    got = sorted(r.id for r in df.filter(any_keyword_pred(["a", "b"], keys)).collect())
    assert got == sorted(i for i, a, b in rows if any(k in str(t).lower() for k in ("é", "calle") for t in (a, b))) and got
    every = ["a"] * 100 + ["b"]
    got = sorted(r.id for r in df.filter(address_keyword_pred(None, F.lit("~"), every, line="b")).collect())
    assert got == sorted(i for i, _, b in rows if "a" in b.lower() and "b" in b.lower())


def test_only_keywords_in_some_text_become_candidates(spark, monkeypatch):
    """Padded numbers share their short pieces with every text, so pieces alone would make each of them a candidate."""
    met, join = [], K.lookup_join
    monkeypatch.setattr(K, "lookup_join", lambda facts, dim, *a, **b: met.append(dim) or join(facts, dim, *a, **b))
    df = spark.range(300).select("id", F.format_string("customer#%09d", F.col("id") * 3).alias("a"))
    keys = spark.range(5000).select(F.format_string("#%09d", F.col("id") * 7).alias("keyword"))
    got = sorted(r.id for r in K.any_keyword_rows(df, ["a"], keys, key=["id"]).collect())
    assert got == [i for i in range(300) if i * 3 % 7 == 0]
    held = [d for d in met if "_words" in d.columns]
    assert len(held) == 1 and held[0].select(F.sum(F.size("_words"))).first()[0] == len(got)


def test_long_keywords_and_pieces_outside_the_basic_plane(spark):
    start = "https://example.org/" + "shared/" * 6
    keys = [f"{start}{i}" for i in range(50)] + ["x" * K.Q, "y" * (K.Q + 1), "?b", "😀" * (K.Q + 2), ""]
    texts = [f"see {start}7 and {start}49!", start, "x" * (K.Q - 1), "x" * K.Q, "y" * K.Q, "y" * 40, "😀b", "😀" * 40, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, a string")
    hits = K.with_hits(df, [F.col("a")], K.keyword_table(table(spark, keys)), ["id"])
    want = {i: {k for k in keys if t is not None and k in t} for i, t in enumerate(texts)}
    assert {r.id: {w.keyword for w in r._hits} for r in hits.collect()} == want
