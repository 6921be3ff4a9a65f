"""Randomised parity: native predicates vs plain-Python statements of the rules."""

import random

from poicraft.functions import (address_keyword_pred, any_keyword_pred, clean_chars, reduce_name,
                                street_entity_pred)

ALPHA = ["a", "b", "on", "Ñ", "é", "É", "(", "=", " ", "ring", "06000", ""]


def rand_text(rng):
    if rng.random() < 0.1:
        return None
    return "".join(rng.choice(ALPHA) for _ in range(rng.randint(0, 6)))


def py_text(x):
    return "None" if x is None else str(x)


def py_street(street, ent, kws):
    *sk, e = kws
    terms = [k for k in sk if k]
    ok = all(k.lower() in py_text(street).lower() for k in terms)
    if e and ok and terms:
        ok = e.lower() in py_text(ent).lower()
    return ok


def py_address(lines, postal, kws):
    if not lines:
        return False
    first = py_text(lines[0])
    if py_text(postal) in first:
        return False
    return all(k.lower() in first.lower() for k in kws)


def py_any(vals, kws):
    return any(k.lower() in py_text(v).lower() for k in kws for v in vals)


def py_clean(x):
    s = py_text(x)
    for ch in "();='><":
        s = s.replace(ch, " ")
    return s


def py_reduce(x, m):
    s = py_text(x)
    return next((v for k, v in m.items() if k in s), s)


def test_random_parity(spark):
    rng = random.Random(7)
    data = [(i, rand_text(rng), rand_text(rng), [rand_text(rng) for _ in range(rng.randint(0, 2))],
             rand_text(rng)) for i in range(600)]
    df = spark.createDataFrame(data, "i int, a string, b string, lines array<string>, cp string")
    kw_sets = [["on", "é"], ["", "b"], ["ring", ""], ["(", "Ñ"], ["", ""], ["06000"]]
    m = {"on": "ON", "ring": "R", "é": "E"}
    for kws in kw_sets:
        cols = [street_entity_pred("a", "b", kws, "reference").alias("s"),
                address_keyword_pred("lines", "cp", kws).alias("ad"),
                any_keyword_pred(["a", "b"], kws).alias("an")]
        got = {r.i: r for r in df.select("i", *cols).collect()}
        for i, a, b, lines, cp in data:
            r = got[i]
            assert r.s == py_street(a, b, kws), (kws, a, b)
            assert r.ad == py_address(lines, cp, kws), (kws, lines, cp)
            assert r.an == py_any([a, b], kws), (kws, a, b)
    out = {r.i: r for r in df.select("i", clean_chars("a").alias("c"), reduce_name("a", m).alias("p")).collect()}
    for i, a, *_ in data:
        assert out[i].c == py_clean(a) and out[i].p == py_reduce(a, m)


def test_coordinate_and_abbreviation_parity(spark):
    from poicraft.functions import abbreviate_label, geojson_coords
    from poicraft.functions.names import LEGEND_ABBREVIATIONS
    rng = random.Random(11)
    pieces = ["1", "2", ".", "-", "+", "e", "5", " ", "x", "_", "0"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(400)]
    texts += ["nan", "inf", "1.5d", "1_0", " 3.25 ", ".5", "5.", "-0.0", "1e-3", None]

    def py_num(t):
        if t is None or "_" in t:
            return None
        try:
            v = float(t)
        except ValueError:
            return None
        return None if v != v or v in (float("inf"), float("-inf")) else v

    df = spark.createDataFrame([(t, "1.0") for t in texts], "a string, b string")
    got = [r.c for r in df.select(geojson_coords("a", "b").alias("c")).collect()]
    for t, c in zip(texts, got):
        v = py_num(t)
        assert list(c) == ([v, 1.0] if v is not None else []), t

    keys = list(LEGEND_ABBREVIATIONS)
    labels = [" ".join(rng.sample(keys + ["x", "Otro"], 2)) + "[3]" for _ in range(100)]

    def py_abbrev(label):
        for k, v in LEGEND_ABBREVIATIONS.items():
            if k in label:
                return label.replace(k, v)
        return label

    lf = spark.createDataFrame([(x,) for x in labels], "l string")
    out = [r.o for r in lf.select(abbreviate_label("l").alias("o")).collect()]
    assert out == [py_abbrev(x) for x in labels]
