"""Column functions against the semantic traps."""

from pyspark.sql import functions as F

from poicraft.functions import (address_keyword_pred, any_keyword_pred, category_color,
                                clean_chars, clean_chars_array, color_for_keys, geojson_coords,
                                month_timestamp, reduce_name, abbreviate_label, search_date,
                                strict_coords, street_entity_pred, timestamp_text)
from poicraft.functions.palette import COLOR_ALPHABETS, OTHER_COLOR


def rows(df, col="r"):
    return [r[col] for r in df.collect()]


def test_clean_chars_each_forbidden_char_and_null(spark):
    df = spark.createDataFrame([("a(b)c;d=e'f>g<h",), (None,)], "s string")
    assert rows(df.select(clean_chars("s").alias("r"))) == ["a b c d e f g h", "None"]
    assert rows(df.select(clean_chars("s", null_text=None).alias("r"))) == ["a b c d e f g h", None]


def test_clean_chars_array_elementwise(spark):
    df = spark.createDataFrame([(["x=1", None],), (None,)], "a array<string>")
    assert rows(df.select(clean_chars_array("a").alias("r"))) == [["x 1", "None"], None]


def test_t1_null_street_matches_keyword_on(spark):
    df = spark.createDataFrame([(None, "ciudad")], "street string, ent string")
    on = df.filter(street_entity_pred("street", "ent", ["on", "ciudad"])).count()
    ring = df.filter(street_entity_pred("street", "ent", ["ring", "ciudad"])).count()
    assert (on, ring) == (1, 0)


def test_t6_blank_keywords_entity_modes(spark):
    df = spark.createDataFrame([("av insurgentes", "jalisco"), ("av reforma", "Ciudad de México")],
                               "street string, ent string")
    kw = ["", "ciudad de méxico"]
    assert df.filter(street_entity_pred("street", "ent", kw, "reference")).count() == 2
    assert df.filter(street_entity_pred("street", "ent", kw, "always")).count() == 1
    assert df.filter(street_entity_pred("street", "ent", ["ciudad de méxico"], "reference")).count() == 2
    assert df.filter(street_entity_pred("street", "ent", ["a", "", "jalisco"])).count() == 1
    assert df.filter(street_entity_pred("street", "ent", ["a", ""])).count() == 2


def test_t7_postal_guard(spark):
    df = spark.createDataFrame([
        (1, ["Calle 5 06000", "x"], "06000"),   # first line holds the postal code: rejected
        (2, ["Av Reforma 10", "06000"], "06000"),
        (3, ["Av Reforma 10"], ""),             # empty postal code is in every line: rejected
        (4, [], "1"), (5, None, "1"),           # no first line: dropped
        (6, ["Av Reforma"], None),              # null postal reads 'None'
        (7, [None, "Reforma"], "1"),            # null first line reads 'None'
    ], "id int, addr array<string>, cp string")
    kept = rows(df.filter(address_keyword_pred("addr", "cp", ["reforma"])).select(F.col("id").alias("r")))
    assert sorted(kept) == [2, 6]
    on = rows(df.filter(address_keyword_pred("addr", "cp", ["on"])).select(F.col("id").alias("r")))
    assert sorted(on) == [7]


def test_any_keyword_filter_or_and_empty(spark):
    df = spark.createDataFrame([("Datos SA", "x", 1), ("y", "Informática", 2), ("z", "w", 3)],
                               "a string, b string, n int")
    assert df.filter(any_keyword_pred(["a", "b"], ["dato", "informát"])).count() == 2
    assert df.filter(any_keyword_pred(["a", "b"], [])).count() == 0
    assert df.filter(any_keyword_pred(["n"], ["3"])).count() == 1


def test_t12_coordinates(spark):
    cases = [("S/N", "1.0", []), (" 1.5 ", "2", [1.5, 2.0]), ("nan", "1", []), ("1.5d", "1", []),
             (None, "1", []), ("-99.1", "bad", []), ("-99.12", "19.43", [-99.12, 19.43]),
             ("1e3", "2", [1000.0, 2.0])]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "lng string, lat string")
    got = rows(df.select(geojson_coords("lng", "lat").alias("r")))
    assert [list(g) for g in got] == [c for _, _, c in cases]


def test_strict_coords(spark):
    df = spark.createDataFrame([("-99.12", "19.4"), ("99", "19.4"), (None, "1.0"), ("1.5e3", "2.0")],
                               "lng string, lat string")
    got = [list(g) for g in rows(df.select(strict_coords("lng", "lat").alias("r")))]
    assert got == [[-99.12, 19.4], [], [], []]


def test_reduce_name_first_match_case_sensitive_and_null(spark):
    m = {"ring": "RNG", "red": "RED", "on": "ON"}
    df = spark.createDataFrame([("red ring",), ("Ring",), (None,), ("blue",)], "s string")
    assert rows(df.select(reduce_name("s", m).alias("r"))) == ["RNG", "Ring", "ON", "blue"]


def test_abbreviate_label_replaces_every_occurrence(spark):
    df = spark.createDataFrame([("Comercio al por menor y Comercio al por menor[3]",)], "s string")
    assert rows(df.select(abbreviate_label("s").alias("r"))) == ["C_aP_menor y C_aP_menor[3]"]


def test_t11_palette_deterministic_and_within_alphabets(spark):
    df = spark.createDataFrame([(f"Brand#{i}",) for i in range(40)] + [(None,), ("Other",)], "c string")
    got = rows(df.select(category_color("c").alias("r")))
    again = rows(df.select(category_color("c").alias("r")))
    assert got == again
    for color in got[:40]:
        assert len(color) == 7 and color[0] == "#"
        assert all(ch in alpha for ch, alpha in zip(color[1:], COLOR_ALPHABETS))
    keyed = rows(df.select(color_for_keys("c", keys=["Brand#1", "Other"]).alias("r")))
    assert keyed[1] == got[1] and keyed[2] == OTHER_COLOR and keyed[-1] == OTHER_COLOR
    assert keyed[-2] == OTHER_COLOR


def test_dates(spark):
    df = spark.createDataFrame([("2019-03-01 10:00:00", "2010-07"), (None, None)], "ts string, m string")
    out = df.select(search_date("ts").alias("d"), month_timestamp("m").alias("m"),
                    timestamp_text("2019-05-23 12:00:00").alias("t")).collect()
    assert out[0].d == "20190227" and out[0].m == "2010-07-01T12:00:00.00Z"
    assert out[1].m == "None-01T12:00:00.00Z" and out[0].t == "2019-05-23T12:00:00.000000Z"
