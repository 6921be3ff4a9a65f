"""Language identification: held-out accuracy, determinism, odd rows."""

import numpy as np
from cases import no_docs, odd_docs, odd_rows, remainder, table
from pyspark.sql import functions as F

from poicraft.llm import langid
from poicraft.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op3_language_hd"](spark, SF).collect()
    lang = dict(zip(table("documents", SF).doc_id, table("documents", SF).lang))
    assert len(rows) == len(lang) and all(r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_vectors_bind_permuted_letters():
    enc = langid.Encoder(dim=64, gram=3)
    a, b, blank = enc._letter(ord("a")), enc._letter(ord("b")), enc._letter(0)
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank.astype(int)
    got = enc.vectors(["Ab", "", "!a--b?", "  "])
    assert np.allclose(got[0], want / np.linalg.norm(want)) and not got[1].any() and not got[3].any()
    assert not np.allclose(got[0], got[2])


def test_many_grams_and_a_full_cache(monkeypatch):
    enc, text = langid.Encoder(dim=32), "abcdefghijklmnop" + "".join(chr(0x400 + i * 7 % 200) for i in range(500))
    whole = enc.vectors([text, "abc"])
    monkeypatch.setattr(langid, "CACHE", 64)
    assert np.allclose(langid.Encoder(dim=32).vectors([text, "abc"]), whole, atol=1e-5)


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    model = langid.train(docs)
    assert list(model) == ["de", "en", "fr"]
    rows = langid.identify(docs, model).collect()
    assert len(rows) == len(odd_rows())
    lost = {(i, t) for i, t, *_ in odd_rows() if not any(c.isalpha() for c in t or "")}
    assert sum(r.lang == "und" and r.score == 0 for r in rows) == len([t for _, t, *_ in odd_rows() if not any(c.isalpha() for c in t or "")]) >= len(lost)
    assert {r.lang for r in rows if r.doc_id == 7} == {"de"}
    assert langid.train(no_docs(spark)) == {} and langid.identify(no_docs(spark), model).count() == 0
    assert {r.lang for r in langid.identify(docs, {}).collect()} == {"und"}


def test_training_is_bounded_and_ignores_other_columns(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("der die das und").alias("text"), F.lit("de").alias("lang"))
    one = langid.train(docs, max_train=50)
    again = langid.train(docs.repartition(7), max_train=50)
    assert np.allclose(one["de"], again["de"], atol=1e-6)


def test_prototypes_and_cosines_by_hand(spark):
    """The argmax over prototypes, recomputed for every document of the query from its definition."""
    docs = table("documents", "/root/testdata/sf0.001")
    enc, vectors = langid.Encoder(), {}
    for i, t in zip(docs.doc_id, docs.text):
        total = np.zeros(langid.DIM)
        letters = "".join(c if c.isalpha() else " " for c in t.lower())
        letters = " " + " ".join(letters.split()) + " "
        for k in range(len(letters) - 2):
            v = np.ones(langid.DIM)
            for j, c in enumerate(letters[k:k + 3]):
                v = v * np.roll(enc._letter(0 if c == " " else ord(c)), 2 - j)
            total += v
        vectors[i] = total / np.linalg.norm(total)
    model = {}
    for lang in sorted(set(docs.lang.dropna())):
        own = [vectors[i] for i, x in zip(docs.doc_id, docs.lang) if x == lang and remainder(i, 3) != 1]
        model[lang] = sum(own) / np.linalg.norm(sum(own))
    rows = QUERIES["op3_language_hd"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        cosines = {k: float(vectors[r.doc_id] @ v) for k, v in model.items()}
        assert abs(r.score - max(cosines.values())) < 1e-4 and cosines[r.lang_pred] > max(cosines.values()) - 1e-4


def test_texts_of_no_language_are_not_accepted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    least = langid.floors(docs, model)
    assert len(least) > 5 and min(least) == 6 and all(0 < v < langid.FLOOR for v in least.values())
    assert docs.filter(~langid.accepted(F.col("text"), model, least)).count() == 0
    rng = np.random.default_rng(4)
    noise = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxzкщшжцчфхпрстнгд"), rng.integers(3, 9))) for _ in range(4000)]
    strange = [(i, " ".join(noise[i * 100:(i + 1) * 100])) for i in range(40)] + [(90, None), (91, "12 !!"), (92, "")]
    df = spark.createDataFrame(strange, "doc_id bigint, text string")
    assert df.filter(langid.accepted(F.col("text"), model, least)).count() == 0


def test_the_kept_table_is_a_byte_a_place():
    """Workers keep it for the next stages: 16 MB of n-gram vectors, not 64."""
    from poicraft.llm.langid import CACHE, DIM, Encoder
    enc = Encoder()
    vectors = enc.vectors(["der schnelle braune Fuchs springt", "the quick brown fox", "", "123"])
    assert enc.table.nbytes == len(enc.table) * DIM and len(enc.table) <= CACHE
    for text, v in zip(["der schnelle braune Fuchs springt", "the quick brown fox"], vectors):
        keys, counts = enc._grams(text)
        want = counts.astype(np.float64) @ enc.table[enc._places(keys)].astype(np.float64)
        assert abs(want / np.linalg.norm(want) - v).max() < 1e-5
    assert not vectors[2:].any()
