"""SpotSigs: edits and digests against Python, signatures by hand, matches against all pairs."""

import hashlib
import re

from cases import SF, no_docs, odd_docs, odd_rows, table
from pyspark.sql import functions as F

from poicraft.llm import spotsigs as S
from poicraft.llm.queries import QUERIES


def signatures(text):
    """Signatures as strings: anchor and chain, or all words if there is no whole chain."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    content = [(w, words[i - 1] if i and words[i - 1] in S.ANCHORS else None) for i, w in enumerate(words) if w not in S.ANCHORS]
    out = {(a, *[w for w, _ in content[i:i + 3]]) for i, (_, a) in enumerate(content) if a and i + 3 <= len(content)}
    return out or {tuple(w if not a else f"{a}^{w}" for w, a in content)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_query(spark):
    docs = table("documents").sort_values("doc_id", ascending=False)
    rows = {r.doc_id: r for r in QUERIES["op5_spotsigs"](spark, SF).collect()}
    ids, texts = docs.doc_id.tolist(), docs.text.tolist()
    assert sorted(rows) == sorted(ids)
    for i, (k, t) in enumerate(zip(ids, texts)):
        n, after, r = len(t), texts[(i + 1) % len(texts)], rows[k]
        edited = t[:n - n // 2] + after[:n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(signatures(t), signatures(edited))) < 1e-9
        assert abs(r.near_next - jaccard(signatures(t), signatures(after))) < 1e-9
        assert int(r.fingerprint.split(":")[0]) == len(signatures(t))
    by_text = {}
    for k, t in zip(ids, texts):
        by_text.setdefault(t, set()).add(rows[k].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_many_blocks_give_the_same_order(spark, monkeypatch):
    docs = spark.range(500).select((F.col("id") * 977 % 5000).alias("doc_id"), F.concat(F.lit("the text "), "id").alias("text"))
    one = sorted(map(tuple, S.with_next(docs, "doc_id", "text", "s").select("doc_id", "text", "next_text").collect()))
    monkeypatch.setattr(S, "BLOCK_ROWS", 20)
    many = sorted(map(tuple, S.with_next(docs, "doc_id", "text", "s").select("doc_id", "text", "next_text").collect()))
    assert one == many and len(one) == 500
    order = sorted(one, reverse=True)
    assert [r[2] for r in order] == [r[1] for r in order[1:]] + [order[0][1]]


def test_odd_rows_and_empty_table(spark, monkeypatch):
    for rows_per_block in (2000, 2):
        monkeypatch.setattr(S, "BLOCK_ROWS", rows_per_block)
        rows = S.fingerprint_edits(odd_docs(spark)).select("doc_id", "n_chars", "edited", S.fingerprint(F.col("sigs")).alias("f"),
                                                           S.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near")).collect()
        assert sorted((r.n_chars for r in rows)) == sorted(len(t or "") for _, t, *_ in odd_rows())
        assert all(0 <= r.near <= 1 for r in rows)
        by = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert by[3].edited == "" and by[2].f == by[3].f
        nulls = [r for r in rows if r.doc_id is None]
        assert len(nulls) == 2 and by[7].f in {r.f for r in nulls}
    one = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")
    assert S.fingerprint_edits(one).first().edited == "abab"
    assert S.fingerprint_edits(no_docs(spark)).count() == 0


def test_matches_are_all_pairs(spark):
    base = "the cat sat down on a mat of straw and the dog ran to a house in that wood with the old tin roof is gone for good by now are you".split()
    texts = [" ".join(base * 2 + [f"the extra{i} word{i} here{i}"] * (i % 4)) for i in range(12)] + ["the only short one text", "", "", None]
    texts += [" ".join(base[::-1]) + f" the other{i // 2} thing{i // 2} here" for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id bigint, text string")
    pairs, members = S.matches(S.signature_rows(docs), 0.6)
    classes = {}
    for i, t in enumerate(texts):
        classes.setdefault(frozenset(signatures(t or "")), []).append(i)
    assert dict(map(tuple, members.collect())) == {i: min(c) for c in classes.values() for i in c}
    want = {}
    sets = {min(c): s for s, c in classes.items()}
    for a in sets:
        for b in sets:
            if a != b and (len(sets[a]), a) < (len(sets[b]), b) and jaccard(sets[a], sets[b]) >= 0.6:
                want[a, b] = round(jaccard(sets[a], sets[b]), 9)
    got = {(r.a, r.b): round(r.likeness, 9) for r in pairs.collect()}
    assert got == want and len(want) > 3


def test_the_query_links_all_near_copies(spark):
    docs = table("documents")
    sets = {k: signatures(t) for k, t in zip(docs.doc_id, docs.text)}
    rows = QUERIES["op5_spotsigs"](spark, SF).collect()
    near = {a: [b for b in sets if b != a and jaccard(sets[a], sets[b]) >= 0.8 - 1e-9] for a in sets}
    assert {r.doc_id: r.n_links for r in rows} == {a: len(b) for a, b in near.items()}
    assert {r.doc_id: r.class_id for r in rows} == {a: min([a] + [b for b in near[a] if sets[a] == sets[b]]) for a in sets}


def test_links_of_repeated_ids_and_rows_without_id(spark):
    base = " ".join(f"the word{i} then{i} here{i}" for i in range(20))
    texts = [(1, base), (1, base + " the last one word"), (2, base), (5, base + " the very last one"), (None, base), (7, "nothing alike")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    rows = S.with_links(S.signature_rows(docs)).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in rows), key=str) == sorted(
        [(1, 1, 3), (1, 1, 3), (2, 1, 3), (5, 5, 3), (None, None, None), (7, 7, 0)], key=str)


def test_a_long_run_of_anchors(spark):
    texts = ["the of " * 100_000 + "one two three four", "the " * 50_000, "of the one of"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n for r in S.signature_rows(docs).select("doc_id", F.size("sigs").alias("n")).collect()}
    assert got == {i: len(signatures(t)) for i, t in enumerate(texts)}


def test_blocks(spark):
    cuts = [i * 10 for i in range(1, 400)]
    values = [None, -5, 0, 9, 10, 11, 1279, 1280, 1281, 3989, 3990, 10**12]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    got = [r.b for r in df.select(S._block(F.col("v"), cuts).alias("b")).collect()]
    assert got == [-1 if v is None else sum(c <= v for c in cuts) for v in values]


def _links(sets):
    return [sum(j != i and jaccard(a, b) >= 0.8 - 1e-9 for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def test_a_large_group_of_near_copies_is_counted_without_its_pairs(spark, monkeypatch):
    common = [f"the word{i} then{i} here{i}" for i in range(40)]
    texts = [" ".join(common[:20] + [f"the extra{i} one{i} here{i}"] + common[20:]) for i in range(300)]
    texts += texts[:20] + [" ".join(common[:36])] * 3 + [" ".join(common[:30]), "nothing alike"]
    kept, old = {}, S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: kept.setdefault(name, old(df, name)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r.n_links for r in S.with_links(S.signature_rows(docs)).collect()}
    assert [rows[i] for i in range(len(texts))] == _links([signatures(t) for t in texts])
    assert kept["spot-pairs"].count() < 3 * len(texts)


def test_links_around_centres_are_those_of_all_pairs(spark, monkeypatch):
    import random
    r = random.Random(5)
    monkeypatch.setattr(S, "GROUP", 4)
    monkeypatch.setattr(S, "FITTED", 3)
    sets = []
    for base, n in ((0, 9), (1000, 20), (2000, 45), (2010, 45), (5000, 90)):
        for _ in range(60):
            x = set(range(base, base + n))
            lost = r.sample(sorted(x), r.randint(0, n // 6))
            sets.append(frozenset((x - set(lost)) | {base + n + r.randint(0, 12) for _ in range(r.randint(0, n // 9))}))
    sets += sets[:40]
    rows = [(i if i % 50 else i + 1, sorted((s * 0x9E3779B97F4A7C15 + 7) % 2**64 - 2**63 for s in x)) for i, x in enumerate(sets)]
    prints = spark.createDataFrame(rows, "doc_id bigint, sigs array<bigint>")
    got = sorted((x.doc_id, x.n_links) for x in S.with_links(prints).collect())
    want = _links(sets)
    assert got == sorted((d, n) for (d, _), n in zip(rows, want))
    assert S._near(S._sets(prints), 0.8).count() > 100


def _numbered(spark, sets):
    rows = [(i, sorted((s * 0x9E3779B97F4A7C15 + 7) % 2**64 - 2**63 for s in x)) for i, x in enumerate(sets)]
    return spark.createDataFrame(rows, "doc_id bigint, sigs array<bigint>")


def test_a_pair_of_near_copies_meets_about_once(spark, monkeypatch):
    import random
    r = random.Random(3)
    monkeypatch.setattr(S, "LEVELS", 1 << 12)
    base = range(100)
    sets = [frozenset(set(base) - set(r.sample(base, 4)) | {1000 + 10 * i + k for k in range(4)}) for i in range(200)]
    sets += [frozenset(100_000 + 60 * i + k for k in range(60)) for i in range(40)]
    found = S._sets(_numbered(spark, sets))
    met = S._candidates(found, 0.8)
    want = sum(_links(sets)) // 2
    assert S._pairs(found, 0.8).count() == want > 15_000
    assert met.distinct().count() <= met.count() < 2 * want
    monkeypatch.setattr(S, "BEFORE", 0)
    often = S._candidates(found, 0.8)
    assert often.count() > 5 * want and S._pairs(found, 0.8).count() == want


def test_a_centre_of_a_group_with_far_sets(spark):
    import random
    r = random.Random(4)
    base = range(25)
    sets = [frozenset(set(base) - set(r.sample(base, k)) | {1000 + 10 * i + j for j in range(k)}) for i in range(240) for k in [(1, 6, 6)[i % 3]]]
    prints = _numbered(spark, sets)
    near = S._near(S._sets(prints), 0.8)
    assert near.count() > 60 and near.count() == near.select("id").distinct().count()
    assert sorted((x.doc_id, x.n_links) for x in S.with_links(prints).collect()) == list(enumerate(_links(sets)))
