"""Conversation repair: the search against exhaustive and plain versions, the query against a plain-Python statement of it."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from cases import SF, table
from pyspark.sql import functions as F

from poicraft.llm import repair as P
from poicraft.llm.queries import QUERIES

SPACE = "[\x20\x09-\x0d]"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def results(codes, audit):
    """Initials of the turns that an audit can give (several, as R and I choose a role), or none if it doesn't fit."""
    rows = [codes[i:i + 2] for i in range(0, len(codes), 2)]
    found = {""}
    for letter in audit:
        if letter == "I":
            found = {f + c for f in found for c in "ua"}
            continue
        if not rows:
            return set()
        (initial, fault), rows = rows[0], rows[1:]
        if letter != "D" and fault in "bd":
            return set()
        found = {f + c for f in found for c in {"D": [""], "K": [initial], "R": "ua"}[letter]}
    return found if not rows else set()


def price(codes, audit):
    kept, cost = iter(codes[1::2]), 0
    for letter in audit:
        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[letter]
        if letter != "I" and next(kept) == "t" and letter != "D":
            cost += 5
    return cost


def exhaustive(codes):
    n = len(codes) // 2
    most = 2 * n  # all deleted
    best = []
    for inserts in range(most // 5 + 1):
        for audit in itertools.product("KRDI", repeat=n + inserts):
            a = "".join(audit)
            if a.count("I") == inserts and any(re.fullmatch("(s?(ua)+)?", r) for r in results(codes, a)):
                best.append((price(codes, a), a))
    return min(best)


def plain(codes):
    """Least (cost, audit) by recursion over rows and the initials still allowed."""
    n = len(codes) // 2

    @lru_cache(None)
    def go(i, state, inserts):
        options = [(0, "")] if i == n and state in "0a" else []
        after = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        due = "a" if state == "u" else "u"
        steps = [(5, "I", i, due)] if inserts < 3 else []
        if i < n:
            initial, fault = codes[2 * i:2 * i + 2]
            steps.append((2, "D", i + 1, state))
            if fault not in "bd":
                extra = 5 * (fault == "t")
                steps.append((1 + extra, "R", i + 1, due))
                if (state, initial) in after:
                    steps.append((extra, "K", i + 1, after[state, initial]))
        for cost, letter, j, s in steps:
            c, a = go(j, s, inserts + 1 if letter == "I" else 0)
            options.append((cost + c, letter + a))
        return min(options, default=(10 ** 9, ""))

    return go(0, "0", 0)


def draw(rng, n):
    return "".join(rng.choice("suuaaa-") + rng.choice("....tbd") for _ in range(n))


def test_search_against_every_audit():
    rng = random.Random(1)
    every = ["".join(a + b for a, b in zip(x, y)) for n in range(3) for x in itertools.product("sua-", repeat=n) for y in itertools.product(".tb", repeat=n)]
    for codes in every + [draw(rng, n) for n in (3, 4, 5) for _ in range(15)]:
        assert P.cheapest(codes) == exhaustive(codes) == plain(codes), codes


@pytest.mark.parametrize("n", [6, 12, 40, 120])
def test_search_against_recursion(n):
    rng = random.Random(n)
    for _ in range(60 if n < 40 else 15):
        codes = draw(rng, n)
        cost, audit = P.cheapest(codes)
        assert (cost, audit) == plain(codes), codes
        assert price(codes, audit) == cost


def test_long_conversations_stay_linear():
    assert P.cheapest("u.a." * 20_000) == (0, "K" * 40_000)
    cost, audit = P.cheapest("u." * 10_000)
    assert cost == 5_000 and len(audit) == 10_000 and "D" not in audit


def brute(rows):
    """The contract, conversation by conversation."""
    out, convs = {}, {}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        live = convs.setdefault(conv, [])
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        hit = zlib.crc32(key.encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        live += [(turn is not None, turn or 0, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for conv, live in convs.items():
        live.sort()
        faults, seen = [], set()
        for _, _, role, text in live:
            bare = re.sub(f"{SPACE}+\\Z", "", text)
            faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ".")
            seen.add((role, text))
        initials = [r[2][:1] for r in live]
        cost, audit = plain("".join((i if i and i in "sua" else "-") + f for i, f in zip(initials, faults)))
        said, i, last = [], 0, ""
        for letter in audit:
            due = "assistant" if last == "u" else "user"
            if letter == "I":
                said.append(due + ":")
            elif letter != "D":
                said.append((live[i][2] if letter == "K" else due) + ":" + live[i][3])
            i += letter != "I"
            last = said[-1][:1] if letter != "D" else last
        turns = {t for known, t, *_ in live if known}
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def same(found, rows):
    got = found.collect()
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r.conv_id], r


def test_query(spark):
    rows = [tuple(r) for r in table("conversations")[["conv_id", "turn", "role", "text"]].itertuples(index=False)]
    same(QUERIES["op12_conversation_repair"](spark, SF), rows)


def test_odd_rows_through_the_query(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}.") for t in range(40)]
    rows += [(2, None, "user", "a."), (2, None, None, "b?"), (2, 5, "assistant", None), (2, 5, "assistant", "c! \n\t "), (2, 5, "assistant", "c! \n\t "), (2, 9, "", "…")]
    rows += [(None, 1, "system", "x."), (None, None, "user", "y."), (3, 7, "user", " "), (4, 0, "system", "only."), (5, 2, "usher", "kept."), (5, 3, "assistant", "z" * 200_000 + "!")]
    gone = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "never seen.")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("conv", "live", "at", "fault", "pair", "new", "turns", "found", "copy"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    same(QUERIES["op12_conversation_repair"](spark, str(tmp_path)), rows)


def test_repair_without_damage_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "Alone.")]
    df = P.messages(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv: r for r in P.repair(df).collect()}
    assert (got[1].cost, got[1].audit, got[1].illegal) == (2, "DKK", 1)
    assert [(t.role, t.text) for t in got[1].repaired] == [("user", "Hello?"), ("assistant", "Yes.")]
    assert (got[2].cost, got[2].audit, got[2].repaired) == (2, "D", [])
    assert P.repair(P.damaged(df.limit(0))).count() == 0
