"""Repair of conversation structure: the cheapest edits that make the turns of a
conversation alternate, found by a bidirectional Dijkstra search.

The edit lattice of a conversation has a node per number of rows read and state of the
result so far: empty, after the system turn, after a user's, after an assistant's.
Keeping, re-roling or deleting a row reads it; inserting an empty turn does not. A
forward heap starts at the empty result, a reverse heap at the results that are whole
(empty, or ending with an assistant); both run until their least costs add up to more
than the best meeting, so every crossing of that cost is finished, and of all of them
the one whose two halves join to the ASCII-least audit wins.

Spark sorts each conversation, finds the faults and builds the result; the search gets
two characters a row. A conversation is one row of output and so meets in one task.

Null roles and texts read as one space. Rows of equal turns stand in order of role and
text; a null turn comes first; null conversation ids form one conversation. Repeated rows
are duplicates of the first. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The cost of each edit, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a kept turn, by state and initial.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: State after a turn that may be chosen: it takes the role that is due.
DUE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: States in which a result is whole.
WHOLE = (START, ASSISTANT)
#: Pairs of initials that may follow each other.
LEGAL = ("su", "ua", "au")
SPACE = "[\\x20\\x09-\\x0D]"
FOUND = "cost bigint, audit string, plan array<struct<row:int,role:string>>"


# ---------------------------------------------------------------- the search


def _after(codes: str, i: int, state: int):
    """Edges ``(cost, letter, (i, state))`` from a node."""
    if 2 * i < len(codes):
        initial, fault = codes[2 * i], codes[2 * i + 1]
        if fault in "bd":
            yield DELETE, "D", (i + 1, state)
        else:
            extra = TRUNCATED if fault == "t" else 0
            if (kept := KEPT.get((state, initial))) is not None:
                yield KEEP + extra, "K", (i + 1, kept)
            yield REROLE + extra, "R", (i + 1, DUE[state])
            yield DELETE, "D", (i + 1, state)
    yield INSERT, "I", (i, DUE[state])


def _before(codes: str, i: int, state: int):
    """Edges ``(cost, letter, (i, state))`` into a node, by the node they come from."""
    for j in ((i - 1, i) if i else (i,)):
        for source in range(4):
            for cost, letter, node in _after(codes, j, source):
                if node == (i, state):
                    yield cost, letter, (j, source)


class _Half:
    """One direction of the search. ``best[node]`` is its cost and, for the ASCII-least audit of
    that cost, the letter and the node towards the start of this half."""

    def __init__(self, starts, sign: int):
        self.sign, self.best, self.done = sign, {s: (0, "", None) for s in starts}, {}
        self.heap = [(0, sign * s[0], s) for s in starts]
        heapq.heapify(self.heap)

    def least(self):
        while self.heap and self.heap[0][2] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self):
        """Takes the next node. Of equal costs the one further back comes first: edges that
        cost nothing lead on by one row, so all ways of that cost into a node are known."""
        cost, _, node = heapq.heappop(self.heap)
        self.done[node] = self.best[node]
        return node, cost

    def offer(self, node, cost: int, letter: str, via) -> None:
        if node in self.done:
            return
        old = self.best.get(node)
        if old is None or cost < old[0]:
            heapq.heappush(self.heap, (cost, self.sign * node[0], node))
        elif cost > old[0] or not self.sooner((letter, via), (old[1], old[2])):
            return
        self.best[node] = (cost, letter, via)

    def audit(self, node) -> str:
        letters = []
        while (step := self.done[node])[2] is not None:
            letters.append(step[1])
            node = step[2]
        return "".join(reversed(letters) if self.sign > 0 else letters)

    def sooner(self, a, b) -> bool:
        """Whether one way into a node has the ASCII-lesser audit than another of equal cost."""
        if self.sign < 0:  # the letters are read from this node on
            while a[0] == b[0] and a[1] != b[1]:
                a, b = self.done[a[1]][1:], self.done[b[1]][1:]
            return a[0] < b[0]
        # the letters are read up to this node: go back to where the ways part
        (x, u), (y, v) = a, b
        while u != v:
            ku, kv = (u[0], self.done[u][0]), (v[0], self.done[v][0])
            if ku >= kv:
                x, u = self.done[u][1:]
            if kv >= ku:
                y, v = self.done[v][1:]
        return x < y


def cheapest(codes: str) -> tuple[int, str]:
    """``cost, audit`` of a conversation given as two characters a row: the role's initial and
    the fault (``b``, ``d``, ``t`` or ``.``)."""
    n = len(codes) // 2
    there = _Half([(0, START)], 1)
    back = _Half([(n, s) for s in WHOLE], -1)
    most, crossings = None, []

    def cross(u, letter, cost, w):
        nonlocal most
        whole = there.done[u][0] + cost + back.done[w][0]
        most = whole if most is None else min(most, whole)
        if cost:
            crossings.append((whole, u, letter, cost, w))

    while True:
        f, r = there.least(), back.least()
        if f is None or r is None or (most is not None and f + r > most):
            break
        if f <= r:
            node, so_far = there.settle()
            if node in back.done:
                cross(node, "", 0, node)
            for cost, letter, w in _after(codes, *node):
                there.offer(w, so_far + cost, letter, node)
                if w in back.done:
                    cross(node, letter, cost, w)
        else:
            node, so_far = back.settle()
            if node in there.done:
                cross(node, "", 0, node)
            for cost, letter, u in _before(codes, *node):
                back.offer(u, so_far + cost, letter, node)
                if u in there.done:
                    cross(u, letter, cost, node)
    # Each cheapest path leaves the costs below f by one edge, from a node settled by the
    # forward search to one settled by the reverse search; or lies on one side of it.
    if f is None or f > most:
        audits = [there.audit(s) for s in back.done if s in there.done and s[0] == n and s[1] in WHOLE and there.done[s][0] == most]
    elif f == 0:
        audits = [back.audit((0, START))]
    else:
        audits = [there.audit(u) + letter + back.audit(w) for whole, u, letter, cost, w in crossings
                  if whole == most and there.done[u][0] < f <= there.done[u][0] + cost]
    return most, min(audits)


def replay(codes: str, audit: str) -> list[tuple[int, str]]:
    """``(row, initial)`` of every turn of the result: the row it comes from (-1: inserted), and
    ``u`` or ``a`` where the edit sets its role (empty: as it is)."""
    out, i, state = [], 0, START
    for letter in audit:
        if letter == "D":
            i += 1
        elif letter == "K":
            out.append((i, ""))
            state, i = KEPT[state, codes[2 * i]], i + 1
        else:
            state = DUE[state]
            out.append((i if letter == "R" else -1, "ua"[state - USER]))
            i += letter == "R"
    return out


def _search(codes: pd.Series) -> pd.DataFrame:
    known = {}
    for c in codes.unique():  # many conversations have the same faults
        cost, audit = cheapest(c)
        known[c] = (cost, audit, [{"row": i, "role": r} for i, r in replay(c, audit)])
    return pd.DataFrame([known[c] for c in codes], columns=["cost", "audit", "plan"])


# ---------------------------------------------------------------- the operator


def messages(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with null roles and texts as one space."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Messages with the faults that the hash of ``conv:turn`` deals out, as ``conv, turn, role, text, live``.

    Of 20 values 0 drops the row (it stays as a row that is not ``live``), 1 empties its
    text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it the user's.
    """
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(at("conv"), F.lit(":"), at("turn"))), F.lit(20))
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(hit == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(hit == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), (hit != 0).alias("live"), copies.alias("copy")).drop("copy")


def diagnosed(rows: DataFrame) -> DataFrame:
    """Live messages with their place in the conversation and first fault: ``conv, turn, role,
    text, live, at, fault``."""
    whole = rows if "live" in rows.columns else rows.withColumn("live", F.lit(True))
    by = ["conv", "live"]
    placed = whole.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "role", "text")))
    again = F.row_number().over(Window.partitionBy(*by, "role", F.sha2("text", 256)).orderBy("at")) > 1
    blank = ~F.col("text").rlike(f"[^{SPACE[1:]}")
    cut = ~F.col("text").rlike(f"[.!?]{SPACE}*\\z")
    return placed.withColumn("again", again).withColumn(
        "fault", F.when(blank, F.lit("b")).when(F.col("again"), F.lit("d")).when(cut, F.lit("t")).otherwise(F.lit("."))).drop("again")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of messages ``conv, turn, role, text`` (and ``live``): ``conv, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired``.

    ``repaired`` holds the turns ``role, text`` after the edits; ``audit`` their letters Keep,
    Rerole, Delete and Insert. A conversation without a live row costs nothing.
    """
    initial = F.substring("role", 1, 1)
    turns = Window.partitionBy("conv", "live").orderBy("at")
    # One shuffle: the windows and the aggregate below all lie within a conversation.
    seen = diagnosed(rows.repartition("conv")).withColumn("pair", F.concat(F.lag(initial).over(turns), initial)).withColumn(
        "new", F.coalesce(F.col("turn") != F.lag("turn").over(turns), F.col("turn").isNotNull()))
    live = lambda c: F.when(F.col("live"), c)
    count = lambda c: F.count(F.when(F.col("live") & c, F.lit(1)))
    # A role without exactly one initial of its own fits nowhere.
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise(F.lit("-")), F.col("fault"))
    found = seen.groupBy("conv").agg(
        F.coalesce(F.max(live(F.col("turn"))) - F.min(live(F.col("turn"))) + 1 - count(F.col("new")), F.lit(0)).cast("bigint").alias("gaps"),
        count(F.col("fault") == "b").alias("blank"), count(F.col("fault") == "d").alias("duplicate"),
        count(F.col("fault") == "t").alias("truncated"), count(~F.col("pair").isin(*LEGAL)).alias("illegal"),
        F.sort_array(F.collect_list(live(F.struct("at", "role", "text", code.alias("code"))))).alias("turns"))
    coded = found.withColumn("found", F.pandas_udf(_search, FOUND)(F.array_join(F.transform("turns", lambda t: t["code"]), "")))
    turn = lambda p: F.get(F.col("turns"), F.greatest(p["row"], F.lit(0)))
    repaired = F.transform("found.plan", lambda p: F.struct(
        F.when(p["role"] == "u", F.lit("user")).when(p["role"] == "a", F.lit("assistant")).otherwise(turn(p)["role"]).alias("role"),
        F.when(p["row"] < 0, F.lit("")).otherwise(turn(p)["text"]).alias("text")))
    return coded.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "found.cost", "found.audit", repaired.alias("repaired"))
