import itertools
import random

import numpy as np
from llm_helpers import SF
from pyspark.sql import functions as F

from binroute.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_cost(roles):
    """The cheapest of all assignments of final roles, with insertions and merges as the costs say."""
    best = c.FAR
    for final in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, state = 0, c.START
        for role, to in zip(roles, final, strict=True):
            ways = [c.MERGE] if state == to else []
            if (state, to) in c._BETWEEN:
                ways.append(c.INSERT * len(c._BETWEEN[state, to]))
            cost += min(ways, default=c.FAR) + c._relabel(role, to)
            state = to
        best = min(best, cost + c.INSERT * len(c._CLOSING[state]))
    return best


def legal(roles):
    if not roles:
        return True
    body = roles[1:] if roles[0] == "system" else roles
    return len(body) % 2 == 0 and bool(body) and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(body))


def cost_of(rows):
    price = {"keep": 0, "merge": c.MERGE, "insert": c.INSERT, "relabel": 0}
    cost = sum(price[r["action"]] for r in rows)
    return cost + sum(c._relabel(c.role_code(r["original_role"]), c.ROLES.index(r["role"]) + 1) for r in rows if r["action"] != "insert")


def check(found, turns):
    """Legal roles, the least cost, and every text once in order."""
    rows = sorted(found, key=lambda r: (r["turn"], r["part"]))
    assert legal([r["role"] for r in rows if r["action"] != "merge"])
    for before, row in zip(rows, rows[1:], strict=False):
        assert row["action"] != "merge" or row["role"] == before["role"]
    assert [r["original_role"] for r in rows if r["action"] != "insert"] == [role for _, role, _ in turns]
    rendered = "".join(r["rendered"] for r in rows)
    at = 0
    for _, _, text in turns:
        at = rendered.index(text or "", at) + len(text or "")
    return cost_of(rows)


def test_cheapest_repairs(spark):
    rng = random.Random(1)
    names = ["system", "user", "assistant", "User ", "tool", None]
    convs = {i: [(t, rng.choice(names), f"text {i} {t}.") for t in range(rng.randint(1, 6))] for i in range(150)}
    rows = [(i, *turn) for i, turns in convs.items() for turn in turns]
    found = {}
    for r in c.repair(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["conv_id"], []).append(r)
    for i, turns in convs.items():
        assert check(found[i], turns) == plain_cost([c.role_code(role) for _, role, _ in turns])


def test_matrices_chain_to_the_same_cost():
    rng = random.Random(2)
    for _ in range(100):
        roles = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        cut = rng.randint(0, len(roles))
        whole = c.total(roles)
        parts = [c.total(roles[:cut]), c.total(roles[cut:])]
        assert (np.minimum((parts[0][:, :, None] + parts[1][None]).min(axis=1), c.FAR) == whole).all()
        (a, b), (d, e) = c.chain(parts)
        assert a == c.START and b == d and int((whole[c.START] + c._CLOSE).min()) == parts[0][a, b] + parts[1][d, e] + c._CLOSE[e]


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(3)
    turns = [(t, rng.choice(["user", "assistant", "system", None]), f"t{t};") for t in range(3000)]
    rows = [(1, *turn) for turn in turns] + [(0, 0, "user", "a"), (2, 0, "assistant", "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = {}
    for r in c.repair(docs).collect():
        found.setdefault(r["conv_id"], []).append(r)
    roles = [c.role_code(role) for _, role, _ in turns]
    whole = c.total(roles)
    assert check(found[1], turns) == int((whole[c.START] + c._CLOSE).min())
    assert [r["role"] for r in sorted(found[2], key=lambda r: (r["turn"], r["part"]))] == ["user", "assistant"]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, None, None, None), (5, 1, "user", "x"), (5, 1, "user", "x"), (6, 0, "assistant", ""), (7, 0, "system", "s" * 100000)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"part": F.lit("p"), "action": F.lit(1), "rendered": F.lit("r")})
    found = c.repair(docs).collect()
    by = {}
    for r in found:
        by.setdefault(r["conv_id"], []).append(r)
    assert set(by) == {None, 5, 6, 7}
    for conv, own in by.items():
        rows_of = sorted(own, key=lambda r: (r["turn"] is not None, r["turn"], r["part"]))
        assert legal([r["role"] for r in rows_of if r["action"] != "merge"]), conv
        assert sum(r["action"] != "insert" for r in own) == sum(x[0] == conv for x in rows)
    assert c.repair(docs.where("conv_id > 100")).count() == 0


def test_given_conversations(spark):
    docs = spark.read.parquet(f"{SF}/conversations.parquet")
    turns, found = {}, {}
    for r in docs.orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    for r in c.repair(docs).collect():
        found.setdefault(r["conv_id"], []).append(r)
    for conv, own in turns.items():
        whole = c.total([c.role_code(role) for _, role, _ in own])
        assert check(found[conv], own) == int((whole[c.START] + c._CLOSE).min())
