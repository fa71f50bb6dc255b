"""Operators that keep groups, orders and texts of any size apart from the driver, against sequential versions."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.functions import assertions as A
from quarrylake.operators import planning as P
from quarrylake.operators import sampling, split

CASES = "case_id string, duplicate_group string, labels array<string>"


def one_by_one(size, have, many, fraction, seed):
    """The greedy choice of one group after the other."""
    draw = np.random.default_rng(seed).random(len(size))
    left, taken = list(many), [0] * len(many)
    total, room = [fraction * sum(m * h[x] for m, h in zip(many, have)) for x in range(len(have[0]))], float(round(fraction * sum(m * n for m, n in zip(many, size))))
    got, wanted, full = [0.0] * len(total), max(room, 1), list(total)
    while room > 0 and any(left):
        def rank(k):
            gain = sum(min(have[k][x], max(full[x] - got[x], 0)) / max(full[x], 1) for x in range(len(full)))
            return round(gain / size[k] + min(room - size[k], 0) / wanted, 12), -abs(room - size[k]), draw[k]

        k = max((k for k in range(len(size)) if left[k]), key=rank)
        if any(taken) and size[k] - room > room:
            break
        left[k] -= 1
        taken[k] += 1
        room -= size[k]
        got = [g + h for g, h in zip(got, have[k])]
    return taken


def test_kinds_in_bulk_as_one_by_one():
    rng = np.random.default_rng(2)
    for trial in range(30):
        n = rng.integers(2, 9)
        size = rng.integers(1, 6, n).astype(float)
        have = np.minimum(rng.integers(0, 4, (n, 4)), size[:, None])
        many = rng.integers(1, 60, n)
        got = split.taken_of_kinds(size, have, many, 0.3, trial)
        assert list(got) == one_by_one(size, have, many, 0.3, trial), trial


def test_split_by_kinds(spark):
    rng = random.Random(3)
    rows = [(f"c{k}", f"g{rng.randrange(300)}", [rng.choice("abc"), rng.choice("abd")] if k % 7 else None) for k in range(1500)]
    rows += [(f"h{k}", "hot", ["a", "a"]) for k in range(700)] + [("n", None, ["a"])]
    cases = spark.createDataFrame(rows, CASES)
    chosen = {r[0] for r in split.split_by_kinds(cases, 0.2, 5).collect()}
    assert chosen == {r[0] for r in split.split_by_kinds(cases.repartition(7), 0.2, 5).collect()}
    kinds = {}
    for g in {r[1] for r in rows if r[1]}:
        own = [set(r[2] or ()) for r in rows if r[1] == g]
        counts = [{"label": x, "n": n} for x in "abcd" if (n := sum(x in o for o in own))]
        kind = json.dumps({"n": len(own)} | ({"counts": counts} if counts else {}), separators=(",", ":"))
        kinds.setdefault(kind, (len(own), [next((c["n"] for c in counts if c["label"] == x), 0) for x in "abcd"], []))[2].append(g)
    size, have, groups = zip(*(kinds[k] for k in sorted(kinds)))
    assert [sum(g in chosen for g in x) for x in groups] == one_by_one(size, have, [len(x) for x in groups], 0.2, 5)
    assert split.split_by_kinds(cases.limit(0), 0.2, 5).collect() == []


def test_tokens_of_a_very_long_text(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["Tooth 11 is missing. ", "The scan is partially visualized and the sinus is not included.\n", "Short. ", " " * 300]) for _ in range(3000))
    reports = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "id string, text string")
    tokens = [("a", k, k + rng.randrange(0, 9)) for k in range(0, len(text), 5)] + [("a", 0, 1000), ("b", 0, 4), ("c", 0, 4), ("a", None, 4), ("a", 9, 3)]
    table = spark.createDataFrame(tokens, "id string, begin int, end int")
    clauses = sorted((r.begin, r.end, r.covers) for r in A.T.clause_table(reports).select("begin", "end", A.T.is_coverage(F.col("clause")).alias("covers")).collect())
    got = {(r.id, r.begin, r.end): r.weight for r in A.token_weights(table, reports, 0.5, 2.0).collect()}
    at = 0
    for key in sorted((t for t in tokens if t[0] == "a" and t[1] is not None), key=lambda t: t[1]):
        while at < len(clauses) and clauses[at][1] <= key[1]:
            at += 1
        hit = at < len(clauses) and clauses[at][0] < key[2] and key[1] < key[2]
        assert got[key] == ((0.5 if clauses[at][2] else 2.0) if hit else 1.0), key
    assert got["b", 0, 4] == got["c", 0, 4] == got["a", None, 4] == 1.0


def test_permutation_of_any_size(spark):
    for n in (1, 2, 3, 7, 10, 97, 1000, 5003):
        places = [r[0] for r in spark.range(n).select(sampling.permuted(F.col("id"), n, 7)).collect()]
        assert sorted(places) == list(range(n))
        if n > 90:
            assert places != [r[0] for r in spark.range(n).select(sampling.permuted(F.col("id"), n, 8)).collect()]
            moved = np.corrcoef(np.arange(n), places)[0, 1]
            assert abs(moved) < 5 / n**0.5
    rows = spark.createDataFrame([(f"k{k}", k % 3) for k in range(200)], "key string, v int")
    one, two = (sorted((r.place, r.key) for r in sampling.shuffled(x, ["key"], 4).collect()) for x in (rows, rows.repartition(9)))
    assert one == two and [p for p, _ in one] == list(range(200))
    assert sampling.shuffled(rows.limit(0), ["key"], 4).count() == 0


def test_topology(spark):
    plans = [([8, 4, 4], [1.0, 1.0, 1.0]), ([80, 192, 192], [0.3, 0.3, 0.3]), ([16, 256, 256], [5.0, 0.7, 0.7]), ([20, 30, 12], [1.0, 1.5, 2.5]), ([7, 7, 7], [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(k, p, s) for k, (p, s) in enumerate(plans)], "k int, patch array<int>, spacing array<double>")
    for most in (2, 5):
        for r in table.select("k", "patch", P.topology(F.col("patch"), F.col("spacing"), 4, most).alias("t")).collect():
            strides, kernels = P.pooling(*plans[r.k], 4, most)
            assert (r.t.strides, r.t.kernels) == (strides, kernels)
            assert all(n % d == 0 and 0 <= n - m < d for n, m, d in zip(r.t.patch, r.patch, r.t.divisors)) and max(r.t.pools) <= most
    assert P.pooling([8, 4, 4], [1.0, 1.0, 1.0]) == ([[1, 1, 1]], [[3, 3, 3]])  # a single axis of less than 12 places stays
    assert P.pooling([12, 4, 4], [1.0, 1.0, 1.0])[0] == [[1, 1, 1], [2, 1, 1]]
