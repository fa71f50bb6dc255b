"""Operators 11 to 13 against brute-force versions, on tables with nulls, ties, repeats, hot keys and odd columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.llm import prefix_trie, projected_search, turn_repair

VECTORS = "vec_id long, embedding array<float>, label int, h long, v string, ids long, cell int, query_id long"
TURNS = "conv_id long, turn long, role string, text string, depth int, cid string, a long, place string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4, 5) for i, v in rows], VECTORS)


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], TURNS)


def nearest(rows, query, k):
    """The k nearest (vec_id, score) by comparing all rows; rows: {vec_id: vector}."""
    found = []
    for i, x in rows.items():
        if i != query:
            size = max(len(x), len(rows[query]))
            a, b = (np.pad(np.array(y, np.float32).astype(float), (0, size - len(y))) for y in (x, rows[query]))
            found.append((float(np.sqrt(((a - b) ** 2).sum())), i))
    return [(i, d) for d, i in sorted(found)[:k]]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 24))
    rows = {k: [float(x) for x in (centres[k % 12] + 0.2 * rng.standard_normal(24)).astype(np.float32)] for k in range(700)}
    rows |= {1000 + k: rows[5] for k in range(900)}  # a hot vector, whose copies tie
    rows |= {3000: rows[7][:11], 3001: [3.0], 3002: [3.0, 0.0]}
    odd = [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [1.0, None]), (5005, [float("inf"), 1.0]), (None, rows[1]), (5, rows[5])]
    table = vectors(spark, [*rows.items(), *odd])
    queries = [0, 5, 100, 300, 1000, 1500, 3000, 3001]
    got = projected_search.search(table, table.where(F.col("vec_id").isin(queries)), capacity=60).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(by) == set(queries)
    hits = 0
    for q in queries:
        want, own = nearest(rows, q, 10), sorted(by[q])
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, i) for _, i, s in own] == sorted((s, i) for _, i, s in own)
        hits += len({i for i, _ in want} & {i for _, i, _ in own})
    assert hits >= 0.97 * 10 * len(queries)
    assert [i for _, i, _ in sorted(by[5])] == list(range(1000, 1010)) and {s for _, _, s in by[5]} == {0.0}
    assert [i for _, i, _ in sorted(by[1500])] == [5, *range(1000, 1009)]
    assert sorted(by[3001])[0][1:] == (3002, 0.0)
    small = vectors(spark, list(rows.items())[:4])
    assert projected_search.search(small, small.where("vec_id = 0")).count() == 3
    empty = vectors(spark, odd[:6])
    assert projected_search.search(empty, empty).collect() == []


def test_recall_on_given_vectors(spark):
    """Recall of the registered query against brute force over the whole table."""
    folder = "/root/testdata/sf0.1"
    x = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in x]), np.array([r.embedding for r in x], float)
    found, want = set(), set()
    for r in projected_search.op11_nearest(spark, folder).collect():
        found.add((r.query_id, r.vec_id))
        assert r.score == np.sqrt(((m[ids == r.vec_id][0] - m[ids == r.query_id][0]) ** 2).sum())
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want |= {(q, i) for i in ids[np.lexsort((ids, d))[:10]]}
    assert len(found & want) >= 0.97 * len(want)


def test_chi_square():
    x = np.random.default_rng(1).chisquare(12, 200_000)
    for p in (0.5, 0.9, 0.99):
        assert abs((x <= projected_search.chi_square_quantile(p, 12)).mean() - p) < 0.005


def trie(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()[:16], r, x))
    own = {c: [v[2:] for v in sorted(x)] for c, x in by.items()}
    whole, nodes, below = {}, {}, {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(tuple(whole[c][:d]), []).append(c)
    for n in nodes:
        if n:
            below.setdefault(n[:-1], []).append(n)
    out = {}
    for n in sorted(nodes, key=len, reverse=True):
        m, children = nodes[n], below.get(n, [])
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n))
        out[n] = (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), len(children), sum(out[c][5] for c in children) if children else 1, sum(out[c][6] for c in children) + (len(m) - 1) * words, hashlib.sha256(ends.encode()).hexdigest())
    return out.values()


def dialogues():
    rng = random.Random(5)
    rows = []
    for c in range(120):
        start = [("system", "one two"), ("user", "hello there")] if c % 3 else [("user", None)]
        said = start + [(rng.choice(["user", "assistant", None]), f"w{rng.randrange(3)} x") for _ in range(rng.randrange(4))]
        rows += [(c, k if k else None, r, x) for k, (r, x) in enumerate(said)]
    for c in range(200, 230):  # copies, and beginnings of a longer one
        rows += [(c, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(30 if c % 2 else c - 195)]
    rows += [(c, k, "user", f"long {k}") for c in (240, 257) for k in range(300 + c)]
    rows += [(c, 0, "user", "alone") for c in (303, 307, 311, 315, -7, -20, -27)]  # without the conversation they begin like
    return rows + [(40, 1, "tie", "b"), (40, 1, "tie", "a"), (40, 1, "tie", "a"), (None, 0, "user", "nobody"), (41, 3, "", " \t ")]


@pytest.mark.parametrize("limit", [50_000, 6])
def test_prefix_trie(spark, limit):
    rows = dialogues()
    got = sorted(map(str, (tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows), limit).collect())))
    assert got == sorted(map(str, trie(rows)))


def test_prefix_trie_of_little(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).collect() == []
    bare = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(bare, 0, "user", "x")]
    assert [tuple(r) for r in prefix_trie.prefix_trie(conversations(spark, rows)).collect()] == list(trie(rows))
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "user", "x")])).collect() == []


NEXT = {"e": "u", "s": "u", "u": "a", "a": "u"}


def hit(c, t):
    return zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20


def cheapest(rows):
    """(cost, audit, repaired) over all sequences of edits, with three insertions at a place at most; rows: (role, text, dead, cut)."""
    def inserted(now):
        for _ in range(3):
            for state, (cost, audit, said) in list(now.items()):
                n = NEXT[state]
                new = (cost + 5, audit + "I", said + (f"{'user' if n == 'u' else 'assistant'}:",))
                now[n] = min(now.get(n, new), new)
        return now

    now = inserted({"e": (0, "", ())})
    for role, text, dead, cut in rows:
        new = {}
        for state, (cost, audit, said) in now.items():
            n, price = NEXT[state], 5 if cut else 0
            ways = [(state, (cost + 2, audit + "D", said))]
            if not dead:
                ways.append((n, (cost + 1 + price, audit + "R", said + (f"{'user' if n == 'u' else 'assistant'}:{text}",))))
                if role[:1] == n or state == "e" and role[:1] == "s":
                    ways.append((role[:1], (cost + price, audit + "K", said + (f"{role}:{text}",))))
            for at, way in ways:
                new[at] = min(new.get(at, way), way)
        now = inserted(new)
    return min(now[s] for s in "ea" if s in now)


def repairs(rows):
    by = {}
    for c, t, r, x in rows:
        own, r, x = by.setdefault(c, []), " " if r is None else r, " " if x is None else x
        key, h = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), hit(c, t)
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        own += [((t is not None, t or 0), key, k, "user" if h == 4 else r, x, t) for k in range(0 if h == 0 else 2 if h == 3 else 1)]
    for c, own in by.items():
        own.sort(key=lambda v: v[:3])
        seen, faults, counts = set(), [], [0, 0, 0]
        for *_, r, x, _ in own:
            bare = x.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (r, x) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                counts[fault] += 1
            faults.append((r, x, fault in (0, 1), fault == 2))
        turns = [v[5] for v in own if v[5] is not None]
        illegal = sum(p[0][:1] + q[0][:1] not in ("su", "ua", "au") for p, q in zip(faults, faults[1:]))
        cost, audit, said = cheapest(faults)
        yield c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


@pytest.mark.parametrize("stretch", [256, 4])
def test_turn_repair(spark, stretch):
    rng = random.Random(9)
    say = ["Yes.", "No", "Why?", "", None, " \t", "One. Two.", "é\n!", "So"]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "system", "tool", "", None, "user"]), rng.choice(say)) for c in range(150) for t in range(rng.randrange(1, 9))]
    rows += [(900, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(700)]  # longer than a stretch
    rows += [(c, t, ("user", "assistant")[t % 2], f"Turn {t}.") for c in range(1000, 1040) for t in range(2)]
    rows += [(None, 1, "user", "Who?"), (None, 2, "assistant", "Nobody."), rows[3], rows[3]]
    rows += [next((c, 0, "user", "Gone.") for c in range(2000, 3000) if hit(c, 0) == 0)]
    got = sorted(map(str, (tuple(r) for r in turn_repair.repair(conversations(spark, rows), stretch).collect())))
    assert got == sorted(map(str, repairs(rows)))


def test_turn_repair_of_nothing(spark):
    assert turn_repair.repair(conversations(spark, [])).collect() == []
