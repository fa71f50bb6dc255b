"""Balls, random components, windows end to end, published tables and merged logs against dense or sequential versions."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylake.functions import losses
from quarrylake.operators import morphology as M
from quarrylake.operators import windows as WI
from quarrylake.sources import tables as T
from quarrylake.streaming import log as LOG

PLACES = "case_id string, z int, y int, x int"


def ball(radius):
    r = int(radius)
    return [o for o in product(range(-r, r + 1), repeat=3) if sum(k * k for k in o) <= radius * radius]


def moved(mask, offsets, shape):
    out = set()
    for p in mask:
        for o in offsets:
            q = tuple(a + b for a, b in zip(p, o))
            if all(0 <= a < n for a, n in zip(q, shape)):
                out.add(q)
    return out


@pytest.mark.parametrize("radius", [1, 2.5, 4, 8])
def test_balls(spark, radius):
    rng = random.Random(int(radius * 10))
    shape = (6, 9, 11) if radius < 8 else (3, 6, 300)
    every = list(product(*map(range, shape)))
    mask = {p for p in every if rng.random() < (0.06 if radius < 8 else 0.002)}
    mask |= {p for p in every if p[2] >= shape[2] - 4}
    within = spark.createDataFrame([("a", *p) for p in every] + [("b", *p) for p in every], PLACES)
    m = spark.createDataFrame([("a", *p) for p in mask] * 2, PLACES)
    big = moved(mask, ball(radius), shape)
    small = mask - moved(set(every) - mask, ball(radius), shape)
    closed = big - moved(set(every) - big, ball(radius), shape)
    for name, want in (("dilation", big), ("erosion", small), ("opening", moved(small, ball(radius), shape)), ("closing", closed)):
        rows = M.OPERATORS[name](m, within, radius).collect()
        assert sorted((r.z, r.y, r.x) for r in rows) == sorted(want) and {r.case_id for r in rows} <= {"a"}, name
    d = {(r.z, r.y, r.x): r.d2 for r in M.squared_distance(m, within, radius).collect()}
    assert d == {p: min(sum((a - b) ** 2 for a, b in zip(p, q)) for q in mask) for p in big}


def test_random_operators_keep_one_hot(spark):
    shape, rng = (4, 6, 6), random.Random(2)
    every = list(product(*map(range, shape)))
    cells = {(c, k): {p for p in every if (p[2] < 3) == (k == 1) and rng.random() < 0.8} for c in "abcdefgh" for k in (1, 2)}
    table = spark.createDataFrame([(c, k, *p) for (c, k), ps in cells.items() for p in ps], "case_id string, c int, z int, y int, x int")
    within = spark.createDataFrame([(c, *p) for c in "abcdefgh" for p in every], PLACES)
    got = {}
    for r in M.operated(table, within, 1, 5, share=0.6, radii=(1, 3)).collect():
        got.setdefault((r.case_id, r.c), set()).add((r.z, r.y, r.x))
    changed = [c for c in "abcdefgh" if got.get((c, 1), set()) != cells[c, 1]]
    assert 0 < len(changed) < 8
    for c in "abcdefgh":
        one, two = got.get((c, 1), set()), got.get((c, 2), set())
        assert not one & two and two == cells[c, 2] - (one - cells[c, 1])
        forms = {n: (moved(cells[c, 1], ball(r), shape), cells[c, 1] - moved(set(every) - cells[c, 1], ball(r), shape), r) for n in ("d", "e") for r in (1, 2)}
        if c in changed:
            options = []
            for r in (1, 2):
                big, small = moved(cells[c, 1], ball(r), shape), cells[c, 1] - moved(set(every) - cells[c, 1], ball(r), shape)
                options += [big, small, big - moved(set(every) - big, ball(r), shape), moved(small, ball(r), shape)]
            assert one in options and forms


def test_random_components(spark):
    parts = [{(0, 0, k) for k in range(3)} | {(1, 1, 3)}, {(3, 3, 0), (3, 3, 1)}, {(3, 0, k) for k in range(5)} | {(2, 0, k) for k in range(6)}]
    rows = [(c, 1, *p) for c in "abcdefghij" for ps in parts for p in ps] + [(c, 2, 3, 3, 5) for c in "abcdefghij"]
    table = spark.createDataFrame(rows, "case_id string, c int, z int, y int, x int")
    sizes = spark.createDataFrame([(c, 4 * 4 * 6) for c in "abcdefghij"], "case_id string, places int")
    got = {c: {1: set(), 2: set()} for c in "abcdefghij"}
    for r in M.without_random_component(table, sizes, [1, 2], 3, share=0.7, other_share=0.5, most=0.1).collect():
        got[r.case_id][r.c].add((r.z, r.y, r.x))
    whole = set().union(*parts)
    kinds = set()
    for c, own in got.items():
        lost = whole - own[1] - {(3, 3, 5)}
        assert lost in (set(), parts[0], parts[1])  # the third part is too large
        moved_in = own[2] - {(3, 3, 5)}
        assert moved_in in (set(), lost)
        kinds.add((bool(lost), bool(moved_in)))
    assert (False, False) in kinds and any(k[0] for k in kinds)
    assert M.without_random_component(table.limit(0), sizes, [1, 2], 3).collect() == []


@pytest.mark.parametrize("gaussian", [True, False])
def test_sliding_windows_end_to_end(spark, gaussian):
    rng = np.random.default_rng(1)
    cases, patch = {"a": (5, 9, 7), "b": (3, 4, 11)}, (4, 4, 4)  # b is smaller than a patch along z
    volumes = {c: rng.normal(size=n) for c, n in cases.items()}
    rows = [(c, 0, *map(int, p), float(a[p])) for c, a in volumes.items() for p in np.ndindex(a.shape)]
    v = spark.createDataFrame(rows, "case_id string, c int, z int, y int, x int, v double")
    sizes = spark.createDataFrame([(c, *n) for c, n in cases.items()], "case_id string, z int, y int, x int")
    # a value that depends on the place in the window, as seen by the model
    first = lambda w: w.withColumn("v", F.col("v") * 2 + F.col("z") - 0.5 * F.col("x"))
    second = lambda w: w.withColumn("v", F.col("v") - 3.0 * F.col("y"))
    got = {}
    for r in WI.sliding_prediction(v, sizes, dict(zip("zyx", patch)), [first, second], 0.5, ("z", "x"), gaussian).collect():
        got.setdefault(r.case_id, {})[r.z, r.y, r.x] = r.v
    weight = np.ones(patch)
    if gaussian:
        for k, n in enumerate(patch):
            g = np.exp(-0.5 * ((np.arange(n) - n // 2) / (n * 0.125)) ** 2)
            weight = weight * g.reshape([-1 if a == k else 1 for a in range(3)])
    for c, a in volumes.items():
        pad = [(max(p - n, 0) // 2, max(p - n, 0) - max(p - n, 0) // 2) for n, p in zip(a.shape, patch)]
        full = np.pad(a, pad)
        total, weights = np.zeros(full.shape), np.zeros(full.shape)
        steps = []
        for n, p in zip(full.shape, patch):
            k = int(np.ceil((n - p) / (p * 0.5))) + 1
            steps.append([int(np.round((n - p) / (k - 1) * i)) for i in range(k)] if k > 1 else [0])
        for s in product(*steps):
            where = tuple(slice(b, b + p) for b, p in zip(s, patch))
            for flips in ((), (0,), (2,), (0, 2)):
                seen = np.flip(full[where], flips)
                z, y, x = np.indices(patch)
                for out in (seen * 2 + z - 0.5 * x, seen - 3.0 * y):
                    total[where] += np.flip(out, flips) * weight
                    weights[where] += weight
        want = (total / weights)[tuple(slice(b, b + n) for (b, _), n in zip(pad, a.shape))]
        assert len(got[c]) == a.size and max(abs(got[c][p] - want[p]) for p in np.ndindex(a.shape)) < 1e-9
    with pytest.raises(Exception, match="not finite"):
        WI.sliding_prediction(v, sizes, dict(zip("zyx", patch)), [lambda w: w.withColumn("v", F.lit(float("inf")))]).collect()


def test_a_failing_rename_leaves_the_table(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "table")
    T.replace_folder(spark.range(3), out)
    real = T._rename

    def failing(fs, source, target):
        if source.getName().endswith(".new"):
            raise OSError("no")
        real(fs, source, target)

    monkeypatch.setattr(T, "_rename", failing)
    with pytest.raises(OSError):
        T.replace_folder(spark.range(5), out)
    assert spark.read.parquet(out).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["table"]


def test_published_versions(spark, tmp_path):
    out = str(tmp_path / "t")
    assert T.published(spark, out) is None
    first = T.publish(spark.range(2), out)
    held = T.published(spark, out)
    second = T.publish(spark.range(4), out)
    assert (T.current_version(spark, out), T.published(spark, out).count(), held.count()) == (second, 4, 2) and first < second
    with pytest.raises(Exception):
        T.publish(spark.range(1).select(F.raise_error(F.lit("no"))), out)
    assert T.published(spark, out).count() == 4
    T.publish(spark.range(6), out)
    assert T.published(spark, out).count() == 6 and not (tmp_path / "t" / first).exists()


def test_a_log_with_late_and_replayed_entries(spark, tmp_path):
    schema = "run string, metric string, epoch int, value double, ts timestamp"
    entries = [("r", "dice", e, e / 10 + k, f"2024-01-01 00:{e:02d}:{k:02d}") for e in range(6) for k in range(2)] + [("s", "dice", 0, 1.0, "2024-01-01 00:00:00"), ("s", "dice", 3, 1.0, "2024-01-01 00:00:00")]
    src = tmp_path / "in"
    batches = [entries[5:9], entries[:7], entries[7:], entries[2:4]]  # out of order, and again
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "run string, metric string, epoch int, value double, ts string").select("run", "metric", "epoch", "value", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(str(src))
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(LOG.merged(spark, str(tmp_path / "log"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None
    log = T.published(spark, str(tmp_path / "log"))
    got = {(r.run, r.epoch): r.value for r in log.collect()}
    assert got == {("r", e): e / 10 + 1 for e in range(6)} | {("s", 0): 1.0, ("s", 3): 1.0}
    LOG.merged(spark, str(tmp_path / "log"))(spark.createDataFrame([tuple(r) for r in log.collect()], schema), 9)
    assert {(r.run, r.epoch): r.value for r in T.published(spark, str(tmp_path / "log")).collect()} == got
    assert [tuple(r) for r in LOG.missing_epochs(log).collect()] == [("s", "dice", 1)]
    ema, at = [], None
    for e in range(6):
        at = got["r", e] if at is None else 0.9 * at + 0.1 * got["r", e]
        ema.append(at)
    assert [r.ema for r in LOG.smoothed(log, "dice").where("run = 'r'").orderBy("epoch").collect()] == pytest.approx(ema)


def test_sample_weights(spark):
    rng = np.random.default_rng(5)
    logits, labels, weights = rng.normal(size=(4, 3, 5)), np.array([[0, 1, -100], [-100] * 3, [2, 3, 4], [1, 1, 1]]), rng.random((4, 3))
    weights[3] = 0
    tokens = [(s, [float(x) for x in logits[s, t]], int(labels[s, t]), float(weights[s, t])) for s in range(4) for t in range(3)]
    samples = spark.createDataFrame([(s, float(s + 1)) for s in range(4)], "sample int, sample_weight double")
    ce = [[np.log(np.exp(logits[s, t]).sum()) - logits[s, t, labels[s, t]] if labels[s, t] >= 0 else None for t in range(3)] for s in range(4)]
    own = {s: sum(c * w for c, w in zip(ce[s], weights[s]) if c is not None) / sum(w for c, w in zip(ce[s], weights[s]) if c is not None) for s in (0, 2)}
    flat = [c for s in range(4) for c in ce[s] if c is not None]
    r = losses.sample_weighted_loss(spark.createDataFrame(tokens, "sample int, logits array<double>, label int, weight double"), samples).first()
    assert r.weighted == pytest.approx((own[0] + 3 * own[2]) / 2) and r.unweighted == pytest.approx(sum(flat) / len(flat))
    none = spark.createDataFrame([], "sample int, logits array<double>, label int, weight double")
    assert tuple(losses.sample_weighted_loss(none, samples).first()) == (0.0, 0.0)
