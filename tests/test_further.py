"""Operators that SQL does not express well, against brute force, and readers and writers on files."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from quarrylake import cli
from quarrylake.functions import assertions as A
from quarrylake.functions import lexicon as L
from quarrylake.functions import losses
from quarrylake.operators import augmentation as G
from quarrylake.operators import catalog as K
from quarrylake.operators import ordering, sampling, split
from quarrylake.operators import planning as P
from quarrylake.operators import records as R
from quarrylake.operators import segmentation as S
from quarrylake.operators import voxels as V
from quarrylake.sources import files
from quarrylake.sources import tables as T

BOX = "case_id string, z int, y int, x int"


def places(df):
    return {(r.case_id, r.z, r.y, r.x) for r in df.collect()}


def scopes_by_hand(clause):
    """The parts that concepts govern, found one anchor after the other."""
    found = []
    for k, (concept, p) in enumerate([*L.CONCEPTS.items(), (None, L.PRESENCE)]):
        found += [(m.start(), m.end(), k, concept) for m in re.finditer(p, clause, re.I)]
    concepts = [f for f in found if f[3]]
    kept = []
    for f in sorted(found):
        if f[3] is None and any(f[0] < c[1] and c[0] < f[1] for c in concepts):
            continue
        if kept and f[3] and kept[-1][3] == f[3] and f[0] - kept[-1][1] <= 2:
            continue
        kept.append(f)
    cuts = [(a[0] + a[1] + b[0] + b[1]) // 4 for a, b in zip(kept, kept[1:])]
    return sorted((f[3], clause[lo:hi]) for f, lo, hi in zip(kept, [0, *cuts], [*cuts, len(clause)]) if f[3])


def test_scopes_against_brute_force(spark):
    rng = random.Random(1)
    words = "missing absent impacted carious caries implant lesion present noted sinus maxillary crown TMJ canal root no the left 1.1 é".split()
    clauses = ["".join(rng.choice(words) + rng.choice([" ", "", ", ", "-"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    d = spark.createDataFrame([(str(k), c) for k, c in enumerate(clauses)], "id string, clause string")
    got = {}
    for r in A.scopes(d).collect():
        got.setdefault(int(r.id), []).append((r.concept, r.scope))
    assert {k: sorted(v) for k, v in got.items()} == {k: s for k, c in enumerate(clauses) if (s := scopes_by_hand(c))}


def test_assertions_feed_labels_targets_and_weights(spark):
    text = "Tooth 48 is impacted. The sinus is not included in the scan volume. Teeth 31 to 32 are missing."
    a = A.extract_assertions(spark.createDataFrame([("a", text)], "id string, text string"))
    assert {r.label for r in A.labels(a).collect()} == {"finding:impacted", "finding:missing", "tooth_group:lower_right_molar", "tooth_group:lower_left_anterior"}
    assert {r.label for r in A.labels(a, by_group=False).collect()} >= {"tooth:48", "tooth:31", "tooth:32"}
    tooth, case = A.structured_targets(a)
    assert {(r.tooth_number, r.concept) for r in tooth.collect()} == {("48", "impacted"), ("31", "missing"), ("32", "missing")} and not {r.concept for r in case.collect()} & {"sinus"}
    spans = [("a", 0, 5), ("a", 22, 30), ("a", 3, 3), ("a", 500, 501)]
    w = A.token_weights(spark.createDataFrame(spans, "id string, begin int, end int"), spark.createDataFrame([("a", text)], "id string, text string"), 0.5, 2.0)
    assert {(r.begin, r.weight) for r in w.collect()} == {(0, 2.0), (22, 0.5), (3, 1.0), (500, 1.0)}


def test_split_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(f"c{k:03}", f"g{rng.randrange(40)}", [f"l{rng.randrange(5)}" for _ in range(rng.randrange(3))]) for k in range(120)]
    groups = {}
    for c, g, ls in rows:
        groups.setdefault(g, []).append(set(ls))
    order = sorted(groups, key=lambda g: min(c for c, h, _ in rows if h == g))
    draws = random.Random(7)
    tie = {g: draws.random() for g in order}
    n = {g: {x: sum(x in s for s in members) for x in {y for s in members for y in s}} for g, members in groups.items()}
    want = {x: 0.25 * sum(c.get(x, 0) for c in n.values()) for c in n.values() for x in c}
    room, got, chosen = round(0.25 * len(rows)), dict.fromkeys(want, 0), set()
    while room > 0:
        rest = [g for g in order if g not in chosen]

        def rank(g):
            size = len(groups[g])
            gain = sum(min(c, max(want[x] - got[x], 0)) / max(want[x], 1) for x, c in n[g].items())
            return round(gain / size - max(size - room, 0) / round(0.25 * len(rows)), 12), -abs(room - size), tie[g]

        g = max(rest, key=rank)
        if chosen and len(groups[g]) - room > room:
            break
        chosen.add(g)
        room -= len(groups[g])
        for x, c in n[g].items():
            got[x] += c
    assert split.multilabel_split(spark.createDataFrame(rows, "case_id string, duplicate_group string, labels array<string>"), 0.25, 7) == chosen
    assert split.multilabel_split(spark.createDataFrame([], "case_id string, duplicate_group string, labels array<string>"), 0.25, 7) == set()


def test_orders_by_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.random() if k % 7 else None, k % 5 > 0) for k in range(500)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k long, v double, ok boolean").repartition(7)
    assert [r.idx for r in ordering.ordered_index(d, ["k"]).orderBy("k").collect()] == list(range(500))
    best, expected = None, {}
    for k, v, ok in sorted(rows):
        expected[k] = bool(ok and v is not None and (best is None or v > best))
        best = v if ok and v is not None and (best is None or v > best) else best
    assert {r.k: r.saved for r in sampling.best_so_far(d, "k", "v", "ok").collect()} == expected
    series = [(s, k, rng.gauss(0, 1)) for s in "ab" for k in range(900)]
    ema = sampling.moving_average(spark.createDataFrame(series, "s string, k long, v double"), "s", "k", "v", 0.5).collect()
    at, want = {}, {}
    for s, k, v in series:
        at[s] = want[s, k] = 0.5 * at[s] + 0.5 * v if s in at else v
    assert {(r.s, r.k): r.ema for r in ema} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}
    empty = d.limit(0)
    assert ordering.ordered_index(empty, ["k"]).count() == 0 and sampling.best_so_far(empty, "k", "v", "ok").count() == 0


def test_patch_policy():
    assert P.patch_size(None, [8, 16], [2, 2]) == [8, 16] and P.patch_size("4x32", [8, 16], [2, 2]) == [4, 16]
    for wrong in ("4", "4x0", "4xa", "3x16"):
        with pytest.raises(ValueError):
            P.patch_size(wrong, [8, 16], [2, 2])
    strides, kernels = P.pooling([16, 64, 64], [3.0, 1.0, 1.0])
    assert strides[0] == [1, 1, 1] and strides[1] == [1, 2, 2] and kernels[0] == [1, 3, 3] and len(kernels) == len(strides)
    assert losses.supervision_weights(3) == [2 / 3, 1 / 3, 0.0] and losses.supervision_weights(1) == [1.0]


def test_components_holes_and_morphology(spark):
    rng = random.Random(4)
    size = 7
    grid = [("a", z, y, x) for z in range(size) for y in range(size) for x in range(size)]
    mask = [p for p in grid if rng.random() < 0.55]
    within, m = (spark.createDataFrame(v, BOX) for v in (grid, mask))

    def parts(cells):
        cells, out = set(cells), []
        while cells:
            stack = [cells.pop()]
            own = set(stack)
            while stack:
                c, z, y, x = stack.pop()
                for n in ((c, z + 1, y, x), (c, z - 1, y, x), (c, z, y + 1, x), (c, z, y - 1, x), (c, z, y, x + 1), (c, z, y, x - 1)):
                    if n in cells:
                        cells.remove(n)
                        own.add(n)
                        stack.append(n)
            out.append(own)
        return out

    got = {}
    for r in G.components(m).collect():
        got.setdefault(r.component, set()).add((r.case_id, r.z, r.y, r.x))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts(mask)))
    holes = {p for own in parts(set(grid) - set(mask)) if all(0 < v < size - 1 for q in own for v in q[1:]) for p in own}
    assert places(G.filled(m, within)) == set(mask) | holes
    labels = within.withColumn("label", F.lit(1))
    gone = {p for own in parts(mask) if len(own) > 5 for p in own}
    assert {(r.case_id, r.z, r.y, r.x) for r in G.without_large_components(labels, m, 5).where("label = 0").collect()} == gone
    assert places(G.opened(m, within)) <= set(mask) <= places(G.closed(m, within))
    sparse = G.sparsified(labels, 0.3, 9, 1)
    kept = places(sparse.where("label = 1"))
    axes = [{p[k] for p in grid if all(q in kept for q in grid if q[k] == p[k])} for k in (1, 2, 3)]
    assert all(len(a) == 2 for a in axes) and kept == {p for p in grid if any(p[k + 1] in axes[k] for k in range(3))}


def test_locations_and_mirrors(spark):
    loc = spark.createDataFrame([("a", 1, 0, 0, k) for k in range(9)] + [("a", 2, 5, 5, 5)], "case_id string, label int, z int, y int, x int")
    r = P.pick_location(loc, 3).collect()
    assert len(r) == 1 and r == P.pick_location(loc.repartition(3), 3).collect()
    p = spark.createDataFrame([("a", "", 0, 0, 0, 0, float("inf"))], "case_id string, flip string, c int, z int, y int, x int, v double")
    with pytest.raises(Exception, match="not finite"):
        P.mirrored_mean(p, {"x": 2}, ["x"]).collect()
    v = spark.createDataFrame([("a", 1, 2, 3)], BOX)
    assert places(P.transpose(v, [2, 0, 1])) == {("a", 3, 1, 2)}


def test_problems_raise_when_read(spark):
    two = spark.createDataFrame([("a", "x.mha"), ("a", "y.mha")], "case_id string, path string")
    with pytest.raises(Exception, match="not one input"):
        T.only_file(two, ".mha").collect()
    with pytest.raises(Exception, match="wrong channels"):
        T.checked_features(spark.createDataFrame([("a", [1, 2, 3, 4])], "case_id string, shape array<int>"), 2).collect()
    with pytest.raises(Exception, match="duplicate case"):
        files.resolve_inputs(spark.createDataFrame([("p/a.nii.gz",), ("q/a.nii.gz",)], "path string")).collect()


def test_writers(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.7)], "epoch int, metric string, value double")
    T.write_epoch(d, d, str(tmp_path / "run"))
    T.write_epoch(d.where("epoch = 2").withColumn("value", F.lit(0.9)), d.limit(0), str(tmp_path / "run"))
    assert {(r.epoch, r.value) for r in spark.read.json(str(tmp_path / "run/metrics")).collect()} == {(1, 0.5), (2, 0.9)}
    T.write_metrics_csv(d.withColumnRenamed("epoch", "step"), str(tmp_path / "log"))
    assert set(spark.read.option("header", True).csv(str(tmp_path / "log")).columns) == {"step", "a", "b"}
    out = str(tmp_path / "table")
    assert T.replace_folder(d, out) and not T.replace_folder(d.limit(1), out, overwrite=False) and spark.read.parquet(out).count() == 2
    assert T.replace_folder(d.limit(1), out) and spark.read.parquet(out).count() == 1 and len(list(tmp_path.glob("table*"))) == 1
    with pytest.raises(Exception):
        T.replace_folder(d.select(F.raise_error(F.lit("no"))), out)
    assert spark.read.parquet(out).count() == 1 and len(list(tmp_path.glob("table*"))) == 1
    assert R.read_summary and T.format_of(F.lit("x")) is not None


def test_commands(spark, tmp_path, capsys):
    for k, text in enumerate(["Tooth 48 is impacted.", "Tooth 48 is impacted!", "Teeth 31 to 33 are missing.", "A lesion of the left mandible.", "Implant on 4.6."]):
        folder = tmp_path / "data/cases" / f"c{k}" / "reports_en"
        folder.mkdir(parents=True)
        (folder / "r.txt").write_text(f" {text}\n")
        (tmp_path / "features").mkdir(exist_ok=True)
        (tmp_path / "features" / f"c{k}.pt").write_text("x")
        image = tmp_path / "images" / f"c{k}" / "cbct"
        image.mkdir(parents=True)
        (image / "volume.nii.gz").write_text("x")
    args = ["manifest", "--data-root", str(tmp_path / "data"), "--feature-root", str(tmp_path / "features"), "--output-dir", str(tmp_path / "out"), "--valid-fraction", "0.4"]
    assert cli.main(args) == 0
    rows = [json.loads(x) for part in ("train", "valid") for f in (tmp_path / "out" / f"{part}.jsonl").glob("part-*") for x in f.read_text().splitlines()]
    assert {r["case_id"] for r in rows} == {f"c{k}" for k in range(5)} and len({r["duplicate_group"] for r in rows if r["case_id"] in ("c0", "c1")}) == 1
    (tmp_path / "features/c3.pt").unlink()
    with pytest.raises(ValueError, match="no feature file"):
        cli.main(args)
    capsys.readouterr()
    assert cli.main(["shard", "--input", str(tmp_path / "images"), "--num-shards", "2", "--shard-index", "1"]) == 0
    assert [x.split("\t")[0] for x in capsys.readouterr().out.splitlines()] == ["c1", "c3"]
    v = spark.createDataFrame([("a", 0, 0, k, k % 2) for k in range(6)], f"{BOX}, label int")
    v.write.parquet(str(tmp_path / "ref"))
    assert cli.main(["evaluate", "--reference", str(tmp_path / "ref"), "--predicted", str(tmp_path / "ref"), "--output", str(tmp_path / "summary"), "--labels", "1"]) == 0
    assert spark.read.json(str(tmp_path / "summary")).first().dice == 1.0


def grid(sizes, value):
    z, y, x = sizes
    return [("a", 0, i, j, k, float(value(i, j, k))) for i in range(z) for j in range(y) for k in range(x)]


VOLUME = "case_id string, c int, z int, y int, x int, v double"


def test_crop_and_back(spark):
    # a hollow box of non-zero values: its inside counts as inside
    def shell(i, j, k):
        return float(2 <= i <= 6 and 2 <= j <= 6 and 1 <= k <= 5 and (i in (2, 6) or j in (2, 6) or k in (1, 5)))

    volume = spark.createDataFrame(grid((9, 9, 9), shell), VOLUME)
    labels = volume.select("case_id", "z", "y", "x", F.when(F.col("z") == 4, 3).otherwise(0).alias("label"))
    v, s = V.crop_to_nonzero(volume, labels)
    assert v.agg(F.max("z"), F.max("y"), F.max("x"), F.count("*")).first() == (4, 4, 4, 125)
    assert {r.label for r in s.collect()} == {0, 3}  # all of the crop is in the filled box
    corner = spark.createDataFrame(grid((5, 5, 5), lambda i, j, k: float(i + j + k <= 4)), VOLUME)
    _, s = V.crop_to_nonzero(corner, corner.select("case_id", "z", "y", "x", F.lit(0).alias("label")))
    assert {(r.z + r.y + r.x <= 4): r.label for r in s.collect()} == {True: 0, False: -1}
    boxes = V.nonzero_box(volume)
    p = v.withColumn("v", F.lit(0.25)).unionByName(v.withColumns({"c": F.lit(1), "v": F.lit(0.75)}))
    whole = V.uncropped_probabilities(p, boxes, {"z": 9, "y": 9, "x": 9})
    got = {(r.c, r.inside): (r.n, r.v) for r in whole.groupBy("c", ((F.col("z").between(2, 6)) & F.col("y").between(2, 6) & F.col("x").between(1, 5)).alias("inside")).agg(F.count("*").alias("n"), F.avg("v").alias("v")).collect()}
    assert got == {(0, True): (125, 0.25), (1, True): (125, 0.75), (0, False): (604, 1.0), (1, False): (604, 0.0)}


def test_resampling_against_brute_force(spark):
    rng = random.Random(6)
    source, target = (4, 5, 3), (7, 3, 6)
    values = {(i, j, k): rng.random() for i in range(4) for j in range(5) for k in range(3)}
    v = spark.createDataFrame(grid(source, lambda *p: values[p]), VOLUME)
    named = [dict(zip("zyx", s)) for s in (source, target)]

    def ends(t, n, m):
        at = min(max((t + 0.5) * n / m - 0.5, 0), n - 1)
        return [(int(at), 1 - (at - int(at))), (min(int(at) + 1, n - 1), at - int(at))]

    got = {(r.z, r.y, r.x): r.v for r in V.resampled(v, *named, linear=True).collect()}
    expected = {}
    for t in ((i, j, k) for i in range(7) for j in range(3) for k in range(6)):
        parts = [ends(a, n, m) for a, n, m in zip(t, source, target)]
        expected[t] = sum(values[p[0], q[0], r[0]] * p[1] * q[1] * r[1] for p in parts[0] for q in parts[1] for r in parts[2])
    assert got == {t: pytest.approx(x) for t, x in expected.items()}
    near = {(r.z, r.y, r.x): r.v for r in V.resampled(v, *named).collect()}
    assert near == {t: values[tuple(min(int((a + 0.5) * n / m), n - 1) for a, n, m in zip(t, source, target))] for t in expected}
    labels = v.select("case_id", "z", "y", "x", F.lit(2).alias("label"))
    image, seg = V.preprocessed(v, labels, [1, 0, 2], {"z": 5, "y": 4, "x": 6})
    assert image.count() == seg.count() == 120 and {r.label for r in seg.collect()} == {2}


def test_more_problems_raise(spark):
    one = spark.createDataFrame([("a",)], "file string")
    with pytest.raises(Exception, match="no reference for a"):
        S.paired_files(one.limit(0), one, strict=False).collect()
    with pytest.raises(Exception, match="no prediction for a"):
        S.paired_files(one, one.limit(0)).collect()
    f = spark.createDataFrame([(1, 0.5)], "case_id int, dice double")
    with pytest.raises(Exception, match="several folds predict 1"):
        S.accumulated_folds([f, f]).collect()
    with pytest.raises(Exception, match="not an RGB"):
        spark.range(1).select(V.rgb_normalize(F.lit(300.0))).collect()
    names = spark.createDataFrame([("Dataset007_a",), ("Dataset007_b",), ("Dataset008_c",)], "name string")
    assert K.the_dataset(names, 8) == "Dataset008_c"
    for number in (7, 9):
        with pytest.raises(ValueError):
            K.the_dataset(names, number)
    with pytest.raises(ValueError):
        sampling.schedule("other", F.lit(1), 1.0, 10)
    with pytest.raises(ValueError):
        sampling.warmup_steps(10, steps=11)
    assert (sampling.warmup_steps(200, ratio=0.1), sampling.warmup_steps(200, percent=5.0), sampling.warmup_steps(200)) == (20, 10, 0)
    with pytest.raises(ValueError):
        K.resolve_configuration({"a": {"inherits_from": "a"}}, "a")
    with pytest.raises(KeyError):
        K.resolve_configuration({}, "a")


def test_vendor_halves(spark):
    p = spark.createDataFrame([(v, f"{v}{k}") for v in "AB" for k in range(40)], "vendor string, patient string")
    s = split.vendor_split(p, 25, 1)
    n = {(r.vendor, r.split, r.half): r["count"] for r in s.groupBy("vendor", "split", "half").count().collect()}
    assert n[("A", "valid", None)] == 25 and n[("A", "train", 0)] + n[("A", "train", 1)] == 15
    sets = {}
    for r in split.mixed_halves(s).collect():
        sets.setdefault(r.train_set, set()).add(r.patient)
    assert set(sets) == {"A", "B", "mix0", "mix1"} and not sets["mix0"] & sets["mix1"] and sets["mix0"] | sets["mix1"] == sets["A"] | sets["B"]
