import math

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import losses, similarity
from quarrylake.operators import clinical as C
from quarrylake.operators import segmentation as S
from quarrylake.operators import voxels as V


def test_bleu_and_meteor(spark):
    p = spark.createDataFrame([("a", "a b c d", ["a b c d"])], "case_id string, prediction string, references array<string>")
    assert similarity.corpus_bleu(p).first().bleu4 == pytest.approx(1.0)
    assert similarity.meteor(p).first().meteor > 0.99
    assert similarity.corpus_bleu(p.limit(0)).first().bleu4 == 0.0


def test_stemmer():
    assert [similarity.porter_stem(w) for w in ("caresses", "ponies", "hopping", "relational", "happy", "controlling", "rate")] == ["caress", "poni", "hop", "relat", "happi", "control", "rate"]


def test_gates_and_scores(spark):
    m = spark.createDataFrame([(0.2, 0.0, 0.0, 0.3), (0.8, 0.0, 0.1, 0.3)], "unsupported_finding_rate double, truncated_generation_rate double, invalid_fdi_case_rate double, tooth_precision_micro double")
    got = C.hard_gates(m).orderBy("unsupported_finding_rate").collect()
    assert [r.eligible for r in got] == [True, False] and len(got[1].failures) == 2


def test_generation_quality(spark):
    p = spark.createDataFrame([("a", "Presence of a prosthetic crown on tooth 35. Presence of a prosthetic crown on tooth 35. Tooth 3.9 is missing", ["Presence of a prosthetic crown on tooth 35."])], "case_id string, prediction string, references array<string>")
    r = C.generation_quality(p).first()
    assert (r.truncated_generation_rate, r.invalid_fdi_case_rate, r.repetition_case_rate, r.invalid_fdi_count) == (1.0, 1.0, 1.0, 1.0)


def test_confusion_of_absent_region_is_null(spark):
    v = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1)], "case_id string, ref int, pred int")
    g = spark.createDataFrame([(1, [1]), (2, [2])], "region int, labels array<int>")
    got = {r.region: r.dice for r in S.confusion(v, g).collect()}
    assert got[1] == pytest.approx(0.5) and got[2] is None
    assert S.foreground_mean(S.confusion(v, g)).first().dice is None


def test_region_geometry(spark):
    rows = [("a", z, y, x, 11 if 1 <= min(z, y, x) and max(z, y, x) < 3 else 0) for z in range(4) for y in range(4) for x in range(4)]
    r = V.region_geometry(spark.createDataFrame(rows, "case_id string, z int, y int, x int, label int")).first()
    assert (r.voxel_count, list(r.centroid), list(r.bbox)) == (8, [1.5, 1.5, 1.5], [1, 1, 1, 3, 3, 3])


def test_global_pool(spark):
    rows = [("a", k // 8, k // 4 % 2, k // 2 % 2, k % 2, float(k)) for k in range(16)]
    got = {r.c: (r.mean, r.max) for r in V.global_pool(spark.createDataFrame(rows, "case_id string, c int, z int, y int, x int, v double")).collect()}
    assert got == {0: (3.5, 7.0), 1: (11.5, 15.0)}


def test_weighted_loss(spark):
    t = spark.createDataFrame([(0, [2.0, 0.0], -100, 0.0), (0, [0.0, 2.0], 0, 1.0), (0, [1.0, 1.0], 1, 2.0)], "sample int, logits array<double>, label int, weight double")
    l0, l1 = math.log(1 + math.exp(2)), math.log(2)
    assert losses.weighted_causal_loss(t).first().loss == pytest.approx((l0 + 2 * l1) / 3)


def test_hinge(spark):
    r = spark.range(1).select(losses.grounding_hinge(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)), 0.1).alias("a"),
                              losses.grounding_hinge(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)), 0.1).alias("b")).first()
    assert r.a == 0 and r.b > 0


def test_largest_component(spark):
    rows = [("a", 0, 0, 0), ("a", 0, 0, 1), ("a", 0, 1, 1), ("a", 5, 5, 5), ("b", 1, 1, 1)]
    got = S.largest_component(spark.createDataFrame(rows, "case_id string, z int, y int, x int")).collect()
    assert sorted((r.case_id, r.z, r.y, r.x) for r in got) == [("a", 0, 0, 0), ("a", 0, 0, 1), ("a", 0, 1, 1), ("b", 1, 1, 1)]


def test_largest_component_query_takes_all_foreground(spark, tmp_path):
    import random

    from quarrylake.plans.evaluation_queries import Q

    rng = random.Random(3)
    rows = [(k, rng.randrange(3), rng.randrange(4), line, 1.0) for k in range(2500, 4500) for line in range(1, 4) if rng.random() < 0.8]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    cases = {}
    for k, _, s, z, _ in rows:
        if z % 4:
            cases.setdefault(f"S{s % 20}", set()).add((z, k % 64, k // 64))
    expected = {}
    for case, left in cases.items():
        while left:
            todo, n = [left.pop()], 0
            while todo:
                z, y, x = todo.pop()
                n += 1
                near = {(z + 1, y, x), (z - 1, y, x), (z, y + 1, x), (z, y - 1, x), (z, y, x + 1), (z, y, x - 1)} & left
                left -= near
                todo += near
            expected[case] = max(n, expected.get(case, 0))
    assert {r.case_id: r.n for r in Q["a43_largest_component"][0](spark, str(tmp_path)).collect()} == expected


def test_moving_average_query_takes_all_events(spark, tmp_path):
    from quarrylake.plans.report_queries import Q

    rows = [(k, (k * 7) % 5, float(k % 13), "view") for k in range(1000)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    last, expected = {}, {}
    for k, u, v, _ in rows:
        last[u] = expected[k] = last[u] * 0.9 + v * 0.1 if u in last else v
    got = {r.epoch: r.ema for r in Q["w12_moving_average"][0](spark, str(tmp_path)).collect()}
    assert got == {k: pytest.approx(x, abs=1e-8) for k, x in expected.items()}


def test_manifest_and_stream(spark, tmp_path):
    from quarrylake.plans.manifest import build
    from quarrylake.sources import files
    from quarrylake.streaming.manifest import first_reports

    rows = [(f"c{k:02}", f"/f/{k}", [f"/r/{k}"], [f"Tooth {k % 4 + 1}{k % 8 + 1} is missing. Report number {k // 2} of the day."]) for k in range(20)]
    m, audit = build(spark.createDataFrame(rows, "case_id string, feature_path string, report_paths array<string>, texts array<string>"))
    split = {r.duplicate_group: set() for r in m.collect()}
    for r in m.collect():
        split[r.duplicate_group].add(r.split)
    assert all(len(s) == 1 for s in split.values()) and {r.split for r in audit.collect()} == {"train", "valid"}
    files.write_manifest(m, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).count() == 20

    src = tmp_path / "in"
    spark.createDataFrame([("a", "One two", "2024-01-01 00:00:00"), ("b", "one TWO!", "2024-01-01 00:01:00"), ("c", "three", "2024-01-01 00:02:00")], "case_id string, text string, ts string").selectExpr("case_id", "text", "timestamp(ts) ts").write.parquet(str(src))
    q = first_reports(spark.readStream.schema("case_id string, text string, ts timestamp").parquet(str(src))).writeStream.format("memory").queryName("firsts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("firsts").count() == 2
