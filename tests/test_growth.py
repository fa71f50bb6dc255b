"""Work that must not grow faster than the tables: what is done once, and in how many tasks."""

import math
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import functions as F

from quarrylake.functions import assertions as A
from quarrylake.functions import losses
from quarrylake.functions import similarity as SIM
from quarrylake.operators import morphology as M
from quarrylake.operators import planning as P
from quarrylake.operators import resampling as R
from quarrylake.operators import sampling
from quarrylake.operators import windows as WI


def counted(spark, monkeypatch):
    """A counter of the pairs that are compared by character."""
    from difflib import SequenceMatcher

    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counting(a: pd.Series, b: pd.Series) -> pd.Series:
        calls.add(len(a))
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.strip(), y.strip()).ratio() for x, y in zip(a, b)], dtype="float64")

    monkeypatch.setattr(SIM, "character_similarity", counting)
    return calls


def test_overfit_metrics_compare_different_pairs_once(spark, monkeypatch):
    calls = counted(spark, monkeypatch)
    rows = spark.range(4000).select(F.concat(F.lit("abcd"), F.col("id") % 2).alias("prediction"), F.lit("abcx").alias("reference"), F.when(F.col("id") % 4 > 0, F.lit("bcd")).alias("swapped"), F.lit(" abc ").alias("source"))
    got = SIM.overfit_metrics(rows).first()
    assert calls.value <= 8
    assert round(got.character_similarity, 9) == round(6 / 9, 9) and round(got.swap_stays, 9) == round(6 / 8, 9) and round(got.swap_follows, 9) == round(4 / 6, 9)


def test_pairs_are_compared_once(spark, monkeypatch):
    calls = counted(spark, monkeypatch)
    pairs = spark.range(3000).select("id", F.when(F.col("id") % 5 > 0, F.lit("abcd")).alias("a"), F.concat(F.lit("ab"), F.col("id") % 2).alias("b"))
    got = {(r.a, r.b, r.similarity): r.n for r in SIM.compared(pairs).groupBy("a", "b", "similarity").agg(F.count("*").alias("n")).collect()}
    assert calls.value == 2
    assert got == {("abcd", "ab0", 4 / 7): 1200, ("abcd", "ab1", 4 / 7): 1200, (None, "ab0", None): 300, (None, "ab1", None): 300}


def shuffles(df):
    """Exchanges of a plan, those by broadcast left out."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_a_resampled_volume_is_shuffled_once(spark):
    v = spark.range(400).selectExpr("'a' AS case_id", "0 AS z", "int(id % 2) AS y", "int(id / 2) AS x", "double(id) AS v")
    grids = spark.createDataFrame([("a", [1, 2, 200], [1, 3, 90], None)], "case_id string, n array<int>, m array<int>, separate int")
    found = R.resampled_cases(v, grids, clip=False)
    assert shuffles(found) == 1 and found.count() == 270
    labels = v.selectExpr("case_id", "z", "y", "x", "int(x > 99) AS label")
    assert shuffles(R.resampled_labels(labels, grids)) == 1
    assert {r.label: r.n for r in R.resampled_labels(labels, grids, zeros=False).groupBy("label").agg(F.count("*").alias("n")).collect()} == {1: 135}


def test_volumes_alone_are_those_with_labels(spark):
    v = spark.range(300).selectExpr("'a' AS case_id", "0 AS c", "int(id % 3) AS z", "int(id / 3 % 10) AS y", "int(id / 30) AS x", "double(id * 7 % 11) AS v")
    labels = v.selectExpr("case_id", "z", "y", "x", "int(v > 5) AS label")
    spacings = spark.createDataFrame([("a", [2.0, 1.0, 1.0])], "case_id string, spacing array<double>")
    one = R.preprocessed_volumes(v, spacings, [0, 2, 1], [1.5, 2.0, 0.8])
    two, _ = R.preprocessed_cases(v, labels, spacings, [0, 2, 1], [1.5, 2.0, 0.8])
    one, two = ({tuple(r)[:-1]: r.v for r in x.collect()} for x in (one, two))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-12 for k in one)


def test_balls_in_boxes_need_no_rows_of_places(spark):
    box = spark.createDataFrame([("a", 0, 3, 0, 1 << 14, 0, 1 << 20), ("b", 2, 4, 0, 2, 63, 66)], "case_id string, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    mask = spark.createDataFrame([("a", 1, 64, 63), ("a", 1, 64, 65), ("b", 2, 0, 64), ("b", 9, 0, 64)], "case_id string, z int, y int, x int")
    big = M.ball_dilated(mask, box, 1)
    assert shuffles(big) == 1
    got = {tuple(r) for r in big.collect()}
    assert {r for r in got if r[0] == "b"} == {("b", 2, 0, 63), ("b", 2, 0, 64), ("b", 2, 0, 65), ("b", 2, 1, 64), ("b", 3, 0, 64)}
    assert len(got) == 5 + 13
    assert {tuple(r) for r in M.ball_closed(mask.where("case_id = 'a'"), box, 1).collect()} == {("a", 1, 64, 63), ("a", 1, 64, 65)}


def test_windows_around_a_place_are_those_of_all_starts(spark):
    rows = [(n, at) for n in (1, 3, 4, 5, 7, 10, 23, 61) for at in range(n + 2)]
    t = spark.createDataFrame(rows, "n int, at int")
    for patch, share in ((4, 0.5), (5, 0.3), (8, 1.0)):
        room = F.greatest("n", F.lit(patch))
        every = F.filter(sampling.spread_starts(room, F.lit(patch), share), lambda s: (s <= F.col("at")) & (F.col("at") < s + patch))
        assert t.where(WI.windows_of(F.col("at"), room, patch, share) != every).count() == 0
    # few are made along a long axis
    plan = spark.range(1).select(WI.windows_of(F.lit(500), F.col("id").cast("int") + 10**9, 4, 0.5).alias("w")).first()
    assert plan.w == [498, 500]


def test_top_share_holds_no_group_in_a_window(spark):
    t = spark.createDataFrame([(g, float(v), k) for k, (g, v) in enumerate([("a", 3), ("a", 1), ("a", 3), ("a", 2), ("b", 5), (None, 7), (None, 9)] * 3)], "g string, loss double, id long")
    found = losses.top_share_mean(t, 0.5, "g")
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.g: r.loss for r in found.collect()} == {"a": 3.0, "b": 5.0, None: 9.0}


def test_topology_is_found_once_for_equal_patches(spark):
    t = spark.range(3000).select("id", F.array(F.lit(16), F.lit(64), (32 * (F.col("id") % 3 + 1)).cast("int")).alias("patch"), F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)).alias("spacing"))
    found = P.topologies(t, 4, 4)
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()  # what is left is a join with the few found
    assert found.where(F.col("t") != P.topology(F.col("patch"), F.col("spacing"), 4, 4)).count() == 0 and found.count() == 3000


def test_rows_of_few_parts_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(SIM, "TEXTS", 10)
    pairs = spark.range(100).coalesce(1).select(F.col("id").alias("case_id"), F.lit("a b c d e").alias("prediction"), F.array(F.lit("a b c d f")).alias("references"))
    plan = SIM.corpus_bleu(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(case_id" in plan and ", 10), REPARTITION_BY_NUM" in plan
    monkeypatch.setattr(A, "TOKENS", 10)
    tokens = spark.range(100).coalesce(1).select(F.lit("r").alias("id"), F.col("id").cast("int").alias("begin"), (F.col("id") + 2).cast("int").alias("end"))
    plan = A.token_weights(tokens, spark.createDataFrame([("r", "a b. c d.")], "id string, text string"), 0.2, 2.0)._jdf.queryExecution().executedPlan().toString()
    assert ", 10), REPARTITION_BY_NUM" in plan


def test_bleu_joins_no_n_grams(spark):
    rows = [("a", "a b c d e a b", ["a b c x", "a b a b"]), ("a", "a b c q", ["c d e", "b"]), ("b", "q r s t u", ["q r s t v", "q r s"]), (None, "a b c d", ["a b c d", "a b c d"]), ("c", None, ["a", "b"]), ("d", "a b c d e", [None, "a b c d e f"])]
    found = SIM.corpus_bleu(spark.createDataFrame(rows, "case_id string, prediction string, references array<string>"))
    # a join by n-grams looks small to the planner at any size and would be broadcast
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "g#" in x]

    def grams(text, n):
        w = (text or "").split()
        return Counter(tuple(w[k:k + n]) for k in range(len(w) - n + 1))

    log = 0
    for n in range(1, 5):
        hits = 0
        for case in "abcd":
            own = [r for r in rows if r[0] == case]
            h = sum((grams(r[1], n) for r in own), Counter())
            most = reduce(Counter.__or__, [sum((grams(r[2][i], n) for r in own), Counter()) for i in (0, 1)])
            hits += sum((h & most).values())
        log += math.log((hits or 0.1) / sum(sum(grams(r[1], n).values()) for r in rows)) / 4
    c, closest = 25, 4 + 3 + 5 + 4 + 6
    assert abs(found.first().bleu4 - min(1, math.exp(1 - closest / c)) * math.exp(log)) < 1e-12


def test_only_series_of_several_chunks_are_folded(spark):
    rows = [(u, k, float((u * 7 + k * 3) % 11)) for u, n in enumerate([1, 2, 200, 3, 500, 66, 1] + [1] * 90) for k in range(n)]
    series = spark.createDataFrame(rows, "u long, k long, v double").repartition(5)
    found = sampling.moving_average(series, "u", "k", "v", keep=0.001)  # chunks of 66 rows
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "_many" in plan and "Union" in plan
    last, expected = {}, {}
    for u, k, v in rows:
        last[u] = expected[u, k] = 0.001 * last[u] + 0.999 * v if u in last else v
    got = {(r.u, r.k): r.ema for r in found.collect()}
    assert got.keys() == expected.keys() and all(abs(got[x] - expected[x]) < 1e-9 for x in expected)


def test_mirror_images_are_shuffled_once(spark, tmp_path, monkeypatch):
    from quarrylake.plans import further_queries as Q

    monkeypatch.setattr(Q, "PLACES", 10, raising=False)
    spark.range(700).selectExpr("id % 300 AS l_orderkey", "id AS l_partkey", "id % 40 AS l_suppkey", "int(id % 7 + 1) AS l_linenumber", "double(id % 50) AS l_quantity").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = Q.Q["a39_mirrored_mean"][0](spark, str(tmp_path))
    assert shuffles(found) == 1 and ", 70), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_tiles_make_few_links(spark, monkeypatch):
    from quarrylake.operators import components, segmentation

    real, seen = components.connected_components, []

    def counted(edges, *rest):
        seen.append(edges.count())
        return real(edges, *rest)

    monkeypatch.setattr(components, "connected_components", counted)
    snake = {("a", 63, 64, x) for x in range(-300, 300)} | {("a", z, 64, 299) for z in range(60, 140)} | {("a", 139, y, 299) for y in range(60, 140)}
    block = {("a", z, y, x) for z in range(5) for y in range(12) for x in range(12)}  # 720 voxels, of which the snake has 758
    other = {("b", 0, 0, 255), ("b", 0, 0, 256), ("b", 7, 7, 7), ("b", 7, 8, 8), ("b", 30, 63, 2), ("b", 30, 64, 2)}
    rows = [*snake, *block, *other, *list(snake)[:50]]
    found = segmentation.largest_component(spark.createDataFrame(rows, "case_id string, z int, y int, x int"))
    assert dict(found.dtypes)["x"] == "int"
    assert sorted(map(tuple, found.collect())) == sorted([*snake, ("b", 0, 0, 255), ("b", 0, 0, 256)])
    assert seen and sum(seen) < 200


def test_next_rows_are_found_in_one_shuffle(spark):
    from quarrylake.operators import dedup

    rows = [(k, [k * 10]) for k in (-65, -64, -1, 0, 1, 2, 5, 62, 63, 64, 65, 127, 128, 130)] + [(5, [51]), (6, [60]), (6, [61]), (None, [7])]
    found = dedup.followed(spark.createDataFrame(rows, "k long, s array<long>"), "k", "s")
    assert shuffles(found) == 1
    pairs = sorted((a, s, t) for a, s in rows for b, t in rows if a is not None and b is not None and b == a + 1)
    assert sorted((r.k, r.s, r.next) for r in found.collect()) == pairs


def test_texts_are_normalised_by_one_replacement(spark):
    from quarrylake.functions import text as T

    cases = {None: None, "": T.EMPTY, " -- ": T.EMPTY, "A": "a", "  Tooth 4.6,\nis MISSING!": "tooth 4 6 is missing", "ÄbİcK9": "b i ck9", "a_b": "a b"}
    t = spark.createDataFrame([(x,) for x in cases], "t string").select("t", T.normalize_report(F.col("t")).alias("n"))
    got = {r.t: r.n for r in t.collect()}
    old = {r.t: r.n for r in t.select("t", F.array_join(F.regexp_extract_all(F.lower("t"), F.lit("[a-z0-9]+"), F.lit(0)), " ").alias("n")).collect()}
    assert got == {x: None if x is None else old[x] or T.EMPTY for x in cases} and got["  Tooth 4.6,\nis MISSING!"] == "tooth 4 6 is missing"
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and "regexp_extract_all" not in plan
    sets = spark.createDataFrame([([1, 2, 3], [2, 3, 4, 5]), ([], []), ([1], []), (None, [1])], "a array<long>, b array<long>")
    assert [r[0] for r in sets.select(T.jaccard(F.col("a"), F.col("b"))).collect()] == [2 / 5, 1.0, 0.0, None]


def test_copies_make_no_links(spark, monkeypatch):
    from quarrylake.operators import dedup

    real, seen = dedup.connected_components, []

    def counted(edges, *rest):
        seen.append(edges.count())
        return real(edges, *rest)

    monkeypatch.setattr(dedup, "connected_components", counted)
    reports = spark.range(1200).selectExpr("concat('i', lpad(id, 4, '0')) AS id", "concat('only one of three words ', id % 3, 'x') AS text")
    got = dedup.duplicate_groups(reports).groupBy("duplicate_group", "template_group").count().collect()
    assert sorted(map(tuple, got)) == [(f"i000{k}", f"i000{k}", 400) for k in range(3)]
    assert sum(seen) < 10


def test_copies_are_normalised_once(spark, monkeypatch):
    from quarrylake.functions import text as T
    from quarrylake.operators import dedup

    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counting(t: pd.Series) -> pd.Series:
        calls.add(len(t))
        return t.str.lower()

    monkeypatch.setattr(T, "normalize_report", counting)
    # i0000 to i0009 have two texts each; of the long texts, those with One and two are near each other
    words = "concat('a b c d e f g h i j k l m n o p q r s t u v w x y z 1 2 3 4 5 6 7 8 9 ', CASE id % 3 WHEN 0 THEN '0 0 0 0 0 0 0 0 0 0 0' WHEN 1 THEN 'One' ELSE 'two' END)"
    reports = spark.range(3000).selectExpr("concat('i', lpad(id, 4, '0')) AS id", f"{words} AS text").unionByName(spark.range(10).selectExpr("concat('i', lpad(id, 4, '0')) AS id", "concat('own text ', id) AS text"))
    got = dedup.duplicate_groups(reports).groupBy("duplicate_group", "template_group").count().collect()
    assert sorted(map(tuple, got)) == [("i0000", "i0000", 1000), ("i0001", "i0001", 1000), ("i0001", "i0002", 1000)]
    assert 3010 <= calls.value < 3200
    calls.value = 0
    assert dedup.shingle_sets(reports, 0.85).count() == 3 and calls.value == 2 * 3010
