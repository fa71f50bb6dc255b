"""Queries over names, file sets, pooling grids and arrays. Q: name -> (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions import losses
from quarrylake.functions import similarity
from quarrylake.operators import catalog as K
from quarrylake.operators import dedup, records, sampling
from quarrylake.operators import segmentation as S
from quarrylake.operators import voxels as V
from quarrylake.plans.generated import generated, sql, with_tables
from quarrylake.plans.report_queries import NEAR
from quarrylake.sources.files import channels

Q: dict[str, tuple] = {}


def query(name: str, text: str | None = None, *tables: str):
    def add(f):
        Q[name] = (f, with_tables(text, *tables) if text and tables else text)
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("p27_region_mask", "SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 3) AS hit FROM lineitem")
def p27(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.region_mask(F.col("l_linenumber"), F.array(F.lit(1), F.lit(3))).alias("hit"))


@query("p29_identifiers", "SELECT p_partkey, p_brand || '__' || p_type || '__' || p_size AS id, p_type AS plans, 'ensemble___' || p_brand || '___' || p_type || '___0_1_' || p_size AS ens FROM part")
def p29(spark, d):
    p = read(spark, d, "part").withColumn("id", K.model_identifier(F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")))
    return p.select("p_partkey", "id", K.parse_identifier(F.col("id"))["plans"].alias("plans"), K.ensemble_name(F.col("p_brand"), F.col("p_type"), F.array(F.lit(0), F.lit(1), F.col("p_size"))).alias("ens"))


@query("j8_shuffled_source", "SELECT a.case_id, b.prediction AS source FROM (SELECT case_id, coalesce(lead(case_id) OVER (ORDER BY case_id), first_value(case_id) OVER (ORDER BY case_id)) s FROM gen_predictions) a JOIN gen_predictions b ON b.case_id = a.s", "gen_predictions")
def j8(spark, d):
    p = generated(spark, d, "gen_predictions")
    s = sampling.derangement(p.select("case_id"), "case_id")
    return s.join(p.select(F.col("case_id").alias("source"), "prediction"), "source").select("case_id", F.col("prediction").alias("source"))


@query("j10_missing_files", "SELECT DISTINCT c_custkey AS file FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j10(spark, d):
    return K.missing_files(read(spark, d, "customer").select(F.col("c_custkey").alias("file")), read(spark, d, "orders").select(F.col("o_custkey").alias("file")))


@query("a2_near_versions", f"""WITH RECURSIVE gen_predictions AS ({sql("gen_predictions")}), documents AS (SELECT case_id AS doc_id, prediction AS text FROM gen_predictions), {NEAR},
e AS (SELECT n.doc_id a, g.id b FROM n JOIN g USING (normal) WHERE n.doc_id <> g.id UNION ALL SELECT a, b FROM near),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id WHERE r.m < u.b),
roots AS (SELECT id, min(m) root FROM r GROUP BY 1), sizes AS (SELECT root, count(*) size FROM roots GROUP BY 1)
SELECT count(*) / sum(size)::DOUBLE AS near_unique_rate, max(size) AS max_near_duplicate_count FROM sizes""")
def a2(spark, d):
    g = dedup.duplicate_groups(generated(spark, d, "gen_predictions").select(F.col("case_id").alias("id"), F.col("prediction").alias("text")))
    n = g.groupBy("duplicate_group").agg(F.count("*").alias("n"))
    return n.agg((F.count("*") / F.sum("n")).alias("near_unique_rate"), F.max("n").alias("max_near_duplicate_count"))


@query("a20_image_shuffle")
def a20(spark, d):
    p = generated(spark, d, "gen_predictions")
    # the prediction from another case's image, and that case's reference
    of = sampling.derangement(p.select("case_id"), "case_id").join(p.select(F.col("case_id").alias("source"), F.col("prediction").alias("swapped"), F.col("reference").alias("own")), "source")
    p = p.join(of.select("case_id", "swapped", "own"), "case_id")
    m = similarity.overfit_metrics(p.select("prediction", "reference", "swapped", F.col("own").alias("source")))
    return m.select(F.round("swap_change_rate", 9).alias("change"), F.round("swap_stays", 9).alias("stays"), F.round("swap_follows", 9).alias("follows"))


@query("a23_overfit_status", "SELECT dataset, config, fold, CASE WHEN dice < 0.505 THEN 'not_memorized' WHEN dice > 0 AND dice > 0.51 THEN 'uses_image' ELSE 'ignores_image' END AS status FROM gen_cv", "gen_cv")
def a23(spark, d):
    x = F.col("dice")
    return generated(spark, d, "gen_cv").select("dataset", "config", "fold", K.overfit_status(x, x, x, F.lit(0.51), 0.505).alias("status"))


@query("a33_region_pool", "SELECT g.case_id, g.label, round(coalesce(avg(v), 0), 7) AS mean, coalesce(max(v), 0)::DOUBLE AS max FROM (SELECT DISTINCT l_suppkey case_id, r label FROM lineitem, (VALUES (1),(3),(9)) t(r)) g LEFT JOIN (SELECT l_suppkey case_id, l_linenumber label, l_quantity v FROM lineitem) f USING (case_id, label) GROUP BY 1, 2")
def a33(spark, d):
    l = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("v"))
    # places numbered within a case stand for its voxels
    at = l.withColumn("z", F.row_number().over(W.partitionBy("case_id").orderBy("label", "v"))).withColumns({"y": F.lit(0), "x": F.lit(0)})
    pooled = V.region_pool(at.select("case_id", F.lit(0).alias("c"), "z", "y", "x", "v"), at.select("case_id", "z", "y", "x", "label"), spark.createDataFrame([(1,), (3,), (9,)], "label int"))
    return pooled.select("case_id", "label", F.round("mean", 7).alias("mean"), "max")


@query("a36_adaptive_pool", """WITH e AS (SELECT label case_id, c, unnest(embedding)::DOUBLE v, unnest(range(0, 64)) z FROM (SELECT label, vec_id c, embedding FROM embeddings)),
b AS (SELECT * FROM e, range(0, 5) t(b) WHERE z >= floor(b * 64 / 5.0) AND z < ceil((b + 1) * 64 / 5.0)) SELECT case_id, b::INT AS token, c, round(avg(v), 6) AS mean, max(v) AS max FROM b GROUP BY 1, 2, 3""")
def a36(spark, d):
    e = read(spark, d, "embeddings").select(F.col("label").alias("case_id"), F.col("vec_id").alias("c"), F.posexplode("embedding").alias("z", "v"))
    f = e.select("case_id", "c", "z", F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("v").cast("double").alias("v"))
    # one place on two axes: of the grid's bins there only those that hold it
    p = V.adaptive_pool(f, {"z": 64, "y": 5, "x": 5}, 5)
    return p.select("case_id", (F.col("token") / 25).cast("int").alias("token"), "c", F.round("mean", 6).alias("mean"), "max")


@query("a37_region_metadata", """WITH r AS (SELECT case_id, ref label, avg(x) cx, min(x) x0, max(x) + 1 x1, count(*) n FROM gen_voxels WHERE ref <> 0 GROUP BY 1, 2)
SELECT case_id, label, round(2 * (cx - min(cx) OVER w) / greatest(max(cx) OVER w - min(cx) OVER w, 1) - 1, 7) AS cx, round((x0 - min(x0) OVER w) / greatest(max(x1) OVER w - min(x0) OVER w, 1)::DOUBLE, 7) AS x0, round((x1 - min(x0) OVER w) / greatest(max(x1) OVER w - min(x0) OVER w, 1)::DOUBLE, 7) AS x1,
round(ln(1 + n) / greatest(ln(1 + max(n) OVER w), 1), 7) AS volume FROM r WINDOW w AS (PARTITION BY case_id)""", "gen_voxels")
def a37(spark, d):
    g = V.region_geometry(generated(spark, d, "gen_voxels").withColumnRenamed("ref", "label"))
    r = g.select("case_id", "label", *(F.col("centroid")[k].alias(f"c{n}") for k, n in enumerate("xyz")), *(F.col("bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "z0", "x1", "y1", "z1"))), F.col("voxel_count").alias("voxels"))
    m = V.region_metadata(r)
    return m.select("case_id", "label", *(F.round(F.col(c), 7).alias(c) for c in ("cx", "x0", "x1", "volume")))


@query("a47_collate", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') AS keys FROM orders GROUP BY 1")
def a47(spark, d):
    return records.collated(read(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", F.array_join(F.col("values").cast("array<string>"), ",").alias("keys"))


def _rounds(n: int = 6) -> str:
    """SQL of a Feistel network of n rounds over x in a grid of a x b places."""
    out = "SELECT i, n, a, b, x // b AS p, x % b AS q FROM walk"
    for k in range(n):
        moved = "p" if k % 2 == 0 else "q"
        other, size = ("q", "a") if moved == "p" else ("p", "b")
        value = f"({moved} + ('0x' || sha1('42:{k}:' || {other})[1:8])::BIGINT) % {size} AS {moved}"
        out = f"SELECT i, n, a, b, {value}, {other} FROM ({out} WHERE x IS NULL OR k = 0 OR x >= n)" if k == 0 else f"SELECT i, n, a, b, {value}, {other} FROM ({out})"
    return out


@query("w3_seeded_shuffle", f"""WITH RECURSIVE size AS (SELECT n, a, (n + a - 1) // a AS b FROM (SELECT count(*) AS n, floor(sqrt(count(*) - 1))::BIGINT + 1 AS a FROM orders)),
walk AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS i, n, a, b, row_number() OVER (ORDER BY o_orderkey) - 1 AS x, 0 AS k FROM orders, size
 UNION ALL SELECT i, n, a, b, p * b + q, 1 FROM ({_rounds()}))
SELECT o_orderkey, x AS place FROM walk JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) USING (i) WHERE k = 1 AND x < n""")
def w3(spark, d):
    return sampling.shuffled(read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 42)


@query("w6_limited_shard", "SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 i FROM gen_records) WHERE i % 3 = 2 ORDER BY case_id LIMIT 10", "gen_records")
def w6(spark, d):
    return sampling.shard(generated(spark, d, "gen_records").select("case_id"), ["case_id"], 2, 3).orderBy("case_id").limit(10)


@query("w11_window_grid", "SELECT p_partkey, z * 4 AS z, x * 4 AS x FROM part, range(0, 14) a(z), range(0, 14) b(x) WHERE z < CASE WHEN p_size <= 8 THEN 1 ELSE ceil((p_size - 8) / 4.0) + 1 END AND x < CASE WHEN p_size <= 8 THEN 1 ELSE ceil((p_size - 8) / 4.0) + 1 END")
def w11(spark, d):
    s = sampling.aligned_starts(F.col("p_size"), F.lit(8), F.lit(4))
    return K.window_grid(read(spark, d, "part").select("p_partkey", s.alias("z"), F.array(F.lit(0)).alias("y"), s.alias("x"))).select("p_partkey", F.col("z").cast("long").alias("z"), F.col("x").cast("long").alias("x"))


@query("w16_foreground_locations", "SELECT case_id, ref AS label, greatest(least(10, count(*)), ceil(count(*) * 0.1))::BIGINT AS n FROM gen_voxels WHERE ref > 0 GROUP BY 1, 2", "gen_voxels")
def w16(spark, d):
    v = V.foreground_locations(generated(spark, d, "gen_voxels").withColumnRenamed("ref", "label"), most=10, share=0.1)
    return v.groupBy("case_id", "label").agg(F.count("*").alias("n"))


@query("m1_affine", "SELECT l_orderkey, l_linenumber, 0.3 * l_quantity + 10 AS x, 0.3 * l_linenumber - 5 AS y FROM lineitem")
def m1(spark, d):
    m = F.array(*(F.array(*(F.lit(float(v)) for v in r)) for r in ((0.3, 0, 0, 10), (0, 0.3, 0, -5), (0, 0, 0.3, 0))))
    p = K.affine_point(m, F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(0.0)))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p")).select("l_orderkey", "l_linenumber", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("m2_nearest_index", "SELECT p_partkey, least(floor((p_partkey % 40) * 17 / 40.0), 16)::INT AS i FROM part")
def m2(spark, d):
    return read(spark, d, "part").select("p_partkey", V.nearest_index(F.col("p_partkey") % 40, 17, 40).alias("i"))


@query("m7_crop_and_back", "SELECT case_id, z, y, x FROM gen_voxels WHERE z >= 2 AND z < 5 AND y >= 3 AND y < 40", "gen_voxels")
def m7(spark, d):
    v = generated(spark, d, "gen_voxels").select("case_id", "z", "y", "x")
    boxes = v.select("case_id").distinct().select("case_id", F.lit(2).alias("z0"), F.lit(5).alias("z1"), F.lit(3).alias("y0"), F.lit(40).alias("y1"), F.lit(0).alias("x0"), F.lit(1 << 30).alias("x1"))
    return V.uncrop(V.crop(v, boxes), boxes)


@query("m8_causal_loss", """WITH e AS (SELECT vec_id % 20 s, CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END l, embedding::DOUBLE[] x FROM embeddings), c AS (SELECT s, l, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[l + 1] ce FROM e)
SELECT s::INT AS sample, round(coalesce(sum(ce) FILTER (l <> -100), 0) / greatest(count(*) FILTER (l <> -100), 1e-8), 9) AS loss FROM c GROUP BY 1""")
def m8(spark, d):
    e = read(spark, d, "embeddings").select((F.col("vec_id") % 20).cast("int").alias("sample"), F.col("embedding").cast("array<double>").alias("logits"), F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label")).alias("label"), F.lit(1.0).alias("weight"))
    return losses.weighted_causal_loss(e).withColumn("loss", F.round("loss", 9))


@query("m12_padding", "SELECT o_custkey, array_to_string(list_concat(k, list_transform(range(0, (max(len(k)) OVER () - len(k))), lambda i: 0)), ',') AS padded FROM (SELECT o_custkey, list_sort(list(o_orderkey)) k FROM orders GROUP BY 1)")
def m12(spark, d):
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k")).withColumn("batch", F.lit(0))
    p = V.pad(o.withColumn("k", F.col("k").cast("array<double>")), "k")
    return p.select("o_custkey", F.array_join(F.col("k").cast("array<bigint>").cast("array<string>"), ",").alias("padded"))


@query("s10_channel_files", "SELECT 'case' || (p_partkey % 50) AS id, count(*) AS n, min('case' || (p_partkey % 50) || '_' || lpad(CAST(p_size AS VARCHAR), 4, '0') || '.nii.gz') AS first FROM part GROUP BY 1")
def s10(spark, d):
    p = read(spark, d, "part").select(F.concat(F.lit("case"), (F.col("p_partkey") % 50).cast("string"), F.lit("_"), F.lpad(F.col("p_size").cast("string"), 4, "0"), F.lit(".nii.gz")).alias("file"))
    return channels(p, ".nii.gz").select("id", F.size("files").cast("long").alias("n"), F.col("files")[0].alias("first"))


@query("s14_dataset_names", "SELECT DISTINCT 'Dataset' || lpad(CAST(p_size AS VARCHAR), 3, '0') || '_' || p_brand AS name FROM part WHERE p_size = 7")
def s14(spark, d):
    n = read(spark, d, "part").select(F.concat(F.lit("Dataset"), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("_"), "p_brand").alias("name"))
    return K.datasets_by_id(n, 7)


@query("v2_available_folds", "SELECT p_partkey::INT AS fold FROM part WHERE p_size % 2 = 0 AND p_partkey % 5 <> 0")
def v2(spark, d):
    f = read(spark, d, "part").select(F.concat(F.lit("fold_"), F.when(F.col("p_partkey") % 5 == 0, "all").otherwise(F.col("p_partkey").cast("string"))).alias("folder"), (F.col("p_size") % 2 == 0).alias("has_checkpoint"))
    return K.available_folds(f)


@query("v16_merged_maps", "SELECT p_partkey, p_size AS a, p_partkey % 3 AS b FROM part")
def v16(spark, d):
    m = records.merged(F.create_map(F.lit("a"), F.col("p_size").cast("long"), F.lit("b"), F.lit(-1).cast("long")), F.create_map(F.lit("b"), F.col("p_partkey") % 3))
    return read(spark, d, "part").select("p_partkey", m["a"].cast("int").alias("a"), m["b"].alias("b"))
