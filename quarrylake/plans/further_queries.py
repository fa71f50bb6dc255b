"""Queries over inputs, records, planning, augmentation and losses. Q: name -> (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylake.functions import losses
from quarrylake.operators import augmentation as G
from quarrylake.operators import catalog as K
from quarrylake.operators import planning as P
from quarrylake.operators import records as R
from quarrylake.operators import sampling
from quarrylake.operators import segmentation as S
from quarrylake.operators import split as SPLIT
from quarrylake.operators import voxels as V
from quarrylake.operators.storage import checkpoint_folder, parts_for
from quarrylake.plans.generated import generated, with_tables
from quarrylake.sources import files as S_FILES
from quarrylake.sources import tables as S_TABLES

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        Q[name] = (f, with_tables(sql, *tables) if sql and tables else sql)
        return f

    return add


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


PATHS = "CASE p_size % 3 WHEN 0 THEN 'in' || p_partkey || '/cbct/volume.nii.gz' WHEN 1 THEN 'in' || p_partkey || '.nii.gz' ELSE 'in' || p_partkey || '.txt' END"


def paths(spark, d):
    return read(spark, d, "part").select((F.col("p_partkey") % 200).alias("input"), F.expr(PATHS).alias("path"))


@query("s1_discovery_problems", "SELECT case_id, CASE WHEN e IS NULL THEN 'no report' WHEN e > 0 THEN 'empty report' ELSE 'no feature file' END AS problem FROM (SELECT c_custkey case_id, e, f FROM customer LEFT JOIN (SELECT o_custkey, count(*) FILTER (o_totalprice < 10000) e FROM orders GROUP BY 1) ON o_custkey = c_custkey LEFT JOIN (SELECT DISTINCT o_custkey k, true f FROM orders WHERE o_orderstatus = 'F') ON k = c_custkey) WHERE e IS NULL OR e > 0 OR f IS NULL")
def s1(spark, d):
    o = read(spark, d, "orders").withColumn("case_id", F.col("o_custkey"))
    r = o.select("case_id", F.when(F.col("o_totalprice") < 10000, " ").otherwise("text").alias("text"))
    return S_TABLES.discovery_problems(read(spark, d, "customer").select(F.col("c_custkey").alias("case_id")), r, o.where("o_orderstatus = 'F'"))


@query("s3_checked_features", "SELECT p_partkey AS case_id, p_size AS depth FROM part")
def s3(spark, d):
    f = read(spark, d, "part").select(F.col("p_partkey").alias("case_id"), F.array(F.lit(320), F.col("p_size"), F.lit(4), F.lit(4)).alias("shape"))
    return S_TABLES.checked_features(f, 320).select("case_id", F.col("shape")[1].alias("depth"))


@query("s4_expanded_inputs", f"SELECT input, path FROM (SELECT p_partkey % 200 input, {PATHS} path, p_size % 3 = 0 own, bool_or(p_size % 3 = 0) OVER (PARTITION BY p_partkey % 200) a FROM part) WHERE path LIKE '%.nii.gz' AND own = a")
def s4(spark, d):
    return S_TABLES.expanded(paths(spark, d))


@query("s5_case_of_path", f"SELECT path, regexp_replace(regexp_replace(path, '/cbct/volume.nii.gz$', ''), '\\.(nii\\.gz|txt)$', '') AS case_id FROM (SELECT {PATHS} path FROM part)")
def s5(spark, d):
    return paths(spark, d).select("path", S_FILES.case_id(F.col("path")).alias("case_id"))


@query("s6_resolved_inputs", f"SELECT DISTINCT regexp_replace(regexp_replace(path, '/cbct/volume.nii.gz$', ''), '\\.(nii\\.gz|txt)$', '') AS case_id, path FROM (SELECT {PATHS} path FROM part)")
def s6(spark, d):
    p = paths(spark, d)
    return S_FILES.resolve_inputs(p.unionByName(p))


@query("s8_formats", "SELECT p_partkey, CASE WHEN p_size % 11 = 0 THEN 'given' ELSE CASE p_size % 5 WHEN 0 THEN 'nifti' WHEN 1 THEN 'mha' WHEN 2 THEN 'tiff' WHEN 3 THEN 'natural' END END AS format FROM part")
def s8(spark, d):
    ending = F.element_at(F.array(*map(F.lit, (".nii.gz", ".MHA", ".tif", ".png", ".txt"))), F.col("p_size") % 5 + 1)
    return read(spark, d, "part").select("p_partkey", S_TABLES.format_of(F.concat("p_name", ending), F.when(F.col("p_size") % 11 == 0, "given")).alias("format"))


@query("s9_only_inputs", "SELECT p_partkey AS case_id, 'f' || p_partkey || '.mha' AS path, least(p_name, p_brand) || ',' || greatest(p_name, p_brand) AS key FROM part")
def s9(spark, d):
    p = read(spark, d, "part")
    sockets = F.to_json(F.array(*(F.struct(F.struct(F.col(c).alias("slug")).alias("socket")) for c in ("p_name", "p_brand"))))
    f = p.select(F.col("p_partkey").alias("case_id"), F.explode(F.array(text("f", F.col("p_partkey"), ".mha"), text("f", F.col("p_partkey"), ".json"))).alias("path"))
    keys = p.select(F.col("p_partkey").alias("case_id"), F.array_join(S_TABLES.interface_key(sockets), ",").alias("key"))
    return S_TABLES.only_file(f, ".mha").join(keys, "case_id")


@query("s11_dataset_index", "SELECT 'c' || (p_partkey % 500) AS case_id, coalesce(max(f) FILTER (k = 0), max(f) FILTER (k = 1)) AS data, max(f) FILTER (k = 2) AS properties FROM (SELECT p_partkey, p_size % 4 k, 'c' || (p_partkey % 500) || CASE p_size % 4 WHEN 0 THEN '.npy' WHEN 1 THEN '.npz' WHEN 2 THEN '.pkl' ELSE '_seg.npy' END f FROM part) GROUP BY 1 HAVING count(*) FILTER (k < 2) > 0")
def s11(spark, d):
    ending = F.element_at(F.array(*map(F.lit, (".npy", ".npz", ".pkl", "_seg.npy"))), F.col("p_size") % 4 + 1)
    f = read(spark, d, "part").select(F.lit("own").alias("folder"), F.concat(text("c", F.col("p_partkey") % 500), ending).alias("file"))
    return S_TABLES.dataset_index(f).select("case_id", "data", "properties")


@query("s13_broken_files", "SELECT o_orderkey AS path FROM orders WHERE NOT starts_with(o_orderpriority, '1')")
def s13(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").cast("binary").alias("content"))
    return S_TABLES.broken_files(o, b"1")


@query("s15_summary", "SELECT f, CASE WHEN n % 2 = 0 THEN n::VARCHAR ELSE '1,' || n END AS region, dice, iou FROM (SELECT l_returnflag f, l_linenumber n, max(l_quantity) dice, min(l_discount) iou FROM lineitem GROUP BY 1, 2)")
def s15(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.max("l_quantity").alias("Dice"), F.min("l_discount").alias("IoU"))
    region = F.when(F.col("l_linenumber") % 2 == 0, F.array("l_linenumber")).otherwise(F.array(F.lit(1), "l_linenumber"))
    m = g.select(F.col("l_returnflag").alias("f"), region.alias("region"), F.explode(F.map_from_arrays(F.array(F.lit("Dice"), F.lit("IoU")), F.array("Dice", "IoU"))).alias("metric", "value"))
    s = R.summary(m, "f").select("f", F.explode(R.read_summary(F.col("summary"))).alias("e"))
    return s.select("f", F.array_join(F.col("e.region").cast("array<string>"), ",").alias("region"), F.col("e.metrics")["Dice"].alias("dice"), F.col("e.metrics")["IoU"].alias("iou"))


@query("k11_upserted", "SELECT DISTINCT 'cudnn_8__torch_2__' || replace(p_name, ' ', '') || '__gpus_' || p_size AS k, CASE WHEN p_size < 20 THEN 2 ELSE 1 END AS seconds FROM part")
def k11(spark, d):
    k = read(spark, d, "part").select(R.benchmark_key(F.lit("8"), F.lit("2"), F.col("p_name"), F.col("p_size")).alias("k"), "p_size").distinct()
    return R.upserted(k.select("k", F.lit(1).alias("seconds")), k.where("p_size < 20").select("k", F.lit(2).alias("seconds")), ["k"])


@query("k12_description", """SELECT '{"channel_names":{' || (SELECT string_agg('"' || r_regionkey || '":"' || r_name || '"', ',' ORDER BY r_regionkey::VARCHAR) FROM region) || '},"labels":{' || (SELECT string_agg('"' || n_name || '":' || n_nationkey, ',' ORDER BY n_name) FROM nation) || '},"numTraining":480,"file_ending":".nii.gz"}' AS description""")
def k12(spark, d):
    c, n = read(spark, d, "region").select(F.col("r_regionkey").alias("number"), F.col("r_name").alias("name")), read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("value"))
    return R.dataset_description(c, n, 480, ".nii.gz")


@query("k14_run_names", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_default' || CASE WHEN o_custkey % 2 = 0 THEN '-LR' || o_custkey ELSE '' END || CASE WHEN o_custkey % 3 > 0 THEN '-overfit' || (o_custkey % 3) ELSE '' END || CASE WHEN o_orderstatus = 'F' THEN '-F' ELSE '' END AS name FROM orders")
def k14(spark, d):
    c = F.col("o_custkey")
    return read(spark, d, "orders").select("o_orderkey", R.run_name(F.col("o_orderdate"), F.lit("default"), F.when(c % 2 == 0, c), c % 3, F.when(F.col("o_orderstatus") == "F", "F").otherwise("")).alias("name"))


@query("u1_reference_union", "SELECT DISTINCT case_id AS id, concept, tooth_number, polarity FROM gen_reference", "gen_reference")
def u1(spark, d):
    a = generated(spark, d, "gen_reference").select(F.col("case_id").alias("id"), "concept", "tooth_number", "polarity")
    return R.reference_union(a.withColumn("report", F.lit(1)).unionByName(a.withColumn("report", F.lit(2))))


@query("o5_assertion_order", "SELECT case_id, string_agg(concept || ':' || coalesce(tooth_number, '-'), ',' ORDER BY concept, tooth_number NULLS FIRST, polarity) AS assertions FROM (SELECT DISTINCT case_id, concept, tooth_number, polarity FROM gen_predicted) GROUP BY 1", "gen_predicted")
def o5(spark, d):
    a = generated(spark, d, "gen_predicted").select("case_id", "concept", "tooth_number", "polarity").distinct()
    a = a.groupBy("case_id").agg(R.assertion_order(F.collect_list(F.struct("concept", "tooth_number", "polarity"))).alias("x"))
    return a.select("case_id", F.array_join(F.transform("x", lambda y: F.concat_ws(":", y["concept"], F.coalesce(y["tooth_number"], F.lit("-")))), ",").alias("assertions"))


@query("u6_missing_keys", "SELECT p_partkey, array_to_string(list_filter(['weights', 'plans', 'epoch'], lambda k: NOT list_contains(CASE p_size % 3 WHEN 0 THEN ['weights'] WHEN 1 THEN ['plans', 'epoch'] ELSE ['epoch', 'plans', 'weights'] END, k)), ',') AS missing FROM part")
def u6(spark, d):
    have = F.element_at(F.array(*(F.array(*map(F.lit, k)) for k in (["weights"], ["plans", "epoch"], ["epoch", "plans", "weights"]))), F.col("p_size") % 3 + 1)
    return read(spark, d, "part").select("p_partkey", F.array_join(R.missing_keys(have, ["weights", "plans", "epoch"]), ",").alias("missing"))


@query("v19_checkpoint_problems", "SELECT p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN 'missing weights' ELSE 'no weights' END AS problem FROM part WHERE p_size % 3 = 0 OR p_size % 5 = 0")
def v19(spark, d):
    size = F.col("p_size")
    keys = F.when(size % 3 == 0, F.array(F.lit("plans"))).otherwise(F.array(F.lit("plans"), F.lit("weights")))
    weights = F.when(size % 5 == 0, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("w"), F.lit(1.0)))
    return R.checkpoint_problem(read(spark, d, "part").select(F.col("p_partkey").alias("name"), keys.alias("keys"), weights.alias("weights")), ["plans", "weights"])


@query("u8_candidates", "SELECT p_brand AS name FROM part UNION SELECT p_type FROM part UNION SELECT o_orderpriority FROM orders")
def u8(spark, d):
    p = read(spark, d, "part")
    return R.candidates(p.select(F.col("p_brand").alias("name")), p.select(F.col("p_type").alias("name")), read(spark, d, "orders").select(F.col("o_orderpriority").alias("name")))


@query("v4_configuration", "SELECT p_partkey, p_size AS patch, p_partkey % 7 AS batch, 0.3 AS spacing FROM part")
def v4(spark, d):
    c = K.resolve_configuration({"low": {"patch": 1, "batch": 2, "spacing": 0.3}, "full": {"inherits_from": "low", "patch": "p_size"}, "cascade": {"inherits_from": "full", "batch": "p_partkey % 7"}}, "cascade")
    return read(spark, d, "part").select("p_partkey", *(F.expr(str(c[k])).cast("double" if k == "spacing" else "long").alias(k) for k in ("patch", "batch", "spacing")))


@query("v5_rehomed_plans", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Dataset002' ELSE 'Dataset003' END AS dataset, CASE WHEN p_partkey % 2 = 0 THEN 'moved_3d_' || p_size ELSE p_brand || '_2d' END AS identifier FROM part")
def v5(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") < 10, "Dataset001").otherwise("Dataset003").alias("dataset"), F.lit("plans").alias("plans_name"),
                                      F.when(F.col("p_partkey") % 2 == 0, text("plans_3d_", F.col("p_size"))).otherwise(F.concat("p_brand", F.lit("_2d"))).alias("identifier"))
    return R.rehomed(p, "Dataset001", "Dataset002", "moved").select("p_partkey", "dataset", "identifier")


@query("v7_patients", "SELECT n_nationkey AS id, n_name AS name, coalesce(try_cast(replace(n_name, 'NATION_1', '') AS INT), -1) AS age FROM nation")
def v7(spark, d):
    import uuid

    path = f"{checkpoint_folder(spark)}/patients-{uuid.uuid4().hex}"
    read(spark, d, "nation").select("n_name", F.replace("n_name", F.lit("NATION_1"), F.lit("")).alias("age"), "n_nationkey").write.option("header", True).csv(path)
    t = S_TABLES.read_patients(spark, path, {"n_nationkey": "int", "n_name": "string", "age": "int"})
    return t.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.coalesce("age", F.lit(-1)).alias("age"))


@query("v8_unstacked", "SELECT 'v' || (l_suppkey % 9) || '_000' || CASE WHEN l_suppkey % 9 < 5 THEN l_linenumber ELSE 0 END || '.nii.gz' AS file, count(*) AS n, sum(l_quantity) AS v FROM lineitem GROUP BY 1")
def v8(spark, d):
    v = read(spark, d, "lineitem").select(text("v", F.col("l_suppkey") % 9).alias("name"), F.lit(".nii.gz").alias("ending"), F.when(F.col("l_suppkey") % 9 < 5, 4).otherwise(3).alias("rank"), F.col("l_linenumber").alias("t"),
                                          F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("l_orderkey").alias("x"), F.col("l_quantity").alias("v"))
    return S_TABLES.unstacked(v).groupBy("file").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query("v9_migrated", """SELECT p_partkey, '{"channel_names":{"0":"CT"},"labels":{' || CASE WHEN p_name > 'background' THEN '"background":0,"' || p_name || '":' || p_size ELSE '"' || p_name || '":' || p_size || ',"background":0' END || '},"file_ending":".nii.gz","numTraining":' || p_partkey || '}' AS description FROM part""")
def v9(spark, d):
    old = text('{"labels":{"0":"background","', F.col("p_size"), '":"', F.col("p_name"), '"},"modality":{"0":"CT"},"training":["a"],"numTraining":', F.col("p_partkey"), "}")
    return read(spark, d, "part").select("p_partkey", R.migrated(old).alias("description"))


@query("v11_label_problems", "SELECT 'ignore must be the largest label' AS problem FROM (SELECT max(n_nationkey) m FROM nation) WHERE m <> 98")
def v11(spark, d):
    n = read(spark, d, "nation").select(F.when(F.col("n_nationkey") == 0, "background").otherwise(F.col("n_name")).alias("name"), F.col("n_nationkey").alias("value"))
    return K.label_problems(n.unionByName(spark.createDataFrame([("ignore", 99)], "name string, value int")))


@query("v12_input_channels", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1 + p_size ELSE 1 END AS n FROM part")
def v12(spark, d):
    return read(spark, d, "part").select("p_partkey", P.input_channels(F.lit(1), F.col("p_size"), F.col("p_partkey") % 2 == 0).alias("n"))


@query("v14_commands", "SELECT p_partkey, 'predict -d ' || p_partkey || ' -i INPUT -o OUTPUT -f 0 ' || p_size || ' -tr ' || p_type || ' -c 3d -p ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' --save_probabilities' ELSE '' END AS command FROM part")
def v14(spark, d):
    c = R.inference_command(F.col("p_partkey").cast("string"), F.lit("3d"), F.col("p_brand"), F.col("p_type"), F.array(F.lit(0), F.col("p_size")), F.col("p_size") % 2 == 0)
    return read(spark, d, "part").select("p_partkey", c.alias("command"))


@query("v20_relative_paths", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'cases/' ELSE '/other/' END || p_name AS path FROM part")
def v20(spark, d):
    path = F.concat(F.when(F.col("p_size") % 2 == 0, "/data/cases/").otherwise("/other/"), "p_name")
    return read(spark, d, "part").select("p_partkey", R.relative(path, F.lit("/data/")).alias("path"))


@query("m17_fastest_epochs", "SELECT user_id, round(min(s), 6) AS seconds, max(t) AS last FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 s, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') t FROM events) GROUP BY 1")
def m17(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("ts").alias("at"))
    last = e.groupBy("user_id").agg(F.max(R.utc_stamp(F.col("at"))).alias("last"))
    return R.fastest_epoch(e, "user_id").withColumn("seconds", F.round("seconds", 6)).join(last, "user_id")


@query("a30_target_spacing", """WITH s AS (SELECT l_linenumber % 3 axis, l_quantity * CASE WHEN l_linenumber % 3 = 0 THEN 9 ELSE 1 END sp, l_orderkey % 100 + CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 900 END n FROM lineitem),
m AS (SELECT axis, quantile_cont(sp, 0.5) sp, quantile_cont(sp, 0.1) p, quantile_cont(n, 0.5) n FROM s GROUP BY 1), w AS (SELECT axis w FROM m ORDER BY sp DESC, axis LIMIT 1), o AS (SELECT max(sp) os, min(n) o FROM m, w WHERE axis <> w)
SELECT axis, round(CASE WHEN axis = w AND sp > 3 * os AND n * 3 < o THEN CASE WHEN p < os THEN greatest(os, p) + 1e-5 ELSE p END ELSE sp END, 7) AS spacing FROM m, w, o""")
def a30(spark, d):
    l = read(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("axis"), F.col("l_orderkey").alias("case_id"), "l_quantity")
    worst = F.col("axis") == 0
    t = S.target_spacing(l.select("case_id", "axis", (F.col("l_quantity") * F.when(worst, 9).otherwise(1)).alias("spacing")), l.select("case_id", "axis", (F.col("case_id") % 100 + F.when(worst, 0).otherwise(900)).alias("size")))
    return t.select("axis", F.round("spacing", 7).alias("spacing"))


@query("a31_axis_order", """WITH s AS (SELECT p_partkey % 50 k, p_size % 3 axis, max(p_retailprice) sp FROM part GROUP BY 1, 2 HAVING true), c AS (SELECT k FROM s GROUP BY 1 HAVING count(*) = 3), f AS (SELECT s.*, first_value(axis) OVER (PARTITION BY k ORDER BY sp DESC, axis) w FROM s JOIN c USING (k)),
g AS (SELECT k, axis, w, row_number() OVER (PARTITION BY k ORDER BY axis <> w, axis) - 1 forward FROM f) SELECT a.k, a.axis, a.forward, b.axis AS backward FROM g a JOIN g b ON a.k = b.k AND b.forward = a.axis""")
def a31(spark, d):
    s = read(spark, d, "part").groupBy((F.col("p_partkey") % 50).alias("k"), (F.col("p_size") % 3).alias("axis")).agg(F.max("p_retailprice").alias("spacing"))
    whole = s.groupBy("k").agg(F.count("*").alias("n")).where("n = 3").select("k")
    return P.axis_order(s.join(whole, "k"), "k")


@query("a31_normalization", "SELECT p_partkey, CASE lower(c) WHEN 'ct' THEN 'ct' WHEN 'nonorm' THEN 'none' WHEN 'rgb_to_0_1' THEN 'rgb' ELSE 'zscore' END AS scheme, lower(c) NOT IN ('ct', 'rgb_to_0_1') AND p_retailprice / 2000 < 0.75 AS use_mask FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN 'CT' WHEN 1 THEN 'noNorm' WHEN 2 THEN 'rgb_to_0_1' ELSE p_name END c FROM part)")
def a31n(spark, d):
    c = read(spark, d, "part").withColumn("channel", F.when(F.col("p_size") % 4 == 3, F.col("p_name")).otherwise(F.element_at(F.array(*map(F.lit, ("CT", "noNorm", "rgb_to_0_1", ""))), F.col("p_size") % 4 + 1)))
    return P.normalization(c, F.col("p_retailprice") / 2000).select("p_partkey", "scheme", "use_mask")


#: Places of volumes in a part.
PLACES = 100_000


@query("a39_mirrored_mean", """WITH v AS (SELECT case_id, z, y, x, max(v) v FROM gen_voxels WHERE z BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4), m AS (SELECT case_id, z, y, x, v FROM v UNION ALL SELECT case_id, 7 - z, y, x, v + 1 FROM v UNION ALL SELECT case_id, z, 63 - y, x, v + 2 FROM v UNION ALL SELECT case_id, 7 - z, 63 - y, x, v + 3 FROM v)
SELECT case_id, z, y, x, round(avg(v), 7) AS v FROM m GROUP BY 1, 2, 3, 4""", "gen_voxels")
def a39(spark, d):
    v = generated(spark, d, "gen_voxels").where("z BETWEEN 0 AND 7").select("case_id", "z", "y", "x", "v")
    # mirror images of a place keep its case and x, so all is found where the places are dealt out to
    v = v.repartition(parts_for(v, PLACES), "case_id", "x").groupBy("case_id", "z", "y", "x").agg(F.max("v").alias("v"))
    flips = F.explode(F.array(*(F.struct(F.lit(f).alias("flip"), F.lit(float(k)).alias("more")) for k, f in enumerate(("", "z", "y", "z,y")))))
    # what is predicted at a place of a mirrored image shows there
    p = v.select("case_id", flips.alias("f"), F.lit(0).alias("c"), "z", "y", "x", "v").select("case_id", "f.flip", "c", "z", "y", "x", (F.col("v") + F.col("f.more")).alias("v"))
    return P.mirrored_mean(p, {"z": 8, "y": 64, "x": 1 << 20}, ["z", "y"]).select("case_id", "z", "y", "x", F.round("v", 7).alias("v"))


@query("w10_spread_starts", "SELECT p_partkey, array_to_string(list_transform(range(0, CASE WHEN p_size <= 8 THEN 1 ELSE ceil((p_size - 8) / 4.0)::INT + 1 END), lambda k: CASE WHEN p_size <= 8 THEN 0 ELSE round_even((p_size - 8) / (ceil((p_size - 8) / 4.0)) * k, 0)::INT END), ',') AS starts FROM part")
def w10(spark, d):
    return read(spark, d, "part").select("p_partkey", F.array_join(sampling.spread_starts(F.col("p_size"), F.lit(8), 0.5).cast("array<string>"), ",").alias("starts"))


@query("w17_patch_starts", "SELECT p_partkey, low, high, CASE WHEN p_size % 2 = 0 THEN greatest(low, p_size - 12) ELSE low + p_partkey % (high - low + 1) END AS start FROM (SELECT *, -ceil(pad / 2.0)::INT low, (n + ceil(pad / 2.0) - 24)::INT high FROM (SELECT p_partkey, p_size, n, greatest(4, 24 - n) pad FROM (SELECT *, p_partkey % 60 + 5 n FROM part)))")
def w17(spark, d):
    p = read(spark, d, "part").withColumn("b", P.patch_bounds((F.col("p_partkey") % 60 + 5).cast("int"), F.lit(24), F.lit(4)))
    return p.select("p_partkey", "b.low", "b.high", P.patch_start(F.col("b"), F.lit(24), F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.col("p_partkey")).alias("start"))


MASK = "SELECT DISTINCT case_id, z, y, x FROM gen_voxels WHERE ref = 1"
ALL = "SELECT DISTINCT case_id, z, y, x FROM gen_voxels"
NEAR = "SELECT DISTINCT case_id, z + dz z, y + dy y, x + dx x FROM {0}, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) s(dz,dy,dx)"


def masks(spark, d):
    v = generated(spark, d, "gen_voxels")
    return v.where("ref = 1").select(*G.PLACE).distinct(), v.select(*G.PLACE).distinct()


@query("m16_dilated", f"WITH m AS ({MASK}), a AS ({ALL}) SELECT n.case_id, n.z, n.y, n.x FROM ({NEAR.format('m')}) n JOIN a USING (case_id, z, y, x)", "gen_voxels")
def m16d(spark, d):
    return G.dilated(*masks(spark, d))


@query("m16_eroded", f"WITH m AS ({MASK}), a AS ({ALL}), o AS (SELECT * FROM a EXCEPT SELECT * FROM m) SELECT * FROM m EXCEPT {NEAR.format('o')}", "gen_voxels")
def m16e(spark, d):
    return G.eroded(*masks(spark, d))


@query("m16_regions", "SELECT case_id, z, y, x, (ref IN (1, 2))::INT AS region_0, (ref = 3)::INT AS region_1 FROM gen_voxels", "gen_voxels")
def m16r(spark, d):
    v = generated(spark, d, "gen_voxels").withColumn("label", F.col("ref"))
    return G.to_regions(v, [[1, 2], [3]]).select("case_id", "z", "y", "x", "region_0", "region_1")


@query("m16_masked_channels", "SELECT case_id, z // 2 AS z, y // 2 AS y, x // 2 AS x, c, CASE WHEN c = 3 THEN (ref = 1)::INT ELSE (ref = 2)::INT END::DOUBLE AS v FROM gen_voxels, (VALUES (3), (4)) t(c) WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0", "gen_voxels")
def m16c(spark, d):
    v = generated(spark, d, "gen_voxels").withColumn("label", F.col("ref"))
    return G.labels_as_channels(G.downsampled(v, {"z": 2, "y": 2, "x": 2}), [1, 2], 3)


@query("m16_slices", "SELECT case_id, ref AS c, z, y, x, CASE WHEN y < 9 THEN v ELSE -1 END AS v FROM gen_voxels", "gen_voxels")
def m16s(spark, d):
    v = generated(spark, d, "gen_voxels").withColumnRenamed("ref", "c")
    return G.masked(G.channels_as_slices(G.slices_as_channels(v, 16), 16), F.col("y") < 9, -1.0)


@query("m15_top_share", "SELECT l_returnflag, round(avg(l_extendedprice), 6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) k, count(*) OVER (PARTITION BY l_returnflag) n FROM lineitem) WHERE k <= greatest(floor(n * 0.1), 1) GROUP BY 1")
def m15(spark, d):
    l = read(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("loss"), F.col("l_orderkey").alias("id"))
    return losses.top_share_mean(l, 0.1, "l_returnflag").withColumn("loss", F.round("loss", 6))


@query("m15_supervised", "SELECT l_linestatus, round(sum(CASE l WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END / 15.0 * (m + 2 * t)), 7) AS loss FROM (SELECT l_linestatus, l_linenumber % 5 l, avg(l_discount) m, max(l_tax) t FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def m15s(spark, d):
    l = read(spark, d, "lineitem").groupBy("l_linestatus", (F.col("l_linenumber") % 5).alias("level")).agg(F.avg("l_discount").alias("m"), F.max("l_tax").alias("t"))
    return losses.supervised(l.withColumn("loss", losses.compound(F.col("m"), F.col("t"), 1.0, 2.0)), 5, "l_linestatus").withColumn("loss", F.round("loss", 7))


@query("m13_image_tokens", "SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY t, k) - 1 AS pos, t AS type_id, l AS region_label FROM (SELECT c_nationkey case_id, 0 t, c_custkey k, 0 l FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey, s_suppkey % 49 FROM supplier)")
def m13(spark, d):
    g = read(spark, d, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("token"), F.lit(0.0).alias("feat"))
    r = read(spark, d, "supplier").select(F.col("s_nationkey").alias("case_id"), F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 49).alias("label"), F.lit(0.0).alias("feat"))
    return V.image_tokens(g, r).select("case_id", "pos", "type_id", "region_label")


@query("m4_rescaled", "SELECT l_orderkey, l_linenumber, round((l_quantity - min(l_quantity) OVER w) / greatest(max(l_quantity) OVER w - min(l_quantity) OVER w, 1e-8), 7) AS v, round((least(greatest(l_quantity, 5), 40) - 20) / 9, 7) AS ct FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def m4(spark, d):
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("case_id"), F.lit(0).alias("c"), F.col("l_quantity").alias("v"), F.round(V.ct_normalize(F.col("l_quantity"), 20.0, 9.0, 5.0, 40.0), 7).alias("ct"))
    return V.rescale(l).select("l_orderkey", "l_linenumber", F.round("v", 7).alias("v"), "ct")


@query("a43_adopted", "SELECT coalesce(avg(a) > avg(b), false) AND count(*) FILTER (a < b) = 0 AS adopt FROM (SELECT l_linenumber, avg(l_discount) b, avg(l_discount + l_tax) a FROM lineitem GROUP BY 1)")
def a43(spark, d):
    l = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("region")).agg(F.avg("l_discount").alias("b"), F.avg(F.col("l_discount") + F.col("l_tax")).alias("a"))
    return S.adopt_postprocessing(l.select("region", F.col("b").alias("dice")), l.select("region", F.col("a").alias("dice")))


@query("a44_balanced_slice", "WITH n AS (SELECT case_id, z, ref, count(*) n FROM gen_voxels WHERE ref > 0 GROUP BY 1, 2, 3), s AS (SELECT case_id, z, sum(n / t) m FROM (SELECT *, sum(n) OVER (PARTITION BY case_id, ref) t FROM n) GROUP BY 1, 2) SELECT case_id, z FROM s QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY m DESC, z) = 1", "gen_voxels")
def a44(spark, d):
    return S.balanced_slice(generated(spark, d, "gen_voxels").withColumnRenamed("ref", "label"))


@query("j10_paired_files", "SELECT DISTINCT o_custkey AS file FROM orders")
def j10(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("file"))
    return S.paired_files(read(spark, d, "customer").select(F.col("c_custkey").alias("file")), o, strict=False)


@query("j13_accumulated_folds", "SELECT o_orderkey AS case_id, o_orderkey % 5 AS fold FROM orders")
def j13(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 5).alias("fold"))
    return S.accumulated_folds([o.where(F.col("fold") == k) for k in range(5)])


@query("a42_case_problems", "SELECT * FROM (SELECT p_partkey AS case_id, unnest(list_filter([CASE WHEN p_size % 7 = 0 THEN 'channels' END, CASE WHEN p_size % 5 = 0 THEN 'shape' END, CASE WHEN p_partkey % 3 = 0 THEN 'spacing' END, CASE WHEN p_partkey % 11 = 0 THEN 'undefined values' END], lambda x: x IS NOT NULL)) AS problem FROM part)")
def a42(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    c = read(spark, d, "part").select(key.alias("case_id"), F.when(size % 7 == 0, 2).otherwise(1).alias("channels"), F.array(size, F.lit(4)).alias("image_shape"), F.array(size + F.when(size % 5 == 0, 1).otherwise(0), F.lit(4)).alias("label_shape"),
                                      F.array(F.lit(0.3), F.lit(1.0)).alias("image_spacing"), F.array(F.lit(0.3), F.when(key % 3 == 0, 1.1).otherwise(1.0)).alias("label_spacing"), F.when(key % 11 == 0, 1).otherwise(0).alias("undefined"))
    return S.case_problems(c, 1)


@query("a46_of_version", "SELECT p_partkey, p_retailprice AS epoch_seconds FROM part WHERE p_type = 'ECONOMY' AND p_size % 3 = 1 AND p_partkey % 2 = 1")
def a46(spark, d):
    r = read(spark, d, "part").select("p_partkey", F.col("p_type").alias("torch"), (F.col("p_size") % 3).alias("cudnn"), (F.col("p_partkey") % 2).alias("gpus"), F.col("p_retailprice").alias("epoch_seconds"))
    return S.of_version(r, "ECONOMY", 1, 1).select("p_partkey", "epoch_seconds")


@query("a49_masked_batch_dice", "SELECT l_linenumber, round((2 * sum(tp * tp) + 1) / greatest(2 * sum(tp * tp) + sum(fp * fp) + sum(fn * fn) + 1, 1e-8), 7) AS dice FROM (SELECT l_linenumber, l_discount * y tp, l_discount * (1 - y) fp, (1 - l_discount) * y fn FROM (SELECT *, (l_returnflag = 'A')::INT::DOUBLE y FROM lineitem WHERE l_linestatus = 'F')) GROUP BY 1")
def a49(spark, d):
    l = read(spark, d, "lineitem").select("l_linenumber", "l_suppkey", F.col("l_discount").alias("p"), (F.col("l_returnflag") == "A").cast("double").alias("y"), (F.col("l_linestatus") == "F").alias("mask"))
    return losses.soft_dice(l, ["l_linenumber", "l_suppkey"], squared=True, over="l_suppkey").withColumn("dice", F.round("dice", 7))


@query("w14_by_name", "SELECT event_id, round(CASE WHEN i < 10 THEN 0.001 * i / 10 ELSE 0.001 * 0.5 * (1 + cos(pi() * least((i - 10) / 90.0, 1.0))) END, 9) AS cosine, round(0.01 * pow(1 - i / 100.0, 0.9), 9) AS poly, 0.5 AS constant FROM (SELECT event_id, event_id % 100 i FROM events)")
def w14(spark, d):
    s = F.col("event_id") % 100
    return read(spark, d, "events").select("event_id", F.round(sampling.schedule("cosine", s, 0.001, 100, percent=10.0), 9).alias("cosine"), F.round(sampling.schedule("poly", s, 0.01, 100), 9).alias("poly"), sampling.schedule("constant", s, 0.5, 100).alias("constant"))


#: A configuration a part; one stage a step.
CONFIGURED = "SELECT p_partkey, [4 + 4 * p_size, 64, 32 * (p_partkey % 5 + 1)] AS size, [1.0 + p_partkey % 4, 1, 1 + 0.5 * (p_partkey % 3)]::DOUBLE[] AS space FROM part"
AXES = "list_filter([1, 2, 3], lambda a: size[a] >= 8)"


@query("a31_topology", f"""WITH RECURSIVE c AS ({CONFIGURED}),
run AS (SELECT p_partkey, 0 AS k, size, space, [0, 0, 0] AS pools, [1, 1, 1] AS near, '1,1,1' AS strides, '' AS kernels FROM c
 UNION ALL SELECT p_partkey, k + 1, list_transform(size, lambda n, a: CASE WHEN list_contains(chosen, a) THEN (n + 1) // 2 ELSE n END), list_transform(space, lambda s, a: CASE WHEN list_contains(chosen, a) THEN 2 * s ELSE s END),
  list_transform(pools, lambda p, a: CASE WHEN list_contains(chosen, a) THEN p + 1 ELSE p END), now, strides || ' ' || array_to_string(list_transform([1, 2, 3], lambda a: CASE WHEN list_contains(chosen, a) THEN 2 ELSE 1 END), ','), kernels || array_to_string(now, ',') || ' '
 FROM (SELECT *, list_filter({AXES}, lambda a: space[a] / list_min(list_transform({AXES}, lambda b: space[b])) < 2 AND pools[a] < 4) AS chosen, list_transform(near, lambda m, a: CASE WHEN space[a] / list_min(space) < 2 THEN 3 ELSE m END) AS now FROM run)
 WHERE len(chosen) > 1 OR (len(chosen) = 1 AND size[chosen[1]] >= 12))
SELECT p_partkey, arg_max(strides, k) AS strides, arg_max(kernels, k) || '3,3,3' AS kernels, array_to_string(arg_max(list_transform(c.size, lambda n, a: ceil(n / (2 ** pools[a]))::INT * (2 ** pools[a])::INT), k), ',') AS patch FROM run JOIN c USING (p_partkey) GROUP BY p_partkey""")
def a31t(spark, d):
    patch = F.array(4 + 4 * F.col("p_size"), F.lit(64), (32 * (F.col("p_partkey") % 5 + 1)).cast("int"))
    spacing = F.array(1.0 + F.col("p_partkey") % 4, F.lit(1.0), 1 + 0.5 * (F.col("p_partkey") % 3))
    t = P.topologies(read(spark, d, "part").select("p_partkey", patch.cast("array<int>").alias("patch"), spacing.alias("spacing")), 4, 4)
    joined = lambda c: F.array_join(F.transform(c, lambda k: F.array_join(k.cast("array<string>"), ",")), " ")
    return t.select("p_partkey", joined(F.col("t.strides")).alias("strides"), joined(F.col("t.kernels")).alias("kernels"), F.array_join(F.col("t.patch").cast("array<string>"), ",").alias("patch"))


@query("v6_prefix_folds", "SELECT DISTINCT o_orderpriority AS id, o_orderpriority[1]::INT - 1 AS fold FROM orders WHERE o_orderpriority[1] IN ('1', '2')")
def v6p(spark, d):
    return SPLIT.prefix_folds(read(spark, d, "orders").select(F.col("o_orderpriority").alias("id")), ["1", "2"])


@query("v6_vendor_counts", "SELECT p_brand AS vendor, least(25, count(*)) AS valid, count(*) - least(25, count(*)) AS train, (count(*) - least(25, count(*)))::BIGINT AS own FROM part GROUP BY 1")
def v6v(spark, d):
    s = SPLIT.vendor_split(read(spark, d, "part").select(F.col("p_brand").alias("vendor"), F.col("p_partkey").alias("patient")), 25, 42)
    n = s.groupBy("vendor").agg(F.count_if(F.col("split") == "valid").alias("valid"), F.count_if(F.col("split") == "train").alias("train"))
    mixed = SPLIT.mixed_halves(s)
    return n.join(mixed.where("train_set = vendor").groupBy("vendor").agg(F.count("*").alias("own")), "vendor")


@query("v6_frames", "SELECT o_orderkey AS patient, o_orderkey || '_' || lpad(k::VARCHAR, 4, '0') AS frame FROM (SELECT o_orderkey, unnest([o_custkey % 30, 30 + o_custkey % 30]) k FROM orders)")
def v6f(spark, d):
    c = F.col("o_custkey") % 30
    f = SPLIT.frames(read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("patient"), c.alias("ed"), (c + 30).alias("es")))
    return f.withColumn("patient", F.col("patient").cast("long"))


@query("v13_sigmoid", "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity - 25) / 5)), 9) AS p FROM lineitem")
def v13(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.sigmoid((F.col("l_quantity") - 25) / 5), 9).alias("p"))


@query("m1_grid_affine", "SELECT p_partkey, round(0.3 * p_size, 7) AS step, round(10 + 0.3 * (p_partkey % 50 + (p_size - 1) / 2.0), 7) AS start FROM part")
def m1(spark, d):
    affine = F.array(*(F.array(*map(F.lit, r)) for r in ((0.3, 0.0, 0.0, 10.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))))
    g = V.grid_affine(affine, F.array(F.col("p_partkey") % 50, F.lit(0), F.lit(0)), F.array(F.col("p_size"), F.lit(1), F.lit(1)))
    return read(spark, d, "part").select("p_partkey", g.alias("g")).select("p_partkey", F.round(F.col("g")[0][0], 7).alias("step"), F.round(F.col("g")[0][3], 7).alias("start"))


@query("m3_separate_axis", "SELECT p_partkey, CASE WHEN p_size > 3 THEN p_partkey % 3 ELSE -1 END::INT AS axis FROM part")
def m3(spark, d):
    s = F.array(*(F.when(F.col("p_partkey") % 3 == k, F.col("p_size").cast("double")).otherwise(1.0) for k in range(3)))
    return read(spark, d, "part").select("p_partkey", F.coalesce(V.separate_axis(s), F.lit(-1)).alias("axis"))


@query("m4_masked_z_score", "SELECT l_orderkey, l_linenumber, round(CASE WHEN i THEN (l_quantity - avg(CASE WHEN i THEN l_quantity END) OVER w) / greatest(stddev_pop(CASE WHEN i THEN l_quantity END) OVER w, 1e-8) ELSE 0 END, 6) AS v, round(l_quantity / 255, 9) AS rgb FROM (SELECT *, l_tax > 0.02 i FROM lineitem) WINDOW w AS (PARTITION BY l_suppkey)")
def m4z(spark, d):
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("case_id"), F.lit(0).alias("c"), F.col("l_quantity").alias("v"), (F.col("l_tax") > 0.02).alias("inside"), F.round(V.rgb_normalize(F.col("l_quantity")), 9).alias("rgb"))
    return V.masked_z_score(l).select("l_orderkey", "l_linenumber", F.round("v", 6).alias("v"), "rgb")


@query("m6_least_weight", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN (SELECT min(p_size) FROM part WHERE p_size % 4 > 0) ELSE p_size END::DOUBLE AS g FROM part")
def m6(spark, d):
    return V.least_weight(read(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 4 == 0, 0).otherwise(F.col("p_size")).cast("double").alias("g")))
