"""Queries over balls, windows and weighted samples. Q: name -> (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylake.functions import losses
from quarrylake.operators import morphology as M
from quarrylake.operators import windows as WI
from quarrylake.plans.generated import generated, with_tables

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        Q[name] = (f, with_tables(sql, *tables) if sql and tables else sql)
        return f

    return add


#: The places of a case without gaps: all z and y, and x up to the last.
BLOCK = "b AS (SELECT case_id, max(x) AS n FROM gen_voxels GROUP BY 1), a AS (SELECT case_id, z, y, unnest(range(0, n + 1)) AS x FROM b, range(1, 8) r(z), range(0, 64) s(y))"
MASK = "m AS (SELECT DISTINCT case_id, z, y, x FROM gen_voxels WHERE ref = 1)"


def reached(source: str, name: str) -> str:
    """CTEs that end in name: the places of a at a squared distance of 6.25 at most from source, least squares along one axis after the other."""
    step = "SELECT case_id, {k}, min(d2 + d * d) AS d2 FROM {t}, range(-2, 3) o(d) GROUP BY ALL"
    return (f"{name}x AS ({step.format(k='z, y, x + d AS x', t=f'(SELECT *, 0 AS d2 FROM {source})')}), {name}y AS ({step.format(k='z, y + d AS y, x', t=f'{name}x')}), "
            f"{name}z AS ({step.format(k='z + d AS z, y, x', t=f'{name}y')}), {name} AS (SELECT case_id, z, y, x FROM {name}z JOIN a USING (case_id, z, y, x) WHERE d2 <= 6.25)")


def block(spark, d):
    """(box, mask) of all cases."""
    v = generated(spark, d, "gen_voxels")
    box = v.groupBy("case_id").agg((F.max("x") + 1).alias("x1"))
    box = box.select("case_id", *(F.lit(k).alias(n) for n, k in (("z0", 1), ("z1", 8), ("y0", 0), ("y1", 64), ("x0", 0))), "x1")
    return box, v.where("ref = 1").select("case_id", "z", "y", "x")


@query("m16_ball_dilated", f"WITH {BLOCK}, {MASK}, {reached('m', 'big')} SELECT case_id, z::INT AS z, y::INT AS y, x::INT AS x FROM big", "gen_voxels")
def m16_dilated(spark, d):
    within, mask = block(spark, d)
    return M.ball_dilated(mask, within, 2.5)


@query("m16_ball_closed", f"WITH {BLOCK}, {MASK}, {reached('m', 'big')}, rest AS (SELECT * FROM a EXCEPT SELECT * FROM big), {reached('rest', 'near')} SELECT case_id, z::INT AS z, y::INT AS y, x::INT AS x FROM (SELECT * FROM big EXCEPT SELECT * FROM near)", "gen_voxels")
def m16_closed(spark, d):
    within, mask = block(spark, d)
    return M.ball_closed(mask, within, 2.5)


@query("a39_windows", """WITH v AS (SELECT case_id, z, y, x, max(v) AS v FROM gen_voxels GROUP BY ALL), b AS (SELECT case_id, max(x) + 1 AS n FROM v GROUP BY 1),
wz(s) AS (VALUES (0), (2), (4)), wy(s) AS (VALUES (0), (16), (32)),
kx AS (SELECT case_id, greatest(n, 40) AS n, (greatest(n, 40) - n) // 2 AS pad, CASE WHEN n <= 40 THEN 1 ELSE ceil((n - 40) / 20.0)::INT + 1 END AS k FROM b),
wx AS (SELECT case_id, pad, CASE WHEN k = 1 THEN 0 ELSE round_even((n - 40) / (k - 1)::DOUBLE * i, 0) END::INT AS s FROM (SELECT *, unnest(range(0, k)) AS i FROM kx)),
f(fz, fx) AS (VALUES (0, 0), (1, 0), (0, 1), (1, 1)),
w AS (SELECT v.case_id, z, y, x, v, z - wz.s AS oz, y - wy.s AS oy, x + pad - wx.s AS ox FROM v JOIN wz ON z >= wz.s AND z < wz.s + 4 JOIN wy ON y >= wy.s AND y < wy.s + 32 JOIN wx ON wx.case_id = v.case_id AND x + pad >= wx.s AND x + pad < wx.s + 40),
g AS (SELECT *, exp(-0.5 * ((oz - 2) / 0.5) ** 2) * exp(-0.5 * ((oy - 16) / 4.0) ** 2) * exp(-0.5 * ((ox - 20) / 5.0) ** 2) AS g FROM w)
SELECT case_id, z, y, x, round(sum(g * (v + 0.25 * CASE WHEN fz = 1 THEN 3 - oz ELSE oz END - 0.5 * CASE WHEN fx = 1 THEN 39 - ox ELSE ox END)) / sum(g), 6) AS v FROM g, f GROUP BY case_id, z, y, x""", "gen_voxels")
def a39_windows(spark, d):
    v = generated(spark, d, "gen_voxels").groupBy("case_id", "z", "y", "x").agg(F.max("v").alias("v")).withColumn("c", F.lit(0))
    sizes = v.groupBy("case_id").agg((F.max("x") + 1).alias("x")).select("case_id", F.lit(8).alias("z"), F.lit(64).alias("y"), "x")
    model = lambda w: w.withColumn("v", F.col("v") + 0.25 * F.col("z") - 0.5 * F.col("x"))
    p = WI.sliding_prediction(v, sizes, {"z": 4, "y": 32, "x": 40}, [model], 0.5, ("z", "x"))
    return p.select("case_id", "z", "y", "x", F.round("v", 6).alias("v"))


@query("m8_sample_weights", """WITH e AS (SELECT vec_id % 20 s, CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END l, CASE WHEN vec_id % 20 = 3 THEN 0 ELSE vec_id % 3 END w, embedding::DOUBLE[] x FROM embeddings),
c AS (SELECT s, l, w, list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) - x[l + 1] ce FROM e WHERE l <> -100),
p AS (SELECT s, sum(ce * w) / greatest(sum(w), 1e-8) AS loss, sum(w) AS active, sum(ce) AS total, count(*) AS n FROM c GROUP BY 1)
SELECT round(avg(CASE WHEN active > 0 THEN loss * (1 + s / 10.0) END), 9)::DOUBLE AS weighted, round(sum(total) / sum(n), 9)::DOUBLE AS unweighted FROM p""")
def m8_weights(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    s = (F.col("vec_id") % 20).alias("sample")
    weight = F.when(F.col("vec_id") % 20 == 3, 0).otherwise(F.col("vec_id") % 3).cast("double")
    tokens = e.select(s, F.col("embedding").cast("array<double>").alias("logits"), F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("label")).alias("label"), weight.alias("weight"))
    samples = e.select(s).distinct().withColumn("sample_weight", 1 + F.col("sample") / 10)
    return losses.sample_weighted_loss(tokens, samples).select(F.round("weighted", 9).alias("weighted"), F.round("unweighted", 9).alias("unweighted"))
