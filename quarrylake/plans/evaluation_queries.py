"""Queries over predictions, segmentations and volumes. Q: name -> (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylake.functions import losses
from quarrylake.functions import similarity
from quarrylake.operators import clinical as C
from quarrylake.operators import segmentation as S
from quarrylake.operators import voxels as V
from quarrylake.plans.generated import generated, with_tables

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        Q[name] = (f, with_tables(sql, *tables) if sql and tables else sql)
        return f

    return add


def rounded(df, *cols: str, digits: int = 9):
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols})


BOTH = ("gen_predicted", "gen_reference")


def both(spark, d):
    return generated(spark, d, BOTH[0]), generated(spark, d, BOTH[1])


def PRF(tp: str, fp: str, fn: str) -> str:
    p, r = f"(CASE WHEN {tp}+{fp}>0 THEN {tp}*1.0::DOUBLE/({tp}+{fp}) ELSE 0 END)", f"(CASE WHEN {tp}+{fn}>0 THEN {tp}*1.0::DOUBLE/({tp}+{fn}) ELSE 0 END)"
    return f"round({p},9)::DOUBLE AS precision, round({r},9)::DOUBLE AS recall, round(CASE WHEN {p}+{r}>0 THEN 2*{p}*{r}/({p}+{r}) ELSE 0 END,9)::DOUBLE AS f1"


TOOTH = """p AS (SELECT DISTINCT case_id, tooth_number, concept, polarity FROM gen_predicted WHERE tooth_number IS NOT NULL), r AS (SELECT DISTINCT case_id, tooth_number, concept, polarity FROM gen_reference WHERE tooth_number IS NOT NULL),
tc AS (SELECT coalesce(p.case_id, r.case_id) case_id, coalesce(p.tooth_number, r.tooth_number) tooth_number, count(*) FILTER (p.case_id IS NOT NULL AND r.case_id IS NOT NULL) tp, count(*) FILTER (r.case_id IS NULL) fp, count(*) FILTER (p.case_id IS NULL) fn, count(r.case_id) support
 FROM p FULL JOIN r ON p.case_id=r.case_id AND p.tooth_number=r.tooth_number AND p.concept=r.concept AND p.polarity=r.polarity GROUP BY 1, 2)"""
ALL_TEETH = "(SELECT CAST(q AS VARCHAR) || CAST(p AS VARCHAR) tooth_number FROM range(1,5) a(q), range(1,9) b(p))"
PER_TOOTH = f"{TOOTH}, pt AS (SELECT t.tooth_number, coalesce(sum(tp),0)::BIGINT tp, coalesce(sum(fp),0)::BIGINT fp, coalesce(sum(fn),0)::BIGINT fn, coalesce(sum(support),0)::BIGINT support FROM {ALL_TEETH} t LEFT JOIN tc USING (tooth_number) GROUP BY 1)"


@query("j4_tooth_counts", f"WITH {TOOTH} SELECT case_id, tooth_number, tp, fp, fn, support FROM tc", *BOTH)
def j4(spark, d):
    return C.tooth_counts(*both(spark, d))


@query("a8_tooth_metrics", f"WITH {PER_TOOTH} SELECT *, {PRF('tp', 'fp', 'fn')} FROM pt", *BOTH)
def a8(spark, d):
    return rounded(C.tooth_metrics(*both(spark, d)), "precision", "recall", "f1")


@query("a7_tooth_summary", f"""WITH {PER_TOOTH}, m AS (SELECT *, {PRF('tp', 'fp', 'fn')} FROM pt), u AS (SELECT {PRF('sum(tp)', 'sum(fp)', 'sum(fn)')} FROM pt)
SELECT precision AS precision_micro, recall AS recall_micro, f1 AS f1_micro, (SELECT round(avg(precision),6) FROM m WHERE support>0) AS precision_macro, (SELECT round(avg(recall),6) FROM m WHERE support>0) AS recall_macro, (SELECT round(avg(f1),6) FROM m WHERE support>0) AS f1_macro FROM u""", *BOTH)
def a7(spark, d):
    s = rounded(C.tooth_summary(*both(spark, d)), "precision_micro", "recall_micro", "f1_micro")
    return rounded(s, "precision_macro", "recall_macro", "f1_macro", digits=6)


NEUTRAL = "coalesce(CASE WHEN tooth_number[1] IN ('1','2') THEN 'upper' ELSE 'lower' END || tooth_number[2], '~') neutral, coalesce(anatomy, '~') anat"


@query("a9_side_agreement", f"""WITH p AS (SELECT *, {NEUTRAL} FROM gen_predicted WHERE side IS NOT NULL), r AS (SELECT case_id, concept, neutral, anat, polarity, list(DISTINCT side) sides FROM (SELECT *, {NEUTRAL} FROM gen_reference WHERE side IS NOT NULL) GROUP BY ALL),
j AS (SELECT p.side, list_contains(sides, p.side) ok FROM p JOIN r USING (case_id, concept, neutral, anat, polarity))
SELECT count(*) AS comparable, count(*) FILTER (ok) AS correct, count(*) FILTER (NOT ok AND side='right') AS left_to_right, count(*) FILTER (NOT ok AND side<>'right') AS right_to_left, round(count(*) FILTER (ok) * 1.0::DOUBLE / count(*), 9) AS accuracy FROM j""", *BOTH)
def a9(spark, d):
    return rounded(C.side_agreement(*both(spark, d)), "accuracy")


SUPPORT = """r AS (SELECT case_id, concept, tooth_number, anatomy, side, list(DISTINCT polarity) ps FROM gen_reference GROUP BY ALL),
s AS (SELECT p.*, CASE WHEN r.ps IS NOT NULL AND NOT list_contains(r.ps, p.polarity) THEN 'conflict' WHEN r.ps IS NOT NULL THEN 'comparable' WHEN p.polarity='positive' THEN 'unsupported' ELSE 'other' END state
 FROM gen_predicted p LEFT JOIN r ON p.case_id=r.case_id AND p.concept=r.concept AND p.tooth_number IS NOT DISTINCT FROM r.tooth_number AND p.anatomy IS NOT DISTINCT FROM r.anatomy AND p.side IS NOT DISTINCT FROM r.side)"""
CASES = "cs AS (SELECT DISTINCT case_id FROM gen_reference)"


@query("j6_support", f"WITH {SUPPORT} SELECT state, count(*) AS n FROM s GROUP BY 1", *BOTH)
def j6(spark, d):
    return C.support(*both(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


def cases(spark, d):
    return generated(spark, d, BOTH[1]).select("case_id").distinct()


@query("a10_contradiction", f"""WITH {SUPPORT}, {CASES} SELECT count(*) FILTER (state='conflict') AS total, count(*) FILTER (state IN ('conflict','comparable')) AS comparable, round(count(*) FILTER (state='conflict')*1.0::DOUBLE/count(*) FILTER (state IN ('conflict','comparable')),9) AS rate,
round(count(DISTINCT CASE WHEN state='conflict' THEN case_id END)*1.0::DOUBLE/(SELECT count(*) FROM cs),9) AS case_rate, count(*) FILTER (state='conflict' AND polarity='positive') AS positive_to_negative, count(*) FILTER (state='conflict' AND polarity='negative') AS negative_to_positive FROM s""", *BOTH)
def a10(spark, d):
    return rounded(C.contradiction(*both(spark, d), cases(spark, d)), "rate", "case_rate")


@query("a11_unsupported", f"""WITH {SUPPORT}, {CASES}, c AS (SELECT cs.case_id, count(*) FILTER (state='unsupported') u, count(*) FILTER (polarity='positive' AND state<>'conflict') c FROM cs LEFT JOIN s USING (case_id) GROUP BY 1)
SELECT sum(u)::BIGINT AS total, round(avg(CASE WHEN u>0 THEN 1.0 ELSE 0 END),9)::DOUBLE AS case_rate, round(sum(u)*1.0::DOUBLE/sum(c),9) AS rate, round(avg(u),9) AS mean, median(u)::DOUBLE AS median, max(u) AS maximum FROM c""", *BOTH)
def a11(spark, d):
    return rounded(C.unsupported(*both(spark, d), cases(spark, d)), "case_rate", "rate", "mean")


@query("a15_unsupported_by_concept", f"WITH {SUPPORT} SELECT concept, count(*) AS n FROM s WHERE state='unsupported' GROUP BY 1", *BOTH)
def a15(spark, d):
    return C.unsupported_by_concept(*both(spark, d))


SPECIFIC = """p AS (SELECT DISTINCT case_id, concept, coalesce(tooth_number,'~') t, coalesce(anatomy,'~') a, coalesce(side,'~') sd, polarity FROM gen_predicted WHERE clause_type='case-specific'), r AS (SELECT DISTINCT case_id, concept, coalesce(tooth_number,'~') t, coalesce(anatomy,'~') a, coalesce(side,'~') sd, polarity FROM gen_reference WHERE clause_type='case-specific'),
f AS (SELECT coalesce(p.case_id,r.case_id) case_id, coalesce(p.concept,r.concept) concept, (p.case_id IS NOT NULL)::INT p, (r.case_id IS NOT NULL)::INT r FROM p FULL JOIN r ON p.case_id=r.case_id AND p.concept=r.concept AND p.t=r.t AND p.a=r.a AND p.sd=r.sd AND p.polarity=r.polarity),
pc AS (SELECT case_id, sum(p*r) tp, sum(p*(1-r)) fp, sum((1-p)*r) fn, sum(r) n FROM f GROUP BY 1)"""


@query("a12_case_specific", f"""WITH {SPECIFIC}, m AS (SELECT n, {PRF('tp', 'fp', 'fn')} FROM pc), u AS (SELECT {PRF('sum(tp)', 'sum(fp)', 'sum(fn)')} FROM pc)
SELECT precision AS precision_micro, recall AS recall_micro, f1 AS f1_micro, (SELECT round(avg(precision),6) FROM m WHERE n>0) AS precision_macro, (SELECT round(avg(recall),6) FROM m WHERE n>0) AS recall_macro, (SELECT round(avg(f1),6) FROM m WHERE n>0) AS f1_macro FROM u""", *BOTH)
def a12(spark, d):
    s = rounded(C.case_specific(*both(spark, d)), "precision_micro", "recall_micro", "f1_micro")
    return rounded(s, "precision_macro", "recall_macro", "f1_macro", digits=6)


@query("a13_by_concept", f"WITH {SPECIFIC}, c AS (SELECT concept, sum(p)::BIGINT predicted, sum(r)::BIGINT reference, sum(p*r)::BIGINT matched FROM f GROUP BY 1) SELECT *, {PRF('matched', '(predicted-matched)', '(reference-matched)')} FROM c", *BOTH)
def a13(spark, d):
    return rounded(C.by_concept(*both(spark, d)), "precision", "recall", "f1")


NORMAL = "coalesce(nullif(array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' '), ''), '<empty>')"


def pairs(spark, d):
    return generated(spark, d, "gen_predictions").select("case_id", "prediction", F.array("reference", "reference2").alias("references"))


@query("a14_uniqueness", f"SELECT count(*)*1.0::DOUBLE/sum(n) AS unique_rate, max(n)::DOUBLE AS max_duplicate_count FROM (SELECT {NORMAL.format('prediction')} k, count(*) n FROM gen_predictions GROUP BY 1)", "gen_predictions")
def a14(spark, d):
    return C.uniqueness(generated(spark, d, "gen_predictions"))


@query("a16_generation_quality", f"""WITH s AS (SELECT case_id, list_filter(list_transform(string_split_regex(prediction, '[.!?;\\n]+'), lambda x: {NORMAL.format('x')}), lambda y: len(string_split(y, ' ')) >= 4) s, prediction, (length(reference)+length(reference2))/2.0 m FROM gen_predictions),
q AS (SELECT CASE WHEN trim(prediction)<>'' AND NOT regexp_matches(prediction,'[.!?]\\s*$') THEN 1 ELSE 0 END cut, CASE WHEN regexp_matches(prediction,'\\.([09]|10) ') THEN 1 ELSE 0 END bad, len(s) sentences, len(s)-len(list_distinct(s)) again, coalesce(list_max(list_transform(s, lambda x: len(list_filter(s, lambda y: y = x)))),0) most, length(prediction)/greatest(m,1) ratio, CASE WHEN trim(prediction)='' THEN 1 ELSE 0 END empty FROM s)
SELECT round(1-avg(cut),9) AS terminal_punctuation_rate, round(avg(cut),9) AS truncated_generation_rate, sum(bad)::DOUBLE AS invalid_fdi_count, round(avg(bad),9) AS invalid_fdi_case_rate, round(sum(again)*1.0::DOUBLE/sum(sentences),9) AS repetition_rate, round(avg(CASE WHEN again>0 THEN 1.0 ELSE 0 END),9)::DOUBLE AS repetition_case_rate, max(most)::DOUBLE AS max_sentence_repeat_count, round(avg(ratio),9)::DOUBLE AS length_ratio_mean, round(avg(empty),9) AS empty_generation_rate FROM q""", "gen_predictions")
def a16(spark, d):
    return rounded(C.generation_quality(pairs(spark, d)), "terminal_punctuation_rate", "truncated_generation_rate", "invalid_fdi_case_rate", "repetition_rate", "repetition_case_rate", "length_ratio_mean", "empty_generation_rate")


_GRAMS = "unnest(list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i:i + n - 1], ' ')))"


@query("a17_bleu", f"""WITH p AS (SELECT case_id, string_split_regex(trim(lower(prediction)), '\\s+') h, [string_split_regex(trim(lower(reference)), '\\s+'), string_split_regex(trim(lower(reference2)), '\\s+')] r FROM gen_predictions), o(n) AS (VALUES (1), (2), (3), (4)),
hg AS (SELECT case_id, n, g, count(*) k FROM (SELECT case_id, n, {_GRAMS.format('h')} g FROM p, o) GROUP BY ALL),
rg AS (SELECT case_id, n, g, max(k) most FROM (SELECT case_id, j, n, g, count(*) k FROM (SELECT case_id, j, n, {_GRAMS.format('w')} g FROM (SELECT case_id, unnest([1, 2]) j, unnest(r) w FROM p), o) GROUP BY ALL) GROUP BY ALL),
hit AS (SELECT n, sum(least(k, most)) m FROM hg JOIN rg USING (case_id, n, g) GROUP BY 1), tot AS (SELECT n, sum(greatest(len(h) - n + 1, 0)) t FROM p, o GROUP BY 1),
x AS (SELECT avg(ln(CASE WHEN coalesce(m, 0) = 0 THEN 0.1 ELSE m::DOUBLE END / greatest(t, 1))) l, max(m) FILTER (n = 1) m1 FROM tot LEFT JOIN hit USING (n)),
z AS (SELECT sum(len(h))::DOUBLE c, sum(CASE WHEN (abs(len(r[1]) - len(h)), len(r[1])) <= (abs(len(r[2]) - len(h)), len(r[2])) THEN len(r[1]) ELSE len(r[2]) END)::DOUBLE r FROM p)
SELECT round(CASE WHEN m1 > 0 THEN CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c) END * exp(l) ELSE 0 END, 9) AS bleu4 FROM x, z""", "gen_predictions")
def a17(spark, d):
    return rounded(similarity.corpus_bleu(pairs(spark, d)), "bleu4")


@query("a18_meteor")
def a18(spark, d):
    return rounded(similarity.meteor(pairs(spark, d)).agg(F.avg("meteor").alias("meteor")), "meteor")


@query("p24_character_similarity")
def p24(spark, d):
    p = generated(spark, d, "gen_predictions")
    like = similarity.compared(p.select("case_id", F.col("prediction").alias("a"), F.col("reference").alias("b")))
    return like.select("case_id", F.round("similarity", 9).alias("similarity"))


@query("a19_overfit_metrics")
def a19(spark, d):
    p = generated(spark, d, "gen_predictions")
    return rounded(similarity.overfit_metrics(p.select("case_id", "prediction", "reference", F.col("reference2").alias("swapped"), F.col("reference").alias("source"))), "exact_match", "character_similarity", "swap_change_rate", "swap_stays", "swap_follows")


METRICS = "SELECT fold, dice AS tooth_f1_micro, dice / 2 AS tooth_f1_macro, dice AS case_specific_f1_micro, 1 - dice AS side_accuracy, dice / 4 AS negation_contradiction_rate, dice AS unsupported_finding_rate, dice / 10 AS truncated_generation_rate, CASE WHEN fold = 3 THEN 0.1 ELSE 0.0 END AS invalid_fdi_case_rate, dice / 3 AS tooth_precision_micro FROM gen_cv"


def metrics(spark, d):
    x = F.col("dice")
    return generated(spark, d, "gen_cv").select(
        "dataset", "config", "fold", x.alias("tooth_f1_micro"), (x / 2).alias("tooth_f1_macro"), x.alias("case_specific_f1_micro"), (1 - x).alias("side_accuracy"), (x / 4).alias("negation_contradiction_rate"),
        x.alias("unsupported_finding_rate"), (x / 10).alias("truncated_generation_rate"), F.when(F.col("fold") == 3, 0.1).otherwise(0.0).alias("invalid_fdi_case_rate"), (x / 3).alias("tooth_precision_micro"))


@query("a21_checkpoint_score", "SELECT dataset, config, fold, round((0.35*dice+0.15*dice/2+0.25*dice+0.10*(1-dice)+0.10*(1-dice/4))/1.0-(0.5*dice+0.2*dice/10+0.2*CASE WHEN fold=3 THEN 0.1 ELSE 0 END),7) AS score FROM gen_cv", "gen_cv")
def a21(spark, d):
    return rounded(C.checkpoint_score(metrics(spark, d)).select("dataset", "config", "fold", "score"), "score", digits=7)


@query("a21_legacy_score", "SELECT dataset, config, fold, round((0.30*dice+0.10*dice/2+0.10*(1-dice)+0.10*(1-dice/4))*(1-0.5*dice),7) AS score_v1 FROM gen_cv", "gen_cv")
def a21b(spark, d):
    return rounded(C.legacy_score(metrics(spark, d)).select("dataset", "config", "fold", "score_v1"), "score_v1", digits=7)


@query("a22_hard_gates", "SELECT dataset, config, fold, array_to_string(list_filter([CASE WHEN dice>0.6 THEN 'unsupported_finding_rate>0.6' END, CASE WHEN dice/10>0.05 THEN 'truncated_generation_rate>0.05' END, CASE WHEN fold=3 THEN 'invalid_fdi_case_rate>0' END, CASE WHEN dice/3<0.15 THEN 'tooth_precision_micro<0.15' END], lambda x: x IS NOT NULL), ';') AS failures FROM gen_cv", "gen_cv")
def a22(spark, d):
    return C.hard_gates(metrics(spark, d)).select("dataset", "config", "fold", F.array_join("failures", ";").alias("failures"))


VOX = "gen_voxels"
REGIONS = "(VALUES (1,[1]),(2,[2]),(3,[3]),(9,[1,2])) g(region, labels)"


def regions(spark):
    return spark.createDataFrame([(1, [1]), (2, [2]), (3, [3]), (9, [1, 2])], "region int, labels array<int>")


CONF = f"""k AS (SELECT case_id, region, count(*) FILTER (list_contains(labels,ref) AND list_contains(labels,pred)) tp, count(*) FILTER (NOT list_contains(labels,ref) AND list_contains(labels,pred)) fp, count(*) FILTER (list_contains(labels,ref) AND NOT list_contains(labels,pred)) fn, count(*) FILTER (NOT list_contains(labels,ref) AND NOT list_contains(labels,pred)) tn FROM gen_voxels, {REGIONS} GROUP BY 1,2),
m AS (SELECT *, tp+fp n_pred, tp+fn n_ref, CASE WHEN tp+fp+fn>0 THEN 2.0*tp::DOUBLE/(2*tp+fp+fn) END dice, CASE WHEN tp+fp+fn>0 THEN tp::DOUBLE/(tp+fp+fn) END iou FROM k)"""


@query("a24_confusion", f"WITH {CONF} SELECT case_id, region, tp, fp, fn, tn, n_pred, n_ref, round(dice,9) AS dice, round(iou,9) AS iou FROM m", VOX)
def a24(spark, d):
    return rounded(S.confusion(generated(spark, d, VOX), regions(spark)), "dice", "iou")


@query("j11_aligned_voxels", "SELECT r AS ref, p AS pred, count(*) AS n FROM (SELECT min(ref) r, min(pred) p FROM gen_voxels GROUP BY case_id, z, y, x) GROUP BY 1, 2", VOX)
def j11(spark, d):
    v, at = generated(spark, d, VOX), ["case_id", "z", "y", "x"]
    sides = (v.groupBy(*at).agg(F.min(c).alias("label")) for c in ("ref", "pred"))
    return S.align(*sides).groupBy("ref", "pred").agg(F.count("*").alias("n"))


@query("a26_region_means", f"WITH {CONF} SELECT region, round(avg(dice),7) AS dice, round(avg(iou),7) AS iou FROM m GROUP BY 1", VOX)
def a26(spark, d):
    return rounded(S.mean_per_region(S.confusion(generated(spark, d, VOX), regions(spark))), "dice", "iou", digits=7)


@query("a26_foreground_mean", f"WITH {CONF}, r AS (SELECT region, avg(dice) dice, avg(iou) iou FROM m GROUP BY 1) SELECT round(avg(dice),7) AS dice, round(avg(iou),7) AS iou FROM r WHERE region<>0", VOX)
def a26b(spark, d):
    return rounded(S.foreground_mean(S.confusion(generated(spark, d, VOX), regions(spark))), "dice", "iou", digits=7)


PROB = "gen_probabilities"


@query("a28_ensemble", "SELECT case_id, voxel, label FROM (SELECT case_id, voxel, label, row_number() OVER (PARTITION BY case_id, voxel ORDER BY p DESC, label) k FROM (SELECT case_id, voxel, label, round(avg(p),6) p FROM gen_probabilities GROUP BY 1,2,3)) WHERE k=1", PROB)
def a28(spark, d):
    p = generated(spark, d, PROB).groupBy("case_id", "voxel", "label").agg(F.round(F.avg("p"), 6).alias("p"))
    return S.argmax_label(p, ["case_id", "voxel"])


@query("a40_ordered_regions", "SELECT case_id, voxel, coalesce(arg_max(label, ord) FILTER (p > 0.5), 0) AS label FROM gen_probabilities GROUP BY 1, 2", PROB)
def a40(spark, d):
    return S.ordered_regions(generated(spark, d, PROB), ["case_id", "voxel"])


@query("v13_softmax", "SELECT case_id, voxel, label, score, round(exp(score-max(score) OVER w)/(sum(exp(score-m)) OVER w),7) AS p FROM (SELECT *, max(score) OVER (PARTITION BY case_id, voxel) m FROM gen_probabilities) WINDOW w AS (PARTITION BY case_id, voxel)", PROB)
def v13(spark, d):
    return rounded(S.softmax(generated(spark, d, PROB).drop("p"), ["case_id", "voxel"]).select("case_id", "voxel", "label", "score", "p"), "p", digits=7)


@query("j12_incomplete_files", "SELECT voxel AS file, count(DISTINCT model) AS models FROM gen_probabilities GROUP BY 1 HAVING count(DISTINCT model) < 2", PROB)
def j12(spark, d):
    return S.incomplete_files(generated(spark, d, PROB).select("model", F.col("voxel").alias("file")))


@query("j13_repeated_cases", "SELECT dataset || config AS case_id, count(*) AS n FROM gen_cv GROUP BY 1 HAVING count(*) > 1", "gen_cv")
def j13(spark, d):
    return S.repeated_cases(generated(spark, d, "gen_cv").select(F.concat("dataset", "config").alias("case_id")))


@query("a27_best_configuration", "SELECT name, dice FROM (SELECT dataset || config name, max(dice) dice FROM gen_cv GROUP BY 1) ORDER BY dice DESC, name LIMIT 1", "gen_cv")
def a27(spark, d):
    s = generated(spark, d, "gen_cv").groupBy(F.concat("dataset", "config").alias("name")).agg(F.max("dice").alias("dice"))
    return S.best_configuration(s.withColumn("ord", F.col("name"))).select("name", "dice")


@query("a27_model_pairs", "SELECT a.n AS a, b.n AS b FROM (SELECT DISTINCT dataset || config n FROM gen_cv) a JOIN (SELECT DISTINCT dataset || config n FROM gen_cv) b ON a.n < b.n", "gen_cv")
def a27b(spark, d):
    m = generated(spark, d, "gen_cv").select(F.concat("dataset", "config").alias("name")).distinct()
    return S.model_pairs(m.withColumn("ord", F.col("name")))


@query("v15_model_grid", "SELECT a.t, b.c FROM (SELECT DISTINCT dataset t FROM gen_cv) a CROSS JOIN (SELECT DISTINCT config c FROM gen_cv) b", "gen_cv")
def v15(spark, d):
    g = generated(spark, d, "gen_cv")
    return g.select(F.col("dataset").alias("t")).distinct().crossJoin(F.broadcast(g.select(F.col("config").alias("c")).distinct()))


@query("a45_results_matrix", "SELECT dataset, config, round(avg(dice) FILTER (fold=0),9) AS fold_0, round(avg(dice) FILTER (fold=1),9) AS fold_1, round(avg(dice) FILTER (fold=2),9) AS fold_2, round(avg(dice) FILTER (fold=3),9) AS fold_3, round(avg(dice) FILTER (fold=4),9) AS fold_4, round(avg(dice),9) AS mean FROM gen_cv GROUP BY 1, 2", "gen_cv")
def a45(spark, d):
    return rounded(S.results_matrix(generated(spark, d, "gen_cv"), [0, 1, 2, 3, 4]), *(f"fold_{k}" for k in range(5)), "mean")


@query("a46_benchmark_matrix", "SELECT p_brand AS dataset, coalesce(CAST(CAST(min(p_retailprice) FILTER (p_size%9=0) AS DECIMAL(18,3)) AS VARCHAR),'MISSING') AS a, coalesce(CAST(CAST(min(p_retailprice) FILTER (p_size%9=1) AS DECIMAL(18,3)) AS VARCHAR),'MISSING') AS b FROM part GROUP BY 1 HAVING count(*) FILTER (p_size%9 IN (0,1)) > 0")
def a46(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    gpu = F.when(F.col("p_size") % 9 == 0, "a").when(F.col("p_size") % 9 == 1, "b").otherwise("c")
    return S.benchmark_matrix(p.select(F.col("p_brand").alias("dataset"), gpu.alias("gpu"), F.col("p_retailprice").alias("epoch_seconds")), ["a", "b"])


@query("a29_fingerprint", "SELECT l_linenumber AS channel, round(avg(l_quantity),7) AS mean, quantile_cont(l_quantity,0.5) AS median, round(stddev_pop(l_quantity),7) AS std, min(l_quantity) AS min, max(l_quantity) AS max, round(quantile_cont(l_quantity,0.995),7) AS p99_5, round(quantile_cont(l_quantity,0.005),7) AS p0_5 FROM lineitem GROUP BY 1")
def a29(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("channel"), F.col("l_quantity").alias("value"))
    return rounded(S.fingerprint(l), "mean", "std", "p99_5", "p0_5", digits=7)


@query("a42_unexpected_labels", "SELECT DISTINCT case_id, ref AS label FROM gen_voxels WHERE ref NOT IN (0,1,2)", VOX)
def a42(spark, d):
    v = generated(spark, d, VOX).select("case_id", F.col("ref").alias("label"))
    return S.unexpected_labels(v, spark.createDataFrame([(0,), (1,), (2,)], "label int"))


@query("a42_label_gaps", "SELECT label, previous FROM (SELECT label, lag(label) OVER (ORDER BY label) previous FROM (SELECT DISTINCT p_size label FROM part WHERE p_size%3<>1)) WHERE label-previous<>1")
def a42b(spark, d):
    return S.label_gaps(spark.read.parquet(f"{d}/part.parquet").where("p_size % 3 <> 1").select(F.col("p_size").alias("label")))


@query("p28_one_hot", "SELECT ref, sum((ref=0)::INT)::BIGINT AS is_0, sum((ref=2)::INT)::BIGINT AS is_2 FROM gen_voxels GROUP BY 1", VOX)
def p28(spark, d):
    v = S.one_hot(generated(spark, d, VOX).select("ref", F.col("ref").alias("label")), [0, 2])
    return v.groupBy("ref").agg(F.sum("is_0").alias("is_0"), F.sum("is_2").alias("is_2"))


@query("p30_remap", "SELECT CASE ref WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 END AS label, count(*) AS n FROM gen_voxels GROUP BY 1", VOX)
def p30(spark, d):
    return S.remap(generated(spark, d, VOX).select(F.col("ref").alias("label")), {0: 0, 1: 2, 2: 1, 3: 4}).groupBy("label").agg(F.count("*").alias("n"))


@query("a44_foreground_slice", "SELECT case_id, z FROM (SELECT case_id, z, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, z) k FROM gen_voxels WHERE ref>0 GROUP BY 1,2) WHERE k=1", VOX)
def a44(spark, d):
    return S.foreground_slice(generated(spark, d, VOX).withColumnRenamed("ref", "label"))


@query("a32_global_pool", "SELECT label AS case_id, c::INT AS c, round(avg(v),6) AS mean, max(v)::DOUBLE AS max FROM (SELECT label, unnest(embedding)::DOUBLE v, unnest(range(0,len(embedding))) c FROM embeddings) GROUP BY 1,2")
def a32(spark, d):
    return rounded(V.global_pool(features(spark, d)), "mean", digits=6)


def features(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("label").alias("case_id"), F.posexplode("embedding").alias("c", "v"))
    return e.select("case_id", "c", F.col("vec_id").alias("z"), F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("v").cast("double").alias("v"))


@query("a34_region_geometry", "SELECT case_id, ref AS label, count(*) AS voxel_count, round(avg(x),7) AS cx, round(avg(y),7) AS cy, round(avg(z),7) AS cz, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x)+1 AS x1, max(y)+1 AS y1, max(z)+1 AS z1 FROM gen_voxels WHERE ref<>0 GROUP BY 1,2", VOX)
def a34(spark, d):
    g = V.region_geometry(generated(spark, d, VOX).withColumnRenamed("ref", "label"))
    return rounded(g.select("case_id", "label", "voxel_count", *(F.col("centroid")[k].alias(f"c{n}") for k, n in enumerate("xyz")), *(F.col("bbox")[k].alias(n) for k, n in enumerate(("x0", "y0", "z0", "x1", "y1", "z1")))), "cx", "cy", "cz", digits=7)


@query("a35_present_regions", "SELECT DISTINCT case_id, ref AS label, CASE ref WHEN 1 THEN 'one' ELSE 'label_' || ref END AS name FROM gen_voxels WHERE ref<>0", VOX)
def a35(spark, d):
    return V.present_regions(generated(spark, d, VOX).withColumnRenamed("ref", "label"), spark.createDataFrame([(1, "one")], "label int, name string"))


@query("a38_overlap_add", "SELECT case_id, z, round(sum(v*w)/greatest(sum(w),1e-7),7) AS v FROM (SELECT case_id, z, v, exp(-0.5*pow((y-32)/8.0,2)) w FROM gen_voxels) GROUP BY 1,2", VOX)
def a38(spark, d):
    v = generated(spark, d, VOX).select("case_id", F.lit(0).alias("c"), "z", "v", V.gaussian_weight(F.col("y"), 64).alias("g"), F.lit(0).alias("y"), F.lit(0).alias("x"))
    return rounded(V.overlap_add(v).select("case_id", "z", "v"), "v", digits=7)


@query("a41_nonzero_box", "SELECT case_id, min(z) AS z0, max(z)+1 AS z1, min(y) AS y0, max(y)+1 AS y1, min(x) AS x0, max(x)+1 AS x1 FROM gen_voxels WHERE ref<>0 GROUP BY 1", VOX)
def a41(spark, d):
    return V.nonzero_box(generated(spark, d, VOX).select("case_id", "z", "y", "x", F.col("ref").alias("v")))


@query("a43_largest_component")
def a43(spark, d):
    v = generated(spark, d, VOX).where("ref > 0")
    return S.largest_component(v).groupBy("case_id").agg(F.count("*").alias("n"))


@query("m4_z_score", "SELECT label AS case_id, c::INT AS c, vec_id AS z, round((v-avg(v) OVER w)/greatest(stddev_pop(v) OVER w,1e-8),6) AS v FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE v, unnest(range(0,len(embedding))) c FROM embeddings) WINDOW w AS (PARTITION BY label, c)")
def m4(spark, d):
    return rounded(V.z_score(features(spark, d)).select("case_id", "c", "z", "v"), "v", digits=6)


@query("m4_ct_normalize", "SELECT l_orderkey, l_linenumber, round((least(greatest(l_quantity,5),45)-25.5)/14.4,9) AS v FROM lineitem")
def m4b(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet")
    return rounded(l.select("l_orderkey", "l_linenumber", V.ct_normalize(F.col("l_quantity"), 25.5, 14.4, 5.0, 45.0).alias("v")), "v")


@query("m3_resampled_size", "SELECT p_partkey, CAST(round_even(p_size * 0.3 / 0.45, 0) AS INT) AS size FROM part")
def m3(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", V.resampled_size(F.col("p_size"), F.lit(0.3), F.lit(0.45)).alias("size"))


@query("m10_grounding_hinge", "SELECT a.vec_id, round(greatest(0.1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + list_cosine_similarity(c.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0),6)::DOUBLE AS hinge FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1 JOIN embeddings c ON c.vec_id=a.vec_id+2")
def m10(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    b, c = (e.select((F.col("vec_id") - k).alias("vec_id"), F.col("e").alias(f"e{k}")) for k in (1, 2))
    return e.join(b, "vec_id").join(c, "vec_id").select("vec_id", F.round(losses.grounding_hinge(F.col("e"), F.col("e2"), F.col("e1"), 0.1), 6).alias("hinge"))


@query("m9_bce", "SELECT l_orderkey, l_linenumber, round((1-y)*x + (1+2*y)*(ln(1+exp(-abs(x)))+greatest(-x,0)),7) AS loss FROM (SELECT l_orderkey, l_linenumber, l_quantity/10-2.5 x, l_linenumber%2 y FROM lineitem)")
def m9(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10 - 2.5).alias("x"), (F.col("l_linenumber") % 2).alias("y"))
    return rounded(l.select("l_orderkey", "l_linenumber", losses.bce_with_logits(F.col("x"), F.col("y"), 3.0).alias("loss")), "loss", digits=7)


@query("m11_masked_mean", "SELECT l_suppkey, round(coalesce(avg(l_quantity) FILTER (l_linenumber=7), avg(l_quantity)),7) AS mean FROM lineitem GROUP BY 1")
def m11(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("m", F.col("l_linenumber") == 7)
    return rounded(losses.masked_mean(l, "l_suppkey", "l_quantity", "m"), "mean", digits=7)


@query("a49_soft_dice", "SELECT l_suppkey, round((2*sum(l_discount*10*(l_linenumber%2))+1)/greatest(sum(l_discount*10)+sum(l_linenumber%2)+1,1e-8),7) AS dice FROM lineitem GROUP BY 1")
def a49(spark, d):
    l = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", (F.col("l_discount") * 10).alias("p"), (F.col("l_linenumber") % 2).alias("y"))
    return rounded(losses.soft_dice(l, ["l_suppkey"]), "dice", digits=7)


@query("s5_case_ids", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.html$', '') AS case_id FROM pages")
def s5(spark, d):
    from quarrylake.sources.files import stem

    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", stem(F.col("url"), ".html").alias("case_id"))


@query("k5_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def k5(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
