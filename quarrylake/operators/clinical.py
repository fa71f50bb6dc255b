"""Agreement of predicted with reference assertions, and what follows from it.

Both sides are tables of distinct (case_id, concept, tooth_number, anatomy, side, polarity, clause_type). Keys may be
NULL, so joins compare them with a marker in place of NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import lexicon as L
from quarrylake.functions import text as T

NULL = "~"
CORE = ["concept", "tooth_number", "anatomy", "side"]
KEY = [*CORE, "polarity"]


def _safe(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(NULL, cols)


def tooth_counts(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(case_id, tooth_number, tp, fp, fn, support) over (tooth, concept, polarity) keys."""
    keys = ["case_id", "tooth_number", "concept", "polarity"]
    p, r = (x.where("tooth_number IS NOT NULL").select(*keys).distinct().withColumn(n, F.lit(1)) for x, n in ((predicted, "p"), (reference, "r")))
    both = p.join(r, keys, "full_outer").fillna(0, ["p", "r"])
    return both.groupBy("case_id", "tooth_number").agg(
        F.sum(F.col("p") * F.col("r")).alias("tp"), F.sum(F.col("p") * (1 - F.col("r"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("r")).alias("fn"), F.sum("r").alias("support"))


def tooth_metrics(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(tooth_number, tp, fp, fn, support, precision, recall, f1) of all 32 teeth."""
    spark = predicted.sparkSession
    all_teeth = spark.createDataFrame([(t,) for t in L.TEETH], "tooth_number string")
    c = tooth_counts(predicted, reference).groupBy("tooth_number").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn", "support")))
    c = all_teeth.join(c, "tooth_number", "left").fillna(0)
    return c.select("*", *(v.alias(k) for k, v in T.prf(*(F.col(x) for x in ("tp", "fp", "fn"))).items()))


def tooth_summary(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: micro values over all teeth, macro values over teeth with support."""
    t = tooth_metrics(predicted, reference)
    m = t.agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "fn")), *(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col(x))), F.lit(0.0)).alias(f"{x}_macro") for x in ("precision", "recall", "f1")))
    micro = T.prf(*(F.col(x) for x in ("tp", "fp", "fn")))
    return m.select(*(v.alias(f"{k}_micro") for k, v in micro.items()), "precision_macro", "recall_macro", "f1_macro")


def _neutral(df: DataFrame) -> DataFrame:
    tooth = F.col("tooth_number")
    jaw = F.when(tooth.isNotNull(), F.concat(F.when(F.substring(tooth, 1, 1).isin("1", "2"), "upper").otherwise("lower"), F.substring(tooth, 2, 1)))
    return _safe(df.where("side IS NOT NULL").withColumn("neutral", jaw), ["neutral", "anatomy"])


def side_agreement(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: comparable, correct, left_to_right, right_to_left, accuracy."""
    keys = ["case_id", "concept", "neutral", "anatomy", "polarity"]
    r = _neutral(reference).groupBy(*keys).agg(F.collect_set("side").alias("sides"))
    j = _neutral(predicted).join(r, keys)
    ok = F.array_contains("sides", F.col("side"))
    a = j.agg(F.count("*").alias("comparable"), F.count_if(ok).alias("correct"), F.count_if(~ok & (F.col("side") == "right")).alias("left_to_right"),
              F.count_if(~ok & (F.col("side") != "right")).alias("right_to_left"))
    return a.withColumn("accuracy", F.when(F.col("comparable") > 0, F.col("correct") / F.col("comparable")).otherwise(0.0))


def support(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """predicted (NULLs marked) with state: conflict, unsupported, comparable or none of these (other)."""
    keys = ["case_id", *CORE]
    r = _safe(reference, CORE).groupBy(*keys).agg(F.collect_set("polarity").alias("polarities"))
    j = _safe(predicted, CORE).join(r, keys, "left")
    state = (F.when(F.col("polarities").isNotNull() & ~F.array_contains("polarities", F.col("polarity")), "conflict")
             .when(F.col("polarities").isNotNull(), "comparable").when(F.col("polarity") == "positive", "unsupported").otherwise("other"))
    return j.withColumn("state", state)


def contradiction(predicted: DataFrame, reference: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: total, comparable, rate, case_rate, positive_to_negative, negative_to_positive; cases: (case_id)."""
    s = support(predicted, reference)
    conflict = F.col("state") == "conflict"
    a = s.agg(F.count_if(conflict).alias("total"), F.count_if(F.col("state").isin("conflict", "comparable")).alias("comparable"),
              F.countDistinct(F.when(conflict, F.col("case_id"))).alias("case_count"),
              F.count_if(conflict & (F.col("polarity") == "positive")).alias("positive_to_negative"), F.count_if(conflict & (F.col("polarity") == "negative")).alias("negative_to_positive"))
    n = cases.agg(F.count("*").alias("n"))
    return a.crossJoin(n).select("total", "comparable", F.when(F.col("comparable") > 0, F.col("total") / F.col("comparable")).otherwise(0.0).alias("rate"),
                                 F.when(F.col("n") > 0, F.col("case_count") / F.col("n")).otherwise(0.0).alias("case_rate"), "positive_to_negative", "negative_to_positive")


def unsupported(predicted: DataFrame, reference: DataFrame, cases: DataFrame) -> DataFrame:
    """One row: total, case_rate, rate, mean, median and maximum a case."""
    s = support(predicted, reference)
    per = s.groupBy("case_id").agg(F.count_if(F.col("state") == "unsupported").alias("u"), F.count_if((F.col("polarity") == "positive") & (F.col("state") != "conflict")).alias("c"))
    per = cases.join(per, "case_id", "left").fillna(0, ["u", "c"])
    a = per.agg(F.sum("u").alias("total"), F.avg((F.col("u") > 0).cast("double")).alias("case_rate"), F.sum("c").alias("c"), F.avg("u").alias("mean"),
                F.percentile("u", F.lit(0.5)).alias("median"), F.max("u").alias("maximum"))
    return a.select("total", "case_rate", F.when(F.col("c") > 0, F.col("total") / F.col("c")).otherwise(0.0).alias("rate"), "mean", "median", "maximum")


def unsupported_by_concept(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    return support(predicted, reference).where("state = 'unsupported'").groupBy("concept").agg(F.count("*").alias("n"))


def _specific(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    keys = ["case_id", *KEY]
    p, r = (_safe(x.where("clause_type = 'case-specific'"), KEY).select(*keys).distinct().withColumn(n, F.lit(1)) for x, n in ((predicted, "p"), (reference, "r")))
    return p.join(r, keys, "full_outer").fillna(0, ["p", "r"])


def _counts() -> list[Column]:
    return [F.sum(F.col("p") * F.col("r")).alias("tp"), F.sum(F.col("p") * (1 - F.col("r"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("r")).alias("fn")]


def case_specific(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: micro values, and macro values over the cases with reference assertions."""
    per = _specific(predicted, reference).groupBy("case_id").agg(*_counts(), F.sum("r").alias("n"))
    v = T.prf(*(F.col(x) for x in ("tp", "fp", "fn")))
    a = per.select("tp", "fp", "fn", "n", *(x.alias(k) for k, x in v.items())).agg(
        *(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn")), *(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col(x))), F.lit(0.0)).alias(f"{x}_macro") for x in v))
    return a.select(*(x.alias(f"{k}_micro") for k, x in v.items()), *(f"{k}_macro" for k in v))


def by_concept(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """(concept, predicted, reference, matched, precision, recall, f1) of case-specific assertions."""
    c = _specific(predicted, reference).groupBy("concept").agg(F.sum("p").alias("predicted"), F.sum("r").alias("reference"), F.sum(F.col("p") * F.col("r")).alias("matched"))
    v = T.prf(F.col("matched"), F.col("predicted") - F.col("matched"), F.col("reference") - F.col("matched"))
    return c.select("*", *(x.alias(k) for k, x in v.items()))


def generation_quality(pairs: DataFrame) -> DataFrame:
    """One row of rates over pairs (case_id, prediction, references array)."""
    p = F.col("prediction")
    bad = F.size(T.invalid_fdi(p))
    stripped = T.strip(p)
    sent = T.sentences(p)
    repeat = T.let(sent, lambda a: F.transform(F.array_distinct(a), lambda s: F.size(F.filter(a, lambda x: x == s))))
    mean = F.aggregate("references", F.lit(0.0), lambda a, x: a + F.length(x)) / F.greatest(F.size("references"), F.lit(1))
    rows = pairs.select(
        ((stripped != "") & ~T.is_terminated(stripped)).cast("int").alias("cut"), bad.alias("bad"), F.size(sent).alias("sentences"),
        (F.size(sent) - F.size(F.array_distinct(sent))).alias("again"), F.coalesce(F.array_max(repeat), F.lit(0)).alias("most"),
        (F.length(p) / F.greatest(mean, F.lit(1.0))).alias("ratio"), (stripped == "").cast("int").alias("empty"))
    return rows.agg(
        (1 - F.avg("cut")).alias("terminal_punctuation_rate"), F.avg("cut").alias("truncated_generation_rate"), F.sum("bad").cast("double").alias("invalid_fdi_count"),
        F.avg((F.col("bad") > 0).cast("double")).alias("invalid_fdi_case_rate"),
        F.when(F.sum("sentences") > 0, F.sum("again") / F.sum("sentences")).otherwise(0.0).alias("repetition_rate"), F.avg((F.col("again") > 0).cast("double")).alias("repetition_case_rate"),
        F.max("most").cast("double").alias("max_sentence_repeat_count"), F.avg("ratio").alias("length_ratio_mean"), F.avg("empty").alias("empty_generation_rate"))


def uniqueness(predictions: DataFrame) -> DataFrame:
    """One row (unique_rate, max_duplicate_count) of predictions (case_id, prediction)."""
    g = predictions.groupBy(T.normalize_report(F.col("prediction")).alias("normal")).agg(F.count("*").alias("n"))
    return g.agg((F.count("*") / F.sum("n")).alias("unique_rate"), F.max("n").cast("double").alias("max_duplicate_count"))


#: Weights and limits of the checkpoint score and its gates.
REWARDS = {"tooth_f1_micro": 0.35, "tooth_f1_macro": 0.15, "case_specific_f1_micro": 0.25, "side_accuracy": 0.10, "negation_consistency": 0.10, "image_shuffle_grounding_gap": 0.05}
PENALTIES = {"unsupported_finding_rate": 0.50, "truncated_generation_rate": 0.20, "repetition_case_rate": 0.20, "invalid_fdi_case_rate": 0.20}
EMPTY_PENALTY = 0.50
LEGACY = {"tooth_f1_micro": 0.30, "tooth_f1_macro": 0.10, "case_specific_recall_micro": 0.25, "case_specific_recall_macro": 0.15, "side_accuracy": 0.10}
MAXIMA = {"unsupported_finding_rate": 0.60, "truncated_generation_rate": 0.05, "invalid_fdi_case_rate": 0.0}
MINIMA = {"tooth_precision_micro": 0.15}


def _metric(df: DataFrame, name: str) -> Column:
    if name == "negation_consistency":
        return 1.0 - _metric(df, "negation_contradiction_rate")
    return F.coalesce(F.col(name), F.lit(0.0)) if name in df.columns else F.lit(0.0)


def _weighted(df: DataFrame, weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * _metric(df, k) for k, w in weights.items()), F.lit(0.0))


def checkpoint_score(metrics: DataFrame, rewards: dict = REWARDS, penalties: dict = PENALTIES, empty: float = EMPTY_PENALTY) -> DataFrame:
    """metrics with score: the weighted mean of rewards less penalties."""
    total = sum(rewards.values())
    reward = _weighted(metrics, rewards) / total if total else F.lit(0.0)
    return metrics.withColumn("score", reward - _weighted(metrics, penalties) - empty * _metric(metrics, "empty_generation_rate"))


def legacy_score(metrics: DataFrame) -> DataFrame:
    reward = _weighted(metrics, LEGACY) + 0.10 * _metric(metrics, "negation_consistency")
    return metrics.withColumn("score_v1", reward * (1.0 - 0.5 * _metric(metrics, "unsupported_finding_rate")))


def hard_gates(metrics: DataFrame, maxima: dict = MAXIMA, minima: dict = MINIMA) -> DataFrame:
    """metrics with failures (array of what a gate says) and eligible."""
    over = [F.when(_metric(metrics, k) > v, f"{k}>{v:g}") for k, v in maxima.items()]
    under = [F.when(_metric(metrics, k) < v, f"{k}<{v:g}") for k, v in minima.items()]
    m = metrics.withColumn("failures", F.array_compact(F.array(*over, *under)))
    return m.withColumn("eligible", F.size("failures") == 0)
