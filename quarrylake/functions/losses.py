"""Closed-form losses and similarities over arrays and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, least: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(least))


def grounding_hinge(correct: Column, shuffled: Column, report: Column, margin: float) -> Column:
    return F.greatest(F.lit(margin) - cosine(correct, report) + cosine(shuffled, report), F.lit(0.0))


def log_sum_exp(x: Column) -> Column:
    m = F.array_max(x)
    return m + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - m)))


def weighted_causal_loss(tokens: DataFrame, ignore: int = -100) -> DataFrame:
    """(sample, loss): token-weighted mean of the cross entropy; tokens: (sample, logits, label, weight)."""
    active = F.when(F.col("label") != ignore, F.col("weight")).otherwise(0.0)
    ce = F.when(F.col("label") != ignore, log_sum_exp(F.col("logits")) - F.get("logits", F.col("label"))).otherwise(0.0)
    return tokens.groupBy("sample").agg((F.sum(ce * active) / F.greatest(F.sum(active), F.lit(1e-8))).alias("loss"))


def sample_weighted_loss(tokens: DataFrame, samples: DataFrame, ignore: int = -100) -> DataFrame:
    """One row (weighted, unweighted): the mean over samples of their token-weighted losses times their weights, and the mean over all labelled tokens.

    tokens: (sample, logits, label, weight), samples: (sample, sample_weight). A sample without a token of positive weight is
    left out; without any the loss is 0.
    """
    labelled = F.col("label") != ignore
    active = F.when(labelled, F.col("weight")).otherwise(0.0)
    ce = F.when(labelled, log_sum_exp(F.col("logits")) - F.get("logits", F.col("label"))).otherwise(0.0)
    own = tokens.groupBy("sample").agg((F.sum(ce * active) / F.greatest(F.sum(active), F.lit(1e-8))).alias("loss"), F.sum(active).alias("active"), F.sum(ce).alias("all"), F.count_if(labelled).alias("n"))
    j = own.join(samples.select("sample", "sample_weight"), "sample")
    weighted = F.avg(F.when(F.col("active") > 0, F.col("loss") * F.col("sample_weight")))
    return j.agg(F.coalesce(weighted, F.lit(0.0)).alias("weighted"), F.coalesce(F.sum("all") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("unweighted"))


def bce_with_logits(x: Column, y: Column, positive: float = 1.0) -> Column:
    soft = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return (1 - y) * x + (1 + (positive - 1) * y) * soft


def masked_mean(rows: DataFrame, by: str, value: str, mask: str) -> DataFrame:
    """(by, mean) over masked rows, or over all where none is."""
    return rows.groupBy(by).agg(F.coalesce(F.avg(F.when(F.col(mask), F.col(value))), F.avg(value)).alias("mean"))


def soft_dice(rows: DataFrame, by: list[str], smooth: float = 1.0, squared: bool = False, over: str | None = None) -> DataFrame:
    """(by..., dice) of rows (by..., p, y, mask or none): the soft Dice of probabilities and targets, masked places left out.

    squared: the squares of products are summed, as some losses do. over: a column of by whose groups are summed before
    the quotient (the samples of a batch); without it each group has its own.
    """
    one = (lambda x: x * x) if squared else (lambda x: x)
    m = F.col("mask").cast("double") if "mask" in rows.columns else F.lit(1.0)
    keys = [b for b in by if b != over]
    s = rows.groupBy(*keys).agg(*(F.sum(one(v) * m).alias(k) for k, v in (("tp", F.col("p") * F.col("y")), ("fp", F.col("p") * (1 - F.col("y"))), ("fn", (1 - F.col("p")) * F.col("y")))))
    return s.select(*keys, ((2 * F.col("tp") + smooth) / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn") + smooth, F.lit(1e-8))).alias("dice"))


def top_share_mean(losses: DataFrame, share: float, *by: str) -> DataFrame:
    """(by..., loss): the mean of the largest share of losses (by..., loss, id), rounded down to whole rows, one at least."""
    from quarrylake.operators.ordering import ordered_index
    from quarrylake.operators.storage import broadcast_if_small

    # ranks by ranges over all groups, less the first of each: no task holds a group
    at = ordered_index(losses.select(*by, "loss", "id"), [*by, F.col("loss").desc(), "id"], "_i")
    own = at.groupBy(*by).agg(F.min("_i").alias("_first"), F.count("*").alias("_n")).withColumnsRenamed({c: f"_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    taken = at.join(broadcast_if_small(own), same).where(F.col("_i") - F.col("_first") < F.greatest(F.floor(F.col("_n") * share), F.lit(1)))
    return taken.groupBy(*by).agg(F.avg("loss").alias("loss"))


def compound(first: Column, second: Column, weight_first: float = 1.0, weight_second: float = 1.0) -> Column:
    """A weighted sum of two losses; one with a weight of 0 is left out, also where it is NULL."""
    parts = [w * x for w, x in ((weight_first, first), (weight_second, second)) if w]
    return sum(parts[1:], parts[0]) if parts else F.lit(0.0)


def supervision_weights(levels: int) -> list[float]:
    """Weights of the losses at resolutions halved again and again: halves of each other, none for the lowest, with the sum 1."""
    w = [0.5 ** k if k < levels - 1 or levels == 1 else 0.0 for k in range(levels)]
    return [x / sum(w) for x in w]


def supervised(losses: DataFrame, levels: int, *by: str) -> DataFrame:
    """(by..., loss): losses (by..., level, loss) of all resolutions with those weights."""
    weights = F.array(*map(F.lit, supervision_weights(levels)))
    return losses.groupBy(*by).agg(F.sum(F.get(weights, F.col("level")) * F.col("loss")).alias("loss"))
