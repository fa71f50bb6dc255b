"""Text similarity: BLEU and METEOR over tokens, and character similarity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarrylake.functions import text as T
from quarrylake.operators.storage import broadcast_if_small, cut, parts_for

#: Texts of a part, whose n-grams are counted there.
TEXTS = 2_000
#: Different pairs of texts with their similarity that are broadcast at most.
COMPARED = 10_000


def _grams(tokens: Column, n: int) -> Column:
    return T.let(tokens, lambda w: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(T.grams(w, n)))


def corpus_bleu(pairs: DataFrame, order: int = 4, epsilon: float = 0.1) -> DataFrame:
    """One row (bleu4) of pairs (case_id, prediction, references): clipped n-gram counts summed over the corpus,
    an epsilon for orders without a match, and the brevity penalty against the closest reference lengths."""
    # n-grams are counted by case, so they stay in the part of their case
    pairs = pairs.select("case_id", "prediction", "references").repartition(parts_for(pairs, TEXTS), "case_id")
    p = pairs.select("case_id", T.metric_tokens(F.col("prediction")).alias("h"), F.transform("references", T.metric_tokens).alias("r"))
    closest = F.array_min(F.transform("r", lambda x: F.struct(F.abs(F.size(x) - F.size("h")).alias("d"), F.size(x).alias("n"))))["n"]
    size = p.agg(F.sum(F.size("h")).alias("c"), F.sum(closest).alias("r"))
    # every order has a row also where no text is long enough
    total = p.select(F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.greatest(F.size("h") - n + 1, F.lit(0)).alias("t")) for n in range(1, order + 1)))).alias("x")).groupBy("x.n").agg(F.sum("x.t").alias("t"))
    # prediction (0) and references are counted by one grouping: a join's sides are estimated by the size of the input files, so it would broadcast all n-grams
    texts = p.where("case_id IS NOT NULL").select("case_id", F.posexplode(F.concat(F.array("h"), "r")).alias("i", "w"))
    grams = texts.select("case_id", "i", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), _grams(F.col("w"), n).alias("g")) for n in range(1, order + 1)))).alias("x"))
    each = grams.select("case_id", "i", "x.n", F.explode("x.g").alias("g")).groupBy("case_id", "i", "n", "g").agg(F.count("*").alias("c"))
    both = each.groupBy("case_id", "n", "g").agg(F.max(F.when(F.col("i") == 0, F.col("c"))).alias("k"), F.max(F.when(F.col("i") > 0, F.col("c"))).alias("most"))
    hit = both.where("k IS NOT NULL AND most IS NOT NULL").groupBy("n").agg(F.sum(F.least("k", "most")).alias("m"))
    rows = total.join(hit, "n", "left").select("n", F.greatest("t", F.lit(1)).alias("t"), F.coalesce("m", F.lit(0)).alias("m"))
    log = rows.agg(F.avg(F.log(F.when(F.col("m") == 0, F.lit(epsilon)).otherwise(F.col("m")) / F.col("t"))).alias("l"), F.max(F.when(F.col("n") == 1, F.col("m"))).alias("m1"))
    penalty = F.when(F.col("c") > F.col("r"), 1.0).when(F.col("c") > 0, F.exp(1 - F.col("r") / F.col("c"))).otherwise(0.0)
    return log.crossJoin(size).select(F.coalesce(F.when(F.col("m1") > 0, penalty * F.exp("l")), F.lit(0.0)).alias("bleu4"))


@F.pandas_udf(DoubleType())
def character_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters by both lengths, blocks matched longest first, of stripped texts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x.strip(), y.strip()).ratio() if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def compared(pairs: DataFrame, name: str = "similarity") -> DataFrame:
    """pairs (a, b, ...) with the character similarity of a and b, found once for each different pair; NULL if one is NULL."""
    # different pairs are dealt out by number, as a comparison takes long for its size
    different = pairs.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct().repartition(spread(pairs), "a", "b")
    return pairs.join(broadcast_if_small(cut(different.withColumn(name, character_similarity("a", "b"))), COMPARED), ["a", "b"], "left")


def spread(df: DataFrame) -> int:
    """Parts over which work on rows is dealt out that takes long for their size."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def overfit_metrics(rows: DataFrame) -> DataFrame:
    """One row of rows (prediction, reference, swapped, source): how far predictions repeat references or follow the swapped input.

    Texts are compared character by character once for each different pair, and weighted by how often it occurs.
    """
    p, r, s, o = (T.strip(F.col(c)) for c in ("prediction", "reference", "swapped", "source"))
    rows = rows.select(p.alias("p"), r.alias("r"), s.alias("s"), o.alias("o"))
    sides = {"character_similarity": ("p", "r"), "swap_stays": ("p", "s"), "swap_follows": ("o", "s")}
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), F.col(a).alias("a"), F.col(b).alias("b")) for name, (a, b) in sides.items()))
    # NULLs go before: a filter by the similarity itself would be moved to the single rows, and compare each of them
    n = rows.select(F.explode(pairs).alias("x")).select("x.*").where("a IS NOT NULL AND b IS NOT NULL").groupBy("name", "a", "b").agg(F.count("*").alias("n"))
    n = n.repartition(spread(n), "name", "a", "b").withColumn("v", character_similarity("a", "b"))
    like = n.agg(*((F.sum(F.when(F.col("name") == name, F.col("v") * F.col("n"))) / F.sum(F.when(F.col("name") == name, F.col("n")))).alias(name) for name in sides))
    equal = rows.agg(F.avg((F.col("p") == F.col("r")).cast("double")).alias("exact_match"), F.avg((F.col("p") != F.col("s")).cast("double")).alias("swap_change_rate"))
    # two single rows
    return equal.crossJoin(like)


_VOWELS = "aeiou"


def _consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and not (w[i] == "y" and i > 0 and _consonant(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_consonant(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _short_end(w: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y; or is a vowel and a consonant alone."""
    n = len(w)
    return (n >= 3 and _consonant(w, n - 3) and not _consonant(w, n - 2) and _consonant(w, n - 1) and w[-1] not in "wxy") or (n == 2 and not _consonant(w, 0) and _consonant(w, 1))


#: Suffixes of the Porter stemmer's later steps and what replaces them.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate",
         "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def porter_stem(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith("ies") and len(w) == 4:
        w = w[:-1]
    elif w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]

    def vowel(x: str) -> bool:
        return any(not _consonant(x, i) for i in range(len(x)))

    cut = next((x for x in ("ed", "ing") if w.endswith(x) and vowel(w[:-len(x)])), None)
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif cut:
        w = w[:-len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _consonant(w, len(w) - 1) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and len(w) > 2 and _consonant(w, len(w) - 2):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        for suffix in sorted(table, key=len, reverse=True):
            if w.endswith(suffix):
                stem = w[:-len(suffix)]
                w = stem + table[suffix] if _measure(stem + ("l" if suffix == "logi" else "")) > 0 else w
                break
    for suffix in sorted(STEP4, key=len, reverse=True):
        if w.endswith(suffix):
            stem = w[:-len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def meteor_score(reference: list[str], hypothesis: list[str], alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> float:
    """Weighted harmonic mean of unigram matches (equal words, then equal stems), less a penalty for their chunks."""
    left, right = dict(enumerate(hypothesis)), dict(enumerate(reference))
    matches: list[tuple[int, int]] = []
    for form in (str, porter_stem):
        for i in sorted(left, reverse=True):
            for j in sorted(right, reverse=True):
                if form(left[i]) == form(right[j]):
                    matches.append((i, j))
                    del left[i], right[j]
                    break
    if not matches:
        return 0.0
    matches.sort()
    p, r, n = len(matches) / len(hypothesis), len(matches) / len(reference), len(matches)
    chunks = 1 + sum((b[0], b[1]) != (a[0] + 1, a[1] + 1) for a, b in zip(matches, matches[1:]))
    return (1 - gamma * (chunks / n) ** beta) * p * r / (alpha * p + (1 - alpha) * r)


@F.pandas_udf(DoubleType())
def _meteor(prediction: pd.Series, references: pd.Series) -> pd.Series:
    return pd.Series([max((meteor_score(r.lower().split(), p.lower().split()) for r in rs), default=0.0) for p, rs in zip(prediction, references)], dtype="float64")


def meteor(pairs: DataFrame) -> DataFrame:
    """(case_id, meteor) of pairs (case_id, prediction, references): the best over the references, found once for equal texts."""
    scores = pairs.select("prediction", "references").distinct().withColumn("meteor", _meteor("prediction", "references"))
    return pairs.join(scores, ["prediction", "references"]).select("case_id", "meteor")
