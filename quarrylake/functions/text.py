"""Column functions over report texts; all stay in the JVM. (?U) makes Java's classes follow Unicode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.functions import lexicon as L

EMPTY = "<empty>"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_report(text: Column) -> Column:
    """Lower-case alphanumeric runs joined by one blank; EMPTY if there is none."""
    low = F.lower(text)
    # one replacement a row: an array of words joined again, also compared with "", would be made twice
    return F.when(low.rlike(L.WORD), F.trim(F.regexp_replace(low, L.NO_WORD, " "))).when(low.isNotNull(), EMPTY)


def grams(words: Column, n: int) -> Column:
    """Runs of n words joined by blanks; words must have n at least. (slice() would copy all words for each run.)"""
    def one(i):
        return F.concat(F.get(words, i), *(x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))))

    return F.transform(F.sequence(F.lit(0), F.size(words) - n), one)


def shingles(normal: Column, size: int = 5) -> Column:
    """Distinct word shingles of a normalised text, as strings; one short shingle for a short text."""
    return let(F.split(normal, " "), lambda w: F.when(F.size(w) < size, F.array(normal)).otherwise(F.array_distinct(grams(w, size))))


def shingle_hashes(normal: Column, size: int = 5) -> Column:
    """The same as 64-bit hashes."""
    return let(F.split(normal, " "), lambda w: F.when(F.size(w) < size, F.array(F.xxhash64(normal))).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 1 if both are empty."""
    both, sizes = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    # not in a branch, so that both is found once a row
    return F.coalesce(F.try_divide(both, sizes - both), F.when(sizes == 0, 1.0))


def clauses(text: Column) -> Column:
    """The clauses of a text as (begin, end, clause), offsets in code points, blank ones left out."""
    parts = F.split(text, f"(?U){L.CLAUSE_BREAK}")
    breaks = F.regexp_extract_all(text, F.lit(f"(?U){L.CLAUSE_BREAK}"), F.lit(0))
    rows = F.zip_with(parts, breaks, lambda p, b: F.struct(p.alias("p"), (F.length(p) + F.coalesce(F.length(b), F.lit(0))).alias("n")))
    none = F.expr("cast(array() as array<struct<begin:int,end:int,clause:string>>)")
    folded = F.aggregate(rows, F.struct(F.lit(0).alias("at"), none.alias("out")), lambda a, x: F.struct(
        (a["at"] + x["n"]).alias("at"),
        F.concat(a["out"], F.array(F.struct(a["at"].alias("begin"), (a["at"] + F.length(x["p"])).alias("end"), x["p"].alias("clause")))).alias("out")))
    return F.filter(folded["out"], lambda c: c["clause"].rlike(r"(?U)\S"))


def clause_texts(text: Column) -> Column:
    """The clauses of a text, blank ones left out."""
    return F.filter(F.split(text, f"(?U){L.CLAUSE_BREAK}"), lambda c: c.rlike(r"(?U)\S"))


def clause_table(reports: DataFrame) -> DataFrame:
    """(id, begin, end, clause) of reports (id, text), one text an id; offsets are running sums, so long texts cost no more."""
    pattern = f"(?U){L.CLAUSE_BREAK}"
    rows = F.zip_with(F.split("text", pattern), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda p, b: F.struct(p.alias("p"), (F.length(p) + F.coalesce(F.length(b), F.lit(0))).alias("n")))
    e = reports.select("id", F.posexplode(rows).alias("k", "x")).select("id", "k", "x.p", "x.n")
    before = F.coalesce(F.sum("n").over(W.partitionBy("id").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    e = e.withColumn("begin", before).where(F.col("p").rlike(r"(?U)\S"))
    return e.select("id", "begin", (F.col("begin") + F.length("p")).alias("end"), F.col("p").alias("clause"))


def is_coverage(clause: Column) -> Column:
    return clause.rlike(f"(?iuU){L.COVERAGE}") & clause.rlike(f"(?iuU){L.VISIBILITY}")


def tooth_side(tooth: Column) -> Column:
    return F.when(F.substring(tooth, 1, 1).isin("1", "4"), "right").otherwise("left")


def tooth_group(tooth: Column) -> Column:
    at = F.substring(tooth, 2, 1).cast("int")
    return F.concat(F.lit("tooth_group:"), F.concat_ws(
        "_", F.when(F.substring(tooth, 1, 1).isin("1", "2"), "upper").otherwise("lower"), tooth_side(tooth),
        F.when(at <= 3, "anterior").when(at <= 5, "premolar").otherwise("molar")))


def teeth(clause: Column) -> Column:
    """Sorted FDI numbers in a clause; a range within one quadrant stands for all its teeth."""
    def groups(pattern: str, g: int) -> Column:
        return F.regexp_extract_all(clause, F.lit(pattern), F.lit(g))

    single = F.zip_with(groups(f"(?U){L.FDI}", 1), groups(f"(?U){L.FDI}", 2), lambda q, p: F.concat(q, p))
    ranges = F.regexp_extract_all(clause, F.lit(f"(?iuU){L.FDI_RANGE}"), F.lit(0))

    def expand(r: Column) -> Column:
        q, a, q2, b = (F.regexp_extract(r, f"(?iuU){L.FDI_RANGE}", k) for k in (1, 2, 3, 4))
        lo, hi = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
        return F.when((q2 == "") | (q2 == q), F.transform(F.sequence(lo, hi), lambda p: F.concat(q, p.cast("string")))).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.concat(single, F.flatten(F.transform(ranges, expand)))))


def side(clause: Column, tooth: Column) -> Column:
    named = F.array_distinct(F.regexp_extract_all(F.lower(clause), F.lit(r"(?U)\b(left|right)\b"), F.lit(1)))
    return F.when(F.size(named) == 1, named[0]).when(tooth.isNotNull(), tooth_side(tooth))


def anatomy(clause: Column) -> Column:
    """The first anatomy, in declared order, that a clause names."""
    return F.coalesce(*(F.when(clause.rlike(f"(?iuU){p}"), name) for name, p in L.ANATOMY.items()))


def polarity(concept: Column, scope: Column, coverage: Column) -> Column:
    negated = F.when(concept == "missing", scope.rlike(f"(?iuU){L.NEGATED_MISSING}")).otherwise(scope.rlike(f"(?iuU){L.NEGATION}"))
    return F.when(~coverage & negated, "negative").otherwise("positive")


def metric_tokens(text: Column) -> Column:
    t = strip(F.lower(text))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def invalid_fdi(text: Column) -> Column:
    """Second numbers of decimal tooth numbers that name no tooth."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"(?U){L.INVALID_DECIMAL_FDI}"), F.lit(2)), lambda p: ~p.cast("int").between(1, 8))


def is_terminated(text: Column) -> Column:
    """Whether a non-blank text ends with a full stop, exclamation or question mark."""
    return text.rlike(r"(?U)[.!?]\s*\z")


def sentences(text: Column, least: int = 4) -> Column:
    """Normalised sentences of so many words at least."""
    return F.filter(F.transform(F.split(text, r"[.!?;\n]+"), normalize_report), lambda s: F.size(F.split(s, " ")) >= least)


def hash_offset(key: Column) -> Column:
    """The first 8 hexadecimal digits of the SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(key.cast("binary")), 1, 8), 16, 10).cast("long")


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where the denominator is 0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)}


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
