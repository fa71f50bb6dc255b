"""Removal of repeated line runs with a suffix array over line IDs (DataFrame operations only).

Every text is a sequence of lines; a line's ID is its rank among all lines that
occur twice, in the order of their hashes. Prefix doubling gives each position
the rank of the 2**k lines from there on, from the ranks of its two halves:
ranks follow the order of the line sequences, so the positions by rank are the
suffix array, and positions of one rank are an interval of it with a common
prefix of 2**k lines at least. Stretches of lines that occur once take no part.

A maximal repeated run of MIN_WORDS words loses all copies but the first, in
(doc_id, line) order. Each of its lines is in the fewest lines from there on
that have MIN_WORDS words or in the fewest up to the run's end that have them,
and these shorter runs repeat where it does. As a line counts for one word at
least, they have at most MIN_WORDS lines: ranks of up to that many lines decide
about runs of any length, so doubling ends there. A run of m lines is the pair
of ranks of its first and its last 2**k <= m lines, which overlap or meet.

Defined results: null stays null and empty stays empty; runs never cross
documents; a run with fewer words, such as a blank line, is never removed by
itself; repeated rows are documents of their own, the first stays; other
columns are kept, those with the names of the added counts are replaced. The
newline of a removed line goes with it. A null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.llm.common import broadcast_if_small, ordered_index, stored

#: A repeated run counts from so many words; a line counts as one word at least.
MIN_WORDS = 10
_ROW = "_line_dedup_row"
_GONE = "_line_dedup_gone"


def line_table(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line, h, words): the lines of each text; h: a 64-bit hash, row: a number of the document's row."""
    t = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    n = F.greatest(F.size(F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(1))
    return t.select("row", "doc_id", "line", F.xxhash64("t").alias("h"), n.alias("words"))


def _ranked(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): the distinct keys that occur twice at least, ranked in their order; counts are made before the shuffle."""
    return broadcast_if_small(ordered_index(pairs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), [F.col(k) for k in keys], name).select(*keys, name))


def repeated_stretches(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, line, words, stretch, rank0): lines that occur twice, where they and their neighbours that do have min_words words."""
    own = lines.join(_ranked(lines, ["h"], "rank0"), "h").select("row", "doc_id", "line", "words", "rank0")
    own = own.withColumn("stretch", F.col("line") - F.row_number().over(W.partitionBy("row").orderBy("line")))
    total = F.sum("words").over(W.partitionBy("row", "stretch"))
    return stored(own.withColumn("total", total).where(F.col("total") >= min_words).drop("total"))


def suffix_ranks(lines: DataFrame, most: int) -> DataFrame:
    """lines with rank1, rank2, ...: the rank of the 2**k lines from there on, NULL where they occur once; 2**k up to most."""
    k = 1
    while 1 << k <= most:
        ahead = F.lead(f"rank{k - 1}", 1 << (k - 1)).over(W.partitionBy("row", "stretch").orderBy("line"))
        lines = lines.withColumns({"a": F.col(f"rank{k - 1}"), "b": ahead})
        both = stored(lines)
        ranks = _ranked(both.where("a IS NOT NULL AND b IS NOT NULL"), ["a", "b"], f"rank{k}")
        lines = both.join(ranks, ["a", "b"], "left").drop("a", "b")
        k += 1
    return lines


def judged_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, doc_id, line, m, a, b): for each line the fewest from it on, and the fewest up to it, that have min_words words.

    a, b: the ranks of a run's first and last 2**k lines, as far as they repeat.
    """
    levels = [c for c in lines.columns if c.startswith("rank")]
    part = W.partitionBy("row", "stretch")
    upto = F.sum("words").over(part.orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow))
    t = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words")).withColumn("x", F.struct("line", "before", "upto", *levels))
    # words before a line, and up to it, grow by one a line at least: the frames hold min_words lines at most
    on = F.collect_list("x").over(part.orderBy("before").rangeBetween(W.currentRow, min_words - 1))
    back = F.collect_list("x").over(part.orderBy("upto").rangeBetween(1 - min_words, W.currentRow))
    runs = t.select("row", "doc_id", on.alias("on"), back.alias("back")).select("row", "doc_id", F.explode(F.array("on", "back")).alias("r")).select("row", "doc_id", "r", F.size("r").alias("m"))
    runs = runs.where(F.try_element_at("r", F.lit(-1))["upto"] - F.col("r")[0]["before"] >= min_words)
    # of the largest 2**k that a run has; as k falls, when() keeps the first that holds
    a = b = F
    for k in reversed(range(len(levels))):
        a, b = (x.when(F.col("m") >= 1 << k, F.get("r", at)[levels[k]]) for x, at in ((a, F.lit(0)), (b, F.col("m") - (1 << k))))
    return runs.select("row", "doc_id", F.col("r")[0]["line"].alias("line"), "m", a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def repeated_lines(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(row, line) of the lines to remove: those of all copies but the first of every repeated run."""
    runs = stored(judged_runs(suffix_ranks(repeated_stretches(stored(lines), min_words), min_words), min_words))
    first = runs.groupBy("m", "a", "b").agg(F.min(F.struct("doc_id", "row", "line")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(broadcast_if_small(stored(first)), ["m", "a", "b"]).where((F.col("f.row") != F.col("row")) | (F.col("f.line") != F.col("line")))
    return later.select("row", F.explode(F.sequence(F.col("line"), F.col("line") + F.col("m") - 1)).alias("line")).distinct()


def remove_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs without the later copies of repeated line runs, and two counts of lines: all, and removed ones."""
    rows = stored(docs.withColumn(_ROW, F.monotonically_increasing_id()))
    lines = line_table(rows.select(F.col(_ROW).alias("row"), "doc_id", "text"))
    gone = repeated_lines(lines, min_words).groupBy(F.col("row").alias(_ROW)).agg(F.collect_set("line").alias(_GONE))
    lines = F.split("text", "\n")
    # the places that stay are a difference of sets, so a text takes time in proportion to its lines
    places = lambda w: F.array_except(F.sequence(F.lit(0).cast("long"), F.size(w).cast("long") - 1), F.col(_GONE).cast("array<bigint>"))
    kept = F.get(F.transform(F.array(lines), lambda w: F.array_join(F.transform(places(w), lambda i: F.get(w, i.cast("int"))), "\n")), F.lit(0))
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(lines))
    out = rows.join(gone, _ROW, "left")
    return out.withColumns({counts[0]: n.cast("long"), counts[1]: F.coalesce(F.size(_GONE), F.lit(0)).cast("long"), "text": F.when(F.col(_GONE).isNull(), F.col("text")).otherwise(kept)}).drop(_ROW, _GONE)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeated_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: Every run by its lines' texts: from each line on, and up to each line, the fewest with ten words; later copies go.
ORACLE_OP8 = r"""
WITH l AS (SELECT doc_id, i-1 AS line, t, greatest(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')),1) w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)),1) i FROM documents)),
r AS (SELECT l.* FROM l JOIN (SELECT t FROM l GROUP BY t HAVING count(*)>1) USING (t)),
s AS (SELECT a.doc_id, a.line, b.line-a.line+1 m, sum(b.w) OVER q tot, count(*) OVER q c, string_agg(b.t, chr(10)) OVER q g
 FROM r a JOIN r b ON a.doc_id=b.doc_id AND b.line BETWEEN a.line AND a.line+15 WINDOW q AS (PARTITION BY a.doc_id, a.line ORDER BY b.line)),
e AS (SELECT a.doc_id, a.line, a.line-b.line+1 m, sum(b.w) OVER q tot, count(*) OVER q c, string_agg(b.t, chr(10)) OVER q g
 FROM r a JOIN r b ON a.doc_id=b.doc_id AND b.line BETWEEN a.line-15 AND a.line WINDOW q AS (PARTITION BY a.doc_id, a.line ORDER BY b.line DESC)),
f AS (SELECT 'on' d, doc_id, line, m, g FROM (SELECT * FROM s WHERE c=m AND tot>=10 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY m)=1)
 UNION ALL SELECT 'back', doc_id, line-m+1, m, g FROM (SELECT * FROM e WHERE c=m AND tot>=10 QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY m)=1)),
x AS (SELECT *, row_number() OVER (PARTITION BY d, g ORDER BY doc_id, line) k FROM f),
gone AS (SELECT DISTINCT doc_id, unnest(range(line, line+m)) line FROM x WHERE k>1),
k AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY line) kept FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY 1),
g AS (SELECT doc_id, count(*) n FROM gone GROUP BY 1)
SELECT d.doc_id, (CASE WHEN coalesce(text,'')='' THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT n_lines, coalesce(n,0)::BIGINT n_removed, sha256(coalesce(kept,'')) kept_sha256
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN g USING (doc_id)
"""
