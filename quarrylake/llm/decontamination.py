"""Benchmark decontamination with a distributed positional inverted index (DataFrame operations only).

The index keeps, for each term that a query list needs, its postings
(term, doc_id, pos, context). A window of a benchmark item is looked up by its
rarest term in the corpus; the postings of that term are intersected with the
offset-adjusted positions of the window's other terms, second rarest first.

Defined results: a null or word-less text has no words, no hits and is clean;
a null item has no windows; repeated items count under each item_id, and once
where item_id and text are the same; rows that share a doc_id are documents of
their own, told apart by their texts; extra columns are ignored; empty tables
give empty or all-clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import broadcast_if_small, small_enough, stored

#: All that is no word character of a text not yet lower-cased.
GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Rows and characters of what the windows are looked up by, up to which it is broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32_000_000


def words(text: Column) -> Column:
    """The words of a text as written; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def fold(word: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(word, UPPER, LOWER)


def _maybe_broadcast(df: DataFrame, *texts: str) -> DataFrame:
    """df to be broadcast if its rows are few enough and so are the characters of its texts, columns of strings or arrays of them."""
    size = sum((F.length(F.array_join(x, " ") if dict(df.dtypes)[x].startswith("array") else F.col(x)) for x in texts), F.lit(0))
    small = small_enough(df, BROADCAST_ROWS) and (df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BROADCAST_CHARS)
    return F.broadcast(df) if small else df


def query_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, m, pos, term, key): the words of each distinct item. key, lower(term), is equal for terms equal after fold()."""
    w = items.select("item_id", "text").distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", words(F.col("text")).alias("w"))
    return w.select("item", "item_id", F.size("w").alias("m"), F.posexplode("w").alias("pos", "word")).select(
        "item", "item_id", "m", "pos", fold(F.col("word")).alias("term"), F.lower("word").alias("key"))


def term_counts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, cf): occurrences in the corpus of each wanted key; partial counts are made before the shuffle."""
    seen = docs.select(F.explode(F.split("text", GAPS)).alias("word")).select(F.lower("word").alias("key"))
    wanted = stored(keys.select("key").distinct())
    return stored(seen.join(_maybe_broadcast(wanted, "key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("cf")))


def document_key(docs: DataFrame) -> Column:
    """What tells documents apart: equal for rows with one doc_id and one text, whose results are the same."""
    return F.xxhash64(docs["doc_id"], docs["text"])


def build_index(docs: DataFrame, keys: DataFrame, reach: int = WINDOW - 1) -> DataFrame:
    """Postings (key, doc, doc_id, pos, ctx, at) of the wanted keys; ctx: the folded words within reach, at: the term's place in it (from 0)."""
    w = docs.select(document_key(docs).alias("doc"), "doc_id", words(F.col("text")).alias("w"))
    e = w.select("doc", "doc_id", "w", F.posexplode("w").alias("pos", "word")).withColumn("key", F.lower("word"))
    hit = e.join(_maybe_broadcast(stored(keys.select("key").distinct()), "key"), "key", "left_semi")
    start = F.greatest(F.col("pos") - reach, F.lit(0))
    ctx = F.slice("w", start + 1, F.col("pos") - start + 1 + reach)
    return hit.select("key", "doc", "doc_id", "pos", F.transform(ctx, fold).alias("ctx"), (F.col("pos") - start).alias("at"))


def plan_windows(terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, item_id, m, pos, key, second, ictx, iat): for each window that can occur its rarest term, once per place in an item.

    second: offset of the rarest other term of the window, as seen from the rarest; ictx and iat: the item's words around it.
    """
    t = terms.join(_maybe_broadcast(counts, "key"), "key", "left").fillna(0, ["cf"])
    item = t.groupBy("item", "item_id", "m").agg(F.sort_array(F.collect_list(F.struct("pos", "term", "key", "cf"))).alias("w"))
    size = F.least("m", F.lit(window))
    wins = item.select("item", "item_id", "m", "w", F.explode(F.sequence(F.lit(0), F.col("m") - size)).alias("s"), size.alias("k"))
    order = F.sort_array(F.transform(F.slice("w", F.col("s") + 1, F.col("k")), lambda x: F.struct(x.cf.alias("cf"), x.pos.alias("pos"))))
    wins = wins.select("item", "item_id", "m", "w", order.alias("o")).where(F.col("o")[0].cf > 0)
    wins = wins.select("item", "item_id", "m", "w", F.col("o")[0].pos.alias("pos"),
                       F.when(F.size("o") > 1, F.get("o", F.lit(1)).pos - F.col("o")[0].pos).otherwise(0).alias("second"))
    # one row for each rarest place and second term; the exact check covers every window through that place
    wins = wins.dropDuplicates(["item", "pos", "second"])
    start = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    return wins.select("item", "item_id", "m", "pos", F.col("w")[F.col("pos")].key.alias("key"), "second",
                       F.transform(F.slice("w", start + 1, F.col("pos") - start + window), lambda x: x.term).alias("ictx"),
                       (F.col("pos") - start).alias("iat"))


def _run(left: bool, window: int) -> Column:
    """Equal neighbours of the matched term on one side, as far as the context goes."""
    step = -1 if left else 1
    # the first place of 1..window at which the two contexts differ or end
    same = F.transform(F.sequence(F.lit(1), F.lit(window)), lambda d: F.coalesce(
        F.get("ctx", F.col("at") + d * step) == F.get("ictx", F.col("iat") + d * step), F.lit(False)))
    return F.array_position(same, False).cast("int") - 1


def phrase_matches(index: DataFrame, plan: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, doc_id, item_id, start, end): runs of document words, end exclusive, that hold an occurrence of a window."""
    both = index.withColumnRenamed("pos", "pos_d").join(_maybe_broadcast(plan.drop("pos", "item"), "key", "ictx"), "key")
    both = both.where(F.get("ctx", F.col("at") + F.col("second")) == F.get("ictx", F.col("iat") + F.col("second")))
    runs = both.select("doc", "doc_id", "item_id", "m", "pos_d", _run(True, window).alias("l"), _run(False, window).alias("r"))
    runs = runs.where(F.col("l") + F.col("r") + 1 >= F.least("m", F.lit(window)))
    return runs.select("doc", "doc_id", "item_id", (F.col("pos_d") - F.col("l")).alias("start"), (F.col("pos_d") + F.col("r") + 1).alias("end"))


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(doc_id, query_id, start): places of each query's rarest term with all its other terms within slop words.

    queries: (query_id, terms array<string>). A query with no terms matches nothing.
    """
    t = queries.select("query_id", F.posexplode(F.array_distinct(F.transform("terms", fold))).alias("pos", "term")).withColumn("key", F.lower("term"))
    counts = term_counts(docs, t)
    ranked = t.join(broadcast_if_small(counts), "key", "left").fillna(0, ["cf"]).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("cf", "term", "key"))).alias("o"))
    plan = ranked.where(F.col("o")[0].cf > 0).select("query_id", F.col("o")[0].key.alias("key"), F.col("o")[0].term.alias("first"), F.transform("o", lambda x: x.term).alias("need"))
    found = build_index(docs, plan, slop).join(_maybe_broadcast(plan, "need"), "key")
    ok = (F.get("ctx", F.col("at")) == F.col("first")) & (F.size(F.array_except("need", "ctx")) == 0)
    return found.where(ok).select("doc_id", "query_id", F.col("pos").alias("start"))


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, doc_id, item_id, start, end) for docs(doc_id, text) and items(item_id, text)."""
    terms = stored(query_terms(items))
    plan = stored(plan_windows(terms, term_counts(docs, terms), window))
    return phrase_matches(build_index(docs, plan, window - 1), plan, window)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: n_words, n_hit, n_items, item_ids (sorted as strings), contaminated (share * n_hit >= n_words > 0 and a hit)."""
    m = find_contamination(docs.select("doc_id", "text"), items.select("item_id", "text"), window)
    # overlapping runs are merged per document: a row for each distinct run only
    per = m.groupBy("doc").agg(
        F.collect_set(F.struct("start", "end")).alias("runs"), F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    merged = F.aggregate(
        F.sort_array("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a.n + F.greatest(x.end - F.greatest(x.start, a.to), F.lit(0))).cast("long").alias("n"), F.greatest(a.to, x.end).alias("to"))).n
    per = per.select("doc", merged.alias("n_hit"), F.array_sort("ids").alias("item_ids"))
    n = docs.select("doc_id", document_key(docs).alias("doc"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = n.join(per, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))
    return out.withColumns({
        "n_items": F.size("item_ids").cast("long"),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))})


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    c = contamination(docs, items)
    return c.select("doc_id", "n_words", "n_hit", "n_items",
                    F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


#: The same rows, by joining every document word with every window's words.
ORACLE_OP1 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w),13) k FROM bw WHERE len(w)>0),
win AS (SELECT DISTINCT item_id, least(len(w),13) k, array_to_string(w[s:s+least(len(w),13)-1],' ') g FROM (SELECT item_id, w, unnest(range(1, len(w)-least(len(w),13)+2)) s FROM bw WHERE len(w)>0)),
dg AS (SELECT doc_id, k, s, array_to_string(w[s:s+k-1],' ') g FROM (SELECT doc_id, w, k, unnest(range(1, len(w)-k+2)) s FROM dw, lens WHERE len(w)>=k)),
hit AS (SELECT doc_id, s, k, item_id FROM dg JOIN win USING (k, g)),
nh AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s+k)) p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) n_items, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR i FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit,0)::BIGINT n_hit, coalesce(n_items,0)::BIGINT n_items, sha256(coalesce(ids,'')) items_sha256,
 coalesce(n_hit,0)>0 AND 20*coalesce(n_hit,0)>=len(w) contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
