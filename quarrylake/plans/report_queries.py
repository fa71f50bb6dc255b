"""Queries over report texts: scalars, duplicates, splits, sampling. Q: name -> (callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import assertions as A
from quarrylake.functions import lexicon as L
from quarrylake.functions import text as T
from quarrylake.operators import dedup, records, sampling, split
from quarrylake.operators.storage import broadcast_if_small
from quarrylake.plans.generated import generated, with_tables

Q: dict[str, tuple] = {}


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        Q[name] = (f, with_tables(sql, *tables) if sql and tables else sql)
        return f

    return add


def docs(spark, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


NORMAL = "coalesce(nullif(array_to_string(regexp_extract_all(lower({0}), '[a-z0-9]+'), ' '), ''), '<empty>')"
# the words of a text, and its shingles one a row: w must be string_split(normal, ' ')
SHINGLES = "unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' ')))"
REPORTS = "gen_reports"


@query("p1_normalize", f"SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents")
def p1(spark, d):
    return docs(spark, d).select("doc_id", T.normalize_report(F.col("text")).alias("normal"))


@query("p2_shingles", f"WITH n AS (SELECT doc_id, string_split({NORMAL.format('text')}, ' ') w FROM documents), s AS (SELECT doc_id, {SHINGLES} s FROM n) SELECT doc_id, count(DISTINCT s) AS n, min(s) AS first, max(s) AS last FROM s GROUP BY 1")
def p2(spark, d):
    s = docs(spark, d).select("doc_id", T.shingles(T.normalize_report(F.col("text"))).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("first"), F.array_max("s").alias("last"))


@query("p3_jaccard", f"""WITH n AS (SELECT doc_id, string_split({NORMAL.format('text')}, ' ') w FROM documents), s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {SHINGLES} s FROM n)), k AS (SELECT doc_id, count(*) c FROM s GROUP BY 1),
i AS (SELECT a.doc_id, count(*) i FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND a.s = b.s GROUP BY 1)
SELECT a.doc_id, CAST(coalesce(i, 0) AS DOUBLE) / (a.c + b.c - coalesce(i, 0)) AS jaccard FROM k a JOIN k b ON b.doc_id = a.doc_id + 1 LEFT JOIN i ON i.doc_id = a.doc_id""")
def p3(spark, d):
    s = docs(spark, d).select("doc_id", T.shingle_hashes(T.normalize_report(F.col("text"))).alias("s"))
    return dedup.followed(s, "doc_id", "s").select("doc_id", T.jaccard(F.col("s"), F.col("next")).alias("jaccard"))


@query("p4_clauses", "SELECT rid, c AS clause, ord::BIGINT AS ord FROM (SELECT rid, unnest(l) c, unnest(range(1, len(l) + 1)) ord FROM (SELECT rid, list_filter(string_split_regex(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') l FROM gen_reports))", REPORTS)
def p4(spark, d):
    r = generated(spark, d, REPORTS).select("rid", F.posexplode(T.clauses(F.col("text"))).alias("ord", "c"))
    return r.select("rid", F.col("c.clause").alias("clause"), (F.col("ord") + 1).cast("long").alias("ord"))


@query("p5_coverage", "SELECT rid, regexp_matches(text, '(?i)\\b(?:scan|acquisition|field of view|volume|available scans?|included|excluded|not visible|not assessable|non[- ]evaluable|partially visuali[sz]ed)\\b') AND regexp_matches(text, '(?i)\\b(?:included|excluded|visible|assessable|visuali[sz]ed|field of view|volume)\\b') AS coverage FROM gen_reports", REPORTS)
def p5(spark, d):
    return generated(spark, d, REPORTS).select("rid", T.is_coverage(F.col("text")).alias("coverage"))


def read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


TEETH = "(SELECT p_partkey, CAST(p_partkey % 4 + 1 AS VARCHAR) || CAST(p_size % 8 + 1 AS VARCHAR) t FROM part)"


def teeth_table(spark, d):
    """A tooth a part."""
    tooth = F.concat((F.col("p_partkey") % 4 + 1).cast("string"), (F.col("p_size") % 8 + 1).cast("string"))
    return read(spark, d, "part").select("p_partkey", tooth.alias("t"))


@query("p6_tooth_side", f"SELECT p_partkey, t, CASE WHEN t[1] IN ('1','4') THEN 'right' ELSE 'left' END AS side FROM {TEETH}")
def p6(spark, d):
    return teeth_table(spark, d).select("p_partkey", "t", T.tooth_side(F.col("t")).alias("side"))


@query("p7_tooth_group", f"SELECT p_partkey, t, 'tooth_group:' || CASE WHEN t[1] IN ('1','2') THEN 'upper' ELSE 'lower' END || '_' || CASE WHEN t[1] IN ('1','4') THEN 'right' ELSE 'left' END || '_' || CASE WHEN t[2]::INT <= 3 THEN 'anterior' WHEN t[2]::INT <= 5 THEN 'premolar' ELSE 'molar' END AS tooth_group FROM {TEETH}")
def p7(spark, d):
    return teeth_table(spark, d).select("p_partkey", "t", T.tooth_group(F.col("t")).alias("tooth_group"))


# the generated reports name a decimal tooth, and by branch a range, 4.6 and 12
@query("p8_fdi_teeth", """SELECT p_partkey AS rid, array_to_string(list_sort(list_distinct(list_concat([CAST(p_partkey % 4 + 1 AS VARCHAR) || CAST(p_size % 8 + 1 AS VARCHAR)],
 list_concat(CASE WHEN p_size % 4 = 2 THEN ['31','32','33','46'] ELSE [] END, CASE WHEN p_partkey % 3 = 1 THEN ['12'] ELSE [] END)))), ',') AS teeth FROM part""")
def p8(spark, d):
    return generated(spark, d, REPORTS).select("rid", F.array_join(T.teeth(F.col("text")), ",").alias("teeth"))


@query("p10_side", "SELECT rid, CASE WHEN len(s) = 1 THEN s[1] END AS side FROM (SELECT rid, list_distinct(regexp_extract_all(lower(text), '\\b(left|right)\\b')) s FROM gen_reports)", REPORTS)
def p10(spark, d):
    return generated(spark, d, REPORTS).select("rid", T.side(F.col("text"), F.lit(None).cast("string")).alias("side"))


@query("p11_anatomy", "SELECT rid, CASE WHEN regexp_matches(text,'(?i)\\bmandibular canal\\b') THEN 'mandibular_canal' WHEN regexp_matches(text,'(?i)\\bmaxillary sinus(?:es)?\\b') THEN 'maxillary_sinus' WHEN regexp_matches(text,'(?i)\\bTMJ\\b|temporomandibular joint|mandibular condyle') THEN 'tmj' WHEN regexp_matches(text,'(?i)\\bmandib(?:le|ular)\\b') THEN 'mandible' WHEN regexp_matches(text,'(?i)\\bmaxill(?:a|ary)\\b') THEN 'maxilla' END AS anatomy FROM gen_reports", REPORTS)
def p11(spark, d):
    return generated(spark, d, REPORTS).select("rid", T.anatomy(F.col("text")).alias("anatomy"))


@query("p12_polarity", "SELECT rid, CASE WHEN regexp_matches(text, '(?i)\\b(?:no|not|without|absent|absence of|no evidence of|no definite|negative for)\\b') THEN 'negative' ELSE 'positive' END AS lesion, CASE WHEN regexp_matches(text, '(?i)\\b(?:no|without)\\s+(?:evidence of\\s+)?(?:missing|absent)\\b') THEN 'negative' ELSE 'positive' END AS missing FROM gen_reports", REPORTS)
def p12(spark, d):
    return generated(spark, d, REPORTS).select("rid", *(T.polarity(F.lit(c), F.col("text"), F.lit(False)).alias(c) for c in ("lesion", "missing")))


def report_assertions(spark, d):
    return A.extract_assertions(generated(spark, d, REPORTS).select(F.col("case_id").alias("id"), "text"))


# clauses of the generated reports, which part them by one blank
CLAUSES = "clauses AS (SELECT rid, id, c, ord FROM (SELECT rid, case_id id, unnest(l) c, unnest(range(1, len(l) + 1)) ord FROM (SELECT rid, case_id, string_split_regex(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)) l FROM gen_reports)) WHERE trim(c) <> '')"
COVERED = f"(regexp_matches({{0}}, '(?i){L.COVERAGE}') AND regexp_matches({{0}}, '(?i){L.VISIBILITY}'))"
GROUP = """'tooth_group:' || CASE WHEN tooth_number[1] IN ('1', '2') THEN 'upper' ELSE 'lower' END || '_' || CASE WHEN tooth_number[1] IN ('1', '4') THEN 'right' ELSE 'left' END || '_' ||
 CASE WHEN tooth_number[2]::INT <= 3 THEN 'anterior' WHEN tooth_number[2]::INT <= 5 THEN 'premolar' ELSE 'molar' END"""
_PATTERNS = ", ".join(f"({k}, {f"'{c}'" if c else 'NULL'}, '(?i){p}')" for k, (c, p) in enumerate([*L.CONCEPTS.items(), (None, L.PRESENCE)]))
_ANATOMY = " ".join(f"WHEN regexp_matches({{0}}, '(?i){p}') THEN '{name}'" for name, p in L.ANATOMY.items())
#: Tooth numbers without lookaround: digit runs of one or two; the only range of the generated reports is 31 to 33.
_TEETH = """list_distinct(list_concat(list_concat(list_filter(regexp_extract_all(d3, '[0-9][0-9]'), lambda t: t[1] BETWEEN '1' AND '4' AND t[2] BETWEEN '1' AND '8'),
 list_transform(regexp_extract_all(regexp_replace(d3, '[0-9][0-9]', 'x', 'g'), '[1-4]\\s*[.]?\\s*[1-8]'), lambda t: t[1] || t[-1])), CASE WHEN contains(d3, '31 to 3') THEN ['31', '32', '33'] ELSE [] END))"""
ASSERTIONS = f"""{CLAUSES}, pat(rank, concept, p) AS (VALUES {_PATTERNS}), cl AS (SELECT DISTINCT id, c FROM clauses),
f AS (SELECT id, c, rank, concept, regexp_extract_all(c, p) f, string_split_regex(c, p) s FROM cl, pat),
m AS (SELECT id, c, rank, concept, f, s, unnest(range(1, len(f) + 1)) i FROM f),
a AS (SELECT id, c, rank, concept, e - n b, e FROM (SELECT id, c, rank, concept, len(f[i]) n, list_sum(list_transform(range(1, i + 1), lambda j: len(f[j]) + len(s[j])))::BIGINT e FROM m)),
apart AS (SELECT * FROM a WHERE concept IS NOT NULL OR NOT EXISTS (SELECT 1 FROM a y WHERE y.id = a.id AND y.c = a.c AND y.concept IS NOT NULL AND a.b < y.e AND y.b < a.e)),
runs AS (SELECT *, sum(new) OVER (PARTITION BY id, c ORDER BY b, e, rank) run FROM (SELECT *, CASE WHEN lag(concept) OVER w = concept AND b - lag(e) OVER w <= 2 THEN 0 ELSE 1 END new FROM apart WINDOW w AS (PARTITION BY id, c ORDER BY b, e, rank))),
kept AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY id, c, run ORDER BY b, e, rank) % 2 = 1),
sc AS (SELECT id, c, concept, substr(c, l + 1, r - l) scope FROM (SELECT *, coalesce((lag(b + e) OVER w + b + e) // 4, 0) l, coalesce((b + e + lead(b + e) OVER w) // 4, len(c)) r FROM kept WINDOW w AS (PARTITION BY id, c ORDER BY b, e, rank)) WHERE concept IS NOT NULL),
th AS (SELECT *, {COVERED.format('scope')} cover, {_TEETH} t FROM (SELECT *, regexp_replace(scope, '[0-9]{{3,}}', 'x', 'g') d3 FROM sc)),
one AS (SELECT *, unnest(CASE WHEN len(t) > 0 THEN t ELSE [NULL] END) tooth_number, list_distinct(regexp_extract_all(lower(scope), '\\b(left|right)\\b', 1)) named FROM th),
found AS (SELECT DISTINCT id, concept, tooth_number, CASE WHEN tooth_number IS NULL THEN coalesce(CASE {_ANATOMY.format('scope')} END, CASE {_ANATOMY.format('c')} END) END AS anatomy,
 CASE WHEN len(named) = 1 THEN named[1] WHEN tooth_number[1] IN ('1', '4') THEN 'right' WHEN tooth_number IS NOT NULL THEN 'left' END AS side,
 CASE WHEN NOT cover AND regexp_matches(scope, CASE WHEN concept = 'missing' THEN '(?i){L.NEGATED_MISSING}' ELSE '(?i){L.NEGATION}' END) THEN 'negative' ELSE 'positive' END AS polarity,
 CASE WHEN cover THEN 'coverage' ELSE 'case-specific' END AS clause_type FROM one)"""


@query("p13_assertions", f"WITH {ASSERTIONS} SELECT * FROM found", REPORTS)
def p13(spark, d):
    return report_assertions(spark, d)


@query("p14_multilabels", f"WITH {ASSERTIONS} SELECT DISTINCT id, 'finding:' || concept AS label FROM found WHERE polarity = 'positive' AND concept IN {L.LABELLED_CONCEPTS} UNION SELECT id, {GROUP} FROM found WHERE polarity = 'positive' AND tooth_number IS NOT NULL", REPORTS)
def p14(spark, d):
    return A.labels(report_assertions(spark, d))


@query("p15_weighting_labels", f"WITH {ASSERTIONS} SELECT DISTINCT id, 'finding:' || concept AS label FROM found WHERE polarity = 'positive' AND concept IN {L.LABELLED_CONCEPTS} UNION SELECT id, 'tooth:' || tooth_number FROM found WHERE polarity = 'positive' AND tooth_number IS NOT NULL", REPORTS)
def p15(spark, d):
    return A.labels(report_assertions(spark, d), by_group=False)


@query("p16_structured_targets", f"WITH {ASSERTIONS}, x AS (SELECT * FROM found WHERE polarity = 'positive' AND clause_type = 'case-specific') SELECT DISTINCT id, tooth_number, concept FROM x WHERE tooth_number IS NOT NULL AND concept IN {L.TOOTH_CONCEPTS} UNION SELECT id, NULL, concept FROM x WHERE concept IN {L.CASE_CONCEPTS}", REPORTS)
def p16(spark, d):
    tooth, case = A.structured_targets(report_assertions(spark, d))
    return tooth.unionByName(case.withColumn("tooth_number", F.lit(None).cast("string")))


@query("p17_token_weights", f"""WITH {CLAUSES}, w AS (SELECT rid, unnest(range(0, len(text), 7)) AS b FROM gen_reports),
o AS (SELECT rid, c, begin, begin + len(c) fin FROM (SELECT rid, c, (sum(len(c) + 1) OVER (PARTITION BY rid ORDER BY ord) - len(c) - 1)::BIGINT AS begin FROM clauses)),
h AS (SELECT w.rid, b, arg_min(c, begin) c FROM w LEFT JOIN o ON o.rid = w.rid AND b < fin AND b + 5 > begin GROUP BY 1, 2)
SELECT rid AS id, b AS begin, b + 5 AS "end", CASE WHEN c IS NULL THEN 1.0 WHEN {COVERED.format('c')} THEN 0.2 ELSE 2.0 END::DOUBLE AS weight FROM h""", REPORTS)
def p17(spark, d):
    r = generated(spark, d, REPORTS).select(F.col("rid").alias("id"), "text")
    words = r.select("id", F.explode(F.sequence(F.lit(0), F.length("text") - 1, F.lit(7))).alias("begin"))
    return A.token_weights(words.select("id", "begin", (F.col("begin") + 5).alias("end")), r, 0.2, 2.0)


@query("p18_metric_tokens", "SELECT rid, array_to_string(string_split_regex(trim(lower(text)), '\\s+'), '|') AS tokens FROM gen_reports", REPORTS)
def p18(spark, d):
    return generated(spark, d, REPORTS).select("rid", F.array_join(T.metric_tokens(F.col("text")), "|").alias("tokens"))


@query("p20_invalid_fdi", "SELECT 'C' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS case_id, CASE WHEN p_size % 11 BETWEEN 1 AND 8 THEN 0 ELSE 1 END AS n FROM part")
def p20(spark, d):
    return generated(spark, d, "gen_predictions").select("case_id", F.size(T.invalid_fdi(F.col("prediction"))).alias("n"))


@query("p21_terminated", "SELECT case_id, regexp_matches(prediction, '[.!?]\\s*$') AS terminated FROM gen_predictions", "gen_predictions")
def p21(spark, d):
    return generated(spark, d, "gen_predictions").select("case_id", T.is_terminated(F.col("prediction")).alias("terminated"))


@query("p22_sentences", f"SELECT case_id, s AS sentence, count(*) AS n FROM (SELECT case_id, unnest(list_filter(list_transform(string_split_regex(prediction, '[.!?;\\n]+'), lambda x: {NORMAL.format('x')}), lambda y: len(string_split(y, ' ')) >= 4)) s FROM gen_predictions) GROUP BY 1, 2", "gen_predictions")
def p22(spark, d):
    return generated(spark, d, "gen_predictions").select("case_id", F.explode(T.sentences(F.col("prediction"))).alias("sentence")).groupBy("case_id", "sentence").agg(F.count("*").alias("n"))


@query("p23_hash_offset", "SELECT doc_id, CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS off FROM documents")
def p23(spark, d):
    return docs(spark, d).select("doc_id", T.hash_offset(F.col("doc_id").cast("string")).alias("off"))


@query("p25_exact_match", "SELECT avg(CASE WHEN trim(prediction) = trim(reference2) THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_match FROM gen_predictions", "gen_predictions")
def p25(spark, d):
    return generated(spark, d, "gen_predictions").agg(F.avg((T.strip(F.col("prediction")) == T.strip(F.col("reference2"))).cast("double")).alias("exact_match"))


@query("j1_exact_groups", f"SELECT min(doc_id) AS id, count(*) AS n FROM (SELECT doc_id, {NORMAL.format('text')} normal FROM documents) GROUP BY normal")
def j1(spark, d):
    return dedup.exact_groups(docs(spark, d).withColumnRenamed("doc_id", "id")).select("id", "n")


NEAR = f"""n AS (SELECT doc_id, {NORMAL.format('text')} normal FROM documents), g AS (SELECT min(doc_id) id, normal FROM n GROUP BY normal),
s AS (SELECT DISTINCT id, h FROM (SELECT id, {SHINGLES} h FROM (SELECT id, string_split(normal, ' ') w FROM g))), k AS (SELECT id, count(*) c FROM s GROUP BY 1),
p AS (SELECT x.id a, y.id b, count(*) i FROM s x JOIN s y ON x.h = y.h AND x.id < y.id GROUP BY 1, 2),
near AS (SELECT a, b, CAST(i AS DOUBLE) / (ka.c + kb.c - i) jaccard FROM p JOIN k ka ON ka.id = a JOIN k kb ON kb.id = b WHERE CAST(i AS DOUBLE) / (ka.c + kb.c - i) >= 0.85)"""


@query("j2_near_pairs", f"WITH {NEAR} SELECT a, b, jaccard FROM near")
def j2(spark, d):
    return dedup.near_pairs(docs(spark, d).withColumnRenamed("doc_id", "id"))


@query("a1_duplicate_groups", f"""WITH RECURSIVE {NEAR}, e AS (SELECT n.doc_id a, g.id b FROM n JOIN g USING (normal) WHERE n.doc_id <> g.id UNION ALL SELECT a, b FROM near),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.id WHERE r.m < u.b)
SELECT n.doc_id AS id, (SELECT min(m) FROM r WHERE r.id = n.doc_id) AS duplicate_group, g.id AS template_group FROM n JOIN g USING (normal)""")
def a1(spark, d):
    return dedup.duplicate_groups(docs(spark, d).withColumnRenamed("doc_id", "id"))


def cases(spark, d):
    r = generated(spark, d, "gen_records")
    return r.withColumn("labels", F.array("label", "label2"))


LABELLED = "l AS (SELECT case_id, unnest(list_distinct([label, label2])) label FROM gen_records), c AS (SELECT label, count(*) n FROM l GROUP BY 1)"


@query("a3_label_counts", "SELECT duplicate_group, label, count(*) AS n FROM (SELECT duplicate_group, unnest(list_distinct([label, label2])) label FROM gen_records) GROUP BY 1, 2", "gen_records")
def a3(spark, d):
    return split.label_counts(cases(spark, d), "duplicate_group")


@query("a4_multilabel_split")
def a4(spark, d):
    c = cases(spark, d)
    chosen = split.split_by_kinds(c, 0.2, 42)
    return c.join(broadcast_if_small(chosen.withColumn("valid", F.lit(True))), "duplicate_group", "left").select("case_id", F.coalesce("valid", F.lit(False)).alias("valid"))


def _rounds(k: int) -> str:
    out = "w0 AS MATERIALIZED (SELECT case_id, avg((1 - 0.99) / (1 - pow(0.99, n))) w FROM l JOIN c USING (label) GROUP BY 1)"
    for i in range(k):
        out += f", w{i + 1} AS MATERIALIZED (SELECT case_id, least(greatest(w / (SELECT avg(w) FROM w{i}), 0.25), 4.0) w FROM w{i})"
    return out


@query("a5_effective_weights", f"WITH {LABELLED}, {_rounds(12)} SELECT case_id, round(w, 9) AS weight FROM w12", "gen_records")
def a5(spark, d):
    return split.effective_weights(cases(spark, d)).select("case_id", F.round("weight", 9).alias("weight"))


@query("a6_audit", "SELECT CASE WHEN reports = 1 THEN 'valid' ELSE 'train' END AS split, count(*) AS cases, count(DISTINCT duplicate_group) AS groups, min(CASE WHEN reports > 1 THEN reports / 2.0 END)::DOUBLE AS min_weight, max(CASE WHEN reports > 1 THEN reports / 2.0 END)::DOUBLE AS max_weight, round(avg(CASE WHEN reports > 1 THEN reports / 2.0 END), 9)::DOUBLE AS mean_weight FROM gen_records GROUP BY 1", "gen_records")
def a6(spark, d):
    c = cases(spark, d).withColumns({"split": F.when(F.col("reports") == 1, "valid").otherwise("train"), "weight": F.col("reports") / 2.0})
    return split.audit(c).withColumn("mean_weight", F.round("mean_weight", 9))


@query("j9_leaked_groups", "SELECT DISTINCT duplicate_group FROM gen_records WHERE reports = 1 AND duplicate_group IN (SELECT duplicate_group FROM gen_records WHERE reports > 1)", "gen_records")
def j9(spark, d):
    c = cases(spark, d)
    return split.leaked_groups(c.where("reports > 1"), c.where("reports = 1"))


@query("v6_modulo_folds", "SELECT id, (row_number() OVER (ORDER BY id) - 1) % 5 AS fold FROM (SELECT DISTINCT duplicate_group id FROM gen_records)", "gen_records")
def v6(spark, d):
    return split.modulo_folds(cases(spark, d).select(F.col("duplicate_group").alias("id")), 5).withColumn("fold", F.col("fold").cast("long"))


@query("w1_epoch_sample", """SELECT case_id, duplicate_group FROM (SELECT *, row_number() OVER (PARTITION BY duplicate_group ORDER BY a) k FROM (
 SELECT *, row_number() OVER (PARTITION BY duplicate_group, template_group ORDER BY a) t FROM (
 SELECT *, ((i - 5 * least(n, 4)) % n + n) % n a FROM (SELECT *, row_number() OVER (PARTITION BY duplicate_group ORDER BY case_id) - 1 i, count(*) OVER (PARTITION BY duplicate_group) n FROM gen_records))) WHERE t <= 2) WHERE k <= least(n, 4)""", "gen_records")
def w1(spark, d):
    return sampling.epoch_sample(generated(spark, d, "gen_records"), epoch=5, cap=2, near_cap=4).select("case_id", "duplicate_group")


@query("w2_annotation_index", "SELECT case_id, (CAST('0x' || substr(sha1(case_id), 1, 8) AS BIGINT) + 42 + 3) % reports AS annotation FROM gen_records", "gen_records")
def w2(spark, d):
    return generated(spark, d, "gen_records").select("case_id", sampling.annotation_index(F.col("case_id"), F.col("reports"), 42, 3).cast("long").alias("annotation"))


@query("w4_rank_shard", "SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 i, count(*) OVER () n FROM gen_records) WHERE i < n - n % 7 AND i % 7 = 3", "gen_records")
def w4(spark, d):
    return sampling.shard(generated(spark, d, "gen_records").select("case_id"), ["case_id"], 3, 7, drop_last=True)


@query("w5_eval_shard", "SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY case_id) - 1 i FROM gen_records) WHERE i % 7 = 6", "gen_records")
def w5(spark, d):
    return sampling.shard(generated(spark, d, "gen_records").select("case_id"), ["case_id"], 6, 7)


@query("v1_work_list", "SELECT case_id FROM (SELECT case_id, reports, row_number() OVER (ORDER BY case_id) - 1 i FROM gen_records) WHERE i % 4 = 1 AND reports <> 2", "gen_records")
def v1(spark, d):
    r = generated(spark, d, "gen_records")
    done = r.where("reports = 2").select("case_id")
    return sampling.shard(r.select("case_id"), ["case_id"], 1, 4).join(done, "case_id", "left_anti")


@query("w7_derangement", "SELECT case_id, coalesce(lead(case_id) OVER (ORDER BY h), first_value(case_id) OVER (ORDER BY h)) AS source FROM (SELECT case_id, sha1(case_id) h FROM gen_records)", "gen_records")
def w7(spark, d):
    r = generated(spark, d, "gen_records").select("case_id", F.sha1(F.col("case_id").cast("binary")).alias("h"))
    return sampling.derangement(r, "h").select("case_id", "source")


@query("w8_roll", "SELECT case_id, coalesce(lag(case_id) OVER (PARTITION BY duplicate_group ORDER BY case_id), last_value(case_id) OVER (PARTITION BY duplicate_group ORDER BY case_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rolled FROM gen_records", "gen_records")
def w8(spark, d):
    return sampling.roll(generated(spark, d, "gen_records"), "duplicate_group", "case_id", "case_id").select("case_id", "rolled")


@query("w9_top_regions", "SELECT case_id, label FROM (SELECT case_id, label, row_number() OVER (PARTITION BY case_id ORDER BY label < 11, label) k FROM (SELECT DISTINCT s_nationkey case_id, c_nationkey label FROM supplier, customer)) WHERE k <= 9")
def w9(spark, d):
    s, c = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("supplier", "customer"))
    r = s.select(F.col("s_nationkey").alias("case_id")).distinct().crossJoin(F.broadcast(c.select(F.col("c_nationkey").alias("label")).distinct()))
    return sampling.top_regions(r, 9).select("case_id", "label")


@query("w10_aligned_starts", "SELECT p_partkey, array_to_string(list_transform(range(0, CASE WHEN p_size <= 8 THEN 1 ELSE CAST(ceil((p_size - 8) / 4.0) AS INT) + 1 END), lambda k: k * 4), ',') AS starts FROM part")
def w10(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(sampling.aligned_starts(F.col("p_size"), F.lit(8), F.lit(4)).cast("array<string>"), ",").alias("starts"))


@query("w12_moving_average", """WITH e AS (SELECT user_id, event_id AS epoch, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 i FROM events)
SELECT a.user_id, a.epoch, round(sum(b.value * CASE WHEN b.i = 0 THEN pow(0.9, a.i) ELSE 0.1 * pow(0.9, a.i - b.i) END), 9) AS ema FROM e a JOIN e b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY 1, 2""")
def w12(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").alias("epoch"), F.col("value").alias("metric"))
    return sampling.moving_average(e, "user_id", "epoch", "metric").select("user_id", "epoch", F.round("ema", 9).alias("ema"))


@query("k10_best_artifact", "SELECT epoch, gate AND (b IS NULL OR metric > b) AS saved FROM (SELECT *, max(CASE WHEN gate THEN metric END) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) b FROM gen_epochs)", "gen_epochs")
def k10(spark, d):
    return sampling.best_so_far(generated(spark, d, "gen_epochs"), "epoch", "metric", "gate").select("epoch", "saved")


@query("w14_schedules", "SELECT event_id, round(CASE WHEN i < 10 THEN 0.001 * i / 10 ELSE 0.001 * 0.5 * (1 + cos(pi() * least((i - 10) / 90.0, 1.0))) END, 9) AS cosine, round(0.01 * pow(1 - i / 100.0, 0.9), 9) AS poly FROM (SELECT event_id, event_id % 100 i FROM events)")
def w14(spark, d):
    s = F.col("event_id") % 100
    return read(spark, d, "events").select("event_id", F.round(sampling.warmup_cosine(s, 0.001, 10, 100), 9).alias("cosine"), F.round(sampling.polynomial_rate(s, 0.01, 100), 9).alias("poly"))


@query("w15_forced_foreground", "SELECT case_id, o_orderkey % 12 AS i, o_orderkey % 12 >= round_even(12 * (1 - 0.33), 0) AS forced FROM (SELECT o_orderkey, 'c' || lpad(o_orderkey::VARCHAR, 7, '0') AS case_id FROM orders)")
def w15(spark, d):
    o = read(spark, d, "orders").select(F.concat(F.lit("c"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("case_id"), (F.col("o_orderkey") % 12).alias("i"))
    return o.withColumn("forced", sampling.forced_foreground(F.col("i"), 12, 0.33))


@query("v21_forced_share", "SELECT avg(CASE WHEN i >= round_even(12 * (1 - 0.33), 0) THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM (SELECT o_orderkey % 12 i FROM orders)")
def v21(spark, d):
    return w15(spark, d).agg(F.avg(F.col("forced").cast("double")).alias("share"))


@query("a48_last_wins", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) k FROM events) WHERE k = 1")
def a48(spark, d):
    return records.last_wins(spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.col("event_id").alias("at")), ["user_id"], "at").select("user_id", "event_id")


@query("o9_first_cases", "SELECT case_id, 1.0::DOUBLE AS sampling_weight FROM gen_records ORDER BY case_id LIMIT 25", "gen_records")
def o9(spark, d):
    return generated(spark, d, "gen_records").orderBy("case_id").limit(25).select("case_id", F.lit(1.0).alias("sampling_weight"))
