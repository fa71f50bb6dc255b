"""Stand-in tables for clinical data, made by one SQL text for Spark and for any ANSI engine from the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Each text names its source tables in braces.
TABLES = {
    # one report a row, several of a case
    "gen_reports": """
SELECT concat('C', lpad(CAST(p_partkey % 301 AS STRING), 4, '0')) AS case_id, p_partkey AS rid,
 concat('Tooth ', CAST(p_partkey % 4 + 1 AS STRING), '.', CAST(p_size % 8 + 1 AS STRING),
  CASE p_partkey % 5 WHEN 0 THEN ' is missing. ' WHEN 1 THEN ' is impacted. ' WHEN 2 THEN ' shows caries. ' WHEN 3 THEN ' has a crown. ' ELSE ' is present. ' END,
  CASE p_size % 4 WHEN 0 THEN 'No osteolytic lesion in the maxilla. ' WHEN 1 THEN 'An osteolytic lesion is noted on the left. ' WHEN 2 THEN 'Teeth 31 to 33 are missing; implant on 4.6. ' ELSE 'The scan is partially visualized and the sinus is not included. ' END,
  CASE p_partkey % 3 WHEN 0 THEN 'Bone loss of the mandible' WHEN 1 THEN 'Root canal treatment on tooth 12.' ELSE 'No evidence of caries!' END) AS text
FROM {part}""",
    "gen_predictions": """
SELECT concat('C', lpad(CAST(p_partkey AS STRING), 6, '0')) AS case_id,
 concat('Tooth ', CAST(p_partkey % 4 + 1 AS STRING), '.', CAST(p_size % 11 AS STRING), ' is missing. ',
  CASE WHEN p_partkey % 7 = 0 THEN 'The upper left molar is impacted. The upper left molar is impacted. ' ELSE 'A lesion is seen here. ' END,
  CASE WHEN p_partkey % 5 = 0 THEN 'Bone loss' WHEN p_partkey % 5 = 1 THEN 'Sinus clear!' ELSE 'Sinus clear. ' END) AS prediction,
 concat('Tooth ', CAST(p_partkey % 4 + 1 AS STRING), '.', CAST(p_size % 8 + 1 AS STRING), ' is missing. A lesion is seen there. Sinus is clear.') AS reference,
 CASE WHEN p_partkey % 2 = 0 THEN 'The sinus is clear and a lesion is seen here. ' ELSE 'Tooth 11 is missing.' END AS reference2
FROM {part}""",
    "gen_predicted": """
SELECT DISTINCT concat('C', CAST(p_partkey % 97 AS STRING)) AS case_id,
 CASE p_size % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'impacted' WHEN 2 THEN 'lesion' WHEN 3 THEN 'caries' WHEN 4 THEN 'sinus' ELSE 'implant' END AS concept,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(CAST(p_partkey % 4 + 1 AS STRING), CAST(p_size % 8 + 1 AS STRING)) END AS tooth_number,
 CASE WHEN p_partkey % 5 = 0 AND p_size % 2 = 0 THEN 'maxilla' ELSE NULL END AS anatomy,
 CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 4 IN (0, 3) THEN 'right' ELSE 'left' END AS side,
 CASE WHEN p_size % 7 = 0 THEN 'negative' ELSE 'positive' END AS polarity,
 CASE WHEN p_size % 13 = 0 THEN 'coverage' ELSE 'case-specific' END AS clause_type
FROM {part} WHERE p_partkey % 3 <> 0""",
    "gen_reference": """
SELECT DISTINCT concat('C', CAST(p_partkey % 97 AS STRING)) AS case_id,
 CASE p_size % 6 WHEN 0 THEN 'missing' WHEN 1 THEN 'impacted' WHEN 2 THEN 'lesion' WHEN 3 THEN 'caries' WHEN 4 THEN 'sinus' ELSE 'implant' END AS concept,
 CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE concat(CAST((p_partkey + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS STRING), CAST(p_size % 8 + 1 AS STRING)) END AS tooth_number,
 CASE WHEN p_partkey % 5 = 0 AND p_size % 2 = 0 THEN 'maxilla' ELSE NULL END AS anatomy,
 CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN (p_partkey + CASE WHEN p_partkey % 8 = 0 THEN 1 ELSE 0 END) % 4 IN (0, 3) THEN 'right' ELSE 'left' END AS side,
 CASE WHEN p_size % 7 = 0 AND p_partkey % 2 = 0 THEN 'negative' ELSE 'positive' END AS polarity,
 CASE WHEN p_size % 13 = 0 THEN 'coverage' ELSE 'case-specific' END AS clause_type
FROM {part} WHERE p_partkey % 4 <> 0""",
    "gen_voxels": """
SELECT concat('S', CAST(l_suppkey % 20 AS STRING)) AS case_id, CAST(l_linenumber AS INT) AS z, CAST(l_orderkey % 64 AS INT) AS y, CAST(floor(l_orderkey / 64) AS INT) AS x,
 CAST(l_linenumber % 4 AS INT) AS ref, CAST((l_linenumber + CASE WHEN l_partkey % 10 = 0 THEN 1 ELSE 0 END) % 4 AS INT) AS pred, l_quantity AS v
FROM {lineitem}""",
    "gen_cv": """
SELECT l_returnflag AS dataset, l_linestatus AS config, CAST(l_linenumber % 5 AS INT) AS fold, CAST(sum(CAST(l_quantity AS INT)) AS DOUBLE) / (count(*) * 50) AS dice
FROM {lineitem} WHERE NOT (l_returnflag = 'A' AND l_linenumber % 5 = 2) GROUP BY l_returnflag, l_linestatus, l_linenumber % 5""",
    "gen_epochs": """
SELECT event_id AS epoch, value AS metric, event_type AS kind, event_id % 3 <> 0 AS gate FROM {events}""",
    "gen_records": """
SELECT concat('c', lpad(CAST(o_orderkey AS STRING), 7, '0')) AS case_id, concat('d', CAST(o_custkey % 200 AS STRING)) AS duplicate_group,
 concat('t', CAST(o_custkey % 200 AS STRING), '_', CAST(o_orderkey % 3 AS STRING)) AS template_group, CAST(o_orderkey % 4 + 1 AS INT) AS reports, o_orderpriority AS label, o_orderstatus AS label2
FROM {orders}""",
    "gen_probabilities": """
SELECT concat('S', CAST(l_suppkey % 20 AS STRING)) AS case_id, l_orderkey AS voxel, CAST(l_linenumber AS INT) AS label, CAST(l_linenumber AS INT) AS ord, l_shipdate < TIMESTAMP '1995-06-01 00:00:00' AS model,
 l_discount * 10 AS p, l_quantity / 10 AS score FROM {lineitem}""",
}


def sql(name: str, tables: dict[str, str] | None = None) -> str:
    """The text that makes a table, its sources under their own names or those given."""
    names = ("part", "lineitem", "orders", "events")
    return TABLES[name].strip().format(**({n: n for n in names} | (tables or {})))


def generated(spark, sf_dir: str, name: str) -> DataFrame:
    text = TABLES[name]
    sources = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("part", "lineitem", "orders", "events") if "{%s}" % n in text}
    return spark.sql(text, **sources)


def with_tables(query: str, *names: str) -> str:
    """query for an ANSI engine, with generated tables as common table expressions."""
    ctes = ", ".join(f"{n} AS ({sql(n)})" for n in names)
    if query.lstrip()[:5].upper() == "WITH ":
        return f"WITH {ctes}, {query.lstrip()[5:]}"
    return f"WITH {ctes} {query}"
