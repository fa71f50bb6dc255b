import random

import pytest
from pyspark.sql import functions as F

from quarrylake.functions import assertions as A
from quarrylake.functions import text as T
from quarrylake.operators import dedup, sampling, split
from quarrylake.operators.components import connected_components
from quarrylake.operators.storage import cut


def found(spark, text):
    rows = A.extract_assertions(spark.createDataFrame([("a", text)], "id string, text string")).collect()
    return {(r.concept, r.tooth_number, r.polarity) for r in rows}


def test_assertions(spark):
    assert {(t, p) for c, t, p in found(spark, "Absence of teeth 3.8 and 4.8.") if c == "missing"} == {("38", "positive"), ("48", "positive")}
    assert {(t, p) for c, t, p in found(spark, "No missing teeth are identified.") if c == "missing"} == {(None, "negative")}
    got = found(spark, "Tooth 46 is present and tooth 48 is impacted. No osteolytic lesion, but tooth 38 is impacted. Teeth 31 to 33 are missing.")
    assert {(t, p) for c, t, p in got if c == "impacted"} == {("48", "positive"), ("38", "positive")}
    assert {(t, p) for c, t, p in got if c == "lesion"} == {(None, "negative")}
    assert {t for c, t, _ in got if c == "missing"} == {"31", "32", "33"}
    assert found(spark, "") == set() == found(spark, None)


def test_clauses_keep_offsets(spark):
    text = "One here.  Two there;\n\nThree\r\nfour "
    rows = spark.createDataFrame([(text,)], "t string").select(F.explode(T.clauses(F.col("t"))).alias("c")).select("c.*").collect()
    assert [(r.begin, r.end, r.clause) for r in rows] == [(0, 9, "One here."), (11, 21, "Two there;"), (23, 28, "Three"), (30, 35, "four ")]


@pytest.mark.parametrize("one_task", [0, None])
def test_components_match_union_find(spark, one_task):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), cut, one_task=one_task).collect()}
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1] or x in got}


def test_duplicate_groups(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [("a", words), ("b", words.upper()), ("c", words + " end"), ("d", "other text"), ("e", ""), ("f", "!")]
    got = {r.id: (r.duplicate_group, r.template_group) for r in dedup.duplicate_groups(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {"a": ("a", "a"), "b": ("a", "a"), "c": ("a", "c"), "d": ("d", "d"), "e": ("e", "e"), "f": ("e", "e")}


def test_epoch_sampler(spark):
    rows = [(f"A{k}", "near", "same") for k in range(5)] + [("B0", "near2", "unique")]
    r = spark.createDataFrame(rows, "case_id string, duplicate_group string, template_group string")
    picked = [sorted(x.case_id for x in sampling.epoch_sample(r, e, 3).collect()) for e in (0, 1)]
    assert picked == [["A0", "A1", "A2", "B0"], ["A0", "A3", "A4", "B0"]]


def test_split_keeps_groups_whole(spark):
    rows = [(f"c{k:02}", f"g{k // 3}", ["x"] if k % 2 else ["y", "z"]) for k in range(30)]
    c = spark.createDataFrame(rows, "case_id string, duplicate_group string, labels array<string>")
    chosen = split.multilabel_split(c, 0.2, 42)
    assert chosen and len(chosen) == 2 and chosen == split.multilabel_split(c, 0.2, 42)


def test_window_starts(spark):
    r = spark.range(1).select(sampling.aligned_starts(F.lit(13), F.lit(8), F.lit(4)).alias("a")).first()
    assert r.a == [0, 4, 8]
