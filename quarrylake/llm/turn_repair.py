"""Conversation structure repair: the cheapest edits that make turns alternate.

Rows are damaged first (`damaged`), then each conversation is repaired. A grammar state
says which roles may follow: nothing yet (e), behind a system row (s), a user row (u) or an
assistant row (a); e and a may end. For each row an edit keeps it, gives it the role that
the state asks for, or deletes it, and up to two inserted rows may come before it; more
never pay, as three of them and a deletion lead nowhere else. `EDGES` lists these steps.

Rows are hash-partitioned by conversation and stretch of STRETCH rows. Inside a batch
DuckDB runs one recursive query: each recursion advances one turn for all stretches at
once and keeps, for each state a stretch begins in and each state reached, the least cost
and of equal ones the ASCII-least audit. Least (cost, audit) pairs compose, since audits
of equal cost are never one another's beginnings (an insertion costs), so a second
recursion joins the stretches of each conversation. Memory is a batch of rows, however
long a conversation is; its audit alone is one value of the result. The repaired text is
hashed as a stream that the audit precedes.

Defined results: a null role, text or turn (in the damage key) is one space; null turns
come first. Rows of one turn are ordered by the hash of role and text before the damage, a repeated
row right behind its original. Repeated rows are turns of their own. Rows with a null conv_id form
one conversation. A conversation that loses all rows has zeros, an empty audit and the
empty string's hash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.llm.common import stored

#: Rows of a conversation that one recursion runs through at most.
STRETCH = 256
#: Rows of a batch, about.
BATCH = 8_192
EMPTY = hashlib.sha256(b"").hexdigest()
STATES, NEXT = "esua", {"e": "u", "s": "u", "u": "a", "a": "u"}


def _edges() -> tuple[list[tuple], list[tuple]]:
    """Steps over a row: (state, role initial or '' for any, next state, cost, audit, whether the row is deleted); and over the end: (state, cost, audit)."""
    steps, ends = [], []
    for state in STATES:
        at = state
        for n in range(3):
            cost, audit = 5 * n, "I" * n
            steps.append((state, "", at, cost + 2, audit + "D", True))
            steps.append((state, "", NEXT[at], cost + 1, audit + "R", False))
            steps.append((state, NEXT[at], NEXT[at], cost, audit + "K", False))
            if at == "e":
                steps.append((state, "s", "s", cost, audit + "K", False))
            if at in "ea":
                ends.append((state, cost, audit))
            at = NEXT[at]
    return steps, ends


EDGES, ENDS = _edges()
#: One recursion is one turn of all stretches; rows: (stretch, place, initial, dead, cut).
ADVANCE = """
WITH RECURSIVE run AS (
    SELECT stretch, 0 AS place, s.state AS began, s.state AS state, {'cost': 0, 'audit': ''} AS best FROM stretches, (SELECT DISTINCT state FROM edges) s
    UNION ALL
    SELECT run.stretch, run.place + 1, began, edges.reached, min({'cost': best.cost + edges.cost + CASE WHEN rows.cut AND NOT edges.deleted THEN 5 ELSE 0 END, 'audit': best.audit || edges.audit})
    FROM run JOIN rows ON rows.stretch = run.stretch AND rows.place = run.place + 1
        JOIN edges ON edges.state = run.state AND (edges.deleted OR NOT rows.dead) AND edges.initial IN ('', rows.initial)
    GROUP BY run.stretch, run.place, began, edges.reached)
SELECT stretch, began, state, best.cost AS cost, best.audit AS audit FROM run JOIN stretches USING (stretch) WHERE run.place = stretches.n
"""
#: One recursion joins the next stretch of all conversations; links: (conv, stretch, began, state, cost, audit).
CHAIN = """
WITH RECURSIVE run AS (
    SELECT conv, 0 AS place, 'e' AS state, {'cost': 0, 'audit': ''} AS best FROM convs
    UNION ALL
    SELECT run.conv, run.place + 1, links.state, min({'cost': best.cost + links.cost, 'audit': best.audit || links.audit})
    FROM run JOIN links ON links.conv = run.conv AND links.stretch = run.place AND links.began = run.state
    GROUP BY run.conv, run.place, links.state)
SELECT conv, min({'cost': best.cost + ends.cost, 'audit': best.audit || ends.audit}) AS best
FROM run JOIN convs USING (conv) JOIN ends USING (state) WHERE run.place = convs.n GROUP BY conv
"""


def _session():
    """A DuckDB of one thread that never writes to disk, with the steps as tables."""
    import duckdb

    db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    db.execute("CREATE TABLE edges (state VARCHAR, initial VARCHAR, reached VARCHAR, cost BIGINT, audit VARCHAR, deleted BOOLEAN)")
    db.executemany("INSERT INTO edges VALUES (?, ?, ?, ?, ?, ?)", EDGES)
    db.execute("CREATE TABLE ends (state VARCHAR, cost BIGINT, audit VARCHAR)")
    db.executemany("INSERT INTO ends VALUES (?, ?, ?)", ENDS)
    return db


def _whole(batches, keys: list[str]):
    """Tables of BATCH rows or so that hold whole groups of rows with equal keys, which follow each other."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        same = np.ones(t.num_rows - 1, bool)
        for k in keys:
            x = t[k].combine_chunks()
            same &= np.asarray(pa.compute.equal(x[1:], x[:-1]))
        last = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
        if held and any(held[-1][k][-1] != t[k][0] for k in keys):
            yield pa.concat_tables(held)
            held = []
        if last and sum(map(len, held)) + last >= BATCH:
            yield pa.concat_tables([*held, t[:last]])
            held, t = [], t[last:]
        held.append(t)
    if held:
        yield pa.concat_tables(held)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, cid, turn, digest, copy, role, text): the rows after the damage; cid names a conversation, a null id included."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")))
    cid = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(cid, F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    rows = rows.withColumns({"cid": cid, "hit": hit, "digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)}).where("hit != 0")
    text = F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "cid", "turn", "digest", F.explode(copies).alias("copy"), role.alias("role"), text.alias("text"))


def marked(rows: DataFrame) -> DataFrame:
    """(cid, place, turn, digest, copy, initial, blank, duplicate, truncated, illegal): faults of each row, places from 0; texts are left behind before the shuffle."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\v\f\r"))
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    slim = rows.select("cid", "turn", "digest", "copy", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"), same.alias("same"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest"), F.col("copy")]
    slim = slim.repartition("cid").withColumn("again", F.row_number().over(W.partitionBy("cid", "same").orderBy(*order)) > 1)
    line = W.partitionBy("cid").orderBy(*order)
    pair = F.concat(F.lag("initial").over(line), F.col("initial"))
    duplicate, truncated = ~F.col("blank") & F.col("again"), ~F.col("blank") & ~F.col("again") & F.col("open")
    illegal = F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))
    return slim.select("cid", (F.row_number().over(line) - 1).cast("long").alias("place"), "turn", "digest", "copy", "initial", "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), illegal.alias("illegal"))


def cheapest(rows: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(cid, cost, audit): the cheapest edits of each conversation; rows: of `marked`."""
    def advance(batches):
        db = _session()
        for t in _whole(batches, ["cid", "stretch"]):
            cid, k, inside = t["cid"].to_numpy(zero_copy_only=False), np.asarray(t["stretch"]), np.asarray(t["place"])
            new = np.concatenate(([True], (cid[1:] != cid[:-1]) | (k[1:] != k[:-1])))
            n = np.diff(np.concatenate((np.flatnonzero(new), [len(new)])))
            number = np.cumsum(new) - 1
            db.register("rows", pa.table({"stretch": number, "place": inside + 1, "initial": t["initial"], "dead": t["dead"], "cut": t["cut"]}))
            db.register("stretches", pa.table({"stretch": np.arange(len(n)), "n": n}))
            got = db.sql(ADVANCE).to_arrow_table()
            at = np.flatnonzero(new)[np.asarray(got["stretch"])]
            out = pa.table({"cid": pa.array(cid[at], pa.string()), "stretch": k[at], **{c: got[c] for c in ("began", "state", "cost", "audit")}})
            yield from out.cast(pa.schema([("cid", pa.string()), ("stretch", pa.int64()), ("began", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])).to_batches()

    def chain(batches):
        db = _session()
        for t in _whole(batches, ["cid"]):
            cid = t["cid"].to_numpy(zero_copy_only=False)
            new = np.concatenate(([True], cid[1:] != cid[:-1]))
            number, names = np.cumsum(new) - 1, cid[new]
            last = np.concatenate((np.flatnonzero(new)[1:], [len(new)])) - 1
            db.register("links", pa.table({"conv": number, **{c: t[c] for c in ("stretch", "began", "state", "cost", "audit")}}))
            db.register("convs", pa.table({"conv": np.arange(len(names)), "n": np.asarray(t["stretch"])[last] + 1}))
            got = db.sql(CHAIN).to_arrow_table()
            best = got["best"].combine_chunks()
            out = pa.table({"cid": pa.array(names[np.asarray(got["conv"])], pa.string()), "cost": best.field("cost").cast(pa.int64()), "audit": best.field("audit")})
            yield from out.cast(pa.schema([("cid", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])).to_batches()

    parts = rows.select("cid", F.floor(F.col("place") / stretch).alias("stretch"), (F.col("place") % stretch).alias("place"), "initial", (F.col("blank") | F.col("duplicate")).alias("dead"), F.col("truncated").alias("cut"))
    parts = parts.repartition("cid", "stretch").sortWithinPartitions("cid", "stretch", "place")
    links = parts.mapInArrow(advance, "cid string, stretch long, began string, state string, cost long, audit string")
    return links.repartition("cid").sortWithinPartitions("cid", "stretch").mapInArrow(chain, "cid string, cost long, audit string")


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(cid, repaired_sha256): the audit comes first in a conversation's stream, the rows follow."""
    def hashed(batches):
        held, out = None, []

        def insert():
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                say("user" if state == "u" else "assistant", "")
                at += 1

        def say(role, text):
            nonlocal first
            sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False

        for b in batches:
            for cid, audit_of, role, text in zip(*(b.column(c).to_pylist() for c in ("cid", "audit", "role", "text"))):
                if audit_of is not None:
                    if held is not None:
                        insert()
                        out.append((held, sha.hexdigest()))
                    held, audit, at, state, sha, first = cid, audit_of, 0, "e", hashlib.sha256(), True
                    continue
                insert()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = role[0]
                    say(role, text)
                elif edit == "R":
                    state = NEXT[state]
                    say("user" if state == "u" else "assistant", text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["cid", "repaired_sha256"])
                out = []
        if held is not None:
            insert()
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([sha.hexdigest()])], ["cid", "repaired_sha256"])

    none = F.lit(None)
    stream = edits.select("cid", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("digest"), F.lit(0).alias("copy"), "audit", none.cast("string").alias("role"), none.cast("string").alias("text"))
    stream = stream.union(rows.select("cid", F.lit(1), "turn", "digest", "copy", none.cast("string"), "role", "text"))
    return stream.repartition("cid").sortWithinPartitions("cid", "kind", F.col("turn").asc_nulls_first(), "digest", "copy").mapInArrow(hashed, "cid string, repaired_sha256 string")


def repair(conversations: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation."""
    rows = damaged(conversations)
    marks = stored(marked(rows))
    edits = stored(cheapest(marks, stretch))
    count = {c: F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")}
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    figures = marks.groupBy("cid").agg(gaps, *count.values()).join(edits, "cid").join(repaired(rows, edits), "cid")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("cid", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *count, "cost")]
    return every.join(figures, "cid", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: One recursion over the turns of all whole conversations, which carries the repaired text along.
ORACLE_OP13 = r"""
WITH RECURSIVE base AS (
    SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
hit AS (SELECT *, sha256(len(role)::VARCHAR || ':' || role || text) AS digest,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(cid || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda s, x:
        list_reduce(list_concat([xor(s, x)], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 20 AS h FROM base),
rows AS (SELECT cid, turn, digest, copy, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM (SELECT *, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE h <> 0)),
seen AS (SELECT *, row_number() OVER line AS k, row_number() OVER (PARTITION BY cid, role, text ORDER BY turn NULLS FIRST, digest, copy) > 1 AS again,
        rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, role[1:1] AS initial, lag(role[1:1]) OVER line || role[1:1] AS pair
    FROM rows WINDOW line AS (PARTITION BY cid ORDER BY turn NULLS FIRST, digest, copy)),
m AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare <> '' AND NOT again AND bare[-1:] NOT IN ('.', '!', '?') AS truncated FROM seen),
nxt(s, n, o) AS (VALUES ('e', 'u', chr(10) || 'user:'), ('s', 'u', chr(10) || 'user:'), ('u', 'a', chr(10) || 'assistant:'), ('a', 'u', chr(10) || 'user:')),
inserted AS (SELECT s, s AS at, '' AS audit, 0 AS cost, '' AS o FROM nxt UNION ALL SELECT s, n, 'I', 5, o FROM nxt
    UNION ALL SELECT a.s, b.n, 'II', 10, a.o || b.o FROM nxt a JOIN nxt b ON b.s = a.n),
edit(e, price) AS (VALUES ('K', 0), ('R', 1), ('D', 2)),
run AS (
    SELECT DISTINCT cid, 0::BIGINT AS k, 'e' AS state, {'cost': 0, 'audit': '', 'said': ''} AS best FROM rows
    UNION ALL
    SELECT cid, k, state, min(best) FROM (
        SELECT m.cid, m.k, CASE e WHEN 'D' THEN i.at WHEN 'R' THEN nxt.n ELSE m.initial END AS state,
            {'cost': best.cost + i.cost + price + CASE WHEN e <> 'D' AND m.truncated THEN 5 ELSE 0 END, 'audit': best.audit || i.audit || e,
             'said': best.said || i.o || CASE e WHEN 'D' THEN '' WHEN 'R' THEN nxt.o || m.text ELSE chr(10) || m.role || ':' || m.text END} AS best
        FROM run JOIN m ON m.cid = run.cid AND m.k = run.k + 1 JOIN inserted i ON i.s = run.state JOIN nxt ON nxt.s = i.at CROSS JOIN edit
        WHERE e = 'D' OR (NOT m.blank AND NOT m.duplicate AND (e = 'R' OR m.initial = nxt.n OR (i.at = 'e' AND m.initial = 's'))))
    GROUP BY cid, k, state),
f AS (SELECT cid, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM m GROUP BY cid),
done AS (SELECT run.cid, min({'cost': best.cost + i.cost, 'audit': best.audit || i.audit, 'said': best.said || i.o}) AS best FROM run JOIN f ON f.cid = run.cid AND f.n = run.k JOIN inserted i ON i.s = run.state AND i.at IN ('e', 'a') GROUP BY run.cid)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
    coalesce(done.best.cost, 0)::BIGINT AS cost, coalesce(done.best.audit, '') AS audit, sha256(coalesce(done.best.said[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, cid FROM base) c LEFT JOIN f USING (cid) LEFT JOIN done USING (cid)
"""
