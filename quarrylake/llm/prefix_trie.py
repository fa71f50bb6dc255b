"""Conversation prefix trie: how many conversations share each beginning, and what sharing saves.

Every conversation is rebuilt (`rebuilt`): it takes the first turns of the conversation
whose id is the next multiple of 20 towards zero. A node is a distinct sequence of first
turns; its key is its depth and two 64-bit XOR sums over (place, turn digest), which
running sums by ranges yield for conversations of any length. Nodes are counted before
anything is grouped, so that copies and shared beginnings cross the shuffle once a task.

A node whose members are all one sequence of turns heads a plain chain, whose figures
follow from running sums. What is left, the nodes where different sequences part and the
tops of their chains, is hash-partitioned by first turn; each partition becomes dictionary
tries inside applyInPandas, folded in postorder without recursion. A first turn of more than SUBTRIE
nodes is opened: the turns that its members share are set aside and its members are
partitioned anew by their next turn, as often as it takes; the nodes set aside are folded
afterwards, deepest first.

Defined results: null role or text count as empty, a null turn comes first, rows of one
turn are ordered by digest, repeated rows are turns of their own. Rows without a conv_id
take no part. A rebuilt conversation without turns is a member of the root. An empty
table has no root. Ids that end a node are hashed as a stream, never gathered.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.llm.common import stored
from quarrylake.llm.mixing import word_count
from quarrylake.operators.ordering import ranges
from quarrylake.operators.storage import broadcast_if_small

#: Nodes of a trie that is built in one task at most, and nodes of small tries that one call builds, about.
SUBTRIE, BUCKET = 50_000, 4_096
#: A conversation begins like the one at the next multiple.
STRIDE = 20
KEY = ["depth", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()


def _head(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def running(df: DataFrame, key: str, order: list[Column], sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """df with place (from 1 in the order of the key's rows) and running sums and XOR sums, the row included, of each key's rows.

    Goes by ranges of (key, *order): a key that spans ranges is carried from one to the next, a row a range on the driver.
    """
    extra = {f"_s_{n}": c for n, c in sums.items()} | {f"_x_{n}": c for n, c in xors.items()} | {"_s_place": F.lit(1).cast("long")}
    parts = ranges(df.withColumns(extra), [F.col(key), *order])
    totals = [(F.bit_xor if n[:3] == "_x_" else F.sum)(n).alias(n) for n in extra]
    ends = parts.groupBy("_p", key).agg(*totals).groupBy("_p").agg(F.min(key).alias("first"), F.max_by(F.struct(key, *extra), key).alias("last"))
    carry, at = [], None
    for r in sorted(ends.collect(), key=lambda r: r["_p"]):
        if at is None or at[key] != r["first"]:
            at = {key: r["first"], **dict.fromkeys(extra, 0)}
        carry.append((r["_p"], r["first"], *(at[n] for n in extra)))
        last = r["last"].asDict()
        if last[key] == at[key]:
            last |= {n: at[n] ^ last[n] if n[:3] == "_x_" else at[n] + last[n] for n in extra}
        at = last
    kind = parts.schema[key].dataType.simpleString()
    before = parts.sparkSession.createDataFrame(carry, f"_p long, _first {kind}, " + ", ".join(f"_c{n} long" for n in extra))
    inside = W.partitionBy("_p", key).orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    out = parts.join(F.broadcast(before), "_p")
    for n in extra:
        carried = F.when(F.col(key) == F.col("_first"), F.col(f"_c{n}")).otherwise(F.lit(0).cast("long"))
        value = F.bit_xor(n).over(inside).bitwiseXOR(carried) if n[:3] == "_x_" else F.sum(n).over(inside) + carried
        out = out.withColumn(n[3:], value)
    return out.drop("_p", "_k", "_first", *extra, *(f"_c{n}" for n in extra))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words): the turns of each conversation, places from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), word_count(text).cast("long").alias("words"))
    return running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], {}, {}).drop("turn")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) rebuilt: (conv_id, total, all_words) and (conv_id, depth, digest, words, total)."""
    h = _head(F.col("conv_id"))
    convs = rows.groupBy("conv_id").agg(F.max("place").alias("n"), F.coalesce(F.sum(F.when(F.col("place") > h, F.col("words"))), F.lit(0)).alias("own_words"))
    heads = rows.where((F.col("conv_id") % STRIDE == 0) & (F.col("place") <= 3)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "digest", "words"))).alias("head"))
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % STRIDE).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.expr("cast(array() as array<struct<place:bigint,digest:binary,words:bigint>>)")), F.lit(1), h)
    convs = convs.select("conv_id", "n", h.alias("h"), "own_words", head.alias("head")).withColumn("taken", F.size("head").cast("long"))
    convs = stored(convs.select("conv_id", "h", "taken", "head", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"), (F.col("own_words") + F.aggregate("head", F.lit(0).cast("long"), lambda s, t: s + t["words"])).alias("all_words")))
    first = convs.select("conv_id", "total", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.words", "total")
    own = rows.where(F.col("place") > h).join(broadcast_if_small(convs.select("conv_id", "h", "taken", "total")), "conv_id")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "total")
    return convs.select("conv_id", "total", "all_words"), first.union(own)


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the conversations that end at each node; the ids pass by in order."""
    def hashed(batches):
        held, sha = None, None
        for b in batches:
            out = []
            for key, conv in zip(zip(*(b.column(k).to_pylist() for k in KEY)), b.column("conv_id").to_pylist()):
                if key != held:
                    if sha:
                        out.append((*held, sha.hexdigest()))
                    held, sha = key, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(b",%d" % conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], [*KEY, "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*held, sha.hexdigest())], [*KEY, "ends_sha256"])

    sorted_ = rows.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    return sorted_.mapInArrow(hashed, "depth long, a long, b long, ends_sha256 string")


def fold(nodes: pd.DataFrame) -> pd.DataFrame:
    """(depth, a, b, pa, pb, n_children, n_leaves, saved_tokens) of a group's shared nodes.

    The trie is a dictionary from a node's key to its children; it is folded in postorder by a stack.
    """
    own = {(d, a, b): (int(n), int(w), bool(s), int(v)) for d, a, b, n, w, s, v in zip(nodes.depth, nodes.a, nodes.b, nodes.n_convs, nodes.words, nodes.single, nodes.chain_saved)}
    above = {(d, a, b): (d - 1, pa_, pb) for d, a, b, pa_, pb in zip(nodes.depth, nodes.a, nodes.b, nodes.pa, nodes.pb)}
    below: dict[tuple, list[tuple]] = {}
    for node, parent in above.items():
        if parent in own:
            below.setdefault(parent, []).append(node)
    figures, out = {}, []
    stack = [(node, False) for node, parent in above.items() if parent not in own]
    while stack:
        node, seen = stack.pop()
        n_convs, words, single, saved = own[node]
        children = below.get(node, [])
        if single:
            figures[node] = (1, saved)
        elif not seen:
            stack.append((node, True))
            stack += [(child, False) for child in children]
        else:
            leaves, saved = (sum(figures[c][i] for c in children) for i in (0, 1))
            figures[node] = (leaves, saved + (n_convs - 1) * words)
            out.append((*node, *above[node][1:], len(children), *figures[node], above[node] not in own))
    return pd.DataFrame(out, columns=[*KEY, "pa", "pb", "n_children", "n_leaves", "saved_tokens", "top"])


FOLDED = "depth long, a long, b long, pa long, pb long, n_children long, n_leaves long, saved_tokens long, top boolean"


def folded(skeleton: DataFrame, places: DataFrame, limit: int) -> DataFrame:
    """FOLDED for all shared nodes; skeleton: shared nodes and tops of chains with ga, gb, their ancestor at depth 1. places: (conv_id, depth, a, b).

    A subtrie of more than limit nodes is opened where it branches first: the turns that all its members share are set
    aside in one step, however many, and its members go on by their next turn.
    """
    level, found, opened, tops = skeleton.withColumn("top", F.col("depth") == 1), [], [], []
    while True:
        level = stored(level)
        big = level.groupBy("ga", "gb", "depth").agg(F.count("*").alias("n")).groupBy("ga", "gb").agg(F.sum("n").alias("n"), F.coalesce(F.min(F.when(F.col("n") > 1, F.col("depth"))), F.max("depth") + 1).alias("fork"))
        big = stored(big.where(F.col("n") > limit).drop("n"))
        small, over = level, None
        if not big.isEmpty():
            mark = broadcast_if_small(big)
            small, over = level.join(mark, ["ga", "gb"], "left_anti"), level.join(mark, ["ga", "gb"])
        buckets = max(1, level.count() // BUCKET)
        done = stored(small.groupBy(F.pmod(F.xxhash64("ga", "gb"), F.lit(buckets)).alias("bucket")).applyInPandas(lambda pdf: fold(pdf), FOLDED))
        found.append(done.drop("top"))
        # what the node above sums over
        tops.append(done.where("top").select("pa", "pb", "n_leaves", "saved_tokens").union(small.where("top and single").select("pa", "pb", F.lit(1).cast("long"), "chain_saved")))
        if over is None:
            break
        opened.append(over.where("depth < fork"))
        ahead = places.select("conv_id", F.col("depth").alias("fork"), F.col("a").alias("ga"), F.col("b").alias("gb"))
        level = over.where("depth >= fork").drop("ga", "gb").join(ahead, ["conv_id", "fork"]).withColumn("top", F.col("depth") == F.col("fork")).drop("fork")
    below = tops.pop()
    for shared, top in zip(reversed(opened), reversed(tops)):
        sums = below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        up = W.partitionBy("ga", "gb").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
        own = F.when(F.col("single"), F.col("chain_saved")).otherwise(F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words"))
        leaves = F.first(F.coalesce("leaves", F.lit(1).cast("long"))).over(up).alias("n_leaves")
        done = stored(shared.join(sums, ["a", "b"], "left").select(*KEY, "pa", "pb", F.coalesce("n_children", F.lit(1).cast("long")).alias("n_children"), leaves, F.sum(own).over(up).alias("saved_tokens"), "top", "single"))
        found.append(done.where("not single").drop("top", "single"))
        below = top.union(done.where("top").select("pa", "pb", "n_leaves", "saved_tokens"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def prefix_trie(conversations: DataFrame, limit: int = SUBTRIE) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row a node, the root included."""
    convs, rows = rebuilt(stored(turns(conversations)))
    rows = rows.withColumns({"x": F.xxhash64("depth", "digest"), "y": F.xxhash64(F.lit("second"), "digest", "depth")})
    rows = stored(running(rows.drop("digest"), "conv_id", [F.col("depth")], {"so_far": F.col("words")}, {"a": F.col("x"), "b": F.col("y")}).drop("place"))
    # all turns of a conversation as one key: members that agree in it are copies
    whole = convs.select("conv_id", "all_words").join(rows.where(F.col("depth") == F.col("total")).select("conv_id", F.col("a").alias("za"), F.col("b").alias("zb")), "conv_id")
    first = rows.where(F.col("depth") == 1).select("conv_id", F.col("a").alias("ga"), F.col("b").alias("gb"))
    seen = rows.join(broadcast_if_small(stored(whole.join(first, "conv_id"))), "conv_id")
    alike = (F.min("za") == F.max("za")) & (F.min("zb") == F.max("zb")) & (F.min("total") == F.max("total"))
    # the words of a chain from the node on: the same for all members where they are copies
    rest = F.min(F.col("all_words") - F.col("so_far") + F.col("words"))
    nodes = seen.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"), F.min(F.col("a").bitwiseXOR(F.col("x"))).alias("pa"), F.min(F.col("b").bitwiseXOR(F.col("y"))).alias("pb"),
        F.min("ga").alias("ga"), F.min("gb").alias("gb"), alike.alias("single"), (F.min("total") > F.col("depth")).cast("long").alias("goes_on"), ((F.count("*") - 1) * rest).alias("chain_saved"))
    nodes = stored(nodes)
    shared = nodes.where(~F.col("single"))
    up = shared.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("up"))
    nodes = stored(nodes.join(up, ["depth", "pa", "pb"], "left"))
    figures = folded(nodes.where(~F.col("single") | F.col("up").isNotNull() | (F.col("depth") == 1)), rows.select("conv_id", *KEY), limit)
    shared = nodes.where(~F.col("single")).join(figures.select(*KEY, "n_children", "n_leaves", "saved_tokens"), KEY)
    single = nodes.where("single").withColumns({"n_children": F.col("goes_on"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.col("chain_saved")})
    columns = ["conv_id", *KEY, "up", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    body = stored(shared.select(columns).union(single.select(columns)))
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    sums = body.where("depth = 1").agg(F.count("*").alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(1)), F.lit(1)).cast("long").alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = top.join(F.broadcast(sums)).select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = _ends(rows.where(F.col("depth") == F.col("total")).select(*KEY, "conv_id").union(convs.where("total = 0").select(zero, zero, zero, "conv_id")))
    every = body.join(F.broadcast(top.select(F.col("conv_id").alias("root"))))
    # inside a chain a node's parent has the same members
    parent = F.when(F.col("depth") == 1, F.col("root")).otherwise(F.coalesce("up", "conv_id"))
    every = every.withColumn("up", parent).drop("root").union(root.select(columns)).join(ends, KEY, "left")
    return every.select("conv_id", "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: crc32 by its rule, eight shifts a byte. A node is the list of its turns; subtrees are summed over the smallest members of nodes, each a member of all nodes above.
ORACLE_OP12 = r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda s, x:
    list_reduce(list_concat([xor(s, x)], range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)) AS r
    FROM (SELECT DISTINCT conv_id FROM t)),
h AS (SELECT conv_id, base, xor(r, 4294967295::BIGINT) % 4 AS h FROM c),
taken AS (SELECT h.conv_id, 0 AS part, t.i, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.i <= h.h
    UNION ALL SELECT h.conv_id, 1, t.i, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.i > h.h),
s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, {'r': role, 't': text} AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM taken),
whole AS (SELECT conv_id, list(turn ORDER BY depth) AS turns, max(depth) AS total FROM s GROUP BY conv_id),
p AS (SELECT s.conv_id, s.depth, s.words, w.total, md5(w.turns[1:s.depth]::VARCHAR) || '-' || len(w.turns[1:s.depth]::VARCHAR) AS node,
        CASE WHEN s.depth > 1 THEN md5(w.turns[1:s.depth - 1]::VARCHAR) || '-' || len(w.turns[1:s.depth - 1]::VARCHAR) ELSE 'root' END AS up
    FROM s JOIN whole w USING (conv_id)
    UNION ALL SELECT conv_id, 0, 0, coalesce(total, 0), 'root', NULL FROM h LEFT JOIN whole USING (conv_id)),
n AS (SELECT node, depth, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256 FROM p GROUP BY node, depth),
k AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node, depth)),
below AS (SELECT p.node, p.depth, sum(f.saved) AS saved_tokens, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, below.n_leaves, below.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN below USING (node, depth) LEFT JOIN n u ON u.node = f.up AND u.depth = f.depth - 1
"""
