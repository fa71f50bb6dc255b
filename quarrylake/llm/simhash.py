"""SimHash fingerprints, and search within a Hamming radius by permuted block tables.

Terms are words and pairs of neighbouring words; each occurrence votes with a
weight that grows with the term's length, so that function words count little.
A fingerprint has BITS bits, written in hex.

Defined results: null and empty texts have no terms and the fingerprint 0;
equal texts have equal fingerprints; the likeness of two fingerprints is the
cosine that their share of equal bits stands for, 0 at least; rows with one
doc_id are documents of their own, in the order of their texts' hashes; a null
doc_id comes last and is no query; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import WordHasher, broadcast_if_small, mix, stored, utf8

BITS = 128
PAIR_WEIGHT, WORD_WEIGHT = 1.0, 0.25
#: Bits that a search allows unless told otherwise (all but equal texts), and those of the query's search: within them lie
#: 0.93 of the pairs of different texts with 3/4 of their word shingles in common (sf0.1). Lists of words with one separator
#: between them lie there too, as the separator is most of their terms; other unrelated texts differ in 45 bits or more.
RADIUS, COPY_RADIUS = 3, 19
#: Rows that are the search's queries, those whose doc_id SEARCHED divides; index rows of a key that meet its queries in one task.
SEARCHED, SHARE = 20, 4096
_PART = 1 << 14


def _signs(h: np.ndarray) -> np.ndarray:
    """A row of BITS zeros and ones for each term."""
    lanes = np.stack([mix(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1)


def fingerprint(hashes: np.ndarray, lengths: np.ndarray) -> bytes:
    """The fingerprint of a text given its words' hashes and lengths."""
    votes, total = np.zeros(BITS, np.float64), 0.0
    for at in range(0, len(hashes), _PART):
        h, n = hashes[at:at + _PART + 1], np.log2(1.0 + lengths[at:at + _PART + 1])
        pair, one = mix(h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:]), slice(0, min(_PART, len(h)))
        terms = np.concatenate((h[one], pair))
        weights = np.concatenate((WORD_WEIGHT * n[one], PAIR_WEIGHT * (n[:-1] + n[1:]) / 2)).astype(np.float32)
        votes += weights @ _signs(terms).astype(np.float32)
        total += float(weights.sum())
    return np.packbits(2 * votes > total).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    equal = 1 - int.bit_count(int.from_bytes(a) ^ int.from_bytes(b)) / BITS
    return float(max(0.0, -np.cos(np.pi * equal)))


class Hasher:
    def __init__(self):
        self.words = WordHasher(lower=False)

    def __call__(self, text: bytes) -> bytes:
        return fingerprint(*self.words(np.frombuffer(text, np.uint8)))


def _fingerprints(batches):
    words = WordHasher(lower=False)
    for batch in batches:
        buf, offs = utf8(batch.column("text"))
        out = []
        for i, j, h, k, at in words.many(buf, offs):
            out += [fingerprint(h[at[r]:at[r + 1]], k[at[r]:at[r + 1]]).hex() for r in range(j - i)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, "doc_id long, fingerprint string")


def _halves(name: str) -> list[Column]:
    """The two words of 64 bits of a fingerprint, from its 32 hex digits."""
    quarter = [F.conv(F.substring(name, k, 8), 16, 10).cast("long") for k in range(1, BITS // 4, 8)]
    return [F.shiftleft(quarter[k], 32).bitwiseOR(quarter[k + 1]) for k in (0, 2)]


def _blocks(n: int) -> list[tuple[int, int, int]]:
    """(half, shift, width) of n blocks, n even, of equal width but for one bit; none crosses the halves."""
    cuts = [k * 128 // n for k in range(n // 2 + 1)]
    return [(half, 64 - high, high - low) for half in (0, 1) for low, high in zip(cuts, cuts[1:])]


def neighbours(queries: DataFrame, index: DataFrame, radius: int, blocks: int | None = None, share: int = SHARE) -> DataFrame:
    """(query, match, distance): all distinct fingerprints of index within radius bits of each distinct one of queries.

    Both have a column fingerprint; equal fingerprints are one entry. The bits are cut into blocks, and each block has its
    permuted table, whose key is that block. Of radius bits at most radius // blocks differ in some block, so each table is
    looked up by the query's block and by all blocks that differ from it in so many bits: in none where blocks > radius, in
    one at most by default. A pair is taken from the first table in which it meets, after its distance is computed in the
    join. A key of more than share index rows is dealt out by rank of a hash to several tasks, to each of which its
    queries go, so no task holds a group that grows with the table.
    """
    blocks = blocks or max(4, radius + 1 if radius < 8 else radius // 2 + 1)
    if not 4 <= blocks <= BITS:
        raise ValueError(f"{blocks} blocks; keys have 1 to 32 bits, so 4 to {BITS} are needed")
    cut = _blocks(blocks + blocks % 2)
    flips = radius // len(cut)

    def words(df: DataFrame, a: str, b: str) -> DataFrame:
        hi, lo = _halves("fingerprint")
        return df.select("fingerprint").where("fingerprint IS NOT NULL").distinct().select(hi.alias(a), lo.alias(b))

    def key(a: str, b: str, t: int) -> Column:
        half, shift, width = cut[t]
        return F.shiftrightunsigned(F.col((a, b)[half]), shift).bitwiseAND((1 << width) - 1).bitwiseOR(F.lit(t << 32))

    def masks(t: int) -> Column:
        return F.array(*(F.lit(sum(1 << k for k in c)).cast("long") for n in range(flips + 1) for c in combinations(range(cut[t][2]), n)))

    tables = range(len(cut))
    right = words(index, "c", "d").select("c", "d", F.explode(F.array(*(key("c", "d", t) for t in tables))).alias("key"))
    looked = F.concat(*(F.transform(masks(t), key("a", "b", t).bitwiseXOR) for t in tables))
    left = words(queries, "a", "b").select("a", "b", F.explode(looked).alias("key"))
    large = right.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > share).select("key", F.ceil(F.col("n") / share).alias("parts"))
    large = broadcast_if_small(stored(large))
    # the part stands above the table (7 bits) and the block (32 bits)
    right = right.join(large, "key", "left").withColumn("key", F.col("key") + F.shiftleft(F.pmod(F.xxhash64("c", "d"), F.coalesce("parts", F.lit(1))), 40))
    left = left.join(large, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)))
    left = left.select("a", "b", (F.col("key") + F.shiftleft("part", 40)).alias("key"))
    other = [F.col("a").bitwiseXOR(F.col("c")), F.col("b").bitwiseXOR(F.col("d"))]
    distance = F.bit_count(other[0]) + F.bit_count(other[1])
    close = [F.bit_count(other[half].bitwiseAND(((1 << width) - 1) << shift if shift + width < 64 else -(1 << shift))) <= flips for half, shift, width in cut]
    first = F.coalesce(*(F.when(close[t], F.lit(t)) for t in tables))
    met = left.alias("l").join(right.select("c", "d", "key").alias("r"), (F.col("l.key") == F.col("r.key")) & (distance <= radius)
                               & (F.shiftrightunsigned(F.col("l.key"), 32).bitwiseAND(127) == first))

    def text(a: str, b: str) -> Column:
        return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))

    return met.select(text("a", "b").alias("query"), text("c", "d").alias("match"), distance.cast("long").alias("distance"))


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_text(text: str, after: str) -> str:
    n = len(text) // 2
    return text[:len(text) - n] + after[:n]


def _row(hasher: Hasher, doc_id: int, text: str, own: bytes, after: str, other: bytes) -> tuple:
    edited = edited_text(text, after).encode()
    h = hasher(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own.hex(), h.hex(), likeness(own, h), likeness(own, other)


def _neighbour_rows(batches):
    """Rows of a sorted partition; its first and its last document are passed on with their texts (edge 0 and 1)."""
    hasher, out, last, first = Hasher(), [], None, True
    part = TaskContext.get().partitionId()
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")),
                        ("near_edited", pa.float64()), ("near_next", pa.float64()), ("part", pa.int64()), ("edge", pa.int32()), ("text", pa.string())])

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def edge(doc, k):
        return doc[0], len(doc[1]), None, doc[2].hex(), None, None, None, part, k, doc[1]

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for k in range(batch.num_rows):
            text = batch.column("text")[k].as_py() or ""
            doc = ids[k], text, hasher(text.encode())
            if first:
                out.append(edge(doc, 0))
                first = False
            else:
                out.append((*_row(hasher, *last, doc[1], doc[2]), part, -1, None))
            last = doc
            if len(out) >= 2000:
                yield made(out)
                out = []
    if last:
        out.append(edge(last, 1))
        yield made(out)


def _edge_rows(batches):
    hasher = Hasher()
    for batch in batches:
        rows = [_row(hasher, r["doc_id"], r["text"], bytes.fromhex(r["fingerprint"]), r["after"], bytes.fromhex(r["other"])) for r in batch.to_pylist()]
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _OUT.split(", ")])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text (its end replaced by the next document's beginning), and their likeness.

    Documents are sorted in ranges, so a document's next one is in its partition but for one document of each. The
    ranges are by doc_id and a hash: the driver samples those, never texts.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = stored(rows.mapInArrow(_neighbour_rows, _OUT + ", part long, edge int, text string"))
    heads = found.where("edge = 0").select("part", F.col("text").alias("after"), F.col("fingerprint").alias("other"))
    # the next partition with rows; after the last, the first: one pair of numbers for each partition
    parts = sorted(r["part"] for r in heads.select("part").collect())
    spark = docs.sparkSession
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part long, next long")
    ends = found.where("edge = 1").select("part", "doc_id", "text", "fingerprint").join(F.broadcast(follow), "part")
    ends = ends.select("doc_id", "text", "fingerprint", "next").join(heads.withColumnRenamed("part", "next"), "next").drop("next")
    return found.where("edge = -1").drop("part", "edge", "text").unionByName(ends.mapInArrow(_edge_rows, _OUT))


def near_counts(rows: DataFrame, radius: int = RADIUS, every: int = SEARCHED) -> DataFrame:
    """rows (doc_id, fingerprint, ...) with n_near: for each doc_id that every divides, how many other fingerprints lie within radius; NULL for the rest."""
    asked = rows.where(F.col("doc_id") % every == 0)
    near = neighbours(asked, rows, radius).groupBy("query").agg((F.count("*") - 1).alias("_near"))  # it finds itself
    near = stored(near)
    out = rows.join(broadcast_if_small(near), (F.col("fingerprint") == F.col("query")) & (F.col("doc_id") % every == 0), "left")
    return out.select(*rows.columns, F.col("_near").alias("n_near"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_counts(stored(compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))), COPY_RADIUS)
