"""Removal of repeated byte strings by prefix-free parsing.

Every text is parsed into overlapping phrases: of each run of LENGTH bytes the
least rolling hash of its GRAM-byte substrings is the trigger (the last one on
ties), and a phrase is what the runs with one trigger cover together. Equal
runs have equal triggers at equal places, so a run can only repeat in a phrase
with the same trigger hash.

* The dictionary holds the distinct phrases of triggers that occur twice; the
  parse is the list of (document, place, phrase).
* Phrases overlap by LENGTH - 1, so each run lies in one phrase of the parse. Of
  the parse's suffix array only the order of its first symbols counts: all runs
  of a phrase that occurs twice in the parse are repeated.
* The suffixes of dictionary phrases that may be equal (those of one trigger) are
  sorted together by prefix doubling, up to LENGTH symbols, beyond which their
  order makes no difference. Suffixes of one rank there are repeated runs.

The same parse over words finds passages of more than PASSAGE words that two
documents share, however few bytes they have.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH
keep all; matches never cross documents; repeated rows are separate documents,
each removed where it repeats the other (rows with one doc_id and one text
share no passage with each other); a null doc_id is kept; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import WordHasher, broadcast_if_small, byte_values, mix, powers, signed, stored, utf8

LENGTH, GRAM = 400, 100
#: A passage has more words than this.
PASSAGE, PASSAGE_GRAM = 50, 13
#: Runs looked at together in a long text, and anchors sent on together.
STEP, FLUSH = 1 << 20, 1 << 18
#: Phrases whose suffixes one task orders, about; triggers with more go by single runs.
PHRASES = 2000
CROWDED = 20_000
_P = 0xD6E8FEB86659FD93
_MASK = np.uint64((1 << 24) - 1)


class Parser:
    """Parses sequences of bytes, or of words as 64-bit hashes."""

    def __init__(self, length: int, gram: int, words: bool = False):
        self.length, self.gram, self.words, self.values = length, gram, words, byte_values()
        self.up = self.down = np.empty(0, np.uint64)
        self.hasher = WordHasher(lower=False)

    def symbols(self, text: np.ndarray) -> np.ndarray:
        return self.hasher(text)[0] if self.words else text

    def sums(self, x: np.ndarray) -> np.ndarray:
        if len(x) > len(self.up):
            n = max(len(x), 1 << 16)
            self.up, self.down = powers(_P, n), powers(pow(_P, -1, 1 << 64), n)
        h = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x if self.words else self.values[x]) * self.up[:len(x)], out=h[1:])
        return h

    def phrases(self, b: np.ndarray):
        """(trigger hash, phrase hash, trigger's place, first and last start of the runs that have it), as arrays."""
        length, gram = self.length, self.gram
        g, out = length - gram + 1, []
        for start in range(0, len(b) - length + 1, STEP):
            runs = min(start + STEP, len(b) - length + 1) - start
            h = self.sums(b[start:start + runs - 1 + length])
            m = runs + g - 1
            grams = mix((h[gram:gram + m] - h[:m]) * self.down[:m])
            key = np.full(-(-m // g) * g, ~np.uint64(0))
            key[:m] = (grams & ~_MASK) | (_MASK - np.arange(m, dtype=np.uint64))
            grid = key.reshape(-1, g)
            ahead = np.minimum.accumulate(grid, axis=1).ravel()
            back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
            at = (_MASK - (np.minimum(back[:runs], ahead[g - 1:g - 1 + runs]) & _MASK)).astype(np.int64)
            cut = np.flatnonzero(np.diff(at)) + 1
            lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [runs])) - 1
            a = at[lo]
            shape = (a - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + (hi - lo).astype(np.uint64) * np.uint64(0xC3A5C85C97CB3127)
            out.append((grams[a], mix((h[hi + length] - h[lo]) * self.down[lo] + shape), a + start, lo + start, hi + start))
        return [np.concatenate(x) for x in zip(*out)] if out else None

    def runs(self, b: np.ndarray, first: int, last: int) -> np.ndarray:
        """Hashes of the runs that start at first .. last."""
        h = self.sums(b[first:last + self.length])
        n = last - first + 1
        return mix((h[self.length:self.length + n] - h[:n]) * self.down[:n])


_KINDS = (np.uint64, np.uint64, np.int64, np.int32, np.int32, np.int32, np.int8)


def _parse(buckets: int, *kind):
    schema = pa.schema([("bucket", pa.int64()), *((f"x{k}", pa.binary()) for k in range(len(_KINDS)))])

    def run(batches):
        parser, held, count = Parser(*kind), [], 0

        def dealt():
            cols = [np.concatenate(x).astype(k) for x, k in zip(zip(*held), _KINDS)]
            trig = cols[0]
            # Of a trigger that repeats here, one row stands for all at the trigger's bucket; the others are
            # known to repeat and are dealt out by document.
            o = np.argsort(trig, kind="stable")
            same = np.concatenate(([False], trig[o][1:] == trig[o][:-1]))
            again = np.zeros(len(trig), bool)
            again[o] = same
            twice = np.zeros(len(trig), bool)
            twice[o] = same | np.concatenate((same[1:], [False]))
            cols[6] = (again * 2 + (twice & ~again)).astype(np.int8)
            b = (np.where(again, mix(cols[2].view(np.uint64)), trig) % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            b, cols = b[o], [c[o] for c in cols]
            cuts = np.flatnonzero(np.diff(b)) + 1
            parts = list(zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(b)]))))
            return pa.RecordBatch.from_arrays([
                pa.array([int(b[x]) for x, _ in parts], pa.int64()),
                *(pa.array([c[x:y].tobytes() for x, y in parts], pa.binary()) for c in cols)], schema=schema)

        for batch in batches:
            ids = batch.column("doc").to_numpy()
            buf, offs = utf8(batch.column("text"))
            for k in range(len(ids)):
                found = parser.phrases(parser.symbols(buf[offs[k]:offs[k + 1]]))
                if found:
                    n = len(found[0])
                    held.append([found[0], found[1], np.full(n, ids[k]), *found[2:], np.zeros(n, np.int8)])
                    count += n
                    if count >= FLUSH:
                        yield dealt()
                        held, count = [], 0
        if held:
            yield dealt()

    return run, "bucket long, " + ", ".join(f"x{k} binary" for k in range(len(_KINDS)))


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket the phrases whose trigger occurs twice in the corpus."""
    trig, ctx, doc, a, lo, hi, flag = (np.concatenate([np.frombuffer(x, k) for x in table.column(f"x{i}").to_pylist()]) for i, k in enumerate(_KINDS))
    known = flag == 2
    own = np.flatnonzero(~known)
    o = own[np.argsort(trig[own], kind="stable")]
    same = trig[o][1:] == trig[o][:-1]
    keep = known.copy()
    keep[o] = np.concatenate(([False], same)) | np.concatenate((same, [False])) if len(o) else False
    keep |= flag == 1
    return pa.table({"trig": signed(trig[keep]), "ctx": signed(ctx[keep]), "doc": doc[keep], "a": a[keep], "lo": lo[keep], "hi": hi[keep]})


_PHRASE = "trig long, doc long, lo int, hi int, least long, most long, done boolean, b binary"


def _with_symbols(length: int, words: bool):
    """Rows of docs with their wanted phrases: each phrase with its symbols."""
    schema = pa.schema([("trig", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("done", pa.bool_()), ("b", pa.binary())])

    def run(batches):
        parser = Parser(length, 1, words)
        for batch in batches:
            ids = batch.column("doc").to_pylist()
            buf, offs = utf8(batch.column("text"))
            rows = []
            for k, wanted in enumerate(batch.column("wanted").to_pylist()):
                text = parser.symbols(buf[offs[k]:offs[k + 1]])
                for w in wanted:
                    rows.append((w["trig"], ids[k], w["lo"], w["hi"], w["least"], w["most"], w["done"], text[w["lo"]:w["hi"] + length].tobytes()))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def suffix_ranks(x: np.ndarray, length: int) -> np.ndarray:
    """For each start in x the rank of the length symbols from there on among all such strings, by prefix doubling."""
    n, size = len(x), 1
    if length > len(x):
        return np.empty(0, np.int64)
    r = x.astype(np.uint64)
    if x.dtype == np.uint8 and length >= 8:  # eight bytes are one number
        size, n = 8, n - 7
        r = sum(x[k:n + k].astype(np.uint64) << np.uint64(56 - 8 * k) for k in range(8))
    r = np.unique(r, return_inverse=True)[1].astype(np.int64)
    while size < length:
        step = min(size, length - size)
        r = np.unique(r[:-step] * (r.max() + 1) + r[step:], return_inverse=True)[1].astype(np.int64)
        size += step
    return r


def _ordered(length: int, words: bool, across: bool):
    def run(table: pa.Table) -> pa.Table:
        """Ranges of repeated runs in the phrases of one bucket that are not done; across: repeated in another document."""
        lo, hi, doc, least, most = (table.column(c).to_numpy() for c in ("lo", "hi", "doc", "least", "most"))
        done = table.column("done").to_numpy(zero_copy_only=False).astype(bool)
        parts = [np.frombuffer(x.as_buffer(), np.uint64 if words else np.uint8) for x in table.column("b")]
        ranks = suffix_ranks(np.concatenate(parts), length)
        runs = (hi - lo + 1).astype(np.int64)
        offset = np.concatenate(([0], np.cumsum([len(p) for p in parts])[:-1]))
        owner = np.repeat(np.arange(len(parts)), runs)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        rank = ranks[np.repeat(offset, runs) + start]
        if across:
            low, high = np.full(len(ranks), np.iinfo(np.int64).max), np.full(len(ranks), np.iinfo(np.int64).min)
            np.minimum.at(low, rank, least[owner])
            np.maximum.at(high, rank, most[owner])
            hit = (low < high)[rank]
        else:
            hit = (np.bincount(rank, minlength=1) > 1)[rank]
        at = np.flatnonzero(hit & ~done[owner])
        new = np.concatenate(([True], (np.diff(at) != 1) | (owner[at][1:] != owner[at][:-1]))) if len(at) else np.empty(0, bool)
        first, last = at[new], at[np.concatenate((new[1:], [True]))] if len(at) else at
        begin = np.repeat(lo, runs) + start
        return pa.table({"doc": doc[owner[first]], "lo": begin[first].astype(np.int32), "hi": begin[last].astype(np.int32)})

    return run


def _single_runs(length: int, words: bool):
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("lo", pa.int32()), ("least", pa.int64()), ("most", pa.int64()), ("done", pa.bool_())])

    def run(batches):
        parser = Parser(length, 1, words)
        for batch in batches:
            for r in batch.to_pylist():
                n = r["hi"] - r["lo"]
                key = parser.runs(np.frombuffer(r["b"], np.uint64 if words else np.uint8), 0, n)
                one = np.ones(n + 1, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(one * r["doc"]), pa.array((r["lo"] + np.arange(n + 1)).astype(np.int32)), pa.array(one * r["least"]), pa.array(one * r["most"]), pa.array(np.full(n + 1, r["done"]))], schema=schema)

    return run, "key long, doc long, lo int, least long, most long, done boolean"


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: bool = False, across: bool = False) -> DataFrame:
    """(doc, lo, hi): the strings of length symbols that start at lo .. hi also start elsewhere; docs: (doc, text).

    across: in another document; then of a string that a document has several times one place is given at least.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    run, schema = _parse(max(8, size // ((250 if words else 50) * FLUSH)), length, gram, words)
    parse = stored(docs.mapInArrow(run, schema).groupBy("bucket").applyInArrow(lambda t: _repeated(t), "trig long, ctx long, doc long, a int, lo int, hi int"))
    phrases = parse.groupBy("trig", "ctx").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"), F.min(F.struct("doc", "lo", "hi")).alias("x"))
    phrases = stored(phrases.withColumn("done", F.col("least") < F.col("most") if across else F.col("n") > 1))
    whole = parse.join(broadcast_if_small(phrases.where("done").select("trig", "ctx")), ["trig", "ctx"]).select("doc", "lo", "hi")
    # phrases of a trigger with several phrases, one of which at least is not known to repeat
    several = stored(phrases.groupBy("trig").agg(F.count("*").alias("d"), F.bool_and("done").alias("all")).where("d > 1 AND NOT all").select("trig", "d"))
    dictionary = phrases.join(broadcast_if_small(several.select("trig")), "trig").select("trig", "least", "most", "done", "x.*")
    wanted = dictionary.groupBy("doc").agg(F.collect_list(F.struct("trig", "lo", "hi", "least", "most", "done")).alias("wanted"))
    texts = stored(docs.join(wanted, "doc").mapInArrow(_with_symbols(length, words), _PHRASE))
    crowds = several.where(F.col("d") > CROWDED).select("trig", F.lit(True).alias("crowded"))
    texts = texts.join(broadcast_if_small(crowds), "trig", "left")
    few = texts.where("crowded IS NULL").drop("crowded")
    count = few.count()
    order = _ordered(length, words, across)
    ordered = few.withColumn("bucket", F.pmod("trig", F.lit(1 + count // PHRASES))).groupBy("bucket").applyInArrow(lambda t: order(t.drop_columns(["bucket"])), "doc long, lo int, hi int")
    run, schema = _single_runs(length, words)
    single = texts.where("crowded").drop("crowded").mapInArrow(run, schema)
    keys = single.groupBy("key").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("most").alias("high")).where("low < high" if across else "n > 1").select("key")
    crowded = single.where("NOT done").join(keys, "key").select("doc", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(ordered).unionByName(crowded)


def _removed(length: int):
    schema = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column("text"))
            rows = []
            for k, ranges in enumerate(batch.column("ranges").to_pylist()):
                spans: list[list[int]] = []
                for r in sorted(ranges or [], key=lambda r: r["lo"]):
                    if spans and r["lo"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["hi"] + length)
                    else:
                        spans.append([r["lo"], r["hi"] + length])
                text, at, kept = buf[offs[k]:offs[k + 1]], 0, []
                for x, y in spans:
                    kept.append(text[at:x].tobytes())
                    at = y
                kept.append(text[at:].tobytes())
                rows.append((len(text), sum(y - x for x, y in spans), len(spans), b"".join(kept)))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("doc"), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[2:]))], schema=schema)

    return run, "doc_id long, doc long, n_bytes long, n_removed long, n_spans long, kept binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, doc, text); doc: equal for rows with one doc_id and one text, which repeat each other wholly."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("doc"), "text")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, doc, n_bytes, n_removed, n_spans, kept): kept holds the bytes that no repeated string covers; doc: of keyed()."""
    rows = keyed(docs)
    ranges = repeated_ranges(rows.select("doc", "text"), length, gram).groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    run, schema = _removed(length)
    return rows.join(ranges, "doc", "left").select("doc_id", "doc", "text", "ranges").mapInArrow(run, schema)


def shared_passages(docs: DataFrame, more_than: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """(doc): the documents, by keyed(), that share a passage of more than so many words with another one."""
    return repeated_ranges(keyed(docs).select("doc", "text"), more_than + 1, gram, words=True, across=True).select("doc").distinct()


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    passages = broadcast_if_small(stored(shared_passages(docs).withColumn("shares_passage", F.lit(1))))
    out = remove_repeats(docs).join(passages, "doc", "left")
    # shares_passage: 1 if another document has more than PASSAGE words of it in a row, also where they have fewer than LENGTH bytes
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("shares_passage", F.lit(0)).alias("shares_passage"))


#: All strings of 400 bytes, as hexadecimal digits, and all runs of 51 words, by their hashes.
ORACLE_OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, hex(encode(coalesce(text, ''))) x FROM documents), n AS (SELECT *, len(x) // 2 AS nb FROM d),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 800)) k FROM (SELECT doc_id, x, unnest(range(0, nb - 399)) i FROM n WHERE nb >= 400)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1), s AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, true)::INT fresh FROM w SEMI JOIN r USING (k)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) run FROM s), sp AS (SELECT doc_id, min(i) a, max(i) + 400 b FROM g GROUP BY doc_id, run),
pc AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) f, a t FROM sp UNION ALL SELECT doc_id, max(b), NULL FROM sp GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * f + 1, 2 * (coalesce(pc.t, nb) - f)), '' ORDER BY f) kx FROM pc JOIN n USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT removed, count(*) spans FROM sp GROUP BY doc_id),
v AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') v FROM d),
q AS (SELECT doc_id, hash(array_to_string(v[i:i + 50], ' ')) k FROM (SELECT doc_id, v, unnest(range(1, len(v) - 49)) i FROM v WHERE len(v) > 50)),
p AS (SELECT DISTINCT doc_id FROM q SEMI JOIN (SELECT k FROM q GROUP BY k HAVING min(doc_id) < max(doc_id)) USING (k))
SELECT n.doc_id, nb::BIGINT AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kx, x))) AS kept_sha256, (p.doc_id IS NOT NULL)::INT AS shares_passage
FROM n LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id)
"""
