"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are the words with at least SYMBOL_SHARE of all training tokens, so at
most 1/share many, and one class for all other words, inside of which a word
has its share of the unigram counts. A state is a context of up to DEPTH symbols
(older words to the left; contexts begin at a text's start and end before a
word of the class). Every context that training texts hold is counted, with
every next symbol. A context stays in the tree if its next-symbol distribution
diverges from that of its longest suffix in the tree; distributions are
smoothed by an absolute discount whose mass goes to that suffix's distribution,
and at the root to add-one counts, so they sum to 1. A word is scored in the
state of its longest suffix.

A branch of the tree, all contexts with one last word, is built and used in one
task: each token is sent once, with the words before it, to the task of its last
word, which returns sums for texts. The contexts with a large share of all
tokens (hot ones) are counted beforehand instead, by partial sums; their counts
go to all the tasks that share their tokens by the next older word. Hot contexts
only decide where tokens go, not what is counted.

Defined results: null and empty texts are the end token alone; repeated rows
are scored each; a null doc_id is learned from; without training rows all scores
are 0; extra columns are ignored; an empty table gives no rows. Words are
identified by 64-bit hashes. Sums are of whole billionths, so that they do not
depend on their order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.common import WordHasher, mix, signed, stored, utf8

END, BEGIN = np.uint64(0x5BD1E995C0DE0E4D), np.uint64(0)
DEPTH = 3
SYMBOL_SHARE = 2.0 ** -20
#: Bits of a symbol. 0: a word of the class, or no word.
BITS = 20
MASK = (1 << BITS) - 1
DISCOUNT, DIVERGENCE = 0.8, 0.01
#: Tokens counted or sent together, documents of a chunk at most, and tokens that one task's branch has, about.
BLOCK, CHUNK_ROWS, BRANCH = 3 << 18, 60_000, 3 << 18
#: A context may be hot from this share of a block on, so there are at most DEPTH / share.
HOT_SHARE = 2.0 ** -14
_SCALE = 1e9


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def _tokens(batch: pa.RecordBatch, hasher: WordHasher):
    """Yields (first row, tokens with an end token after each text, row of each token counted from the first)."""
    buf, offs = utf8(batch.column("text"))
    for i, j, h, _, at in hasher.many(buf, offs):
        n = np.diff(at)
        yield i, np.insert(h, at[1:], END), np.repeat(np.arange(j - i, dtype=np.int32), n + 1)


def _older(x: np.ndarray, row: np.ndarray, k: int, begin, none) -> np.ndarray:
    """The symbol k places before each token of its text; begin just before the first, none beyond."""
    out = np.full(len(x), none, x.dtype)
    out[k:] = np.where(row[k:] == row[:-k], x[:-k], none)
    first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1)) + k - 1
    first = first[first < len(x)]
    # the k-th token of a text, if that has so many
    out[first[row[first] == row[first - k + 1]]] = begin
    return out


def _packed(x: np.ndarray, kind) -> bytes:
    """Bytes of numbers, by place value, compressed."""
    x = np.ascontiguousarray(x.astype(kind))
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes, kind) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    raw = np.frombuffer(pa.decompress(b[8:], n, codec="zstd", asbytes=True), np.uint8) if n else np.empty(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _count_words(batches):
    """(level, z, a, b, c): at level 0 how often training texts of a block have the word b, at others contexts that may be hot."""
    hasher, held, count, rows = WordHasher(), [], 0, 0
    schema = pa.schema([("level", pa.int32()), *((x, pa.int64()) for x in "zabc")])

    def counted():
        t, row = (np.concatenate(x) for x in zip(*held))
        u, inv, c = np.unique(t, return_inverse=True, return_counts=True)
        zero = np.zeros(len(u), np.uint64)
        cols = [[np.zeros(len(u), np.int64)], [zero], [zero], [u], [c]]
        often = max(32, len(t) * HOT_SHARE)
        older = [_older(t, row, k, BEGIN, BEGIN) for k in range(1, DEPTH + 1)]
        # tokens after a context that may be hot: one of its ends is
        at, key = np.arange(len(t)), np.zeros(len(t), np.uint64)
        for level, w in enumerate(older, 1):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + w[at])
            _, first, inv, c = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            many = c >= often
            own = at[first[many]]
            context = [older[k - 1][own] if k <= level else np.zeros(len(own), np.uint64) for k in (3, 2, 1)]
            for col, x in zip(cols, (np.full(len(own), level), *context, c[many])):
                col.append(x)
            at, key = at[many[inv]], key[many[inv]]
        level, *context, c = (np.concatenate(x) for x in cols)
        return pa.RecordBatch.from_arrays([pa.array(level.astype(np.int32)), *(pa.array(signed(x)) for x in context), pa.array(c.astype(np.int64))], schema=schema)

    for batch in batches:
        out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        for i, t, row in _tokens(batch, hasher):
            keep = ~out[i + row]
            held.append((t[keep], row[keep] + rows))  # whole texts
            rows += int(row[-1]) + 1
            count += int(keep.sum())
            if count >= BLOCK:
                yield counted()
                held, count, rows = [], 0, 0
    if count:
        yield counted()


class Symbols:
    """The words that are symbols, as 1, 2, ..., and the root's distribution; made from arrays that are broadcast."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        self.words, self.tokens, self.denominator = words, tokens, float(tokens + distinct + 1)
        self.begin = len(words) + 1
        rest = self.denominator - float(np.sum(counts + 1))
        self.root = np.concatenate(([rest], counts + 1, [0])) / self.denominator

    def of(self, t: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(t), np.int32)
        at = np.minimum(np.searchsorted(self.words, t), len(self.words) - 1)
        return np.where(self.words[at] == t, at + 1, 0).astype(np.int32)

    def contexts(self, s: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
        """The symbols before each token, the nearest first; 0 from where its context ends on."""
        out = []
        for k in range(1, DEPTH + 1):
            x = _older(s, row, k, self.begin, 0)
            if out:
                x[out[-1] == 0] = 0
            out.append(x)
        return out


def _keys(context: list[np.ndarray], level: int) -> np.ndarray:
    """The first symbols of contexts, as many as level, as one number."""
    key = np.zeros(len(context[0]), np.int64)
    for x in reversed(context[:level]):
        key = (key << BITS) | x
    return key


class Routes:
    """Where tokens go. hot: for each level the sorted keys of its hot contexts, and the first and number of their tasks."""

    def __init__(self, tasks: int, hot: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.tasks, self.hot = tasks, hot

    def find(self, context: list[np.ndarray], level: int) -> np.ndarray:
        """The place of each context among the hot ones of a level, or -1."""
        keys, key = self.hot[level - 1][0], _keys(context, level)
        if not len(keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where((keys[at] == key) & (context[level - 1] > 0), at, -1)

    def of(self, context: list[np.ndarray], spread: np.ndarray) -> np.ndarray:
        out = (mix(context[0].astype(np.uint64)) % np.uint64(self.tasks)).astype(np.int64)
        for level in range(1, DEPTH + 1):
            at = self.find(context, level)
            hot = at >= 0
            first, number = self.hot[level - 1][1:]
            # shared out by the next older word, or in any way where there is none
            key = _keys(context, level + 1) if level < DEPTH else spread
            share = (mix(key[hot].astype(np.uint64)) % number[at[hot]].astype(np.uint64)).astype(np.int64)
            out[hot] = (first[at[hot]] + share) % self.tasks
        return out

    def targets(self) -> list[list[np.ndarray]]:
        """For each level and hot context the tasks that need its counts: its own, and those of hot contexts that end with it."""
        need = [[set() for _ in keys] for keys, _, _ in self.hot]
        for level, (keys, first, number) in enumerate(self.hot, 1):
            for key, f, n in zip(keys.tolist(), first.tolist(), number.tolist()):
                own = {(f + k) % self.tasks for k in range(n)}
                for shorter in range(1, level + 1):
                    # the newest symbols are in the lowest bits
                    at = int(np.searchsorted(self.hot[shorter - 1][0], key & ((1 << BITS * shorter) - 1)))
                    need[shorter - 1][at] |= own
        return [[np.array(sorted(x)) for x in level] for level in need]


def _count_hot(shared, parts: int):
    """(part, keys, counts), packed: how often symbols follow hot contexts in training texts of a block; a key has the context's level, its place and the symbol."""
    schema = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches):
        words, routes = Symbols(*shared.value[0]), Routes(*shared.value[1])
        hasher, held, count = WordHasher(), [np.empty(0, np.int64)], 0

        def counted():
            key, c = np.unique(np.concatenate(held), return_counts=True)
            part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            o = np.argsort(part, kind="stable")
            return _batch([(int(part[o[x]]), _packed(key[o[x:y]], np.uint64), _packed(c[o[x:y]], np.uint32)) for x, y in _slices(part[o])], schema)

        for batch in batches:
            out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for i, t, row in _tokens(batch, hasher):
                keep = ~out[i + row]
                s = words.of(t)
                context = [x[keep] for x in words.contexts(s, row)]
                s = s[keep].astype(np.int64)
                for level in range(1, DEPTH + 1):
                    at = routes.find(context, level)
                    hot = at >= 0
                    held.append((level << 60) | (at[hot].astype(np.int64) << BITS) | s[hot])
                count += len(t)
                if count >= BLOCK:
                    yield counted()
                    held, count = [np.empty(0, np.int64)], 0
        if count:
            yield counted()

    return run, "part long, keys binary, counts binary"


#: What goes to a task (kind 0: tokens, 1: words of the class, 2: counts of a hot context) and a chunk's own documents (kind 3).
_SENT = pa.schema([("task", pa.int64()), ("kind", pa.int32()), ("chunk", pa.int64()), *((f"x{k}", pa.binary()) for k in range(DEPTH + 2)), ("ids", pa.list_(pa.int64()))])
_SENT_SQL = "task long, kind int, chunk long, " + ", ".join(f"x{k} binary" for k in range(DEPTH + 2)) + ", ids array<long>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _slices(task: np.ndarray):
    cuts = np.flatnonzero(np.diff(task)) + 1
    return zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(task)])).tolist()) if len(task) else ()


def _send(shared):
    def run(batches):
        words, routes = Symbols(*shared.value[0]), Routes(*shared.value[1])
        root = np.log10(np.maximum(words.root, 1e-300))
        hasher, number = WordHasher(), TaskContext.get().partitionId() << 32
        ids, held, parts, rows, count = [], [], [], 0, 0

        def sent():
            t, row = (np.concatenate(x) for x in zip(*parts))
            out = np.concatenate(held)
            s = words.of(t)
            mark = row * 2 + ~out[row]  # a text's place, and whether it is learned from
            made = []
            context = words.contexts(s, row)
            at = np.flatnonzero(context[0])
            own = [x[at] for x in context]
            task = routes.of(own, mix((number + at).astype(np.uint64)))
            # by task, and within it by the two words before, for compression
            o = np.argsort((task << 2 * BITS) | (own[0].astype(np.int64) << BITS) | own[1], kind="stable")
            task, o = task[o], at[o]
            cols = [x[o] for x in (*context, s, mark)]
            for x, y in _slices(task):
                made.append((int(task[x]), 0, number, *(_packed(x_[x:y], np.uint32) for x_ in cols), None))
            at = np.flatnonzero(s == 0)
            task = (mix(t[at] + np.uint64(1)) % np.uint64(routes.tasks)).astype(np.int64)
            o = np.argsort(task, kind="stable")
            at, task = at[o], task[o]
            for x, y in _slices(task):
                made.append((int(task[x]), 1, number, _packed(t[at[x:y]], np.uint64), _packed(mark[at[x:y]], np.uint32), *[None] * DEPTH, None))
            n = len(out)
            known = np.bincount(row, s > 0, n).astype(np.int64)
            base = np.rint(np.bincount(row, np.where(s > 0, root[s], 0.0), n) * _SCALE).astype(np.int64)
            made.append((number % routes.tasks, 3, number, out.tobytes(), np.bincount(row, minlength=n).astype(np.int64).tobytes(), known.tobytes(), base.tobytes(), *[None] * (DEPTH - 2), pa.chunked_array(ids).to_pylist()))
            return _batch(made, _SENT)

        for batch in batches:
            doc, out = batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for i, t, row in _tokens(batch, hasher):
                n = int(row[-1]) + 1
                ids.append(doc.slice(i, n))
                held.append(out[i:i + n])
                parts.append((t, row + rows))
                rows, count = rows + n, count + len(t)
                if count >= BLOCK or rows >= CHUNK_ROWS:
                    yield sent()
                    ids, held, parts, rows, count = [], [], [], 0, 0
                    number += 1
        if rows:
            yield sent()

    return run


def _pack_hot(shared):
    def run(table: pa.Table) -> pa.Table:
        """The counts of one part, packed for the tasks that need them."""
        routes = Routes(*shared.value[1])
        targets = routes.targets()
        keys, counts = (np.concatenate([_unpacked(x.as_py(), kind).astype(np.int64) for x in table.column(c)]) for c, kind in (("keys", np.uint64), ("counts", np.uint32)))
        key, at = np.unique(keys, return_inverse=True)
        c, made = np.zeros(len(key), np.int64), []
        np.add.at(c, at, counts)
        for x, y in _slices(key >> BITS):
            level, i = int(key[x] >> 60), int(key[x] >> BITS) & ((1 << 40) - 1)
            body = (_packed(key[x:y] & MASK, np.uint32), _packed(c[x:y], np.uint64), level.to_bytes(1, "little"), int(routes.hot[level - 1][0][i]).to_bytes(8, "little"))
            made += [(int(task), 2, None, *body, *[None] * (DEPTH - 2), None) for task in targets[level - 1][i]]
        return pa.Table.from_batches([_batch(made, _SENT)])

    return run


def branch(symbols: Symbols, context: list[np.ndarray], w: np.ndarray, learned: np.ndarray, hot: list[np.ndarray], counts: list[tuple]) -> np.ndarray:
    """The probability of each token's symbol w in the state of its longest suffix.

    context: symbols before, nearest first; hot: by level, whether the token's context is counted in counts instead,
    (level, context, w, c), from the shortest contexts to the longest.
    """
    result = symbols.root[w].copy()
    occ = np.flatnonzero(context[0])
    # what a key at this level continues: the entry of the shorter context with the same w, at first the root's
    entry, group, prob = w[occ], None, symbols.root
    side = [(lv, ctx, x, c, x) for lv, ctx, x, c in counts]  # the last: the entry so far
    for level in range(1, DEPTH + 1):
        keep = context[level - 1][occ] > 0
        occ, entry = occ[keep], entry[keep]
        here = [s for s in side if s[0] >= level]
        older = [np.full(len(s[2]), (s[1] >> (BITS * (level - 1))) & MASK) for s in here]
        keys = np.concatenate([(entry << BITS) | context[level - 1][occ], *((s[4] << BITS) | x for s, x in zip(here, older))])
        weight = np.concatenate([(learned[occ] & ~hot[level - 1][occ]).astype(float), *((s[3] if s[0] == level else np.zeros(len(s[2]))) for s in here)])
        if not len(keys):
            break
        u, inv = np.unique(keys, return_inverse=True)
        c = np.bincount(inv, weight, len(u))
        last, old = u >> BITS, u & MASK
        # contexts: the shorter one, and the symbol before it
        _, g = np.unique(old if group is None else (group[last] << BITS) | old, return_inverse=True)
        total, kinds = np.bincount(g, c), np.bincount(g, c > 0)
        below = prob[last]
        p = (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds[g] * below) / np.maximum(total, 1)[g]
        gain = np.bincount(g, np.where(c > 0, c * np.log(np.maximum(p, 1e-300) / below), 0.0)) / np.maximum(total, 1)
        prob, group = np.where(((total > 0) & (gain >= DIVERGENCE))[g], p, below), g
        entry, result[occ] = inv[:len(occ)], prob[inv[:len(occ)]]
        at = len(occ)
        moved = []
        for s in here:
            moved.append((*s[:4], inv[at:at + len(s[2])]))
            at += len(s[2])
        side = moved
    return result


_BACK = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("row", "score", "base", "known")), ("ids", pa.list_(pa.int64()))])


def _sums(values: np.ndarray) -> np.ndarray:
    return np.rint(values * _SCALE).astype(np.int64)


def _scored(shared):
    def run(table: pa.Table) -> pa.Table:
        """Of one task: sums for the texts of each chunk (kind 0: of scores, 1: of words of the class); chunks' own rows pass through."""
        symbols, routes = Symbols(*shared.value[0]), Routes(*shared.value[1])
        made, rows = [], {k: [] for k in range(4)}
        for r in table.to_pylist():
            rows[r["kind"]].append(r)
        made += [(r["chunk"], 3, r["x0"], r["x1"], r["x3"], r["x2"], r["ids"]) for r in rows[3]]

        def returned(chunks, of, marks, kind, *values):
            for k, chunk in enumerate(chunks):
                own = of == k
                place, at = np.unique(marks[own] >> 1, return_inverse=True)
                sums = [np.zeros(len(place), np.int64) for _ in values]
                for x, v in zip(sums, values):
                    np.add.at(x, at, v[own])
                made.append((chunk, kind, _packed(place, np.uint32), *(_packed(x, np.int64) if x is not None else None for x in (sums + [None] * 3)[:3]), None))

        if rows[0]:
            cols = [[_unpacked(r[f"x{k}"], np.uint32).astype(np.int64) for r in rows[0]] for k in range(DEPTH + 2)]
            of = np.repeat(np.arange(len(rows[0])), [len(x) for x in cols[0]])
            *context, w, mark = (np.concatenate(x) for x in cols)
            hot = [routes.find(context, level) >= 0 for level in range(1, DEPTH + 1)]
            counts = [(r["x2"][0], int.from_bytes(r["x3"], "little"), _unpacked(r["x0"], np.uint32).astype(np.int64), _unpacked(r["x1"], np.uint64).astype(float)) for r in rows[2]]
            p = branch(symbols, context, w, (mark & 1) > 0, hot, sorted(counts, key=lambda x: x[0]))
            returned([r["chunk"] for r in rows[0]], of, mark, 0, _sums(np.log10(p / symbols.root[w])))
        if rows[1]:
            words, marks = ([_unpacked(r[k], kind) for r in rows[1]] for k, kind in (("x0", np.uint64), ("x1", np.uint32)))
            of = np.repeat(np.arange(len(words)), [len(x) for x in words])
            words, marks = np.concatenate(words), np.concatenate(marks)
            _, at = np.unique(words, return_inverse=True)
            c = np.bincount(at, marks & 1)[at]
            base = _sums(np.log10((c + 1) / symbols.denominator))
            returned([r["chunk"] for r in rows[1]], of, marks, 1, np.zeros(len(c), np.int64), base, (c > 0).astype(np.int64))
        return pa.Table.from_batches([_batch(made, _BACK)])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _finished(table: pa.Table) -> pa.Table:
    """The documents of one chunk with all their sums."""
    rows = table.to_pylist()
    own = next(r for r in rows if r["kind"] == 3)
    held, n = np.frombuffer(own["row"], bool), np.frombuffer(own["score"], np.int64)
    base, known = np.frombuffer(own["base"], np.int64).copy(), np.frombuffer(own["known"], np.int64).copy()
    more = np.zeros(len(n), np.int64)
    for r in rows:
        if r["kind"] < 3:
            place = _unpacked(r["row"], np.uint32)
            more[place] += _unpacked(r["score"], np.int64)
            if r["kind"] == 1:
                base[place] += _unpacked(r["base"], np.int64)
                known[place] += _unpacked(r["known"], np.int64)
    return pa.Table.from_arrays([pa.array(own["ids"], pa.int64()), pa.array(held), pa.array(n), pa.array(known), pa.array(base / _SCALE), pa.array((base + more) / _SCALE)], schema=_OUT)


def train(docs: DataFrame) -> tuple[tuple, tuple]:
    """(what makes Symbols, what makes Routes) of docs (text, held_out)."""
    found = stored(docs.select("text", "held_out").mapInArrow(_count_words, "level int, z long, a long, b long, c long").groupBy("level", "z", "a", "b").agg(F.sum("c").alias("c")))
    tokens, distinct = found.where("level = 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = found.where((F.col("level") == 0) & (F.col("c") >= max(1, tokens * SYMBOL_SHARE))).select("b", "c").toArrow()
    words, counts = top.column("b").to_numpy().view(np.uint64), top.column("c").to_numpy()
    most = np.lexsort((words, -counts))[:MASK - 1]  # a share of 2**-20 allows a few more than there are numbers
    most = most[np.argsort(words[most])]
    symbols = words[most], counts[most], int(tokens), int(distinct)
    tasks = max(4, tokens // BRANCH)
    ids, hot = Symbols(*symbols), []
    for level in range(1, DEPTH + 1):
        t = found.where((F.col("level") == level) & (F.col("c") >= max(1, tokens / (4 * tasks), tokens * HOT_SHARE))).select("z", "a", "b", "c").toArrow()
        context = [np.where((x := t.column(c).to_numpy().view(np.uint64)) == BEGIN, ids.begin, ids.of(x)) for c in ("b", "a", "z")[:level]]
        c = t.column("c").to_numpy()
        key, fits = _keys(context, level), np.all([x > 0 for x in context], axis=0)
        # nothing is older than a text's beginning
        fits &= np.all([x != ids.begin for x in context[:-1]], axis=0) if level > 1 else True
        if level > 1:
            fits &= np.isin(key & ((1 << BITS * (level - 1)) - 1), hot[-1][0])
        o = np.argsort(key[fits])
        key, c = key[fits][o], c[fits][o]
        number = np.minimum(np.ceil(2 * c * tasks / max(tokens, 1)).astype(np.int64), tasks)
        hot.append((key, (mix(key.astype(np.uint64)) % np.uint64(tasks)).astype(np.int64), np.maximum(number, 1)))
    return symbols, (int(tasks), hot)


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); the held-out fold is not learned from."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(fold_of(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"))
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run, schema = _count_hot(shared, max(4, model[1][0] // 32))
    pack = _pack_hot(shared)
    hot = docs.mapInArrow(run, schema).groupBy("part").applyInArrow(lambda t: pack(t), _SENT_SQL)
    sent = docs.mapInArrow(_send(shared), _SENT_SQL).unionByName(hot)
    scored = _scored(shared)
    back = sent.groupBy("task").applyInArrow(lambda t: scored(t), "chunk long, kind int, row binary, score binary, base binary, known binary, ids array<long>")
    out = back.groupBy("chunk").applyInArrow(lambda t: _finished(t), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model[0][2]).cast("long").alias("train_tokens"), "base_score", "score")


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
