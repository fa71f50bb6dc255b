"""Each operator against a brute-force version on small tables that hold nulls, empty texts, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrylake.llm import decontamination, jaccard_join, line_dedup, mixing, pii, simhash, substring_dedup, suffix_tree_lm

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, row_ long, h long, key string"


def table(spark, texts, sources=None):
    rows = [(k, t, "en", sources[k] if sources else f"s{k % 3}", len(t or ""), 1, 2, 3, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(rng, n, vocabulary=40):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def lower(t):
    return (t or "").translate({k: k + 32 for k in range(65, 91)})


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def corpus():
    rng = random.Random(7)
    base = words(rng, 60, 500)
    texts = [" ".join(base), " ".join(base), " ".join(base[:-3] + ["x", "y"]), " ".join(base[:30]), None, "", "  \n ", "One", "one", "A b C", "É é", "\n".join([" ".join(base)] * 2)]
    for _ in range(25):
        edited = list(base)
        for _ in range(rng.randrange(1, 6)):
            edited[rng.randrange(len(edited))] = f"e{rng.randrange(1000)}"
        texts.append(" ".join(edited))
    texts += [" ".join(words(rng, rng.randrange(1, 90), 300)) for _ in range(25)]
    return texts + [" ".join(words(rng, 9000, 3000))]


def test_decontamination(spark):
    rng = random.Random(1)
    items = [" ".join(words(rng, 30, 200)), "Short Item, here", None, "", "...", " ".join(words(rng, 13, 200)), "Short Item, here"]
    texts = ["x " + items[0] + " y", items[0].upper(), "say short item here twice: SHORT ITEM HERE", None, "", " ".join(items[0].split()[5:17]), " ".join(items[0].split()[5:18]), "É" + items[5], "a " * 300 + items[5], "the the"]
    bench = spark.createDataFrame([(k, t, 5) for k, t in enumerate(items)], "item_id long, text string, doc_id long")

    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontamination.contamination(table(spark, texts), bench).collect()}
    for k, t in enumerate(texts):
        w, hit, ids = tokens(t), set(), set()
        for i, item in enumerate(items):
            v = tokens(item)
            n = min(13, len(v))
            for s in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(i))
        assert got[k] == (len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)), k
    assert decontamination.contamination(table(spark, []), bench).count() == 0
    # a benchmark row twice, and rows that share a doc_id
    again = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontamination.contamination(table(spark, texts), bench.unionByName(bench)).collect()}
    assert again == got
    shared = table(spark, [texts[0], "four clean words here", None, texts[0]]).withColumn("doc_id", F.when(F.col("doc_id") == 2, None).otherwise(1))
    rows = sorted((r.n_words, r.n_hit, r.contaminated) for r in decontamination.contamination(shared, bench).collect())
    assert rows == [(0, 0, False), (4, 0, False), *[(got[0][0], got[0][1], True)] * 2]
    assert decontamination.contamination(table(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    q = spark.createDataFrame([(1, ["Alpha", "beta"]), (2, ["gamma"]), (3, [])], "query_id long, terms array<string>")
    got = decontamination.proximity_matches(table(spark, ["alpha x y BETA", "alpha x y z q beta", None, "gamma gamma"]), q, 3).collect()
    assert sorted((r.doc_id, r.query_id) for r in got) == [(0, 1), (3, 2), (3, 2)]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def accepted(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(v - 9 * (v > 9) for k, c in enumerate(reversed(d)) for v in [int(c) * (1 + k % 2)])
        return 13 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_pii(spark, tmp_path):
    texts = ["x@y@z.com a.b@c.d.e@f.g 1.2.3.4.5.6.7.8 999.1.1.1 é 10.0.0.1", "+1 (22) 333 4444 444-55 4111 1111 1111 1111 or 4111-1111-1111-1112", None, "", "+" * 50 + "1" * 40 + " 5" * 3000 + "a" * 2000 + "@b",
             "00000000000000000255.1.1.1 +12345678901234567 +1-2-3-4-5-6-7-8-9", "call 555-123-4567, SSN 123-45-6789, Dr. Smith joe [at] foo [dot] com", "call 555-123-4567, SSN 123-45-6789, Dr. Smith joe [at] foo [dot] com"]
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op2_pii(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        base = [(kind, m.start(), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, t or "") if accepted(kind, m.group())]
        joined = ",".join(f"{a}:{b}:{c}" for a, b, c in base)
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), k
        assert set(filter(None, joined.split(","))) <= set(got[k].spans.split(","))
    assert len(got) == len(texts)
    table(spark, []).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert pii.op2_pii(spark, str(tmp_path / "empty")).count() == 0


def test_pii_finds_more_kinds(spark):
    rng = random.Random(3)

    def hexes(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    wanted = {"secret": [hexes(40), "sk_live_" + hexes(24), "ghp_" + hexes(36), "AKIA" + "ABCD1234EFGH5678", "hunter2horse"], "name": ["John Smith", "Dr. Jane Doe"], "phone": ["030 1234567", "(555) 123-4567"], "ssn": ["123-45-6789"], "iban": ["DE89 3704 0044 0532 0130 00"]}
    said = ['token = "{}"', "key {} is", "use {} now", "id {} there", "password: {}", "My name is {}.", "ask {} today", "call {} today", "call {} today", "SSN {}.", "account {}."]
    texts = [f"é some words {s.format(x)} and more words" for s, x in zip(said, [x for xs in wanted.values() for x in xs])]
    clean = [f"plain words number {k} of page {k * 7} in section 4.{k}" for k in range(60)] + ["the token was lost", "a secret garden", "I am here"]
    rows, spans = pii.personal_data(table(spark, texts * 3 + clean))
    found = {}
    for r in spans.collect():
        found.setdefault(r.doc_id, set()).add((r.kind, r.m, r.start, r.end))
    kinds = [k for k, xs in wanted.items() for _ in xs]
    for k, (kind, x) in enumerate(zip(kinds, [x for xs in wanted.values() for x in xs])):
        at = texts[k].index(x)
        assert (kind, x, at, at + len(x)) in found.get(k, ()), (kind, x, found.get(k))
    assert set(found) == set(range(3 * len(texts)))


def test_pii_of_any_length(spark):
    rng = random.Random(8)

    def run(n, signs="abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ0123456789"):
        return "".join(rng.choice(signs) for _ in range(n - 1)) + "7"

    made = {"password: {}": lambda n: run(n), "use {} now": lambda n: "ghp_" + run(n), "key {} is": lambda n: run(n, "0123456789abcdef"), "id {} there": lambda n: "sk_live_" + run(n), "take {} here": lambda n: f"eyJ{run(20)}.{run(n)}.{run(43)}", "token = '{}'": lambda n: run(n), "with {}.": lambda n: f"eyJ{run(n)}.{run(n)}.{run(n)}"}
    texts, secrets = [], []
    for n in (65, 129, 180, 1_200, 10_000, 300_000):
        for form, make in made.items():
            secrets.append(make(n))
            texts.append("é words before " + form.format(secrets[-1]) + " and words behind")
    clean = [f"plain words number {k} of page {k * 7} in section 4.{k}" for k in range(60)]
    _, spans = pii.personal_data(table(spark, texts + clean))
    found = {}
    for r in spans.collect():
        found.setdefault(r.doc_id, set()).add((r.kind, r.start, r.end))
    for k, (t, x) in enumerate(zip(texts, secrets)):
        assert ("secret", t.index(x), t.index(x) + len(x)) in found.get(k, ()), (k, len(x))
    assert set(found) == set(range(len(texts)))


def test_pii_estimates_the_hidden_class():
    # two kinds of candidates whose labelers are right nine times of ten
    rng = random.Random(4)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        counts[tuple((1 if y else -1) * (1 if rng.random() < 0.9 else -1) for _ in pii.LABELERS), y] += 1
    patterns = Counter()
    for (v, _), n in counts.items():
        patterns[v] += n
    post = pii.estimate(patterns)
    wrong = sum(n for (v, y), n in counts.items() if (post[v] > 0.5) != y)
    assert wrong / 4000 < 0.06 and abs(sum(post[v] * n for v, n in patterns.items()) / 4000 - 0.3) < 0.03
    weights = pii.fit_classifier([((k, 1, 1, 1, 1, 1), float(k == "a"), 10.0) for k in "ab"])
    assert weights[pii.FEATURES[0], "a"] > 0 > weights[pii.FEATURES[0], "b"]


def simhash_by_hand(text):
    """Word by word and bit by bit; hashes of words are the operator's own."""
    import numpy as np

    h, n = simhash.WordHasher(lower=False)(np.frombuffer(text.encode(), np.uint8))
    votes, total = [0.0] * simhash.BITS, 0.0
    logs = [math.log2(1 + int(x)) for x in n]
    terms = [(x, simhash.WORD_WEIGHT * y) for x, y in zip(h, logs)]
    with np.errstate(over="ignore"):
        terms += [(simhash.mix(np.array([h[k] * np.uint64(0xC2B2AE3D27D4EB4F) + h[k + 1]]))[0], simhash.PAIR_WEIGHT * (logs[k] + logs[k + 1]) / 2) for k in range(len(h) - 1)]
    for x, weight in terms:
        total += weight
        for k, bit in enumerate(simhash._signs(np.array([x]))[0]):
            votes[k] += weight * bit
    bits = [simhash.BITS - 1 - k for k in range(simhash.BITS)]
    # a bit of as many votes for as against is a matter of rounding
    tied = sum(1 << b for b, v in zip(bits, votes) if abs(2 * v - total) <= 1e-6 * total)
    return sum(1 << b for b, v in zip(bits, votes) if 2 * v > total), tied


def test_simhash_of_odd_tables(spark):
    long = "word " * 700_000  # more than one piece
    rows = [(None, "a b c"), (2, "x y"), (2, "p q r s"), (2, None), (5, long), (20, "near this one here now"), (40, "near this one here now")]
    out = simhash.near_counts(simhash.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit(1)))).collect()
    assert len(out) == len(rows) and {r.doc_id: r.n_near for r in out if r.n_near is not None} == {20: 0, 40: 0}
    assert next(r for r in out if r.doc_id == 5).n_chars == len(long)
    assert [r.near_next for r in out if r.doc_id == 20] == [1.0]
    f = {r.doc_id: r.fingerprint for r in out}
    near = spark.createDataFrame([(0, "0" * 32), (1, "0" * 31 + "7"), (3, "0" * 31 + "f"), (60, "1" + "0" * 31)], "doc_id long, fingerprint string")
    assert {r.doc_id: r.n_near for r in simhash.near_counts(near).collect()} == {0: 2, 1: None, 3: None, 60: 1} and f


def test_simhash(spark):
    texts = corpus()
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.compare_with_next(table(spark, texts).repartition(5)).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        after = texts[(k + 1) % len(texts)] or ""
        t = t or ""
        n = len(t) // 2
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256((t[:len(t) - n] + after[:n]).encode()).hexdigest()
        other = got[(k + 1) % len(texts)].fingerprint
        assert got[k].near_next == simhash.likeness(bytes.fromhex(got[k].fingerprint), bytes.fromhex(other))
    assert got[0].fingerprint == got[1].fingerprint
    assert simhash.compare_with_next(table(spark, [])).count() == 0
    assert [r.near_next for r in simhash.compare_with_next(table(spark, ["alone"])).collect()] == [1.0]
    for k, t in rows:
        value, tied = simhash_by_hand(t or "")
        assert (int(got[k].fingerprint, 16) ^ value) & ~tied == 0, k
    f = simhash.fingerprints(table(spark, texts))
    near = {(r["query"], r.match): r.distance for r in simhash.neighbours(f, f, 3).collect()}
    all_f = {r.fingerprint for r in f.collect()}
    assert near == {(a, b): d for a in all_f for b in all_f if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}


@pytest.mark.parametrize("radius, blocks, share", [(3, None, 4096), (8, 4, 7), (19, None, 4096), (19, None, 5), (19, 24, 4096), (0, None, 4096)])
def test_simhash_search(spark, radius, blocks, share):
    """All pairs within the radius, also where a block is shared by all and its key is dealt out."""
    rng = random.Random(radius)
    made = [0, (1 << 128) - 1]
    for _ in range(12):
        centre = rng.getrandbits(128)
        made += [centre] + [centre ^ sum(1 << b for b in rng.sample(range(128), rng.randrange(24))) for _ in range(10)]
    made += [rng.getrandbits(100) for _ in range(40)]
    rows = [(k, f"{x:032x}") for k, x in enumerate(made + made[:9])] + [(999, None)]
    index = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    asked = index.where("doc_id % 3 = 0")
    got = [(r["query"], r.match, r.distance) for r in simhash.neighbours(asked, index, radius, blocks, share).collect()]
    few = {x for k, x in rows if x and k % 3 == 0}
    assert sorted(got) == sorted((a, b, d) for a in few for b in {x for _, x in rows if x} if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= radius)


def test_simhash_finds_near_copies(spark):
    """At least 0.9 of the pairs with 3/4 of their shingles in common; what is found has like terms, by their cosine."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    texts = sorted(r.text for r in docs.select("text").distinct().collect())
    sets, holders = [], {}
    for k, t in enumerate(texts):
        w = split(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        for x in sets[-1]:
            holders.setdefault(x, []).append(k)
    common = Counter((a, b) for x in holders.values() for i, b in enumerate(x) for a in x[:i])
    links = [(a, b) for (a, b), n in common.items() if 4 * n >= 3 * (len(sets[a]) + len(sets[b]) - n)]
    f = {r.doc_id: r.fingerprint for r in simhash.fingerprints(table(spark, texts)).collect()}
    rows = spark.createDataFrame(list(f.items()), "doc_id long, fingerprint string")
    near = {(r["query"], r.match) for r in simhash.neighbours(rows, rows, simhash.COPY_RADIUS).collect()}
    found = [(a, b) for a, b in links if (f[a], f[b]) in near]
    assert len(links) > 10 and len(found) >= 0.9 * len(links)

    def terms(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        size = [math.log2(1 + len(x.encode())) for x in w]
        c = Counter()
        for k, x in enumerate(w):
            c[x] += simhash.WORD_WEIGHT * size[k]
        for k in range(len(w) - 1):
            c[w[k], w[k + 1]] += simhash.PAIR_WEIGHT * (size[k] + size[k + 1]) / 2
        return c

    of = {x: k for k, x in f.items()}
    for a, b in {tuple(sorted((of[a], of[b]))) for a, b in near if a != b}:
        x, y = terms(texts[a]), terms(texts[b])
        assert sum(n * y[t] for t, n in x.items()) >= 0.6 * math.hypot(*x.values()) * math.hypot(*y.values())


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_join(spark, monkeypatch, small):
    if small:  # no rounds of centres, crowds of two components, small tries and chunks
        for name, x in (("ROUNDS", 0), ("CROWD", 1), ("LEAVES", 5), ("PROBES", 3), ("CHUNK", 500), ("DEALT", 100), ("BROADCAST_ROWS", 1), ("ONE_TASK", 1)):
            monkeypatch.setattr(jaccard_join, name, x)
    texts = corpus()
    texts += [texts[-1] + " and more of it", "first " + texts[-1]]  # long near copies
    sets = []
    for t in texts:
        w = split(t)
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(i):
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicate_classes(table(spark, texts)).collect()}
    assert got == {k: (len(s), label[k]) for k, s in enumerate(sets)}
    assert jaccard_join.near_duplicate_classes(table(spark, [])).count() == 0


def test_jaccard_join_shuffles_no_texts(spark, monkeypatch):
    plans, before, kept = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), jaccard_join.stored
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 1)  # as where more than 100,000 sets are left
    monkeypatch.setattr(jaccard_join, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = "a b c d e f g h i j k l m n o p"
        rows = [(None, a), (0, "zero " + a + " q"), (0, "other words than those of all the rest"), (5, a + " q"), (6, a + " q"), (7, "x y")]
        sets = jaccard_join.possible_sets(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.n for r in sets) == [12, 13, 14]
    assert not [x for p in plans for x in p.splitlines() if "SortMergeJoin" in x and "doc_id" in x]


def test_jaccard_join_of_odd_ids(spark):
    a, b, c = "a b c d e f g h", "p q r s t u v w", "x y"
    rows = [(None, a), (None, None), (7, a), (7, b), (7, None), (3, b), (1 << 60, c), ((1 << 60) + 1, c)]
    got = sorted(map(tuple, jaccard_join.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 4, 7), (None, 0, None), (7, 4, 7), (7, 4, 3), (7, 0, 7), (3, 4, 3), (1 << 60, 1, 1 << 60), ((1 << 60) + 1, 1, 1 << 60)], key=str)


def test_trie_agrees_with_sets():
    import numpy as np

    rng = random.Random(5)
    order = jaccard_join.Order(np.array([3, 9], np.uint64), np.array([7, 5]))

    def coded(s):
        x, r = order.sort(np.array(sorted(s), np.uint64))
        return np.rec.fromarrays([r.astype(">u4"), x.astype(">u8")]).tobytes()

    sets = [set(rng.sample(range(30), rng.randrange(5, 25))) for _ in range(200)]
    assert jaccard_join.trie_links(coded(sets[0]), [coded(s) for s in sets]) == [100 * len(s & sets[0]) >= 75 * len(s | sets[0]) for s in sets]


def test_mixing(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randrange(0, 400))) for _ in range(300)] + [None, "", "a"]
    sources = [None if k % 11 == 0 else f"s{min(k % 7, 3)}" for k in range(len(texts))]
    sources[-1] = "tiny"
    docs = table(spark, texts, sources)
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    sizes = Counter()
    for t, s in zip(texts, sources):
        sizes[s] += len(split(t))
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, total = dict.fromkeys(sizes, 0.0), sum(sizes.values())
    capped = set()
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    target = {s: float(3 * sizes[s]) if s in capped else weights[s] * level for s in sizes}
    taken = Counter()
    for r in rows:
        assert r.size == len(split(texts[r.doc_id])) and r.taken <= 3 * r.size and r.target == pytest.approx(target[sources[r.doc_id]])
        taken[sources[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] + 2 * mixing.BLOCK for s in sizes)
    # long texts, and equal rows whose hashes tie
    long = table(spark, ["w " * 400_000, "w " * 400_000, "v"], ["a", "a", "b"]).withColumn("doc_id", F.when(F.col("doc_id") < 2, 7).otherwise(8))
    both = [sorted(map(tuple, mixing.mix(d).collect())) for d in (long, long.repartition(3))]
    assert both[0] == both[1] and sum(r[1] for r in both[0]) == 800_001 and all(r[4] <= 3 * r[1] for r in both[0])
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mix(table(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_substring_dedup(spark, monkeypatch, crowded):
    monkeypatch.setattr(substring_dedup, "CROWDED", crowded)
    rng = random.Random(6)
    base = "".join(rng.choice("ab cé") for _ in range(300))
    texts = [base[rng.randrange(200):][:rng.randrange(150)] + rng.choice(["", "x" * 80, "xy" * 40, base[:90]]) + base[rng.randrange(300):] for _ in range(40)] + [None, "", "z", base, base]
    n = 40
    data = [(t or "").encode() for t in texts]
    starts = Counter(b[k:k + n] for b in data for k in range(len(b) - n + 1))
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(table(spark, texts), n, 10).collect()}
    for k, b in enumerate(data):
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if starts[b[i:i + n]] > 1:
                cover[i:i + n] = b"\1" * n
        spans = len(re.findall(b"\1+", bytes(cover)))
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(cover), spans, bytes(x for x, c in zip(b, cover) if not c)), k
    assert substring_dedup.remove_repeats(table(spark, []), n, 10).count() == 0
    w = [list("".join((t or "").split())) for t in texts]  # each character a word
    spaced = table(spark, [" ".join(x) for x in w])
    owners = {}
    for k, x in enumerate(w):
        for i in range(len(x) - 20):
            owners.setdefault(tuple(x[i:i + 21]), set()).add(k)
    key = {r.doc: r.doc_id for r in substring_dedup.keyed(spaced).collect()}
    assert {key[r.doc] for r in substring_dedup.shared_passages(spaced, 20, 6).collect()} == {k for ks in owners.values() if len(ks) > 1 for k in ks}


def removed_by_hand(data, n):
    starts = Counter(b[k:k + n] for b in data for k in range(len(b) - n + 1))
    out = []
    for b in data:
        cover = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if starts[b[i:i + n]] > 1:
                cover[i:i + n] = b"\1" * n
        out.append((len(b), sum(cover)))
    return sorted(out)


def test_substring_dedup_at_full_length(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "STEP", 3000)  # long texts go in steps
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh é") for _ in range(3000))
    texts = [base, "x" * 900, base[500:899], base[100:600] + "q", "".join(rng.choice("ab") for _ in range(20_000)) + base[:450], None, base]
    rows = [(None, texts[1], "k"), (4, texts[2], "k"), (4, texts[3], "k"), (5, texts[5], "k"), ((1 << 60) + 1, texts[0], "k"), ((1 << 60) + 1, texts[0], "k"), (6, texts[4], "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = substring_dedup.remove_repeats(d).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == removed_by_hand([(t or "").encode() for _, t, _ in rows], 400)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(k) for k, _, _ in rows)


def test_suffix_ranks_follow_the_order_of_suffixes():
    import numpy as np

    rng = random.Random(3)
    for kind, n in ((np.uint8, 5), (np.uint8, 21), (np.uint64, 7)):
        x = np.array([rng.randrange(3) for _ in range(300)], kind)
        parts = [tuple(x[k:k + n]) for k in range(len(x) - n + 1)]
        places = {p: k for k, p in enumerate(sorted(set(parts)))}
        assert substring_dedup.suffix_ranks(x, n).tolist() == [places[p] for p in parts]


def test_suffix_tree_scores(spark):
    texts = corpus() + ["the cat sat on the mat"] * 60
    rows = suffix_tree_lm.score_documents(table(spark, texts)).collect()
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))}
    tokens = [split(t) + ["\n"] for t in texts]
    c = Counter(w for k, t in enumerate(tokens) if not held[k] for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    assert len(rows) == len(texts) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert suffix_tree_lm.score_documents(table(spark, [])).count() == 0


def suffix_tree_by_hand(tokens, held, share):
    """Scores of tokenised texts by dictionaries, context by context; and the distributions of all states."""
    train = [t for t, h in zip(tokens, held) if not h]
    c = Counter(w for t in train for w in t)
    n, least = sum(c.values()), max(1, sum(c.values()) * share)
    den = n + len(c) + 1
    known = {w for w in c if c[w] >= least}
    root = {w: (c[w] + 1) / den for w in known}
    root[None] = 1 - sum(root.values())

    def symbols(t):
        return [w if w in known else None for w in t]

    def context(s, k, depth):
        out = []
        for i in range(k - 1, max(k - 1 - depth, -2), -1):
            x = "BEGIN" if i < 0 else s[i]
            if x is None:
                break
            out.append(x)
        return tuple(out)  # the nearest first

    after = {}
    for t in train:
        s = symbols(t)
        for k, w in enumerate(s):
            full = context(s, k, suffix_tree_lm.DEPTH)
            for m in range(1, len(full) + 1):
                after.setdefault(full[:m], Counter())[w] += 1
    states = {}

    def p(ctx, w):
        if not ctx:
            return root[w]
        below = p(ctx[:-1], w)
        if ctx not in states:
            return below
        f, total = after[ctx], sum(after[ctx].values())
        return (max(f[w] - suffix_tree_lm.DISCOUNT, 0) + suffix_tree_lm.DISCOUNT * len(f) * below) / total

    for m in range(1, suffix_tree_lm.DEPTH + 1):
        for ctx, f in after.items():
            if len(ctx) == m:
                states[ctx] = True
                gain = sum(x * math.log(p(ctx, w) / p(ctx[:-1], w)) for w, x in f.items()) / sum(f.values())
                if gain < suffix_tree_lm.DIVERGENCE:
                    del states[ctx]
    for ctx in states:
        assert sum(p(ctx, w) for w in root) == pytest.approx(1.0)
    scores = []
    for t in tokens:
        s = symbols(t)
        base = sum(math.log10((c[w] + 1) / den) for w in t)
        scores.append(base + sum(math.log10(p(context(s, k, suffix_tree_lm.DEPTH), w) / root[w]) for k, w in enumerate(s)))
    return scores, states


@pytest.mark.parametrize("share, branch_size", [(2.0 ** -20, 1 << 21), (0.002, 300)])
def test_suffix_tree_against_brute_force(spark, monkeypatch, share, branch_size):
    for name, x in (("SYMBOL_SHARE", share), ("BRANCH", branch_size), ("BLOCK", 700), ("CHUNK_ROWS", 20)):
        monkeypatch.setattr(suffix_tree_lm, name, x)
    rng = random.Random(11)
    texts = corpus() + ["the cat sat on the mat and the cat ran"] * 60 + [" ".join(rng.choice(["a b c d", "a b d c", "b a", "c"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    expected, states = suffix_tree_by_hand([split(t) + ["\n"] for t in texts], held, share)
    assert {len(s) for s in states} == set(range(1, suffix_tree_lm.DEPTH + 1))
    d = table(spark, texts)
    if branch_size < 1000:  # contexts of every length are hot
        docs = d.withColumn("held_out", F.coalesce(suffix_tree_lm.fold_of(F.col("doc_id"), 7) == 2, F.lit(False)))
        assert all(len(keys) for keys, _, _ in suffix_tree_lm.train(docs)[1][1])
    for parts in (1, 7):
        got = {r.doc_id: r.score for r in suffix_tree_lm.score_documents(d.repartition(parts)).collect()}
        assert got == {k: pytest.approx(x, abs=1e-5) for k, x in enumerate(expected)}


def test_suffix_tree_of_odd_tables(spark):
    rows = [(None, "a b a b", "k"), (3, "word " * 450_000, "k"), (3, None, "k"), (3, None, "k"), (5, "", "k")]
    got = suffix_tree_lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string, held_out string")).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 1, 5, 450_001] and len({r.train_tokens for r in got}) == 1
    only = [k for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    none = suffix_tree_lm.score_documents(spark.createDataFrame([(k, "x y") for k in only], "doc_id long, text string")).collect()
    assert [(r.held_out, r.n_known, r.train_tokens, r.score) for r in none] == [(True, 0, 0, 0.0)] * 2


def test_suffix_tree_scores_do_not_depend_on_partitions(spark):
    # each text's pairs occur once in it, and each text is a partition of its own
    texts = ["a quick brown fox jumps over lazy dogs"] * 40
    one, many = (sorted((r.doc_id, round(r.score, 6)) for r in suffix_tree_lm.score_documents(table(spark, texts).repartition(k, "doc_id")).collect()) for k in (1, 64))
    assert one == many


@pytest.mark.parametrize("min_words", [10, 1, 37])
def test_line_dedup(spark, min_words):
    rng = random.Random(8)
    long = [" ".join(words(rng, 12)) for _ in range(4)]
    short = ["a b c", "d e", "f g h i j", "", "k"]
    texts = ["\n".join(rng.choice(long + short * 2) for _ in range(rng.randrange(1, 14))) for _ in range(60)] + [None, "", "\n\n", long[0], long[0]]
    a, b = " ".join(f"once{k}" for k in range(20)), "five short words at last"
    texts += [f"{a}\n{b}\nx1", f"{a}\n{b}\nx2", f"{a}\n{b}", *["\n".join(f"one{k}" for k in range(60))] * 2, *["\n".join([long[1]] * 40)] * 2]
    lines = [None if t is None else t.split("\n") for t in texts]
    seen, gone = set(), [set() for _ in texts]
    for k, ls in enumerate(lines):
        for i in range(len(ls or [])):
            for j in range(i + 1, len(ls) + 1):
                run = tuple(ls[i:j])
                if sum(max(1, len(split(x))) for x in run) >= min_words:
                    if run in seen:
                        gone[k] |= set(range(i, j))
                    seen.add(run)
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(table(spark, texts), min_words).collect()}
    for k, ls in enumerate(lines):
        expected = texts[k] if not gone[k] else "\n".join(x for i, x in enumerate(ls) if i not in gone[k])
        assert (got[k].text, got[k].n_removed) == (expected, len(gone[k])), k
    assert any(gone) and line_dedup.remove_repeated_lines(table(spark, []), min_words).count() == 0


def test_line_dedup_of_odd_columns(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(None, t, 1, "g", 5, 6), (4, t, 2, "g", 5, 6), (4, t, 3, "g", 5, 6), (5, None, 4, "g", 5, 6)]
    got = line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, row int, gone string, n_lines int, n_removed int"))
    assert sorted((r.row, r.text, r.gone, r.n_lines, r.n_removed) for r in got.collect()) == [(1, t, "g", 1, 0), (2, "", "g", 1, 1), (3, "", "g", 1, 1), (4, None, "g", 0, 0)]


def test_pipeline_drops_whole_copies(spark):
    import corpus_pipeline

    text = " ".join(f"once{k}" for k in range(20)) + "\nfive short words at last"
    left = corpus_pipeline.drop_repeated_lines(spark, table(spark, [text, text, text + "\nx"]), "")
    assert {r.doc_id: r.text for r in left.collect()} == {0: text, 2: "x"}


def test_frequent_shingles_reach_the_driver_as_bytes(spark):
    import numpy as np

    from quarrylake.llm import jaccard_join

    rows = spark.range(1000).selectExpr("id - 500 AS h", "id + 4 AS c").repartition(2).mapInArrow(jaccard_join._packed_counts, "h binary, c binary").collect()
    assert len(rows) < 20
    h, c = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in ((0, np.int64), (1, np.uint32)))
    assert sorted(zip(h.tolist(), c.tolist())) == [(k - 500, k + 4) for k in range(1000)]
