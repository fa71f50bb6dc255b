"""Personal data by weak supervision (DataFrame operations only).

Base detectors find e-mail addresses, IPv4 addresses, card and phone numbers.
Wider patterns, none of which limits the length of a secret, propose further spans. Labelers vote on every candidate, for (1),
against (-1) or not at all (0): its format, cue words before it, a gazetteer,
and what it touches. Expectation-maximisation over the counts of vote patterns
estimates what each vote is worth; the resulting probabilities train a logistic
span classifier on shape features, which decides about the proposed spans.
Both fits see the grouped counts of all candidates; how many groups there are
depends on the labelers and features, not on the corpus.

Defined results: a null text counts as empty; offsets are code points, end
exclusive; base spans always stay; a proposed span that overlaps a base span is
dropped, but for a secret that holds it whole; repeated rows are separate documents; extra columns are ignored; an
empty table gives no rows. Of an assignment (token = "...") the span is the
value, and of a phrase that introduces a name the name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarrylake.llm.common import stored

#: Possessive forms of the contract's patterns: the same matches, in linear time. \G: right behind the last match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
KINDS = [*BASE, "iban", "name", "secret", "ssn"]
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra"
KEYS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key"
#: How well-known keys begin, with what follows, however long: possessive, so that a match is one pass.
SECRETS = (r"(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{8,}+|sk-[A-Za-z0-9]{20,}+|gh[oprsu]_[A-Za-z0-9]{16,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{16,}+"
           r"|(?:AKIA|ASIA)[A-Z0-9]{12,}+|AIza[A-Za-z0-9_-]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_NAME = "[A-ZÀ-Þ][a-zß-ÿ]++"
INTRODUCED = "[Mm]y name is|[Nn]ame is|[Nn]ame:|[Ii] am|I'm|[Dd]ear|[Ss]incerely,|[Rr]egards,|[Mm]ein Name ist|[Ii]ch hei(?:ß|ss)e|[Jj]e m'appelle|[Mm]e llamo"
WIDER = (
    r"(?<![A-Za-z0-9+_-])(?:"
    r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}"
    r"|0[0-9]{2,4}[ /-][0-9]{5,8}"
    r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?"
    rf"|{SECRETS}"
    r"|[a-f0-9]{16,}+|[A-F0-9]{32,}+"
    rf"|(?i:{KEYS})[\x20\t]*+[:=][\x20\t]*+[\"']?[^\s\"',;<>()]{{6,}}+"
    # the parts of an address are 64 characters long at most
    r"|[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64}(?:(?:\.| ?[\[(](?:dot|DOT)[\])] ?)[A-Za-z0-9-]{1,64}){1,8}"
    rf"|(?:{TITLES})\.? {_NAME}(?: {_NAME})?"
    rf"|(?:{INTRODUCED}) {_NAME} {_NAME}"
    r")(?![A-Za-z0-9])")
#: What of a match is the span, where that is less than the match.
VALUE = {"secret": rf"(?s)^(?i:{KEYS})[\x20\t]*[:=][\x20\t]*[\"']?(.+)$", "name": rf"(?s)^(?:{INTRODUCED}) (.+)$"}
#: The gazetteer of given names.
GIVEN = ("Anna|Maria|Laura|Julia|Sarah|Emma|Mary|Linda|Susan|Karen|Lisa|Nancy|Elena|Carmen|Sofia|Marie|Claire|Sophie|Camille|Petra|Sabine|Ursula|Heike|Ingrid|Monika|Jane|Alice|Olivia|"
         "John|James|Robert|Michael|David|William|Thomas|Peter|Paul|Mark|George|Daniel|Hans|Klaus|Stefan|Andreas|Martin|Wolfgang|Jürgen|Pierre|Jean|Luc|Michel|Antoine|José|Juan|Carlos|Luis|Miguel|Pedro|Antonio")
#: Cue words before a span.
CUES = {
    "email": "e-?mail|mail|contact|write|correo|courriel|kontakt", "ip": "ip|host|server|address|from", "card": "card|visa|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|llama|appel", "iban": "iban|account|konto|compte|cuenta", "name": "name|dear|signed|contact|von|nom|nombre",
    "secret": "password|passwd|pwd|token|secret|api.?key|key", "ssn": "ssn|social|security|insurance|tax"}
AGAINST = "version|isbn|issn|page|figure|table|section|vol|no|commit|sha|md5|rev|build"
#: Endings and beginnings that the gazetteer knows, by kind.
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|de|fr|es|uk|info|io|eu)$", "iban": r"^(DE|FR|ES|GB|IT|NL|AT|CH|BE|PT|PL|IE)", "card": r"^(4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^\+?(1|33|34|44|49|39|31|41|43|\(|0)", "name": rf"^({TITLES}|{GIVEN})\b", "secret": rf"^(?:{SECRETS})$"}
CONTEXT = 24
LABELERS = ["format", "cue", "known", "edges"]
FEATURES = ["kind", "length", "digits", "marks", "before", "after"]
ROUNDS = 25


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def valid(kind: str, x: Column) -> Column:
    """Whether a match of a base pattern counts."""
    d = _digits(x)
    if kind == "ip":
        return F.forall(F.transform(F.split(x, r"\."), lambda p: F.ltrim(p, F.lit("0"))), lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(d).between(13, 19) & F.call_function("luhn_check", d)
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: str, needs: str) -> Column:
    """Matches of a pattern, each with the length of what lies before it since the last match, and what touches it."""
    got, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    rows = F.zip_with(got, F.transform(between, lambda x, i: F.struct(F.length(x).cast("long").alias("gap"), F.right(x, F.lit(CONTEXT)).alias("left"), i.alias("i"), F.left(x, F.lit(1)).alias("first"))),
                      lambda m, b: F.struct(m.alias("m"), b.alias("b")))
    none = F.expr("cast(array() as array<struct<m:string,b:struct<gap:bigint,left:string,i:int,first:string>>>)")
    return F.when(F.contains(text, F.lit(needs)) if needs else F.lit(True), rows).otherwise(none)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, row), candidates (doc_id, row, kind, base, start, end, m, left, after))."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stored(t.select("doc_id", F.monotonically_increasing_id().alias("row"), *(_found(F.col("text"), p, NEEDS[k]).alias(k) for k, p in BASE.items()),
                            _found(F.col("text"), WIDER, "").alias("wider")))
    kinds = F.array(*(F.struct(F.lit(k).alias("source"), F.col(k).alias("x")) for k in [*BASE, "wider"]))
    e = found.select("doc_id", "row", F.explode(kinds).alias("s")).select("doc_id", "row", "s.source", F.explode("s.x").alias("x"))
    # zip_with pads: behind the last match lies a piece without one
    e = e.select("doc_id", "row", "source", "x.m", "x.b.gap", "x.b.left", "x.b.i", "x.b.first", F.coalesce(F.length("x.m"), F.lit(0)).cast("long").alias("n"))
    order = W.partitionBy("row", "source").orderBy("i")
    e = e.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    e = e.withColumn("after", F.lead("first").over(order)).where("m IS NOT NULL")
    d = F.length(_digits(F.col("m")))
    proposed = (F.when(F.col("m").rlike(r"(?i)[\[(]at[\])]"), "email").when(F.col("m").rlike(VALUE["secret"]) | F.col("m").rlike(f"^(?:{SECRETS})$"), "secret")
                .when(F.col("m").rlike(f"^({TITLES})") | F.col("m").rlike(VALUE["name"]), "name").when(F.col("m").rlike("^(?:[a-f0-9]{16,}|[A-F0-9]{32,})$") & (d < F.length("m")), "secret")
                .when(F.col("m").rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(F.col("m").rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(F.col("m").rlike("^[0-9(]") & d.between(8, 13), "phone"))
    e = e.withColumn("kind", F.when(F.col("source") == "wider", proposed).otherwise(F.col("source"))).where("kind IS NOT NULL")
    # what comes before the value goes to its left context
    value = F.col("m")
    for k, p in VALUE.items():
        value = F.when((F.col("source") == "wider") & (F.col("kind") == k) & F.col("m").rlike(p), F.regexp_extract("m", p, 1)).otherwise(value)
    e = e.withColumn("value", value).withColumns({"left": F.right(F.concat("left", F.substr("m", F.lit(1), F.length("m") - F.length("value"))), F.lit(CONTEXT)), "n": F.length("value").cast("long"), "m": F.col("value")})
    good = F.lit(False)
    for k in BASE:
        good = F.when(F.col("source") == k, valid(k, F.col("m"))).otherwise(good)
    e = e.select("doc_id", "row", "kind", (F.col("source") != "wider").alias("of_base"), good.alias("base"), (F.col("end") - F.col("n")).alias("start"), "end", "m", "left", F.coalesce("after", F.lit("")).alias("after"))
    return found.select("doc_id", "row"), stored(e)


def _by_kind(table: dict[str, str], column: str, prefix: str = "", suffix: str = "") -> Column:
    out = F.lit(False)
    for k, p in table.items():
        out = F.when(F.col("kind") == k, F.col(column).rlike(f"{prefix}{p}{suffix}")).otherwise(out)
    return out


def votes(c: DataFrame) -> DataFrame:
    """c with a vote of each labeler and the span classifier's features."""
    cue, foe = _by_kind({k: f"(?:{p})" for k, p in CUES.items()}, "left", r"(?i)(?<![A-Za-z])", r"[\w.]{0,3}[\s:=\"'(]{0,4}(?:is|at|ist|est|es)?[\s:\"']{0,3}$"), F.col("left").rlike(rf"(?i)\b(?:{AGAINST})\.?[\s:=#]{{0,3}}$")
    glued = F.col("left").rlike(r"[\p{L}0-9_]$") | F.col("after").rlike(r"^[\p{L}0-9_]")
    d = F.length(_digits(F.col("m"))) / F.length("m")
    return c.withColumns({
        "format": F.when((F.col("kind") == "secret") & ~F.col("m").rlike("[0-9]"), -1).when(F.col("base") | F.col("kind").isin("iban", "ssn", "name") | ((F.col("kind") == "secret") & F.col("m").rlike("[A-Za-z]")) | F.col("m").rlike(r"(?i)[\[(](at|dot)[\])]"), 1).when(F.col("of_base"), -1).otherwise(0),
        "cue": F.when(cue, 1).when(foe, -1).otherwise(0),
        "known": F.when(_by_kind(GAZETTEER, "m"), 1).otherwise(0),
        "edges": F.when(glued, -1).otherwise(1),
        "length": F.least(F.floor(F.length("m") / 6), F.lit(5)).cast("int"), "digits": F.floor(d * 4).cast("int"),
        "marks": F.least(F.length(F.regexp_replace("m", r"[\p{L}0-9]", "")), F.lit(4)).cast("int"),
        "before": F.when(F.col("left") == "", 0).when(F.col("left").rlike(r"\s$"), 1).when(F.col("left").rlike(r"[:=\"'(]$"), 2).otherwise(3),
        "after_": F.when(F.col("after") == "", 0).when(F.col("after").rlike(r"^\s"), 1).when(F.col("after").rlike(r"^[.,;:!?\"')]"), 2).otherwise(3)})


def estimate(patterns: dict[tuple, float]) -> dict[tuple, float]:
    """Probability that a candidate is personal data, for each (votes) pattern with its count: naive Bayes with a hidden class, by EM."""
    # it starts from the balance of votes
    post = {v: 1 / (1 + math.exp(-1.5 * sum(v) + 0.5)) for v in patterns}
    for _ in range(ROUNDS):
        mass = {y: sum(n * (post[v] if y else 1 - post[v]) for v, n in patterns.items()) for y in (0, 1)}
        rate = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        table = {}
        for j in range(len(LABELERS)):
            for y in (0, 1):
                for x in (-1, 0, 1):
                    seen = sum(n * (post[v] if y else 1 - post[v]) for v, n in patterns.items() if v[j] == x)
                    # a vote in favour is thought better than chance beforehand
                    prior = 3.0 if (x == 1) == (y == 1) and x else 1.0
                    table[j, y, x] = (seen + prior) / (mass[y] + 5.0)
        post = {v: _two(rate * math.prod(table[j, 1, x] for j, x in enumerate(v)), (1 - rate) * math.prod(table[j, 0, x] for j, x in enumerate(v))) for v in patterns}
    return post


def _two(a: float, b: float) -> float:
    return a / (a + b) if a + b else 0.5


def fit_classifier(rows: list[tuple[tuple, float, float]], steps: int = 200, rate: float = 1.0, penalty: float = 1e-3) -> dict[tuple, float]:
    """Weights of a logistic regression on one-hot features; rows: (feature values, share that is personal data, count)."""
    weights: dict[tuple, float] = {("", ""): 0.0}
    total = sum(n for *_, n in rows) or 1.0
    for _ in range(steps):
        grad = {k: penalty * w for k, w in weights.items()}
        for values, y, n in rows:
            keys = [("", ""), *zip(FEATURES, values)]
            p = 1 / (1 + math.exp(-sum(weights.get(k, 0.0) for k in keys)))
            for k in keys:
                grad[k] = grad.get(k, 0.0) + (p - y) * n / total
        for k, g in grad.items():
            weights[k] = weights.get(k, 0.0) - rate * g
    return weights


def personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents (doc_id, row), spans (doc_id, row, kind, base, start, end, m))."""
    rows, c = candidates(docs)
    v = stored(votes(c))
    counts = v.groupBy(*LABELERS, "kind", "length", "digits", "marks", "before", "after_").agg(F.count("*").alias("n")).collect()
    patterns: dict[tuple, float] = {}
    for r in counts:
        k = tuple(r[x] for x in LABELERS)
        patterns[k] = patterns.get(k, 0.0) + r["n"]
    post = estimate(patterns)
    groups: dict[tuple, list[float]] = {}
    for r in counts:
        g = groups.setdefault((r["kind"], r["length"], r["digits"], r["marks"], r["before"], r["after_"]), [0.0, 0.0])
        g[0] += post[tuple(r[x] for x in LABELERS)] * r["n"]
        g[1] += r["n"]
    # each kind counts the same, so that many digits of one do not decide about the few spans of another
    of_kind: dict[str, float] = {}
    for k, (_, n) in groups.items():
        of_kind[k[0]] = of_kind.get(k[0], 0.0) + n
    weights = fit_classifier([(k, a / n, n / of_kind[k[0]]) for k, (a, n) in sorted(groups.items())])
    z = F.lit(weights["", ""])
    for name in FEATURES:
        own = [(k[1], w) for k, w in sorted(weights.items(), key=str) if k[0] == name]
        part = F.lit(0.0)
        for value, w in own:
            part = F.when(F.col("after_" if name == "after" else name) == value, w).otherwise(part)
        z = z + part
    base = v.where("base").select("doc_id", "row", "kind", "base", "start", "end", "m")
    more = v.where(~F.col("of_base") & (z >= 0)).select("doc_id", "row", "kind", "base", "start", "end", "m")
    taken = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    apart = (F.col("start") >= F.col("e")) | (F.col("s") >= F.col("end")) | ((F.col("kind") == "secret") & (F.col("start") <= F.col("s")) & (F.col("e") <= F.col("end")))
    more = more.join(taken, (F.col("row") == F.col("r")) & ~apart, "left_anti")
    return rows, base.unionByName(more)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    rows, spans = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    x = F.struct(rank.alias("k"), F.col("start"), F.col("end"), F.concat_ws(":", "kind", "start", "end").alias("s"))
    per = spans.groupBy("row").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE),
        F.sort_array(F.collect_list(F.when(F.col("base"), x))).alias("b"), F.sort_array(F.collect_list(x)).alias("a"))
    text = {c: F.array_join(F.transform(c, lambda y: y.s), ",") for c in "ab"}
    out = rows.join(per, "row", "left")
    # n_spans: base spans and those that the method adds
    return out.select("doc_id", *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE), F.coalesce(F.size("a"), F.lit(0)).cast("long").alias("n_spans"),
                      F.sha2(F.coalesce(text["b"], F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce(text["a"], F.lit("")).alias("spans"))
