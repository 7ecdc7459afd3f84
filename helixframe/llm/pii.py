"""Operator 6: personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans.  Labelers (strict pattern, which abstains where only a wider
one matches, checksum or range, gazetteer, context words, boundaries) vote yes, no or abstain on each; expectation-
maximisation over the counts of vote patterns estimates the labelers' reliabilities
and each pattern's posterior; a naive Bayes span classifier on shape and votes is
trained on those posteriors (votes are features too).  Spans of the base rules always stay; other candidates
are added where the classifier is sure and they overlap no base span.

The pattern table has a constant bound (votes and features are small enumerations),
whatever the corpus.  Offsets are code points, end exclusive.

Defined results: null text counts as empty (no spans); repeated rows and null ids
each get a row; an empty table gives no rows; a text's size is not bounded (patterns
are possessive, so they run in linear time without recursion); of spans with one start the
kinds' order decides.  Other columns are not read.
"""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from . import common

# Kinds in their order, and the base patterns in possessive form.
KINDS = ("email", "ip", "card", "phone", "secret")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Wider candidates of the method: (kind, a pattern that a text must hold for the next one to match, pattern).
WIDER = (
    ("email", "at", rf"(?<!{LOCAL})[A-Za-z0-9._%+-]{{2,}}+ ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]{{2,}}+)++"),
    ("phone", "[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    ("secret", "", r"(?:token|secret|password|api[_-]key)\s{0,3}+[=:]\s{0,3}+\"?[A-Za-z0-9_-]{12,}+\"?"),
)
IP_RANGE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]] ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+(?:1|7|2[0-9]|3[0-9]|4[0-9]|5[0-9]|6[0-6]|8[0-9]|9[0-8])|\(?[2-9][0-9]{2})",
    "secret": r"[0-9]",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|correo|courriel)\W*\w*\W*$",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|from)\W*\w*\W*$",
    "card": r"(?i)(?:card|visa|master|amex|credit|carte|tarjeta|karte)\W*\w*\W*$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell)\W*\w*\W*$",
    "secret": r"(?i)(?:export|config|auth|login|env)\W*\w*\W*$",
}
COUNTER_CUE = r"(?i)(?:version|isbn|issn|figure|section|order|serial|part no)\W*\w*\W*$"
CONTEXT = 24
LABELERS = 5
ROUNDS = 12
#: Posterior from which a candidate that no base rule accepts is added.
SURE = 0.9


def starts(pieces: Column, matches: Column) -> Column:
    """Offset of each match: running sums of the lengths of pieces and matches, in blocks, so long lists stay near linear."""
    block = 512
    sizes = F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    ahead = F.transform(F.slice(pieces, 1, F.size(matches)), F.length)
    n_blocks = F.ceil(F.size(matches) / block).cast("int")

    def one(i: Column) -> Column:
        base = F.aggregate(F.slice(sizes, 1, i * block), F.lit(0), lambda a, x: a + x)
        seed = F.struct(base.alias("at"), F.array().cast("array<int>").alias("out"))
        part = F.slice(sizes, i * block + 1, block)
        return F.aggregate(part, seed, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]

    bases = F.flatten(F.transform(F.sequence(F.lit(0), n_blocks - 1), one))
    return F.zip_with(bases, ahead, lambda b, p: b + p)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    figures = F.split(F.reverse(number), "")
    worth = F.transform(figures, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def accepted(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    n = F.length(digits(m))
    return {
        "email": F.lit(True),
        "ip": m.rlike(IP_RANGE),
        "card": F.when(n.between(14, 19), luhn(digits(m))).otherwise(False),
        "phone": n.between(10, 15),
    }[kind]


def spans_of(i: int, kind: str, base: bool):
    """For F.transform over the matches of job ``i``: match and index to span."""

    def span(m: Column, k: Column) -> Column:
        at = F.get(F.col(f"s{i}"), k)
        return F.struct(
            at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (at + F.length(m)).alias("end"), F.lit(kind).alias("kind"), m.alias("m"),
            F.right(F.get(F.col(f"p{i}"), k), F.lit(CONTEXT)).alias("l"), F.left(F.get(F.col(f"p{i}"), k + 1), F.lit(CONTEXT)).alias("r"),
            (accepted(kind, m) if base else F.lit(False)).alias("base"), F.lit(not base).alias("wide"),
        )

    return span


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and cands: array of (start, rank, end, kind, m, l, r, base, wide) of whole texts; wide ones are not of a base pattern."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    need = {"email": F.col("t").contains("@"), "phone": F.col("t").contains("+"), "ip": F.col("t").rlike("[0-9]"), "card": F.col("t").rlike("[0-9]")}
    jobs = [(k, p, need[k], True) for k, p in PATTERNS.items()] + [(k, p, F.col("t").rlike(w), False) for k, w, p in WIDER]
    none = F.array().cast("array<string>")
    for i, (_, p, when, _) in enumerate(jobs):
        rows = rows.withColumn(f"m{i}", F.when(when, F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none))
    for i, (_, p, _, _) in enumerate(jobs):
        rows = rows.withColumn(f"p{i}", F.when(F.size(f"m{i}") > 0, F.split("t", p, -1)).otherwise(none))
    rows = rows.drop("t")
    for i, _ in enumerate(jobs):
        rows = rows.withColumn(f"s{i}", F.when(F.size(f"m{i}") > 0, starts(F.col(f"p{i}"), F.col(f"m{i}"))).otherwise(F.array().cast("array<int>")))
    lists = []
    for i, (kind, _, _, base) in enumerate(jobs):
        found = F.transform(F.col(f"m{i}"), spans_of(i, kind, base))
        if kind == "card":  # short runs of digits are no candidates
            found = F.filter(found, lambda c: c["base"] | F.length(digits(c["m"])).between(13, 19))
        lists.append(found)
    return rows.select("doc_id", F.concat(*lists).alias("cands"))


def by_kind(kind: Column, table: dict[str, Column]) -> Column:
    out = F.lit(None)
    for k, v in table.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 2).otherwise(0)


def votes(c: Column) -> list[Column]:
    """The labelers' votes on a candidate: 1 yes, 2 no, 0 abstains."""
    kind, m, left, right = c["kind"], c["m"], c["l"], c["r"]
    n = F.length(digits(m))
    valid = by_kind(kind, {
        "email": m.rlike(r"(?:\.|dot[)\]] ?)[A-Za-z]{2,}$"), "ip": m.rlike(IP_RANGE),
        "card": F.when(n.between(13, 19), luhn(digits(m))).otherwise(False), "phone": n.between(10, 15),
        "secret": m.rlike("[0-9]") & m.rlike("[A-Za-z]"),
    })
    known = by_kind(kind, {k: (digits(m) if k == "card" else m).rlike(p) for k, p in GAZETTEER.items()})
    cue = by_kind(kind, {k: left.rlike(p) for k, p in CUES.items()})
    glued = left.rlike(r"[\w.@-]$") | right.rlike(r"^[\w@-]")
    return [
        vote(c["base"], ~c["base"] & ~c["wide"]), vote(valid, ~valid), vote(known, ~known & kind.isin("card", "email")),
        vote(cue, left.rlike(COUNTER_CUE)), vote(~glued, glued),
    ]


def features(c: Column) -> list[Column]:
    """Shape of a candidate, as small enumerations."""
    m, left, right = c["m"], c["l"], c["r"]
    klass = lambda s: F.when(s == "", 0).when(s.rlike(r"^\s"), 1).when(s.rlike("^[A-Za-z]"), 2).when(s.rlike("^[0-9]"), 3).otherwise(4)
    return [
        F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("int"),
        F.floor(4 * F.length(digits(m)) / F.length(m)).cast("int"),
        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(6)),
        klass(F.right(left, F.lit(1))),
        klass(F.left(right, F.lit(1))),
        F.when(m.contains(" "), 1).when(m.contains("-"), 2).when(m.contains("."), 3).otherwise(0),
    ]


class Model:
    """What expectation-maximisation and the span classifier learned; a few hundred numbers."""

    def __init__(self, prior: dict, weights: dict):
        self.prior, self.weights = prior, weights

    def score(self, c: Column) -> Column:
        """Log odds that a candidate is personal data."""
        total = by_kind(c["kind"], {k: F.lit(v) for k, v in self.prior.items()}) if self.prior else F.lit(None)
        for i, f in enumerate(features(c) + votes(c)):
            table = [x for (kind, j, value), w in self.weights.items() if j == i for x in (F.lit(f"{kind}:{value}"), F.lit(w))]
            if table:
                total = total + F.coalesce(F.try_element_at(F.create_map(*table), F.concat_ws(":", c["kind"], f.cast("string"))), F.lit(0.0))
        return F.coalesce(total.cast("double"), F.lit(-99.0))


def expectation_maximisation(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """The posterior of each (kind, votes) from (kind, votes, count): labelers are independent given the truth,
    each with its own chances to vote yes, no or not at all."""
    post = {(k, v): (v.count(1) + 1) / (v.count(1) + v.count(2) + 2) for k, v, _ in patterns}
    for _ in range(rounds):
        for kind in {k for k, *_ in patterns}:
            rows = [(v, n, post[k, v]) for k, v, n in patterns if k == kind]
            total, yes = sum(n for _, n, _ in rows), sum(n * p for _, n, p in rows)
            prior = min(max((yes + 1) / (total + 2), 0.02), 0.98)
            odds = []
            for i in range(LABELERS):
                for x in range(3):
                    n, y = sum(n for v, n, _ in rows if v[i] == x), sum(n * p for v, n, p in rows if v[i] == x)
                    odds.append(math.log(((y + 1) / (yes + 3)) / ((n - y + 1) / (total - yes + 3))))
            for v, *_ in rows:
                logit = math.log(prior / (1 - prior)) + sum(odds[3 * i + x] for i, x in enumerate(v))
                post[kind, v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))
    return post


def train(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimates reliabilities by expectation-maximisation, then fits the span classifier to the posteriors."""
    one = found.select(F.explode("cands").alias("c"))
    cols = [v.alias(f"v{i}") for i, v in enumerate(votes(F.col("c")))] + [f.alias(f"f{i}") for i, f in enumerate(features(F.col("c")))]
    marks = [f"v{i}" for i in range(LABELERS)]
    keys = ["kind", *marks, *[f"f{i}" for i in range(len(cols) - LABELERS)]]
    table = common.cut(one.select(F.col("c")["kind"].alias("kind"), *cols).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    # a row for each kind and vote pattern: 5 x 3 ** LABELERS at most
    patterns = [(r.kind, tuple(r[m] for m in marks), r.n) for r in table.groupBy("kind", *marks).agg(F.sum("n").alias("n")).collect()]
    if not patterns:
        return Model({}, {})
    post = found.sparkSession.createDataFrame([(k, *v, p) for (k, v), p in expectation_maximisation(patterns, rounds).items()], f"kind string, {', '.join(f'{m} int' for m in marks)}, p double")
    slots = F.explode(F.array(*[F.struct(F.lit(i).alias("j"), F.col(x).cast("int").alias("value")) for i, x in enumerate(keys[1 + LABELERS :] + marks)])).alias("s")
    rows = table.join(F.broadcast(post), ["kind", *marks]).select("kind", "n", "p", slots).groupBy("kind", "s").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p")).alias("y")).collect()
    sums: dict = {}
    for r in rows:
        if r.s.j == 0:
            have = sums.setdefault(r.kind, [0.0, 0.0])
            have[0] += r.y
            have[1] += r.n - r.y
    prior = {k: math.log((y + 0.5) / (n + 0.5)) for k, (y, n) in sums.items()}
    weights = {(r.kind, r.s.j, r.s.value): math.log(((r.y + 0.5) / (sums[r.kind][0] + 8)) / ((r.n - r.y + 0.5) / (sums[r.kind][1] + 8))) for r in rows}
    return Model(prior, weights)


def find(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """doc_id, base and added: arrays of (start, rank, end, kind), sorted by start and kind."""
    found = common.cut(candidates(docs))
    model = train(found)
    base = F.filter("cands", lambda c: c["base"])
    slim = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["start"], c["rank"], c["end"], c["kind"])))
    rows = found.withColumn("base", base)
    free = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.filter("cands", lambda c: ~c["base"] & (model.score(c) >= math.log(sure / (1 - sure))) & free(c))
    return rows.select("doc_id", slim(F.col("base")).alias("base"), slim(more).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"] == k), False)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]  # noqa: B023
    both = F.array_sort(F.array_distinct(F.concat("base", "added")))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(both).alias("spans"))
