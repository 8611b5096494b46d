"""Personal data by weak supervision, in DataFrame expressions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Two families of further candidates are looser:
``number`` (digit groups that are no valid card and lie outside the other kinds) and ``secret`` (long runs of letters and
digits mixed). Four labelers vote on each candidate, for, against or not at all:

* form: a regular expression of the usual groupings (or of keys and hex digits),
* gazetteer: a word of a fixed list stands in the text just before,
* context: what stands right before or after, such as ``=``, ``:``, a quote, a currency sign or a unit,
* shape: dates, versions, numbers of one repeated digit and plain words are no personal data.

Votes and features of all candidates of all documents are counted by Spark; there are at most
2 * 3^4 * 12 different combinations, and only their counts reach the driver. There expectation-maximisation
estimates each labeler's reliability and the share of true candidates, and the posterior of every
combination trains a naive Bayes span classifier over the features. Its weights go back as literals, and a
candidate stays if its log odds are above zero. Base spans always stay.

Offsets are code points. Where a pattern's matches begin follows from the lengths of what lies between them.

Defined results: a null or empty text has no spans; a row is judged by itself but for the trained weights, so repeated
rows agree; a very long text, also one long run of digits, labels or key letters, is matched whole and takes no stack; an empty table
gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdensity.llm.common import let
from netdensity.session import materialize

LOCAL = "A-Za-z0-9._%+-"
# The four patterns of the contract. A match begins where the last one ended or where no character of its first run
# stands before, which finds the same matches but passes over a long run once; repeated groups are possessive, which finds the
# same where nothing follows them and takes no stack.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"[A-Za-z0-9_+/=-]{20,}"
KINDS = ("email", "ip", "card", "phone", "number", "secret")
MASK = "\x01"
#: Words just before a candidate that speak for it, by family, in lower case.
GAZETTEER = {
    "number": ("phone", "tel", "telephone", "mobile", "call", "fax", "ssn", "social security", "passport", "account", "iban", "id", "card", "licence", "license", "insurance", "member"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api", "auth", "bearer", "credential", "access"),
}
CHUNK = 128
#: Rounds of expectation-maximisation, and what is added to every count.
ROUNDS, PRIOR = 50, 0.5


def prefix(s: Column) -> Column:
    """For an array of longs, the sums of what stands before each place; by chunks, so that long arrays stay cheap."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y)
    before = lambda x: F.transform(x, lambda y, i: total(F.slice(x, 1, i)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / CHUNK).cast("int")), lambda b: F.slice(s, b * CHUNK + 1, CHUNK))

    def placed(chunks: Column) -> Column:
        sums = let(F.transform(chunks, total), before)
        return let(sums, lambda p: F.flatten(F.transform(chunks, lambda c, k: F.transform(before(c), lambda x: x + F.get(p, k)))))

    return F.when(F.size(s) == 0, F.array().cast("array<bigint>")).otherwise(let(chunks, placed))


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """Array of (s, e, m, before, after): the pattern's matches where ``guard`` holds."""
    kind = "array<struct<s:int,e:int,m:string,before:string,after:string>>"

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, k: (F.char_length(m) + F.char_length(F.get(gaps, k))).cast("long"))

        def spans(before: Column) -> Column:
            def one(m: Column, k: Column) -> Column:
                s = (F.get(before, k) + F.char_length(F.get(gaps, k))).cast("int")
                return F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m"), F.right(F.get(gaps, k), F.lit(24)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(8)).alias("after"))

            return F.transform(found, one)

        return let(steps, lambda st: let(prefix(st), spans))

    some = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda f: F.when(F.size(f) == 0, F.array().cast(kind)).otherwise(let(F.split(text, pattern, -1), lambda g: placed(f, g)).cast(kind)))
    return F.when(guard, some).otherwise(F.array().cast(kind))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the check of the last digit."""
    values = F.transform(F.sequence(F.lit(0), F.char_length(d) - 1), lambda i: F.substring(d, F.char_length(d) - i, F.lit(1)).cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def valid_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def valid_ip(m: Column) -> Column:
    # Leading zeros do not count; more than three digits after them are over 255.
    return F.forall(F.split(m, "\\."), lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: F.when(F.char_length(q) > 3, F.lit(False)).otherwise(q.cast("int") <= 255)))


def vote(plus: Column, minus: Column) -> Column:
    return F.when(minus, -1).when(plus, 1).otherwise(0)


def judged(family: str, c: Column) -> Column:
    """A candidate with its votes and features."""
    m, low = c["m"], F.lower(c["before"])
    n = F.char_length(digits(m))
    near = F.rlike(low, F.lit(r"(?:^|[^a-z])(?:" + "|".join(GAZETTEER[family]) + r")[^a-z]*$"))
    if family == "number":
        form = vote(F.rlike(m, F.lit(r"^(?:[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{2}(?:[ -][0-9]{2}){4})$")), ~n.between(7, 19))
        shape = vote(F.lit(False), F.rlike(m, F.lit(r"^(?:(?:19|20)[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}|([0-9])(?:[ -]?\1)*+|[0-9]{1,6})$")))
        context = vote(F.rlike(c["before"], F.lit(r"[:=#(] ?$")), F.rlike(c["before"], F.lit(r"[$€£.,/]$")) | F.rlike(c["after"], F.lit(r"^(?:[.,/][0-9]|[%€$£A-Za-z]| ?(?:km|kg|usd|eur)\b)")))
    else:
        form = vote(F.rlike(m, F.lit(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_+/=-]{20,})$")), ~F.rlike(m, F.lit("[0-9]")) | ~F.rlike(m, F.lit("[A-Za-z]")))
        shape = vote(n >= 5, F.rlike(m, F.lit(r"^[A-Za-z]++(?:[-_/][A-Za-z]++)*+[0-9]{0,4}$|^[=_+/-]+$|^[0-9-]+$")))
        context = vote(F.rlike(c["before"], F.lit(r"[:=] ?[\"']?$|[\"']$")), F.rlike(c["before"], F.lit(r"[/.#?&]$")))
    return F.struct(
        F.lit(family).alias("kind"), c["s"].alias("s"), c["e"].alias("e"),
        form.alias("v0"), vote(near, F.lit(False)).alias("v1"), context.alias("v2"), shape.alias("v3"),
        F.when(F.char_length(m) < 12, 0).when(F.char_length(m) < 20, 1).when(F.char_length(m) < 36, 2).otherwise(3).alias("f_len"),
        F.when(10 * n < 3 * F.char_length(m), 0).when(10 * n < 8 * F.char_length(m), 1).otherwise(2).alias("f_digits"),
    )


def spans_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, base (array of kind, s, e) and cand (array of judged candidates): one pass over the texts, no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_digits = F.rlike(t, F.lit("[0-9]"))
    found = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        t.alias("t"),
        matches(t, EMAIL, F.contains(t, F.lit("@"))).alias("email"),
        F.filter(matches(t, IP, has_digits), lambda c: valid_ip(c["m"])).alias("ip"),
        F.filter(matches(t, CARD, has_digits), lambda c: valid_card(c["m"])).alias("card"),
        F.filter(matches(t, PHONE, F.contains(t, F.lit("+"))), lambda c: F.char_length(digits(c["m"])).between(9, 15)).alias("phone"),
    )

    def masked(t: Column, pattern: str, sign: Column) -> Column:
        def join(f: Column, g: Column) -> Column:
            return F.array_join(F.transform(g, lambda x, k: F.concat(x, F.repeat(F.lit(MASK), F.coalesce(F.char_length(F.get(f, k)), F.lit(0))))), "")

        found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.when(sign, let(found, lambda f: F.when(F.size(f) == 0, t).otherwise(let(F.split(t, pattern, -1), lambda g: join(f, g))))).otherwise(t)

    # One pattern after the other: each by itself passes over a long run once.
    u = masked(F.col("t"), EMAIL, F.contains(F.col("t"), F.lit("@")))
    u = let(u, lambda x: masked(x, PHONE, F.contains(x, F.lit("+"))))
    u = let(u, lambda x: masked(x, IP, F.rlike(x, F.lit("[0-9]\\.[0-9]"))))
    found = found.withColumn("u", u)
    u = F.col("u")
    numbers = F.filter(matches(u, CARD, F.rlike(u, F.lit("[0-9]"))), lambda c: (F.char_length(digits(c["m"])) >= 6) & ~valid_card(c["m"]))
    secrets = F.filter(matches(u, SECRET, F.rlike(u, F.lit(SECRET))), lambda c: F.rlike(c["m"], F.lit("[A-Za-z]")))
    plain = lambda kind: F.transform(kind, lambda c: F.struct(F.lit(kind).alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return found.select(
        "doc_id",
        F.concat(*[plain(k) for k in KINDS[:4]]).alias("base"),
        F.concat(F.transform(numbers, lambda c: judged("number", c)), F.transform(secrets, lambda c: judged("secret", c))).alias("cand"),
    )


@dataclass
class Model:
    """Per family: the labelers' reliabilities, the share of true candidates, and the classifier's log odds."""

    reliability: dict[str, list[dict[int, tuple[float, float]]]] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)
    weights: dict[str, dict[str, dict[int, float]]] = field(default_factory=dict)
    bias: dict[str, float] = field(default_factory=dict)


VOTES = ("v0", "v1", "v2", "v3")
FEATURES = ("v0", "v1", "v2", "v3", "f_len", "f_digits")
VALUES = {"f_len": range(4), "f_digits": range(3)} | {v: (-1, 0, 1) for v in VOTES}


def train(counts: list[dict]) -> Model:
    """``counts``: combinations of kind, votes and features, with how many candidates (n) have them."""
    model = Model()
    for family in KINDS[4:]:
        rows = [r for r in counts if r["kind"] == family]
        if not rows:
            continue
        # Start from the balance of votes.
        post = [1 / (1 + math.exp(-1.5 * sum(r[v] for v in VOTES))) for r in rows]
        for _ in range(ROUNDS):
            true = sum(p * r["n"] for p, r in zip(post, rows))
            false = sum((1 - p) * r["n"] for p, r in zip(post, rows))
            share = (true + PRIOR) / (true + false + 2 * PRIOR)
            table = []
            for v in VOTES:
                by = {k: [PRIOR * (1 + k), PRIOR * (1 - k)] if k else [PRIOR, PRIOR] for k in (-1, 0, 1)}
                for p, r in zip(post, rows):
                    by[r[v]][0] += p * r["n"]
                    by[r[v]][1] += (1 - p) * r["n"]
                by = {k: [x + 1e-3 for x in xs] for k, xs in by.items()}
                sums = [sum(xs[c] for xs in by.values()) for c in (0, 1)]
                table.append({k: (xs[0] / sums[0], xs[1] / sums[1]) for k, xs in by.items()})
            odds = [math.log(share / (1 - share)) + sum(math.log(t[r[v]][0] / t[r[v]][1]) for t, v in zip(table, VOTES)) for r in rows]
            post = [1 / (1 + math.exp(-max(-500, min(500, o)))) for o in odds]
        model.reliability[family], model.share[family] = table, share
        true = sum(p * r["n"] for p, r in zip(post, rows))
        false = sum((1 - p) * r["n"] for p, r in zip(post, rows))
        model.bias[family] = math.log((true + PRIOR) / (false + PRIOR))
        model.weights[family] = {}
        for f in FEATURES:
            n = {k: [PRIOR, PRIOR] for k in VALUES[f]}
            for p, r in zip(post, rows):
                n[r[f]][0] += p * r["n"]
                n[r[f]][1] += (1 - p) * r["n"]
            sums = [sum(x[c] for x in n.values()) for c in (0, 1)]
            model.weights[family][f] = {k: math.log(x[0] / sums[0]) - math.log(x[1] / sums[1]) for k, x in n.items()}
    return model


def kept(model: Model, c: Column) -> Column:
    """Whether the classifier keeps a candidate."""
    out = F.lit(False)
    for family, weights in model.weights.items():
        odds = F.lit(model.bias[family])
        for f, by in weights.items():
            w = F.lit(0.0)
            for value, x in by.items():
                w = F.when(c[f] == value, F.lit(x)).otherwise(w)
            odds = odds + w
        out = F.when(c["kind"] == family, odds > 0).otherwise(out)
    return out


def find(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, base and spans of every row: arrays of (kind, s, e), by kind as listed, then start."""
    spans = materialize(spans_of(docs, doc_id, text))
    seen = spans.select(F.explode("cand").alias("c")).select("c.kind", *[f"c.{f}" for f in FEATURES])
    # At most 2 * 3^4 * 12 rows, whatever the corpus.
    model = train([r.asDict() for r in seen.groupBy("kind", *FEATURES).agg(F.count("*").alias("n")).orderBy("kind", *FEATURES).collect()])
    added = F.transform(F.filter("cand", lambda c: kept(model, c)), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e")))
    return spans.select("doc_id", "base", F.concat("base", added).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["s"], c["e"])), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
