"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions find candidate spans: strict ones, which are always kept, and loose ones (obfuscated addresses, colon
addresses, cards of 13 to 15 digits, numbers without a plus).  Loose ones that overlap a strict one of their kind are no
candidates.  Five labelers vote on each: its form once it is written plainly, check digits and ranges, a gazetteer of domains,
networks, card issuers and area codes that the corpus's own strict spans name in two documents at least, the words before it,
and the characters around it.  None of them looks at which pattern has found a candidate.  Expectation-maximisation over the
votes, which assumes that labelers err independently, estimates how reliable each is and how likely each vote pattern is
personal data.  These likelihoods train the final classifier, a logistic model of votes and shape on all candidates, which
decides on the loose spans.

Spark's functions have no positions of all matches, so a text is split at its matches: a match begins after the gaps and
matches before it.  All regular expressions use possessive groups, which don't recurse, and begin only where a run begins, so
that a run of any length is read once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
#: Tag, kind, strict, cheap precondition, pattern.
EMAIL = rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EMAIL_LOOSE = rf"(?i)(?<![{LOCAL}])[{LOCAL}]++[ ]?[\[({{ ](?:at|@)[\])}} ][ ]?[a-z0-9-]++(?:[ ]?(?:[\[({{ ]dot[\])}} ]|\.)[ ]?[a-z0-9-]++)++"
IP_LOOSE = r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Fa-f:])"
CARD_LOOSE = r"(?<![0-9+(-])(?<![0-9]\x20)[0-9]{4}[\x20-][0-9]{4,6}[\x20-][0-9]{4,5}(?![0-9-])"
PHONE_LOOSE = r"(?<![0-9+)(-])(?:\([0-9]{2,4}\)[\x20-]?|[0-9]{2,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
#: Words before a span that speak for it and against it.
FOR = {
    "email": "mail|e-mail|email|contact|kontakt|contacto|courriel|correo|write to|schreib",
    "ip": "ip|host|server|address|adresse|client|login|from",
    "card": "card|visa|master|amex|credit|kredit|carte|tarjeta|payment|iban",
    "phone": "phone|tel|call|mobile|fax|telefon|téléphone|teléfono|whatsapp|sms|cell",
}
AGAINST = "isbn|issn|version|release|v|doi|rfc|section|page|order|serial|invoice|sku|part no|figure"
LABELERS = ["form", "check", "gazetteer", "context", "around"]
ITERATIONS = 60
ACCEPT = 0.5
CONTEXT = 24


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits is a multiple of ten."""
    n = F.length(digits)

    def part(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), part) % 10 == 0).otherwise(F.lit(False))


def found(text: Column, tag: int, pattern: str, when: Column) -> Column:
    """For each match, and for what follows the last, an entry: tag, number, length, head and tail of the gap before, match."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    entry = F.zip_with(gaps, matches, lambda g, m: F.struct(F.lit(tag).alias("tag"), F.length(g).alias("gap"), F.substring(g, 1, CONTEXT).alias("head"), F.right(g, F.lit(CONTEXT)).alias("tail"), m.alias("match")))
    entries = F.transform(entry, lambda x, i: F.struct(x.tag.alias("tag"), i.alias("i"), x.gap.alias("gap"), x["head"].alias("head"), x.tail.alias("tail"), x.match.alias("match")))
    return F.when(when, entries).otherwise(F.array().cast("array<struct<tag:int,i:int,gap:int,head:string,tail:string,match:string>>"))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each match with its place and surroundings; a document without any has one row without tag."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text.alias("t"))
    t = F.col("t")
    at, digit = t.contains("@"), t.rlike("[0-9]")
    parts = [
        found(t, 0, EMAIL, at),
        found(t, 1, IP, digit & t.rlike(r"[0-9]\.[0-9]++\.[0-9]")),
        found(t, 2, CARD, digit & t.rlike(r"(?:[0-9][\x20-]?){16}")),
        found(t, 3, PHONE, t.contains("+") & t.rlike(r"\+[0-9]")),
        found(t, 4, EMAIL_LOOSE, (t.contains("dot") | t.contains("DOT") | at) & t.rlike(rf"(?i)[\[({{ ](?:at|@)[\])}} ][ ]?[a-z0-9-]++[ ]?(?:[\[({{ ]dot|\.[a-z])")),
        found(t, 5, IP_LOOSE, t.contains(":") & t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
        found(t, 6, CARD_LOOSE, digit & t.rlike(r"[0-9]{4}[\x20-][0-9]{4}")),
        found(t, 7, PHONE_LOOSE, digit & t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
    ]
    rows = rows.select("id", "row", F.explode_outer(F.concat(*parts)).alias("x")).select("id", "row", "x.*")
    order = W.partitionBy("row", "tag").orderBy("i")
    size = F.coalesce(F.length("match"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long")
    rows = rows.withColumn("after", F.lead("head").over(order)).withColumn("stop", end).withColumn("start", end - size)
    return rows.where("match is not null or tag is null or i = 0").drop("i", "gap", "head")


def valid_candidates(cands: DataFrame) -> DataFrame:
    """The matches that pass their kind's check, or may pass as loose ones, but for loose ones that overlap strict ones of their kind.

    `digits` are a match's digits; `plain` is an address with its signs for at and dot written plainly.
    """
    m, tag, digits = F.col("match"), F.col("tag"), F.col("digits")
    n = F.length(digits)

    def small(x: Column) -> Column:
        short = F.regexp_replace(x, "^0+", "")
        return (F.length(short) <= 3) & (F.coalesce(short.substr(1, 3).try_cast("int"), F.lit(0)) <= 255)

    octets = F.forall(F.split(m, r"\."), small)
    card, phone = n.between(16, 19) & luhn(digits), n.between(8, 15)
    valid = F.when(tag == 1, octets).when(tag == 2, card).when(tag == 3, phone).when(tag == 6, n.between(13, 15) & luhn(digits)).otherwise(True)
    at = F.regexp_replace(F.lower(m), r"[ ]?[\[({ ]at[\])} ][ ]?", "@")
    plain = F.regexp_replace(at, r"[ ]?[\[({ ]dot[\])} ][ ]?", ".")
    rows = cands.where("match is not null").withColumn("digits", F.regexp_replace("match", "[^0-9]", "")).where(valid)
    rows = rows.withColumn("kind", tag % 4).withColumn("strict", tag < 4).withColumn("plain", plain)
    place = W.partitionBy("row", "kind").orderBy("start", "stop", "tag")
    ended = F.max(F.when(F.col("strict"), F.col("stop"))).over(place.rowsBetween(W.unboundedPreceding, -1))
    begins = F.min(F.when(F.col("strict"), F.col("start"))).over(place.rowsBetween(1, W.unboundedFollowing))
    rows = rows.withColumn("ended", ended).withColumn("begins", begins)
    inside = (F.coalesce("ended", F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("begins") < F.col("stop"), F.lit(False)))
    return rows.where(F.col("strict") | ~inside).drop("ended", "begins")


def entry_of(kind: Column) -> Column:
    """What a gazetteer has of a candidate: an address's domain, the first half of an ip, a card's issuer, an area code."""
    digits, groups = F.col("digits"), F.split("match", "[.:]")
    domain = F.regexp_extract("plain", r"([a-z0-9-]+\.[a-z0-9-]+)$", 1)
    return (
        F.when(kind == 0, domain)
        .when(kind == 1, F.concat_ws(".", groups[0], F.get(groups, F.lit(1))))
        .when(kind == 2, digits.substr(1, 4))
        .otherwise(F.when(F.length(digits) >= 10, F.substring(digits, F.length(digits) - 9, F.lit(3))))
    )


def labelled(cands: DataFrame) -> DataFrame:
    """The valid candidates with five votes of 1, 0 or -1."""
    rows = valid_candidates(cands).withColumn("entry", entry_of(F.col("kind")))
    named = rows.where("strict and entry <> ''").groupBy("kind", "entry").agg((F.min("row") != F.max("row")).alias("known")).where("known")
    rows = rows.join(named, ["kind", "entry"], "left")
    m, kind, digits, plain = (F.col(c) for c in ("match", "kind", "digits", "plain"))
    n, colons = F.length("digits"), F.col("match").contains(":")
    left, after = F.lower(F.coalesce("tail", F.lit(""))), F.coalesce("after", F.lit(""))

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    def by_kind(*votes: Column) -> Column:
        return F.when(kind == 0, votes[0]).when(kind == 1, votes[1]).when(kind == 2, votes[2]).otherwise(votes[3])

    address = plain.rlike(r"^[a-z0-9._%+-]{1,64}@(?:[a-z0-9-]{1,63}\.){1,9}[a-z]{2,24}$")
    octets = m.rlike(r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$")
    grouped = m.rlike(r"^[0-9]+$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$|^[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}$")
    form = by_kind(
        vote(address, ~address),
        F.when(colons, vote(m.rlike(r"[A-Fa-f]|::"), ~m.rlike(r"[A-Fa-f]|::|[0-9]{3}"))).otherwise(vote(octets, ~octets)),
        vote(grouped, ~grouped),
        vote(n.between(10, 13), (n < 9) | (n > 14)),
    )
    first = F.coalesce(F.split(m, r"\.")[0].try_cast("int"), F.lit(0))
    dull = digits.rlike(r"^([0-9])\1*$") | digits.rlike("00000|12345|98765")
    check = by_kind(
        vote(plain.rlike("^[^@]*[a-z][^@]*@"), ~plain.rlike("^[^@]*[a-z][^@]*@")),
        F.when(colons, F.lit(0)).otherwise(vote(first.between(1, 223), ~first.between(1, 223))),
        vote(digits.rlike("^[3-6]"), ~digits.rlike("^[2-6]")),
        vote(~dull & (n >= 10), dull),
    )
    gazetteer = F.when(F.col("known"), 1).otherwise(0)
    speaks = by_kind(*(left.rlike(rf"(?<![\p{{L}}])(?:{FOR[name]})(?![\p{{L}}])") for name in KINDS))
    context = vote(speaks, left.rlike(rf"(?<![\p{{L}}])(?:{AGAINST})[^\p{{L}}]{{0,3}}$"))
    glued, joined = left.rlike(r"[\p{L}\p{N}_/=-]$"), after.rlike(r"^[\p{L}\p{N}_/=-]")
    around = vote(~glued & ~joined, glued | joined)
    votes = [form, check, gazetteer, context, around]
    shape = F.least(F.floor(n / 4), F.lit(4)).cast("int")
    return rows.select("id", "row", "kind", "strict", "start", "stop", *(v.cast("int").alias(x) for v, x in zip(votes, LABELERS)), shape.alias("shape"))


def likelihoods(patterns: list[tuple[tuple[int, ...], float]], iterations: int = ITERATIONS) -> list[float]:
    """P(personal data) of each vote pattern, by expectation-maximisation from the majority vote.

    Labelers are taken as independent given the truth; each has a table of P(vote | truth), smoothed by one vote of each.
    """
    if not patterns:
        return []
    post = [1 / (1 + math.exp(-2.0 * sum(v))) for v, _ in patterns]
    k = len(patterns[0][0])
    for _ in range(iterations):
        total = sum(c for _, c in patterns)
        prior = (sum(c * p for (_, c), p in zip(patterns, post)) + 1) / (total + 2)
        table = {(j, x, y): 1.0 for j in range(k) for x in (-1, 0, 1) for y in (0, 1)}
        for (v, c), p in zip(patterns, post):
            for j, x in enumerate(v):
                table[j, x, 1] += c * p
                table[j, x, 0] += c * (1 - p)
        norm = {(j, y): sum(table[j, x, y] for x in (-1, 0, 1)) for j in range(k) for y in (0, 1)}
        new = []
        for v, _ in patterns:
            a, b = math.log(prior), math.log(1 - prior)
            for j, x in enumerate(v):
                a += math.log(table[j, x, 1] / norm[j, 1])
                b += math.log(table[j, x, 0] / norm[j, 0])
            new.append(1 / (1 + math.exp(min(700.0, b - a))))
        done = max(abs(x - y) for x, y in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    return post


def features(kind: int, votes: tuple[int, ...], shape: int) -> list[str]:
    return ["bias", f"kind={kind}", f"shape={kind}:{shape}", *(f"{x}={v}" for x, v in zip(LABELERS, votes))]


def fit_logistic(rows: list[tuple[list[str], float, float]], steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> dict[str, float]:
    """Weights of a logistic model from (features, target between 0 and 1, count)."""
    w: dict[str, float] = {}
    total = sum(c for _, _, c in rows) or 1.0
    for _ in range(steps):
        g: dict[str, float] = {}
        for f, y, c in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.get(x, 0.0) for x in f)))))
            for x in f:
                g[x] = g.get(x, 0.0) + c * (p - y)
        for x, d in g.items():
            w[x] = w.get(x, 0.0) - rate * (d / total + ridge * w.get(x, 0.0))
    return w


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of personal data of each row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and base_sha256 are of the strict spans; spans has these and the added ones, which overlap none of their kind.
    Places are code points, ends exclusive.  A null text is empty; repeated rows give repeated rows, and a null id is kept.
    Without any candidate nothing is learned and nothing added; a likelihood of just `ACCEPT` adds.  A text of any length is
    searched whole; an empty table gives an empty result.  Other columns aren't read, whatever their names.
    """
    cands = materialise(candidates(docs, id_col, text_col), "pii-candidates")
    spans = materialise(labelled(cands), "pii-votes")
    keys = ["kind", *LABELERS, "shape"]
    # as many rows as there are patterns of votes and shapes at most, whatever the corpus
    patterns = [(tuple(r[k] for k in keys), float(r["count"])) for r in spans.groupBy(*keys).count().collect()]
    patterns.sort()
    rows = []
    for kind in range(len(KINDS)):
        of = [(p, c) for p, c in patterns if p[0] == kind]
        rows += [(features(p[0], p[1:-1], p[-1]), y, c) for (p, c), y in zip(of, likelihoods([(p[1:-1], c) for p, c in of]))]
    w = fit_logistic(rows)
    z = F.lit(w.get("bias", 0.0))
    for name, weight in sorted(w.items()):
        left, _, value = name.partition("=")
        if left == "shape":
            kind, shape = value.split(":")
            z = z + F.when((F.col("kind") == int(kind)) & (F.col("shape") == int(shape)), weight).otherwise(0.0)
        elif value:
            z = z + F.when(F.col(left) == int(value), weight).otherwise(0.0)
    scored = spans.where(F.col("strict") | (1 / (1 + F.exp(-z)) >= ACCEPT)).select("row", F.struct("kind", "start", "stop", "strict").alias("s"))
    by_row = cands.groupBy("row").agg(F.first("id").alias("id"))
    lists = scored.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("all"))
    out = by_row.join(lists, "row", "left").withColumn("all", F.coalesce("all", F.array().cast(lists.schema["all"].dataType)))
    out = out.withColumn("base", F.filter("all", lambda s: s.strict))

    def joined(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == k)).cast("long")

    counts = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select(F.col("id").alias(id_col), *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"), (F.size("all") - F.size("base")).cast("long").alias("n_added"))
