"""Personal data by weak supervision, with DataFrame functions only.

Exact rules give the base spans. Wider patterns propose further candidates (written-out addresses, other separators, numbers
without a plus). Labelers vote on every candidate: rules on its form, gazetteers of top-level domains, issuers, calling codes and
special networks, and the words and signs beside it. Expectation-maximisation over the counts of equal ballots, a table of
bounded size, estimates how reliable each labeler is for each kind. The likelihoods that follow train a classifier of spans (naive
Bayes over hashed features of form and context, and the ballot); candidates that it takes for personal data and that meet
no base span are added.

Places come from the pieces between matches: a match starts where the lengths of all pieces and matches before it end.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulage.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: The base rules. Where a match cannot start inside a run of signs, it is only tried at the run's start or where the
#: last match ended; parts that nothing can follow are possessive. Both leave the matches as they are.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT, _DOT = r"(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)", r"(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)"
#: What else is worth a vote; lengths are bounded, so that a text is scanned in linear time.
WIDE = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{0,8}}{_DOT}[A-Za-z]{{2,63}}(?![A-Za-z0-9-])",
    r"(?<![A-Za-z0-9])(?:[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\)|\x20dot\x20)[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7})(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[0-9](?:[\x20./_-]{0,3}[0-9]){12,18}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9+])(?<![0-9][./-])(?:(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}|(?:00\x20?|\+)?[0-9(](?:[\x20().\-/]{0,3}[0-9]){6,14}(?![.\-/]?[0-9]))(?![A-Za-z0-9])",
)
#: Gazetteers (fixed values): top-level domains, issuers' first digits, calling codes, networks that are nobody's address.
TLDS = "com org net edu gov mil int info biz io dev app me co uk de fr es it nl be ch at se no fi dk pl cz pt ru ua tr gr ie eu us ca mx br ar cl au nz jp cn kr in za il sg hk test example"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35|30[0-5]|3[689]|62)"
CALLING = r"^(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-9][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[7-9][0-9]|8[05][0-9]|9[679][0-9])"
NOBODY = r"^(?:0|127|255|22[4-9]|23[0-9])\."
#: Words before a span that speak for a kind (fixed values); and words that speak against any.
FOR = (r"mail|contact|write|reach|from|cc|address", r"\bip\b|host|server|login|addr|client|connect", r"card|visa|master|amex|credit|debit|pay|account|\bcc\b", r"tel|phone|call|fax|mobile|cell|contact|\bsms\b|reach")
AGAINST = r"token|sha|hash|version|\bv\b|uuid|isbn|issn|order|serial|build|commit|revision|invoice|part|\bid\b|number of|[=#]\s*[\"']?$"
LABELERS, BALLOTS = ("rule", "form", "gazetteer", "words", "edges", "against"), 3
FAMILIES, BUCKETS = ("shape", "edges", "before", "after", "size", "ballot"), 256
CONTEXT, ROUNDS = 40, 50


def _matches(text: Column, pattern: str, kind: int, base: bool) -> Column:
    """Of a pattern's matches: kind, base, at (number of the match), gap (length of the piece before), match, before, after."""
    bound = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")))

    def one(s: Column) -> Column:
        return F.transform(s.m, lambda m, i: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("at"), F.length(F.get(s.p, i)).cast("long").alias("gap"), m.alias("match"), F.right(F.get(s.p, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(s.p, i + 1), F.lit(CONTEXT)).alias("after")))

    return F.get(F.transform(bound, one), 0)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of at most 19 digits passes the check of card numbers."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"


def _by_kind(*of: Column) -> Column:
    return reduce(lambda w, k: w.when(F.col("kind") == k, of[k]), range(1, 4), F.when(F.col("kind") == 0, of[0]))


def _valid() -> Column:
    """What the base rules ask of a match beside its pattern."""
    n = F.length(_digits(F.col("match")))
    card = F.when(n.between(16, 19), luhn(_digits(F.col("match")))).otherwise(F.lit(False))
    return _by_kind(F.lit(True), F.col("match").rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), card, n.between(8, 15))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and (row, kind, start, end, base, match, before, after) of the matches that have a
    form fit for their kind; base: the base rules give it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.concat(*[_matches(F.col("text"), p, k, base) for base, ps in ((True, BASE), (False, WIDE)) for k, p in enumerate(ps)])
    rows = cut(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")).select("row", "doc_id", found.alias("found")))
    each = rows.select("row", F.explode("found").alias("f")).select("row", "f.*").withColumn("size", F.length("match").cast("long"))
    w = Window.partitionBy("row", "kind", "base").orderBy("at")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(w)).withColumn("start", F.col("end") - F.col("size"))
    n = F.length(_digits(F.col("match")))
    told = placed.select("row", "kind", "start", "end", (F.col("base") & _valid()).alias("base"), "match", "before", "after")
    likely = F.col("base") | _by_kind(F.lit(True), ~F.col("match").rlike("[0-9]{5}|[0-9]{4}[.]"), n.between(13, 19), n.between(7, 15))
    once = told.where(likely).groupBy("row", "kind", "start", "end").agg(F.max("base").alias("base"), F.max(F.struct("match", "before", "after")).alias("c"))
    return rows.select("row", "doc_id"), once.select("row", "kind", "start", "end", "base", "c.*")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.coalesce(no, F.lit(False)), -1).otherwise(0)


def ballots(found: DataFrame) -> DataFrame:
    """found with a vote of each labeler: 1 for personal data, -1 against, 0 for neither."""
    match, digits, before = F.col("match"), _digits(F.col("match")), F.lower("before")
    n = F.length(digits)
    domain = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1))
    parts = F.regexp_replace(match, r"\[\.\]|\(\.\)|\x20dot\x20", ".")
    octets = parts.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    passes = F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False))
    sure = F.col("base") | _by_kind(match.rlike("@.*[.]"), octets | match.contains(":"), passes, F.lit(False))
    rule = _vote(sure, _by_kind(F.lit(False), ~octets & ~match.contains(":"), ~passes, ~n.between(8, 15)))
    spread = match.rlike(r"^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$") | match.rlike("^[0-9]+$")
    grouped = match.rlike(r"^(?:\+|00)") | match.rlike(r"^\(?[0-9]{2,5}\)?[ .\-/][0-9]{2,4}[ .\-/]?[0-9]{2,}$")
    form = _by_kind(_vote(match.rlike(r"^[A-Za-z0-9][^@]*[A-Za-z0-9]@"), match.rlike(r"\.\.|^\.|--")), _vote(match.rlike(r"^[1-9][0-9]{0,2}\.[0-9.]+$"), match.rlike(r"^0|\.0[0-9]")), _vote(spread, match.rlike("[./_]")), _vote(grouped, match.rlike(r"^[0-9]+$") | match.rlike(r"^\(?[0-9]{1,2}[ ./-]")))
    known = domain.isin(TLDS.split())
    calls = match.startswith("+") | match.startswith("00")
    gazetteer = _by_kind(_vote(known, ~known), _vote(F.lit(False), parts.rlike(NOBODY)), _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS)), _vote(calls & F.regexp_replace(digits, "^00", "").rlike(CALLING), calls))
    words = _vote(reduce(lambda w, k: w.when(F.col("kind") == k, before.rlike(FOR[k])), range(1, 4), F.when(F.col("kind") == 0, before.rlike(FOR[0]))), F.lit(False))
    inside = F.col("before").rlike(r"[A-Za-z0-9_]$") | F.col("after").rlike("^[A-Za-z0-9_]")
    return found.withColumns({"v_rule": rule, "v_form": form, "v_gazetteer": gazetteer, "v_words": words, "v_edges": _vote(~inside, inside), "v_against": _vote(F.lit(False), before.rlike(AGAINST))})


def reliabilities(counts: list[tuple]) -> list[dict]:
    """For each kind the log odds of personal data and, for each labeler, what its vote -1, 0 or 1 adds to them.

    counts: (kind, votes, n). Expectation-maximisation for two classes and independent labelers, from their majority; labelers
    start out as mostly right with the weight of ten candidates, so that few candidates do not decide all. Where a kind has
    no candidate these first beliefs stand.
    """
    first = {1: {-1: 1.0, 0: 4.0, 1: 5.0}, 0: {-1: 5.0, 0: 4.0, 1: 1.0}}
    out = []
    for kind in range(len(KINDS)):
        own = sorted((votes, n) for k, votes, n in counts if k == kind)
        likely = [0.9 if sum(v) > 0 else 0.1 if sum(v) < 0 else 0.5 for v, _ in own]
        for _ in range(ROUNDS):
            share = {y: 1.0 + sum(n * (p if y else 1 - p) for (_, n), p in zip(own, likely)) for y in (0, 1)}
            odds = math.log(share[1] / share[0])
            told = []
            for k in range(len(LABELERS)):
                seen = {y: {v: first[y][v] + sum(n * (p if y else 1 - p) for (votes, n), p in zip(own, likely) if votes[k] == v) for v in (-1, 0, 1)} for y in (0, 1)}
                told.append({v: math.log(seen[1][v] / sum(seen[1].values()) * sum(seen[0].values()) / seen[0][v]) for v in (-1, 0, 1)})
            likely = [1 / (1 + math.exp(-max(-500.0, min(500.0, odds + sum(told[k][x] for k, x in enumerate(votes)))))) for votes, _ in own]
        out.append({"odds": odds, "labelers": told})
    return out


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))))


def classify(voted: DataFrame) -> DataFrame:
    """voted with p, the classifier's probability of personal data.

    The labelers' likelihoods are its labels. Features are hashed into BUCKETS for each kind and family, so its weights
    are at most 4 * 6 * 256 rows, whatever the corpus, and are broadcast; only the counts of ballots (4 * 3**6 rows at
    most) pass the driver.
    """
    votes = [f"v_{name}" for name in LABELERS]
    counts = [(r["kind"], tuple(r[v] for v in votes), r["n"]) for r in voted.groupBy("kind", *votes).agg(F.count("*").alias("n")).collect()]
    rates = reliabilities(counts)
    pick = lambda values, at: F.get(F.array(*[F.lit(float(x)) for x in values]), at)
    log_odds = pick([r["odds"] for r in rates], F.col("kind"))
    for k, name in enumerate(votes):
        log_odds = log_odds + pick([r["labelers"][k][v] for r in rates for v in (-1, 0, 1)], F.col("kind") * BALLOTS + F.col(name) + 1)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("match", "[0-9]+", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    sign = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), r"\p{L}", "a")
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    features = [shape, F.concat(sign(F.right("before", F.lit(1))), F.lit("|"), sign(F.left("after", F.lit(1)))), word("before", r"(\p{L}+)[^\p{L}]*$"), word("after", r"^[^\p{L}]*(\p{L}+)"), F.length(_digits(F.col("match"))).cast("string"), F.concat_ws(",", *votes)]
    keys = F.array(*[F.pmod(F.xxhash64(F.lit(name), f), F.lit(BUCKETS)) + k * BUCKETS for k, (name, f) in enumerate(zip(FAMILIES, features))])
    known = cut(voted.withColumn("likely", _sigmoid(log_odds)).withColumn("keys", keys).drop(*votes))
    each = known.select("row", "kind", "start", "end", "likely", F.explode("keys").alias("key"))
    sums = each.groupBy("kind", "key").agg(F.sum("likely").alias("yes"), F.sum(1 - F.col("likely")).alias("no"))
    whole = known.groupBy("kind").agg(F.sum("likely").alias("all_yes"), F.sum(1 - F.col("likely")).alias("all_no"))
    weight = F.log((F.col("yes") + 1) / (F.col("all_yes") + BUCKETS)) - F.log((F.col("no") + 1) / (F.col("all_no") + BUCKETS))
    weights = sums.join(F.broadcast(whole), "kind").select("kind", "key", weight.alias("weight"), F.log((F.col("all_yes") + 1) / (F.col("all_no") + 1)).alias("prior"))
    scored = each.join(F.broadcast(weights), ["kind", "key"]).groupBy("row", "kind", "start", "end").agg((F.sum("weight") + F.first("prior")).alias("score"))
    return known.drop("keys", "likely").join(scored, ["row", "kind", "start", "end"]).withColumn("p", _sigmoid(F.col("score"))).drop("score")


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and (row, kind, start, end, base, p) of its spans: code points, end exclusive.

    kind: email, ip, card or phone. Base spans are those of the base rules, per kind. Others are added where the classifier
    gives one half or more, if they meet no base span and no earlier added one. Null and empty texts have none; rows that
    repeat a document are reported each; other columns are left out; an empty table gives none.
    """
    rows, found = candidates(docs)
    scored = cut(classify(ballots(cut(found))).where("base or p >= 0.5").select("row", "kind", "start", "end", "base", "p"))
    own = F.col("base")
    w = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("start"), "end", F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    clear = (F.coalesce(F.max("end").over(w), F.lit(0)) <= F.col("start")) & (F.coalesce(F.min(F.when(own, F.col("start"))).over(back), F.col("end")) >= F.col("end"))
    kept = scored.withColumn("clear", clear).where(own | F.col("clear"))
    name = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return rows, kept.select("row", name.alias("kind"), "start", "end", "base", "p")


def find(docs: DataFrame) -> DataFrame:
    """find_spans as one row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 and spans, both
    over `kind:start:end`, by kind as listed, then start, joined by commas."""
    rows, spans = find_spans(docs)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = F.struct(place.alias("k"), "start", "end", "kind", "base")
    met = spans.groupBy("row").agg(F.array_sort(F.collect_list(told)).alias("s"), *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS])
    line = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    none = F.lit("")
    both = rows.join(met, "row", "left")
    return both.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS], F.sha2(F.coalesce(line(F.filter("s", lambda x: x.base)), none), 256).alias("base_sha256"), F.coalesce(line(F.col("s")), none).alias("spans"))
