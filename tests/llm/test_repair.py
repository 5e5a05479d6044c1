import hashlib
import itertools
import random
import re
from collections import defaultdict
from zlib import crc32

from haulage.llm import queries, repair

SHAPE = re.compile(r"(s?(ua)+)?")


def audit_of(turns):
    """Counts, cost, audit and repaired turns by the definition: every choice of edits is tried, inserts up to two a place."""
    seen, kinds, last = set(), [], None
    illegal = 0
    for _, role, text in turns:
        kind = "blank" if not text.strip(" \t\n\v\f\r") else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\v\f\r")[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        illegal += last is not None and last + role[:1] not in ("su", "ua", "au")
        last = role[:1]
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    # partial repairs by the state of the pattern, all audits of the least cost kept: no order of audits is used here
    ways = {"": {(0, "", ())}}

    def step(ways, options):
        out = defaultdict(set)
        for shape, have in ways.items():
            for cost, audit, done in have:
                for c, e, new in options:
                    now = shape + "".join(r[:1] or "?" for r, _ in new)
                    if re.fullmatch(r"s?(ua)*u?", now):
                        out[_short(now)].add((cost + c, audit + e, done + new))
        return {k: {w for w in v if w[0] == min(x[0] for x in v)} for k, v in out.items()}

    def _short(shape):
        return shape if len(shape) < 2 else "ua" if shape[-1] == "a" else "u"

    more = [(3 * len(i), "I" * len(i), tuple((r, "") for r in i)) for i in inserts]
    for (_, role, text), kind in zip(turns, kinds):
        extra = 3 * (kind == "truncated")
        options = [(4, "D", ())]
        if kind not in ("blank", "duplicate"):
            options += [(extra, "K", ((role, text),))] + [(3 + extra, "R", ((r, text),)) for r in ("user", "assistant")]
        ways = step(step(ways, more), options)
    ways = step(ways, more)
    best = min(w for k, v in ways.items() if k in ("", "ua") for w in v)
    times = [t for t, _, _ in turns if t is not None]
    gaps = max(times) - min(times) + 1 - len(set(times)) if times else 0
    text = "\n".join(f"{r}:{t}" for r, t in best[2])
    return (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, best[0], best[1], hashlib.sha256(text.encode()).hexdigest())


def brute(rows, spoil=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv]
        role, text = (" " if x is None else x for x in (role, text))
        fault = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if spoil else 9
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            convs[conv] += [(turn, "user" if fault == 4 else role, text)] * (1 + (fault == 3))
    return {c: audit_of(sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, t in convs.items()}


def got(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[c] for c in names) for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def some_rows(rng, n):
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "Why?", "so", " ", "", None, "No!  ", "End.\n", f"t{k}.", f"t{k}."])
            rows.append((c, rng.choice([k, k, k, k + 5, None]), role, text))
    return rows


def test_the_table_of_steps_and_solve_by_all_edits():
    rng = random.Random(3)
    for _ in range(200):
        rows = bytes(rng.randrange(16) for _ in range(rng.randint(1, 5)))
        for x, y in itertools.product(repair.STATES, repair.STATES):
            ways = {(0, "", x)}
            for r in rows:
                ways = {(c + d, a + e, z) for c, a, s in ways for z in repair.STATES for d, e in [repair.steps(r)[s][z]] if d < repair.NEVER}
            ends = sorted((c, a) for c, a, s in ways if s == y)
            if ends:
                assert "".join(repair.solve(rows, x, y)) == ends[0][1]


def test_query_against_brute_force(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_repair(spark, sf001)) == brute(rows)


def test_random_conversations_in_short_segments(spark):
    rows = some_rows(random.Random(5), 300)
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", seg int")
    want, plain = brute(rows), brute(rows, False)
    assert got(repair.audit_conversations(repair.damage(df), df)) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(repair.audit_conversations(df, segment=3)) == plain
        assert repair.repair_conversations(df, 3)[1].groupBy("conv_id").count().where("count > 2").count() > 50
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, 0, "user", "a."), (1, 0, "user", "a."), (1, 2**62, "user", "a."), (2, None, "", "x."), (3, 5, "ünder", "y."), (-7, 1, "system", "s.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(repair.audit_conversations(df)) == brute(rows, False)
    assert repair.audit_conversations(df.where("false")).count() == 0
    gone = got(repair.audit_conversations(df.where("false"), df))
    assert gone[1] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and len(gone) == 5


def test_a_long_conversation(spark):
    many = [(1, k // 3, ["user", "assistant", "user"][k % 3], "w" * (k % 7) + str(k % 42_000) + "..x"[k % 3]) for k in range(60_000)]
    df = spark.createDataFrame(many, SCHEMA)
    counts, pieces = repair.repair_conversations(df)
    told = pieces.orderBy("seg").collect()
    shape = "".join(t.role[0] for p in told for t in p.turns)
    assert len(told) > 10 and re.fullmatch(r"(s?(ua)+)?", shape) and counts.first().duplicate == got(repair.audit_conversations(df))[1][2] == 18_000
