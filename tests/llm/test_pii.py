import hashlib
import re
import time

from haulage.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def passes(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_of(text):
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(digits(m)) <= 19 and passes(digits(m)),
        "phone": lambda m: 8 <= len(digits(m)) <= 15,
    }
    return [(kind, m.start(), m.end()) for kind, p in zip(good, (EMAIL, IP, CARD, PHONE)) for m in re.finditer(p, text or "") if good[kind](m.group())]


def want(text):
    spans = base_of(text)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return (*[sum(k == kind for k, _, _ in spans) for kind in pii.KINDS], hashlib.sha256(joined.encode()).hexdigest()), set(joined.split(",")) - {""}


def check(df, docs):
    got = sorted((str(r.doc_id), (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256), r.spans) for r in df.collect())
    wanted = sorted((str(d), *want(t)) for d, t in docs)
    assert [g[:2] for g in got] == [w[:2] for w in wanted]
    for (_, _, spans), (_, _, own) in zip(got, wanted):
        assert own <= set(spans.split(","))
    return {d: s for d, _, s in got}


def test_query_against_python_rules(spark, sf001):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").collect()]
    spans = check(queries.op11_pii(spark, sf001), docs)
    clean = [d for d, t in docs if t and not re.search(r"[0-9]{4}|[0-9]\.[0-9]|@|\+", t)]
    assert len(clean) > 300 and not any(spans[str(d)] for d in clean)


ODD = [
    "a@b.c_d@e.f..g@h.i", "@x.y a@b a@b. a@b.c.", "éa@b.cé+1 (234) 555-6789é", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "4111 1111 1111 1111-4111111111111111",
    "4111111111111111", "4111-1111-1111-1112", "+1 234 567 8", "+12345678901234567", "+1((((((", "+1 23-45)67 89)+44 20 7946 0958", "𝒳 x@y.zz 𝒳 10.0.0.1", "", None, "no data at all", "\x01a@b.c\x02", "1" * 40, "a" * 100 + "@b.co",
]


def test_odd_texts(spark):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a@b.cc", "x"), (1, ODD[1], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    check(pii.find(df), [r[:2] for r in rows])
    assert pii.find(df.where("false")).count() == 0


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "+1 " + "-" * 1_000_000, "x@y.zz " * 30_000, "9." * 500_000, "a." * 500_000 + "@"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert time.perf_counter() - began < 90
    assert got[4].n_email == 30_000 and got[4].spans.endswith(f"email:{29_999 * 7}:{29_999 * 7 + 6}")


def test_the_method_adds_what_the_rules_miss(spark):
    clear = [f"please write to user{k}.name@mail{k % 7}.example.com today or call +1 ({200 + k}) 555-0{100 + k} now, card 4111 1111 1111 1111 too" for k in range(100)]
    noise = [f'token = "{k:04d}1234567890123" and build 1.{k}.3 of order 12345678901{k:02d}' for k in range(100)]
    more = ["contact jane [at] mail (dot) example (dot) org soon", "mail me: bob at example dot com please", "phone: (415) 555-0199 at noon", "host 10[.]20[.]30[.]40 is down", "pay with card 4111.1111.1111.1111 now"]
    df = spark.createDataFrame(list(enumerate(clear + noise + more)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    more_than_base = [(t, spans[100 + k]) for k, t in enumerate(noise) if set(spans[100 + k].split(",")) - {""} != want(t)[1]]
    assert not more_than_base, more_than_base[:3]
    found = [spans[200 + k] for k in range(5)]
    assert [f.split(":")[0] for f in found] == ["email", "email", "phone", "ip", "card"], found
    assert more[0][slice(*map(int, found[0].split(":")[1:]))] == "jane [at] mail (dot) example (dot) org"


def test_reliabilities_find_the_unreliable_labeler():
    counts = [(0, (1, 1, 1, 1, 1, 0), 500), (0, (1, 1, 1, -1, 1, 0), 500), (0, (-1, -1, -1, 1, -1, -1), 500), (0, (-1, -1, -1, -1, -1, -1), 500)]
    told = pii.reliabilities(counts)[0]["labelers"]
    assert told[0][1] > 3 and told[0][-1] < -3 and abs(told[3][1]) < 0.2
    assert len(pii.reliabilities([])) == 4
