import hashlib
import random
import re
import time

import duckdb
import pytest

from haulage.llm import chat, html_extract, licenses, queries


def same(spark, name, sf_dir):
    df = queries.queries()[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(queries.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = rel.project(", ".join(df.columns)).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_chat_and_licenses_against_sql(spark, sf001):
    same(spark, "op4_chat", sf001)
    same(spark, "op5_licenses", sf001)


def test_chat_reads_back(spark):
    odd = ["<|end|>", "<|next|>\\", "\\", "\\\\<|role:user|>", "<", "", None, "|>", "\n", "<\\|", "x" * 100_000, "<|", "|"]
    rows = [(1, i, ["user", "assistant", "assistant"][i % 3], t, 0) for i, t in enumerate(odd)]
    rows += [(2, 0, None, "a", 0), (2, 0, None, "a", 0), (None, 0, "a|>b\\|", "t", 0), (3, 1, "", "z", 0), (3, None, "<|end|>", "y", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert back[1] == [(["user", "assistant", "assistant"][i % 3], t or "") for i, t in enumerate(odd)]
    assert back[2] == [("", "a"), ("", "a")] and back[None] == [("a|>b\\|", "t")] and back[3] == [("<|end|>", "y"), ("", "z")]
    assert chat.chat_digests(df.where("false")).count() == 0


def test_chat_merges_and_masks(spark):
    rows = [(1, 0, "user", "q <|end|>"), (1, 1, "assistant", "a\\"), (1, 2, "assistant", "<|role:user|>"), (1, 3, "user", "q"), (1, 4, "assistant", "b"), (2, 0, "user", "q")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    text = back[1].formatted
    assert text == r"<|role:user|>q <\|end|><|end|><|role:assistant|>a\\<|next|><\|role:user|><|end|><|role:user|>q<|end|><|role:assistant|>b<|end|>"
    assert [text[s.start : s.end] for s in back[1].loss_spans] == ["a\\\\", "<\\|role:user|>", "b"] and back[2].loss_spans == []


def test_licenses_odd_rows(spark):
    text = "Intro.\nAll rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted; x"
    df = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, "", 1), (3, "Released under the MIT License.", 1), (None, "LICENSED UNDER CC-BY 4.0", 1)], "doc_id long, text string, licenses int")
    got = sorted((str(r.doc_id), r.sentence_ids, r.licenses) for r in licenses.scan(df).collect())
    assert got == [("1", "RESERVED,BSD-GRANT", "BSD,BSD-reserved,all-rights-reserved"), ("2", "", ""), ("3", "", ""), ("3", "MIT-NAME", "MIT"), ("None", "CC-BY-4-NAME", "CC-BY-4.0")]


def test_html_articles(spark, sf001):
    pages = spark.read.parquet(f"{sf001}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for p in pages.collect():
        article = re.search(r"(?s)<article>(.*?)(</article>|$)", p.html)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        want = [" ".join(__import__("html").unescape(re.sub("<[^>]*>", " " if "br" in b else "", b)).split()) for b in blocks]
        assert got[p.page_id].text == "\n".join(b for b in want if b)


def test_html_shapes():
    page = """<html><head><title>T</title><style>x</style></head><body><header><h1>Site</h1></header>
    <div id="menu"><ul><li>Home</li><li>About</li></ul></div><div class="content"><h1>Head &amp; line</h1><p>First <b>long</b> passage, %s.</p>
    <p>Short.</p><div class="advert">Buy now %s</div><form><p>Enter your name %s</p></form><p>Last passage&nbsp;here, %s.</p></div>
    <div class="comments"><p>I disagree %s</p></div><div class="sidebar"><a href="x">More</a></div><footer>&copy; us</footer></body></html>"""
    fill = "with many words that go on for a while so that the block is long enough to count"
    want = f"Head & line\nFirst long passage, {fill}.\nShort.\nLast passage here, {fill}."
    assert html_extract.extract(page % ((fill,) * 5)) == want
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p>") == ""
    assert html_extract.extract("plain &lt;text&gt; only") == "plain <text> only"


def test_html_without_article_elements(spark, sf001):
    """Surge and dive points alone find what the article element marks."""
    pages = [r.html for r in spark.read.parquet(f"{sf001}/pages.parquet").collect()]
    bare = [p.replace("<article", "<div").replace("</article", "</div") for p in pages]
    assert [html_extract.extract(p) for p in bare] == [html_extract.extract(p) for p in pages]


def test_html_keeps_what_is_content():
    long = "<p>" + "words that go on for a while and make a paragraph of some length, " * 3 + "end.</p>"
    words = re.sub("<.*?>", "", long)
    page = f"""<nav><a>Home</a></nav><div class='post-header'><h1>Title</h1></div><div class='post'>{long}<section id='discussion'><h2>Discussion</h2>{long}</section>
    <section class='related-work'>{long}</section><p>foo<!-- x -->bar <math>x+y</math></p><div class='related'><ul><li><a>{"Other page " * 20}</a></li></ul></div></div>
    <div class='comments'>{long * 9}</div><aside>{long * 9}</aside>"""
    for p in (page, "<article>" + page + "</article>"):
        assert html_extract.extract(p) == f"Title\n{words}\nDiscussion\n{words}\n{words}\nfoobar x+y"
    assert html_extract.extract("a < b <b>c</b> & d <a title=it's x>k</a> it's") == "a < b c & d k it's"
    teasers = f"<div class=teasers><article><p>Short.</p></article><article><p>One more.</p></article></div><div>{long * 8}</div>"
    assert html_extract.extract(teasers) == "\n".join([words] * 8)


def test_html_time_is_linear():
    for part in ("<a ", "<a b='", '<a b=">"', "<div>x", "</p><p", "<!--", "<div></p>", "<script>", "<span class=ad>x"):
        began = time.process_time()
        html_extract.extract(part * (500_000 // len(part)))
        assert time.process_time() - began < 5


def test_html_odd_rows(spark):
    rows = [(1, "u", "<p>a", 1), (1, "u", "<p>a", 1), (None, None, None, 1), (2, "v", "<p>" + "long " * 400_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text[:9], r.n_chars) for r in html_extract.extract_pages(df).collect()), key=str)
    assert got == [(1, "u", "a", 1), (1, "u", "a", 1), (2, "v", "long long", 1_999_999), (None, None, "", 0)]
    assert html_extract.extract_pages(df.where("false")).count() == 0


def test_passages():
    assert html_extract.passages([5, 5, 100, 90, 5, 5, 5, 5, 5], window=2, surge=80) == [(1, 5)]
    assert html_extract.passages([], 3, 10) == []


LONG = "<p>" + "words that go on for a while and make a paragraph of some length, " * 3 + "end.</p>"


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "elementor-widget-container", "quick-reply-post", "menu-du-jour recipe", "post-banner-wrap", "layout-with-ads"])
def test_html_names_that_only_hint(name):
    words = re.sub("<.*?>", "", LONG)
    page = f"<body><h1>Head</h1><div class='{name}'>{LONG}{LONG}</div><div class='footer'>{LONG}</div></body>"
    assert html_extract.extract(page) == f"Head\n{words}\n{words}"
    assert html_extract.extract(f"<div class='{name}'><article>{LONG}</article></div>") == words
    short = f"<article>{LONG}<div class='share-wrap footer-container'><a href=x>Share</a></div></article>"
    assert html_extract.extract(short) == words


def test_html_furniture_that_holds_the_article():
    words = re.sub("<.*?>", "", LONG)
    assert html_extract.extract(f"<form id=f><div class=menu>{LONG}</div><article>{LONG}</article></form>") == words
    assert html_extract.extract(f"<div class='sidebar-left'><main>{LONG}</main></div>") == words
    comments = f"<article>{LONG}</article><div class='comment-list'><article class='comment'>{LONG * 5}</article></div>"
    assert html_extract.extract(comments) == words
    assert html_extract.extract(f"<article>{LONG}<aside class='pullquote'>He said so.</aside><aside>{LONG}</aside>{LONG}</article>") == f"{words}\nHe said so.\n{words}"


def test_html_articles_that_go_on():
    words = re.sub("<.*?>", "", LONG)
    assert html_extract.extract(f"<article>{LONG}</article><p>x</p><article>{LONG}</article><article><p>Teaser.</p></article>") == f"{words}\n{words}"
    two = f"<div id=a>{LONG}{LONG}</div><p>a</p><p>b</p><p>c</p><p>d</p><div id=b>{LONG}</div>"
    assert html_extract.extract(two) == f"{words}\n{words}\na\nb\nc\nd\n{words}"
    far = f"<div id=a>{LONG}{LONG}</div>{'<p>x</p>' * 9}<div id=b>{LONG}</div>"
    assert html_extract.extract(far) == f"{words}\n{words}\n{words}"
    assert html_extract.extract(f"<a>Home</a><div><a>About</a></div>{LONG}<p>© 2020 us</p>") == words


def shuffled_page(rng):
    """A page made of parts of known kinds, and the text that a reader wants of it."""
    para = lambda: "<p>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(25, 60))) + ".</p>"
    body = [para() for _ in range(rng.randint(2, 6))]
    if rng.random() < 0.5:
        body.insert(rng.randrange(1, len(body)), "<h2>Middle</h2>")
    inner = list(body)
    for junk in rng.sample(["<div class='advert'>Buy {}</div>", "<aside>Side {}</aside>", "<div id='newsletter'>Join {}</div>", "<form>Name {}</form>", "<script>var a = '{}'</script>", "<div class='social-share'><a>Tweet</a></div>"], rng.randint(0, 4)):
        inner.insert(rng.randrange(len(inner) + 1), junk.format("now " * rng.randint(1, 60)))
    tag, name = rng.choice([("article", ""), ("div", " class='content has-sidebar'"), ("div", " id='story'"), ("main", ""), ("section", " class='no-menu post'")])
    held = f"<{tag}{name}><h1>Top</h1>{''.join(inner)}</{tag}>"
    around = ["<nav>" + "<a>Link</a> " * rng.randint(1, 40) + "</nav>", "<header><h1>Site</h1></header>", f"<div class='sidebar'>{para()}</div>", "<footer>© all</footer>", f"<div class='comments'>{para() * 3}</div>", "<div class='cookie-notice'>We use cookies</div>"]
    rng.shuffle(around)
    cut = rng.randrange(len(around) + 1)
    wrap = rng.choice(["{}", "<div class='page-wrapper'>{}</div>", "<form id='all'>{}</form>" if tag in ("article", "main") else "{}"])
    page = "<html><body>" + wrap.format("".join(around[:cut]) + held + "".join(around[cut:])) + "</body></html>"
    return page, "\n".join(["Top", *[re.sub("<.*?>", "", b) for b in body]])


def test_html_of_shuffled_pages():
    rng = random.Random(12)
    for _ in range(400):
        page, want = shuffled_page(rng)
        assert html_extract.extract(page) == want, page


def test_long_conversations_take_linear_time(spark):
    rows = spark.range(100_000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 3 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text <|', id) AS text")
    began = time.perf_counter()
    (got,) = chat.chat_digests(rows).collect()
    assert time.perf_counter() - began < 45  # 100 times 1,000 turns; a quadratic form takes half an hour
    want = "".join(f"text <|{k}" for k in range(100_000) if k % 3)
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (100_000, len(want), hashlib.sha256(want.encode()).hexdigest())
