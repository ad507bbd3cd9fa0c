"""Pages and conversations: extraction, URL filters, WARC and chat formats."""

import gzip
import hashlib
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import chat, htmltext, urls, warc

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="top"><h2>Site</h2><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li><li><a href=/b>B</a></li></ul></nav><div class="cookie-notice">We use cookies and such things on this site.</div>
<article><h1>Head&shy;line</h1><p>First&nbsp; para <b>bold</b>graph<br>after   a break</p><div class="ad">Buy now</div><p>x<p>Last &lt;one&gt; &#x41;
<!-- not this --><a href="/l">a linked sentence</a><form><input name=q><label>Search</label></form><section id="comments"><p>Nice post, said a reader with a long comment.</p></section></article>
<aside><p>Related things to read, many of them.</p></aside><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page_with_furniture():
    assert htmltext.main_text(PAGE) == "Head\xadline\nFirst para boldgraph\nafter a break\nx\nLast <one> A a linked sentence"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- open", "<script>x", "</div></p>", "<nav>only a menu</nav>", "<a href='"])
def test_pages_without_main_text(page):
    assert htmltext.main_text(page) == ""


def test_density_decides_without_an_article():
    body = " ".join(["plain words in a paragraph"] * 12)
    page = f"<body><ul><li><a href=1>One</a></li><li><a href=2>Two more</a></li></ul><p>{body}</p><p>{body}</p><p><a href=3>links and links and links</a></p></body>"
    assert htmltext.main_text(page) == f"{body}\n{body}"


LONG = "A sentence of an article that says something of some length about matters. " * 3
SAID = LONG.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<div class="layout has-sidebar"><article><h1>Title</h1><p>{LONG}</p></article></div>', f"Title\n{SAID}"),
        (f'<div class="content with-sidebar"><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></div>', f"The title\n{SAID}\n{SAID}"),
        (f'<form id="aspnetForm"><div><h1>The title</h1><p>{LONG}</p></div></form>', f"The title\n{SAID}"),
        (f"<article><h1>T</h1><nav><ul><li><a>one</a></li><li><a>two</a></li></ul></nav><p>{LONG}</p></article>", f"T\n{SAID}"),
        (f'<main><p>{LONG}</p><aside class="related"><ul><li><a>Rel one</a><li><a>Rel two</a></ul></aside></main>', SAID),
        (f'<main><p>{LONG}</p><div id="kommentare"><p>{LONG}</p><p>{LONG}</p></div></main>', SAID),
        (f'<div><p>{LONG}</p><div class="x9"><h3>3 Comentarios</h3><p>{LONG}</p><p>Yes.</p></div></div>', SAID),
        (f'<article><p>{LONG}</p><p style="display: none">{LONG}</p><div hidden>{LONG}</div></article>', SAID),
        (f'<article><header class="entry-header"><h1>T</h1><p>By me</p></header><div class="table-responsive"><p>{LONG}</p></div><footer>Filed</footer></article>', f"T\nBy me\n{SAID}"),
        (f'<div class="q1"><ul><li><a>Home</a><li><a>About us</a></ul></div><h1>The title</h1><p>{LONG}</p><div><a>Next page</a></div>', f"The title\n{SAID}"),
        (f'<article class="comment-body"><p>{LONG}</p></article><article><p>{LONG} x</p></article>', f"{SAID} x"),
        ("<div>" * 3000 + LONG, SAID),
    ],
)
def test_layouts_furniture_and_comments(page, want):
    assert htmltext.main_text(page) == want


def held_out(rng):
    """A page with class names that say nothing, and its main blocks."""
    words = lambda n: " ".join(rng.choice(["wort", "mot", "palabra", "word"]) + rng.choice("abc") for _ in range(n))
    menu = lambda: f"<ul class=z{rng.randrange(99)}>" + "".join(f"<li><a href=/x>{words(rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(3, 8))) + "</ul>"
    title, body, want = words(rng.randint(3, 9)), [], []
    for _ in range(rng.randint(2, 12)):
        text = words(rng.choice([rng.randint(7, 20), rng.randint(20, 120)]))
        linked = f"<a href=/y>{words(2)}</a>" if rng.random() < 0.3 else ""
        body.append(f"<p>{text} {linked}</p>")
        want.append(f"{text} {words(0)}{linked[linked.find('>') + 1 : -4] if linked else ''}".strip())
    wrap = rng.choice(["article", "main", "div"])
    ends = [f"<footer>{words(9)}</footer>", f"<aside><p>{words(40)}</p>{menu()}</aside>", f"<div class=y{rng.randrange(99)}><h3>{rng.choice(['Kommentare', '12 Comments', 'Comentarios (3)', 'Commentaires'])}</h3><p>{words(30)}</p><p>{words(60)}</p></div>"]
    inner = [f"<nav>{menu()}</nav>", menu(), ""]
    html = f"<body>{menu()}<{wrap} class=k{rng.randrange(99)}><h1>{title}</h1>{rng.choice(inner)}{''.join(body)}</{wrap}>{''.join(rng.sample(ends, rng.randint(1, 3)))}</body>"
    return html, "\n".join([title, *want])


def running(n, word="wort"):
    return " ".join(f"{word}{k}" for k in range(n))


@pytest.mark.parametrize(
    "inner, stays",
    [
        ("<div class='legal-news'><p>{long} MARK</p></div>", True),
        ("<section class='search-engine-history'><h2>History</h2><p>{long} MARK</p></section>", True),
        ("<section id='discussion'><h2>Discussion</h2><p>{long} MARK</p></section>", True),
        ("<h2>Discussion</h2><p>{long} a</p><h2>Conclusion</h2><p>{long} MARK</p>", True),
        ("<section><h2>Comments on method</h2><p>{long} MARK</p></section>", True),
        ("<h2>Diskussion</h2><div><p>Eva, vor 3 Tagen</p><p>{short} MARK</p></div><div><p>Jan, vor 2 Tagen</p><p>{short}</p></div>", False),
        ("<h2>Replies</h2><p>{long} MARK</p><form><p>{short}</p></form>", False),
        ("<section id='comments'><p>{long} MARK</p></section>", False),
        ("<section><h2>3 Comments</h2><p>{long} MARK</p></section>", False),
        ("<div class='cookie-notice'><p>{long} MARK</p></div>", False),
        ("<div class='advert'><p>{long} MARK</p></div>", False),
        ("<div class='related-posts'><a>{long} MARK</a></div>", False),
    ],
)
@pytest.mark.parametrize("page", ["<nav><a>Home</a></nav><article><h1>Its title</h1><p>{first}</p>{inner}</article><footer>fine print</footer>", "<main><h1>Its title</h1><p>{first}</p>{inner}</main>"])
def test_hints_give_way_to_running_text(page, inner, stays):
    html = page.format(first=running(60, "x"), inner=inner.format(long=running(50), short=running(6)))
    text = htmltext.main_text(html)
    assert ("MARK" in text) == stays and running(60, "x") in text and "fine print" not in text


def test_reading_takes_time_in_proportion():
    import time

    for html in ("<div>" * 50_000 + "x" + "</p>" * 50_000 + "</section>" * 50_000, "<svg>x" * 50_000 + "<title>" * 50_000, "<h2>Discussion</h2>" * 20_000, "<p><h3>Comments</h3>" * 20_000):
        began = time.process_time()
        htmltext.Page(html)
        assert time.process_time() - began < 5


def test_the_classifier_on_held_out_pages():
    rng = random.Random(2)
    pages = [held_out(rng) for _ in range(400)]
    assert sum(htmltext.main_text(html) == want for html, want in pages) >= 0.95 * len(pages)


def test_blocks_equal_those_of_another_parser():
    from html.parser import HTMLParser

    class Other(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.now, self.linked, self.deep = [], "", 0, 0

        def flush(self):
            if text := " ".join(self.now.split()):
                self.out.append((text, (len(text.split()), min(self.linked, len(text.split())))))
            self.now, self.linked = "", 0

        def handle_starttag(self, tag, attrs):
            if tag == "a":
                self.deep = 1
            elif tag not in ("b", "i", "span"):
                self.flush()

        def handle_endtag(self, tag):
            if tag == "a":
                self.deep = 0
            elif tag not in ("b", "i", "span"):
                self.flush()

        def handle_data(self, data):
            self.now += data
            self.linked += len(data.split()) * self.deep

    rng = random.Random(3)
    for _ in range(100):
        html = held_out(rng)[0].replace("worta", "&lt;w&#246;rt&nbsp;").replace("mota", "<b>m</b><i>ot</i>")
        other = Other()
        other.feed(html)
        other.flush()
        mine = htmltext.Page(html)
        assert list(zip(mine.texts, mine.counts)) == other.out


def test_extraction_keeps_all_rows(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<article>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    got = htmltext.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == sorted([len(htmltext.main_text(PAGE))] * 2 + [0, 499_999])
    assert htmltext.extract(df.limit(0)).count() == 0


URLS = {
    1: ("https://A.Example.ORG/es/5?x#y", "a.example.org", "/es/5", "example.org/es/", "block"),
    2: ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    3: ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    4: ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
    5: ("ftp://x.com/de/", "x.com", "/de/", "com/de/", "block"),
    6: ("http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"),
    7: ("http://x.com", "x.com", "", None, "allow"),
    8: ("http://x.org#/es/", "x.org", "", None, "allow"),
    9: (None, "", "", None, "allow"),
    10: ("no scheme.org/es/", "", "", None, "allow"),
    11: ("://ÄB.com/A%20?://z", "Äb.com", "/A%20", None, "allow"),
    12: ("", "", "", None, "allow"),
    13: ("http://h/" + "a/" * 5000, "h", "/" + "a/" * 5000, None, "allow"),
}


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in URLS.items()], "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict")
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(df, labels).collect()}
    assert got == {i: v[1:] for i, v in URLS.items()}
    assert urls.filter_urls(df.limit(0), labels).count() == 0


@pytest.mark.parametrize("sent, hot", [(200_000, 0.001), (0, 0.01), (0, 2.0)])
def test_bad_branches_are_rejected_and_others_not(spark, monkeypatch, sent, hot):
    monkeypatch.setattr(urls, "MOST_SENT", sent)
    monkeypatch.setattr(urls, "HOT", hot)
    rows, labels, i = [], [], 0
    for k in range(400):
        for branch, bad in (("news", 0.02), ("spam", 0.97), ("blog", 0.03)):
            rows.append((i, f"http://s.net/{branch}/{k}/item-{k % 7}"))
            if k % 3:
                labels.append((i, random.Random(i).random() < bad))
            i += 1
    rows += [(i + k, f"http://t.net/spam/{k}") for k in range(50)]
    got = urls.filter_urls(spark.createDataFrame(rows + rows[:5], "page_id long, url string"), spark.createDataFrame(labels + labels[:9] + [(None, True)], "page_id long, bad boolean"))
    counts = {(r["branch"], r["verdict"]): r["n"] for r in got.groupBy(F.concat("host", F.lit("/"), F.split("path", "/")[1]).alias("branch"), "verdict").agg(F.count("*").alias("n")).collect()}
    assert counts == {("s.net/news", "allow"): 402, ("s.net/spam", "block"): 402, ("s.net/blog", "allow"): 401, ("t.net/spam", "allow"): 50}


def test_templates_generalise_variable_segments(spark):
    rows = [("h", f"/user/{'abcdefghij'[k % 10] * (k + 1)}/posts/{k}.html", 1, 0, 0) for k in range(40)] + [("h", "/", 1, 0, 0), ("h", "", 1, 0, 0)]
    leaves = urls.templates(spark.createDataFrame(rows, "host string, path string, n long, labelled long, bad long"))
    assert {r["template"] for r in leaves.collect()} == {"/*/*/*/*", ""}


def test_a_bad_branch_among_one_off_segments_is_rejected(spark):
    slugs = [f"w{'abcdefghij'[k % 10]}{k}x" for k in range(1000)]
    rows = [(k, f"http://h.net/{slug}/{k}") for k, slug in enumerate(slugs)] + [(1000 + k, f"http://h.net/casino/{k}") for k in range(500)]
    labels = [(i, i >= 1000) for i, _ in rows]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"))
    assert {(r["page_id"] >= 1000, r["verdict"]) for r in got.collect()} == {(False, "allow"), (True, "block")}


def test_branches_that_part_below_many_segments_are_told_apart(spark):
    rows = [(("h", f"/a/b/c/2024/01/02/x/{'bad' if k % 2 else 'good'}/p{k}/q/r", 1, 1, k % 2)) for k in range(80)]
    rows += [("h", "/a/b/c/2024/01/02/x", 1, 0, 0), ("g", "/" + "s/" * 3000, 1, 1, 1), ("g", "/" + "s/" * 50, 1, 0, 0)]
    leaves = urls.templates(spark.createDataFrame(rows, "host string, path string, n long, labelled long, bad long"))
    deep = "/*" * 7
    assert {(r["host"], r["template"], r["bad"]) for r in leaves.collect() if r["labelled"]} == {("h", f"{deep}/good/**", 0), ("h", f"{deep}/bad/**", 1), ("g", "/*/*/*/*/*/*/**", 1)}
    labels = spark.createDataFrame([(k, bool(k % 2)) for k in range(80)], "page_id long, bad boolean")
    pages = spark.createDataFrame([(k, f"http://h.net{r[1]}") for k, r in enumerate(rows[:80])], "page_id long, url string")
    assert {(r["page_id"] % 2, r["verdict"]) for r in urls.filter_urls(pages, labels).collect()} == {(0, "allow"), (1, "block")}


def test_verdicts_of_the_method_equal_its_sql(spark, tmp_path):
    import duckdb

    rng, rows, labels = random.Random(8), [], []
    for i in range(1500):
        host = rng.choice(["a.net", "B.net", "c.info"])
        branch, bad = rng.choice([("news", 0.05), ("casino", 0.95), ("blog", 0.1), ("x/y", 0.5)])
        path = f"/{branch}/{rng.choice([rng.randrange(90), f'{rng.randrange(9)}.html', 'deadbeef0123-4567', 'same'])}"
        if branch == "x/y":  # told apart below the usual depth
            good = rng.random() < 0.5
            path, bad = f"/x/y/{'s/' * 5}{'good' if good else 'evil'}/{rng.randrange(50)}", 0.02 if good else 0.98
        rows.append((i, f"http://{host}{path}{rng.choice(['', '?q', '#f'])}"))
        if i % 4:
            evil = rng.random() < bad
            labels.append((i, int(not evil) if rng.random() < 0.5 else 1, int(evil)))
    rows += [(3000, None), (3001, "nothing"), (3002, "http://www.example.org/es/1"), (None, "http://a.net/casino/1")]
    labels += [(3, None, None), (None, 0, 1)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = urls.op8_urls(spark, str(tmp_path)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({urls.OP8_SQL})").fetchall(), key=key)
    blocked = {r["path"].split("/")[1] + ("/evil" if "evil" in r["path"] else "") for r in got if r["rule"] is None and r["verdict"] == "block"}
    assert blocked == {"casino", "x/evil"}


def payloads():
    rng = random.Random(7)
    big = "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(300_000))
    member = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nnested").decode("latin-1")
    texts = ["", None, "a" * 99, "b" * 100, "é" * 50, big, member * 3, "\x1f\x8b\x08" * 40, "x\r\n\r\ny" * 30]
    return [(k, f"http://h/{k}\n", t) for k, t in enumerate(texts)] + [(k + 100, None, t) for k, t in enumerate(texts)] + [(None, "n", "b" * 100), (3, "again", "b" * 100)]


@pytest.mark.parametrize("split", [500, 70_000, 1 << 30])
@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_archives_round_trip(spark, tmp_path, monkeypatch, split, broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST", broadcast)
    rows = payloads()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as payload_digest").repartition(3)
    folder = f"file://{tmp_path}/warc"
    got = warc.read(warc.write(df, folder), split=split, folder=folder).collect()
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(i, first.get(t, i))
    want = []
    for i, _, t in rows:
        p = (t or "").encode()
        again = i is not None and t in first and i > first[t]
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[t] if again else None, b"" if again else p))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got), key=str) == sorted(want, key=str)


def test_members_are_plain_gzip_and_damage_is_skipped():
    parts = [warc.record(k, None, b"payload %d" % k * 50, "0" * 64, None) for k in range(5)]
    assert gzip.decompress(b"".join(parts)).count(b"WARC/1.1\r\n") == 5
    import pyarrow as pa

    raw = b"junk" + parts[0] + parts[1][:-30] + parts[2]
    archive = warc._Archive(pa.BufferReader(raw))
    assert [h["x-page-id"] for h, _ in archive.records(0, len(raw))] == ["0", "2"]


def test_foreign_archives_are_read(spark, tmp_path):
    def member(kind, block, *more):
        return gzip.compress(b"WARC/1.0\r\nwarc-TYPE:" + kind + b"\r\n" + b"".join(m + b"\r\n" for m in more) + b"Content-Length:%d\r\n\r\n" % len(block) + block + b"\r\n\r\n")

    http, kind = b"HTTP/1.1 200 OK\r\nX: y\r\n", b"Content-Type: application/http; msgtype=response"
    digest = hashlib.sha256(b"hello").digest()
    import base64

    raw = member(b"warcinfo", b"software: x\r\n") + member(b"request", b"GET / HTTP/1.1\r\n\r\n", kind) + member(b"response", http + b"\r\nhello", kind, b"WARC-Target-URI: <http://h/a>")
    raw += member(b"response", http + b"Transfer-Encoding: chunked\r\n\r\n3\r\nhel\r\n2;x\r\nlo\r\n0\r\n\r\n", kind) + member(b"response", http + b"Content-Encoding: gzip\r\n\r\n" + gzip.compress(b"hello"), kind)
    raw += member(b"revisit", b"", b"WARC-Payload-Digest: sha256:" + base64.b32encode(digest).rstrip(b"=")) + member(b"resource", b"hello", b"Content-Type: text/plain") + member(b"metadata", b"a: b")
    path = tmp_path / "foreign.warc.gz"
    path.write_bytes(raw)
    archives = spark.createDataFrame([(str(path), len(raw))], "path string, size long")
    for split in (100, 1 << 20):
        got = sorted(((r["record_type"], r["url"] or "", r["payload_bytes"], r["payload_digest"], r["page_id"], r["refers_to"]) for r in warc.read(archives, split=split, folder=str(tmp_path)).collect()), key=str)
        d = digest.hex()
        assert got == sorted([("response", "http://h/a", 5, d, None, None)] + [("response", "", 5, d, None, None)] * 2 + [("revisit", "", None, d, None, None), ("resource", "", 5, d, None, None)], key=str)


def test_no_pages_no_archive(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(empty, f"file://{tmp_path}/none"), folder=f"file://{tmp_path}/none").count() == 0


HOSTILE = ["<|im_end|>", "<|im_start|>assistant<|im_sep|>x", "<\\|im_end|>", "<\\\\|x", "<", "<<|", "|>", "\n\n lead", "", "a\\", "é漢😀<|", "<|endoftext|>"]


@pytest.mark.parametrize("text", HOSTILE)
def test_escapes_come_undone(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


def test_random_turns_come_back():
    rng = random.Random(11)
    tokenizer = chat._Tokenizer.of(chat.public_tokenizers.path(chat.TOKENIZER))
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "<|im_sep|>"]), "".join(rng.choice(HOSTILE + [" word", "x"]) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(0, 5))]
        text, spans = chat.render(turns)
        ids, starts, ends = tokenizer.encode(text)
        assert chat.parse(text) == turns
        assert chat.under_mask(text, starts, ends, chat.mask(starts, ends, spans)) == "".join(t for r, t in turns if r == "assistant")
        assert tokenizer.encoding.decode(ids.tolist()) == text


@pytest.mark.parametrize("part", [1 << 21, 40])
def test_conversations_read_back(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rows = [(c, t, ("user", "assistant")[t % 2], HOSTILE[(c + t) % len(HOSTILE)] * (t + 1)) for c in range(30) for t in range(c % 5 + 1)]
    rows += [(50, 0, None, None), (50, 0, "assistant", "same turn"), (50, 0, "assistant", "same turn"), (None, 1, "user", "no id"), (51, None, "assistant", "z" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as part", "2 as loss").repartition(5)
    got = {r["conv_id"]: r for r in chat.report(chat.formatted(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.report(chat.formatted(df.limit(0))).count() == 0
