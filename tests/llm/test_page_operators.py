"""Archives, page texts, embeddings and the pipeline against brute force, and odd input."""

import base64
import gzip
import hashlib
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from mediapulse.llm import html, neighbours, warc
from mediapulse.llm.common import scratch_path

PAGES = "page_id long, url string, html string, http string, host string, path string, ord string"


@pytest.fixture(scope="module")
def pages(spark):
    body = "<html><body><p>Some text</p></body></html>"
    rows = [
        (1, "http://a.example/x y", body), (2, "http://a.example/z", body), (3, None, None),
        (4, "http://b.example/", ""), (5, "http://c.example/", "WARC/1.1\r\n\r\n\r\nfiledesc:// 1\n" + "é" * 70_000),
        (None, "u", "alone"), (6, "http://b.example", "x"), (6, "http://b.example", "x")
    ]
    return spark.createDataFrame([(*r, "h", "o", "p", "q") for r in rows], PAGES)


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, pages, least):
    got = sorted(map(tuple, warc.page_archive(pages, scratch_path(spark, "archive"), least).collect()), key=str)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    top = {}
    for i, b in rows:
        top[b] = max(top.get(b, -1), -1 if i is None else i)
    want, seen = [], set()
    for i, b in rows:
        first = len(b) < least or ((-1 if i is None else i) == top[b] and (i, b) not in seen)
        seen.add((i, b))
        want.append((i, len(b), sha(b), "response" if first else "revisit", None if first else top[b]))
    assert got == sorted(want, key=str)


def test_archive_of_nothing(spark, pages):
    assert warc.page_archive(pages.limit(0), scratch_path(spark, "archive")).count() == 0


def test_both_arc_versions_are_read():
    doc = b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nabc"
    one = b"filedesc://x.arc 0.0.0.0 19990101000000 text/plain 20\n1 0 someone\nURL ...\n\nhttp://h/a b 1.2.3.4 19990102030405 text/html %d\n%s\n" % (
        len(doc), doc
    )
    two = b"filedesc://y.arc 0.0.0.0 19990101000000 text/plain 200 - - 0 y.arc 12\n2 0 someone\n\nhttp://h/c 1.2.3.4 19990102030405 text/html 200 - - 99 y.arc %d\n%s\nbroken line\nhttp://h/d 1.2.3.4 19990102030405 image/png 200 - - 99 y.arc 50\nshort" % (
        len(doc), doc
    )
    for data in (one, gzip.compress(one), gzip.compress(one[:80]) + gzip.compress(one[80:])):
        (r,) = warc.arc_records("x", data)
        assert (r["uri"], r["captured"], r["payload"], r["truncated"]) == (
            "http://h/a b", "19990102030405", b"abc", False
        )
    a, lost, b = warc.arc_records("y", two)
    assert lost["problem"] == "header" and lost["uri"] is None
    assert (a["uri"], a["payload"], a["http"][:8]) == ("http://h/c", b"abc", b"HTTP/1.1") and (
        b["payload"], b["http"], b["truncated"]
    ) == (b"short", b"", True)
    assert len({x["record_id"] for x in (a, b)}) == 2


def test_any_file_names_and_bad_records(spark, tmp_path):
    lead = b"filedesc://x.arc 0.0.0.0 19990101000000 text/plain 20\n1 0 someone\nURL ...\n\n"
    record = lambda url, body: b"%s 1.2.3.4 19990102030405 text/html %d\n%s\n" % (url, len(body), body)
    for k, sub in enumerate(("a", "b")):
        (tmp_path / "arc" / sub).mkdir(parents=True)
        body = record(b"http://h/%d" % k, b"payload %d" % k)
        (tmp_path / "arc" / sub / "crawl-1999.arc.gz").write_bytes(gzip.compress(lead + body))
    bad = lead + b"http://h/x 1.2.3.4 19990102030405 text/html many\n\xff\xfe garbage\n" + record(
        b"http://h/2", b"payload 2"
    )
    (tmp_path / "arc" / "plain.arc").write_bytes(b"filedesc://foo\n" + bad)
    body = gzip.compress(lead + record(b"http://h/3", b"payload 3"))
    (tmp_path / "arc" / "junk.arc.gz").write_bytes(body + b"no gzip member")
    (tmp_path / "arc" / "padded.arc.gz").write_bytes(gzip.compress(lead + record(b"http://h/5", b"payload 5")) + b"\0" * 30)
    long = bytes(np.random.default_rng(1).integers(97, 123, 5000).astype(np.uint8))
    (tmp_path / "arc" / "cut.arc.gz").write_bytes(gzip.compress(lead + record(b"http://h/4", long))[:-900])
    rows = warc.read_arc(spark, str(tmp_path / "arc")).collect()
    good = [r for r in rows if not r.problem]
    assert {r.uri for r in good} == {f"http://h/{k}" for k in range(6)} and len(
        {r.record_id for r in good}
    ) == len(good)
    assert {r.problem for r in rows if r.problem} == {"header", "gzip"} and [r.uri for r in good if r.truncated] == ["http://h/4"]
    lost = {
        r.problem: r.n for r in warc.arc_to_warc(
            spark, str(tmp_path / "arc"), str(tmp_path / "warc"), "uri"
        ).collect()
    }
    assert lost == {"header": 2, "gzip": 2}
    back = warc.read_warc(spark, str(tmp_path / "warc")).collect()
    assert {r.uri for r in back} == {r.uri for r in good} and not any(r.problem for r in back)
    text = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\nWARC-Payload-Digest: sha1:WRONG\r\n\r\nabc\r\n\r\nWARC/1.1\r\nContent-Length: x\r\n\r\n\r\nWARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Length: 2\r\n\r\nde\r\n\r\n"
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.warc.gz").write_bytes(gzip.compress(text))
    assert [r.problem for r in warc.read_warc(spark, str(tmp_path / "other"), "*.warc.gz").collect()] == [
        "digest", "length", None
    ]


def test_archives_of_many_files(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "PER_FILE", 2)
    assert warc.page_archive(pages, scratch_path(spark, "archive")).count() == pages.count()


def test_warc_fields(spark, pages):
    folder = scratch_path(spark, "archive")
    warc.write_arc(pages.where("page_id in (1, 2)"), f"{folder}/arc")
    warc.arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", "record_id")
    records = [
        r for f in spark.read.format("binaryFile").load(
            f"{folder}/warc"
        ).collect() for r in warc.warc_records(bytes(f.content))
    ]
    kinds = sorted(f["warc-type"] for f, _ in records)
    assert kinds == ["response", "revisit"]
    by = {f["warc-type"]: (f, b) for f, b in records}
    assert by["revisit"][0][
        "warc-refers-to"
    ] == by["response"][0]["warc-record-id"] and by["revisit"][0]["warc-date"] == "2024-01-01T00:00:00Z"
    assert by["revisit"][1].endswith(
        b"\r\n\r\n"
    ) and b"<html>" not in by["revisit"][1] and b"<html>" in by["response"][1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><div class="side sidebar"><p>Other stories</p></div>
<div class="story s12"><h1>A &amp; B</h1><p>First<br>line &eacute;&#33; <b>bold   <i>text</i></b> with <a href="x">link</a><p>Second one, left open<form><input><label>Mail</label></form><ul><li>point one<li>point two</ul><!-- <p>no</p> --><blockquote>1 < 2 &lt; 3</blockquote></div>
<section id="comments"><p>Reader says a lot of things that are much longer than the article itself. And more of them. And more.</p></section><footer>&copy; all</footer>"""
TEXT = "A & B\n\nFirst line é! bold text with link\n\nSecond one, left open\n\npoint one\n\npoint two\n\n1 < 2 < 3"


def test_article_text():
    path, _ = html.best_path(PAGE)
    assert path == ">html>body>div.story s#" and html.text_at(PAGE, path) == TEXT


def test_marked_containers_around_the_article():
    body = "<article><p>First words of the story.</p><p>More of it.</p></article>"
    ad = '<div class="ad-banner"><p>Buy this now, and that as well.</p></div>'
    for page in (
        f'<body><div class="layout has-sidebar">{ad}{body}</div></body>',
        f'<body><div class="sidebar search">{ad}{body}</div></body>',
        f'<body><form action="/p.aspx">{ad}{body}</form><div class="related"><p>Another long story, with very many words to read, out of the way.</p></div></body>',
    ):
        assert html.text_at(page, html.best_path(page)[0]) == "First words of the story.\n\nMore of it."
        assert not any("Buy this" in text or "Another" in text for text, _, _ in html.blocks(page))
    # without article or main: most of the text, then whatever there is
    page = f'<body><form>{ad}<div><p>A story of some more words than all adverts have.</p><p>And an end to it.</p></div></form></body>'
    assert html.text_at(page, html.best_path(page)[0]).startswith("A story") and "Buy" not in html.text_at(
        page, html.best_path(page)[0]
    )
    page = '<body><div class="notice"><p>One one.</p></div><div class="alert"><p>Two two.</p></div></body>'
    assert [text for text, _, _ in html.blocks(page)] == ["One one.", "Two two."]


def test_host_consensus(spark):
    # the short page alone would be read from its longer teaser box; its host's other pages outvote it
    short = '<html><body><div class="teaser"><p>A long teaser about something else, in many words, of no use.</p></div><div class="story s9"><p>Brief.</p></div></body></html>'
    rows = [(k, "https://News.example:80/p", PAGE) for k in range(3)] + [
        (9, "https://news.example/q", short), (10, "https://other.example/", short), (11, None, None), (12, "x", ""),
        (13, "https://news.example/r", "<p>bare"), (14, "https://news.example/s", "no markup")
    ]
    got = {
        r.page_id: r for r in html.extract_text(
            spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], PAGES)
        ).collect()
    }
    assert got[0].text == TEXT and got[9].text == "Brief." and got[10].text.startswith("A long teaser")
    assert [got[k].text for k in (11, 12, 13, 14)] == ["", "", "bare", "no markup"] and all(
        r.n_chars == len(r.text) for r in got.values()
    ) and len(got) == len(rows)
    assert html.extract_text(spark.createDataFrame([], PAGES)).count() == 0


WORDS = "Long words of the story that go on and on. " * 8


@pytest.mark.parametrize("page,text", [
    ("<p>bare", "bare"), ("no markup &amp; all", "no markup & all"), ("<nav>menu</nav>", ""),
    (
        f'<div class="layout has-sidebar"><nav>x</nav><article><h1>T</h1><p>{WORDS}</p></article></div>',
        f"T\n\n{WORDS.strip()}"
    ),
    (
        f'<body><div class="post"><div class="post-header"><h1>Title</h1></div><div class="post-body"><p>{WORDS}</p></div></div><div class="teaser"><p>Other story</p></div></body>',
        f"Title\n\n{WORDS.strip()}"
    ),
    (
        f"<body><header>Site</header><article><header><h1>Title</h1><p>By me</p></header><p>{WORDS}</p><footer>f</footer></article></body>",
        f"Title\n\n{WORDS.strip()}"
    ),
    (
        f"<body><article><h1>Title</h1><p>Short intro.</p><section><p>{WORDS}</p><p>{WORDS}</p></section></article><div><p>Other</p></div></body>",
        f"Title\n\nShort intro.\n\n{WORDS.strip()}\n\n{WORDS.strip()}"
    ),
    (f"<body><h1>Title</h1><div class='c'><p>{WORDS}</p></div><footer>x</footer></body>", f"Title\n\n{WORDS.strip()}"),
    # closed elements of other vocabularies, short comments, unclosed and quoted tags
    (f"<body><a href='/'><svg class='icon'/></a><article><p>{WORDS}</p><svg viewBox='0 0 1 1'><path d='M0'/><text>no</text></svg><p>End.</p></article>", f"{WORDS.strip()}\n\nEnd."),
    (f"<body><!--><article><p>{WORDS}</p><!---><p>End.</p><!-- <p>no</p> --></article>", f"{WORDS.strip()}\n\nEnd."),
    (f"<body><article><p>{WORDS}</p><noscript><p>no</p></noscript><template><p>no</p></template><p>End.</p><script>if (a<b) '</p>'</script></article>", f"{WORDS.strip()}\n\nEnd."),
    (f"<body><article><svg><g><p>{WORDS}</p></article><p>x", WORDS.strip()),
    # a container with running text of its own between its parts
    (f'<body><div class="post"><p>Intro.</p><div class="text"><p>{WORDS}</p></div><div class="more"><p>{WORDS}</p></div></div></body>', f"Intro.\n\n{WORDS.strip()}\n\n{WORDS.strip()}"),
    # a story and a teaser
    (f"<body><main><article><h1>T</h1><p>{WORDS}</p></article><article><h2>Other</h2><p>Read this as well.</p></article></main></body>", f"T\n\n{WORDS.strip()}"),
])
def test_page_shapes(page, text):
    path = html.best_path(page)
    assert (html.text_at(page, path[0]) if path else "") == text


NAMES = "comment-list comments-area related-posts ad-slot share-buttons sidebar-left newsletter-box site-footer author-box cookie-bar social-links promo-block widget-area entry-comments post-related-items".split()


@pytest.mark.parametrize("name", NAMES)
def test_names_of_several_words(name):
    extra = f'<div class="{name}"><p>Something else that is no part of it.</p></div>'
    for page in (
        f"<body>{extra}<article><h1>T</h1><p>{WORDS}</p>{extra}<p>End.</p></article>{extra}</body>",
        f'<body><div class="page">{extra}<div class="story"><h1>T</h1><p>{WORDS}</p>{extra}<p>End.</p></div>{extra}</div></body>',
        f'<body><div class="has-sidebar with-{name}"><article><h1>T</h1><p>{WORDS}</p><p>End.</p></article></div></body>',
        f'<body><div class="story"><div class="text-and-{name}"><h1>T</h1><p>{WORDS}</p><p>End.</p></div></div></body>',
        f'<body><article><h1>T</h1><div class="body {name}-on"><p>{WORDS}</p><p>End.</p></div></article></body>',
    ):
        assert html.text_at(page, html.best_path(page)[0]) == f"T\n\n{WORDS.strip()}\n\nEnd.", page


def test_long_comments_are_not_the_article():
    for name in ("comments", "comment-list", "reply-thread"):
        page = f'<body><div class="story"><h1>T</h1><p>{WORDS}</p></div><div class="{name}"><p>{WORDS * 4}</p></div></body>'
        assert html.text_at(page, html.best_path(page)[0]) == f"T\n\n{WORDS.strip()}"


class Plain(HTMLParser):
    """The blocks of the first article of a page whose boilerplate is in nav, header, footer, aside, form or class ad."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.out, self.held = [], [], []

    def flush(self):
        text = " ".join("".join(self.held).split())
        tags = [t for t, _ in self.stack]
        skipped = {"nav", "footer", "aside", "form", "script", "style", "title", "head"}
        if text and "article" in tags and not skipped & set(tags) and not any("ad" in c.split() for _, c in self.stack):
            self.out.append(text)
        self.held = []

    def handle_starttag(self, tag, attributes):
        if tag in html.INLINE:
            self.held += [" "] * (tag == "br")
            return
        self.flush()
        if tag not in html.VOID:
            self.stack.append((tag, dict(attributes).get("class") or ""))

    def handle_endtag(self, tag):
        if tag in html.INLINE:
            return
        self.flush()
        at = [k for k, (t, _) in enumerate(self.stack) if t == tag]
        if at:
            del self.stack[at[-1] :]

    def handle_data(self, data):
        self.held.append(data)


def test_pages_against_another_parser(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in rows.select("page_id", "html").collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        plain.flush()
        want[r.page_id] = "\n\n".join(plain.out)
    assert {r.page_id: r.text for r in html.extract_text(rows).collect()} == want


def test_very_long_pages_are_read_whole(spark):
    body = "<article>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(30_000)) + "</article>"
    (r,) = html.extract_text(
        spark.createDataFrame([(1, "http://long.example/", body, "a", "b", "c", "d")], PAGES)
    ).collect()
    assert r.text == "\n\n".join(f"Paragraph {k} of a very long page." for k in range(30_000))


def test_votes_against_a_plain_count(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("url", "html").collect()
    votes = {}
    for r in rows:
        host = (r.url or "").split("/")[2].split("@")[-1].split(":")[0].lower()
        if (got := html.best_path(r.html or "")) is not None:
            n = votes.setdefault(host, {}).setdefault(got[0], [0, 0.0])
            n[0] += 1
            n[1] += round(got[1], 6)
    want = {h: max((n, round(s, 3), p) for p, (n, s) in v.items())[2] for h, v in votes.items()}
    assert {r.host: r.path for r in html.host_paths(spark.read.parquet(f"{sf}/pages.parquet")).collect()} == want


def test_salted_paths_equal_broadcast_ones(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html", html.host_of().alias("host"))
    winners = html.host_paths(pages)
    a, b = (
        sorted(
            map(str, html.with_host_path(pages, winners, n).select("page_id", "path").collect())
        ) for n in (10**6, 0)
    )
    assert a == b and len(a) == pages.count()


def slow_links(rows, threshold=0.98):
    ok = {
        k: (l, np.array(v, float)) for k, v,
        l in rows if l is not None and k is not None and v and all(
            x is not None and np.isfinite(x) for x in v
        ) and any(v)
    }
    near = {k: set() for k, _, _ in rows}
    ids = list(ok)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            (la, va), (lb, vb) = ok[a], ok[b]
            if la == lb and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= threshold:
                near[a].add(b)
                near[b].add(a)
    return near


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng, rows = np.random.default_rng(3), []
    for g in range(120):
        centre = rng.standard_normal(16)
        for _ in range({0: 60, 1: 30, 2: 2, 3: 3}.get(g % 40, 1)):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.standard_normal(16) * 0.02], g % 3))
    rows += [(5000 + k, rows[7][1], rows[7][2]) for k in range(4)] + [
        (5010, [2 * x for x in rows[7][1]], rows[7][2]), (5011, rows[7][1], 2 if rows[7][2] != 2 else 1)
    ]
    want = slow_links(rows)
    got = {
        r.vec_id: r for r in neighbours.near_vectors(
            spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        ).collect()
    }
    label = {k: k for k in want}
    for _ in range(5):
        for k in want:
            label[k] = min([label[k], *(label[x] for x in want[k])])
    found = sum(got[k].n_links for k in want)
    assert 0.98 * sum(map(len, want.values())) <= found <= sum(map(len, want.values()))
    assert np.mean([(got[k].n_links, got[k].component_id) == (len(want[k]), label[k]) for k in want]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def around(rng, centre, n, noise):
    return unit(centre + noise * unit(rng.standard_normal((n, len(centre)))))


def big_group(kind):
    """Vectors of one label with many links: tight groups, and pairs of groups that few links hold together."""
    rng = np.random.default_rng(1)
    a, b = unit(rng.standard_normal((2, 64)))
    b = unit(b - (a @ b) * a)
    tilted = lambda cosine: cosine * a + np.sqrt(1 - cosine**2) * b
    if kind == "two groups":
        return np.concatenate([around(rng, a, 200, 0.005), around(rng, tilted(0.984), 200, 0.005)])
    if kind == "loose groups":
        return np.concatenate([around(rng, a, 300, 0.12), around(rng, tilted(0.975), 300, 0.12)])
    return around(rng, a, kind, 0.005)


@pytest.mark.parametrize("kind", [200, 1000, 5000, "two groups", "loose groups"])
def test_large_groups_lose_no_link(spark, kind):
    v = big_group(kind).astype(np.float32)
    u = unit(v.astype(np.float64))
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    while True:
        low = np.minimum(label, np.where(near, label[None], len(v)).min(axis=1))
        if (low == label).all():
            break
        label = low
    rows = spark.createDataFrame(
        [(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int"
    )
    got = neighbours.near_vectors(neighbours.written(rows.repartition(4), "vectors")).orderBy("vec_id").toPandas()
    assert (got.n_links.to_numpy() == near.sum(axis=1)).all() and (got.component_id.to_numpy() == label).all()
    assert (got.audit_recall == 1.0).all()


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_recall", lambda links, true: (0.5, 0.5))
    with pytest.raises(RuntimeError, match="0.500"):
        neighbours.near_vectors(
            spark.createDataFrame(
                [(1, [1.0, 2.0], 1), (2, [1.0, 2.1], 1)], "vec_id long, embedding array<float>, label int"
            ),
            most=1, rounds=1
        )


def test_ties_and_ids_with_several_vectors(spark):
    rows = [
        (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2),
        (1, [1.0, 0.0], 2)
    ]
    got = neighbours.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    ).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [
        (1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1)
    ]


def test_near_vectors_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [1.0, 2.0], 2), (4, [1.0, 2.0], None),
        (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [1.0, None], 1), (9, [nan, 1.0], 1), (10, [inf, 1.0], 1),
        (None, [1.0, 2.0], 1), (11, [1e-30, 2e-30], 1), (12, [1.0, 2.0, 0.0], 1), (13, [-1.0, -2.0], 1)
    ]
    shape = "vec_id long, embedding array<float>, label int, id string, key string, n_links string"
    got = neighbours.near_vectors(spark.createDataFrame([(*r, "a", "b", "c") for r in rows], shape)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by[1] == (2, 1, True) and by[2] == (2, 1, False) and by[11] == (2, 1, False) and by[None] == (0, None, False)
    assert all(by[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13))
    assert neighbours.near_vectors(spark.createDataFrame([], shape)).count() == 0


def slow_pipeline(docs, labels, benchmark):
    """Token ids of every document that is left, stage by stage from the definitions; only the fitted voter is shared."""
    from mediapulse.llm import quality
    from tests.llm.test_text_operators import components, slow_hits, slow_shingles, slow_substring, slow_windows, tokenizer

    marks = {}
    for i, q in labels:
        marks[i] = max(q, marks.get(i, 0))
    train = [i for i in sorted(marks) if zlib.crc32(str(i).encode()) % 5 and i in docs]
    share = {c: sum(marks[i] == c for i in marks if zlib.crc32(str(i).encode()) % 5) for c in (0, 1)}
    raw = {i: (t or "").encode() for i, t in docs.items()}
    voter = quality.Voter(
        np.stack([quality.features(raw[i]) for i in train]), np.array([marks[i] for i in train]), share
    )
    good = {i: t for i, t in docs.items() if voter.score(quality.features(raw[i])[None])[0] >= 0.3}
    sets = {i: slow_shingles(t) for i, t in good.items()}
    alike = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    group = components(list(sets), alike)
    once = slow_substring({i: t for i, t in good.items() if group[i] == i})
    windows, t, left = slow_windows(benchmark), tokenizer(), {}
    for i, text in once.items():
        words, hit, _ = slow_hits(text or "", windows)
        if hit:
            if 2 * len(hit) >= len(words):
                continue
            spans, cut, last = [m.span() for m in WORD.finditer((text or "").encode())], [], 0
            for k in sorted(hit):  # blanks and marks between two hit words go with them
                a, z = spans[k]
                if k - 1 not in hit:
                    cut.append((text or "").encode()[last:a])
                last = z
            text = b"".join([*cut, (text or "").encode()[last:]]).decode()
        left[i] = t.encode(text or "", add_special_tokens=False).ids
    return left


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_pipeline_against_brute_force(spark, sf):
    import corpus_pipeline

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = slow_pipeline(docs, labels, benchmark)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and 100 < len(got) < len(docs)
    assert [n for n, _ in corpus_pipeline.STAGES][0].startswith("quality")


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    shape = "doc_id long, text string, lang string, source string, n_chars long, score string, spans string"
    story = " ".join(f"word{k % 97} and{k}" for k in range(80))
    rows = [
        (1, story), (2, story + " end"), (2, story + " end"), (3, None), (4, ""), (5, " \n "), (None, "no id"),
        (None, None), (6, "very " * 50_000)
    ]
    frame = spark.createDataFrame([(i, t, None, None, None, "s", "p") for i, t in rows], shape)
    for name, docs in (("odd", frame), ("empty", frame.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0)], "doc_id long, quality int").write.parquet(
            str(tmp_path / name / "labels.parquet")
        )
        spark.createDataFrame(
            [("a", "ten words of an item that no document here has"), ("b", None), (None, "")],
            "item_id string, text string"
        ).write.parquet(str(tmp_path / name / "benchmark.parquet"))
        at = docs
        for stage, f in corpus_pipeline.STAGES:
            at = f(spark, at, str(tmp_path / name))
            assert stage.startswith("bpe") or at.columns == corpus_pipeline.COLUMNS
        left = sorted(((r.doc_id, r.n_tokens) for r in at.collect()), key=str)
        ids = [i for i, _ in left if i is not None]
        assert ids == ([] if name == "empty" else sorted(set(ids))) and not {2, 4, 5} & set(ids)
        assert name == "empty" or (1 in ids and sum(i is None for i, _ in left) == 2)
