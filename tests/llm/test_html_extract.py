import random
import resource
import time

import pytest

from siftlode.llm import html_extract
from siftlode.llm.html_extract import blocks

SCHEMA = "page_id long, url string, html string"


def own(i, n):
    return " ".join(f"p{i}w{j}" for j in range(n))


def test_shares_decide_open_blocks_beside_an_article():
    menu = "<div>Home News About Contact Search Login Help</div>"
    pages = [f"<body>{menu}<article>teaser {i}</article><div class=content>{own(i, 20)}</div></body>" for i in range(4)]
    assert [t for t, _, _ in html_extract.extract(pages)] == [f"teaser {i}\n{own(i, 20)}" for i in range(4)]


def test_shares_decide_inside_articles_too():
    notice = "<p>Please subscribe to our letter for more stories like this one</p>"
    pages = [f"<body><article><p>{own(i, 20)}</p>{notice * (i < 6)}</article></body>" for i in range(10)]
    assert [t for t, _, _ in html_extract.extract(pages)] == [own(i, 20) for i in range(10)]
    # on under half of the pages it is a passage that articles share
    pages = [f"<body><article><p>{own(i, 20)}</p>{notice * (i < 4)}</article></body>" for i in range(10)]
    assert all(("subscribe" in t) == (i < 4) for i, (t, _, _) in enumerate(html_extract.extract(pages)))
    # copies of one page keep their article
    assert [t for t, _, _ in html_extract.extract([pages[0]] * 9)] == [html_extract.extract(pages[:1])[0][0]] * 9


def slow_texts(pages):
    """The texts of a host's pages by counting every run in a dictionary of sets."""
    parsed = [[(z, t.split(" ")) for z, t in blocks(p)] for p in pages]
    streams = [[w for _, ws in page for w in ws] for page in parsed]
    where = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - 5):
            where.setdefault(tuple(s[i : i + 6]), set()).add(k)
    n = len(pages)
    least = (max(3, -(-n // 100)), max(5, -(-n // 2)))
    out = []
    for page, s in zip(parsed, streams, strict=True):
        marks = [[False] * len(s) for _ in least]
        for i in range(len(s) - 5):
            for mark, want in zip(marks, least, strict=True):
                if len(where[tuple(s[i : i + 6])]) >= want:
                    mark[i : i + 6] = [True] * 6
        at, stays = 0, []
        for zone, ws in page:
            seen, wide = (sum(m[at : at + len(ws)]) / len(ws) for m in marks)
            stays.append(wide < 0.9 if zone == "article" else seen < 0.5)
            at += len(ws)
        if any(z == "article" for z, _ in page) and not any(s and z == "article" for (z, _), s in zip(page, stays, strict=True)):
            stays = [s or z == "article" for (z, _), s in zip(page, stays, strict=True)]
        out.append("\n".join(" ".join(ws) for (_, ws), s in zip(page, stays, strict=True) if s))
    return out


def site(rnd, n):
    """Pages of one host: text with and without an article, menus and notices without a telling name, shared passages."""
    menu, passage = own("m", 9), own("s", 30)
    notices = [own(f"n{i}", 8 + i) for i in range(6)]
    pages = []
    for i in range(n):
        body = "".join(f"<p>{own(rnd.randrange(10**6), rnd.randrange(1, 30))} {passage if rnd.random() < 0.2 else ''}</p>" + (f"<div>{rnd.choice(notices)}</div>" if rnd.random() < 0.5 else "") for _ in range(rnd.randrange(5)))
        body = f"<article>{body}<p>{notices[0]}</p></article>" if rnd.random() < 0.6 else f"<div>{body}</div>"
        pages.append(f"<body><div>{menu}</div><div class=ad>{own(i, 5)}</div>{body}<div>{notices[1] if rnd.random() < 0.03 else ''}</div><footer>{own('f', 7)}</footer>")
    return [*pages, None, "", pages[0], "<p>only this"]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    sites = {"a.test": site(rnd, 260), "b.test": site(rnd, 40), "c.test": site(rnd, 2), "": site(rnd, 5)}
    return [(100_000 * h + i, f"http://{name}/{i}" if name else None, p) for h, (name, pages) in enumerate(sites.items()) for i, p in enumerate(pages)]


@pytest.mark.parametrize("chunk_bytes", [html_extract.CHUNK_BYTES, 30_000, 2_000])
def test_main_text_is_that_of_all_runs_counted(spark, rows, chunk_bytes):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.page_id: r for r in html_extract.main_text(df, chunk_bytes=chunk_bytes).collect()}
    assert len(got) == len(rows)
    for h in range(4):
        mine = [r for r in rows if r[0] // 100_000 == h]
        for (k, url, _), want in zip(mine, slow_texts([r[2] for r in mine]), strict=True):
            assert (got[k].text, got[k].url, got[k].n_chars) == (want, url, len(want))


def test_the_suffix_arrays_decide(spark, rows, monkeypatch):
    with_arrays = [t for t, _, _ in html_extract.extract([r[2] for r in rows if r[0] < 100_000])]
    monkeypatch.setattr(html_extract, "repeated", lambda streams, *least: [[s < 0 for s in streams] for _ in least])
    without = [t for t, _, _ in html_extract.extract([r[2] for r in rows if r[0] < 100_000])]
    assert sum(a != b for a, b in zip(with_arrays, without, strict=True)) > 200


def test_repeated_rows_in_many_chunks(spark):
    df = spark.createDataFrame([(1, "http://h/1", f"<article><p>{own(1, 40)}</p></article>")] * 300 + [(2, "http://h/2", f"<p>{own(2, 40)}</p>")], SCHEMA)
    got = html_extract.main_text(df.withColumn("host", df.url).withColumn("packed", df.url), chunk_bytes=1_000).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(1, own(1, 40))] * 300 + [(2, own(2, 40))]
    assert html_extract.main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize(
    "page",
    ["<article>" + "<b></i>" * 150_000 + "x", "<a href='" + "x y " * 500_000, "<a b='\"" * 100_000 + "<a b=\"'" * 100_000, "<" * 500_000, "<div>" * 100_000 + "a" + "</p>" * 100_000, "<title>" * 200_000 + "<!--" * 200_000, "<p class=" * 200_000],
)
def test_odd_pages_take_linear_time(page):
    began = time.time()
    blocks(page)
    assert time.time() - began < 8


def test_a_very_long_page_takes_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(blocks("<article class='open" + " " + "<p>word " * 2_500_000 + "'>")) <= 1
    assert len(blocks("<article>" + "word " * 4_000_000)[0][1]) == 19_999_999
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000


def test_markup():
    page = "<p>a &lt; b<br>c</p><p title='x>y'>d</p> 1 < 2 <3 </ x> <!-- c --><!doctype x><div hidden>no</div><div class=\"foo ad-box\">ad</div><img alt='q' />z<custom/>t<section role=main>m</section><p title='open>e"
    assert blocks(page) == [("open", "a < b c"), ("open", "d"), ("open", "1 < 2 <3"), ("open", "zt"), ("article", "m"), ("open", "e")]
