"""Main text of pages: hand-made HTML, and brute force over all pairs of pages."""

import html
import random

import numpy as np
import pytest

from wardcast.llm import html_blocks, page_text
from wardcast.llm.html_blocks import ARTICLE, FRAME, PLAIN
from wardcast.llm.shared import Scratch


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("", []),
        ("just  text\n\t here", [(PLAIN, "just text here")]),
        ("<p>a<b>b</b>c<br>d</p>", [(PLAIN, "abc d")]),
        ("<p><b>one.<br><p>two", [(PLAIN, "one."), (PLAIN, "two")]),
        ("<p>&lt;a&gt; &amp; &#233;&nbsp;x &quot &am", [(PLAIN, '<a> & é x " &am')]),
        ("<title>t</title><style>p{}</style><script>var t='</p>';</script>x", [(PLAIN, "x")]),
        ("<SCRIPT>never ends <p>a</p>", []),
        ("a<!-- <p>b</p> -->c<!-- never ends <p>d", [(PLAIN, "ac")]),
        ("<!DOCTYPE html><?xml x?>a<![CDATA[b]]>c", [(PLAIN, "ac")]),
        ("3 < 4 <5 > 2 <", [(PLAIN, "3 < 4 <5 > 2 <")]),
        ("<p title=\"a > b\" x='>'>in</p><a href=it's>out</a> <i title=\"never", [(PLAIN, "in"), (PLAIN, 'out <i title="never')]),
        ("<nav>m</nav><header>h</header><p>t</p><aside>s</aside><footer>f", [(FRAME, "m"), (FRAME, "h"), (PLAIN, "t"), (FRAME, "s"), (FRAME, "f")]),
        ("<nav><ul><li>a<li>b</nav>c", [(FRAME, "a"), (FRAME, "b"), (PLAIN, "c")]),
        ("<nav><b>a</nav>c</b>", [(FRAME, "a"), (PLAIN, "c")]),
        ("<article><header><h1>T</h1></header><p>x<footer>tags</footer><form>f</form></article>", [(ARTICLE, "T"), (ARTICLE, "x"), (FRAME, "tags"), (FRAME, "f")]),
        ('<article>x<div class="user-comments"><article>c</article></div>y</article>', [(ARTICLE, "x"), (FRAME, "c"), (ARTICLE, "y")]),
        ('<article>x <span class="ad">buy</span> y<article class="comment">c</article></article>', [(ARTICLE, "x y"), (FRAME, "buy"), (FRAME, "c")]),
        ('<span class="ad"><span>a</span> b</span> c', [(FRAME, "a b"), (PLAIN, "c")]),
        ('<p class="notice">a<p>b', [(FRAME, "a"), (PLAIN, "b")]),
        ("<form><p>f</p><main>in</main></form><aside><article>teaser</article></aside>", [(FRAME, "f"), (ARTICLE, "in"), (FRAME, "teaser")]),
        ('<div role="navigation">n</div><div role="main">t</div><div itemprop="articleBody">u</div>', [(FRAME, "n"), (ARTICLE, "t"), (ARTICLE, "u")]),
        ('<body class="has-sidebar nav-open"><div class="no-sidebar">a</div><div id="mainMenu">m</div>', [(PLAIN, "a"), (FRAME, "m")]),
        ('<div class="article-header">a</div><div class="page-header">b</div>', [(PLAIN, "a"), (FRAME, "b")]),
        ('<div class="address shadow">a</div><div hidden>b</div><div style="display: none">c</div>', [(PLAIN, "a")]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", [(PLAIN, "a"), (PLAIN, "b"), (PLAIN, "c")]),
        ("</p></div></nope>a</article>", [(PLAIN, "a")]),
    ],
)
def test_blocks(given, wanted):
    assert html_blocks.blocks(given) == wanted


def test_blocks_of_odd_and_large_pages():
    assert html_blocks.blocks("<b>" * 100_000 + "x") == [(PLAIN, "x")]
    assert html_blocks.blocks("<div><p>" * 20_000 + "x" + "</div>" * 20_000) == [(PLAIN, "x")]
    assert len(html_blocks.blocks("<a " * 100_000)) == 1
    assert html_blocks.blocks("<a href=\"" * 30_000 + ">x") == [(PLAIN, "x")]
    assert len(html_blocks.blocks("<p>word " * 200_000)) == 200_000


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def plain_page(blocks):
    return "<html><body>" + "".join(f"<div>{html.escape(b)}</div>" for b in blocks) + "</body></html>"


def brute(rows):
    """``rows`` (page_id, host, html, blocks of the stream, article or None): (page_id, text, outer, repeated)."""
    k = page_text.LEAST

    def runs(blocks):
        t = " ".join(blocks).split()
        return [tuple(t[i : i + k]) for i in range(max(len(t) - k + 1, min(len(t), 1)))]

    def marks(row, pages):
        """Which tokens of the row lie in runs that two distinct ones of ``pages`` have."""
        n = len(" ".join(row[3]).split())
        hit = np.zeros(n, bool)
        for i, run in enumerate(runs(row[3])):
            if len({p[2] for p in pages if p[1] == row[1] and run in p[4]}) > 1:
                hit[i : i + k] = True
        return hit

    rows = [(*r, runs(r[3])) for r in rows]
    pages = [(r[0], r[1], r[2], r[3], set(r[5]), r[4]) for r in rows if r[1]]
    told = [p for p in pages if p[5] is not None or 100 * (~marks(p, pages)).sum() >= 20 * len(" ".join(p[3]).split())]
    out = []
    for r in rows:
        hit = marks(r, told) if r[1] else np.zeros(len(" ".join(r[3]).split()), bool)
        text, at = r[4], 0
        if text is None:
            kept = []
            for b in r[3]:
                n = len(b.split())
                if not hit[at : at + n].all():
                    kept.append(b)
                at += n
            text = " ".join(kept)
        out.append((r[0], text, len(hit), int(hit.sum())))
    return out


def case(seed):
    r = random.Random(seed)
    rows, page = [], 0
    for h in range(4):
        frames = [words(r, r.randint(1, 12)) for _ in range(5)]
        copied = [words(r, 30), words(r, 25)]
        for _ in range(r.choice((2, 6, 12))):
            some = r.sample(frames, r.randint(1, 5))
            kind = r.random()
            if kind < 0.3:  # a marked article, in places with a frame's text in it
                article = " ".join([words(r, 20), frames[0]])
                text = "<nav>" + "</nav><nav>".join(some) + f"</nav><article><p>{article}</p></article>"
                rows.append((page, f"h{h}.org", text, some, article))
            else:
                body = copied if kind < 0.6 else [words(r, r.randint(1, 40)), words(r, 12)]
                if kind < 0.4:
                    body = [body[0].replace(body[0].split()[7], "other"), body[1]]  # a near copy
                blocks = some[:2] + body + some[2:]
                rows.append((page, f"h{h}.org", plain_page(blocks), blocks, None))
            page += 1
    rows.append((*rows[0][:1], *rows[0][1:]))  # a row twice
    rows.append((None, None, rows[1][2], rows[1][3], rows[1][4]))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, tmp_path, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(page_text, "MOST_BROADCAST", -1)
    rows = case(seed)
    given = [(p, f"https://u@{h.upper()}:80/{p}?q#f" if h else None, t, "x", 1) for p, h, t, _, _ in rows]
    pages = spark.createDataFrame(given, "page_id bigint, url string, html string, text string, n int").repartition(3)
    got = page_text.main_text(pages, Scratch(spark, str(tmp_path))).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    found = sorted(((r["page_id"], r["text"], r["n_outer"], r["n_repeated"]) for r in got), key=key)
    assert found == sorted(brute(rows), key=key)
    assert any(0 < x[3] for x in found)


def test_frames_go_and_copied_articles_stay(spark, tmp_path):
    r = random.Random(9)
    menu, notice, article = words(r, 6), words(r, 9), [words(r, 40), words(r, 40)]
    pages = [(i, "http://a.b/", plain_page([menu, words(r, 30), notice])) for i in range(5)]
    pages += [(10 + i, "http://a.b/", plain_page([menu, *article, notice, f"page {i}"])) for i in range(4)]
    pages += [(20, "http://c.d/", plain_page([menu, article[0]])), (21, "no url", plain_page([menu, article[0]]))]
    got = page_text.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string"), Scratch(spark, str(tmp_path)))
    text = {r["page_id"]: r["text"] for r in got.collect()}
    assert all(menu not in text[i] and notice not in text[i] and len(text[i].split()) == 30 for i in range(5))
    assert all(text[10 + i] == " ".join([*article, f"page {i}"]) for i in range(4))
    assert text[20] == text[21] == f"{menu} {article[0]}"


def test_nulls_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None), (None, "http://a/", ""), (3, "http://a/", "<script>x</script>"), (3, "http://a/", "<p>one"), (4, "http://a/", "<p>one")]
    form = "page_id bigint, url string, html string"
    got = page_text.main_text(spark.createDataFrame(rows, form), Scratch(spark, str(tmp_path))).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"], r["n_outer"], r["n_repeated"]) for r in got) == [
        (0, "", 0, 0, 0),
        (1, "", 0, 0, 0),
        (3, "", 0, 0, 0),
        (3, "one", 3, 1, 0),
        (4, "one", 3, 1, 0),
    ]
    empty = page_text.main_text(spark.createDataFrame([], form), Scratch(spark, str(tmp_path)))
    assert empty.collect() == [] and empty.columns == ["page_id", "url", "text", "n_chars", "n_outer", "n_repeated"]


def test_long_pages(spark, tmp_path):
    r = random.Random(3)
    shared = words(r, 50)
    long = [words(r, 20) for _ in range(20_000)]
    pages = [(1, "http://a/", plain_page([shared, *long])), (2, "http://a/", plain_page([shared, *(words(r, 20) for _ in range(9))]))]
    got = page_text.main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string"), Scratch(spark, str(tmp_path)))
    assert {r["page_id"]: r["text"] for r in got.collect()}[1] == " ".join(long)
