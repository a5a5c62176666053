import random

import pytest

from tonegauge.llm import style_tree as S

SCHEMA = "page_id long, url string, html string, host string, low int"


def text(source):
    return "\n".join(t for _, t in S.Page(source).candidates())


@pytest.mark.parametrize("source,want", [
    ("", ""),
    ("plain &amp; <b>bold</b>\n\ttext", "plain & bold text"),
    ("<p>one<p>two<br>more</p>three", "one\ntwo more\nthree"),
    ("<article><h1>T&eacute;st</h1><p><b>open <br><p>next</article>after", "Tést\nopen\nnext"),
    ("<body><nav><ul><li><a href=x>menu</a></ul></nav><article><p>a</p></article><footer>f</footer>", "a"),
    ("<script>var t=\"</p>\";</script><style>p{}</style><!-- <p>no</p> --><p>yes", "yes"),
    ("<div class='ad top'>buy</div><div id=cookie-notice>c</div><div class=text>t</div><form>f</form>", "t"),
    ("<main><p>x</p><section class=\"comments\"><p>first!</p></section><aside>s</aside></main>", "x"),
    ("<article><header><h1>Title</h1></header><p>body</article><header>site</header>", "Title\nbody"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
    ("<p title='a>b'>x</p><p title=\"unclosed>y</p>", "x\ny"),
    ("<p>1 < 2 &lt; 3 &#65;&#x42;&nbsp;C", "1 < 2 < 3 AB C"),
    ("<title>T</title><textarea>no</textarea><p>unclosed <script>x", "unclosed"),
])
def test_blocks(source, want):
    assert text(source) == want


def page(r, i, body=None):
    p = body or "".join(f"<p>{' '.join(str(r.random()) for _ in range(9))}</p>" for _ in range(r.randint(1, 5)))
    return f"<html><body><div class=strap>We value your visit</div><div class=text><h2>n {i}</h2>{p}</div><div class=strap2>all rights</div></body></html>"


def run(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA).repartition(3)
    return {r.page_id: (r.text, r.n_chars) for r in S.main_texts(df).collect()}


def test_same_branches_of_a_site_go(spark):
    r = random.Random(1)
    rows = [(i, f"http://a.example/{i}", page(r, i)) for i in range(30)]
    rows += [(100 + i, f"http://b.example/{i}", page(r, i)) for i in range(3)]
    copy = page(r, 0, "<p>copied text</p>")
    rows += [(200 + i, f"http://c.example/{i}", copy) for i in range(40)]
    rows += [(300, None, "<p>x"), (301, "http://a.example/n", None), (302, "::", ""), (303, "http://a.example/l", "<p>" + "long &amp; " * 100000)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    for i in range(30):
        assert got[i][0].startswith(f"n {i}\n0.") and "visit" not in got[i][0] and "rights" not in got[i][0]
    assert got[100][0].startswith("We value")          # too few pages to tell
    assert all("copied text" in got[200 + i][0] for i in range(40))  # copies are one page
    assert (got[300], got[301], got[302]) == (("x", 1), ("", 0), ("", 0))
    assert got[303][1] == len("long & ") * 100000 - 1
    assert run(spark, []) == {}


def test_articles_of_the_test_pages_stay_whole(spark):
    import re
    from html import unescape
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in S.main_texts(df).collect()}
    for r in df.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        plain = unescape(re.sub(r"<[^>]*>", " ", body))
        assert got[r.page_id].split() == plain.split()


@pytest.mark.parametrize("source,want", [
    ("<div class=page-header>h</div><div class=text>t</div><div class='page-sidebar x'>s</div><div id=page-nav>n</div><div class=\"page-footer\">f</div>", "t"),
    ("<div class='has-sidebar no-comments'><div class=page-nav>n</div><article><p>a</p></article></div>", "a"),
    ("<div class=page-header>h<div>i</div></div><div class=page-with-sidebar><main><p>m</p></main></div>", "m"),
])
def test_layout_words_count_on_wrappers_only(source, want):
    assert text(source) == want


def test_hosts_of_few_pages_lose_what_repeats(spark):
    r = random.Random(2)
    rows = [(100 * n + i, f"http://h{n}.example/{i}", page(r, i)) for n in (4, 5, 7) for i in range(n)]
    got = run(spark, rows)
    for k, (x, _) in got.items():
        assert x.startswith(f"n {k % 100}\n0.") and "visit" not in x and "rights" not in x
