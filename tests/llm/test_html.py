import re
from html import unescape

from lodforge.llm import html
from lodforge.llm.common import table


def plain(page):
    """The article of the generated pages by direct cutting."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", inside))
    return "\n\n".join(p for p in parts if p)


def test_generated_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    pages_in = {r["page_id"]: r["html"] for r in pages.collect()}
    found = html.extract_pages(pages).collect()
    assert len(found) == len(pages_in)
    for r in found:
        assert r["text"] == plain(pages_in[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_regions_without_article():
    page = """<body class="x"><header><h1>Site</h1></header><ul class=menu><li>a<li>b</ul><div id="cookie-notice">We use cookies to make this page work as well as it can.</div>
    <div class="content"><h2>Title &amp; more</h2><p>Long paragraph one with many words in it, really quite long indeed.<p>Short.<div class="adBox">buy</div>
    <p>Another <b>long</b>&nbsp;paragraph   here\nwith lots of text so that it counts.</div><section class="comments"><p>I agree with it all very much, thanks for the nice article!</p></section>
    <form><label>Mail</label></form><footer>bye</footer>"""
    assert html.main_text(page) == "Title & more\n\nLong paragraph one with many words in it, really quite long indeed.\n\nShort.\n\nAnother long paragraph here with lots of text so that it counts."


def test_nested_and_broken_markup():
    page = "<main><article><header><h1>Head</h1></header><p>One<br>two <script>x='<p>no</p>'</script>three<p>Be.</p><aside>side</aside><article class=comment><p>me too</p></article></article></main><nav>x"
    assert html.main_text(page) == "Head\n\nOne two three\n\nBe."
    assert html.main_text("<div><p>only text, &lt;kept&gt; &eacute;&#x41;") == "only text, <kept> éA"


def test_cases(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (3, "u", "<nav>all menu</nav>"), (None, "u", "no markup at all"), (4, "u", "<p>" + "long " * 50000)]
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", html.F.lit("old")))
    got = {(r["page_id"], r["n_chars"]) for r in out.collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (None, 16), (4, 249999)} and out.count() == 6
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_nothing_beside_the_body_is_lost():
    intro, body = "An introduction of some words about it. " * 4, "The body goes on for quite a while here. " * 24
    page = f"<body><h1>Title</h1><div>{intro}</div><div><p>{body}</p></div></body>"
    assert html.main_text(page) == "\n\n".join(["Title", intro.strip(), body.strip()])
    for tag in ("blockquote", "li", "td", "pre"):
        page = f"<body><div><p>Before.</p><{tag}>{body}</{tag}><p>After.</p></div></body>"
        assert html.main_text(page) == f"Before.\n\n{body.strip()}\n\nAfter."
    page = f"<body><article><p>{body}</p><p>{body}</p></article><hr><hr><hr><article><b>S</b><i>h</i><b>o</b><i>r</i>t.</article></body>"
    assert html.main_text(page) == "\n\n".join([body.strip(), body.strip(), "Short."])


BODY = "The body of the page goes on for quite a while, as prose does. " * 8


def test_marks_alone_empty_no_page():
    for opening, closing in (('<div class="content no-sidebar">', "</div>"), ('<article class="post has-sidebar">', "</article>"), ('<div class="share-price-report">', "</div>"), ("<form>", "</form>"), ('<div class="widget">', "</div>"), ('<span class="nav-wrapper">', "</span>")):
        assert html.main_text(f"<body><nav><a>Home</a></nav>{opening}<h1>Title</h1><p>{BODY}</p><p>End.</p>{closing}<footer>bye</footer></body>") == f"Title\n\n{BODY.strip()}\n\nEnd.", opening
    inside = f'<article><h2 class="section-header">Part</h2><p>{BODY}</p><div class="search-results-analysis">Results of it.</div></article>'
    assert html.main_text(inside) == f"Part\n\n{BODY.strip()}\n\nResults of it."
    assert html.main_text(f"<body><p>{BODY}</p><a>Home</a><a>News</a><p>{BODY}</p></body>") == "\n\n".join([BODY.strip()] * 2)
    assert html.main_text('<div class="ad">A long advert that says more than the page does, by far.</div><article><h1>Short</h1></article>') == "Short"


def pages_without_articles():
    """Bodies, side columns and teasers that nothing but their ratios tells apart."""
    for k in range(40):
        links = "".join(f"<li>x{i} <b>y</b></li>" for i in range(6 + k % 9))
        body = "".join(f"<p>{BODY[: 90 + 37 * ((k + j) % 5)]}</p>" for j in range(3 + k % 4))
        teaser = "<article><b>See</b> <i>also</i></article>" if k % 2 else ""
        yield f"<body><div><div><ul>{links}</ul></div><div><h1>Title {k}</h1>{body}</div>{teaser}<div><ul>{links}</ul></div></div></body>", f"Title {k}", 3 + k % 4


def test_ratios_choose_the_region(monkeypatch):
    def right():
        found = [(html.main_text(page).split("\n\n"), title, n) for page, title, n in pages_without_articles()]
        return sum(blocks[0] == title and len(blocks) - ("See also" in blocks) == n + 1 for blocks, title, n in found)

    assert right() == 40
    draw = html.np.random.default_rng(1)
    monkeypatch.setattr(html, "smooth", lambda ratios: draw.random(len(ratios)))
    assert right() < 20


def test_deep_pages_take_linear_time():
    import time

    for page in ("<div>word " * 50_000, "<b>x" * 50_000 + "<p>y" * 5_000, "<div><i>" + "<b>x</i>" * 50_000):
        began = time.time()
        assert html.main_text(page)
        assert time.time() - began < 20
