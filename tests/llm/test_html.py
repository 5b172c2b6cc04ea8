from __future__ import annotations

from driftmark.llm import html
from tests.llm.tables import sorted_rows


def pages(spark, rows):
    return spark.createDataFrame(
        [(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, text string"
    )


def text_of(source):
    return "\n\n".join(t for t, _ in html.Page(source).main_blocks())


def test_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>no</p> -->
    <div class="cookie-notice">We use cookies</div><div class='ad'>Buy</div>
    <article><h1>Fish &amp; chips</h1><p><b>One\n  two.<br>three<p>Four &lt;5&gt; &#233;&euro;<aside>See also</aside>
    <form><input value=">"><p>Mail</p></form><ul><li>a<li>b</ul><blockquote>Said <i>so</i>.</blockquote>
    <section class="comments"><p>First!</p></section></article><footer>&copy; x</footer></body></html>"""
    assert text_of(page) == "Fish & chips\n\nOne two. three\n\nFour <5> é€\n\na\n\nb\n\nSaid so."


def test_broken_pages():
    assert text_of("") == "" and text_of("just text") == "just text"
    assert text_of("<article><p>a</b></article></div><p>out") == "a"
    assert text_of("<p>a<p>b</p></div><div>c") == "a\n\nb\n\nc"
    assert text_of("<article><p>cut &am") == "cut &am"
    assert text_of("<script>x") == "" and text_of("a < b <> c") == "a < b <> c"
    assert text_of("<!-- open") == "" and text_of("<p title='a>b'>t") == "t"
    assert text_of("<div>" * 5000 + "deep") == "deep"


def test_templates_of_a_host(spark):
    def page(i, host, extra=""):
        body = f"<div><div><b>Our shop</b> sells things</div>{extra}<p>Story {i} of {host}</p></div>"
        return (i, f"https://{host}/{i}", f"<body>{body}</body>")

    rows = [page(i, "a.example") for i in range(8)]
    rows += [page(i + 100, "b.example") for i in range(3)]
    rows += [(200 + i, "https://c.example", "<body><div>Same <p>page</p></div></body>") for i in range(50)]
    rows += [(300, None, None), (301, "not a url [", ""), (None, "https://a.example/x", "<p>t</p>")]
    got = {r.page_id: r for r in html.main_text(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i].text == f"Story {i} of a.example"
    assert got[101].text == "Our shop sells things\n\nStory 101 of b.example"
    # One article printed often is one article.
    assert got[205].text == "Same\n\npage"
    assert got[300].text == "" and got[300].n_chars == 0 and got[301].text == ""
    assert got[None].text == "t"


def test_template_on_one_page_in_a_hundred_of_a_large_host(spark):
    def page(i):
        notice = "<div>Strike news <b>here</b></div>" if i % 100 == 0 else ""
        wrap = "<article>{}</article>" if i % 200 == 0 else "<div>{}</div>"
        return (i, f"https://big/{i}", "<body>" + wrap.format(f"{notice}<p>Story {i}</p>") + "</body>")

    got = html.main_text(pages(spark, [page(i) for i in range(2000)])).collect()
    assert len(got) == 2000 and all(r.text == f"Story {r.page_id}" for r in got)


def test_names_inside_an_article(spark):
    body = """<h1>T{0}</h1><section id="related-work"><h2 id="social-impact">Impact {0}</h2>
    <p class="notice">Notice {0}</p><p>See <span class="share">shares</span></p></section>
    <div class="reply-to-critics">Critics {0}</div>{1}"""

    def page(i, host, extra):
        return (i, f"https://{host}/{i}", f"<article>{body.format(i, extra.format(i))}</article>")

    rows = [page(i, "a", '<div class="x comments">Comment {0}</div>') for i in range(6)]
    rows += [page(10 + i, "b", '<section class="related">Real {0}</section>') for i in range(2)]
    rows += [(20, "https://c/", '<h2 id="social-impact">H</h2><p class="notice">P</p><div class="notice">D</div>')]
    got = {r.page_id: r.text for r in html.main_text(pages(spark, rows)).collect()}
    own = "T{0}\n\nImpact {0}\n\nNotice {0}\n\nSee shares\n\nCritics {0}"
    for i in range(6):
        assert got[i] == own.format(i)
    for i in (10, 11):
        assert got[i] == own.format(i) + f"\n\nReal {i}"
    assert got[20] == "H\n\nP"


def test_articles_keep_repeated_paragraphs(spark):
    rows = [
        (i, "http://h/", f"<nav>m</nav><article><p>Always the same.</p><p>No. {i} 😀</p></article>") for i in range(30)
    ]
    got = sorted_rows(html.main_text(pages(spark, rows)), "page_id", "text", "n_chars")
    want = [(i, f"Always the same.\n\nNo. {i} 😀", 18 + len(f"No. {i} 😀")) for i in range(30)]
    assert got == sorted(want, key=repr)


def test_empty(spark):
    assert html.main_text(pages(spark, [])).count() == 0
