"""HTML extraction and link rules on small pages."""

from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.operators import extract as X
from newsloom.operators import links as L


def value(spark, page, expression):
    frame = spark.createDataFrame([(page,)], "html string")
    return frame.select(expression(F.col("html")).alias("v")).first().v


def pages(spark, *rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_nested_elements_are_matched(spark):
    page = '<div class="x content"><div>a</div><p>b</p><div/>c<div><div>d</div></div></div>tail'
    inner = value(spark, page, lambda c: H.element(c, "div", H.class_contains("content")))
    assert inner == "<div>a</div><p>b</p><div/>c<div><div>d</div></div>"


def test_unclosed_element_runs_to_the_end(spark):
    assert value(spark, "<article><p>a<p>b", lambda c: H.element(c, "article")) == "<p>a<p>b"
    assert value(spark, "<main></main>", lambda c: H.element(c, "article")) is None
    assert value(spark, "<articles>no</articles>", lambda c: H.element(c, "article")) is None


def test_node_text_strips_each_node(spark):
    page = "<p> a <b>b&nbsp;</b><!-- no --> c  d</p><script>x</script>\n<p></p>e"
    assert value(spark, page, lambda c: H.node_text(H.without_noise(c), " ")) == "a b c  d e"
    assert value(spark, page, lambda c: H.node_text(H.without_noise(c), "")) == "abc  de"


def test_tags_with_quoted_angle_brackets(spark):
    assert value(spark, '<p title="a > b">x</p>', lambda c: H.node_text(c, " ")) == "x"
    assert value(spark, "<p title=it's>x</p>", lambda c: H.node_text(c, " ")) == "x"


def test_clean_text(spark):
    page = "<style>p{}</style><h1>A&amp;B</h1>\n <p>c&eacute;\xa0 d</p>"
    assert value(spark, page, H.clean_text) == "A&B cé d"


def test_inner_text_lines(spark):
    assert value(spark, "a <b>b</b>\n c<br>d<div>e</div><p>f</p><p>g</p>", H.inner_text) == "a b c\nd\ne\n\nf\n\ng"


def test_fallback_fields(spark):
    long = "word " * 60
    rows = pages(
        spark, ("u1", f"<h2> Two </h2><h1>One</h1><main>{long}</main><time> 2025 </time>"),
        ("u2", f'<h1>One</h1><div class="my-content"><div>{long}</div>{long}</div>'),
        ("u3", "<h1>One</h1><article>short</article>"))
    got = {r.article_url: r for r in X.extract_fallback(rows).collect()}
    assert set(got) == {"u1", "u2"}
    assert (got["u1"].headline, got["u1"].date) == ("Two", "2025")
    assert len(got["u2"].content) == 2 * len(long.strip()) + 1
    assert len(X.extract_fallback(rows, only_usable=False).collect()) == 3


def test_rendered_headline_and_date_priorities(spark):
    page = ('<meta property="og:title" content="Meta &amp; title"><h1> </h1><h3>Third</h3>'
            '<meta name="pubdate" content=""><span class="post-date"> May 1 </span>')
    assert value(spark, page, X.headline_rendered) == "Third"
    assert value(spark, page, X.date_rendered) == "May 1"
    assert value(spark, page.replace("<h3>Third</h3>", ""), X.headline_rendered) == "Meta & title"
    assert value(spark, '<meta content="d" property="article:published_time">', X.date_rendered) == "d"


def test_rendered_content_first_long_else_last(spark):
    long = "x" * 201
    assert value(spark, f'<article>a</article><div class="body">{long}</div>', X.content_rendered) == long
    assert value(spark, '<article>a</article><main>m</main>', X.content_rendered) == "m"
    assert value(spark, "plain", X.content_rendered) == ""
    assert value(spark, f"<article>{long}</article><main>m</main>", X.content_rendered) == long


def test_listing_fields(spark):
    page = ('<h2>H</h2><main>m</main><div class="entry-content">e<div>f</div></div>'
            '<span class="podcastHeader-date">07.08.25</span>')
    assert value(spark, page, X.content_listing) == "m"
    assert value(spark, page.replace("main", "section"), X.content_listing) == "e\nf"
    assert value(spark, page, lambda c: X.date_listing(c, F.lit(""))) == "07.08.2025"
    assert value(spark, page, lambda c: X.date_listing(c, F.lit("01.01.2024"))) == "01.01.2024"


def test_main_text_leaves_navigation_out(spark):
    page = "<title>T</title><body><nav>n</nav><p>a</p><footer>f</footer><p>b</p></body>"
    row = X.extract_main(pages(spark, ("u", page))).first()
    assert (row.headline, row.content) == ("T", "a\nb")


BASE = "https://www.example.com/x/"


def links(spark, hrefs, operator):
    anchors = "".join(f'<a href="{h}">t</a>' for h in hrefs)
    return {r.article_url for r in operator(pages(spark, (BASE, f"<body>{anchors}</body>"))).collect()}


HREFS = ["/news/a", "https://www.example.com/b.html", "https://www.example.com/b", "https://other.example.org/?r=www.example.com",
         "https://www.example.com/news/a#top", "/login", "mailto:x@www.example.com"]


def test_static_links(spark):
    assert links(spark, HREFS, L.static_links) == {"https://www.example.com/news/a", "https://www.example.com/b.html"}


def test_fallback_links(spark):
    assert links(spark, HREFS, L.fallback_links) == {
        "https://www.example.com/b.html", "https://www.example.com/b", "https://other.example.org/?r=www.example.com"}


def test_rendered_links_by_class_heading_and_parent(spark):
    page = ('<a class="article-links" href="p1">x</a><a href=p2><h3>x</h3></a>'
            '<div class="card-title"><span>s</span><a href="/p3?a=1&amp;b=2">x</a></div>'
            '<div class="card-title"></div><a href="p4">x</a><a>no href</a><a href="">x</a>'
            '<!-- <a href="/news/no">x</a> --><a href="#/news/">x</a><a href="/news/y">y</a><a href="/2024/z">z</a>')
    got = {r.article_url: r.pos for r in L.rendered_links(pages(spark, (BASE, page))).collect()}
    assert set(got) == {BASE + "p1", BASE + "p2", "https://www.example.com/p3?a=1&b=2", "https://www.example.com/news/y"}
    with_years = {r.article_url for r in L.rendered_links(pages(spark, (BASE, page)), True).collect()}
    assert with_years - set(got) == {"https://www.example.com/2024/z"}


def test_teaser_parent_and_first_position(spark):
    page = ('<ul class="teaser list"><li>x</li><b>y</b><a href="/q">q</a></ul><a href="/q">q</a>'
            '<p class="teaser"><a href="/r">r</a><p><a href="/s">s</a>')
    got = {r.article_url: r.pos for r in L.static_links(pages(spark, (BASE, page))).collect()}
    assert got == {"https://www.example.com/q": 0, "https://www.example.com/r": 2}


def test_card_links(spark):
    page = ('<div class="card a"><div class="card-info"><b>x</b> 07.08.2025</div><a class="article-links" href="/1">t</a>'
            '<div><a class="x article-links" href="2">t</a></div></div><a class="article-links" href="/3">t</a>'
            '<div class="cards"><a class="article-links" href="/4">t</a></div>'
            '<div class="card"><a class="article-links" href="/1">t</a><a class="other" href="/5">t</a></div>')
    got = {r.article_url: r.listing_date for r in L.card_links(pages(spark, ("https://h/", page))).collect()}
    assert got == {"https://h/1": "07.08.2025", "https://h/2": "07.08.2025", "https://h/3": "", "https://h/4": ""}
