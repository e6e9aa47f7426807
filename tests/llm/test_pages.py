import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesseral.llm import pages


def text(html):
    return pages.main_text(pages.blocks_of(html), set())


def test_article_without_its_surroundings():
    html = (
        '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{a:b}</style><script>var t="</p>";</script></head><body>'
        "<header><h2>Site</h2></header><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- no > text -->"
        '<div class="ad">Buy <div>now</div> this</div><div id="cookie-notice">We use cookies<p>OK</p></div>'
        "<article><header><h1>Title&nbsp;&eacute;&#233;&#x1F600;</h1></header><p>One <b>bold</b><br>line\n\t two.<p>Next &lt;p&gt; &copy;"
        '<form><input name=a><button>Send</button></form><aside>Aside</aside><p class="advert">Gone<p>Stays'
        '<section class="comments"><h3>Comments</h3><article class="comment"><p>Nice</p></article></section>'
        "<ul><li>a<li class=promo>b<li>c</ul></article><div class='sidebar'>Side</div><footer>&copy; us</footer></body></html>"
    )
    assert text(html) == "Title éé😀\nOne bold line two.\nNext <p> ©\nStays\na\nc"


def test_names_of_furniture():
    for name in ("sidebar-left", "site-footer", "topnav", "mainMenu", "cookie-consent", "post__comments", "adBox", "share-buttons", "related-posts", "breadcrumbs", "newsletter_signup"):
        assert text(f'<article><p>A</p><div class="{name}">x</div><p>B</p></article>') == "A\nB", name
        assert text(f"<body><p>A</p><section id={name}><p>x</p></section></body>") == "A", name
    for name in ("article-header", "lead", "adagio", "headline", "entry-content", "shadow", "menuett-text"):
        assert text(f'<article><p>A</p><div class="{name}">x</div></article>') == "A\nx", name


def test_pages_that_break_off():
    assert text("<html><body><article><p>Half a pa") == "Half a pa"
    assert text("<html><body><article><p>Half <scr") == "Half"
    assert text("<article><p>A</p><script>x = '<p>") == "A"
    assert text("<article><p>A<div class=ad>x</article><p>B") == "A"
    assert text("<article><p>A &am") == "A &am"
    assert text("") == text("<!-- ") == text("<article></article>") == ""
    assert text("plain 1 < 2 text") == "plain 1 < 2 text"
    assert text("<main><p>M</p></main><p>x</p>") == "M"


@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.integers(0, 4), max_size=30))
@settings(max_examples=300, deadline=None)
def test_common_lines_are_a_longest_common_subsequence(a, b):
    whole = pages.TABLE_BITS
    for bits in (whole, 8):
        pages.TABLE_BITS = bits
        try:
            check_common_lines(a, b)
        finally:
            pages.TABLE_BITS = whole


def check_common_lines(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    found = pages.common_lines(a, b)
    assert len(found) == best[-1][-1] and found == sorted(set(found))
    rest = iter(b)
    assert all(any(y == a[i] for y in rest) for i in found)


def test_partners_are_the_nearest_neighbours_whatever_the_partitions(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c"]), f"/{rng.choice('xyz')}/{rng.randrange(50)}") for i in range(200)] + [(999, "alone", "/")]
    from tesseral.llm.common import Scratch

    found = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        keys = spark.createDataFrame(rows, "page_id long, host string, path string")
        found.append({r.page_id: r.partner for r in pages.nearest_pages(keys, Scratch(spark, "t")).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and 999 not in found[0] and len(found[0]) == 200

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    order = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    for k, (i, host, path) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][1] == host]
        if near:
            assert found[0][i] == min(near, key=lambda r: edit(path, r[2]))[0]


def test_shared_lines_go_where_no_article_is_marked(spark):
    page = "<body><div>Site name</div><div>{}</div><p>{}</p><div>All rights</div></body>"
    rows = [
        (1, "http://h.example/a/1", page.format("same", "one")),
        (2, "http://h.example/a/2", page.format("same", "two")),
        (3, "http://h.example/z", page.format("z", "three")),
        (4, "http://other.example/a", page.format("same", "four")),
        (5, "http://copy.example/a", "<p>twin</p>"),
        (6, "http://copy.example/b", "<p>twin</p>"),
        (7, None, "<p>no url</p>"),
        (8, "http://h.example/n", None),
        (9, "nonsense", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("lines", F.lit(2))
    got = {r.page_id: (r.text, r.n_chars) for r in pages.extract(df).collect()}
    assert got[1] == ("one", 3) and got[2] == ("two", 3)
    assert got[4][0] == "Site name\nsame\nfour\nAll rights"
    assert got[5][0] == got[6][0] == "twin"
    assert got[7] == ("no url", 6) and got[8] == got[9] == ("", 0)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract(empty).collect() == []


def test_a_very_long_page():
    html = "<article>" + "<p>word &amp; more</p>" * 50_000 + "<" * 20_000 + "<a '" * 3000
    assert text(html).startswith("word & more\nword & more")


def test_few_kinds_of_lines_are_aligned_in_time():
    import time

    rng = random.Random(1)
    a, b = ([rng.randrange(3) for _ in range(8000)] for _ in range(2))
    start = time.process_time()
    found = pages.common_lines(a, b)
    assert len(found) > 5000 and time.process_time() - start < 5


def test_names_that_tell_a_state_or_hold_the_article():
    article = "<article class='{}'><p>A</p></article>"
    for name in ("post comments-open", "has-sidebar", "hentry post-12 sidebar-closed"):
        assert text(article.format(name)) == "A", name
    for name in ("comment", "comment-item", "teaser card", "related-post"):
        assert text(article.format(name) + article.format("post").replace("A", "B")) == "B", name
    for before in ('<div class="overflow-hidden">', '<div class="content has-sidebar">', '<form action="/x">', '<div id="modal-root"><div class="widget">'):
        assert text(f"<nav>x</nav>{before}<article><p>A</p></article></div></form>") == "A", before
    assert text('<div class="sidebar"><p>S</p></div><article><p>A</p></article>') == "A"
    assert pages.main_text(pages.page_blocks('<body><div class="modal"><p>All there is</p></div></body>'), set()) == "All there is"


def test_rows_that_repeat(spark):
    page = "<body><div>Site name</div><p>{}</p></body>"
    rows = [(1, "http://h.example/a", page.format("one")), (1, "http://h.example/b", page.format("two")), (1, "http://h.example/a", page.format("one")), (None, "http://h.example/c", page.format("three")), (2, None, None)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or -1, r.text) for r in got) == [(-1, "three"), (1, "one"), (1, "one"), (1, "two"), (2, "")]


def test_lines_that_most_pages_share_go_from_marked_articles(spark):
    page = "<nav>x</nav><article><h1>{0}</h1><p>{1}</p><p>{0} more</p><p>{0} end</p><p>Read our other stories</p></article>"
    rows = [(i, f"http://h.example/{i}", page.format(f"t{i}", "common" if i < 2 else f"own {i}")) for i in range(5)]
    rows += [(10 + i, f"http://copy.example/{i}", page.format("same", "same text")) for i in range(3)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == f"t{i}\n{'common' if i < 2 else f'own {i}'}\nt{i} more\nt{i} end"
    assert {got[10 + i] for i in range(3)} == {"same\nsame text\nsame more\nsame end\nRead our other stories"}
