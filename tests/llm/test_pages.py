import pytest

from strandkeep.llm import page_text as P

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div id="top-ad">Buy</div>
<article class="post"><header><h1>A &amp; B</h1></header><p>One<br>two &lt;b&gt; <b>bold<p>Second&nbsp;  para<script>x</script></p><form><input>Sign up</form>
<ul><li>first<li>second</ul><table><tr><td>a</td><td>b</td></tr></table><!-- gone --><div class="comments"><p>Nice post!</p></div></article>
<aside>More</aside><section class="comment-list"><p>Reader says</p></section><footer>&copy; Site</footer></body></html>"""
TEXT = "A & B\n\nOne two <b> bold\n\nSecond para\n\nfirst\n\nsecond\n\na b"


def test_article_without_the_rest():
    assert P.extract(PAGE, set()) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &am text", "plain &am text"), ("<p>cut of<", "cut of<"), ("<p>cut <b", "cut"), ("</div><p>x</p></p>", "x"),
        ("<main><p>a</p></main><p>b</p>", "a"), ("<body><div><a href=1>x</a> <a href=2>y</a></div><p>text <a>z</a></p></body>", "text z"),
        ("<div hidden>no</div><div style='display: none'>no</div><p>yes</p>", "yes"), ("<article>x" + "<div>" * 3000 + "deep", "x\n\ndeep"),
        ("<article><p>&#233;t&eacute; &#x1F600;</p></article>", "été \U0001f600"), ("<textarea>never closed <p>a", "never closed\n\na"),
    ],
)
def test_odd_pages(page, text):
    assert P.extract(page, set()) == text


def test_template_is_counted_per_host(spark):
    rows = [(k, f"http://one.example/{k}", f"<body><div><p>Our motto</p></div><p>Body {k}</p><div><p>Both hosts</p></div></body>") for k in range(8)]
    rows += [(10, "http://two.example/1", "<body><div><p>Our motto</p></div><p>Only page</p></body>"), (11, None, None), (11, None, None), (12, "no url", "")]
    rows += [(20 + k, f"http://copies.example/{k}", "<body><p>The same page on every address</p></body>") for k in range(9)]
    got = {r.page_id: r.text for r in P.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Body 3" and got[10] == "Our motto\n\nOnly page" and got[11] == "" and got[12] == ""
    assert got[25] == "The same page on every address"


def test_paragraphs_quoted_in_articles_stay(spark):
    rows = [(k, f"http://one.example/{k}", f"<nav>Menu</nav><article><h1>{k}</h1><p>A line that all quote</p></article>", "x") for k in range(9)]
    got = P.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert all(r.text == f"{r.page_id}\n\nA line that all quote" for r in got) and len(got) == 9


def test_boxes_that_most_articles_of_a_host_hold_go(spark):
    box, quoted = "<div class='x7'><p>Read us daily</p></div>", "<p>A line that all quote</p>"
    rows = [(k, f"http://one.example/{k}", f"<article><div><p>Body {k}</p>{quoted}</div>{box if k < 7 else ''}</article>") for k in range(9)]
    rows += [(20 + k, f"http://two.example/{k}", f"<main><p>Body {k}</p>{box if k < 4 else ''}</main>") for k in range(9)]  # not most
    rows += [(40 + k, f"http://same.example/{k}", f"<nav>{k}</nav><article>{box}<p>One article everywhere</p></article>") for k in range(9)]
    rows += [(60 + k, f"http://three.example/{k}", f"<article><p>Body {k}</p>{box}</article>") for k in range(3)]  # too few
    got = {r.page_id: r.text for r in P.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Body {k}\n\nA line that all quote" for k in range(9))
    assert got[20] == "Body 0\n\nRead us daily" and got[60] == "Body 0\n\nRead us daily" and got[40] == "Read us daily\n\nOne article everywhere"


def test_query(spark, tiny):
    got = P.op5_page_text(spark, tiny)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) > 0 for r in got.collect())


def test_empty_table(spark):
    assert P.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def rows_of(spark, folder):
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]


def brute_templates(rows):
    """host -> (template, known) by counting every key in dictionaries."""
    seen, of = {}, {}
    for _, url, page in rows:
        host = (url or "").lower().split("://")[-1].split("/")[0].split(":")[0] if url and "://" in url else ""
        for key, page_, content in P.page_keys(page) if page else ():
            seen.setdefault((host, key), {}).setdefault((page_, content))
    for (host, key), found in seen.items():
        kind, n = key & 7, len(found)
        every = len(seen[host, kind])
        share = {P.OUTER: P.SHARE, P.BOX: P.INNER_SHARE, P.PARAGRAPH: P.PARAGRAPH_SHARE}.get(kind, P.SLOT_SHARE)
        least = P.LEAST_ARTICLES if kind == P.PARAGRAPH else P.LEAST_PAGES
        varied = kind == P.FREE and len({c for _, c in found}) > n * P.VARIETY
        if key != kind and n >= least and n >= every * share and not varied:
            of.setdefault(host, (set(), set()))[0].add(key)
            if kind == P.BESIDE:
                of[host][1].add(key)
    return of


def test_equals_brute_force_over_a_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = rows_of(spark, folder)
    want = brute_templates(rows)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    assert {r.host: (set(r.template), set(r.known)) for r in P.templates(pages).collect()} == want and want
    got = {r.page_id: r.text for r in P.op5_page_text(spark, folder).collect()}
    for page_id, url, page in rows:
        host = url.split("://")[1].split("/")[0]
        assert got[page_id] == P.extract(page, *want.get(host, (set(), set())))


def test_the_template_decides_the_text(spark):
    """On the given pages template removal alone, without a look at names, leaves the article; without it all pages of the counted hosts change."""
    rows = rows_of(spark, "/root/testdata/sf0.1")
    of = brute_templates(rows)
    right = changed = counted = 0
    for _, url, page in rows:
        template, known = of.get(url.split("://")[1].split("/")[0], (set(), set()))
        if known:
            counted += 1
            want = P.extract(page, set())  # by names
            right += P.extract(page, template, known, names=False) == want
            changed += P.extract(page, set(), known) != P.extract(page, template, known)
    assert counted > 0.9 * len(rows) and right == counted and changed == counted


def test_unnamed_template_inside_and_beside_articles(spark):
    note, quoted = "<section class=q9><p>Sign here for our letters</p></section>", "<p>A line that most quote</p>"
    article = "<article><h1>{k}</h1><p>Body {k}</p>{quoted}<p>More {k}</p><p>End {k}</p>{note}<p>Written for our readers</p></article>"
    page = "<body><div class=x1><p>Motto {m}</p></div>{article}<div class=x2>Elsewhere {k}</div></body>"
    rows = [(k, f"http://one.example/{k}", page.format(k=k, m=k % 3, article=article.format(k=k, note=note, quoted=quoted))) for k in range(20)]
    loose = "<body><div class=x1><p>Motto {m}</p></div><div class=x3><p>Body {k}</p></div><div class=x2><p>Seen {m}</p></div></body>"
    rows += [(100 + k, f"http://two.example/{k}", loose.format(k=k, m=k % 3)) for k in range(20)]
    got = {r.page_id: (r.text, r.n_template) for r in P.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == (f"{k}\n\nBody {k}\n\nA line that most quote\n\nMore {k}\n\nEnd {k}", 4) for k in range(20))
    assert all(got[100 + k] == (f"Body {k}", 2) for k in range(20))


@pytest.mark.parametrize("page", ["<div>{n}", "<article>{n}", "<p><b>{n}", "<ul><li><b>x{n}", "<a title='x>y{n}", '<a b="c" {n}', "<title>{n}", "<span>{n}</p>{n}"])
def test_time_is_linear_in_the_page(page):
    import time

    def took(n):
        began, head = time.process_time(), page.split("{n}")
        text = "".join(x * n for x in head)
        P.page_keys(text)
        P.extract(text, {1})
        return time.process_time() - began

    took(1000)
    assert took(100_000) < 25 * max(took(10_000), 0.05)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p><a title=it's>x</a> text one</p><p>text two</p>", "x text one\n\ntext two"), ("<p title='a>b'>x</p>", "x"), ("<p title=\"never>x</p><p>y</p>", "x\n\ny"),
        ("<p class = \"ad\">no</p><p class=ad>no</p><p CLASS='ad x'>no</p><p>yes", "yes"), ("a < b and <3 <p>c", "a < b and <3\n\nc"),
        ("<main><p>Text</p><div class=comments><article>Nice</article></div></main>", "Text"),
    ],
)
def test_attributes_and_loose_signs(page, text):
    assert P.extract(page, set()) == text
