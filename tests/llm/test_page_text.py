import html
import re

from tests.llm.fixtures import corpus
from tidemark.llm import page_text as P

SCHEMA = "page_id long, url string, html string"


def wanted(page):
    """The blocks of the page's <article>; the test pages have plain markup."""
    m = re.search(r"<article>(.*)</article>", page or "", re.S)
    if not m:
        return ""
    body = re.sub(r"<!--.*?-->", "", m[1], flags=re.S)
    blocks = re.split(r"</?(?:p|h[1-6]|ul|li|div)\b[^>]*>", re.sub(r"<br>", " ", body))
    clean = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks)
    return "\n".join(b for b in clean if b)


def test_corpus(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in P.op5(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    pages = corpus(sf, "pages")
    assert len(got) == len(pages)
    for p in pages:
        r = got[p["page_id"]]
        assert r["text"] == wanted(p["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == p["url"]


def test_best_part_against_all_parts():
    """The linear scan finds the largest sum of all contiguous parts."""
    page = "<body><nav><a>Home page</a></nav><div class=ad>Buy this now</div><p>One two three.</p><p>Four <b>five</b></p><table><tr><td>x</table><p>six</p><footer>legal words</footer>"
    scores = [P.weight({}, k, t, c, n) * (len(t.split()) if k == "text" else 1) for k, t, c, n, _ in P.tokens(page)]
    best = max(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))
    text = P.extract(page, {})
    assert best > 0 and text.startswith("One two three.\nFour five") and "legal" not in text and "Home" not in text


def test_markup():
    w = {}
    page = """<html><head><title>T</title><script>if (a<b) "</p>"</script><style>p{}</style></head><body><!-- <p>no</p> -->
    <header>Site name</header><main><h1>Head &amp; &#8212; line</h1><p>a&nbsp;b <i>c</i><br>d\n\t e &lt;f&gt; and more words here to weigh
    <p>second paragraph without an end<ul><li>one item<li>two items</ul><form><input name=q>Search me</form>
    <div class="comments"><p>A reader says so</p></div><p>last words of the article here</p></main><footer>&copy; us</footer></body>"""
    assert P.extract(page, w).split("\n") == ["Head & — line", "a b c d e <f> and more words here to weigh", "second paragraph without an end", "one item", "two items", "last words of the article here"]


def test_marks_do_not_empty_pages():
    """Classes of layouts, slugs of headings and wrappers leave the article whole."""
    body = "<h1>Head line</h1><p>First words of the text.</p><p>More words of it here.</p>"
    text = "Head line\nFirst words of the text.\nMore words of it here."
    side = "<div class='sidebar'><p>Buy this</p></div><div class='site-footer'>legal words</div>"
    for page in (
        f"<body class='single no-sidebar search'>{body}{side}</body>",
        f"<div class='page has-sidebar'>{body}{side}</div>",
        f"<div class='layout-with-nav'>{body}</div>{side}",
        f"<body><form id=aspnet>{body}{side}</form></body>",
        f"<div class=widget><div class='sidebar'><article>{body}</article></div>{side}</div>",
        f"<div class='search'><main>{body}</main><p>other hits</p></div>{side}",
    ):
        assert P.extract(page, {}) == text, page
    parts = "<section id='related-work'><h2 id='search-algorithms'>Search</h2><p>Some of it.</p></section><div id='social-history'><p>Old times.</p></div><section id=search><p>How to find.</p></section>"
    assert P.extract(f"<article>{body}{parts}{side}</article>", {}) == text + "\nSearch\nSome of it.\nOld times.\nHow to find."


def test_marks_with_most_words_beside_the_article():
    page = f"<article><h1>Head of it</h1><p>Three words more</p></article><div class=comments>{'<p>I think so too</p>' * 20}</div>"
    assert P.extract(page, {}) == "Head of it\nThree words more"


def test_marks_are_learned():
    """A mark that wraps the content of labelled pages does not hold on others; one that does not keeps holding."""
    labelled = ["<div class=widget><article><p>one two three four</p></article></div><div class=promo><p>buy</p></div><h1>Site</h1>" + "<p>x y z</p>" * 5] * 3
    w = P.learn(labelled)
    assert w["mark widget"] > 0 > w["mark promo"]
    page = "<h1>Site</h1><div class=widget><p>one two three four five six</p></div><div class=promo><p>buy</p></div>" + "<p>x y z</p>" * 4
    assert "one two" in P.extract(page, w | {"word in p": 1.0}) and "buy" not in P.extract(page, w | {"word in p": 1.0})
    assert "one two" not in P.extract(page, {})


def test_awkward(spark):
    pages = [None, "", "   ", "plain words only", "<", "<p", "<!-- open", "<p title=\"x", "<b>" * 3000 + "deep", "<div>" * 3000 + "deep text", "&#0; &bogus; &amp", "<p>x</p>" * 2000]
    rows = [(i, None, p) for i, p in enumerate(pages)] + [(1, "u", "<p>again</p>"), (None, "u", "<p>no id</p>")]
    got = P.op5(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got if r["url"] is None}
    assert by[0] == by[1] == by[2] == "" and by[3] == "plain words only" and by[8] == "deep"
    assert P.op5(spark.createDataFrame([], SCHEMA)).count() == 0


BODY = "<h1>Title of it</h1>" + "".join(f"<p>This is paragraph {i} of the article with several words in it.</p>" for i in range(6))
TEXT = "\n".join(["Title of it", *(f"This is paragraph {i} of the article with several words in it." for i in range(6))])


def test_pages_that_keep_their_article():
    for page in (
        f"<html><body class='home no-sidebar'><nav>a b c</nav><article>{BODY}</article></body></html>",
        f"<html><body class='single menu-open'><article>{BODY}</article></body></html>",
        f"<html><body><form><article>{BODY}</article></form></body></html>",
        f"<html><body><article class='post has-comments'>{BODY}</article></body></html>",
        f"<html><body><div class='article notice'>{BODY}</div></body></html>",
        f"<html><body><div title=it's class=x>{BODY}</div></body></html>",
        f"<html><body><div class=\"x\"\" id=a>{BODY}</div></body></html>",
        f"<html><body><div class=\"x id=a>{BODY}</div></body></html>",
        f"<html><body><div data-x=a=\"b'c class = 'y z'>{BODY}</div></body></html>",
    ):
        assert P.extract(page, {}) == TEXT, page[:80]


def test_further_parts_of_the_content():
    """Two articles far apart, or one with many tags in it, are whole; what stands between them is not taken."""
    gap = "<hr><img><br>" * 40
    assert P.extract(f"<body><article>{BODY}</article>{gap}<nav>menu words here</nav>{gap}<article>{BODY}</article></body>", {}) == TEXT + "\n" + TEXT
    assert P.extract(f"<body><main>{BODY}{gap}<p>The end of it.</p></main><div class=footer>legal words</div></body>", {}) == TEXT + "\nThe end of it."


def test_linear_time():
    import time

    for part in ("<b>x", "<b>x</i>", "<div>x", "<div>x</p>", "<p><b>x</div>", "<script>", '<a b="', "<!--", "<a b=", "<div class='ad'>x", "<li>x", "<", "&amp", "<a '\""):
        began = time.time()
        P.extract(part * 100_000, {})
        assert time.time() - began < 8, part
