"""Extraction against pages whose main text is known, and the wrapper's inference rules."""

import json
import re
from html import unescape

from typeahead.llm import wrappers as W
from typeahead.llm.queries import QUERIES


def plain(source):
    """The article of the generated pages, by their one known layout."""
    body = source[source.index("<article>") + 9 : source.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)>|<br>", body)
    blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in blocks]
    return " ".join(b for b in blocks if b)


def test_op9_on_the_generated_pages(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = QUERIES["op9_html_extraction"](spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == plain(pages[r.page_id].html)
        assert (r.url, r.n_chars) == (pages[r.page_id].url, len(r.text))


SITE = """<html><head><title>T{i}</title></head><body><div class="top-menu"><a href=/>Home</a></div>
<div id=x1>Welcome to our site, we hope you enjoy reading it today</div>
<div class="story"><h2>Title {i}</h2><p>First &amp; long text of story {i} <b>bo</b>ld<p>second   part {i}{more}</div>
<div class="comments"><p>reader says {i}</div><form>Name<input></form><div class=cookie-notice>We use cookies</div><footer>Imprint</footer></body>"""


def test_sites_without_article_marks():
    pages = [SITE.format(i=i, more="<p>third" * (i % 2)) for i in range(4)]
    wrapper = W.infer(pages)
    assert [W.extract(p, wrapper) for p in pages] == [f"Title {i} First & long text of story {i} bold second part {i}" + " third" * (i % 2) for i in range(4)]
    fixed = [t for _, t in json.loads(wrapper)["fixed"]]
    assert "Welcome to our site, we hope you enjoy reading it today" in fixed


def test_inference_of_groups():
    li = lambda *t: [y for x in t for y in ("li", "\0" + x, "/li")]
    one = W.fold(["ul", *li("a", "b", "c"), "/ul"])
    two = W.fold(["ul", *li("d", "e"), "/ul", "p", "\0x", "/p"])
    assert one == ["ul", ["+", ["li", "\0", "/li"]], "/ul"]
    assert W.align(one, two) == [*one, ["?", ["p", "\0x", "/p"]]]
    assert W.align(["h1", "\0a", "/h1"], ["h1", "\0b", "/h1"]) == ["h1", W.SLOT, "/h1"]


def test_parts_inside_articles_and_markup():
    page = "<header>Site</header><article><header><h1>Head&nbsp;line</h1></header><p>a<script>var x='</p>'</script>b <i>c</i>d<br>e<aside>no</aside><div class='ad'>no</div><table><tr><td>1<td>2</table><!-- c --><p>x &lt;y&gt; &copy &#228;<section class=comments><p>no</section></article><nav>no</nav>"
    assert W.extract(page, None) == "Head line ab cd e 1 2 x <y> © ä"
    assert W.extract("<p>one</p> two <ul><li>three<li>four</ul>", None) == "one two three four"


def test_hard_cases(spark):
    rows = [(1, "http://a.b/c", None, 1), (2, None, "", 1), (3, None, "<p>x", 1), (3, None, "<p>x", 1), (4, "https://u@A.b:80/", "<b", 1), (5, "nonsense", "no markup", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in W.extract_pages(df).collect())
    assert [g[:2] for g in got] == [(1, ""), (2, ""), (3, "x"), (3, "x"), (4, ""), (5, "no markup")]
    assert W.extract_pages(df.limit(0)).count() == 0


def test_text_after_a_long_article_is_learned():
    """Site text behind more than 600 items of a page, of which no two adjacent stretches repeat."""
    kinds = ("p", "h2", "pre", "h3")
    long = lambda i: "".join(f"<{(k := kinds[(n * n // 7 + n // 5 + i * (n % 3 == 0)) % 4])}>text {i} {n}</{k}>" for n in range(900))
    pages = [f"<body>{long(i)}<div id=x9>Printed by the press of the town</div></body>" for i in range(3)]
    assert all(len(W.fold(W.Page(p).tokens)) > 600 for p in pages)
    wrapper = W.infer(pages)
    assert [W.extract(p, wrapper) for p in pages] == [" ".join(f"text {i} {n}" for n in range(900)) for i in range(3)]


def test_streams_are_compared_whole():
    import random

    r = random.Random(3)
    a = [r.choice("pqrstuvw") for _ in range(900)]
    b = [x for x in a if r.random() < 0.9]
    stretches = list(W._opcodes(a, b))
    assert [x for _, i, j, _, _ in stretches for x in a[i:j]] == a and [x for _, _, _, k, m in stretches for x in b[k:m]] == b
    assert all(a[i:j] == b[k:m] for equal, i, j, k, m in stretches if equal)
    assert sum(j - i for equal, i, j, _, _ in stretches if equal) > 0.9 * len(b)


def test_pages_are_read_by_the_expression():
    """Site text inside the article goes by its position in the expression; the same words in a slot stay."""
    page = lambda i, *more: f"<body><article><h1>Title {i}</h1>" + "".join(f"<p>part {i} {n}</p>" for n in range(2 + i)) + "".join(f"<p>{m}</p><p>after</p>" for m in more) + "<p>Read our magazine</p></article></body>"
    pages = [page(i) for i in range(4)]
    wrapper = W.infer(pages)
    want = lambda i: " ".join([f"Title {i}", *(f"part {i} {n}" for n in range(2 + i))])
    assert [W.extract(p, wrapper) for p in pages] == [want(i) for i in range(4)]
    assert W.extract(page(9, "Read our magazine"), wrapper) == want(9) + " Read our magazine after"
    assert W.extract(page(9) + "<h5>x</h5>", wrapper) == want(9)  # not accepted: by place
    assert W.extract("<article><p>Read our magazine</article>", W.infer(["<article><p>Read our magazine</article>"] * 9)) == "Read our magazine"


def test_matching_of_groups():
    program = W._program(["ul", ["+", ["li", W.SLOT, "/li"]], ["?", ["li", "\1end", "/li"]], "/ul"])
    li = lambda *t: [y for x in t for y in ("li", x, "/li")]
    assert W.match(program, ["ul", *li("\0a", "\1end", "\1end"), "/ul"]) == [False, False, True]
    assert W.match(program, ["ul", *li("\0a"), "/ul"]) == [False]
    assert W.match(program, ["ul", "/ul"]) is None


def test_every_page_and_template_of_a_host_counts(spark):
    """Two templates on one host without article marks, texts beside the heaviest container and blocks of links."""
    one = lambda i: f"<body><div class=left>Daily news of the town</div><div class=story><p>{f'long story {i} ' * 20}</p></div><div class=more><p>sequel {i}</p><p><a href=x>source of {i}</a></p></div></body>"
    two = lambda i: f"<body><div class=right>Weekly letters to the town</div><div class=story><p>letter {i}</p></div></body>"
    want = lambda i: f"{f'long story {i} ' * 20}sequel {i} source of {i}"
    rows = [(i, f"http://one.host/{i}", one(i)) for i in range(30)] + [(100 + i, f"http://one.host/{i}", two(i)) for i in range(30)]
    rows += [(200, "http://one.host/x", "<body><div class=left>Daily news of the town</div><div class=other><p>alone</p></div></body>"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (32 << 20, 0):
        got = sorted((r.page_id, r.text) for r in W.extract_pages(df, most=most).collect())
        assert got == sorted([*((i, want(i)) for i in range(30)), *((100 + i, f"letter {i}") for i in range(30)), (200, "alone"), (0, want(0))])


def test_names_of_the_whole_page_drop_nothing():
    assert W.extract('<body class="single post has-sidebar"><article><p>one</p></article></body>', None) == "one"
    assert W.extract('<article class="post comment-open"><p>one</p><div class="comment-list"><article class="comment">no</article></div></article>', None) == "one"
    assert W.extract('<main><p>a</p><div class="related-facts"><p>facts</p></div><div id="relatedPosts">no</div></main>', None) == "a facts"
    assert W.extract('<body><form id=aspnet><div class="page-with-nav"><article>one<form>no</form></article></div></form></body>', None) == "one"
    for name in ("top-menu", "site-footer", "adBanner", "cookie_notice", "sidebar left", "share-buttons", "nav"):
        assert W.extract(f'<body><div class="{name}">no</div><p>yes</p></body>', None) == "yes"


def test_text_stays_where_pages_do_not_mark_their_article(spark, small):
    """The generated pages with div for article: what is left out is up to the host's expression and the names."""
    by_host = {}
    for r in spark.read.parquet(f"{small}/pages.parquet").withColumn("host", W.host()).collect():
        by_host.setdefault(r.host, []).append(r.html)
    for pages in by_host.values():
        bare = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
        wrapper = W.infer(bare)
        assert [W.extract(b, wrapper) for b in bare] == [plain(p) for p in pages]


def test_menus_of_any_length_and_the_wrapper_decides():
    for item in ("Item", "Item {k}"):
        page = lambda i: "<body><ul>" + "".join(f"<li><a href=/x>{item.format(k=k)}</a></li>" for k in range(700)) + f"</ul><div><p>text {i}</p><p>more {i}</p></div></body>"
        wrapper = W.infer([page(i) for i in range(5)])
        assert W.extract(page(7), wrapper) == "text 7 more 7"
        assert W.extract(page(7), None).startswith("Item")


def test_every_page_is_learned(spark):
    """Parts that are there or not in all 64 ways: each page is accepted, and the site's words quoted in a slot stay."""
    parts = ("<h2>a {i}</h2>", "<ul><li>b {i}</li></ul>", "<pre>c {i}</pre>", "<blockquote>d {i}</blockquote>", "<h3>e {i}</h3>", "<h4>f {i}</h4>")
    rows, want = [], {}
    for i in range(128):
        held = [x.format(i=i) for k, x in enumerate(parts) if i >> k & 1]
        quote = ["<p>Read our magazine</p>", f"<p>after {i}</p>"] * (i >= 64)
        inner = [f"<h1>Title {i}</h1>", *held, f"<p>one {i}</p>", f"<p>two {i}</p>", *quote]
        rows.append((i, f"http://one.host/{i}", f"<body><article>{''.join(inner)}<p>Read our magazine</p></article></body>"))
        want[i] = " ".join(re.sub("<[^>]*>", "", x) for x in inner)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    ((_, _, wrapper),) = W.wrappers(df, W.facts(df)).collect()
    fixed, program = W._loaded(wrapper)
    assert all(W.match(program, W._stream(W.Page(html), fixed)) for _, _, html in rows)
    assert {r.page_id: r.text for r in W.extract_pages(df).collect()} == want
    assert W.infer([html for _, _, html in rows]) == wrapper


def test_expressions_of_free_pages_stay_small():
    """Pages that agree on no order: all are accepted, by an expression bounded by the longest, in parts too."""
    import random

    r = random.Random(8)
    kinds = ("p", "h2", "ul", "pre", "h3", "table", "h4")
    pages = []
    for _ in range(300):
        tokens = [x for k in (r.choice(kinds) for _ in range(r.randrange(5, 60))) for x in (k, W.SLOT, "/" + k)]
        pages.append(["body", *tokens, "p", W.FIXED + "Imprint", "/p", "/body"])
    shapes = [json.dumps(W.fold(p)) for p in pages]
    whole = W.learn(dict.fromkeys(shapes, 1))
    merged = W.learn({json.dumps(W.learn(dict.fromkeys(shapes[k::5], 1))): 60 for k in range(5)})
    for expression in (whole, merged):
        assert W._size(expression) <= W.GROWTH * max(W._size(json.loads(s)) for s in shapes)
        program = W._program(expression)
        for p in pages:
            taken = W.match(program, p)
            assert taken is not None and taken[-1] and not any(taken[:-1])
