"""HTML extraction: pages of many shapes, hosts with and without a template, and hostile input."""

import time
from collections import Counter, defaultdict

import pytest

from corvane.llm import html_extract
from corvane.llm.html_extract import Template, deduce_templates, extract_main_text, page_text, page_tokens, parsed, text_token, tokens


def text(html):
    return page_text(html)


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>A  b</h1><p>one<br>two<p>three &lt;x&gt;</article>", "A b\none two\nthree <x>"),
        ("<body><nav><a>menu</a></nav><article><p><b>x.<br><p>y</p></article><footer>f</footer></body>", "x.\ny"),
        ("<article><p>a<script>var t = '</p>';</script>b</p><style>p{}</style></article>", "ab"),
        ("<header>site</header><main><header><h1>Title</h1></header><aside>side</aside><p>t</p></main>", "Title\nt"),
        ("<article><p>t</p><div class='ad'>buy</div><section id=comments><p>first!</p></section><form>f</form></article>", "t"),
        ("<article><p>t</p><div class=\"cookie-notice\"><p>ok?</p></div></article>", "t"),
        ("<body><div class=content><p>no article here</p></div><div class=sidebar>s</div></body>", "no article here"),
        ("<body><h1>T</h1><div class=x><p>" + "long text " * 9 + "</p><section><p>more</p></section></div><div class=y>short</div></body>", "T\n" + ("long text " * 9).strip() + "\nmore"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a\nb\nc\nd"),
        ("<article><p>a&nbsp;b\t\n c</p><!-- <p>no</p> --><p>d</p>", "a b c\nd"),
        ("<article><p>1 < 2 and <b>bold</b>word</p></article>", "1 < 2 and boldword"),
        ("<div role=navigation>n</div><div role=main><p>m</p></div>", "m"),
        ("<article><p>unclosed", "unclosed"),
        ("<article>" + "<div>" * 2000 + "deep" + "</div>" * 2000 + "</article>", "deep"),
    ],
)
def test_page_text(html, wanted):
    assert text(html) == wanted


def test_broken_markup_ends():
    for html in ("<", "<a", "<!-- x", "</", "<p <p>", "<p class='x>", "<script>never", "&#xZZ; &bogus;", "<" * 5000, "<!" * 2000):
        list(tokens(html))
        text(html)


def rows(spark):
    body = "<html><body><div>Welcome to our site</div><div><a>m{0}</a></div><p>own text that is of some greater length {0}</p><div>All rights kept</div></body></html>"
    data = [(i, f"https://One.example/{i}", body.format(i)) for i in range(6)]
    data += [(10, "https://two.example/", body.format(10)), (11, None, "<article>x</article>"), (12, "https://u@one.example:8080/", None), (13, "odd", "")]
    return spark.createDataFrame([*data, data[0]], "page_id long, url string, html string").selectExpr("*", "'clash' AS host", "1 AS template", "'t' AS text")


def test_template_of_a_host(spark):
    got = extract_main_text(rows(spark)).collect()
    found = {r.page_id: r.text for r in got}
    assert len(got) == 11 and all(r.n_chars == len(r.text) for r in got)
    assert found[3] == "m3\nown text that is of some greater length 3"  # what all pages of the host say is template
    assert found[10] == "Welcome to our site\nm10\nown text that is of some greater length 10\nAll rights kept"  # one page has none
    assert found[11] == "x" and found[12] == found[13] == ""


def deduced(pages):
    """Template of a host by comparing whole occurrence vectors: {token: (vector, parent's vector, aside)}."""
    counts, parent, depth, own, n_all = defaultdict(Counter), {}, {}, Counter(), Counter()
    for i, html in enumerate(pages):
        for kind, e, t in parsed(html):
            if kind == "open":
                key = (e.token, "element")
                own[key] += e.own
                parent[key], depth[key] = e.parent and (e.parent.token, "element"), (e.depth, 0, e.token)
            elif kind == "text" and e is not None and not e.aside and (token := text_token(e, t)):
                key = (token, "text")
                parent[key], depth[key] = (e.token, "element"), (e.depth + 1, 1, token)
            else:
                continue
            counts[key][i] += 1
            n_all[key] += 1
    vector = {k: tuple(c[i] for i in range(len(pages))) for k, c in counts.items()}
    often = {k for k, c in counts.items() if len(c) >= 3 and 2 * len(c) >= len(pages)}
    classes = defaultdict(set)
    for k in often:
        classes[vector[k]].add(k)
    out = {}
    for v, members in classes.items():
        outermost = min(members, key=depth.get)
        above = parent[outermost]
        if all(kind == "text" for _, kind in members) and len(counts[outermost]) < 0.8 * len(counts[above]):
            continue
        for k in members:
            out[k[0]] = v, vector[above] if above in often else None, k[1] == "element" and 2 * own[k] > n_all[k]
    return out


def hostile_pages():
    frame = "<body><div class=a>Welcome{4}</div><nav><a>menu {0}</a></nav><div class={1}><p>own text of the page {0}</p>{2}<h4>More</h4></div>{3}<p>All rights</p></body>"
    pages = [frame.format(i, "xy"[i % 2], "<ul><li>one<li>two</ul>" * (i % 3), "<footer>f</footer>" * (i < 4), "" if i < 5 else "!") for i in range(7)]
    return [*pages, "", "<p>odd one", "<article><p>t</article>"]


def test_template_is_that_of_whole_vectors(spark):
    for pages in (hostile_pages(), hostile_pages()[:7], hostile_pages()[:3], hostile_pages()[:2], ["<p>x"] * 3):
        rows = deduce_templates(spark.createDataFrame([(i, "h", p) for i, p in enumerate(pages)], "page_key long, host string, html string"))
        rows = rows.where("token IS NOT NULL").collect()
        wanted = deduced(pages)
        assert {r.token: bool(r.aside) for r in rows} == {k: v[2] for k, v in wanted.items()}
        named = {}
        for r in rows:  # equal vectors are told by equal numbers
            vector, above, _ = wanted[r.token]
            assert named.setdefault(vector, r.vector) == r.vector
            assert (above is None) == (r.parent_vector is None)
            if above is not None and above in named:
                assert named[above] == r.parent_vector
        assert len(set(named.values())) == len(named)


def test_classes_decide_the_text(spark):
    # articles, and pages without: without its classes the host's pages come out otherwise
    data = [(i, "http://a.example/", f"<body><article><p>own text of the page {i}</p><p>Share this</p></article></body>") for i in range(4)]
    data += [(9 + i, "http://b.example/", f"<body><div><p>own text of the page {i}</p><p>All rights</p></div></body>") for i in range(4)]
    # a hint in a name counts where the class holds little of the host's text
    side = "<body><div class=left-sidebar-box><p>see {0}</p></div><p>{0}, a text of some greater length, goes on and on</p></body>"
    data += [(20 + i, "http://c.example/", side.format(i)) for i in range(4)]
    # an element that is aside on most pages is on all: the one page where it also holds an article
    wrap = "<body><div class=comments>{0}</div><article><p>text {1}</p></article></body>"
    data += [(30 + i, "http://d.example/", wrap.format("<p>first!</p>" if i else "<article>a comment</article>", i)) for i in range(4)]
    frame = spark.createDataFrame(data, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in extract_main_text(frame).collect()}
    for i in range(4):
        assert found[i] == found[9 + i] == f"own text of the page {i}"
        assert found[20 + i] == f"{i}, a text of some greater length, goes on and on"
        assert found[30 + i] == f"text {i}"
    assert all(page_text(h) != found[p] for p, _, h in data if p < 20 or p == 30)


def test_texts_of_a_nested_class(spark):
    # a layout that six of ten pages have: its text is on all pages of its class, though not on most of the host's
    one, two = "<body><section class=one><p>text {0} of this layout</p><p>Read on</p></section></body>", "<body><section class=two><p>text {0} of that</p></section></body>"
    data = [(i, "http://a.example/", (one if i < 6 else two).format(i)) for i in range(10)]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert found[2] == "text 2 of this layout" and found[7] == "text 7 of that"


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 300_000, "<b>" * 60_000, '<a ">"' * 50_000, "<b>" * 30_000 + "</i>" * 30_000, "<p><button>" + "<b>" * 20_000 + "<div></div>" * 20_000,
        "<script" * 50_000, "<p class='x>" * 50_000, "<!" * 300_000, "<table>" + "<tr><td>x" * 30_000, "<div class=x>" * 30_000 + "<article>t", "<!-- " * 100_000,
    ],
)
def test_long_pages_take_linear_time(html):
    start = time.time()
    page_text(html, Template())
    page_tokens(html)
    assert time.time() - start < 20


def test_memo_of_tags_is_bounded():
    for i in range(50_002):
        html_extract._tag("p", f" id=x data-n={i}")
    assert len(html_extract._TAGS) <= 50_001


def test_empty_table(spark):
    assert extract_main_text(rows(spark).limit(0)).isEmpty()


def test_template_in_articles(spark):
    # a heading and a text on half of the pages are one class; near copies of an article are no template
    body = "<body><article><p>{0}</p>{1}<p>Read our newsletter</p></article></body>"
    more = "<h4>Further reading</h4>"
    data = [(i, f"http://a.example/{i}", body.format(f"the text of the page {i} goes on " * 4, more * (i < 3))) for i in range(5)]
    data += [(9 + i, f"http://b.example/{i}", f"<article><p>{'one long text ' * 9}</p><p>{i}</p></article>") for i in range(4)]
    data += [(20 + i, "http://c.example/", "<body><div>all the same</div></body>") for i in range(4)]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert found[i] == ("the text of the page %d goes on " % i * 4).strip()
    for i in range(4):
        assert found[9 + i] == ("one long text " * 9).strip() + f"\n{i}"
        assert found[20 + i] == "all the same"


LONG, OTHER = "long text " * 9, "other text " * 7


@pytest.mark.parametrize(
    ("html", "wanted"),
    [
        ("<div class='page with-sidebar'><article>t</article></div>", "t"),
        ("<body class=ad-free><div class='has-banner no-comments'><article>t</article></div>", "t"),
        ("<div class=sidebar><article>t</article></div>", "t"),
        ("<form id=search><main><p>t</p></main></form>", "t"),
        ("<article>t<div class=comments><article>first!</article></div></article>", "t"),
        ("<body><div class=content><div class=lead>" + OTHER + "</div><div class=body>" + LONG + "</div></div>", f"{OTHER.strip()}\n{LONG.strip()}"),
    ],
)
def test_nothing_of_an_article_is_dropped(html, wanted):
    assert text(html) == wanted


def test_hosts_with_two_layouts(spark):
    one, two = "<body><div class=one>{0} line " * 1 + LONG + "</div></body>", "<body><div class=one>{0} short</div><div class=two>{0} " + OTHER + "</div></body>"
    data = [(i, "http://a.example/", (one if i < 4 else two).format(i)) for i in range(6)]
    found = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert found[1] == "1 line " + LONG.strip()
    assert found[5] == "5 short\n5 " + OTHER.strip()
