"""Operator 9, HTML extraction, by equivalence-class template deduction.

Tokens of a page are its elements and its texts, told apart by their path. Tokens of one host that occur equally often on
every page have one occurrence vector and form an equivalence class. Classes that enough pages have are nested, each in
the class of its outermost token's parent, from the root down; those that hold make the host's template. What a page has between the
template's tokens are its slots. The template says which of them a page's article is made of: its texts are none of it,
and each of its elements is aside or not for the whole host. Element names, roles, and class and id names are the evidence for
that, as occurrence alone doesn't tell an article from a menu; they decide alone only where there is no template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import materialise

#: A class is valid on a host if at least this share of its pages, and as many pages, have it.
LEAST_SHARE, LEAST_PAGES = 0.5, 3
#: A class of nothing but texts is valid if it is on this share of the pages of the class that it is nested in.
TEXT_SHARE = 0.8
#: Where the template would take more than this share of an article's characters, the host's pages are copies of each other.
COPY_SHARE = 0.5
#: A template's element whose name only hints at an aside is one if it holds no more than this share of the host's characters.
HINT_SHARE = 0.2
#: Template rows up to which templates are broadcast; beyond it pages meet them in a shuffle on the host.
BROADCAST_ROWS = 20_000

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_START = re.compile(r"</?[a-zA-Z]")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_NUMBERED = re.compile(r"[-_]?\d+$")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")}
_MASK = (1 << 63) - 1

# Element names, and names of class, id and role, after the HTML standard and common usage.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
#: An element closes what is open of its group up to the nearest bound: group -> (members, who closes them, bounds).
IMPLIED = {
    "p": (("p",), BLOCK - frozenset("td th tr tbody thead tfoot caption legend".split()), "article section div body td th li button".split()),
    "li": (("li",), ("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("tr",), ("table",)),
    "option": (("option",), ("option",), ("select",)),
}
CONTAINERS = frozenset("body div section main article td fieldset dd center blockquote".split())
SKIPPED = frozenset("head script style noscript template svg iframe title textarea nav footer aside button select dialog menu search object audio video canvas".split())
MAIN = frozenset(("article", "main"))
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices alert comment comments disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer share sharing social "
    "related newsletter subscribe subscription popup modal paywall masthead topbar toolbar pagination pager login signup search "
    "ad-banner ad-container ad-slot ad-unit ad-wrapper comment-list comments-area cookie-banner cookie-bar cookie-consent "
    "cookie-notice disqus_thread main-menu main-nav nav-menu newsletter-signup related-articles related-posts share-buttons "
    "side-bar site-footer site-nav social-links social-share".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())

_CLOSED_BY: dict[str, list[str]] = {}
_SCOPES: dict[str, list[tuple[str, bool]]] = {}
for _group, (_members, _closers, _bounds) in IMPLIED.items():
    for _n in _closers:
        _CLOSED_BY.setdefault(_n, []).append(_group)
    for _n in _bounds:
        _SCOPES.setdefault(_n, []).append((_group, False))
    for _n in _members:
        _SCOPES.setdefault(_n, []).append((_group, True))


def _hash(text: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _under(parent: int, own: int) -> int:
    """Token of something below a token: one number however deep the path is."""
    h = ((parent ^ own) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    return (h ^ (h >> 29)) & _MASK


_TAGS: dict[tuple[str, str], tuple[int, bool, bool, bool, bool]] = {}


def _tag(name: str, attributes: str) -> tuple[int, bool, bool, bool, bool]:
    """A tag's label as a hash, and whether it is a main element, an aside by its role, by a whole name, or by a part of one."""
    known = _TAGS.get((name, attributes))
    if known is None:
        label, names, role = name, [], ""
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
            if kind == "role":
                role = value
            else:
                names += [_NUMBERED.sub("", n) for n in value.split()]
            label += {"class": ".", "id": "#", "role": "@"}[kind] + _DIGITS.sub("0", value)
        own_main = name in MAIN or role in ("main", "article")
        free = own_main or name in ("html", "body")
        hint = not free and any(not ASIDE_NAMES.isdisjoint(re.split("[-_]", n)) for n in names)
        known = _hash(label), own_main, role in ASIDE_ROLES, not free and not ASIDE_NAMES.isdisjoint(names), hint
        if len(_TAGS) > 50_000:
            _TAGS.clear()
        if len(attributes) < 500:
            _TAGS[name, attributes] = known
    return known


class Element:
    """An element: its token and what is known of it from its tag and its place."""

    __slots__ = ("always", "aside", "chars", "depth", "hint", "holds_main", "in_article", "main", "maybe", "name", "own", "parent", "region", "scope", "token")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        label, own_main, by_role, by_name, hint = _tag(name, attributes)
        self.name, self.parent = name, parent
        self.token = _under(parent.token if parent else 0, label)
        self.depth = parent.depth + 1 if parent else 0
        # the outermost container below the body is the region that a text is in; 0 is the body itself
        self.region = parent.region if parent else 0
        if not self.region and name in CONTAINERS and name != "body":
            self.region = self.token
        self.main = own_main or (parent is not None and parent.main)
        self.in_article = name == "article" or (own_main and name != "main") or (parent is not None and parent.in_article)
        self.always = name in SKIPPED
        self.maybe = name == "form" or (name == "header" and not self.main) or by_role or by_name
        self.hint = hint and not self.main
        self.holds_main = self.own = self.aside = False
        self.chars = 0
        self.scope = parent.scope if parent else {}
        if name in _SCOPES:
            self.scope = self.scope | {group: self if inside else None for group, inside in _SCOPES[name]}
        while own_main and parent is not None and not parent.always and not parent.holds_main:
            parent.holds_main = True
            parent = parent.parent

    def settle(self, template: dict[int, bool]) -> None:
        """Tell whether this is aside, once the page is read and the parent settled: by the template, if it knows the element.

        Else by its names, but for what holds an article. An aside within an article stays one, as the articles that it
        holds are comments or teasers.
        """
        outer = self.parent
        excused = self.holds_main and not (outer is not None and outer.in_article)
        self.own = self.always or (self.maybe and not excused)
        self.aside = (outer is not None and outer.aside) or template.get(self.token, self.own)


def parsed(html: str, template: dict[int, bool] | None = None) -> list[tuple[str, Element | None, str]]:
    """The tokens of a page, with their elements settled."""
    found = list(tokens(html))
    for kind, element, _ in found:
        if kind == "open":
            element.settle(template or {})
    return found


def tokens(html: str) -> Iterator[tuple[str, Element | None, str]]:
    """(kind, element, text) in page order; kinds: open, close, text, break (an inline one).

    Time is linear in the page: a tag that nothing ends is looked for once, implied ends are found without a
    search through open elements, and an end tag that fits none of them costs nothing. An unended tag or comment takes
    the rest of the page with it.
    """
    stack: list[Element] = []
    open_names: dict[str, int] = {}
    last_end, tag = html.rfind(">"), _TAG
    at, size = 0, len(html)

    def pop_to(element: Element) -> None:
        while True:
            gone = stack.pop()
            open_names[gone.name] -= 1
            if gone is element:
                return

    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        if start > at:
            yield "text", stack[-1] if stack else None, html[at:start]
        if start == size:
            return
        m = tag.match(html, start)
        if m is None:
            after = html[start + 1 : start + 2]
            if after in ("!", "?"):
                comment = html.startswith("<!--", start)
                end = html.find("-->", start + 4) if comment else html.find(">", start)
                at = end + (3 if comment else 1) if end >= 0 else size
            elif not _TAG_START.match(html, start):
                yield "text", stack[-1] if stack else None, "<"
                at = start + 1
            elif start > last_end:
                return
            elif tag is _PLAIN_TAG:
                yield "text", stack[-1] if stack else None, "<"
                at = start + 1
            else:
                # a quote that nothing ends: from here on quotes aren't looked at, so that no tag is searched twice
                tag, at = _PLAIN_TAG, start
            continue
        at, name, attributes = m.end(), m[2].lower(), m[3]
        if m[1]:
            if open_names.get(name):
                cut = next(e for e in reversed(stack) if e.name == name)
                yield "close", cut, ""
                pop_to(cut)
            continue
        for group in _CLOSED_BY.get(name, ()):
            if stack and (gone := stack[-1].scope.get(group)):
                pop_to(gone)
        element = Element(name, attributes, stack[-1] if stack else None)
        yield "open", element, ""
        if name in _RAW:
            end = _RAW[name].search(html, at)
            at = end.end() if end else size
        elif name in VOID or attributes.endswith("/"):
            if name not in BLOCK:
                yield "break", element, ""
        else:
            stack.append(element)
            open_names[name] = open_names.get(name, 0) + 1


def text_token(element: Element, text: str) -> int | None:
    """Token of a text, or None for nothing but white space."""
    plain = " ".join(unescape(text).split())
    return _under(element.token, _hash("\n" + plain)) if plain else None


ELEMENT, TEXT, REGION = 0, 1, 2
_TOKENS = "host string, page_key long, token long, kind int, n long, parent long, depth int, region long, chars long, asides long, hints long"


def page_tokens(html: str) -> list[tuple]:
    """(token, kind, n, parent, depth, region, chars, asides, hints) of a page: its elements with the characters in them, its
    texts, and the regions outside articles with theirs."""
    found = parsed(html)
    rows: dict[tuple[int, int], list] = {}

    def add(token: int, kind: int, parent: int | None, depth: int, region: int | None, chars: int, aside: bool = False, hint: bool = False) -> None:
        row = rows.setdefault((token, kind), [token, kind, 0, parent, depth, region, 0, 0, 0])
        row[2] += 1
        row[6] += chars
        row[7] += aside
        row[8] += hint

    for kind, element, text in found:
        if kind == "text" and element is not None and not element.aside and (token := text_token(element, text)):
            element.chars += len(text)
            add(token, TEXT, element.token, element.depth + 1, None if element.main else element.region, len(text))
            if not element.main:
                add(element.region, REGION, None, 0, element.region, len(text))
    opened = [element for kind, element, _ in found if kind == "open"]
    for element in reversed(opened):
        if element.parent is not None:
            element.parent.chars += element.chars
    for e in opened:
        add(e.token, ELEMENT, e.parent.token if e.parent else None, e.depth, None, e.chars, e.own, e.hint and not e.holds_main)
    return list(map(tuple, rows.values()))


def _page_tokens(batches):
    import pyarrow as pa

    names = [c.split()[0] for c in _TOKENS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in _TOKENS.split(", ")]
    for b in batches:
        for page, host, html in zip(*(b.column(c).to_pylist() for c in ("page_key", "host", "html"))):
            found = page_tokens(html)
            columns = [[host] * len(found), [page] * len(found), *(map(list, zip(*found)) if found else [[]] * 9)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds)], names=names)


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, token, kind, vector, parent_vector, aside, region, chars) from (page_key, host, html).

    Element and text rows are the tokens of the valid classes, with their class's vector and that of the class that it is nested in.
    A vector is told by a sum over pages of a page's hash times the token's count there, which is one number for equal occurrence
    vectors, so no page list is ever gathered. ``aside`` is the host's verdict on an element: what its names say on most of
    its occurrences, or a hint in its names if it holds little of the host's text. Region rows are the
    host's regions outside articles with the characters of their texts that are not template. Tokens that
    fewer than ``LEAST_PAGES`` pages have end at their first aggregation.
    """
    found = pages.mapInArrow(_page_tokens, _TOKENS)
    code = F.xxhash64("page_key", F.lit(11)).cast("decimal(20,0)") * F.col("n").cast("decimal(10,0)")
    vectors = found.groupBy("host", "token", "kind").agg(
        F.sum(code).alias("vector"), F.count("*").alias("n_pages"), F.sum("n").alias("n"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
        F.max("region").alias("region"), F.sum("chars").alias("chars"), F.sum("asides").alias("asides"), F.sum("hints").alias("hints"),
    )
    counted = materialise(vectors.where((F.col("n_pages") >= LEAST_PAGES) | (F.col("kind") == REGION)), "tokens")
    hosts = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    # one row a host and few a token: what is joined from here on is aggregated
    often = counted.where(F.col("kind") != REGION).join(hosts, "host").where(F.col("n_pages") >= LEAST_SHARE * F.col("host_pages"))
    often = materialise(often, "frequent-tokens")
    classes = often.groupBy("host", "vector").agg(
        F.max("n_pages").alias("class_pages"), F.min(F.col("kind") == TEXT).alias("only_texts"),
        F.min_by("parent", F.struct("depth", "kind", "token")).alias("parent"),
    )
    outer = often.where(F.col("kind") == ELEMENT).select("host", F.col("token").alias("parent"), F.col("vector").alias("parent_vector"), F.col("n_pages").alias("outer_pages"))
    nested = classes.join(outer, ["host", "parent"], "left")
    valid = nested.where(~F.col("only_texts") | (F.col("class_pages") >= TEXT_SHARE * F.col("outer_pages"))).drop("parent")
    members = often.join(valid.select("host", "vector", "parent_vector"), ["host", "vector"])
    whole = often.where("parent IS NULL").groupBy("host").agg(F.sum("chars").alias("host_chars"))
    by_names = 2 * F.col("asides") > F.col("n")
    by_hint = (2 * F.col("hints") > F.col("n")) & (F.col("chars") <= HINT_SHARE * F.col("host_chars"))
    verdict = F.when(F.col("kind") == ELEMENT, by_names | F.coalesce(by_hint, F.lit(False)))
    kept = members.join(whole, "host", "left").withColumn("aside", verdict)
    template = kept.select("host", "token", "kind", "vector", "parent_vector", "aside")
    held = counted.where(F.col("kind") == REGION).select("host", "region", "chars")
    taken = members.where((F.col("kind") == TEXT) & F.col("region").isNotNull()).select("host", "region", (-F.col("chars")).alias("chars"))
    regions = held.unionByName(taken).groupBy("host", "region").agg(F.sum("chars").alias("chars")).where("chars > 0")
    return template.unionByName(regions.withColumn("kind", F.lit(REGION)), allowMissingColumns=True)


class Template:
    """What a host's classes say: its texts, and its elements with whether they are aside; and its heaviest region."""

    def __init__(self, texts=(), elements=(), asides=(), main_region: int | None = None):
        self.texts, self.main_region = frozenset(texts), main_region
        self.elements = dict.fromkeys(elements, False) | dict.fromkeys(asides, True)


def page_text(html: str, template: Template | None = None) -> str:
    """The article's slots of a page, a line for each block.

    Template texts and what is aside are no slots of it. Where the page has an article (or main) element its slots are the text. Else it is the
    slots of the region that holds most of the page's text, and of the one that holds most of the host's, with a top heading.
    """
    template = template or Template()
    found = parsed(html, template.elements)
    gone: set[int] = set()
    sizes = {True: [0, 0], False: [0, 0]}
    for i, (kind, element, text) in enumerate(found if template.texts else ()):
        if kind == "text" and element is not None and not element.aside and (token := text_token(element, text)):
            hit = token in template.texts
            sizes[element.main][hit] += len(text)
            if hit:
                gone.add(i)
    inner_kept, outer_kept = sizes[True][1] > COPY_SHARE * sum(sizes[True]), not sizes[False][0]
    parts: dict[bool, list[str]] = {True: [], False: []}
    inner: list[str] = []
    outer: list[tuple[int, str]] = []
    heading = -1
    region, has_main = 0, False

    def flush() -> None:
        for main in (True, False):
            line = " ".join("".join(parts[main]).split())
            if line and main:
                inner.append(line)
            elif line:
                outer.append((region, line))
            parts[main].clear()

    for i, (kind, element, text) in enumerate(found):
        if kind == "text":
            if element is None:
                parts[False].append(unescape(text))
                region = region if parts[False][:-1] else 0
            elif not element.aside and (i not in gone or (inner_kept if element.main else outer_kept)):
                parts[element.main].append(unescape(text))
                if not element.main:
                    region = heading if element.name == "h1" else element.region
        elif kind == "break":
            parts[element.main].append(" ")
        elif element.name in BLOCK:
            flush()
        if kind == "open" and element.main and not element.aside:
            has_main = True
    flush()
    if has_main:
        return "\n".join(inner)
    lengths: dict[int, int] = {}
    for where, line in outer:
        if where != heading:
            lengths[where] = lengths.get(where, 0) + len(line)
    kept = {heading, template.main_region, max(lengths, key=lambda x: (lengths[x], x), default=0)}
    # 0 is the body itself, with all that is in it
    return "\n".join(line for where, line in outer if where in kept or 0 in kept)


def _texts(batches):
    import pyarrow as pa

    templates: dict[str, Template] = {}
    parts = ("texts", "elements", "asides", "main_region")
    for b in batches:
        texts = []
        hosts, pages = b.column("host").to_pylist(), b.column("html").to_pylist()
        for i, (host, html) in enumerate(zip(hosts, pages)):
            if host not in templates:
                if len(templates) > 1_000:
                    templates.clear()
                found = [b.column(c)[i].as_py() for c in parts]
                templates[host] = Template(*[x or () for x in found[:3]], found[3])
            texts.append(page_text(html, templates[host]))
        keep = [c for c in b.schema.names if c in ("page_id", "url")]
        arrays = [*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    Null and empty html give an empty text. Pages without a host (null or odd urls) share the template of the
    empty host. Hosts with fewer than three pages have no template. Repeated
    rows come out as often as they went in; an empty table gives an empty result.

    Scale: what is shuffled for the templates is a row for each token, combined by host and
    token in each task; a token is one number whatever its depth. Templates of a checked size are broadcast, so that pages are read
    twice and never moved. A page is read in time and memory linear in its length.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host)
    keyed = rows.select(F.xxhash64("page_id", "url").alias("page_key"), "host", "html")
    template = materialise(deduce_templates(keyed), "templates")
    of_kind = lambda kind, ok=F.lit(True): F.collect_set(F.when((F.col("kind") == kind) & ok, F.col("token")))
    by_host = template.groupBy("host").agg(
        of_kind(TEXT).alias("texts"), of_kind(ELEMENT, ~F.col("aside")).alias("elements"), of_kind(ELEMENT, F.col("aside")).alias("asides"),
        F.max_by("region", F.struct("chars", "region")).alias("main_region"),
    )
    if template.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_host = F.broadcast(by_host)
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url {dict(rows.dtypes)['url']}, text string, n_chars long"
    return rows.join(by_host, "host", "left").mapInArrow(_texts, schema)
