"""Entities in texts: indicators by pattern, with offsets, excerpts and confidence; facts built of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.addresses import LOOPBACK, PRIVATE, UNSPECIFIED, address_number, canonical_ipv6, in_ranges
from corvane.session import materialise

# ASCII word bounds: an indicator beside a CJK character counts.
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# a bound between a word character and another one, for patterns that may begin or end with a mark
_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
CVE = rf"(?i){_L}CVE-\d{{4}}-\d{{4,}}{_R}"
IPV4 = rf"{_L}\d{{1,3}}(?:\.\d{{1,3}}){{3}}{_R}"
EMAIL = rf"(?i){_B}[a-z0-9._%+\-]+@[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)+{_R}"
URL = rf"""(?i){_L}https?://[^\s<>"'`\\]+"""
HASH = rf"(?i){_L}(?:[0-9a-f]{{64}}|[0-9a-f]{{40}}|[0-9a-f]{{32}}){_R}"
ACCOUNT = rf"(?i){_L}(?:https?://)?(?:www\.)?(github\.com|twitter\.com|x\.com|t\.me)/([A-Za-z0-9_]{{1,32}})(?![A-Za-z0-9_-])"
IPV6 = rf"(?i){_B}(?:[0-9a-f]{{0,4}}:){{2,7}}[0-9a-f]{{0,4}}{_B}"
DOMAIN = rf"(?i){_L}[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?)*\.[a-z]{{2,}}{_R}"
#: How far an excerpt reaches to either side, and the pieces of a text that excerpts are cut from.
EXCERPT, PIECE = 240, 4096

# First parts of paths that are pages of a platform and no one's account.
RESERVED_PATHS = (
    "orgs", "settings", "marketplace", "sponsors", "notifications", "login", "signup", "join", "features", "topics", "collections", "explore", "about",
    "pricing", "enterprise", "security", "new", "search", "site", "apps", "gist", "pulls", "issues", "organizations", "users", "account", "copilot",
    "codespaces", "discussions", "home", "i", "messages", "compose", "intent", "hashtag", "tos", "privacy", "share", "joinchat", "addstickers",
    "proxy", "socks", "setlanguage", "addlist",
)

# Names of files that look like domains.
FILE_NAMES = (
    "readme.md", "changelog.md", "license.md", "contributing.md", "security.md", "index.md", "setup.py", "main.py", "app.py", "test.py", "__init__.py",
    "index.js", "app.js", "main.js", "server.js", "config.js", "package.json", "index.php", "config.php", "shell.php", "cmd.php", "main.go", "main.rs",
    "lib.rs", "mod.rs", "build.rs", "makefile.am", "configure.ac", "cargo.toml", "package.lock", "install.sh", "build.sh", "run.sh", "entrypoint.sh",
    "setup.sh", "start.sh", "index.html", "index.htm", "default.aspx",
)


#: What every match of a pattern holds; texts without it are not searched.
NEEDS = {EMAIL: "@", URL: "://", IPV6: ":", ACCOUNT: "/"}


def let(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(values: Column, zero: Column, op) -> Column:
    """Of every element what ``op``, which is associative, makes of all before it, from ``zero`` on; whole numbers.

    A fold that adds to an array copies it each time, so folds run within blocks of about the root of the length.
    """

    def fold(part: Column, start: Column) -> Column:
        init = F.struct(start.alias("now"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct(op(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))
        return F.aggregate(part, init, step, lambda a: a["out"])

    def blocked(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / size).cast("int") - 1), lambda i: F.slice(v, i * size + 1, size))
        starts = lambda bs: fold(F.transform(bs, lambda b: F.aggregate(b, zero, op)), zero)
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, starts(bs), fold)))

    return let(values, lambda v: F.when(F.size(v) > 0, blocked(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """Array of (at, hit, excerpt): code point offsets, texts and surroundings of all matches."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), h.alias("hit")))

    def placed(ps: Column) -> Column:
        starts = scan(F.transform(ps, lambda p: p["gap"] + F.length(p["hit"])), F.lit(0), lambda a, b: a + b)
        return F.zip_with(ps, starts, lambda p, s: F.struct((s + p["gap"]).alias("at"), p["hit"].alias("hit")))

    # excerpts are cut from pieces, as reaching into a long text takes time by the distance
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    cut = lambda ms: let(pieces, lambda ws: F.transform(ms, lambda m: F.struct(m["at"].alias("at"), m["hit"].alias("hit"), _excerpt(ws, m).alias("excerpt"))))
    found = let(let(pairs, placed), cut)
    may = text.contains(NEEDS[pattern]) & text.rlike(pattern) if pattern in NEEDS else text.rlike(pattern)
    return F.when(may, found).otherwise(F.array().cast("array<struct<at:int,hit:string,excerpt:string>>"))


def _excerpt(pieces: Column, m: Column) -> Column:
    start = F.greatest(m["at"] - EXCERPT, F.lit(0))
    n = m["at"] - start + F.length(m["hit"]) + EXCERPT
    first, last = F.floor(start / PIECE).cast("int"), F.floor((start + n) / PIECE).cast("int")
    return F.trim(F.substring(F.array_join(F.slice(pieces, first + 1, last - first + 1), ""), start % PIECE + 1, n))


#: What lies in every match of a pattern, and the characters that all its matches are made of, with those that its bounds look at.
_MARKS, _RUN_OF = {EMAIL: "@", DOMAIN: r"\.[A-Za-z]{2}"}, r"[A-Za-z0-9._%+\-@]"

#: Characters of excerpts that leave a worker at once.
HELD = 1 << 22


def _places(text: str, pattern: str, compiled) -> list[tuple[int, str]]:
    """(at, hit) of all matches: only those runs of characters are searched in which a match may lie."""
    out, done = [], 0
    if pattern == URL:
        at = text.find("://")
        while at >= 0:
            m = next((m for back in (5, 4) if at - back >= done and (m := compiled[URL].match(text, at - back))), None)
            if m:
                out.append((m.start(), m.group()))
                done = m.end()
            at = text.find("://", max(at + 3, done))
        return out
    for mark in compiled["marks", pattern].finditer(text):
        start = mark.start()
        if start < done:
            continue
        while start > done and compiled["run"].match(text, start - 1, start):
            start -= 1
        done = compiled["runs"].match(text, mark.start()).end()
        out += [(m.start(), m.group()) for m in compiled[pattern].finditer(text, start, done)]
    return out


def trim_url_tail(url: str) -> str:
    """Marks at the end are not the url's, nor are closing brackets that nothing opens; they may alternate."""
    for _ in range(4):
        end = url[-1:] if url.endswith(("\x85", "\u2028", "\u2029")) else ""  # a line's end is no mark, and stays
        url = url[: len(url) - len(end)].rstrip(".,;:!?\"'。，；：！？、") + end
        for opens, closes in ("()", "[]"):
            surplus, tail = url.count(closes) - url.count(opens), len(url) - len(url.rstrip(closes))
            url = url[: len(url) - max(0, min(surplus, tail))]
    return url


def _searching(patterns: tuple[str, ...]):
    def run(batches):
        import re
        from bisect import bisect_right

        import pyarrow as pa

        compiled = {p: re.compile(p, re.ASCII) for p in (EMAIL, URL, DOMAIN)} | {("marks", p): re.compile(m) for p, m in _MARKS.items()}
        compiled |= {"run": re.compile(_RUN_OF), "runs": re.compile(_RUN_OF + "*")}
        kinds = {EMAIL: "email", URL: "url", DOMAIN: "domain"}

        def covering(spans, at):
            i = bisect_right(spans, at, key=lambda x: x[0]) - 1
            return spans[i][1] if i >= 0 and at < spans[i][0] + len(spans[i][1]) else None

        def batch_of(doc_ids, rows):
            columns = list(zip(*rows))
            types = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
            arrays = [doc_ids.take(pa.array(columns[0], pa.int32())), *[pa.array(c, t) for c, t in zip(columns[1:], types)]]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "kind", "at", "hit", "excerpt", "in_email"])

        for batch in batches:
            doc_ids, rows, held = batch.column("doc_id"), [], 0
            for n, text in enumerate(batch.column("text")):
                if (text := text.as_py()) is None:
                    continue
                found = {p: _places(text, p, compiled) for p in ((EMAIL, URL, DOMAIN) if DOMAIN in patterns else patterns)}
                urls = [(at, trim_url_tail(hit)) for at, hit in found.get(URL, ())]
                for p in patterns:
                    for i, (at, hit) in enumerate(found[p]):
                        if p == DOMAIN and covering(urls, at):
                            continue
                        excerpt = text[max(at - EXCERPT, 0) : at + len(hit) + EXCERPT].strip(" ")
                        in_email = covering(found[EMAIL], at) if p == DOMAIN else None
                        rows.append((n, kinds[p], at, urls[i][1] if p == URL else hit, excerpt, in_email))
                        held += len(excerpt) + len(hit) + len(in_email or "")
                        if held > HELD:
                            yield batch_of(doc_ids, rows)
                            rows, held = [], 0
            if rows:
                yield batch_of(doc_ids, rows)

    return run


def search(docs: DataFrame, *patterns: str) -> DataFrame:
    """(doc_id, kind, at, hit, excerpt, in_email) of all matches of EMAIL, URL and DOMAIN, or some of them, in one pass over the texts.

    These patterns are dear to try at every character. All that an address or a name is made of stands in one run of few characters around a mark
    (an @, or a dot before two letters), so only such runs are searched. Urls come without the marks that end them, names that lie in a
    url are left out, and ``in_email`` is the address in which a name lies.
    """
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, kind string, at int, hit string, excerpt string, in_email string"
    holds = {EMAIL: "@", URL: "://", DOMAIN: "."}
    may = F.lit(False)
    for p in patterns:
        may = may | F.col("text").contains(holds[p])
    return docs.select("doc_id", "text").where(may).mapInArrow(_searching(patterns), schema)


def _found(docs: DataFrame, pattern: str) -> DataFrame:
    if pattern in (EMAIL, URL):
        return search(docs, pattern).select("doc_id", "at", "hit", "excerpt")
    return docs.select("doc_id", F.explode(matches(F.col("text"), pattern)).alias("m")).select("doc_id", "m.at", "m.hit", "m.excerpt")


_ITEM = ["doc_id", "entity_type", "entity_key", "confidence", "at", "excerpt", "attributes"]


def _item(rows: DataFrame, kind, key: Column, confidence, **attributes: Column) -> DataFrame:
    """Items; attributes that are null are left out."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    named = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in attributes.items()]
    given = F.filter(F.array(*named), lambda x: x["value"].isNotNull()) if named else F.array().cast("array<struct<key:string,value:string>>")
    return rows.select("doc_id", as_col(kind).alias("entity_type"), key.alias("entity_key"), as_col(confidence).cast("double").alias("confidence"), "at", "excerpt", F.map_from_entries(given).alias("attributes"))


def to_extract(docs: DataFrame) -> DataFrame:
    """Documents that are no duplicates. A row that doesn't say (column is_duplicate) fails the job: neither answer is a safe default."""
    unsaid = F.raise_error(F.concat(F.lit("is_duplicate is missing: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("no id")))).cast("boolean")
    return docs.where(F.when(F.col("is_duplicate").isNull(), unsaid).otherwise(~F.col("is_duplicate")))


def extract_cves(docs: DataFrame) -> DataFrame:
    return _item(_found(docs, CVE), "vulnerability", F.upper("hit"), 1.0)


def extract_ipv4(docs: DataFrame) -> DataFrame:
    """Addresses whose parts are at most 255 and have no leading zero."""
    ok = F.forall(F.split("hit", r"\."), lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
    return _address(_found(docs, IPV4).where(ok), F.col("hit"), 4, 0.75)


def extract_ipv6(docs: DataFrame) -> DataFrame:
    """Addresses in their canonical form; what only looks like one, such as a time of day, is left out."""
    rows = _found(docs, IPV6).withColumn("key", canonical_ipv6(F.col("hit"))).where("key IS NOT NULL")
    return _address(rows, F.col("key"), 6, 0.95)


def _address(rows: DataFrame, key: Column, version: int, confidence: float) -> DataFrame:
    rows = rows.withColumn("number", address_number(key))
    kind = lambda ranges: in_ranges(F.col("number"), ranges)
    private, loopback, nothing = kind(PRIVATE), kind(LOOPBACK), kind(UNSPECIFIED)
    return _item(rows, "ip", key, confidence, ip_version=F.lit(version), is_loopback=loopback, is_private=private, is_globally_routable=~(private | loopback | nothing))


def extract_emails(docs: DataFrame, suffixes: tuple[str, ...] | None = None, found: DataFrame | None = None) -> DataFrame:
    """Addresses, lower-cased; with ``suffixes`` only those whose domain ends in a known one. ``found`` is what a search found before."""
    key = F.lower("hit")
    items = _item(_found(docs, EMAIL) if found is None else found.where("kind = 'email'"), "email", key, 0.95, domain=F.substring_index(key, "@", -1))
    return items if suffixes is None else items.where(F.substring_index("entity_key", ".", -1).isin(*suffixes))


def extract_hashes(docs: DataFrame) -> DataFrame:
    """MD5, SHA-1 and SHA-256 by length; forty digits may be something else and count less. No run of digits in a UUID is as long."""
    n = F.length("hit")
    algorithm = F.when(n == 32, "md5").when(n == 40, "sha1").otherwise("sha256")
    return _item(_found(docs, HASH), "hash", F.lower("hit"), F.when(n == 40, 0.7).otherwise(0.9), algorithm=algorithm, ambiguous_sha1=F.when(n == 40, True))


def extract_accounts(docs: DataFrame, reserved: tuple[str, ...] = RESERVED_PATHS) -> DataFrame:
    host, handle = F.lower(F.regexp_extract("hit", ACCOUNT, 1)), F.lower(F.regexp_extract("hit", ACCOUNT, 2))
    platform = F.when(host == "github.com", "github").when(host == "t.me", "telegram").otherwise("twitter")
    rows = _found(docs, ACCOUNT).where(~handle.isin(*reserved))
    return _item(rows, "account", F.concat_ws(":", platform, handle), 0.75, platform=platform, handle=handle)


def extract_urls(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    from corvane.functions.urls import canonical_url

    rows = _found(docs, URL) if found is None else found.where("kind = 'url'")
    host = F.nullif(F.lower(F.regexp_extract("hit", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return _item(rows, "url", F.coalesce(canonical_url("hit"), F.col("hit")), 0.95, scheme=F.lower(F.substring_index("hit", ":", 1)), host=host)


def derived_domains(items: DataFrame) -> DataFrame:
    """The domain of each address and of each url whose host is no IP address."""
    host = F.rtrim(F.coalesce(F.col("attributes")["domain"], F.col("attributes")["host"]), F.lit("."))
    rows = items.where(F.col("entity_type").isin("url", "email")).withColumn("key", host)
    rows = rows.where("key IS NOT NULL").where(~F.col("key").rlike(r"^\d{1,3}(\.\d{1,3}){3}$|^\["))
    return _item(rows, "domain", F.col("key"), 0.95)


def bare_domains(found: DataFrame) -> DataFrame:
    """(doc_id, at, hit, excerpt, in_email) of names in running text that look like domains, of what a search found.

    ``in_email`` is the domain of the address in which the name lies.
    """
    return found.where("kind = 'domain'").select("doc_id", "at", F.lower("hit").alias("hit"), "excerpt", F.lower(F.substring_index("in_email", "@", -1)).alias("in_email"))


def extract_domains(docs: DataFrame, derived_from: DataFrame, suffixes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Domains of urls and addresses (``derived_from``), and those that stand by themselves, under known ``suffixes`` (column suffix).

    A name by itself counts if it is no suffix, no file's name and not all digits before its suffix, and lies neither in a url nor in an
    address that counts. ``found`` is what a search found before.
    """
    from corvane.functions.domains import with_suffix

    derived = derived_domains(derived_from).select(*_ITEM[:-1])
    # suffixes are looked up from the names and joined back; what is written is not searched for once more for that
    found = materialise(search(docs, DOMAIN), "names") if found is None else found
    plain = bare_domains(found).where("length(hit) <= 253").where(~F.col("hit").isin(*FILE_NAMES))
    plain = with_suffix(plain, "in_email", suffixes).where("suffix IS NULL").drop("suffix", "registrable")
    plain = _item(plain, "domain", F.col("hit"), 0.8).select(*_ITEM[:-1])
    rows = with_suffix(materialise(derived.unionByName(plain), "domains"), "entity_key", suffixes)
    numbers = F.substring(F.col("entity_key"), F.lit(1), F.length("entity_key") - F.length(F.substring_index("entity_key", ".", -1))).rlike(r"^[0-9.]*$")
    rows = rows.where("suffix IS NOT NULL").where((F.col("confidence") == 0.95) | (F.col("registrable").isNotNull() & ~numbers))
    registrable = F.col("registrable")
    return _item(rows, "domain", F.col("entity_key"), F.col("confidence"), public_suffix=F.col("suffix"), registrable_domain=registrable, is_registrable_domain=registrable == F.col("entity_key"))


def extract_all(docs: DataFrame, max_items: int | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """(doc_id, entity_type, entity_key, confidence, at, excerpt, attributes) of all extractors; with ``max_items`` only the first so many a document.

    With ``suffixes``, a table of public suffixes, addresses and domains must end in one, and domains in running text are found. Without it
    domains are those of urls and addresses, whatever they end in.
    """
    from corvane.functions.domains import with_suffix

    # what is joined with itself or used twice is searched for once and written
    hits = None if suffixes is None else materialise(search(docs, EMAIL, URL, DOMAIN), "hits")
    emails, urls = extract_emails(docs, found=hits), extract_urls(docs, hits)
    if suffixes is not None:
        known = with_suffix(emails.withColumn("host", F.col("attributes")["domain"]), "host", suffixes)
        emails = known.where("suffix IS NOT NULL").select(*_ITEM)
    linked = emails.unionByName(urls)
    domains = derived_domains(linked) if suffixes is None else extract_domains(docs, linked, suffixes, hits)
    found = linked
    for p in (extract_cves(docs), extract_ipv4(docs), extract_ipv6(docs), domains, extract_hashes(docs), extract_accounts(docs)):
        found = found.unionByName(p)
    if max_items is None:
        return found
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "entity_key", "entity_type"))
    return found.withColumn("nth", nth).where(F.col("nth") <= max_items).drop("nth")


def entities(items: DataFrame) -> DataFrame:
    """One row an entity: greatest confidence, first and last document, number of documents."""
    return items.groupBy("entity_type", "entity_key").agg(
        F.max("confidence").alias("confidence"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.countDistinct("doc_id").alias("n_docs"),
    )


def overlaid_attributes(items: DataFrame, order: tuple[str, ...] = ("doc_id", "at")) -> DataFrame:
    """(entity_type, entity_key, attributes): of every key what the last item in ``order`` that has it says; other keys stay.

    Each (entity, key) is one grouped maximum, which tasks take of their own rows first, so a frequent entity moves as few rows as any. At
    one place the greater value wins. Entities without attributes have an empty map.
    """
    named = items.select("entity_type", "entity_key", *order, F.explode_outer("attributes").alias("name", "value"))
    last = named.groupBy("entity_type", "entity_key", "name").agg(F.max_by("value", F.struct(*order, "value")).alias("value"))
    entries = F.sort_array(F.filter(F.collect_list(F.struct("name", "value")), lambda x: x["name"].isNotNull()))
    return last.groupBy("entity_type", "entity_key").agg(F.map_from_entries(entries).alias("attributes"))


def upsert_entities(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored entities (entity_type, entity_key, confidence, attributes map) with new ones over them: the greater confidence, and attributes overlaid by key."""
    key = ["entity_type", "entity_key"]
    rows = stored.select(*key, "confidence", "attributes", F.lit(0).alias("at")).unionByName(new.select(*key, "confidence", "attributes", F.lit(1).alias("at")))
    best = rows.groupBy(*key).agg(F.max("confidence").alias("confidence"))
    return best.join(overlaid_attributes(rows, ("at",)), key)


def mention_type(entity_type: Column) -> Column:
    return F.when(entity_type == "person", "authored_by").when(entity_type == "organization", "published_by").when(entity_type == "url", "references").otherwise("mentions")


def relationships(items: DataFrame, evidence_cap: int = 100) -> DataFrame:
    """Document-entity edges: every mention is evidence, counted up to a cap."""
    return items.groupBy("doc_id", mention_type(F.col("entity_type")).alias("relationship_type"), "entity_type", "entity_key").agg(
        F.least(F.count("*"), F.lit(evidence_cap)).alias("evidence_count"), F.max("confidence").alias("confidence"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"),
    )


def identifiers(items: DataFrame) -> DataFrame:
    """(namespace, value, entity_key): rows for the types that identify."""
    namespace = (
        F.when(F.col("entity_type") == "vulnerability", "cve")
        .when(F.col("entity_type") == "account", F.concat(F.substring_index("entity_key", ":", 1), F.lit("_handle")))
        .when(F.col("entity_type").isin("domain", "ip", "url", "email"), F.col("entity_type"))
    )
    value = F.when(F.col("entity_type") == "account", F.substring_index("entity_key", ":", -1)).otherwise(F.col("entity_key"))
    return items.select(namespace.alias("namespace"), value.alias("value"), "entity_key").where("namespace IS NOT NULL").distinct()


def extract_people(docs: DataFrame) -> DataFrame:
    """The author field (column author): the name in brackets after an address, or else the field itself."""
    from corvane.functions.text import collapse_space, person_key

    shown = F.regexp_extract("author", r"\(([^()]+)\)\s*$", 1)
    name = collapse_space(F.when(shown != "", shown).otherwise(F.col("author")))
    rows = docs.where("author IS NOT NULL").select("doc_id", name.alias("hit")).where("hit <> '' AND NOT contains(hit, '@')")
    return rows.select("doc_id", F.lit("person").alias("entity_type"), person_key(F.col("hit")).alias("entity_key"), F.lit(0.6).alias("confidence"))


def extract_organizations(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each of some attribute fields that says something."""
    from corvane.functions.text import person_key

    each = F.explode(F.array_distinct(F.array(*[person_key(F.col(f)) for f in fields]))).alias("entity_key")
    rows = docs.select("doc_id", each).where("entity_key IS NOT NULL AND entity_key <> ''")
    return rows.select("doc_id", F.lit("organization").alias("entity_type"), "entity_key", F.lit(0.6).alias("confidence"))


def derived_edges(items: DataFrame) -> DataFrame:
    """A domain belongs to the url, or is associated with the address, that it comes from; one edge a pair."""
    ends = items.where(F.col("entity_type").isin("url", "email"))
    host = F.when(F.col("entity_type") == "email", F.substring_index("entity_key", "@", -1)).otherwise(F.regexp_extract("entity_key", r"^[a-z]+://([^/:?#]+)", 1))
    kind = F.when(F.col("entity_type") == "email", "associated_with").otherwise("belongs_to")
    return ends.select(host.alias("domain"), kind.alias("relationship_type"), "entity_type", "entity_key").distinct()
