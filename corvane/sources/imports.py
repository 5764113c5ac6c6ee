"""JSON and CSV imports: field mapping by alias, limits, lenient times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names under which files call the fields, the first that is there counts.
ALIASES = {
    "title": ("title", "headline", "name", "subject"),
    "body": ("body", "content", "text"),
    "summary": ("summary", "description", "excerpt"),
    "url": ("url", "link", "permalink"),
    "published_at": ("published_at", "published", "date", "pubdate"),
    "author": ("author", "by", "creator"),
    "publisher": ("publisher", "source", "site"),
    "language": ("language", "lang"),
    "external_id": ("external_id", "id", "guid"),
}
MAX_RECORDS, MAX_RECORD_BYTES, MAX_FIELD_BYTES, MAX_DEPTH, MAX_COLUMNS = 10_000, 262_144, 65_536, 32, 512


def parse_time(value: Column) -> Column:
    """RFC 3339, RFC 2822, three forms of date and time, two of date, seconds since 1970; null for anything else."""
    v = F.trim(value)
    no_day = F.regexp_replace(v, r"^[A-Za-z]{3},\s*", "")
    zone = F.regexp_replace(no_day, r"\b(GMT|UT)$", "+0000")
    forms = [F.try_to_timestamp(v, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss")]
    forms.append(F.try_to_timestamp(zone, F.lit("d MMM yyyy HH:mm:ss xx")))
    forms += [F.try_to_timestamp(v, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd")]
    return F.coalesce(*forms, F.when(v.rlike(r"^\d{10}$"), F.timestamp_seconds(v.try_cast("long") if hasattr(v, "try_cast") else v.cast("long"))))


def map_fields(rows: DataFrame, explicit: dict[str, str] | None = None) -> DataFrame:
    """The nine logical fields of raw rows; an explicit column wins over aliases, which ignore case. Blank is null."""
    by_name = {c.lower(): c for c in rows.columns}
    out = []
    for field, aliases in ALIASES.items():
        named = (explicit or {}).get(field)
        if named and named.lower() not in by_name:
            raise KeyError(f"no column {named!r} for {field}")
        names = [named.lower()] if named else [a for a in aliases if a in by_name]
        values = [F.trim(F.col(f"`{by_name[a]}`").cast("string")) for a in names]
        filled = [F.when(v != "", v) for v in values]
        out.append((F.coalesce(*filled) if filled else F.lit(None).cast("string")).alias(field))
    return rows.select(*out).withColumn("published_raw", F.col("published_at")).withColumn("published_at", parse_time(F.col("published_at")))


def drop_empty(records: DataFrame) -> DataFrame:
    """Records without title, body and summary say nothing."""
    return records.where(F.coalesce("title", "body", "summary").isNotNull())


def over_limits(records: DataFrame) -> DataFrame:
    """Records with a field or a whole that is too large."""
    sizes = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in records.columns]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return records.where((F.greatest(*sizes) > MAX_FIELD_BYTES) | (total > MAX_RECORD_BYTES))


def json_depth(text: Column) -> Column:
    """Deepest nesting of brackets outside strings."""
    bare = F.regexp_replace(text, r'"(?:[^"\\]|\\.)*"', "")
    steps = F.transform(F.regexp_extract_all(bare, F.lit(r"[\[\]{}]"), F.lit(0)), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    init = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, init, lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")), lambda a: a["most"])


def read_json(spark: SparkSession, path: str, explicit: dict[str, str] | None = None) -> DataFrame:
    """A JSON array or one object a line, told by the first character; only objects count."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1)).first()
    rows = spark.read.option("primitivesAsString", True).json(path, multiLine=bool(first and first[0] == "["))
    return drop_empty(map_fields(rows, explicit))


def read_csv(spark: SparkSession, path: str, explicit: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header; a ragged row fails the import; cells are trimmed."""
    rows = spark.read.csv(path, header=True, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, enforceSchema=False)
    if len(rows.columns) > MAX_COLUMNS:
        raise ValueError("too many columns")
    return drop_empty(map_fields(rows, explicit))


def classify_content(content_type: Column, path: Column) -> Column:
    """json, csv, feed, html or unsupported: by media type, then by the path's ending, in that order of kinds."""
    media = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    end = F.lower(F.coalesce(path, F.lit("")))
    ends = lambda *names: end.rlike(rf"\.({'|'.join(names)})$")
    json_media = media.isin("application/json", "text/json") | media.endswith("+json")
    csv_media = media.isin("text/csv", "application/csv", "text/comma-separated-values")
    feed_media = media.isin("application/xml", "text/xml", "application/rdf+xml") | media.contains("rss") | media.contains("atom")
    html_media = media.isin("text/html", "application/xhtml+xml", "application/xhtml")
    return (
        F.when(json_media | ends("json"), "json").when(csv_media | ends("csv"), "csv")
        .when(feed_media | ends("xml", "rss", "atom"), "feed").when(html_media | ends("html", "htm", "xhtml"), "html")
        .otherwise("unsupported")
    )


def sniff_body(body: Column) -> Column:
    """feed, html or unknown, by the first 512 characters."""
    head = F.lower(F.substring(body, 1, 512))
    feed = head.contains("<rss") | head.contains("<feed") | head.contains('xmlns="http://www.w3.org/2005/atom"')
    page = F.ltrim(head).startswith("<!doctype html") | head.contains("<html") | head.contains("<head") | head.contains("<body")
    return F.when(feed, "feed").when(page, "html").otherwise("unknown")
