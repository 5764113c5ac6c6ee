"""Keyword, vector and hybrid search over documents."""

from __future__ import annotations

import base64
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import cosine

K1, B = 1.2, 0.75
RRF_K, MAX_POOL = 60, 200
MAX_QUERY_CHARS, MAX_TOKENS, MAX_DEPTH = 1024, 64, 8


class QueryError(ValueError):
    """A keyword query that can't be understood; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def terms_of(text: Column) -> Column:
    """Lower-cased words, and every pair of neighbouring CJK characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}&&[^⺀-鿿豈-﫿]]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit(r"[⺀-鿿豈-﫿]+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    return F.coalesce(F.concat(words, pairs), F.array().cast("array<string>"))


def lex_query(text: str) -> list[tuple[str, str]]:
    """Tokens of a keyword query: words, phrases, operators (upper case only) and brackets."""
    if len(text) > MAX_QUERY_CHARS:
        raise QueryError("too_long")
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif c in "()":
            out.append((c, c))
            i += 1
        elif c == '"':
            end = text.find('"', i + 1)
            if end < 0:
                raise QueryError("open_quote")
            if not text[i + 1 : end].strip():
                raise QueryError("empty_phrase")
            out.append(("phrase", text[i + 1 : end]))
            i = end + 1
        else:
            end = i
            while end < len(text) and not text[end].isspace() and text[end] not in '()"':
                end += 1
            word = text[i:end]
            out.append((word, word) if word in ("AND", "OR", "NOT") else ("word", word))
            i = end
    if not out:
        raise QueryError("empty")
    if len(out) > MAX_TOKENS:
        raise QueryError("too_many_tokens")
    return out


def query_condition(text: str, terms: Column) -> Column:
    """The condition that a keyword query puts on an array of terms: NOT before AND (or nothing) before OR."""
    tokens = lex_query(text)
    at = 0

    def peek() -> str | None:
        return tokens[at][0] if at < len(tokens) else None

    def either(depth: int) -> Column:
        nonlocal at
        found = every(depth)
        while peek() == "OR":
            at += 1
            found = found | every(depth)
        return found

    def every(depth: int) -> Column:
        nonlocal at
        found = one(depth)
        while peek() not in (None, "OR", ")"):
            if peek() == "AND":
                at += 1
            found = found & one(depth)
        return found

    def one(depth: int) -> Column:
        nonlocal at
        if depth > MAX_DEPTH:
            raise QueryError("too_deep")
        kind = peek()
        if kind is None or kind in ("AND", "OR", ")"):
            raise QueryError("missing_operand")
        value = tokens[at][1]
        at += 1
        if kind == "NOT":
            return ~one(depth + 1)
        if kind == "(":
            found = either(depth + 1)
            if peek() != ")":
                raise QueryError("open_bracket")
            at += 1
            return found
        wanted = terms_of(F.lit(value))
        if kind == "word":
            return F.size(F.array_except(wanted, terms)) == 0
        n = F.size(wanted)
        starts = F.sequence(F.lit(1), F.greatest(F.size(terms) - n + 1, F.lit(1)))
        return F.exists(starts, lambda i: F.slice(terms, i, n) == wanted)

    found = either(0)
    if at < len(tokens):
        raise QueryError("extra_bracket")
    return found


def read_index(spark, path: str, schema: str) -> DataFrame:
    """A stored index; one that nobody has written yet holds nothing. Any other failure to read it is an error."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def bm25(docs: DataFrame, query_terms: list[str], k: int = 10, text_col: str = "text") -> DataFrame:
    """(rank, doc_id, score): the best ``k`` documents that hold all terms, ties by id."""
    best = bm25_scores(docs, query_terms, text_col).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")


def bm25_scores(docs: DataFrame, query_terms: list[str], text_col: str = "text") -> DataFrame:
    """(doc_id, score) of all documents that hold all terms, in no order.

    One pass gives each document's length and term counts; corpus figures are one aggregate over them.
    """
    terms = terms_of(F.col(text_col))

    def times(word: str) -> Column:
        return F.size(F.filter("terms", lambda t: t == F.lit(word))).cast("double")

    tf = [times(q).alias(f"tf{i}") for i, q in enumerate(query_terms)]
    counted = docs.select("doc_id", terms.alias("terms")).select("doc_id", F.size("terms").alias("n"), *tf)
    corpus = counted.agg(
        F.count("*").alias("docs"), F.avg("n").alias("avg_n"),
        *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(query_terms))],
    ).first()
    if not corpus["docs"]:
        return counted.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    score = F.lit(0.0)
    held = F.lit(True)
    for i in range(len(query_terms)):
        df, t = corpus[f"df{i}"], F.col(f"tf{i}")
        idf = math.log(1 + (corpus["docs"] - df + 0.5) / (df + 0.5))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("n") / corpus["avg_n"]))
        held = held & (t > 0)
    return counted.where(held).select("doc_id", F.round(score, 6).alias("score"))


def boosted(docs: DataFrame, query_terms: list[str], fields: dict[str, float]) -> DataFrame:
    """(doc_id, score): the best of each document's fields that hold all terms, a field's score times its boost."""
    each = [bm25_scores(docs, query_terms, f).select("doc_id", (F.col("score") * float(boost)).alias("score")) for f, boost in fields.items()]
    both = each[0]
    for e in each[1:]:
        both = both.unionByName(e)
    return both.groupBy("doc_id").agg(F.max("score").alias("score"))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, where: Column | None = None, metric: str = "cosine") -> DataFrame:
    """(vec_id, score): the ``k`` nearest (k within 1 and 200) by cosine or l2, filtered before, ties by id."""
    k = max(1, min(k, MAX_POOL))
    if where is not None:
        vectors = vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    if metric == "cosine":
        score = cosine(F.col("embedding"), q)
    else:
        diff = F.aggregate(F.zip_with("embedding", q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        score = 1 / (1 + diff)
    return vectors.select("vec_id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def similar(vectors: DataFrame, vec_id: int, k: int = 10) -> DataFrame:
    """The ``k`` vectors most like a stored one, itself left out."""
    own = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    if own is None:
        raise KeyError(vec_id)
    return nearest(vectors, list(own["embedding"]), k + 1).where(F.col("vec_id") != vec_id).limit(k)


def pool_size(limit: int) -> int:
    return max(1, min(3 * limit, MAX_POOL))


def fuse_ranks(left: DataFrame, right: DataFrame, limit: int, left_weight: float = 1.0, right_weight: float = 1.0) -> DataFrame:
    """(id, score, left_rank, right_rank): reciprocal rank fusion of two lists (id, rank), ties by id."""
    one = lambda d, c: d.groupBy("id").agg(F.min("rank").alias(c))
    both = one(left, "left_rank").join(one(right, "right_rank"), "id", "full")
    part = lambda c, w: F.coalesce(F.lit(w) / (RRF_K + F.col(c)), F.lit(0.0))
    score = F.round(part("left_rank", left_weight) + part("right_rank", right_weight), 9)
    return both.select("id", score.alias("score"), "left_rank", "right_rank").orderBy(F.desc("score"), "id").limit(limit)


def keyset_page(rows: DataFrame, after=None, limit: int = 20, id_col: str = "doc_id") -> DataFrame:
    """A page by falling id after a cursor; the limit is kept within 1 and 100."""
    if after is not None:
        rows = rows.where(F.col(id_col) < after)
    return rows.orderBy(F.desc(id_col)).limit(max(1, min(limit, 100)))


def search_after(rows: DataFrame, after: tuple | None, limit: int) -> DataFrame:
    """A page by falling score, then rising id (columns score, id), after the last page's end."""
    if after is not None:
        score, last = after
        rows = rows.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("id") > last)))
    return rows.orderBy(F.desc("score"), "id").limit(limit)


def encode_cursor(values: list) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> list:
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as e:
        raise QueryError("bad_cursor") from e
    if not isinstance(values, list):
        raise QueryError("bad_cursor")
    return values


def highlight(text: Column, word: str) -> Column:
    """A stretch of 160 characters around the first hit, with hits emphasised."""
    import re

    at = F.greatest(F.locate(word.lower(), F.lower(text)) - 80, F.lit(1))
    return F.regexp_replace(F.substring(text, at, F.lit(160)), f"(?i)({re.escape(word)})", "<em>$1</em>")


def first_page(rows: DataFrame, key: str, limit: int) -> DataFrame:
    return rows.orderBy(key).limit(limit)


def next_cursor(page: DataFrame, key: str, limit: int) -> DataFrame:
    """(last_id, next_cursor) of a page: a cursor only where the page is full, as a short one is the last."""
    return page.agg(F.max(key).alias("last_id"), F.when(F.count("*") >= limit, F.max(key)).alias("next_cursor"))


def page_with_total(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows, each with the exact number of all; the number is one broadcast row."""
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def optional_filters(rows: DataFrame, equal: dict[str, object] | None = None, at_least: dict[str, object] | None = None, at_most: dict[str, object] | None = None, missing: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` under those filters that are set: a value that is None filters nothing, and ``missing`` asks for columns without a value.

    Each is a plain predicate on a column, so it reaches the scan; a filter that isn't set leaves no trace in the plan.
    """
    for column, value in (equal or {}).items():
        rows = rows if value is None else rows.where(F.col(column) == F.lit(value))
    for column, value in (at_least or {}).items():
        rows = rows if value is None else rows.where(F.col(column) >= F.lit(value))
    for column, value in (at_most or {}).items():
        rows = rows if value is None else rows.where(F.col(column) <= F.lit(value))
    for column in missing:
        rows = rows.where(F.col(column).isNull())
    return rows
