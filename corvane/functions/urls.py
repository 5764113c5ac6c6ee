"""Canonical urls, as an Arrow UDF: parsing and percent-encoding have no built-in counterpart."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import TRACKING_PARAMS, TRACKING_PREFIXES

DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


def _tracks(name: str) -> bool:
    low = name.lower()
    return low in TRACKING_PARAMS or low.startswith(TRACKING_PREFIXES)


def _plain_escape(m: re.Match) -> str:
    c = chr(int(m[1], 16))
    return c if c in _UNRESERVED else "%" + m[1].upper()


def canonical(raw: str | None) -> str | None:
    """The url under which equal pages meet; null if it can't be parsed.

    Scheme and host are lower-cased; fragment, user, default port and tracking parameters go; parameters are sorted;
    escapes are upper-cased, and undone where they needn't be; a trailing slash keeps its meaning.
    """
    try:
        url = urlsplit((raw or "").strip())
        port = url.port
    except ValueError:
        return None
    if not url.scheme or not url.hostname:
        return None
    host = f"[{url.hostname}]" if ":" in url.hostname else url.hostname
    if port and port != DEFAULT_PORTS.get(url.scheme):
        host += f":{port}"
    path = _ESCAPE.sub(_plain_escape, url.path or "/")
    kept = sorted((k, v) for k, v in parse_qsl(url.query, keep_blank_values=True) if not _tracks(k))
    query = "?" + urlencode(kept, safe="*").replace("~", "%7E") if kept else ""
    return f"{url.scheme}://{host}{path}{query}"


def _canonical_batch(urls: pd.Series) -> pd.Series:
    return urls.map(canonical)


def canonical_url(url: Column | str) -> Column:
    """``canonical`` over Arrow batches."""
    return F.pandas_udf(_canonical_batch, "string")(url)
