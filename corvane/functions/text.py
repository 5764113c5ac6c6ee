"""Text normalisation, hashing and other scalar functions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import addresses

# Query parameters that only track, and prefixes of such.
TRACKING_PARAMS = (
    "gclid", "gclsrc", "dclid", "gbraid", "wbraid", "fbclid", "msclkid", "yclid", "_openstat", "mc_cid", "mc_eid",
    "_hsenc", "_hsmi", "hsctatracking", "igshid", "ttclid", "twclid", "spm", "scm", "ref", "ref_src", "ref_url",
    "referrer", "referer", "cmpid", "campaignid", "s_cid", "icid", "ncid", "sr_share", "vero_id", "vero_conv",
    "oly_anon_id", "oly_enc_id", "wickedid",
)
TRACKING_PREFIXES = ("utm_", "pk_", "mtm_", "matomo_")


def collapse_space(text: Column) -> Column:
    """Unicode white space runs become one space; none at the ends; case stays."""
    return F.trim(F.regexp_replace(text, r"\p{IsWhite_Space}+", " "))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the collapsed parts joined by a bar; null counts as empty."""
    return F.sha2(F.concat_ws("|", *[collapse_space(F.coalesce(p, F.lit(""))) for p in parts]), 256)


def person_key(name: Column) -> Column:
    """Names of people and organisations: collapsed and lower-cased."""
    return F.lower(collapse_space(name))


def is_tracking_param(name: Column) -> Column:
    low = F.lower(name)
    found = low.isin(*TRACKING_PARAMS)
    for prefix in TRACKING_PREFIXES:
        found = found | low.startswith(prefix)
    return found


def is_import_url(url: Column) -> Column:
    """Urls made up on import, which say nothing about the document."""
    return F.lower(F.ltrim(url)).startswith("import://")


def is_web_url(url: Column) -> Column:
    return F.coalesce(F.lower(F.trim(url)).rlike(r"^https?://[^/\s]+"), F.lit(False))


def truncate_chars(text: Column, n: int) -> Column:
    """At most ``n`` characters, with an ellipsis where more follows."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def truncate_bytes(text: Column, n: int) -> Column:
    """At most ``n`` bytes of UTF-8, cut on a character's bound."""
    cut = F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")
    # the bytes of a character that the cut breaks become replacement characters, which are taken off again
    whole = F.regexp_replace(F.make_valid_utf8(cut), "\\x{FFFD}+$", "")
    return F.when(F.octet_length(text) <= n, text).otherwise(whole)


#: Fixed value: what stands for a masked credential.
MASK = "[已省略]"


def redact_credentials(text: Column) -> Column:
    """Words that begin with sk- are masked, and a mark is put where a bearer token follows."""
    marked = F.replace(text, F.lit("Bearer "), F.lit(f"Bearer {MASK} "))
    return F.regexp_replace(marked, r"""sk-[^\s"',)\]]*""", f"sk-{MASK}")


def source_text(title: Column, summary: Column, body: Column) -> Column:
    """What is chunked: every part that there is, each with a line end."""
    return F.concat(*[F.when(F.coalesce(p, F.lit("")) != "", F.concat(p, F.lit("\n"))).otherwise("") for p in (title, summary, body)])


def snippet(summary: Column, body: Column, n: int = 200) -> Column:
    """The first ``n`` characters of the summary, or else of the body; an ellipsis where more follows."""
    text = F.coalesce(F.when(summary != "", summary), body)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def merge_json(base: Column, patch: Column) -> Column:
    """Shallow merge of two JSON objects of strings; the patch wins."""
    kind = "map<string,string>"
    return F.to_json(F.map_from_entries(F.concat(
        F.filter(F.map_entries(F.from_json(base, kind)), lambda e: ~F.map_contains_key(F.from_json(patch, kind), e["key"])),
        F.map_entries(F.from_json(patch, kind)),
    )))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(19, 2)), part(21, 12))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_similarity(distance: Column) -> Column:
    return 1 - F.least(distance, F.lit(64)) / 64.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """From -1 to 1; 0 where lengths differ, a vector is empty or a norm is 0."""
    norms = F.sqrt(dot(a, a) * dot(b, b))
    cos = F.greatest(F.least(dot(a, b) / norms, F.lit(1.0)), F.lit(-1.0))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), cos).otherwise(0.0)


def embedding_model(language: Column) -> Column:
    """English has a model of its own."""
    return F.when(F.lower(F.split(language, "[-_]")[0]) == "en", "english").otherwise("multilingual")


def embedding_input(language: Column, text: Column, role: str) -> Column:
    """The multilingual model wants its inputs' role (query or passage) in front."""
    return F.when(embedding_model(language) == "multilingual", F.concat(F.lit(f"{role}: "), text)).otherwise(text)


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if a part is over 255."""
    parts = [F.split(ip, r"\.")[i].cast("int") for i in range(4)]
    fits = parts[0].between(0, 255)
    for p in parts[1:]:
        fits = fits & p.between(0, 255)
    number = parts[0].cast("long") * (1 << 24) + parts[1] * (1 << 16) + parts[2] * 256 + parts[3]
    return F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & fits, number)


def _within(number: Column, cidrs: Sequence[str]) -> Column:
    import ipaddress

    found = F.lit(False)
    for c in cidrs:
        net = ipaddress.ip_network(c)
        found = found | number.between(int(net.network_address), int(net.broadcast_address))
    return found


# Cloud metadata addresses, never fetched, and ranges that are not public.
HARD_DENY = ("169.254.169.254/32", "100.100.100.200/32", "169.254.169.253/32", "168.63.129.16/32")
SOFT_DENY = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.2.0/24",
    "192.168.0.0/16", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/3",
)


def ipv4_class(ip: Column) -> Column:
    """hard_deny, soft_deny or public; null for what is no IPv4 address."""

    def judged(number: Column) -> Column:
        return F.when(number.isNull(), None).when(_within(number, HARD_DENY), "hard_deny").when(_within(number, SOFT_DENY), "soft_deny").otherwise("public")

    # the number is computed once, and not in each of the comparisons
    return F.element_at(F.transform(F.array(ipv4_number(ip)), judged), 1)


def json_merge_sources(*columns: str) -> Column:
    """First column that has something."""
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in columns])


# Names of cloud metadata servers; the same as an address; ranges of IPv6 that are not public.
HARD_DENY_HOSTS = ("metadata.google.internal", "metadata.google.com", "metadata.goog")
HARD_DENY_V6 = "fd00:ec2::254/128"
SOFT_DENY_V6 = ("::/128", "::1/128", "fe80::/10", "fc00::/7", "ff00::/8")


def host_class(host: Column) -> Column:
    """Class of an IPv4 or IPv6 address or a known host name; null for other names, which must be resolved first.

    An IPv4 address within an IPv6 one (mapped, or in the last 32 bits) counts as itself.
    """

    def judged(number: Column) -> Column:
        compatible = (number["upper"] == 0) & (number["lower"] > 1) & (number["lower"] < 1 << 32)
        mapped = F.struct(number["upper"].alias("upper"), F.when(compatible, number["lower"].bitwiseOR(F.lit(0xFFFF << 32))).otherwise(number["lower"]).alias("lower"))
        deny = lambda ranges: addresses.in_ranges(mapped, ranges)
        kind = F.when(deny((*HARD_DENY, HARD_DENY_V6)), "hard_deny").when(deny((*SOFT_DENY, *SOFT_DENY_V6)), "soft_deny").otherwise("public")
        return F.when(number.isNotNull(), kind)

    plain = F.lower(F.rtrim(F.trim(host), F.lit(".")))
    return F.when(plain.isin(*HARD_DENY_HOSTS), "hard_deny").otherwise(F.element_at(F.transform(F.array(addresses.address_number(plain)), judged), 1))
