"""Identifiers, URLs, numbers and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions.text import bound

DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
DOI_PREFIX = r"(?i)^(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)"
# Query parameters that only track.
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "dclid", "msclkid", "ref",
    "source", "campaign", "medium", "term", "content", "_ga", "_gid", "_gac", "mc_eid", "mc_cid",
)
# Hosts of media, and path words and extensions that are no article.
MEDIA_HOSTS = ("youtube", "youtu.be", "vimeo", "podcast", "soundcloud")
NOT_ARTICLES = r"(?i)(?:login|signup|register|logout|search|cart|checkout|admin|api|feed|rss|sitemap|tag|category|page/\d+|#)"
NOT_PAGES = r"(?i)\.(pdf|jpg|jpeg|png|gif|svg|css|js|xml|zip|gz|tar|mp3|mp4|ico|woff2?|ttf|eot)$"


def doi(c: Column) -> Column:
    """The first DOI in a text in canonical form, or null: prefix, end punctuation and unmatched closers removed."""
    def closed(bare: Column, opener: str, closer: str) -> Column:
        more = F.length(F.replace(bare, F.lit(opener), F.lit(""))) - F.length(F.replace(bare, F.lit(closer), F.lit("")))
        tail = F.length(bare) - F.length(F.rtrim(bare, F.lit(closer)))
        return F.substring(bare, F.lit(1), F.length(bare) - F.greatest(F.lit(0), F.least(more, tail)))

    found = F.regexp_extract(F.trim(F.regexp_replace(F.trim(c), DOI_PREFIX, "")), DOI, 0)
    canonical = lambda x: bound(bound(F.regexp_replace(x, "[.,;:!?]+$", ""), lambda bare: closed(bare, "(", ")")), lambda bare: F.lower(closed(bare, "[", "]")))
    return bound(found, lambda x: F.when(x != "", canonical(x)))


def isbn13_valid(c: Column) -> Column:
    """Thirteen digits with weights 1 and 3."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, i: a + F.substring(c, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.when(c.rlike(r"^\d{13}$"), total % 10 == 0).otherwise(F.lit(False))


def isbn10_valid(c: Column) -> Column:
    """Nine digits and a check digit or X, modulo 11."""
    digit = lambda i: F.when(F.upper(F.substring(c, i, F.lit(1))) == "X", 10).otherwise(F.substring(c, i, F.lit(1)).try_cast("int"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda a, i: a + digit(i) * (F.lit(11) - i))
    return F.when(c.rlike(r"^\d{9}[\dXx]$"), total % 11 == 0).otherwise(F.lit(False))


def isbn13(c: Column) -> Column:
    """A valid ISBN without separators, ISBN-10 upgraded; or null."""
    bare = F.regexp_replace(c, r"[-\s\x{2010}-\x{2015}]+", "")
    core = F.concat(F.lit("978"), F.substring(bare, 1, 9))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(core, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.when(isbn10_valid(bare), F.concat(core, ((F.lit(10) - total % 10) % 10).cast("string"))).when(isbn13_valid(bare), bare)


def host(c: Column) -> Column:
    """Host of a URL in lower case."""
    return F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


# Blocks of IPv4 addresses that are not global, as first address and prefix length.
NOT_GLOBAL = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4))


def public_url(c: Column) -> Column:
    """Whether a URL may be fetched by its form alone (F03): HTTP(S), a host, no userinfo, not this machine, an IP literal only if global.

    Of IPv6 literals only global unicast (2000::/3, without the documentation block) counts; a host of digits and dots that is no address is refused.
    """
    authority = F.regexp_extract(c, r"^(?i:https?)://([^/?#]*)", 1)
    boxed = F.lower(F.regexp_extract(authority, r"^\[([^\]]*)\](?::\d*)?$", 1))
    name = F.lower(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.+$", ""))
    octets = F.transform(F.split(name, r"\."), lambda x: x.try_cast("long"))
    dotted = name.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & F.forall(octets, lambda x: x <= 255)
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    value = lambda a: sum(int(x) << (24 - 8 * i) for i, x in enumerate(a.split(".")))
    inner = F.lit(False)
    for first, bits in NOT_GLOBAL:
        inner = inner | number.between(value(first), value(first) + (1 << (32 - bits)) - 1)
    ok = F.when(authority.contains("[") | authority.contains("]"), boxed.rlike(r"^[23][0-9a-f]{3}:[0-9a-f:.]*$") & ~boxed.rlike(r"^2001:0?db8:")).when(dotted, ~inner).otherwise(~name.rlike(r"^(?:0x[0-9a-f]+|[\d.]+)$"))
    return F.when(c.isNotNull(), (authority != "") & (name != "") & ~authority.contains("@") & ~name.isin("localhost", "localhost.localdomain") & F.coalesce(ok, F.lit(False)))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def without_tracking(c: Column) -> Column:
    """A URL without tracking parameters."""
    base, query, fragment = F.regexp_extract(c, r"^([^?#]*)", 1), F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1), F.regexp_extract(c, r"(#.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & p.contains("=") & (F.split(p, "=")[1] != "") & ~F.split(p, "=")[0].isin(*TRACKING)), "&")
    return F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), fragment)


def resource_type(c: Column) -> Column:
    """Route of an input by host and extension (S01); only public URLs (F03) have one."""
    ext = F.lower(F.regexp_extract(path(c), r"\.([A-Za-z0-9]+)$", 1))
    media = F.lit(False)
    for token in MEDIA_HOSTS:
        media = media | host(c).contains(token)
    return (
        F.when(~c.rlike(r"^https?://") | (host(c) == "") | ~public_url(c), "unsupported")
        .when(media | ext.isin("mp3", "mp4", "wav", "m4a", "webm", "mov"), "media")
        .when(ext == "pdf", "digital_pdf")
        .when(ext.isin("doc", "docx", "odt", "ppt", "pptx", "xls", "xlsx"), "office_document")
        .when(ext == "djvu", "djvu_document")
        .otherwise("url_article")
    )


def roman_value(c: Column) -> Column:
    """Value of a Roman numeral."""
    n = F.transform(F.filter(F.split(F.lower(c), ""), lambda x: x != ""), lambda x: F.when(x == "m", 1000).when(x == "d", 500).when(x == "c", 100).when(x == "l", 50).when(x == "x", 10).when(x == "v", 5).otherwise(1))
    return F.aggregate(
        n,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")),
        lambda a, x: F.struct((a.total + x - F.when(a.last < x, 2 * a.last).otherwise(0)).alias("total"), x.alias("last")),
        lambda a: a.total.cast("long"),
    )


def page_candidates(c: Column) -> Column:
    """Printed page number of a short text by the first pattern that fits, or null."""
    # dots and dashes of all kinds as one, then the same frame around a number for each of them, then labels, then a bare number
    t = F.regexp_replace(F.regexp_replace(c, "[·•∙・]", "·"), "[–—]", "-")
    framed = [rf"{mark}\s*(\d{{1,4}})\s*{mark}" for mark in ("·", "-")]
    labelled = [rf"{before}\s*(\d{{1,4}}){after}" for before, after in (("第", r"\s*[页頁]"), (r"[Pp]age\s", ""), (r"[Ss]\.", ""), (r"[Pp]\.", ""))]
    value = F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (*framed, *labelled, r"^\s*(\d{1,4})\s*$"))).cast("long")
    return F.when(value.between(1, 9999), value)


def date_parts(c: Column) -> Column:
    """Year, month and day that a text prints, in its own precision, as ``y``, ``y-m`` or ``y-m-d``; or null."""
    months = "January February March April May June July August September October November December".split()
    number = lambda x: x.cast("int").cast("string")
    name = "(" + "|".join(months) + ")"
    month = lambda x: F.array_position(F.array(*map(F.lit, months)), x).cast("string")
    g = lambda p, i: F.regexp_extract(c, p, i)
    cjk, iso, ym = r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", r"(\d{4})[-/](\d{1,2})(?:[^\d-/]|$)"
    long1, long2, my, y = name + r" (\d{1,2}), (\d{4})", r"(\d{1,2}) " + name + r" (\d{4})", name + r" (\d{4})", r"(?:^|[^\p{L}\p{N}_])([12]\d{3})(?:$|[^\p{L}\p{N}_])"
    return (
        F.when(c.rlike(cjk), F.concat_ws("-", g(cjk, 1), number(g(cjk, 2)), number(g(cjk, 3))))
        .when(c.rlike(iso), F.concat_ws("-", g(iso, 1), number(g(iso, 2)), number(g(iso, 3))))
        .when(c.rlike(long1), F.concat_ws("-", g(long1, 3), month(g(long1, 1)), number(g(long1, 2))))
        .when(c.rlike(long2), F.concat_ws("-", g(long2, 3), month(g(long2, 2)), number(g(long2, 1))))
        .when(c.rlike(ym), F.concat_ws("-", g(ym, 1), number(g(ym, 2))))
        .when(c.rlike(my), F.concat_ws("-", g(my, 2), month(g(my, 1))))
        .when(c.rlike(y), g(y, 1))
    )


def page_list(spec: Column, total: Column) -> Column:
    """Sorted distinct pages of a selection such as ``1-5, -3``; ends are clamped to 1..total."""
    part = lambda p: (
        F.when(p.rlike(r"^-\d+$"), F.sequence(F.greatest(F.lit(1), total + p.try_cast("int") + 1), total))
        .when(p.rlike(r"^\d+\s*-\s*\d+$"), _span(F.split(p, "-")[0].try_cast("int"), F.split(p, "-")[1].try_cast("int"), total))
        .when(p.rlike(r"^\d+$"), _span(p.try_cast("int"), p.try_cast("int"), total))
        .otherwise(F.array().cast("array<int>"))
    )
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.transform(F.split(spec, ","), lambda p: F.trim(p)), part))))


def _span(a: Column, b: Column, total: Column) -> Column:
    low, high = F.greatest(a, F.lit(1)), F.least(b, total)
    return F.when((a <= b) & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


# Words that end a publisher's name.
PUBLISHER_WORDS = "press|publications|verlag|books|inc|ltd|university|publisher|出版社|书局"


def split_publisher(c: Column) -> tuple[Column, Column]:
    """Place and publisher of an imprint; the comma form only before a publisher word (X06). Null where it doesn't split."""
    colon = r"^(.*\S)\s*[:：]\s*([^:：,]*\S)\s*$"
    comma = r"^(.*\S)\s*,\s*([^:：,]*\S)\s*$"
    like = F.lower(F.rtrim(F.regexp_extract(c, comma, 2), F.lit("."))).rlike(f"(?:{PUBLISHER_WORDS})$")
    pick = lambda i: F.when(c.rlike(colon), F.trim(F.regexp_extract(c, colon, i))).when(c.rlike(comma) & like, F.trim(F.regexp_extract(c, comma, i)))
    return pick(1), pick(2)


def split_title(c: Column) -> tuple[Column, Column]:
    """Title and subtitle at the first colon, if three characters follow (X06). Null where it doesn't split."""
    p = r"^([^:：]*(?::[^\s:：][^:：]*)*?)(?::\s+|\s*：\s*)(.*)$"
    head, tail = F.trim(F.regexp_extract(c, p, 1)), F.trim(F.regexp_extract(c, p, 2))
    ok = c.rlike(p) & (head != "") & (F.length(tail) >= 3)
    return F.when(ok, head), F.when(ok, tail)


# Eras and the year before their first.
ERAS = {"民國": 1911, "明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}


def era_year(c: Column) -> Column:
    """Year of an era in the common calendar, or null."""
    number = F.regexp_extract(c, r"(\d+)年", 1).try_cast("long")
    out = F.lit(None).cast("long")
    for name, before in ERAS.items():
        out = F.when(c.contains(name), number + before).otherwise(out)
    return out
