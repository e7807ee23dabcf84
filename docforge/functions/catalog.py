"""Cataloguing blocks and reference strings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions import ident as I
from docforge.functions.text import bound

CANDIDATES = "array<struct<field:string,value:string,confidence:double,quote:string>>"
# The separators and anchors of a Chinese cataloguing statement, as printed and as recognisers garble them.
_DOT, _COLON, _SLASH, _COMMA, _DASH = "．.·一。", "：:", "/／", "，,", "—–―-"
_HEAD = rf"([^\s{_SLASH}{_COLON}].{{1,120}}?)(?:\s*[{_COLON}]\s*([^{_SLASH}]{{1,120}}?))?\s*[{_SLASH}]\s*([^{_DOT}]{{2,120}}?)\s*[{_DOT}]\s*[{_DASH}]{{0,2}}\s*"
_TAIL = rf"([^{_COMMA}]{{2,40}}?)\s*[{_COMMA}]\s*((?:19|20)\d{{2}})"
MAIN = rf"{_HEAD}([^{_COLON}{_DOT}{_DASH}]{{1,20}}?)\s*[{_COLON}]\s*{_TAIL}"
NO_COLON = rf"{_HEAD}([^{_DOT}{_COMMA}]{{1,12}}?)[{_DOT}]\s*{_TAIL}"
HEADER, CERTIFICATE = r"(?i)图书在版编目\s*[（(]\s*CIP\s*[)）]\s*数据", r"CIP数据核字\s*[（(]\s*\d{4}\s*[)）]\s*第\s*\d+\s*号"
GARBLED_HEADER, GARBLED_CERTIFICATE = r".{0,3}书在版编目[（(]CIP[)）]数据", r"CIP数据核字[（(]\d{4}[)）]第?\d+[】\]]*号"
SERIES = r"[（(]\s*([^（）()]{2,30}?)\s*[/／;；,，]\s*[^（）()]{0,12}?\s*[)）]"
PUBLISHERS = "出版(?:集团|集團)|出版中心|出版社|印书馆|印書館|书局|書局"
ROLES = "校订|校訂|校译|校譯|译注|譯注|编译|編譯|主编|主編|编著|編著|编写|編寫|改编|改編|整理|摄影|绘|繪|著|编|編|译|譯|校|撰"
TRANSLATORS = ("译", "譯", "译注", "譯注", "校译", "校譯", "翻译", "翻譯")
COUNTRY = r"^[\[［【(（〔][^\]］】)）〕]{1,8}[\]］】)）〕]\s*"
NOISE = "[ •·・,，、;；]+"
ISBN_LINE = r"ISBN\s*[:：]?\s*([\d\-–\s]+)"
# The anchor of an English cataloguing block.
ANCHOR = r"(?i)Library\s+of\s+Congress\s+Catalogu?ing[- ]in[- ]Publication|Catalogu?ing[- ]in[- ]Publication\s+Data"
# The phrases that introduce a citation of the page itself, in order, each with what ends it; and pointers to a policy.
GUIDANCE = (
    r"若要转载请参考如下格式[：:]\s*((?s:.*?))(?:。|$)",
    r"版权(?:声明|申明)\s*[：:]\s*若要(?:转载或引用|引用)(?:本文|此文)?[，,]?\s*(?:请(?:按|参考|采用|用)以下格式[：:]?\s*)?((?s:.*?))(?:。|$)",
    r"若要转载或引用此文[，,]?\s*请用以下格式[：:]?\s*((?s:.*?))(?:。|$)",
    r"若参考了这篇中译[，,]?\s*请注明引用格式如下[：:]?\s*((?s:.*?))(?:。|$)",
    r"引用本文\s*[：:]\s*([^\n]+(?:\n[^\S\n]*[^\s][^\n]*){0,2})",
    r"引用此文\s*[：:]\s*([^\n]+(?:\n[^\S\n]*[^\s][^\n]*){0,2})",
    r"引用格式\s*[：:]\s*((?s:.*?))(?:。|$)",
    r"版权申明\s*[：:]\s*若您想转载此文[，,]?\s*((?s:.*?))(?:。|请按|$)",
    r"若要引用(?:本文|此文)?[，,]?\s*(?:请(?:按|参考|采用)以下格式[：:]?\s*)?((?s:.*?))(?:。|也请参考|$)",
    r"(?i)Cite\s+this\s+(?:article|entry)\s*[：:\n]\s*((?s:.*?))(?:\n\n|\n##|$)",
    r"(?i)This\s+(?:article|work|topic page)\s+can\s+be\s+cited\s+as[：:]\s*`?([^\n`]+)",
    r"Zitierweise\s*[：:]\s*((?s:.*?))(?:\n\n|$)",
    r"(?i)Pour\s+citer\s*[：:]\s*((?s:.*?))(?:\n\n|$)",
)
POLICY = r"^(?:请(?:参考|参阅|见)?\s*)?\[?\s*版权(?:声明|申明)"
# Marks of the national reference standard and their kinds of work.
MARKS = {"J": "article-journal", "D": "thesis", "M": "book", "C": "paper-conference", "N": "article-newspaper", "R": "report", "S": "report", "EB": "webpage", "DB": "webpage"}
REFERENCE = r"(?is)^\s*([^.．]+?)\s*[.．]\s*(.+?)\s*\[\s*(EB/OL|DB/OL|J/OL|M/OL|J|D|M|C|N|R|S|P|A|G|Z)\s*\]\s*(.*)$"
_YEARS = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)"
_PAGES = r"[:：]\s*([A-Za-z]?\d+(?:\s*[-–—]\s*[A-Za-z]?\d+)?)\s*[.．]?\s*$"
JOURNAL = r"^([^,，]+?)\s*[,，]\s*(\d{4})(?:\s*[,，]\s*([^,，(（:：]+))?(?:\s*[（(]\s*([^)）]+)\s*[)）])?(?:\s*[:：]\s*([^.,，。]+))?"
IMPRINT = r"^([^:：.]+?)\s*[:：]\s*([^,，]+?)\s*[,，]\s*(\d{4})(?:\s*[:：]\s*([^.,，。]+))?"
CONTAINER = r"^//\s*([^.．]+?)\s*[.．]\s*"


def joined_cjk(c: Column) -> Column:
    """Without white space between two Chinese characters."""
    return F.regexp_replace(F.trim(c), r"(?<=[\x{3400}-\x{9fff}])\s+(?=[\x{3400}-\x{9fff}])", "")


def person_of(statement: Column) -> tuple[Column, Column]:
    """Name and last role word of a statement of responsibility, without country and separators."""
    bare = F.regexp_replace(F.regexp_replace(statement, f"^{NOISE}|{NOISE}$", ""), r"^\s+|\s+$", "")
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, COUNTRY, ""), f"^{NOISE}|{NOISE}$", ""), rf"(?:\s*(?:{ROLES}))+\s*$", "")
    return F.trim(name), F.regexp_extract(bare, rf"({ROLES})\s*$", 1)


def _some(value: Column) -> Column:
    """A text without blanks at its ends, or null."""
    return bound(F.trim(value), lambda v: F.when(v != "", v))


def _field(name: Column | str, value: Column, confidence: Column, quote: Column) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    return F.struct(name.alias("field"), _some(value).alias("value"), confidence.cast("double").alias("confidence"), F.trim(quote).alias("quote"))


def _given(fields: Column) -> Column:
    return F.filter(fields, lambda f: f.value.isNotNull()).cast(CANDIDATES)


def cip(text: Column) -> Column:
    """Fields of a Chinese cataloguing-in-publication block, title / responsibility. place : publisher, year.

    An anchored block counts 0.99, another 0.9. Under a garbled anchor the block is read again without white
    space and Latin parentheses, and its title and series are left out. Nothing of this shape: an empty list.
    """
    strict = lambda t: t.rlike(HEADER) | t.rlike(CERTIFICATE)
    forms = bound(text, lambda t: F.struct(t.alias("text"), F.regexp_replace(t, r"\s+", "").alias("collapsed"), strict(t).alias("strict")))
    garbled = lambda f: ~f.strict & (f.collapsed.rlike(GARBLED_HEADER) | f.collapsed.rlike(GARBLED_CERTIFICATE))
    return bound(bound(forms, lambda f: F.struct(f.text.alias("text"), f.collapsed.alias("collapsed"), f.strict.alias("strict"), garbled(f).alias("garbled"))), _cip_of)


def _cip_of(block: Column) -> Column:
    body = F.regexp_replace(block.collapsed, rf"^.*?(?:(?i:图书在版编目[（(]CIP[)）]数据)|{GARBLED_HEADER})", "")
    body = F.regexp_replace(F.regexp_replace(body, "[(（][^()（）]*?[A-Za-z][^()（）]*?[)）]", ""), "([著编译校撰订辑理])I", "$1；")
    parts = F.coalesce(F.when(~block.garbled, _read(block.text)), F.when(block.strict | block.garbled, _read(body)))
    return bound(parts, lambda part: _cip_fields(block, part))


def _read(text: Column) -> Column:
    """The match and the six groups of the first pattern that fits, or null. Each pattern runs once: failing and wide character classes are slow."""
    groups = lambda c, p: F.when(c.rlike(p), F.array(*(F.regexp_extract(c, p, i) for i in range(7))))
    mark = lambda c, p: F.regexp_replace(c, rf"({p})(?s:.*)", "\x02" + "\x01".join(f"${i}" for i in range(1, 8)))
    cut = lambda c, p: bound(F.get(F.split(mark(c, p), "\x02"), F.lit(1)), lambda m: F.split(m, "\x01"))
    first = lambda f, c: F.coalesce(f(c, MAIN), f(c, NO_COLON))
    return bound(text, lambda c: F.when(c.rlike(r"[\x01\x02]"), first(groups, c)).otherwise(first(cut, c)))


def _cip_fields(block: Column, part: Column) -> Column:
    at = lambda i: F.get(part, F.lit(i))
    sure, quote = F.when(block.strict | block.garbled, 0.99).otherwise(0.9), at(0)

    def person(p: Column) -> Column:
        name, role = person_of(p)
        return _field(F.when(role.isin(*TRANSLATORS), "translator").otherwise("authors"), joined_cjk(name), sure, quote)

    named = lambda publisher: F.when(publisher.rlike(PUBLISHERS) | publisher.rlike("[A-Za-z]"), publisher)
    numbers = F.filter(F.transform(F.regexp_extract_all(block.text, F.lit(ISBN_LINE), F.lit(1)), lambda x: F.regexp_replace(x, r"[\s–-]", "")), I.isbn13_valid)
    around = F.replace(block.text, quote, F.lit("\n"))
    fields = F.concat(
        F.when(block.garbled, F.array().cast(CANDIDATES)).otherwise(
            F.array(_field("series", joined_cjk(F.regexp_extract(around, SERIES, 1)), sure, F.regexp_extract(around, SERIES, 0)), _field("title", joined_cjk(at(1)), sure, quote), _field("subtitle", joined_cjk(at(2)), sure, quote))
        ),
        F.transform(F.split(at(3), "[;；]"), person),
        F.array(
            _field("place", joined_cjk(F.regexp_replace(at(4), "^一", "")), sure, quote),
            _field("publisher", bound(F.regexp_replace(at(5), r"\s+", ""), named), sure, quote),
            _field("year", at(6), sure, quote),
            bound(F.get(numbers, F.lit(0)), lambda number: _field("ISBN", number, sure, number)),
        ),
    )
    return F.when(part.isNotNull(), _given(fields)).otherwise(F.array().cast(CANDIDATES))


def labelled(text: Column, label: str) -> Column:
    """Parts of a labelled line, cut at upright bars."""
    line = F.regexp_extract(text, rf"(?:^|\n)\s*{label}\s*:\s*([^\n]+)", 1)
    return F.filter(F.transform(F.split(line, r"\|"), lambda s: F.trim(s)), lambda s: s != "")


def loc_cip(text: Column) -> Column:
    """Fields of a labelled English cataloguing block at 0.98; an empty list without its anchor."""
    return bound(text, lambda t: F.when(t.rlike(ANCHOR), _given(_loc_fields(t))).otherwise(F.array().cast(CANDIDATES)))


def _loc_fields(text: Column) -> Column:
    sure = F.lit(0.98)
    first = lambda xs: F.get(xs, F.lit(0))
    imprint = r"([A-Z][A-Za-z .\-]{1,40}(?:\s*[;,]\s*[A-Z][A-Za-z .\-]{1,40}){0,2})\s*:\s*([A-Z][\p{L}\p{N}_&'’.,\- ]{1,80}?)\s*,\s*\[?((?:19|20)\d{2})\]?"
    written = r"^([A-ZÀ-ÖØ-Þ][\p{L}\p{N}_'’.\-]*),\s*([A-ZÀ-ÖØ-Þ][\p{L}\p{N}_'’.\- ]*?)\s*$"

    def titles(raw: Column) -> Column:
        whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\s+/\s+.*$", ""), r"\s+([:;,.])", "$1"), r"^[ .]+|[ .]+$", "")
        quote = F.concat(F.lit("Title: "), raw)
        return bound(F.split(whole, "[:：]", 2), lambda parts: F.array(_field("title", F.trim(F.get(parts, F.lit(0))), sure, quote), _field("subtitle", F.get(parts, F.lit(1)), sure, quote)))

    def author(name: Column) -> Column:
        known = lambda tidy: F.when(tidy.rlike(written), F.concat(F.regexp_extract(tidy, written, 1), F.lit(", "), F.regexp_extract(tidy, written, 2)))
        return F.array(_field("author", bound(F.regexp_replace(name, r"^[ .]+|[ .]+$", ""), known), sure, F.concat(F.lit("Names: "), name)))

    def imprints(desc: Column) -> Column:
        of = lambda i: F.regexp_extract(desc, imprint, i)
        return F.array(_field("place", F.get(F.split(of(1), r"\s*;\s*"), F.lit(0)), sure, desc), _field("publisher", F.regexp_replace(of(2), r"^[ ,.]+|[ ,.]+$", ""), sure, desc), _field("year", of(3), sure, desc))

    def numbers(idents: Column) -> Column:
        return bound(F.transform(idents, lambda x: F.regexp_replace(F.regexp_extract(x, r"(?i)ISBN\s*[:：]?\s*([\d\-]+)", 1), "-", "")), lambda found: bound(F.array_position(F.transform(found, I.isbn13_valid), F.lit(True)), lambda at: numbered(idents, found, at)))

    def numbered(idents: Column, found: Column, at: Column) -> Column:
        upto = F.slice(idents, F.lit(1), F.when(at > 0, at).otherwise(F.size(idents)).cast("int"))
        control = first(F.filter(F.transform(upto, lambda x: F.regexp_extract(x, r"LCCN\s+(\d+)", 1)), lambda x: x != ""))
        isbn = F.when(at > 0, F.get(found, (at - 1).cast("int")))
        return F.array(_field("ISBN", isbn, sure, isbn), bound(control, lambda c: _field("LCCN", c, sure, F.concat(F.lit("LCCN "), c))))

    other = lambda name, label: F.array(bound(first(labelled(text, label)), lambda v: _field(name, v, sure, v)))
    desc = first(F.filter(labelled(text, "Description"), lambda d: d.rlike(imprint)))
    return F.concat(
        bound(first(labelled(text, "Title")), titles), bound(first(labelled(text, "Names")), author), bound(desc, imprints), bound(labelled(text, "Identifiers"), numbers),
        other("subjects", "Subjects"), other("classification", "Classification"),
    )


def guidance(text: Column) -> Column:
    """The citation that a page asks for: the first pattern in order that gives over ten characters and no policy pointer."""
    def cleaned(c: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "<[^>]+>", "")
        bare = F.regexp_replace(F.regexp_replace(bare, r"(?m)\[#\].*$", ""), r"^\s+|\s+$", "")
        return F.regexp_replace(F.regexp_replace(bare, r"\[([^\]]+)\]\[[^\]]*\]", "$1"), r"\[([^\]]+)\]\([^\)]*\)", "$1")

    found = [cleaned(F.regexp_extract(text, p, 1)) for p in GUIDANCE]
    return F.coalesce(*(F.when((F.length(c) > 10) & ~c.rlike(POLICY), c) for c in found))


def reference(text: Column) -> Column:
    """A reference of the national standard, ``authors. title[mark]. source``, as a struct; null for anything else.

    Its source is read by the mark: a journal with year, volume, issue and pages; a container; an imprint; or
    just a year and pages.
    """
    c = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"^(?:引用本文|引用此文|本文引用格式|引用格式)\s*[：:]\s*", "")
    groups = lambda c: F.when(c.rlike(REFERENCE), F.array(*(F.regexp_extract(c, REFERENCE, i) for i in range(1, 5))))
    return bound(bound(c, groups), _reference_of)


def _reference_of(groups: Column) -> Column:
    g = lambda i: F.get(groups, F.lit(i - 1))
    mark = F.regexp_extract(F.upper(g(3)), "^[A-Z]+", 0)
    title = F.regexp_replace(g(2), r"^[\s.．]+|[\s.．]+$", "")
    rest = F.regexp_replace(g(4), r"^[\s.．]+", "")
    boxed = lambda p: F.struct(p.who, p.title, p.mark, p.rest, ((p.mark == "C") & p.rest.rlike(CONTAINER)).alias("boxed"))
    tailed = lambda p: F.struct(p.who, p.title, p.mark, p.rest, p.boxed, F.when(p.boxed, F.regexp_replace(p.rest, CONTAINER, "")).otherwise(p.rest).alias("tail"))
    form = lambda p: F.when((p.mark == "J") & p.rest.rlike(JOURNAL), "journal").when(p.mark.isin("M", "D", "R", "C") & (p.boxed | (p.mark != "C")) & p.tail.rlike(IMPRINT), "imprint").otherwise("")
    parts = bound(bound(F.struct(g(1).alias("who"), title.alias("title"), mark.alias("mark"), rest.alias("rest")), boxed), tailed)
    return bound(parts, lambda p: F.when(p.title != "", bound(form(p), lambda f: _source(p, f == "journal", f == "imprint"))))


def _source(p: Column, journal: Column, imprint: Column) -> Column:
    j, m = (lambda i: _some(F.regexp_extract(p.rest, JOURNAL, i))), (lambda i: _some(F.regexp_extract(p.tail, IMPRINT, i)))
    pages = lambda x: F.regexp_replace(F.regexp_replace(x, r"[.．]+$", ""), r"\s+", "")
    kind = F.lit("document")
    for k, v in MARKS.items():
        kind = F.when(p.mark == k, v).otherwise(kind)
    authors = F.filter(F.transform(F.split(F.regexp_replace(p.who, r"[.．\s]+$", ""), r"[,，;；]\s*|\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")
    return F.struct(
        p.title.alias("title"), kind.alias("type"), F.array_distinct(authors).alias("authors"),
        F.when(journal, j(1)).when(p.boxed, _some(F.regexp_extract(p.rest, CONTAINER, 1))).alias("container"),
        F.when(journal, j(2)).when(imprint, m(3)).otherwise(_some(F.regexp_extract(p.tail, _YEARS, 1))).try_cast("int").alias("year"),
        F.when(journal, j(3)).alias("volume"), F.when(journal, j(4)).alias("issue"),
        F.when(journal, pages(j(5))).when(imprint, pages(m(4))).otherwise(pages(_some(F.regexp_extract(p.tail, _PAGES, 1)))).alias("page"),
        F.when(imprint, m(1)).alias("place"), F.when(imprint, m(2)).alias("publisher"),
        F.when(p.mark.isin("EB", "DB"), _some(F.regexp_replace(F.regexp_extract(p.rest, r"(?i)https?://\S+", 0), "[.,，。]+$", ""))).alias("url"),
    )


def titles_match(a: Column, b: Column) -> Column:
    """Equal letters and digits, or one of eight or more inside the other."""
    x, y = (F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}\p{N}]+", "") for t in (a, b))
    return (x != "") & (y != "") & ((x == y) | ((F.length(x) >= 8) & (F.instr(y, x) > 0)) | ((F.length(y) >= 8) & (F.instr(x, y) > 0)))
