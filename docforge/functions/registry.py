"""Payloads of registries as bibliographic columns: JSON texts in, no Python.

Each normaliser takes a JSON column and returns a struct of FIELDS; what a payload lacks is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions import ident as I
from docforge.functions.text import bound

PEOPLE = "array<struct<family:string,given:string,literal:string>>"
FIELDS = ("type", "title", "subtitle", "container", "publisher", "place", "page", "volume", "issue", "url", "doi", "isbn", "issn", "language", "edition", "issued", "author", "editor", "translator")
# Kinds of work of each registry.
CROSSREF_TYPES = {"journal-article": "article-journal", "journal": "article-journal", "book": "book", "book-chapter": "chapter", "proceedings-article": "paper-conference", "report": "report", "dissertation": "thesis", "posted-content": "article"}
DATACITE_TYPES = {"Dissertation": "thesis", "Report": "report", "Dataset": "dataset", "Book": "book", "BookChapter": "chapter", "JournalArticle": "article-journal"}
OPENALEX_TYPES = {"article": "journal-article"}
DATES = ("published-print", "issued", "published-online", "published")


def filled(c: Column) -> Column:
    """A text without blanks at its ends, or null."""
    return F.nullif(F.trim(c), F.lit(""))


def first_text(json: Column, path: str) -> Column:
    """A text, or the first one of a list that isn't blank, at a path."""
    listed = lambda raw: F.get(F.filter(F.transform(F.from_json(raw, "array<string>"), filled), lambda x: x.isNotNull()), F.lit(0))
    return bound(F.get_json_object(json, path), lambda raw: F.when(raw.startswith("["), listed(raw)).otherwise(filled(raw)))


def mapped(c: Column, names: dict[str, str], other: str) -> Column:
    """A name by a table; a missing one stays null."""
    out = F.when(c.isNotNull(), other)
    for k, v in names.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def people(persons: Column) -> Column:
    """Names of a list of (family, given, name): the family with its given name, else the name as a whole; null for none."""
    one = lambda p: F.struct(filled(p.family).alias("family"), F.when(filled(p.family).isNotNull(), filled(p.given)).alias("given"), F.when(filled(p.family).isNull(), filled(p["name"])).alias("literal"))
    kept = F.filter(F.transform(persons, one), lambda p: p.family.isNotNull() | p.literal.isNotNull())
    return bound(kept, lambda k: F.when(F.size(k) > 0, k))


def _persons(json: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(json, path), "array<struct<family:string,given:string,name:string>>")


def date_parts(json: Column) -> Column:
    """Year, month and day of the first date that has whole numbers, as far as it goes."""
    dates = [F.from_json(F.get_json_object(json, f"$.{k}.date-parts[0]"), "array<int>") for k in DATES]
    return F.coalesce(*(bound(d, lambda d: F.when((F.size(d) > 0) & F.forall(d, lambda x: x.isNotNull()), d)) for d in dates))


def year_parts(c: Column) -> Column:
    """A year from 1000 to 9999 as date parts."""
    return bound(c.try_cast("int"), lambda year: F.when(year.between(1000, 9999), F.array(year)))


def _struct(**fields: Column) -> Column:
    none = {"issued": "array<int>", "author": PEOPLE, "editor": PEOPLE, "translator": PEOPLE}
    return F.struct(*(fields.get(n, F.lit(None)).cast(none.get(n, "string")).alias(n) for n in FIELDS))


def crossref(json: Column) -> Column:
    """A work message of the DOI registry for publications."""
    return bound(json, _crossref)


def _crossref(json: Column) -> Column:
    t = lambda k: first_text(json, f"$.{k}")
    return _struct(
        type=bound(t("type"), lambda k: mapped(k, CROSSREF_TYPES, "article")), title=t("title"), container=t("container-title"), publisher=t("publisher"), place=t("publisher-location"), page=t("page"), volume=t("volume"), issue=t("issue"), url=t("URL"),
        doi=I.doi(t("DOI")), isbn=t("ISBN"), issn=t("ISSN"), language=t("language"), edition=t("edition"), issued=date_parts(json), author=people(_persons(json, "$.author")), editor=people(_persons(json, "$.editor")), translator=people(_persons(json, "$.translator")),
    )


def openlibrary(json: Column, isbn: Column) -> Column:
    """An edition record; it is a book of the ISBN that was asked for."""
    return bound(json, lambda j: _openlibrary(j, isbn))


def _openlibrary(json: Column, isbn: Column) -> Column:
    def joined(path: str) -> Column:
        raw = F.get_json_object(json, path)
        parts = F.filter(F.transform(F.from_json(raw, "array<string>"), filled), lambda x: x.isNotNull())
        return F.when(raw.startswith("["), F.nullif(F.array_join(parts, " and "), F.lit(""))).otherwise(filled(raw))

    names = F.filter(F.transform(F.from_json(F.get_json_object(json, "$.authors"), "array<struct<name:string>>"), lambda p: F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), filled(p["name"]).alias("literal"))), lambda p: p.literal.isNotNull())
    year = F.regexp_extract(F.get_json_object(json, "$.publish_date"), r"\d{4}", 0).try_cast("int")
    return _struct(
        type=F.lit("book"), isbn=isbn, title=first_text(json, "$.title"), subtitle=first_text(json, "$.subtitle"), publisher=joined("$.publishers"), place=joined("$.publish_places"), edition=filled(F.get_json_object(json, "$.edition_name")),
        language=F.nullif(F.regexp_replace(F.get_json_object(json, "$.languages[0].key"), "^/languages/", ""), F.lit("")), issued=F.when(year.isNotNull(), F.array(year)), author=F.when(F.size(names) > 0, names),
    )


def datacite(json: Column) -> Column:
    """A work of the DOI registry for data; with or without its envelope."""
    return bound(F.coalesce(F.get_json_object(json, "$.attributes"), json), _datacite)


def _datacite(own: Column) -> Column:
    general, special = F.coalesce(F.get_json_object(own, "$.types.resourceTypeGeneral"), F.lit("")), F.lower(F.trim(F.coalesce(F.get_json_object(own, "$.types.resourceType"), F.lit(""))))
    loose = lambda k: k.general.isin("Text", "Other", "")
    kind = bound(F.struct(general.alias("general"), special.alias("special")), lambda k: F.when(loose(k) & k.special.isin("thesis", "dissertation"), "thesis").when(loose(k) & (k.special == "report"), "report").otherwise(mapped(k.general, DATACITE_TYPES, "article")))
    parsed = lambda path, more: F.from_json(F.get_json_object(own, path), f"array<struct<familyName:string,givenName:string,name:string{more}>>")
    named = lambda persons: people(F.transform(persons, lambda p: F.struct(p.familyName.alias("family"), p.givenName.alias("given"), p["name"].alias("name"))))
    helpers = parsed("$.contributors", ",contributorType:string")
    role = lambda kind: named(F.filter(helpers, lambda p: p.contributorType == kind))
    titles = F.filter(F.transform(F.from_json(F.get_json_object(own, "$.titles"), "array<struct<title:string>>"), lambda x: filled(x.title)), lambda x: x.isNotNull())
    return _struct(
        type=kind, title=F.get(titles, F.lit(0)), publisher=first_text(own, "$.publisher"), language=first_text(own, "$.language"), doi=I.doi(first_text(own, "$.doi")), issued=year_parts(F.get_json_object(own, "$.publicationYear")),
        author=named(parsed("$.creators", "")), editor=role("Editor"), translator=role("Translator"),
    )


def openalex(json: Column) -> Column:
    """A work of the open index; its kinds are those of the publications' registry but for articles."""
    return bound(json, _openalex)


def _openalex(json: Column) -> Column:
    g = lambda path: bound(F.get_json_object(json, path), filled)

    def kind(k: Column) -> Column:
        for name, other in OPENALEX_TYPES.items():
            k = F.when(k == name, other).otherwise(k)
        return bound(k, lambda x: mapped(x, CROSSREF_TYPES, "article"))

    ends = F.struct(g("$.biblio.first_page").alias("first"), g("$.biblio.last_page").alias("last"))
    page = bound(ends, lambda e: F.when(e.first.isNotNull(), F.concat(e.first, F.when(e.last.isNotNull() & (e.last != e.first), F.concat(F.lit("-"), e.last)).otherwise(""))))
    names = F.transform(F.from_json(F.get_json_object(json, "$.authorships"), "array<struct<author:struct<display_name:string>>>"), lambda p: F.struct(F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("given"), p.author.display_name.alias("name")))
    return _struct(
        type=bound(g("$.type"), kind), title=F.coalesce(g("$.title"), g("$.display_name")), container=g("$.primary_location.source.display_name"), publisher=g("$.primary_location.source.host_organization_name"), issn=first_text(json, "$.primary_location.source.issn"),
        volume=g("$.biblio.volume"), issue=g("$.biblio.issue"), language=g("$.language"), doi=I.doi(g("$.doi")), page=page,
        issued=year_parts(g("$.publication_year")), author=people(names),
    )


def provider_state(provider: Column, known: list[str], selected: Column, enabled: Column, offline: Column, user: Column, needs_user: list[str]) -> Column:
    """Why a provider is not asked, in order; null where it is."""
    return (
        F.when(~provider.isin(*known), "unsupported")
        .when(provider.isin(*needs_user) & (F.coalesce(user, F.lit("")) == ""), "no_username")
        .when(offline, "offline")
        .when(~enabled, "disabled")
        .when(~F.array_contains(selected, provider), "not_selected")
    )


def retry_delay(header: Column, now: Column) -> Column:
    """Seconds to wait: a number, or the time until an HTTP date, else half a second; never below 0."""
    number = F.when(header.rlike(r"^\s*\d+(?:\.\d+)?\s*$"), header.try_cast("double"))
    date = F.try_to_timestamp(F.regexp_extract(header, r"^\s*[A-Za-z]{3}, (\d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT\s*$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.greatest(F.lit(0.0), F.coalesce(number, F.unix_seconds(date).cast("double") - now, F.lit(0.5)))
