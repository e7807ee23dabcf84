"""The record library: listing, search, lookup and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T


def listing(records: DataFrame, order: str, limit: int = 20, offset: int = 0, kind: str | None = None) -> DataFrame:
    """Newest first, with the total before paging (T01). limit is held to 1..100, offset to 0 or more."""
    limit, offset = max(1, min(limit, 100)), max(0, offset)
    own = records if kind is None else records.where(F.col("type") == kind)
    total = own.agg(F.count(F.lit(1)).alias("total"))
    page = own.orderBy(F.desc(order)).offset(offset).limit(limit)
    return page.join(F.broadcast(total))  # one row


def search_score(needle: str, title: Column, authors: Column, doi: Column, url: Column, container: Column, folder: Column) -> Column:
    """Score of a record for a search text; the first rule that fits counts."""
    n, low = needle.strip().lower(), lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (
        F.when(low(title) == n, 100)
        .when(low(title).contains(n), 60)
        .when(low(doi) == n, 90)
        .when(low(url) == n, 85)
        .when(low(authors).contains(n), 40)
        .when(low(container).contains(n), 30)
        .when(low(folder).contains(n), 20)
        .otherwise(0)
        .cast("long")
    )


def search(records: DataFrame, score: Column, order: str, limit: int = 10) -> DataFrame:
    """Best records by score, newest first among equals; limit is held to 1..50."""
    return records.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc(order)).limit(max(1, min(limit, 50)))


def matches_id(target: Column, *keys: Column) -> Column:
    """Whether one of the keys equals the target but for case."""
    return F.exists(F.array(*[F.lower(k) for k in keys]), lambda k: F.coalesce(k == F.lower(F.trim(target)), F.lit(False)))


def citation(author: Column, title: Column, container: Column, place: Column, publisher: Column, year: Column, url: Column) -> Column:
    """Plain rendering of a record (K08): defaults Unknown and n.d., absent parts left out."""
    some = lambda c, f: F.when(F.coalesce(c, F.lit("")) != "", f(c))
    imprint = F.concat_ws("：", some(place, lambda c: c), some(publisher, lambda c: c))
    dated = F.concat_ws(", ", F.when(imprint != "", imprint), F.coalesce(some(year, lambda c: c), F.lit("n.d.")))
    return F.concat(F.concat_ws(". ", F.coalesce(some(author, lambda c: c), F.lit("Unknown")), some(title, lambda c: F.concat(F.lit("*"), c, F.lit("*"))), some(container, lambda c: F.concat(F.lit("*"), c, F.lit("*"))), dated, some(url, lambda c: F.concat(F.lit("URL: "), c))), F.lit("."))


def distinct_identities(results: DataFrame, key: str, identity: str, order: str, k: int = 5) -> DataFrame:
    """The first k distinct identities of each query in provider order."""
    first = results.groupBy(key, identity).agg(F.min(order).alias(order))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order, identity)).cast("long")).where(F.col("place") <= k)


def lookup(records: DataFrame, key: str, columns: list[str], targets: DataFrame) -> DataFrame:
    """Records that one of some ids names, but for case and blanks at the ends (J21): target, key. The join is by id, not by an OR of conditions."""
    ids = records.select(key, F.explode(F.array_distinct(F.array(*(F.lower(c) for c in columns)))).alias("__id")).where("__id is not null")
    return targets.select("target", F.lower(F.trim("target")).alias("__id")).join(ids, "__id").select("target", key).distinct()


def physical_index(c: Column) -> Column:
    """The number of the first tagged page index in a text, or null."""
    return F.regexp_extract(c, r"<physical_index_(\d+)>", 1).try_cast("long")


def ordered_fields(fields: Column, order: list[str]) -> Column:
    """The entries of a map that are listed, in that order; others and missing ones are dropped."""
    return F.filter(F.transform(F.array(*map(F.lit, order)), lambda k: F.struct(k.alias("key"), F.try_element_at(fields, k).alias("value"))), lambda kv: kv.value.isNotNull())


def person_surface(family: Column, given: Column, literal: Column) -> tuple[Column, Column]:
    """What a person is searched by: the family name and given name, else the name as a whole."""
    named = F.coalesce(family, F.lit("")) != ""
    return F.when(named, family).otherwise(F.coalesce(literal, F.lit(""))), F.when(named, F.nullif(given, F.lit("")))


def listed_authors(c: Column) -> Column:
    """Names of a comma-separated text, in order."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_listed(c: Column) -> Column:
    """The first entry of a comma-separated text."""
    return F.trim(F.split(c, ",")[0])


def batch_kind(c: Column) -> Column:
    """The kind that a batch's file name begins with."""
    return F.regexp_extract(c, r"^([^_.]*)", 1)


def table_row(*cells: Column | str) -> Column:
    """One row of a Markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown(records: DataFrame, blocks: DataFrame, key: str, header: list[str]) -> DataFrame:
    """One Markdown text per record (K04): a YAML header, title, citation, body in order with page marks, and numbered notes.

    records: key, the header's columns, title, citation. blocks: key, ord, page, first (of its page), text, note
    (whether it is one as well). Texts of a record are gathered in order: a record is one row.
    """
    body = F.concat(F.when(F.col("first"), F.concat(F.lit("<!-- page "), F.col("page"), F.lit(" -->\n"))).otherwise(""), F.col("text"))
    own = blocks.withColumn("body", body).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "body", F.when(F.col("note"), F.col("text")).alias("note")))).alias("b"))
    notes = F.transform(F.filter("b", lambda x: x.note.isNotNull()), lambda x, i: F.concat(F.lit("[^"), i + 1, F.lit("]: "), x.note))
    top = F.concat_ws("\n", F.lit("---"), *(F.concat(F.lit(f"{c}: "), T.yaml_escaped(F.col(c))) for c in header), F.lit("---"))
    text = F.concat_ws("\n\n", top, F.concat(F.lit("# "), F.col("title")), F.col("citation"), F.array_join(F.transform("b", lambda x: x.body), "\n"), F.when(F.size(notes) > 0, F.array_join(notes, "\n")))
    return records.join(own, key).select(key, text.alias("markdown"))


def refresh_target(html: Column) -> Column:
    """Where a page's refresh tag sends its reader, or null."""
    tag = F.regexp_extract(html, r"(?i)<meta\b(?=[^>]*http-equiv\s*=\s*[\"']?refresh)([^>]*)>", 1)
    return F.nullif(F.trim(F.regexp_extract(tag, r"(?i)content\s*=\s*\"\s*\d+(?:\.\d+)?\s*;\s*url\s*=\s*['\"]?([^'\";]+)", 1)), F.lit(""))


def refresh_chains(pages: DataFrame, most: int = 5) -> DataFrame:
    """Where each page leads by refresh tags, ``most`` of them at most (S08): url, final_url, state (article, cycle, unresolved), hops.

    One equi-join per hop over the pages' (url, target) pairs; a page without a tag is the article, a page that
    leads back is a cycle, and one whose chain is too long or leaves the table is unresolved.
    """
    links = pages.select("url", refresh_target(F.col("html")).alias("target"))
    hop = links.select(F.col("url").alias("__url"), F.col("target").alias("__target"))
    c = links.select(F.col("url").alias("start"), "url", "target", F.lit(0).cast("long").alias("hops"), F.array("url").alias("seen"), F.lit(False).alias("cycle"))
    for _ in range(most):
        moves = F.col("__url").isNotNull() & ~F.col("cycle")
        c = c.join(hop, (F.col("target") == F.col("__url")) & ~F.col("cycle"), "left").select(
            "start", F.when(moves, F.col("__url")).otherwise(F.col("url")).alias("url"), F.when(moves, F.col("__target")).otherwise(F.col("target")).alias("target"), (F.col("hops") + moves.cast("long")).alias("hops"),
            F.when(moves, F.concat("seen", F.array("__url"))).otherwise(F.col("seen")).alias("seen"), (F.col("cycle") | (moves & F.array_contains("seen", F.col("__url")))).alias("cycle"),
        )
    done = ~F.col("cycle") & F.col("target").isNull()
    return c.select(F.col("start").alias("url"), F.when(done, F.col("url")).alias("final_url"), F.when(F.col("cycle"), "cycle").when(done, "article").otherwise("unresolved").alias("state"), "hops")
