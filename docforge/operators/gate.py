"""The evidence gate: a value stands only on quoted spans that its source's blocks hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.functions.text import bound

# Reasons to drop a field, fields of persons, fields whose words may be laid out otherwise, and block keys that can't fill a field.
DROP_REASONS = ("not_found", "quote_mismatch", "empty", "wrong_role")
PERSONS = ("author", "editor", "translator", "interviewer", "host")
WORDED = (*PERSONS, "title", "subtitle", "publisher", "publisher-place")
NOT_PERSONS, NOT_TITLES = ("uploader", "channel", "platform"), ("filename", "source_path")
MOST_SPANS = 8


def found_at(quote: Column, text: Column, tight: tuple[Column, Column], loose: tuple[Column, Column]) -> Column:
    """Place (from 0) of a quote in a text: verbatim, else but for case and white space, else in presentation form (there, its place); or null.

    ``tight`` and ``loose`` are the compact and the presented forms of both.
    """
    held = lambda pair: bound(F.when(pair[0] != "", F.instr(pair[1], pair[0])), lambda at: F.when(at > 0, at))
    solid = F.array_compact(F.transform(F.split(text, ""), lambda c, i: F.when(~c.isin(*T.NO_SIGNS), i)))
    folded = bound(held(tight), lambda at: F.when(at.isNotNull(), F.get(solid, at - 1)).otherwise(held(loose) - 1))
    return bound(F.instr(text, quote), lambda at: F.when(at > 0, at - 1).otherwise(folded)).cast("long")


def wrong_role(field: Column, key: Column) -> Column:
    """Whether a block of this metadata key can't be the source of a field."""
    k = F.coalesce(key, F.lit(""))
    return (
        (field.isin(*PERSONS) & k.isin(*NOT_PERSONS))
        | ((field == "publisher") & (k == "platform"))
        | ((field == "title") & k.isin(*NOT_TITLES))
        | ((field == "accessed") & (k != "accessed"))
        | ((field == "issued") & (F.lower(k).contains("modified") | F.lower(k).isin("event-date", "event_date")))
    )


def supports(field: Column, value: Column, quote: Column) -> Column:
    """Whether a quote carries a value: its compact form, its words where layout may differ, or both ends of a page range."""
    ends = F.filter(F.split(value, r"\s*[-–—/]\s*"), lambda p: F.trim(p) != "")
    held = lambda form: F.instr(form(quote), form(value)) > 0
    return (
        (field == "type")
        | (F.instr(F.lower(T.squeezed(quote)), F.lower(T.squeezed(value))) > 0)
        | ((field == "page") & (F.size(ends) > 1) & F.forall(ends, lambda p: F.instr(T.compact(quote), T.compact(p)) > 0))
        | (field.isin(*WORDED) & (held(T.plain) | held(T.compact)))
    )


def _joined(quote: Column, here: tuple[Column, Column], after: tuple[Column, Column]) -> Column:
    """Whether a quote falls into two parts at one blank or line end, the first in a text and the second in the next one.

    ``here`` and ``after`` are the compact and the presented forms of both texts (a verbatim part is in these as well).
    """
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.length(quote) - 1, F.lit(2))), lambda i: F.substring(quote, i, F.lit(1)).isin(" ", "\n"))
    solid = lambda i: ~F.substring(quote, i - 1, F.lit(1)).rlike(r"\s") & ~F.substring(quote, i + 1, F.lit(1)).rlike(r"\s")
    in_ = lambda x, forms: ((T.compact(x) != "") & (F.instr(forms[0], T.compact(x)) > 0)) | ((T.presented(x) != "") & (F.instr(forms[1], T.presented(x)) > 0))
    return F.coalesce(F.exists(at, lambda i: solid(i) & in_(F.substring(quote, F.lit(1), i - 1), here) & in_(F.substring(quote, i + 1, F.length(quote)), after)), F.lit(False))


def gate(values: DataFrame, spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """Which values their evidence supports: source_id, field, supported, reason (of a drop), block_id and char_start of the first span.

    values: source_id, field, value. spans: source_id, field, span_no, block_id, quote. blocks: source_id,
    block_id, ord, text, page, metadata_key. Spans of a field must each resolve in their block, in blocks that
    follow one another on one page; a lone quote may run over into the next block. A field with no span or
    more than MOST_SPANS is not found. Joins are by block and by field; only the first spans of a field are gathered.
    """
    order = Window.partitionBy("source_id").orderBy("ord")
    held = blocks.select("source_id", "block_id", "ord", "text", "page", "metadata_key", T.compact(F.col("text")).alias("tight"), T.presented(F.col("text")).alias("loose"))
    after = [F.lead(c).over(order).alias(f"after_{c}") for c in ("tight", "loose", "page", "metadata_key")]
    held = held.select("*", F.row_number().over(order).alias("place"), *after)
    field = Window.partitionBy("source_id", "field").orderBy("span_no")
    s = spans.withColumn("r", F.row_number().over(field)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source_id", "field"))).where(F.col("r") <= MOST_SPANS)
    s = s.join(held, ["source_id", "block_id"], "left").withColumn("tight_quote", T.compact(F.col("quote"))).withColumn("loose_quote", T.presented(F.col("quote")))
    s = s.withColumn("start", found_at(F.col("quote"), F.col("text"), (F.col("tight_quote"), F.col("tight")), (F.col("loose_quote"), F.col("loose"))))
    blank = F.coalesce(F.trim(F.col("quote")), F.lit("")) == ""
    role = wrong_role(F.col("field"), F.col("metadata_key"))
    one_page = F.col("page").isNull() | F.col("after_page").isNull() | (F.col("page") == F.col("after_page"))
    runs_on = (F.col("n") == 1) & one_page & ~role & ~wrong_role(F.col("field"), F.col("after_metadata_key")) & _joined(F.col("quote"), (F.col("tight"), F.col("loose")), (F.col("after_tight"), F.col("after_loose")))
    reason = F.when(blank, "empty").when(F.col("text").isNull(), "not_found").when(F.col("start").isNull() & runs_on, None).when(F.col("start").isNull(), "quote_mismatch").when(role, "wrong_role")
    before = lambda c: F.lag(c).over(field)
    apart = (F.col("r") > 1) & ~(F.coalesce(F.col("place") == before("place") + 1, F.lit(False)) & F.coalesce(F.col("page") == before("page"), F.lit(True)))
    s = s.withColumn("reason", reason).withColumn("apart", apart)
    first = lambda c: F.min_by(c, F.when(F.col("r") == 1, 1))
    own = s.groupBy("source_id", "field").agg(
        F.max("n").alias("n"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("r"))).alias("bad"), F.max("apart").alias("apart"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "quote"))), lambda x: x.quote), " ").alias("quote"), first("block_id").alias("block_id"), first("start").alias("char_start"),
    )
    v = values.join(own, ["source_id", "field"], "left")
    empty = F.coalesce(F.trim("value"), F.lit("")) == ""
    why = (
        F.when(empty, "empty")
        .when(F.col("n").isNull() | (F.col("n") > MOST_SPANS), "not_found")
        .when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("apart") | ~supports(F.col("field"), F.col("value"), F.col("quote")), "quote_mismatch")
    )
    return v.withColumn("reason", why).select("source_id", "field", F.col("reason").isNull().alias("supported"), "reason", F.when(F.col("reason").isNull(), F.col("block_id")).alias("block_id"), F.when(F.col("reason").isNull(), F.col("char_start")).alias("char_start"))
