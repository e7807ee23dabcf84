"""Whether two records are one work: a title that agrees, and anchors that the source supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import match

CJK = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}]"
# Words before a Roman volume number, the least score, and lengths of titles that say little.
VOLUMES = ("volume", "vol", "part", "tome", "book")
LEAST_SCORE, SHORT_CHARS, SHORT_WORDS = 0.90, 12, 3


def title_key(title: Column, subtitle: Column) -> Column:
    """Plain title, with the subtitle where the title does not have it already."""
    t, s = T.plain(F.coalesce(title, F.lit(""))), T.plain(F.coalesce(subtitle, F.lit("")))
    return F.when((s == "") | (F.instr(t, s) > 0), t).otherwise(F.trim(F.concat(t, F.lit(" "), s)))


def numerals(key: Column) -> Column:
    """Arabic numbers of a plain title, and Roman ones after a word for a volume, in order."""
    w = F.split(key, " ")
    own = lambda i: F.when((i > 0) & F.get(w, i - 1).isin(*VOLUMES) & F.get(w, i).rlike("^[ivxlcdm]+$"), F.array(F.get(w, i))).otherwise(F.regexp_extract_all(F.get(w, i), F.lit(r"(\d+)"), F.lit(1)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - 1), own))


def _surnames(p: Column) -> Column:
    name = T.plain(F.coalesce(F.nullif(p.family, F.lit("")), p.literal, F.lit("")))
    last = F.when(name.contains(" ") & ~name.rlike(CJK), F.regexp_extract(name, "([^ ]+)$", 1))
    return F.array_compact(F.array(F.nullif(name, F.lit("")), last))


def _givens(p: Column) -> Column:
    literal = F.coalesce(p.literal, F.lit(""))
    rest = F.when(literal.contains(","), F.regexp_replace(literal, "^[^,]*,", "")).otherwise(F.regexp_replace(F.trim(literal), r"\s*\S+$", ""))
    given = F.coalesce(F.nullif(p.given, F.lit("")), F.when(~literal.rlike(CJK), rest), F.lit(""))
    return F.filter(F.split(T.plain(given), " "), lambda w: w != "")


def _clash(a: Column, b: Column) -> Column:
    """Given names that differ, place by place; an initial does not differ from its name."""
    differ = lambda x, y: (x != y) & ~((F.left(x, F.lit(1)) == F.left(y, F.lit(1))) & (F.least(F.length(x), F.length(y)) == 1))
    return F.exists(F.zip_with(a, b, differ), lambda d: F.coalesce(d, F.lit(False)))


def names_agree(a: Column, b: Column) -> Column:
    """Some person of both lists is the same by surname, and no such pair has clashing given names."""
    same = lambda p, q: F.arrays_overlap(_surnames(p), _surnames(q))
    met = F.exists(a, lambda p: F.exists(b, lambda q: same(p, q)))
    clash = F.exists(a, lambda p: F.exists(b, lambda q: same(p, q) & _clash(_givens(p), _givens(q))))
    return F.coalesce(met & ~clash, F.lit(False))


def judged(pairs: DataFrame, score: Column, least: float = LEAST_SCORE) -> DataFrame:
    """Adds title keys, score, anchors, accepted and reason to pairs of a record (l_) and a candidate (r_).

    Columns of each side: title, subtitle, type, edition, language, author, editor (lists of family, given, literal),
    year, publisher, container; besides supported (the record's fields that its source supports), known (an
    identifier is given) and isbn (the candidate has nothing but an ISBN). ``score`` may use the columns lt and rt,
    the title keys; scripts without blanks must agree in full.
    """
    l, r = (lambda n: F.col(f"l_{n}")), (lambda n: F.col(f"r_{n}"))  # noqa: E741
    p = pairs.withColumn("lt", title_key(l("title"), l("subtitle"))).withColumn("rt", title_key(r("title"), r("subtitle")))
    wide = F.concat("lt", "rt").rlike(CJK)
    p = p.withColumn("score", F.when(wide, (F.col("lt") == F.col("rt")).cast("double")).otherwise(score))
    has = lambda f: F.array_contains("supported", f)
    differ = lambda f: (T.plain(l(f)) != "") & (T.plain(r(f)) != "") & (T.plain(l(f)) != T.plain(r(f)))
    types = l("type").isNotNull() & r("type").isNotNull() & (l("type") != r("type")) & ~((l("type") == "article") & r("type").isin("article-journal", "paper-conference"))
    tests = {f: (has(f) & (F.size(r(f)) > 0), names_agree(l(f), r(f))) for f in ("author", "editor")}
    later = {
        "issued": (has("issued") & r("year").isNotNull(), F.coalesce(F.abs(l("year") - r("year")) <= 1, F.lit(False))),
        "publisher": (has("publisher") & (F.coalesce(r("publisher"), F.lit("")) != ""), T.plain(F.coalesce(l("publisher"), F.lit(""))) == T.plain(r("publisher"))),
        "container-title": (has("container-title") & (F.coalesce(r("container"), F.lit("")) != ""), T.plain(F.coalesce(l("container"), F.lit(""))) == T.plain(r("container"))),
    }
    anchors = F.array_compact(F.array(*(F.when(use & agrees, F.lit(f)) for f, (use, agrees) in (tests | later).items())))
    p = p.withColumn("anchors", anchors)
    short = (F.length(F.replace("lt", F.lit(" "), F.lit(""))) < SHORT_CHARS) | (~wide & (F.size(F.split("lt", " ")) < SHORT_WORDS))
    needed = F.when(F.col("known") & ~F.col("isbn"), 0).when(short, 2).otherwise(1)
    reason = (
        F.when((F.col("lt") == "") | (F.col("rt") == "") | (F.col("score") < least), "title_mismatch")
        .when(numerals(F.col("lt")) != numerals(F.col("rt")), "title_numeral_mismatch")
        .when(types, "work_type_mismatch")
        .when(F.coalesce(differ("edition"), F.lit(False)), "edition_mismatch")
        .when(F.coalesce(differ("language"), F.lit(False)), "language_mismatch")
    )
    for f, (use, agrees) in tests.items():
        reason = reason.when(use & ~agrees & (~F.col("known") | F.col("isbn")), f"{f}_mismatch")
    reason = reason.when(F.col("isbn") & ~F.array_contains("anchors", "author"), "isbn_requires_title_author_agreement")
    for f, (use, agrees) in later.items():
        reason = reason.when(use & ~agrees & ~F.col("known"), f"{f}_mismatch")
    reason = reason.when(F.size("anchors") < needed, "insufficient_source_anchors")
    return p.withColumn("reason", F.coalesce(reason, F.lit("host_identity_agreement"))).withColumn("accepted", F.col("reason") == "host_identity_agreement")


def identity_key(doi: Column, isbn: Column, other: Column) -> Column:
    """What candidates count as one by: DOI, else ISBN, else anything else."""
    return F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("isbn:"), isbn), other)


def selected(judged_: DataFrame, key: str, identity: str) -> DataFrame:
    """The accepted candidate of each record, unless another one is as good but for the margin (E08): key, identity, score, decision."""
    return match.top_with_margin(judged_.where("accepted"), key, identity, "score", 0.0)
