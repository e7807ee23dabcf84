"""Zones of front matter, document types, marker scores and page ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T

# Marker patterns and weights of the page scan.
MARKERS = (
    ("图书在版编目", 10), ("CIP数据核字", 10), ("版权所有|侵权必究", 4), ("出版发行", 4), ("责任编辑", 3), ("定价", 2), ("开本", 2), ("版次", 2), ("©", 6),
    ("Copyright", 6), ("All rights reserved", 5), ("First published|First edition", 5), ("Printed in", 4), ("Library of Congress", 4),
    ("Cataloguing-in-Publication|Cataloging-in-Publication", 5), ("ISBN", 5), ("Reprinted", 3),
)
# Signals of document types.
THESIS = (r"(?:^|[^\p{L}\p{N}_])thesis(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])dissertation(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])a\s+thesis\s+submitted(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])in\s+partial\s+fulfillment(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])degree\s+of(?:$|[^\p{L}\p{N}_])", "学位论文", "硕士", "博士")
BOOK = ("图书在版编目", r"(?:^|[^\p{L}\p{N}_])cip(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])isbn(?:$|[^\p{L}\p{N}_])", r"copyright\s*©", r"all\s+rights\s+reserved", r"published\s+by", "出版社", "出版发行")
PAPER = (r"(?:^|[^\p{L}\p{N}_])doi(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])abstract(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])keywords?(?:$|[^\p{L}\p{N}_])", r"received\s*[:：]", r"accepted\s*[:：]", r"corresponding\s+author", r"(?:^|[^\p{L}\p{N}_])volume(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])issue(?:$|[^\p{L}\p{N}_])", r"(?:^|[^\p{L}\p{N}_])pp\.")
#: Letters that a line has if one of the signals above is in it.
SIGNAL_LETTERS = ("thesis", "dissert", "partial", "degree", "学位论文", "硕士", "博士", "图书", "cip", "isbn", "copyright", "rights", "published", "出版", "doi", "abstract", "keyword", "received", "accepted", "author", "volume", "issue", "pp.", "press", "publications", "verlag", "books")
PUBLISHER_LINE = r"^[A-Z][\p{L}\p{N}_&'’.,\- ]{0,59}?(?i:press|publications|verlag|books)\.?$"
BARE_DOI = r"(?:^|[^\p{L}\p{N}_])10\.\d{4,9}/\S+"
# Zone signals.
CIP = r"(?i)图书在版编目|在版编目|(?:^|[^\p{L}\p{N}_])CIP(?:$|[^\p{L}\p{N}_])|Library\s+of\s+Congress"
COPYRIGHT = r"(?i)©|\(c\)\s*\d|版权所有|copyright|ISBN"
CONTENTS = r"(?i)^(?:目\s*录|contents|table\s+of\s+contents|inhalt|sommaire)$"
LEADER = r"(?:\.{4,}|…{2,}|·{4,}|_{4,})\s*[\d一二三四五六七八九十]+"
IMPRINT_CJK = r"^(?:[\x{4e00}-\x{9fff}]{2,10}[:：,，]\s*)?[\x{4e00}-\x{9fff}·]{2,14}(?:出版社|出版集团|出版公司|书局|書局|印书馆|印書館|书店|書店)$"
IMPRINT = r"^([A-Z][\p{L}\p{N}_&'’.\- ]{1,60}?\s(?i:press|publications|publishers|publishing|verlag|books)\.?)(?:\s*[,;]\s*|\s+)?([A-Za-zÀ-ÿ][\p{L}\p{N}_&'’.\-]*(?:[ ,]+[A-Za-zÀ-ÿ][\p{L}\p{N}_&'’.\-]*){0,4})?\.?$"
BODY_END = r"[。；，]|\.\s*$|,\s*$|;\s*$"
ZONE_ORDER = ("title", "statement_of_responsibility", "copyright", "cip", "imprint", "cover", "body", "other", "running_head", "contents")


def marker_scores(lines: DataFrame, least_docs: int = 3) -> DataFrame:
    """Weighted markers of each document over its lines that do not repeat in its collection.

    doc_id, source, score, n_markers, repeated (whether a repeated line occurs).
    """
    keyed = lines.withColumn("key", T.repeat_key(F.col("line")))
    repeated = keyed.where("key <> ''").select("source", "key", "doc_id").distinct().groupBy("source", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs).select("source", "key", F.lit(True).alias("rep"))
    own = keyed.join(repeated, ["source", "key"], "left").withColumn("rep", F.coalesce("rep", F.lit(False)))
    hits = [(F.when(~F.col("rep") & F.col("line").rlike(f"(?i){p}"), 1).otherwise(0), w) for p, w in MARKERS]
    score, n = sum((h * w for h, w in hits[1:]), hits[0][0] * hits[0][1]), sum((h for h, _ in hits[1:]), hits[0][0])
    return own.groupBy("doc_id", "source").agg(F.sum(score).cast("double").alias("score"), F.sum(n).cast("long").alias("n_markers"), F.max("rep").alias("repeated"))


def candidate_pages(scores: DataFrame, k: int = 8) -> DataFrame:
    """The best page with its neighbours, then others by score, ``k`` in all, clipped to 1..n.

    Columns: source, page (1..n), score.
    """
    ranked = scores.select("source", "page", "score", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "page")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("source")).alias("n"))
    best = ranked.where("r = 1").select("source", "n", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"))
    others = ranked.join(best.select("source", "page"), ["source", "page"], "left_anti")
    more = others.withColumn("r2", F.row_number().over(Window.partitionBy("source").orderBy("r"))).where(F.col("r2") <= k - 3).select("source", "n", "page")
    return best.unionByName(more).where("page between 1 and n").select("source", "page")


def _any(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def document_types(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Book, paper or thesis by distinct signals, then page count (A19): doc_id, type, confidence, n_signals.

    ``pages`` has doc_id and page_count.
    """
    # most lines hold no signal's letters at all: these go by plain search before any pattern is tried
    lines = lines.withColumn("low", F.lower("line")).withColumn("near", F.lit(False) | _any(F.col("low"), SIGNAL_LETTERS))
    flag = lambda p, i: F.max(F.when(F.col("near") & F.col("line").rlike(f"(?i){p}"), 1).otherwise(0)).alias(i)
    named = [(f"{kind}{i}", p) for kind, ps in (("t", THESIS), ("b", BOOK), ("p", PAPER)) for i, p in enumerate(ps)]
    suffix = F.max(F.when(F.col("near") & T.stripped(F.col("line")).rlike(PUBLISHER_LINE), 1).otherwise(0)).alias("b99")
    found = lines.groupBy("doc_id").agg(*(flag(p, n) for n, p in named), suffix, F.max(F.col("line").contains("10.") & F.col("line").rlike(BARE_DOI)).alias("has_doi"))
    total = lambda kind: sum((F.col(c) for c in found.columns if c[0] == kind and c[1:].isdigit()), F.lit(0))
    s = found.select("doc_id", "has_doi", total("t").alias("thesis"), total("b").alias("book"), total("p").alias("paper")).join(pages, "doc_id")
    kind = F.when(F.col("thesis") > 0, "thesis").when(F.col("book") > 0, "book").when(F.col("paper") > 0, "paper").when((F.col("page_count") <= 12) & F.col("has_doi") & (F.col("page_count") > 0), "paper").otherwise("book")
    n = F.when(F.col("thesis") > 0, F.col("thesis")).when(F.col("book") > 0, F.col("book")).otherwise(F.col("paper"))
    by_pages = ((F.col("page_count") >= 60) & ~F.col("has_doi")) | ((F.col("page_count") <= 12) & F.col("has_doi") & (F.col("page_count") > 0))
    confidence = F.when(n >= 2, 0.9).when(n == 1, 0.7).when(by_pages, 0.6).otherwise(0.3)
    return s.select("doc_id", kind.alias("type"), confidence.cast("double").alias("confidence"), n.cast("long").alias("n_signals"))


def is_imprint(c: Column) -> Column:
    """Whether a line is a publisher's imprint as a whole."""
    pub, place = F.rtrim(F.regexp_extract(c, IMPRINT, 1), F.lit(" .,")), F.rtrim(F.regexp_extract(c, IMPRINT, 2), F.lit(" .,"))
    latin = c.rlike(IMPRINT) & ~pub.rlike(r"\d") & ~place.rlike(r"\d") & ~c.rlike(r"(?i)(?:^|[^\p{L}\p{N}_])by(?:$|[^\p{L}\p{N}_])") & pub.rlike("[A-Z]") & ((T.word_count(pub) <= 6) | (place != "") | c.rlike(r"(?:^|[^\p{L}\p{N}_])(?:1[5-9]|20)\d{2}(?:$|[^\p{L}\p{N}_])"))
    return (c != "") & (F.length(c) <= 100) & (c.rlike(IMPRINT_CJK) | latin)


def label_zones(blocks: DataFrame) -> DataFrame:
    """One zone for each block (E01). Columns: doc_id, page (from 1), line_no, line; adds zone."""
    c = T.stripped(F.col("line"))
    b = blocks.select("doc_id", "page", "line_no", "line", c.alias("t"))
    first = F.when(F.col("line").rlike(CIP), "cip").when(F.col("line").rlike(COPYRIGHT), "copyright").when(is_imprint(F.col("t")), "imprint").when(F.col("t").rlike(CONTENTS), "contents").otherwise("body")
    b = b.withColumn("z", first).withColumn("key", T.repeat_key(F.col("line")))
    page, doc = Window.partitionBy("doc_id", "page"), Window.partitionBy("doc_id")
    any_ = lambda cond: F.max(F.when(cond, 1).otherwise(0)).over(page) == 1
    leaders = F.sum(F.when(F.col("line").rlike(LEADER), 1).otherwise(0)).over(page)
    b = b.withColumn("has_cip", any_(F.col("z") == "cip")).withColumn("has_contents", any_(F.col("z") == "contents") | (leaders >= 2))
    b = b.withColumn("z", F.when(F.col("has_cip") & F.col("z").isin("body", "copyright"), "cip").when(~F.col("has_cip") & F.col("has_contents") & (F.col("z") == "body"), "contents").otherwise(F.col("z")))
    bad = ~F.col("z").isin("body", "imprint") | (F.length("line") > 160) | F.col("line").rlike(BODY_END) | F.col("line").rlike(CIP) | F.col("line").rlike(COPYRIGHT) | F.col("t").rlike(CONTENTS)
    b = b.withColumn("n", F.count(F.lit(1)).over(page)).withColumn("ok", ~any_(bad) & (F.sum(T.word_count(F.col("line"))).over(page) <= 40) & (F.sum(F.length("line")).over(page) <= 260) & (F.col("page") <= 3))
    b = b.withColumn("title_page", F.coalesce(F.min(F.when(F.col("ok") & (F.col("n") >= 2), F.col("page"))).over(doc), F.min(F.when(F.col("ok"), F.col("page"))).over(doc)))
    on_title = (F.col("page") == F.col("title_page")) & (F.col("z") == "body")
    head = F.min(F.when(on_title, F.col("line_no"))).over(doc)
    capital, letters = F.regexp_count("line", F.lit(r"\p{Lu}")), F.regexp_count("line", F.lit(r"\p{L}"))
    display = (letters > 0) & (T.word_count(F.col("line")) <= 12) & (capital >= 0.6 * letters) & ~F.col("line").rlike(BODY_END)
    b = b.withColumn("head", head)
    b = b.withColumn("z", F.when(on_title & (F.col("line_no") == F.col("head")), "title").when(on_title, "statement_of_responsibility").when((F.col("page") < F.col("title_page")) & F.col("head").isNotNull() & (F.col("n") == 1) & (F.col("z") == "body") & display, "cover").otherwise(F.col("z")))
    pages_of_key = b.where("key <> ''").select("doc_id", "key", "page").distinct().groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("k")).where("k >= 3").select("doc_id", "key", F.lit(True).alias("rep"))
    b = b.join(pages_of_key, ["doc_id", "key"], "left")
    return b.select("doc_id", "page", "line_no", F.when(F.col("rep") & (F.col("z") == "body"), "running_head").otherwise(F.col("z")).alias("zone"))


def zone_rank(zone: Column) -> Column:
    """Reading priority of a zone."""
    out = F.lit(ZONE_ORDER.index("other"))
    for i, z in enumerate(ZONE_ORDER):
        out = F.when(zone == z, i).otherwise(out)
    return out.cast("long")


def evidence_scores(lines: DataFrame, terms: list[str], imprint: str = "(?i)copyright|license", bibliography: str = "(?i)references|bibliography", identity: str = "(?i)title|author|publisher") -> DataFrame:
    """Lexical scores of lines for a query (T03): term counts, early pages, imprint neighbourhood, role words."""
    count = sum((F.regexp_count(F.lower("line"), F.lit(t)) for t in terms[1:] if len(t) > 2), F.regexp_count(F.lower("line"), F.lit(terms[0])))
    here = F.max(F.when(F.col("line").rlike(imprint), 1).otherwise(0)).over(Window.partitionBy("doc_id", "page"))
    b = lines.withColumn("here", here)
    near = Window.partitionBy("doc_id").orderBy("page").rangeBetween(-1, 1)
    b = b.withColumn("near", F.max("here").over(near))
    score = count + F.when(F.col("page") < 4, 8).otherwise(0) + F.when(F.col("here") == 1, 6).when(F.col("near") == 1, 3).otherwise(0) - F.when(F.col("line").rlike(bibliography), 20).otherwise(0) + F.when(F.col("line").rlike(identity), 1).otherwise(0)
    return b.select("doc_id", "page", "line_no", score.cast("long").alias("score"))
