"""Queries over record rules and layout, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import ident as I
from docforge.functions import text as T
from docforge.operators import records, structure, zones
from docforge.plans.document_queries import _LEVELS, _SPANS, _heads, _lines, _spans, has, many, q, strip
from docforge.plans.registry import query


@query("F01", "WITH p AS (SELECT o_orderkey, 1990 + o_orderkey % 20 AS y, 1 + o_orderkey % 14 AS m, 1 + o_orderkey % 33 AS d FROM orders) SELECT o_orderkey, m <= 12 AND d <= day(last_day(make_date(y, least(m, 12), 1))) AS valid FROM p")
def valid_dates(t):
    k = F.col("o_orderkey")
    y, m, d = ((1990 + k % 20).cast("int"), (1 + k % 14).cast("int"), (1 + k % 33).cast("int"))
    return t("orders").select("o_orderkey", records.is_date(y, m, d).alias("valid"))


@query("F02", "SELECT event_id, CASE event_type WHEN 'click' THEN value - 20 >= 0 AND value - 20 < value WHEN 'view' THEN event_id % 7 - 1 >= 0 WHEN 'signup' THEN event_id % 5 >= 1 ELSE false END AS valid FROM events")
def valid_locators(t):
    kind = F.when(F.col("event_type") == "click", "media").when(F.col("event_type") == "view", "page").when(F.col("event_type") == "signup", "section").otherwise("other")
    return t("events").select("event_id", records.is_locator(kind, F.col("value") - 20, F.col("value"), F.col("event_id") % 7 - 1, F.col("event_id") % 5).alias("valid"))


_SPEC = "CASE p_size % 4 WHEN 0 THEN p_size || '-' || (p_size + 3) WHEN 1 THEN '1-5, -' || p_size WHEN 2 THEN p_size || ',' ELSE p_size || '-' END"


@query("F04", f"SELECT p_partkey, regexp_matches({_SPEC}, {q(records.PAGE_SPEC)}) AS valid FROM part")
def valid_page_specs(t):
    n = F.col("p_size")
    spec = F.when(n % 4 == 0, F.concat(n, F.lit("-"), n + 3)).when(n % 4 == 1, F.concat(F.lit("1-5, -"), n)).when(n % 4 == 2, F.concat(n, F.lit(","))).otherwise(F.concat(n, F.lit("-")))
    return t("part").select("p_partkey", spec.rlike(records.PAGE_SPEC).alias("valid"))


@query(
    "F05",
    r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1)) AS base, CASE page_id % 3 WHEN 0 THEN upper(regexp_extract(url, '([^/?#]+)/?(?:[?#].*)?$', 1)) WHEN 1 THEN md5(url) || '.pdf' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS title FROM pages)
    SELECT page_id, lower(trim(title)) = base OR lower(trim(title)) = regexp_replace(base, '\.[^.]*$', '') OR regexp_matches(lower(trim(title)), '^[0-9a-f]{32,64}\.pdf$') AS dropped FROM u""",
)
def filename_titles(t):
    k = F.col("page_id") % 3
    title = F.when(k == 0, F.upper(F.regexp_extract("url", r"([^/?#]+)/?(?:[?#].*)?$", 1))).when(k == 1, F.concat(F.md5("url"), F.lit(".pdf"))).otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return t("pages").select("page_id", records.looks_like_filename(title, F.col("url")).alias("dropped"))


@query("F06 X12", "SELECT conv_id, turn, len(list_filter(string_split(text, '. '), lambda n: length(n) <= 80 AND trim(n) <> '' AND NOT regexp_matches(lower(n), '^(?:the|and|with|for|of|in|on|der|die|das|le|la|les|el|los) ')))::BIGINT AS n_kept FROM conversations")
def author_filter(t):
    return t("conversations").select("conv_id", "turn", F.size(records.kept_authors(F.split("text", r"\. "))).cast("long").alias("n_kept"))


_VALUES = ", ".join(f"('{a}', '{f}')" for a, fields in records.PROFILE.items() for f in (*records.COMMON, *fields))
_KIND = "CASE p_size % 5 WHEN 0 THEN 'article-journal' WHEN 1 THEN 'webpage' WHEN 2 THEN 'book' WHEN 3 THEN 'chapter' ELSE 'interview' END"


@query("F10 U01", f"WITH d(type, field) AS (VALUES {_VALUES}) SELECT p_partkey AS record_id, d.type, d.field FROM part JOIN d ON d.type = {_KIND}")
def field_profile(t):
    n = F.col("p_size") % 5
    kind = F.when(n == 0, "article-journal").when(n == 1, "webpage").when(n == 2, "book").when(n == 3, "chapter").otherwise("interview")
    return records.evaluated_fields(t("part").select(F.col("p_partkey").alias("record_id"), kind.alias("type"))).select("record_id", "type", "field")


@query("F13", f"WITH d(type, field) AS (VALUES {_VALUES}), e AS (SELECT p_partkey AS record_id, {_KIND} AS type, p_size FROM part) SELECT e.record_id, count(*) AS n_empty FROM e JOIN d ON d.type = e.type WHERE NOT (d.field = 'title' OR (d.field = 'publisher' AND p_size % 2 = 0) OR (d.field = 'author' AND p_size % 3 = 0)) GROUP BY e.record_id")
def empty_fields(t):
    n = F.col("p_size") % 5
    kind = F.when(n == 0, "article-journal").when(n == 1, "webpage").when(n == 2, "book").when(n == 3, "chapter").otherwise("interview")
    p = t("part").select(F.col("p_partkey").alias("record_id"), kind.alias("type"), "p_size")
    have = p.select("record_id", F.explode(F.array_compact(F.array(F.lit("title"), F.when(F.col("p_size") % 2 == 0, "publisher"), F.when(F.col("p_size") % 3 == 0, "author")))).alias("field"))
    return records.evaluated_fields(p).join(have, ["record_id", "field"], "left_anti").groupBy("record_id").agg(F.count(F.lit(1)).alias("n_empty"))


@query(
    "J05",
    """WITH i AS (SELECT user_id, event_id // 500 AS page, event_id AS item_id, value AS x0, value + 10 AS x1 FROM events WHERE event_type <> 'purchase'), g AS (SELECT user_id, event_id // 500 AS page, event_id AS image_id, value - 3 AS i0, value + 12 AS i1 FROM events WHERE event_type = 'purchase'),
    j AS (SELECT i.user_id, i.page, item_id, image_id, greatest(0.0, least(x1, i1) - greatest(x0, i0)) / (x1 - x0) AS share FROM i JOIN g ON i.user_id = g.user_id AND i.page = g.page), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, page, item_id ORDER BY share DESC, image_id) AS r, min(image_id) OVER (PARTITION BY user_id, page, item_id) AS f FROM j)
    SELECT user_id, page, item_id, CASE WHEN share > 0.5 THEN image_id ELSE f END AS image_id FROM r WHERE r = 1""",
)
def image_overlap(t):
    e = t("events").withColumn("page", F.expr("event_id div 500"))
    items = e.where("event_type <> 'purchase'").select("user_id", "page", F.col("event_id").alias("item_id"), F.col("value").alias("x0"), (F.col("value") + 10).alias("x1"))
    images = e.where("event_type = 'purchase'").select("user_id", "page", F.col("event_id").alias("image_id"), (F.col("value") - 3).alias("i0"), (F.col("value") + 12).alias("i1"))
    return records.best_overlap(items, images, ["user_id", "page"])


@query("A16", "SELECT CASE WHEN p_size % 2 = 0 THEN 'publisher_split' ELSE 'none' END AS rule, count(*) AS n, count(*) FILTER (p_size % 2 = 0) AS rescued FROM part GROUP BY 1")
def adapter_counts(t):
    gold = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" : "), "p_name")).otherwise(F.concat("p_brand", F.lit(" "), "p_name"))
    _, adapted = I.split_publisher(gold)
    p = t("part").select(adapted.alias("adapted"), gold.alias("gold"), "p_name")
    rule = F.when(F.col("adapted").isNotNull(), "publisher_split").otherwise("none")
    return p.groupBy(rule.alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("gold") != F.col("p_name")) & F.coalesce(F.col("adapted") == F.col("p_name"), F.lit(False))).alias("rescued"))


@query("A18", "WITH a AS (SELECT event_type, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END) AS r FROM events GROUP BY 1), b AS (SELECT event_type, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0 END) AS r FROM events GROUP BY 1) SELECT a.event_type AS field, round(b.r - a.r, 6) AS delta FROM a JOIN b ON a.event_type = b.event_type")
def report_delta(t):
    report = lambda x: t("events").groupBy(F.col("event_type").alias("field")).agg(F.avg(F.when(F.col("value") > x, 1.0).otherwise(0.0)).alias(f"r{x}"))
    return report(50).join(report(40), "field").select("field", F.round(F.col("r40") - F.col("r50"), 6).alias("delta"))


@query("W15", f"WITH $LINES, {_SPANS} SELECT s.doc_id, s.start_line, sum(length(l.line))::BIGINT AS total FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.line_no BETWEEN s.start_line AND s.end_line GROUP BY s.doc_id, s.start_line")
def subtree_totals(t):
    # a running sum per document gives each span's total: no range join
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    run = _lines(t).select("doc_id", "line_no", F.length("line").alias("n"), F.sum(F.length("line")).over(w).alias("upto"))
    ends = run.select("doc_id", F.col("line_no").alias("end_line"), "upto")
    starts = run.select("doc_id", F.col("line_no").alias("start_line"), (F.col("upto") - F.col("n")).alias("before"))
    return _spans(t).join(starts, ["doc_id", "start_line"]).join(ends, ["doc_id", "end_line"]).select("doc_id", "start_line", (F.col("upto") - F.col("before")).alias("total"))


@query("W17", f"WITH $LINES, n AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines) SELECT doc_id, line_no, len(regexp_extract_all(line, '\\d+'))::BIGINT AS n_numbers FROM n WHERE (line_no = 0 OR line_no = last) AND {many('line', r'\S+')} BETWEEN 1 AND 8")
def page_number_zones(t):
    own = _lines(t).withColumn("last", F.max("line_no").over(Window.partitionBy("doc_id")))
    return own.where(((F.col("line_no") == 0) | (F.col("line_no") == F.col("last"))) & T.word_count(F.col("line")).between(1, 8)).select("doc_id", "line_no", F.regexp_count("line", F.lit(r"\d+")).cast("long").alias("n_numbers"))





@query("T04", f"WITH z AS (SELECT user_id, event_id, CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 9 WHEN 4 THEN 5 ELSE 7 END AS p FROM events) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY p, event_id) AS place FROM z")
def zone_order(t):
    k = F.col("event_id") % 6
    zone = F.when(k == 0, "title").when(k == 1, "cip").when(k == 2, "body").when(k == 3, "contents").when(k == 4, "cover").otherwise("unknown")
    w = Window.partitionBy("user_id").orderBy(zones.zone_rank(zone), "event_id")
    return t("events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("T05", f"WITH $LINES, r AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN {has('line', '(?i)copyright|license|imprint|preface')} THEN 0 ELSE 1 END, line_no) AS place FROM lines WHERE {strip('line')} <> '') SELECT doc_id, line_no, place FROM r WHERE place <= 12")
def candidate_regions(t):
    first = F.when(F.col("line").rlike("(?i)copyright|license|imprint|preface"), 0).otherwise(1)
    w = Window.partitionBy("doc_id").orderBy(first, "line_no")
    return _lines(t).where(T.stripped(F.col("line")) != "").select("doc_id", "line_no", F.row_number().over(w).cast("long").alias("place")).where("place <= 12")


@query("X10 X11", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS family, CASE WHEN p_size % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS given FROM part")
def name_parts(t):
    parts = F.split("p_name", " ")
    name = F.when(F.col("p_size") % 2 == 0, F.concat(parts[0], F.lit(", "), parts[1])).otherwise(F.col("p_name"))
    family, given = records.western_name(name)
    return t("part").select("p_partkey", family.alias("family"), given.alias("given"))


@query("X18", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || '|' || year(o_orderdate) || '/' || month(o_orderdate) || '/' || day(o_orderdate) || '|' || strftime(o_orderdate, '%Y%m%d') || '|' || year(o_orderdate) || '年' || month(o_orderdate) || '月' || day(o_orderdate) || '日' AS forms FROM orders")
def date_forms(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", F.concat_ws("|", F.date_format(d, "yyyy-MM-dd"), F.concat_ws("/", F.year(d), F.month(d), F.day(d)), F.date_format(d, "yyyyMMdd"), F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.day(d), F.lit("日"))).alias("forms"))


@query("X42 S05", "SELECT event_id, round(least(1.0, greatest(0.0, value / 500)), 4) AS x, round(least(1.0, greatest(0.0, (value - 30) / 500)), 4) AS y FROM events")
def layout_norm(t):
    clip = lambda c: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4)
    return t("events").select("event_id", clip(F.col("value") / 500).alias("x"), clip((F.col("value") - 30) / 500).alias("y"))


@query("X52", "SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), lambda h: CASE WHEN starts_with(h, '/') THEN 'images' || h ELSE h END), ' ') AS paths FROM pages")
def prefixed_paths(t):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return t("pages").select("page_id", F.array_join(F.transform(links, lambda h: F.when(h.startswith("/"), F.concat(F.lit("images"), h)).otherwise(h)), " ").alias("paths"))


@query("X60 K03", "SELECT p_partkey, sha256(json_object('brand', p_brand, 'name', p_name, 'size', p_size)::VARCHAR) AS digest FROM part")
def canonical_json(t):
    return t("part").select("p_partkey", F.sha2(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))), 256).alias("digest"))


@query("E07", "WITH s AS (SELECT l_orderkey AS record_id, CASE l_linenumber WHEN 1 THEN 'title' WHEN 2 THEN 'author' WHEN 3 THEN 'issued' ELSE 'other' END AS field, l_quantity > 10 AS ok FROM lineitem) SELECT record_id, count(*) FILTER (ok) AS n_supported, bool_or(field = 'title' AND ok) AND bool_or(field = 'author' AND ok) AND bool_or(field = 'issued' AND ok) AS complete FROM s GROUP BY record_id")
def record_states(t):
    n = F.col("l_linenumber")
    field = F.when(n == 1, "title").when(n == 2, "author").when(n == 3, "issued").otherwise("other")
    return records.completeness(t("lineitem").select(F.col("l_orderkey").alias("record_id"), field.alias("field"), F.when(F.col("l_quantity") > 10, "source-supported").otherwise("unverified").alias("state")))


@query("E12", "WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) SELECT user_id, event_id, 'https://example.org/' || event_type AS uri FROM r WHERE r <= 3 AND event_type <> 'error'")
def authority_links(t):
    first = F.slice(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), 1, 3)
    a = t("events").groupBy("user_id").agg(first.alias("a")).select("user_id", F.explode("a").alias("a"))
    return a.where("a.event_type <> 'error'").select("user_id", "a.event_id", F.concat(F.lit("https://example.org/"), "a.event_type").alias("uri"))


@query("G03", "WITH $LINES SELECT doc_id, line_no, last_value(CASE WHEN length(line) % 7 = 0 THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM lines")
def carried_sections(t):
    return records.carried_sections(_lines(t).select("doc_id", "line_no", "line"), "doc_id", "line_no", F.when(F.length("line") % 7 == 0, F.col("line_no"))).select("doc_id", "line_no", "section")


@query("G04 G06", f"WITH $LINES, {_LEVELS}, p AS (SELECT doc_id, line_no, (SELECT max(o.line_no) FROM heads o WHERE o.doc_id = h.doc_id AND o.line_no < h.line_no AND o.level < h.level) AS parent FROM heads h) SELECT doc_id, line_no, lpad((row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1)::VARCHAR, 4, '0') AS number, NOT EXISTS (SELECT 1 FROM p c WHERE c.doc_id = p.doc_id AND c.parent = p.line_no) AS leaf FROM p")
def tree_numbers(t):
    return records.preorder(structure.section_parents(_heads(t)))


@query("S04", "WITH d AS (SELECT p_partkey AS doc_id, p_size * 25 AS n, CASE WHEN p_size * 25 <= 100 THEN p_size * 25 WHEN p_size * 25 <= 250 THEN 50 WHEN p_size * 25 <= 500 THEN 40 WHEN p_size * 25 <= 1000 THEN 25 ELSE 20 END AS step FROM part), c AS (SELECT doc_id, n, step, unnest(range(0, n, step)) AS start_page FROM d) SELECT doc_id, start_page::BIGINT AS start_page, (least(start_page + step, n) - 1)::BIGINT AS end_page FROM c")
def page_chunks(t):
    return records.chunks(t("part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") * 25).alias("n_pages")))


@query("S19", "SELECT user_id, median((value + 1) / (1 + event_id % 90)) > 1.5 AS vertical FROM events GROUP BY user_id")
def vertical_text(t):
    return t("events").groupBy("user_id").agg((F.median((F.col("value") + 1) / (1 + F.col("event_id") % 90)) > 1.5).alias("vertical"))


@query("S20", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' WHEN 'es' THEN 'spa' ELSE 'eng+chi_sim' END AS code FROM documents")
def ocr_language(t):
    code = F.lit("eng+chi_sim")
    for k, v in records.OCR_CODES.items():
        code = F.when(F.col("lang") == k, v).otherwise(code)
    return t("documents").select("doc_id", code.alias("code"))


@query("H12", "SELECT p_partkey, p_size::BIGINT AS first, (p_size + 4)::BIGINT AS last FROM part")
def label_bounds(t):
    label = F.concat(F.lit("pp. "), F.col("p_size"), F.lit("–"), F.col("p_size") + 4)
    found = F.regexp_extract_all(label, F.lit(r"\d+"), F.lit(0))
    return t("part").select("p_partkey", F.get(found, F.lit(0)).cast("long").alias("first"), F.element_at(found, -1).cast("long").alias("last"))


@query("H25", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(value) AS v FROM events GROUP BY ALL) SELECT user_id, coalesce(max(CASE WHEN event_type = 'view' AND n >= 2 THEN v END), max(CASE WHEN event_type = 'click' AND n >= 2 THEN v END), max(CASE WHEN event_type = 'error' THEN v END)) AS chosen FROM c GROUP BY user_id")
def preferred_blocks(t):
    c = t("events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("v"))
    of = lambda k, least: F.max(F.when((F.col("event_type") == k) & (F.col("n") >= least), F.col("v")))
    return c.groupBy("user_id").agg(F.coalesce(of("view", 2), of("click", 2), of("error", 1)).alias("chosen"))


@query("A08", "SELECT lang, count(*) FILTER (toxic = 1 AND p = 1) AS tp, count(*) FILTER (toxic = 0 AND p = 1) AS fp, count(*) FILTER (toxic = 1 AND p = 0) AS fn, count(*) FILTER (toxic = 0 AND p = 0) AS tn FROM (SELECT lang, toxic, CASE WHEN regexp_matches(text, '(?i)idiot|moron|trash|stupid') THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id) GROUP BY lang")
def link_counts(t):
    p = F.when(F.col("text").rlike("(?i)idiot|moron|trash|stupid"), 1).otherwise(0)
    j = t("labels").join(t("documents"), "doc_id").select("lang", "toxic", p.alias("p"))
    n = lambda a, b, name: F.count_if((F.col("toxic") == a) & (F.col("p") == b)).alias(name)
    return j.groupBy("lang").agg(n(1, 1, "tp"), n(0, 1, "fp"), n(1, 0, "fn"), n(0, 0, "tn"))


@query("X23", "SELECT p_partkey, (p_size % 60 + 1911)::BIGINT AS minguo, (p_size % 40 + 1925)::BIGINT AS showa FROM part")
def era_years(t):
    n = F.col("p_size")
    minguo, showa = F.concat(F.lit("民國"), n % 60, F.lit("年")), F.concat(F.lit("昭和"), n % 40, F.lit("年"))
    return t("part").select("p_partkey", I.era_year(minguo).alias("minguo"), I.era_year(showa).alias("showa"))
