"""Queries of cataloguing blocks, references, seeds, trees, page numbers, files and rendering, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import catalog as C
from docforge.functions import registry as R
from docforge.functions import text as T
from docforge.operators import library, score, seeds, zones
from docforge.plans.document_queries import _lines, has, many, q, squeeze, strip
from docforge.plans.evidence_queries import _plain, _tight
from docforge.plans.registry import query
from docforge.plans.tables import dealt


def _group(x: str, p: str, i: int) -> str:
    return f"regexp_extract({x}, {q(p)}, {i})"


# Blocks as printed, garbled and without an anchor; with and without subtitle, series, colon and a valid number.
_CIP = """CASE p_size % 4 WHEN 0 THEN '图书在版编目（CIP）数据' WHEN 1 THEN 'ffl书在版编目（C I P ) 数据' WHEN 2 THEN '第一版' ELSE 'CIP数据核字（2019）第123号' END || chr(10) || CASE WHEN p_size % 6 = 0 THEN '（文库丛书／张三主编）' || chr(10) ELSE '' END || '书 名' || p_size || CASE WHEN p_size % 2 = 0 THEN '：副 题' ELSE '' END || ' / （美）诺曼' || p_size || CASE WHEN p_size % 5 = 0 THEN '(Norman)' ELSE '' END || '著；李四译注 .—' || '北京'
 || CASE WHEN p_size % 3 = 0 THEN '.' ELSE ' : ' END || CASE WHEN p_size % 7 = 0 THEN '某某公司' ELSE '某 某出版社' END || ', ' || (1990 + p_size % 30) || '.10' || chr(10) || 'ISBN ' || CASE WHEN p_size % 2 = 0 THEN '978-7-111-12806-9' ELSE '978-7-111-12806-1' END"""
_FITS = lambda x: f"({has(x, C.MAIN)} OR {has(x, C.NO_COLON)})"
_PART = lambda i: f"CASE WHEN {has('src', C.MAIN)} THEN {_group('src', C.MAIN, i)} ELSE {_group('src', C.NO_COLON, i)} END"
_CJK = lambda x: r"regexp_replace(regexp_replace(trim({0}), '([\x{{3400}}-\x{{9fff}}])\s+([\x{{3400}}-\x{{9fff}}])', '\1\2', 'g'), '([\x{{3400}}-\x{{9fff}}])\s+([\x{{3400}}-\x{{9fff}}])', '\1\2', 'g')".format(x)  # noqa: E731, UP032
_DIGITS = "list_sum(list_transform(generate_series(1, 13), lambda i: substr({0}, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0"


@query(
    "X07",
    rf"""WITH x AS (SELECT p_partkey, {_CIP} AS t FROM part), k AS (SELECT *, regexp_replace(t, '\s+', '', 'g') AS c, {has("t", C.HEADER)} OR {has("t", C.CERTIFICATE)} AS strict FROM x),
    g AS (SELECT *, NOT strict AND ({has("c", C.GARBLED_HEADER)} OR {has("c", C.GARBLED_CERTIFICATE)}) AS garbled, regexp_replace(regexp_replace(regexp_replace(c, '^.*?(?:图书在版编目[（(]CIP[)）]数据|.{{0,3}}书在版编目[（(]CIP[)）]数据)', ''), '[(（][^()（）]*?[A-Za-z][^()（）]*?[)）]', '', 'g'), '([著编译校撰订辑理])I', '\1；', 'g') AS body FROM k),
    s AS (SELECT *, CASE WHEN NOT garbled AND {_FITS("t")} THEN t WHEN strict OR garbled THEN body ELSE '' END AS src, CASE WHEN strict OR garbled THEN 0.99 ELSE 0.9 END::DOUBLE AS confidence FROM g),
    p AS (SELECT *, {_PART(0)} AS quote, {_PART(1)} AS title, {_PART(2)} AS sub, {_PART(3)} AS resp, {_PART(4)} AS place, regexp_replace({_PART(5)}, '\s+', '', 'g') AS pub, {_PART(6)} AS yr, regexp_replace(regexp_extract(t, 'ISBN\s*[:：]?\s*([\d\-–\s]+)', 1), '[\s–-]', '', 'g') AS num FROM s WHERE {_FITS("src")}),
    w AS (SELECT p_partkey, confidence, trim(regexp_replace(u, '^[ •·・,，、;；]+|[ •·・,，、;；]+$', '', 'g')) AS u FROM (SELECT p_partkey, confidence, unnest(regexp_split_to_array(resp, '[;；]')) AS u FROM p)),
    f AS (SELECT p_partkey, 'series' AS field, {_CJK(_group("replace(t, quote, chr(10))", C.SERIES, 1))} AS value, confidence FROM p WHERE NOT garbled UNION ALL SELECT p_partkey, 'title', {_CJK("title")}, confidence FROM p WHERE NOT garbled UNION ALL SELECT p_partkey, 'subtitle', {_CJK("sub")}, confidence FROM p WHERE NOT garbled
      UNION ALL SELECT p_partkey, CASE WHEN regexp_extract(u, '({C.ROLES})\s*$', 1) IN ('译', '譯', '译注', '譯注', '校译', '校譯') THEN 'translator' ELSE 'authors' END, {_CJK(f"regexp_replace(regexp_replace(u, {q(C.COUNTRY)}, ''), '(?:{C.ROLES})+$', '')")}, confidence FROM w
      UNION ALL SELECT p_partkey, 'place', {_CJK("place")}, confidence FROM p UNION ALL SELECT p_partkey, 'publisher', pub, confidence FROM p WHERE regexp_matches(pub, '{C.PUBLISHERS}|[A-Za-z]') UNION ALL SELECT p_partkey, 'year', yr, confidence FROM p UNION ALL SELECT p_partkey, 'ISBN', num, confidence FROM p WHERE length(num) = 13 AND {_DIGITS.format("num")})
    SELECT * FROM f WHERE value <> ''""",
)
def cip_fields(t):
    return dealt(t("part"), "p_partkey").select("p_partkey", F.explode(C.cip(F.expr(_CIP))).alias("c")).select("p_partkey", "c.field", "c.value", "c.confidence")


_LOC = """CASE WHEN p_size % 4 = 0 THEN 'Copyright page' WHEN p_size % 4 = 1 THEN 'Cataloging-in-Publication  Data' ELSE 'Library of Congress Cataloging-in-Publication Data' END || chr(10) || 'Names: ' || upper(substr(p_name, 1, 1)) || split_part(p_name, ' ', 1) || ',Ann B. | Other, X.' || chr(10) || 'Title: ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' : a study' ELSE '' END || ' / by Ann.' || chr(10)
 || 'Description: ' || CASE WHEN p_size % 3 = 0 THEN 'xii pages | ' ELSE '' END || 'New York ; London : ' || upper(substr(p_type, 1, 1)) || ' Press, [' || (1950 + p_size) || '] | 24 cm' || chr(10) || 'Identifiers: LCCN 20' || p_size || ' | ISBN ' || CASE WHEN p_size % 2 = 0 THEN '9780201134476' ELSE '978-0-201-13447-9' END || ' (paper) | LCCN 99' || chr(10) || 'Subjects: LCSH: Tests | More'"""
_LABEL = lambda label: rf"list_filter(list_transform(string_split(regexp_extract(t, '(?:^|\n)\s*{label}\s*:\s*([^\n]+)', 1), '|'), lambda s: trim(s)), lambda s: s <> '')"
_DESC = r"([A-Z][A-Za-z .\-]{1,40}(?:\s*[;,]\s*[A-Z][A-Za-z .\-]{1,40}){0,2})\s*:\s*([A-Z][\p{L}\p{N}_&''’.,\- ]{1,80}?)\s*,\s*\[?((?:19|20)\d{2})\]?"


@query(
    "X08",
    rf"""WITH x AS (SELECT p_partkey, {_LOC} AS t FROM part), a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace({_LABEL("Title")}[1], '\s+/\s+.*$', ''), '\s+([:;,.])', '\1', 'g'), '^[ .]+|[ .]+$', '', 'g') AS title, list_filter({_LABEL("Description")}, lambda d: regexp_matches(d, '{_DESC}'))[1] AS d, regexp_replace({_LABEL("Names")}[1], '^[ .]+|[ .]+$', '', 'g') AS n, {_LABEL("Identifiers")} AS ids FROM x WHERE {has("t", C.ANCHOR)}),
    b AS (SELECT *, list_filter(list_transform(ids, lambda i: replace(regexp_extract(i, '(?i)ISBN\s*[:：]?\s*([\d\-]+)', 1), '-', '')), lambda v: length(v) = 13 AND list_sum(list_transform(generate_series(1, 13), lambda j: TRY_CAST(substr(v, j, 1) AS INT) * CASE WHEN j % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0) AS isbns FROM a),
    f AS (SELECT p_partkey, 'title' AS field, trim(split_part(title, ':', 1)) AS value FROM b UNION ALL SELECT p_partkey, 'subtitle', trim(split_part(title, ':', 2)) FROM b UNION ALL SELECT p_partkey, 'author', CASE WHEN regexp_matches(n, '^[A-Z][\w''’.\-]*,\s*[A-Z][\w''’.\- ]*$') THEN regexp_replace(n, ',\s*', ', ') END FROM b UNION ALL SELECT p_partkey, 'place', trim(split_part(regexp_extract(d, '{_DESC}', 1), ';', 1)) FROM b
      UNION ALL SELECT p_partkey, 'publisher', regexp_replace(regexp_extract(d, '{_DESC}', 2), '^[ ,.]+|[ ,.]+$', '', 'g') FROM b UNION ALL SELECT p_partkey, 'year', regexp_extract(d, '{_DESC}', 3) FROM b UNION ALL SELECT p_partkey, 'ISBN', isbns[1] FROM b UNION ALL SELECT p_partkey, 'LCCN', regexp_extract(ids[1], 'LCCN\s+(\d+)', 1) FROM b UNION ALL SELECT p_partkey, 'subjects', {_LABEL("Subjects")}[1] FROM b)
    SELECT p_partkey, field, value, 0.98::DOUBLE AS confidence FROM f WHERE value <> ''""",
)
def loc_fields(t):
    return dealt(t("part"), "p_partkey").select("p_partkey", F.explode(C.loc_cip(F.expr(_LOC))).alias("c")).select("p_partkey", "c.field", "c.value", "c.confidence")


_CITED = """CASE p_size % 6 WHEN 0 THEN 'ZHANG San, 李四. ' || p_name || '[J]. ' || p_type || ', 2020, ' || p_size || '(3): 45 - 67.' WHEN 1 THEN '王五. ' || p_name || ' [ D ]. 北京: 北京大学, 2021.' WHEN 2 THEN 'Smith J; Doe A and Roe B. ' || p_name || '[M]. Berlin: ' || p_type || ', 19' || (10 + p_size) || ': 88-90.' WHEN 3 THEN '赵六. ' || p_name || '[C]//' || p_type || '. Paris: Press, 2001: 12-20.' WHEN 4 THEN 'Org. ' || p_name || '[EB/OL]. (2019-03-04) https://example.org/x' || p_size || '. ' ELSE 'No mark here, ' || p_name || ' 2020.' END"""
_GUIDED = f"""'Intro text' || chr(10) || CASE p_size % 9 WHEN 0 THEN '引用本文：' || {_CITED} WHEN 1 THEN 'Cite this article: ' || {_CITED} || chr(10) || chr(10) || 'more' WHEN 2 THEN 'This work can be cited as: `' || {_CITED} || '`' WHEN 3 THEN 'Zitierweise: short' WHEN 4 THEN 'Pour citer : <i>' || {_CITED} || '</i> [x](y)' WHEN 5 THEN '若要引用本文，请参考版权申明。引用格式：' || {_CITED} || '。end' WHEN 6 THEN '引用格式: ' || {_CITED} || '。end' WHEN 7 THEN 'nothing' ELSE '若要引用本文，请采用以下格式：' || {_CITED} || '。' END"""
_CLEAN = lambda x: rf"regexp_replace(regexp_replace({strip(rf'''regexp_replace(regexp_replace({strip(x)}, '<[^>]+>', '', 'g'), '(?m)\[#\].*$', '', 'g')''')}, '\[([^\]]+)\]\[[^\]]*\]', '\1', 'g'), '\[([^\]]+)\]\([^\)]*\)', '\1', 'g')"
_ASKED = "coalesce(" + ", ".join(f"CASE WHEN length({_CLEAN(_group('t', p, 1))}) > 10 AND NOT {has(_CLEAN(_group('t', p, 1)), C.POLICY)} THEN {_CLEAN(_group('t', p, 1))} END" for p in C.GUIDANCE) + ")"


@query("X13", f"WITH x AS (SELECT p_partkey, {_GUIDED} AS t FROM part) SELECT p_partkey, {_ASKED} AS citation FROM x")
def citation_guidance(t):
    return t("part").select("p_partkey", C.guidance(F.expr(_GUIDED)).alias("citation"))


_REF = rf"""r0 AS (SELECT *, regexp_replace({strip("t")}, '^(?:引用本文|引用此文|本文引用格式|引用格式)\s*[：:]\s*', '') AS c FROM x), r1 AS (SELECT *, regexp_extract(upper({_group("c", C.REFERENCE, 3)}), '^[A-Z]+') AS mark, regexp_replace({_group("c", C.REFERENCE, 2)}, '^[\s.．]+|[\s.．]+$', '', 'g') AS title, regexp_replace({_group("c", C.REFERENCE, 4)}, '^[\s.．]+', '') AS rest, {_group("c", C.REFERENCE, 1)} AS who FROM r0 WHERE {has("c", C.REFERENCE)}),
    r2 AS (SELECT *, mark = 'C' AND {has("rest", C.CONTAINER)} AS boxed FROM r1 WHERE title <> ''), r3 AS (SELECT *, CASE WHEN boxed THEN regexp_replace(rest, {q(C.CONTAINER)}, '') ELSE rest END AS tail FROM r2), r4 AS (SELECT *, mark = 'J' AND {has("rest", C.JOURNAL)} AS jo, mark IN ('M', 'D', 'R', 'C') AND (boxed OR mark <> 'C') AND {has("tail", C.IMPRINT)} AS im FROM r3)"""
_YEAR_PAGE = r"(?:^|\D)((?:19|20)\d{2})(?:\D|$)", r"[:：]\s*([A-Za-z]?\d+(?:\s*[-–—]\s*[A-Za-z]?\d+)?)\s*[.．]?\s*$"
_PAGED = lambda x: rf"nullif(regexp_replace(regexp_replace(trim({x}), '[.．]+$', ''), '\s+', '', 'g'), '')"


@query(
    "X13",
    rf"""WITH x AS (SELECT p_partkey, {_CITED} AS t FROM part), {_REF}
    SELECT p_partkey, title, CASE mark WHEN 'J' THEN 'article-journal' WHEN 'D' THEN 'thesis' WHEN 'M' THEN 'book' WHEN 'C' THEN 'paper-conference' WHEN 'EB' THEN 'webpage' ELSE 'document' END AS type, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(who, '[.．\s]+$', ''), '[,，;；]\s*|\s+and\s+'), lambda a: trim(a)), lambda a: a <> ''), '; ') AS authors,
    CASE WHEN jo THEN trim({_group("rest", C.JOURNAL, 1)}) WHEN boxed THEN trim({_group("rest", C.CONTAINER, 1)}) END AS container, (CASE WHEN jo THEN {_group("rest", C.JOURNAL, 2)} WHEN im THEN {_group("tail", C.IMPRINT, 3)} ELSE nullif({_group("tail", _YEAR_PAGE[0], 1)}, '') END)::INTEGER AS year, CASE WHEN jo THEN nullif(trim({_group("rest", C.JOURNAL, 3)}), '') END AS volume, CASE WHEN jo THEN nullif(trim({_group("rest", C.JOURNAL, 4)}), '') END AS issue,
    CASE WHEN jo THEN {_PAGED(_group("rest", C.JOURNAL, 5))} WHEN im THEN {_PAGED(_group("tail", C.IMPRINT, 4))} ELSE {_PAGED(_group("tail", _YEAR_PAGE[1], 1))} END AS page, CASE WHEN im THEN trim({_group("tail", C.IMPRINT, 1)}) END AS place, CASE WHEN im THEN trim({_group("tail", C.IMPRINT, 2)}) END AS publisher, CASE WHEN mark = 'EB' THEN regexp_replace(regexp_extract(rest, 'https?://\S+'), '[.,，。]+$', '') END AS url FROM r4""",
)
def reference_fields(t):
    # exploded and not filtered: a filter would be evaluated apart
    x = dealt(t("part"), "p_partkey").select("p_partkey", F.explode(F.array_compact(F.array(C.reference(F.expr(_CITED))))).alias("x"))
    return x.select("p_partkey", "x.title", "x.type", F.array_join("x.authors", "; ").alias("authors"), "x.container", "x.year", "x.volume", "x.issue", "x.page", "x.place", "x.publisher", "x.url")


_SELF = f"""CASE n WHEN 0 THEN 'Heading of ' || p_partkey WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'Other A. Something else[J]. Journal, 2001.' ELSE '' END WHEN 2 THEN substr({_CITED}, 1, 12) WHEN 3 THEN substr({_CITED}, 13) ELSE 'tail' END"""


@query(
    "J11",
    rf"""WITH l AS (SELECT p_partkey AS doc_id, n AS line_no, trim({_SELF}) AS a, upper(p_name) AS page_title FROM part, generate_series(0, 4) g(n)), w AS (SELECT *, lead(a, 1, '') OVER o AS b, lead(a, 2, '') OVER o AS c2 FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY line_no)),
    u AS (SELECT doc_id, line_no, page_title, k AS n_lines, CASE k WHEN 1 THEN a WHEN 2 THEN array_to_string(list_filter([a, b], lambda s: s <> ''), ' ') ELSE array_to_string(list_filter([a, b, c2], lambda s: s <> ''), ' ') END AS t FROM w, generate_series(1, 3) h(k) WHERE a <> ''), x AS (SELECT * FROM u WHERE contains(t, '[') AND length(t) <= 600), {_REF},
    m AS (SELECT *, regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '', 'g') AS p1, regexp_replace(lower(page_title), '[^\p{{L}}\p{{N}}]+', '', 'g') AS p2 FROM r4), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, n_lines) AS k FROM m WHERE p1 <> '' AND p2 <> '' AND (p1 = p2 OR (length(p1) >= 8 AND contains(p2, p1)) OR (length(p2) >= 8 AND contains(p1, p2))))
    SELECT doc_id, line_no::BIGINT AS line_no, n_lines::BIGINT AS n_lines, t AS citation, title FROM r WHERE k = 1""",
)
def self_citation(t):
    p = t("part").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    lines = p.select(F.col("p_partkey").alias("doc_id"), F.col("n").cast("long").alias("line_no"), F.expr(_SELF).alias("line"))
    return seeds.self_citations(lines, t("part").select(F.col("p_partkey").alias("doc_id"), F.upper("p_name").alias("page_title")))


_PATTERN = """CASE n WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN CASE WHEN p_size % 3 = 0 THEN 'Abstract: none' ELSE p_brand || ', ' || p_type END WHEN 3 THEN 'Key words: ' || p_type || ' ' WHEN 4 THEN CASE WHEN p_size % 2 = 0 THEN 'ISSN 1234-567X' ELSE '1007-1024(20' || (10 + p_size % 15) || ')0' || (1 + p_size % 9) || '-0' || (100 + p_size) || '-12' END ELSE 'body' END"""


@query(
    "X15",
    r"""WITH i AS (SELECT p_partkey AS doc_id, n AS ord, CASE WHEN n < 4 THEN 0 ELSE 1 END AS page, CASE WHEN n = 1 AND p_size % 5 <> 0 THEN 1 ELSE 0 END AS level, """
    + _PATTERN
    + r""" AS t FROM part, generate_series(0, 5) g(n)), k AS (SELECT *, min(CASE WHEN page = 0 AND level = 1 THEN ord END) OVER (PARTITION BY doc_id) AS ta FROM i WHERE trim(t) <> ''), m AS (SELECT *, min(CASE WHEN page = 0 AND ord > ta THEN ord END) OVER (PARTITION BY doc_id) AS aa FROM k),
    f AS (SELECT doc_id, max(t) FILTER (ord = ta) AS title, max(t) FILTER (ord = aa AND NOT regexp_matches(t, '(?i)^\s*(abstract|key\s*words?)')) AS author, max(trim(regexp_replace(t, '(?i)^key words:', ''))) FILTER (regexp_matches(t, '(?i)^key words')) AS keywords, max(regexp_extract(t, 'ISSN\s*(\S+)', 1)) FILTER (contains(t, 'ISSN')) AS issn, max(t) FILTER (regexp_matches(t, '^\d{4}-\d{4}\(')) AS code FROM m GROUP BY doc_id)
    SELECT doc_id, title, author, keywords, coalesce(issn, substr(code, 1, 9)) AS issn, regexp_extract(code, '\((\d{4})\)', 1)::BIGINT AS year, regexp_extract(code, '\)(\d{2})-', 1)::BIGINT AS issue, regexp_extract(code, '-(\d{4})-\d{2}$', 1)::BIGINT AS first_page, regexp_extract(code, '-(\d{4})-\d{2}$', 1)::BIGINT + regexp_extract(code, '-(\d{2})$', 1)::BIGINT - 1 AS last_page FROM f""",
)
def pattern_metadata(t):
    p = t("part").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return seeds.pattern_fields(p.select(F.col("p_partkey").alias("doc_id"), F.col("n").alias("ord"), F.when(F.col("n") < 4, 0).otherwise(1).alias("page"), F.when((F.col("n") == 1) & (F.col("p_size") % 5 != 0), 1).otherwise(0).alias("level"), F.expr(_PATTERN).alias("text")))


# Front matter of five lines, zoned by line.
_FRONT = """CASE n WHEN 0 THEN p_name WHEN 1 THEN CASE p_size % 4 WHEN 0 THEN 'By Ann ' || p_brand WHEN 1 THEN 'translated by Bob B' WHEN 2 THEN 'Edited by Carl ' || p_size ELSE 'a note' END WHEN 2 THEN upper(substr(p_type, 1, 1)) || 'x Press, Berlin' WHEN 3 THEN 'Copyright ' || (1900 + p_size) || ' by someone' ELSE 'body 1999 text' END"""
_ZONE = "CASE n WHEN 0 THEN CASE WHEN p_size % 5 = 0 THEN 'running_head' ELSE 'title' END WHEN 1 THEN 'body' WHEN 2 THEN 'imprint' WHEN 3 THEN 'copyright' ELSE 'body' END"
_SEEDS = rf"""b AS (SELECT p_partkey AS doc_id, n AS line_no, trim({_FRONT}) AS t, {_ZONE} AS z FROM part, generate_series(0, 4) g(n)),
c AS (SELECT doc_id, 'title' AS field, t AS value, 1 AS rule, line_no FROM b WHERE z = 'title' UNION ALL SELECT doc_id, 'author', regexp_extract(t, '^(?:By|by|von) (.*)$', 1), 2, line_no FROM b WHERE regexp_matches(t, '^by [A-Z]') AND z <> 'running_head' UNION ALL SELECT doc_id, 'translator', regexp_extract(t, '(?i)^translated by (.*)$', 1), 2, line_no FROM b WHERE regexp_matches(t, '(?i)^translated by ') AND z <> 'running_head' UNION ALL SELECT doc_id, 'editor', regexp_extract(t, '(?i)^edited by (.*)$', 1), 2, line_no FROM b WHERE regexp_matches(t, '(?i)^edited by ') AND z <> 'running_head'
  UNION ALL SELECT doc_id, 'publisher', regexp_replace(regexp_extract(t, {q(zones.IMPRINT)}, 1), '[ .,]+$', ''), 3, line_no FROM b WHERE z = 'imprint' UNION ALL SELECT doc_id, 'issued', regexp_extract(t, '(?:^|\D)((?:1[5-9]|20)\d{{2}})(?:\D|$)', 1), 4, line_no FROM b WHERE z IN ('imprint', 'copyright', 'title')),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY rule, line_no, value) AS r FROM c WHERE value <> '')"""


def _seeded(t):
    p = t("part").withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return seeds.seeds(seeds.candidates(p.select(F.col("p_partkey").alias("doc_id"), F.col("n").cast("long").alias("line_no"), F.expr(_FRONT).alias("line"), F.expr(_ZONE).alias("zone"))))


@query("E13", f"WITH {_SEEDS} SELECT doc_id, field, value, rule::BIGINT AS rule, line_no::BIGINT AS line_no FROM s WHERE r = 1")
def seeded_fields(t):
    return _seeded(t)


@query(
    "E14",
    f"""WITH {_SEEDS}, d AS (SELECT p_partkey AS doc_id, 'title' AS field, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_type END AS draft FROM part UNION ALL SELECT p_partkey, 'edition', p_brand FROM part), a AS (SELECT doc_id, field, value AS seed FROM s WHERE r = 1)
    SELECT coalesce(a.doc_id, d.doc_id) AS doc_id, coalesce(a.field, d.field) AS field, coalesce(seed, draft) AS value, CASE WHEN seed IS NOT NULL THEN 'seed' ELSE 'draft' END AS origin, CASE WHEN seed IS NOT NULL AND draft IS NOT NULL AND {_plain("seed")} <> {_plain("draft")} THEN draft END AS other FROM a FULL JOIN d ON a.doc_id = d.doc_id AND a.field = d.field""",
)
def settled_fields(t):
    p = t("part")
    draft = p.select(F.col("p_partkey").alias("doc_id"), F.lit("title").alias("field"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_type")).alias("value")).unionByName(p.select(F.col("p_partkey").alias("doc_id"), F.lit("edition").alias("field"), F.col("p_brand").alias("value")))
    return seeds.settled(_seeded(t), draft)


# Page numbers and trees -----------------------------------------------------------------------

_IDX = "i AS (SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events)"


def _indexed(t):
    return t("events").select("user_id", "event_id", "event_type", "value", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("idx"))


@query(
    "A21",
    f"""WITH {_IDX}, n AS (SELECT user_id, idx, idx + CASE WHEN event_id % 5 = 0 THEN 1 WHEN event_id % 7 = 0 THEN 40 ELSE 0 END + CASE WHEN user_id % 2 = 0 THEN 990 ELSE 0 END AS number FROM i), g AS (SELECT *, idx - lag(idx) OVER w AS want, number - lag(number) OVER w AS got FROM n WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
    s AS (SELECT user_id, count(got) AS n_pairs, avg(CASE WHEN got = want AND got > 0 THEN 100 WHEN abs(got - want) <= 1 THEN 50 WHEN got IS NOT NULL THEN -50 END) AS mean, min(number) >= 1 AND max(number) <= 1000 AS plain FROM g GROUP BY user_id) SELECT user_id, n_pairs, round(CASE WHEN n_pairs = 0 THEN 0 ELSE mean + CASE WHEN plain THEN 20 ELSE 0 END END, 6)::DOUBLE AS score FROM s""",
)
def sequence_scores(t):
    e = F.col("event_id")
    number = F.col("idx") + F.when(e % 5 == 0, 1).when(e % 7 == 0, 40).otherwise(0) + F.when(F.col("user_id") % 2 == 0, 990).otherwise(0)
    return seeds.sequence_scores(_indexed(t).select("user_id", "idx", number.alias("number")), "user_id").withColumn("score", F.round("score", 6))


@query(
    "A21",
    f"""WITH {_IDX}, c AS (SELECT user_id, idx, idx + 10 AS number FROM i WHERE event_id % 3 <> 0 UNION SELECT user_id, idx, idx + event_id % 4 * 7 FROM i), o AS (SELECT *, number - idx AS o FROM c), g AS (SELECT *, idx - lag(idx) OVER w AS want, number - lag(number) OVER w AS got FROM o WINDOW w AS (PARTITION BY user_id, o ORDER BY idx)),
    s AS (SELECT user_id, o, count(got) AS n, CASE WHEN count(got) = 0 THEN 0 ELSE avg(CASE WHEN got = want AND got > 0 THEN 100 WHEN abs(got - want) <= 1 THEN 50 WHEN got IS NOT NULL THEN -50 END) + CASE WHEN min(number) >= 1 AND max(number) <= 1000 THEN 20 ELSE 0 END END AS score FROM g GROUP BY user_id, o), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, score DESC, o) AS r FROM s)
    SELECT o.user_id, idx, number FROM o JOIN b ON o.user_id = b.user_id AND o.o = b.o WHERE r = 1""",
)
def best_sequences(t):
    i = _indexed(t)
    found = i.where("event_id % 3 <> 0").select("user_id", "idx", (F.col("idx") + 10).alias("number")).union(i.select("user_id", "idx", F.col("idx") + F.col("event_id") % 4 * 7))
    return seeds.best_sequences(found, "user_id")


@query("H02", f"WITH {_IDX}, p AS (SELECT user_id, idx, CASE WHEN event_id % 4 = 0 THEN idx * 2 END AS page FROM i), b AS (SELECT user_id, idx, page, coalesce(last_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, coalesce(first_value(page IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS high FROM p) SELECT user_id, idx, low::BIGINT AS low, high::BIGINT AS high FROM b WHERE page IS NULL")
def page_bounds(t):
    return seeds.between_known(_indexed(t).select("user_id", "idx", F.when(F.col("event_id") % 4 == 0, F.col("idx") * 2).alias("page")), "user_id")


_HEAD = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"
_BARE = r"regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*)', 1), '<[^>]*>', ' ', 'g')"


@query("H03", rf"""WITH p AS (SELECT page_id, {_HEAD} AS title, {_BARE} AS t FROM pages) SELECT page_id, {_tight("title")} <> '' AND contains({_tight("t")}, {_tight("title")}) AS appears, {_tight("title")} <> '' AND starts_with({_tight("t")}, {_tight("title")}) AS at_start FROM p""")
def title_on_page(t):
    body = F.regexp_replace(F.regexp_extract("html", r"(?s)<body[^>]*>(.*)", 1), "<[^>]*>", " ")
    appears, starts = seeds.title_appears(F.regexp_extract("html", "<title>([^<]*)</title>", 1), body)
    return t("pages").select("page_id", appears.alias("appears"), starts.alias("at_start"))


@query("H07", f"""WITH {_IDX}, b AS (SELECT user_id, idx, CASE user_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.1 WHEN 2 THEN CASE WHEN idx % 2 = 0 THEN 0.2 ELSE 0.9 END ELSE value / 100 % 1 END AS x FROM i), s AS (SELECT user_id, idx % 2 AS odd, CASE WHEN x < 0.33 THEN 'left' WHEN x > 0.67 THEN 'right' ELSE 'center' END AS spot FROM b),
    g AS (SELECT user_id, count(DISTINCT spot) AS n, count(DISTINCT spot) FILTER (odd = 0) AS n0, count(DISTINCT spot) FILTER (odd = 1) AS n1, min(spot) AS one FROM s GROUP BY user_id) SELECT user_id, CASE WHEN n = 1 AND one = 'center' THEN 'center' WHEN n = 1 THEN 'constant' WHEN n = 2 AND n0 = 1 AND n1 = 1 THEN 'alternating' ELSE 'mixed' END AS pattern FROM g""")
def position_pattern(t):
    u = F.col("user_id") % 4
    x = F.when(u == 0, 0.5).when(u == 1, 0.1).when(u == 2, F.when(F.col("idx") % 2 == 0, 0.2).otherwise(0.9)).otherwise(F.col("value") / 100 % 1)
    return seeds.position_pattern(_indexed(t).select("user_id", "idx", x.alias("x")), "user_id")


@query("H05", r"""WITH x AS (SELECT event_id, 'see <physical_index_' || event_id || '> and <physical_index_7>' AS t, CASE WHEN event_id % 2 = 0 THEN '{"title": "a", "text": "long", "nodes": "' || event_type || '", "node_id": "' || event_id || '"}' ELSE '{"node_id": "x", "title": "b"}' END AS j FROM events) SELECT event_id, TRY_CAST(nullif(regexp_extract(t, '<physical_index_(\d+)>', 1), '') AS BIGINT) AS physical_index, array_to_string(list_transform(list_filter(['title', 'node_id', 'nodes'], lambda k: json_extract_string(j, '$.' || k) IS NOT NULL), lambda k: k || '=' || json_extract_string(j, '$.' || k)), ';') AS kept FROM x""")
def tree_projection(t):
    e = t("events").withColumn("t", F.concat(F.lit("see <physical_index_"), "event_id", F.lit("> and <physical_index_7>")))
    even = F.concat(F.lit('{"title": "a", "text": "long", "nodes": "'), "event_type", F.lit('", "node_id": "'), "event_id", F.lit('"}'))
    j = F.when(F.col("event_id") % 2 == 0, even).otherwise(F.lit('{"node_id": "x", "title": "b"}'))
    kept = library.ordered_fields(F.from_json(j, "map<string,string>"), ["title", "node_id", "nodes"])
    return e.select("event_id", library.physical_index(F.col("t")).alias("physical_index"), F.array_join(F.transform(kept, lambda kv: F.concat(kv.key, F.lit("="), kv.value)), ";").alias("kept"))


@query("H06", f"WITH $LINES, s AS (SELECT doc_id, line_no, line, {many('line', chr(92) + 'S+')} AS n FROM lines) SELECT doc_id, line_no, n::BIGINT AS n_tokens, CASE WHEN n < 200 THEN sha256(line) END AS own_summary FROM s WHERE n > 0")
def short_summaries(t):
    n = T.word_count(F.col("line"))
    return _lines(t).where(n > 0).select("doc_id", "line_no", n.alias("n_tokens"), F.when(n < 200, F.sha2("line", 256)).alias("own_summary"))


# Records, files and rendering -----------------------------------------------------------------

_SIDES = """d AS (SELECT p_partkey AS id, lower(CASE p_size % 6 WHEN 0 THEN p_name || ': ' || p_type ELSE p_name END) AS a_title, lower(CASE p_size % 6 WHEN 0 THEN p_name || ': a note' WHEN 1 THEN p_name || ' and more' ELSE p_name END) AS b_title, CASE WHEN p_size % 6 = 2 THEN p_brand END AS a_publisher, CASE WHEN p_size % 6 = 2 THEN 'The ' || p_brand || ' Team' WHEN p_size % 6 = 3 THEN split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1) ELSE p_name END AS b_author, p_name AS a_author,
CASE WHEN p_size % 6 = 4 THEN '1999-5' ELSE '1999' END AS a_issued, '1999' AS b_issued, p_size % 6 <> 5 AS differs FROM part)"""


@query(
    "A15",
    f"""WITH {_SIDES}, t AS (SELECT *, length(a_publisher) >= 3 AND contains(lower(b_author), lower(a_publisher)) AND lower(b_author) <> lower(a_publisher) AS p1, a_title <> b_title AND length(least(a_title, b_title)) >= 3 AND (starts_with(a_title, b_title) OR starts_with(b_title, a_title)) AS p2,
    split_part(a_issued, '-', 1) = split_part(b_issued, '-', 1) AND len(string_split(a_issued, '-')) <> len(string_split(b_issued, '-')) AS p3, list_sort(list_filter(regexp_split_to_array(lower(a_author), '[\\s,]+'), lambda x: x <> '')) = list_sort(list_filter(regexp_split_to_array(lower(b_author), '[\\s,]+'), lambda x: x <> '')) AND list_filter(regexp_split_to_array(lower(a_author), '[\\s,]+'), lambda x: x <> '') <> list_filter(regexp_split_to_array(lower(b_author), '[\\s,]+'), lambda x: x <> '') AND len(list_filter(regexp_split_to_array(lower(a_author), '[\\s,]+'), lambda x: x <> '')) >= 2 AS p4,
    a_title <> b_title AND trim(split_part(a_title, ': ', 1)) = trim(split_part(b_title, ': ', 1)) AS p5 FROM d WHERE differs), u AS (SELECT id, unnest(['publisher_in_author', 'title_prefix', 'date_precision', 'name_order', 'subtitle_split', 'unexplained']) AS pattern, unnest([coalesce(p1, false), p2, p3, p4, p5, NOT (coalesce(p1, false) OR p2 OR p3 OR p4 OR p5)]) AS hit FROM t)
    SELECT pattern, count(*) FILTER (hit) AS n, min(id) FILTER (hit) AS example FROM u GROUP BY pattern""",
)
def disagreement_patterns(t):
    p, k = t("part"), F.col("p_size") % 6
    title = lambda zero, one: F.lower(F.when(k == 0, zero).when(k == 1, one).otherwise(F.col("p_name")))
    words = F.split("p_name", " ")
    d = p.where(k != 5).select(
        F.col("p_partkey").alias("id"), title(F.concat("p_name", F.lit(": "), "p_type"), F.col("p_name")).alias("a_title"), title(F.concat("p_name", F.lit(": a note")), F.concat("p_name", F.lit(" and more"))).alias("b_title"), F.when(k == 2, F.col("p_brand")).alias("a_publisher"), F.lit(None).cast("string").alias("b_publisher"),
        F.col("p_name").alias("a_author"), F.when(k == 2, F.concat(F.lit("The "), "p_brand", F.lit(" Team"))).when(k == 3, F.concat(words[1], F.lit(", "), words[0])).otherwise(F.col("p_name")).alias("b_author"), F.when(k == 4, "1999-5").otherwise("1999").alias("a_issued"), F.lit("1999").alias("b_issued"),
    )
    return score.disagreement_patterns(d)


@query("J21", "WITH k AS (SELECT DISTINCT page_id, lower(u) AS u FROM (SELECT page_id, unnest([url, 'doc-' || page_id, '10.1000/' || page_id]) AS u FROM pages)), q AS (SELECT CASE page_id % 3 WHEN 0 THEN upper(url) WHEN 1 THEN ' DOC-' || page_id || ' ' ELSE 'nothing-' || page_id END AS target FROM pages WHERE page_id % 4 = 0) SELECT DISTINCT target, page_id FROM q JOIN k ON lower(trim(target)) = u")
def record_lookup(t):
    p, k = t("pages"), F.col("page_id") % 3
    targets = p.where("page_id % 4 = 0").select(F.when(k == 0, F.upper("url")).when(k == 1, F.concat(F.lit(" DOC-"), "page_id", F.lit(" "))).otherwise(F.concat(F.lit("nothing-"), "page_id")).alias("target"))
    return library.lookup(p.select("page_id", "url", F.concat(F.lit("doc-"), "page_id").alias("folder"), F.concat(F.lit("10.1000/"), "page_id").alias("doi")), "page_id", ["url", "folder", "doi"], targets)


@query("H11", "WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'crossref' WHEN 1 THEN 'geonames' WHEN 2 THEN 'other' WHEN 3 THEN 'datacite' ELSE 'openlibrary' END AS p, CASE event_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'Tue, 01 Jan 2030 00:00:30 GMT' WHEN 2 THEN 'soon' END AS h FROM events) SELECT event_id, CASE WHEN p = 'other' THEN 'unsupported' WHEN p = 'geonames' AND event_id % 2 = 0 THEN 'no_username' WHEN event_id % 11 = 0 THEN 'offline' WHEN event_id % 7 = 0 THEN 'disabled' WHEN p NOT IN ('crossref', 'geonames', 'openlibrary') THEN 'not_selected' END AS state, CASE event_id % 4 WHEN 0 THEN 7.0 WHEN 1 THEN 30.0 ELSE 0.5 END::DOUBLE AS delay FROM e")
def provider_gate(t):
    e = F.col("event_id")
    p = F.element_at(F.array(*map(F.lit, ("crossref", "geonames", "other", "datacite", "openlibrary"))), (e % 5 + 1).cast("int"))
    header = F.when(e % 4 == 0, "7").when(e % 4 == 1, "Tue, 01 Jan 2030 00:00:30 GMT").when(e % 4 == 2, "soon")
    state = R.provider_state(p, ["crossref", "datacite", "openlibrary", "geonames"], F.array(*map(F.lit, ("crossref", "geonames", "openlibrary"))), e % 7 != 0, e % 11 == 0, F.when(e % 2 == 1, "me"), ["geonames"])
    return t("events").select("event_id", state.alias("state"), R.retry_delay(header, F.lit(1_893_456_000)).alias("delay"))


@query("H20 H22", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN split_part(p_name, ' ', 1) WHEN p_size % 3 = 1 THEN p_brand ELSE '' END AS surface, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 0 THEN split_part(p_name, ' ', 2) END AS given, array_to_string(list_filter(list_transform(string_split(p_name || ', ' || p_type || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS authors, trim(split_part(' 978-' || p_size || ', 979', ',', 1)) AS isbn, split_part(split_part(CASE WHEN p_size % 2 = 0 THEN 'ebook_0806' ELSE 'textbook.jsonl' END, '_', 1), '.', 1) AS kind FROM part")
def dataset_fields(t):
    n, w = F.col("p_size"), F.split("p_name", " ")
    surface, given = library.person_surface(F.when(n % 3 == 0, w[0]), F.when(n % 2 == 0, w[1]), F.when(n % 3 == 1, F.col("p_brand")))
    authors, isbn = library.listed_authors(F.concat("p_name", F.lit(", "), "p_type", F.lit(" ,"))), library.first_listed(F.concat(F.lit(" 978-"), n, F.lit(", 979")))
    return t("part").select("p_partkey", surface.alias("surface"), given.alias("given"), F.array_join(authors, "|").alias("authors"), isbn.alias("isbn"), library.batch_kind(F.when(n % 2 == 0, "ebook_0806").otherwise("textbook.jsonl")).alias("kind"))


_YAML = r"""CASE WHEN regexp_matches({0}, '[:#\[\]{{}},&*!|>''"%@`]|^\s|\s$|^$') THEN '"' || replace(replace({0}, '\', '\\'), '"', '\"') || '"' ELSE {0} END"""


@query(
    "K04",
    f"""WITH $LINES, r AS (SELECT d.doc_id, source || ' #' || d.doc_id AS title, lang FROM documents d), b AS (SELECT doc_id, string_agg(CASE WHEN line_no % 5 = 0 THEN '<!-- page ' || (line_no // 5 + 1) || ' -->' || chr(10) ELSE '' END || line, chr(10) ORDER BY line_no) AS body, string_agg(CASE WHEN line_no % 7 = 3 THEN line END, chr(10) ORDER BY line_no) AS notes, list(line ORDER BY line_no) FILTER (line_no % 7 = 3) AS n FROM lines GROUP BY doc_id)
    SELECT r.doc_id, sha256('---' || chr(10) || 'title: ' || {_YAML.format("title")} || chr(10) || 'language: ' || {_YAML.format("lang")} || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || 'Unknown. *' || title || '*. n.d..' || chr(10) || chr(10) || body || CASE WHEN len(n) > 0 THEN chr(10) || chr(10) || array_to_string(list_transform(n, lambda x, i: '[^' || i || ']: ' || x), chr(10)) ELSE '' END) AS digest FROM r JOIN b ON r.doc_id = b.doc_id""",
)
def library_markdown(t):
    d = t("documents").select("doc_id", F.concat("source", F.lit(" #"), "doc_id").alias("title"), F.col("lang").alias("language"))
    none = F.lit(None).cast("string")
    records = d.withColumn("citation", library.citation(none, F.col("title"), none, none, none, none, none))
    lines = _lines(t).select("doc_id", F.col("line_no").alias("ord"), F.expr("line_no div 5 + 1").alias("page"), (F.col("line_no") % 5 == 0).alias("first"), F.col("line").alias("text"), (F.col("line_no") % 7 == 3).alias("note"))
    return library.markdown(records, lines, "doc_id", ["title", "language"]).select("doc_id", F.sha2("markdown", 256).alias("digest"))


@query("K10", "WITH s AS (SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean FROM events GROUP BY event_type) SELECT event_type, '| ' || event_type || ' | ' || n || ' | ' || printf('%.2f', mean) || ' |' AS line FROM s")
def report_lines(t):
    s = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 2).alias("mean"))
    return s.select("event_type", library.table_row("event_type", "n", F.format_string("%.2f", "mean")).alias("line"))


def _refreshing(t):
    nxt = F.concat(F.lit("https://example.org/p"), F.col("page_id") + 1)
    meta = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit('<META content="x" name=a><meta http-equiv="Refresh" content="0; URL=\''), nxt, F.lit("'\">"))).when(F.col("page_id") % 10 == 9, F.concat(F.lit('<meta http-equiv="refresh" content="1;url=https://example.org/p'), F.col("page_id"), F.lit('">'))).otherwise("")
    return t("pages").select(F.concat(F.lit("https://example.org/p"), "page_id").alias("url"), F.concat(meta, "html").alias("html"))


@query(
    "S08",
    """WITH RECURSIVE m AS (SELECT 'https://example.org/p' || page_id AS url, CASE WHEN page_id % 4 = 3 THEN 'https://example.org/p' || (page_id + 1) WHEN page_id % 10 = 9 THEN 'https://example.org/p' || page_id END AS target FROM pages), c AS (SELECT url AS start, url, target, 0 AS hops, [url] AS seen, false AS cycle FROM m UNION ALL SELECT c.start, m.url, m.target, hops + 1, list_append(seen, m.url), list_contains(seen, m.url) FROM c JOIN m ON c.target = m.url WHERE hops < 5 AND NOT cycle),
    l AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops DESC) AS r FROM c) SELECT start AS url, CASE WHEN cycle THEN NULL WHEN target IS NULL THEN url END AS final_url, CASE WHEN cycle THEN 'cycle' WHEN target IS NULL THEN 'article' ELSE 'unresolved' END AS state, hops::BIGINT AS hops FROM l WHERE r = 1""",
)
def refresh_chains(t):
    return library.refresh_chains(_refreshing(t), 5)


@query("S15", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE url END AS url, page_id % 4 = 0 AS unreadable FROM (SELECT page_id, url FROM pages)")
def readable_rows(t):
    from docforge.plans.tables import new_path
    from docforge.sources import files

    p = t("pages")
    spark, path = p.sparkSession, new_path(p.sparkSession, "rows")
    row = F.to_json(F.struct("page_id", "url"))
    p.select(F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('{"page_id": '), F.col("page_id"), F.lit(', "url": "cut'))).otherwise(row).alias("value")).write.text(path)
    rows = files.json_lines(spark, path, "page_id long, url string")
    known = F.coalesce("page_id", F.regexp_extract("corrupt", r"(\d+)", 1).cast("long"))
    return rows.select(known.alias("page_id"), "url", F.col("corrupt").isNotNull().alias("unreadable"))


@query("S16", "SELECT p_partkey, p_name AS title, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS author, CASE WHEN p_size % 2 = 0 THEN p_type END AS publisher, (1900 + p_size)::VARCHAR AS issued, 'id' || p_partkey AS idno FROM part")
def tei_fields(t):
    from docforge.sources import files

    x = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title level="a"> '), "p_name", F.lit("</title></titleStmt><publicationStmt>"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("<publisher>"), "p_type", F.lit("</publisher>"))).otherwise(""), F.lit("<date>"), F.col("p_size") + 1900, F.lit("</date><idno>id"), "p_partkey",
        F.lit("</idno></publicationStmt><sourceDesc>"), F.when(F.col("p_size") % 3 != 0, F.concat(F.lit("<author><persName><surname>"), "p_brand", F.lit("</surname></persName></author>"))).otherwise(""), F.lit("</sourceDesc></fileDesc></teiHeader></TEI>"),
    )
    return dealt(t("part"), "p_partkey").select("p_partkey", files.tei_fields(x).alias("x")).select("p_partkey", "x.*")


@query("S18", "WITH r AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'bad' ELSE sha256(substr(url, 1, length(url) - 1)) END AS digest FROM pages), f AS (SELECT digest, min(page_id) AS page_id FROM r WHERE regexp_matches(digest, '^[0-9a-f]{64}$') GROUP BY digest) SELECT digest, page_id, row_number() OVER (ORDER BY digest) AS place FROM f")
def manifest_rows(t):
    from docforge.sources import files

    rows = t("pages").select("page_id", F.when(F.col("page_id") % 9 == 0, "bad").otherwise(F.sha2(F.expr("substr(url, 1, length(url) - 1)"), 256)).alias("digest"))
    return files.manifest(rows, "digest", "page_id")


@query("K02 Z06", "SELECT p_brand AS record, p_partkey, CASE WHEN p_size % 2 = 0 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 0) THEN 'new' ELSE 'old' END AS version FROM part WHERE NOT (p_size % 2 = 1 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 50 = 0))")
def replaced_records(t):
    from docforge.plans.tables import new_path
    from docforge.sources import files

    p = t("part")
    path = new_path(p.sparkSession, "records")
    own = p.select(F.col("p_brand").alias("record"), "p_partkey", "p_size")
    files.write_records(own.withColumn("version", F.lit("old")).drop("p_size"), path, "record")
    some = own.where("p_partkey % 50 = 0").select("record").distinct()
    files.write_records(own.join(some, "record").where("p_size % 2 = 0").withColumn("version", F.lit("new")).drop("p_size"), path, "record")
    return p.sparkSession.read.schema("p_partkey long, version string, record string").parquet(path).select("record", "p_partkey", "version")


@query("K01 K05", "SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS batch FROM events")
def appended_log(t):
    from docforge.plans.tables import new_path
    from docforge.sources import files

    e = t("events").select("event_id", "event_type")
    path = new_path(e.sparkSession, "log")
    for batch in (1, 2):
        files.append_rows(e.where(F.col("event_id") % 2 == batch - 1).withColumn("batch", F.lit(batch).cast("long")), path)
    return files.json_lines(e.sparkSession, path, "event_id long, event_type string, batch long").select("event_id", "event_type", "batch")


@query("V01 V03", "SELECT p_partkey, upper(p_name) AS name, length(p_type)::BIGINT AS n FROM part")
def registered_function(t):
    from docforge.operators import extend

    name = "upper_names"
    if name not in extend.names():
        extend.register(name, lambda df: df.select("p_partkey", F.upper("p_name").alias("name"), F.length("p_type").cast("long").alias("n")), ("p_partkey", "name", "n"))
    return extend.apply(name, t("part").select("p_partkey", "p_name", "p_type"))
