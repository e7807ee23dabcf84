"""Queries over documents, pages and their lines, with the SQL that gives the same rows.

A document's lines play the part of blocks, ``source`` that of a collection.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import ident as I
from docforge.functions import text as T
from docforge.operators import clean, evidence, library, structure, zones
from docforge.plans.registry import query


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def rkey(x: str) -> str:
    return f"CASE WHEN length({strip(x)}) < 60 THEN regexp_replace(lower({x}), {q(T.NOT_WORD)}, '', 'g') ELSE '' END"


def mkey(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '\d+', ' ', 'g'), {q(T.NOT_WORD_OR_LOW_LINE)}, ' ', 'g'))"


def many(x: str, p: str) -> str:
    return f"len(regexp_extract_all({x}, {q(p)}))"


def has(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def _lines(t):
    return structure.lines(t("documents"))


@query("A01 H26", f"WITH $LINES, k AS (SELECT doc_id, {rkey('line')} AS key FROM lines) SELECT key, count(DISTINCT doc_id) AS n_docs, count(*) AS n_lines, min(doc_id) AS first_doc FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 3")
def repeated_lines(t):
    return clean.repeated_lines(_lines(t))


_MARGINS = f"""inked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS a, row_number() OVER (PARTITION BY doc_id ORDER BY line_no DESC) AS b FROM lines WHERE {strip("line")} <> ''),
keyed AS (SELECT source, doc_id, line, {mkey("line")} AS key FROM inked WHERE a <= 4 OR b <= 4),
fits AS (SELECT DISTINCT source, key, doc_id FROM keyed WHERE key <> '' AND NOT {has("line", T.PAGE_NUMBER)} AND length({strip("line")}) <= 80 AND length(key) <= 60 AND {many("key", "\\S+")} <= 8),
pages_of AS (SELECT source, count(DISTINCT doc_id) AS pages FROM lines GROUP BY source),
margins AS (SELECT f.source, key, count(*) AS n_pages, min(doc_id) AS first_page FROM fits f JOIN pages_of p ON f.source = p.source GROUP BY f.source, key, pages HAVING count(*) >= least(5, greatest(2, ceil(pages * 0.15))))"""


@query("A02", f"WITH $LINES, {_MARGINS} SELECT * FROM margins")
def margin_lines(t):
    return clean.margin_lines(_lines(t))


@query(
    "W01",
    f"""WITH $LINES, {_MARGINS},
    marked AS (SELECT l.*, ({strip("line")} = '' OR {has("line", T.PAGE_NUMBER)} OR coalesce(l.doc_id > m.first_page, false)) AS gone FROM lines l LEFT JOIN margins m ON l.source = m.source AND m.key = {mkey("line")}),
    span AS (SELECT *, min(CASE WHEN NOT gone THEN line_no END) OVER (PARTITION BY doc_id) AS lo, max(CASE WHEN NOT gone THEN line_no END) OVER (PARTITION BY doc_id) AS hi FROM marked)
    SELECT doc_id, count(*) AS n_kept, sha256({strip("string_agg(line, chr(10) ORDER BY line_no)")}) AS text_sha256 FROM span WHERE lo IS NULL OR line_no BETWEEN lo AND hi GROUP BY doc_id""",
)
def strip_margins(t):
    lines = _lines(t)
    return clean.strip_margins(lines, clean.margin_lines(lines)).select("doc_id", "n_kept", F.sha2("text", 256).alias("text_sha256"))


_NODES = f"""nodes AS (SELECT doc_id, 'doc' || doc_id || ':p1:para' || (line_no + 1) || ':' || substr(sha256({squeeze("line")}), 1, 8) AS node_id, 1::BIGINT AS page, line_no + 1 AS paragraph, sha256({squeeze("line")}) AS sha256 FROM lines WHERE {squeeze("line")} <> '')"""
_TREE = f"""{_NODES}, leaves AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY node_id) - 1 AS idx, sha256 AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM nodes),
tree AS (SELECT doc_id, 0 AS lvl, idx, h, n FROM leaves UNION ALL
  SELECT doc_id, lvl + 1, idx // 2, sha256(max(CASE WHEN idx % 2 = 0 THEN h END) || coalesce(max(CASE WHEN idx % 2 = 1 THEN h END), max(CASE WHEN idx % 2 = 0 THEN h END))), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY doc_id, lvl, idx // 2, n)"""


@query("G01 G02 S02 A22", f"WITH $LINES, {_NODES} SELECT * FROM nodes")
def nodes(t):
    return structure.nodes(_lines(t))


@query("A11", f"WITH RECURSIVE $LINES, {_TREE} SELECT t.doc_id, l.leaf_count, t.h AS root FROM tree t JOIN (SELECT doc_id, count(*) AS leaf_count FROM nodes GROUP BY doc_id) l ON t.doc_id = l.doc_id WHERE t.n = 1")
def merkle_root(t):
    return structure.merkle_roots(structure.nodes(_lines(t)))


@query(
    "E17",
    f"""WITH RECURSIVE $LINES, {_TREE}, own AS (SELECT doc_id, least(2, count(*) - 1) AS leaf FROM nodes GROUP BY doc_id),
    spot AS (SELECT o.doc_id, t.lvl, (o.leaf // (2 ** t.lvl)::BIGINT) AS i, any_value(t.n) AS n FROM own o JOIN tree t ON o.doc_id = t.doc_id WHERE t.n > 1 GROUP BY ALL),
    s AS (SELECT doc_id, lvl, i, CASE WHEN xor(i, 1) < n THEN xor(i, 1) ELSE i END AS j FROM spot)
    SELECT s.doc_id, s.lvl::BIGINT AS level, CASE WHEN j > i THEN 'right' ELSE 'left' END AS position, t.h AS hash FROM s JOIN tree t ON s.doc_id = t.doc_id AND s.lvl = t.lvl AND s.j = t.idx""",
)
def merkle_proof(t):
    return structure.merkle_proofs(structure.nodes(_lines(t)), F.least(F.lit(2), F.col("leaf_count") - 1))


@query(
    "A12",
    f"""WITH $LINES, p AS (SELECT doc_id, line_no // 10 AS page, sha256(string_agg(sha256({squeeze("line")}), '' ORDER BY line_no)) AS h FROM lines GROUP BY doc_id, line_no // 10)
    SELECT doc_id, count(*) AS n_pages, sha256(string_agg(h, '' ORDER BY page)) AS root FROM p GROUP BY doc_id""",
)
def hier_merkle(t):
    return structure.hierarchical_roots(_lines(t))


_RATIOS = f"CASE WHEN length(text) = 0 THEN 1.0 ELSE {many('text', r'[\p{L}\p{N}]')} / length(text) END AS a, CASE WHEN length(text) = 0 THEN 1.0 ELSE {many('text', r'\s+')} / length(text) END AS s, CASE WHEN length(text) = 0 THEN 1.0 ELSE {many('text', chr(10) + '+')} / length(text) END AS n"


@query("X40 S03", f"WITH r AS (SELECT doc_id, {_RATIOS} FROM documents) SELECT doc_id, round(a, 6) AS alphanum, round(s, 6) AS space, round(n, 6) AS newline, CASE WHEN a < 0.3 OR s > 0.7 OR n > 0.6 THEN 'scanned' ELSE 'digital' END AS kind FROM r")
def text_quality(t):
    c = F.col("text")
    a, s, n = T.alphanum_ratio(c), T.space_ratio(c), T.newline_ratio(c)
    return t("documents").select("doc_id", F.round(a, 6).alias("alphanum"), F.round(s, 6).alias("space"), F.round(n, 6).alias("newline"), F.when((a < 0.3) | (s > 0.7) | (n > 0.6), "scanned").otherwise("digital").alias("kind"))


@query(
    "A13",
    f"""WITH r AS (SELECT source, {_RATIOS} FROM documents), k AS (SELECT source, count(*) AS n_pages, count(*) FILTER (a < 0.3 OR s > 0.7 OR n > 0.6) AS n_scanned, count(*) FILTER (a >= 0.6) AS n_usable FROM r GROUP BY source)
    SELECT source, n_pages, n_scanned, n_usable, CASE WHEN n_usable / n_pages >= 0.9 AND n_scanned = 0 THEN 'digital' WHEN n_scanned / n_pages >= 0.5 THEN 'scanned' ELSE 'mixed' END AS verdict FROM k""",
)
def page_vote(t):
    c = F.col("text")
    a, bad = T.alphanum_ratio(c), (T.alphanum_ratio(c) < 0.3) | (T.space_ratio(c) > 0.7) | (T.newline_ratio(c) > 0.6)
    k = t("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(bad).alias("n_scanned"), F.count_if(a >= 0.6).alias("n_usable"))
    verdict = F.when((F.col("n_usable") / F.col("n_pages") >= 0.9) & (F.col("n_scanned") == 0), "digital").when(F.col("n_scanned") / F.col("n_pages") >= 0.5, "scanned").otherwise("mixed")
    return k.select("*", verdict.alias("verdict"))


def _signals() -> str:
    flag = lambda p: f"max(CASE WHEN {has('line', '(?i)' + p)} THEN 1 ELSE 0 END)"
    total = lambda ps: " + ".join(flag(p) for p in ps)
    return f"{total(zones.THESIS)} AS th, {total(zones.BOOK)} + max(CASE WHEN {has(strip('line'), zones.PUBLISHER_LINE)} THEN 1 ELSE 0 END) AS bo, {total(zones.PAPER)} AS pa, bool_or({has('line', zones.BARE_DOI)}) AS doi"


@query(
    "A19 H13 F14",
    f"""WITH $LINES, s AS (SELECT doc_id, {_signals()} FROM lines GROUP BY doc_id), x AS (SELECT s.*, ceil(n_chars / 1800) AS pages, CASE WHEN th > 0 THEN th WHEN bo > 0 THEN bo ELSE pa END AS n FROM s JOIN documents d ON s.doc_id = d.doc_id)
    SELECT doc_id, CASE WHEN th > 0 THEN 'thesis' WHEN bo > 0 THEN 'book' WHEN pa > 0 THEN 'paper' WHEN pages <= 12 AND doi AND pages > 0 THEN 'paper' ELSE 'book' END AS type,
    CASE WHEN n >= 2 THEN 0.9 WHEN n = 1 THEN 0.7 WHEN (pages >= 60 AND NOT doi) OR (pages <= 12 AND doi AND pages > 0) THEN 0.6 ELSE 0.3 END::DOUBLE AS confidence, n::BIGINT AS n_signals FROM x""",
)
def doc_type_judge(t):
    return zones.document_types(_lines(t), t("documents").select("doc_id", F.ceil(F.col("n_chars") / 1800).alias("page_count")))


_MARK = " + ".join(f"CASE WHEN NOT rep AND {has('line', '(?i)' + p)} THEN {w} ELSE 0 END" for p, w in zones.MARKERS)
_MARK_N = " + ".join(f"CASE WHEN NOT rep AND {has('line', '(?i)' + p)} THEN 1 ELSE 0 END" for p, _ in zones.MARKERS)
_SCORES = f"""keyed AS (SELECT *, {rkey("line")} AS key FROM lines), rep AS (SELECT source, key FROM keyed WHERE key <> '' GROUP BY source, key HAVING count(DISTINCT doc_id) >= 3),
own AS (SELECT k.*, r.key IS NOT NULL AS rep FROM keyed k LEFT JOIN rep r ON k.source = r.source AND k.key = r.key),
scores AS (SELECT doc_id, source, sum({_MARK})::DOUBLE AS score, sum({_MARK_N})::BIGINT AS n_markers, bool_or(rep) AS repeated FROM own GROUP BY doc_id, source)"""


@query("A03", f"WITH $LINES, {_SCORES} SELECT * FROM scores")
def marker_pages(t):
    return zones.marker_scores(_lines(t))


@query(
    "W12",
    f"""WITH $LINES, {_SCORES}, paged AS (SELECT source, score, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, count(*) OVER (PARTITION BY source) AS n FROM scores),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, page) AS r FROM paged),
    best AS (SELECT source, n, unnest([page - 1, page, page + 1]) AS page FROM ranked WHERE r = 1),
    rest AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY r) AS r2 FROM ranked k WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.source = k.source AND b.page = k.page))
    SELECT source, page FROM (SELECT source, n, page FROM best UNION ALL SELECT source, n, page FROM rest WHERE r2 <= 5) WHERE page BETWEEN 1 AND n""",
)
def candidate_pages(t):
    scores = zones.marker_scores(_lines(t))
    paged = scores.select("source", "score", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long").alias("page"))
    return zones.candidate_pages(paged)


_PUB, _PLACE = (f"regexp_replace(regexp_extract(t, {q(zones.IMPRINT)}, {i}), '[ .,]+$', '')" for i in (1, 2))


@query(
    "E01",
    f"""WITH $LINES, b0 AS (SELECT doc_id, line_no, line, line_no // 5 + 1 AS page, {strip("line")} AS t, {rkey("line")} AS key FROM lines),
    b1 AS (SELECT *, CASE WHEN {has("line", zones.CIP)} THEN 'cip' WHEN {has("line", zones.COPYRIGHT)} THEN 'copyright'
      WHEN t <> '' AND length(t) <= 100 AND ({has("t", zones.IMPRINT_CJK)} OR ({has("t", zones.IMPRINT)} AND NOT {has(_PUB, r"\d")} AND NOT {has(_PLACE, r"\d")} AND NOT {has("t", r"(?i)(?:^|[^\p{L}\p{N}_])by(?:$|[^\p{L}\p{N}_])")} AND {has(_PUB, "[A-Z]")} AND ({many(_PUB, r"\S+")} <= 6 OR {_PLACE} <> '' OR {has("t", r"(?:^|[^\p{L}\p{N}_])(?:1[5-9]|20)\d{2}(?:$|[^\p{L}\p{N}_])")}))) THEN 'imprint'
      WHEN {has("t", zones.CONTENTS)} THEN 'contents' ELSE 'body' END AS z FROM b0),
    b2 AS (SELECT *, bool_or(z = 'cip') OVER p AS has_cip, bool_or(z = 'contents') OVER p OR sum(CASE WHEN {has("line", zones.LEADER)} THEN 1 ELSE 0 END) OVER p >= 2 AS has_contents FROM b1 WINDOW p AS (PARTITION BY doc_id, page)),
    b3 AS (SELECT * REPLACE (CASE WHEN has_cip AND z IN ('body', 'copyright') THEN 'cip' WHEN NOT has_cip AND has_contents AND z = 'body' THEN 'contents' ELSE z END AS z) FROM b2),
    b4 AS (SELECT *, count(*) OVER p AS n, NOT bool_or(z NOT IN ('body', 'imprint') OR length(line) > 160 OR {has("line", zones.BODY_END)} OR {has("line", zones.CIP)} OR {has("line", zones.COPYRIGHT)} OR {has("t", zones.CONTENTS)}) OVER p
      AND sum({many("line", r"\S+")}) OVER p <= 40 AND sum(length(line)) OVER p <= 260 AND page <= 3 AS ok FROM b3 WINDOW p AS (PARTITION BY doc_id, page)),
    b5 AS (SELECT *, coalesce(min(CASE WHEN ok AND n >= 2 THEN page END) OVER (PARTITION BY doc_id), min(CASE WHEN ok THEN page END) OVER (PARTITION BY doc_id)) AS tp FROM b4),
    b6 AS (SELECT *, min(CASE WHEN page = tp AND z = 'body' THEN line_no END) OVER (PARTITION BY doc_id) AS head FROM b5),
    b7 AS (SELECT * REPLACE (CASE WHEN page = tp AND z = 'body' AND line_no = head THEN 'title' WHEN page = tp AND z = 'body' THEN 'statement_of_responsibility'
      WHEN page < tp AND head IS NOT NULL AND n = 1 AND z = 'body' AND {many("line", r"\p{L}")} > 0 AND {many("line", r"\S+")} <= 12 AND {many("line", r"\p{Lu}")} >= 0.6 * {many("line", r"\p{L}")} AND NOT {has("line", zones.BODY_END)} THEN 'cover' ELSE z END AS z) FROM b6),
    rep AS (SELECT doc_id, key FROM b0 WHERE key <> '' GROUP BY doc_id, key HAVING count(DISTINCT page) >= 3)
    SELECT b7.doc_id, page, line_no, CASE WHEN rep.key IS NOT NULL AND z = 'body' THEN 'running_head' ELSE z END AS zone FROM b7 LEFT JOIN rep ON b7.doc_id = rep.doc_id AND b7.key = rep.key""",
)
def zone_labels(t):
    return zones.label_zones(_lines(t).withColumn("page", F.expr("line_no div 5 + 1")))


@query(
    "T03",
    """WITH $LINES, p AS (SELECT doc_id, line_no, line, line_no // 3 + 1 AS page, CASE WHEN regexp_matches(line, '(?i)copyright|license') THEN 1 ELSE 0 END AS imp FROM lines),
    h AS (SELECT *, max(imp) OVER (PARTITION BY doc_id, page) AS here FROM p), n AS (SELECT *, max(here) OVER (PARTITION BY doc_id ORDER BY page RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM h)
    SELECT doc_id, page, line_no, (len(regexp_extract_all(lower(line), 'the')) + len(regexp_extract_all(lower(line), 'der')) + len(regexp_extract_all(lower(line), 'license')) + CASE WHEN page < 4 THEN 8 ELSE 0 END
      + CASE WHEN here = 1 THEN 6 WHEN near = 1 THEN 3 ELSE 0 END - CASE WHEN regexp_matches(line, '(?i)references|bibliography') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(line, '(?i)title|author|publisher') THEN 1 ELSE 0 END)::BIGINT AS score FROM n""",
)
def evidence_rank(t):
    return zones.evidence_scores(_lines(t).withColumn("page", F.expr("line_no div 3 + 1")), ["the", "der", "license"])


@query(
    "W10 E15",
    "WITH $LINES, s AS (SELECT doc_id, line_no, length(line) AS n, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines), k AS (SELECT doc_id, line_no, greatest(0, least(n, 12000 - before))::BIGINT AS taken FROM s) SELECT * FROM k WHERE taken > 0",
)
def budget_select(t):
    return structure.within_budget(_lines(t), "doc_id", "line_no", F.length("line"), 12_000)


@query(
    "W08",
    f"""WITH $LINES, p AS (SELECT DISTINCT doc_id, line_no FROM lines WHERE length({strip("line")}) BETWEEN 1 AND 200), r AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM p),
    i AS (SELECT doc_id, min(line_no) AS a, max(line_no) AS b FROM r GROUP BY doc_id, run) SELECT doc_id, count(*) AS n_runs, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS spec FROM i GROUP BY doc_id""",
)
def page_islands(t):
    return structure.islands(_lines(t).where(F.length(T.stripped(F.col("line"))).between(1, 200)), "doc_id", "line_no")


_LEVELS = "heads AS (SELECT doc_id, line_no, 1 + length(line) % 3 AS level FROM lines)"
_SPANS = f"""{_LEVELS}, spans AS (SELECT h.doc_id, h.level, h.line_no AS start_line, coalesce((SELECT min(o.line_no) - 1 FROM heads o WHERE o.doc_id = h.doc_id AND o.line_no > h.line_no AND o.level <= h.level), (SELECT max(o.line_no) FROM heads o WHERE o.doc_id = h.doc_id)) AS end_line FROM heads h)"""


def _heads(t):
    return _lines(t).select("doc_id", "line_no", (1 + F.length("line") % 3).cast("long").alias("level"))


def _spans(t):
    h = _heads(t)
    return structure.section_spans(h, h.groupBy("doc_id").agg(F.max("line_no").alias("last_line")))


@query("W05 H16", f"WITH $LINES, {_LEVELS} SELECT doc_id, line_no, level::BIGINT AS level, (SELECT max(o.line_no) FROM heads o WHERE o.doc_id = h.doc_id AND o.line_no < h.line_no AND o.level < h.level) AS parent FROM heads h")
def section_tree(t):
    return structure.section_parents(_heads(t))


@query("W04 H04", f"WITH $LINES, {_SPANS} SELECT doc_id, level::BIGINT AS level, start_line, end_line FROM spans")
def section_text(t):
    return _spans(t)


@query(
    "J04 J14",
    f"""WITH $LINES, {_SPANS} SELECT p.doc_id, p.line_no, max(level)::BIGINT AS level, arg_max(start_line, level * 1000000 + start_line) AS start_line, count(*) AS n_covering FROM lines p JOIN spans s ON p.doc_id = s.doc_id AND p.line_no BETWEEN start_line AND end_line GROUP BY p.doc_id, p.line_no""",
)
def page_sections(t):
    return structure.deepest_section(_lines(t).select("doc_id", "line_no"), _spans(t))


@query(
    "J03",
    f"""WITH $LINES, {_SPANS}, k AS (SELECT p.doc_id, p.line_no, start_line, end_line, row_number() OVER (PARTITION BY p.doc_id, p.line_no ORDER BY start_line, end_line) AS r FROM lines p JOIN spans s ON p.doc_id = s.doc_id AND p.line_no BETWEEN start_line AND end_line)
    SELECT doc_id, line_no, start_line, end_line FROM k WHERE r = 1""",
)
def first_claim(t):
    return structure.first_claims(_lines(t).select("doc_id", "line_no"), _spans(t))


@query(
    "J01",
    """WITH $LINES, a AS (SELECT source, line, doc_id, line_no, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, line_no) AS k FROM lines WHERE line_no = 0 AND line <> ''),
    b AS (SELECT source, line, doc_id, line_no, row_number() OVER (PARTITION BY source, line ORDER BY doc_id, line_no) AS k FROM lines WHERE line_no > 0 AND line <> '')
    SELECT a.source, sha256(a.line) AS line_sha256, a.k, a.doc_id AS doc_id_l, a.line_no AS line_no_l, b.doc_id AS doc_id_r, b.line_no AS line_no_r FROM a JOIN b ON a.source = b.source AND a.line = b.line AND a.k = b.k""",
)
def ordinal_join(t):
    lines = _lines(t).where("line <> ''")
    j = structure.ordinal_join(lines.where("line_no = 0"), lines.where("line_no > 0"), ["source", "line"], ["doc_id", "line_no"])
    return j.select("source", F.sha2("line", 256).alias("line_sha256"), "k", "doc_id_l", "line_no_l", "doc_id_r", "line_no_r")


@query(
    "J19",
    f"""WITH $LINES, known AS (SELECT DISTINCT substr({squeeze("line")}, 1, 200) AS s FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark))
    SELECT doc_id, line_no, length(line)::BIGINT AS n FROM lines WHERE NOT EXISTS (SELECT 1 FROM known WHERE s = substr({squeeze("line")}, 1, 200))""",
)
def signature_anti(t):
    known = t("benchmark").select(F.explode(F.split("text", "\n")).alias("line"))
    return clean.without_signatures(_lines(t), known).select("doc_id", "line_no", F.length("line").cast("long").alias("n"))


@query("J10", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''")
def contains_join(t):
    return evidence.contained(t("benchmark"), t("documents")).select("item_id", "doc_id")


@query(
    "E05",
    """WITH p AS (SELECT item_id, doc_id, lower(b.text) AS qt, lower(d.text) AS t FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''),
    o AS (SELECT *, list_filter(generate_series(1, length(t) - length(qt) + 1), lambda i: substr(t, i, length(qt)) = qt) AS pos FROM p)
    SELECT item_id, doc_id, len(pos)::BIGINT AS n, pos[1]::BIGINT AS first_pos, substr(t, greatest(1, pos[1] - 45), pos[1] + length(qt) + 45 - greatest(1, pos[1] - 45)) AS context FROM o""",
)
def quote_replay(t):
    return evidence.replayed(evidence.contained(t("benchmark"), t("documents")))


@query(
    "E05",
    """WITH p AS (SELECT item_id, lower(b.text) AS qt, lower(d.text) AS t FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE b.text <> ''),
    o AS (SELECT item_id, sum(len(list_filter(generate_series(1, length(t) - length(qt) + 1), lambda i: substr(t, i, length(qt)) = qt))) AS n FROM p GROUP BY item_id)
    SELECT b.item_id, CASE WHEN coalesce(n, 0) = 0 THEN 'span_not_found' WHEN n = 1 THEN 'extraction-match' ELSE 'ambiguous_span' END AS status, coalesce(n, 0)::BIGINT AS candidate_count FROM benchmark b LEFT JOIN o ON b.item_id = o.item_id""",
)
def quote_status(t):
    return evidence.replay_status(evidence.replayed(evidence.contained(t("benchmark"), t("documents"))), t("benchmark"))


_HTML = r"regexp_extract(html, '<title>([^<]*)</title>', 1) AS title"


def _records(t):
    return t("pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", 'lang="([^"]*)"', 1).alias("type"))


@query("T01", f"SELECT page_id, url, title, type, count(*) OVER () AS total FROM (SELECT page_id, url, {_HTML}, regexp_extract(html, 'lang=\"([^\"]*)\"', 1) AS type FROM pages) WHERE type = 'en' ORDER BY page_id DESC LIMIT 100 OFFSET 5")
def library_list(t):
    return library.listing(_records(t), "page_id", 100, 5, "en").select("page_id", "url", "title", "type", "total")


@query(
    "T02 V04",
    f"""WITH r AS (SELECT page_id, url, {_HTML}, regexp_extract(html, 'lang="([^"]*)"', 1) AS type FROM pages), s AS (SELECT page_id, title, CASE WHEN lower(title) = 'the' THEN 100 WHEN contains(lower(title), 'the') THEN 60 WHEN lower(url) = 'the' THEN 85 WHEN contains(lower(type), 'the') THEN 40 WHEN contains(lower(url), 'the') THEN 30 ELSE 0 END::BIGINT AS score FROM r)
    SELECT * FROM s WHERE score > 0 ORDER BY score DESC, page_id DESC LIMIT 50""",
)
def library_search(t):
    r = _records(t)
    score = library.search_score("the", F.col("title"), F.col("type"), F.lit(""), F.col("url"), F.col("url"), F.lit(""))
    return library.search(r, score, "page_id", 50).select("page_id", "title", "score")


_HOST = r"lower(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query(
    "",  # a part of S09: links of one page
    rf"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)
    SELECT page_id, href FROM l WHERE href LIKE '/%' AND href <> '/' AND NOT {has("href", I.NOT_ARTICLES)} AND NOT {has("href", I.NOT_PAGES)}""",
)
def article_urls(t):
    links = t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href")).distinct()
    return links.where(F.col("href").startswith("/") & (F.col("href") != "/") & ~F.col("href").rlike(I.NOT_ARTICLES) & ~F.col("href").rlike(I.NOT_PAGES))


@query(
    "X16",
    rf"""WITH u AS (SELECT page_id, url, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS qs, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
    k AS (SELECT *, array_to_string(list_filter(string_split(qs, '&'), lambda p: p <> '' AND contains(p, '=') AND split_part(p, '=', 2) <> '' AND NOT list_contains([{", ".join(q(x) for x in I.TRACKING)}], split_part(p, '=', 1))), '&') AS kept FROM u)
    SELECT page_id, base || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || frag AS url FROM k""",
)
def clean_urls(t):
    return t("pages").select("page_id", I.without_tracking(F.col("url")).alias("url"))


@query("X61 X62", r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS lang, regexp_extract(html, 'charset="([^"]*)"', 1) AS charset, len(regexp_extract_all(html, '<a href='))::BIGINT AS n_links FROM pages""")
def html_head(t):
    g = lambda p: F.regexp_extract("html", p, 1)
    return t("pages").select("page_id", g("<title>([^<]*)</title>").alias("title"), g("<h1>([^<]*)</h1>").alias("h1"), g('<html[^>]*lang="([^"]*)"').alias("lang"), g('charset="([^"]*)"').alias("charset"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("n_links"))


@query(
    "S01 F03",
    rf"""WITH u AS (SELECT page_id, url, {_HOST.format("url")} AS h, lower(regexp_extract({_PATH.format("url")}, '\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)
    SELECT page_id, h AS host, CASE WHEN NOT regexp_matches(url, '^https?://') OR h = '' OR h IN ('localhost', '127.0.0.1') THEN 'unsupported' WHEN {" OR ".join(f"contains(h, {q(m)})" for m in I.MEDIA_HOSTS)} OR e IN ('mp3', 'mp4', 'wav', 'm4a', 'webm', 'mov') THEN 'media'
      WHEN e = 'pdf' THEN 'digital_pdf' WHEN e IN ('doc', 'docx', 'odt', 'ppt', 'pptx', 'xls', 'xlsx') THEN 'office_document' WHEN e = 'djvu' THEN 'djvu_document' ELSE 'url_article' END AS resource_type FROM u""",
)
def url_routing(t):
    return t("pages").select("page_id", I.host(F.col("url")).alias("host"), I.resource_type(F.col("url")).alias("resource_type"))


@query("F11 X63", r"""SELECT page_id, length(html) < 25000 AND regexp_matches(lower(substr(html, 1, 4000)), 'captcha|access denied|just a moment|verify you are human') AS blocked, contains(lower(html), 'redirecting') AND length(regexp_replace(html, '<[^>]*>', '', 'g')) < 300 AS redirect_only FROM pages""")
def page_predicates(t):
    blocked = (F.length("html") < 25_000) & F.lower(F.substring("html", 1, 4000)).rlike("captcha|access denied|just a moment|verify you are human")
    redirect = F.lower("html").contains("redirecting") & (F.length(F.regexp_replace("html", "<[^>]*>", "")) < 300)
    return t("pages").select("page_id", blocked.alias("blocked"), redirect.alias("redirect_only"))


@query("X01 X02 X22 X24", rf"""WITH $LINES SELECT doc_id, line_no, {squeeze("line")} AS canonical, CASE WHEN regexp_replace(regexp_replace(lower(trim(line)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'source' ELSE regexp_replace(regexp_replace(lower(trim(line)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') END AS slug,
   regexp_replace(substr(regexp_replace(regexp_replace(lower(line), {q(T.NOT_WORD)}, '_', 'g'), '^_+|_+$', '', 'g'), 1, 30), '_+$', '') AS unicode_slug,
   CASE WHEN {has("line", r"^[(（][一二三四五六七八九十\d]+[)）]")} THEN 2 WHEN {has("line", r"^\d+[.．、]")} THEN 3 ELSE 1 END::BIGINT AS heading_level FROM lines""")
def line_forms(t):
    c = F.col("line")
    return _lines(t).select("doc_id", "line_no", T.squeezed(c).alias("canonical"), T.slug(c).alias("slug"), T.unicode_slug(c).alias("unicode_slug"), T.heading_level(c).alias("heading_level"))


@query("X17", rf"""SELECT conv_id, turn, regexp_replace(lower(text), '[\s\x{{3000}}\x{{200B}}\x{{FEFF}}]+', '', 'g') AS compact, trim(regexp_replace(lower(text), {q(T.NOT_WORD_OR_LOW_LINE)}, ' ', 'g')) AS plain FROM conversations""")
def text_forms(t):
    return t("conversations").select("conv_id", "turn", T.compact(F.col("text")).alias("compact"), T.plain(F.col("text")).alias("plain"))


@query("F07", f"""WITH $LINES, k AS (SELECT doc_id, line_no, {rkey("line")} AS key FROM lines), r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 3) SELECT doc_id, line_no FROM k WHERE line_no // 5 < 3 AND key NOT IN (SELECT key FROM r)""")
def page_window(t):
    lines = _lines(t)
    keyed = lines.select("doc_id", "line_no", T.repeat_key(F.col("line")).alias("key"))
    return keyed.where("line_no div 5 < 3").join(clean.repeated_lines(lines).select("key"), "key", "left_anti").select("doc_id", "line_no")


@query("F08", f"""WITH $LINES, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) SELECT doc_id, line_no FROM n WHERE line_no < greatest(1, floor(n * 0.1)) OR line_no >= n - greatest(1, floor(n * 0.1))""")
def page_edges(t):
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    edge = F.greatest(F.lit(1), F.floor(F.col("n") * 0.1))
    return _lines(t).withColumn("n", n).where((F.col("line_no") < edge) | (F.col("line_no") >= F.col("n") - edge)).select("doc_id", "line_no")


@query("E06 U06", """WITH $LINES, b AS (SELECT doc_id::VARCHAR AS source_id, line_no AS ord, 'b' || line_no AS block_id, line_no // 5 AS page, line AS text FROM lines WHERE line <> '') SELECT sha256(source_id || '|' || page || '|' || block_id || '|0|' || length(text)) AS span_id, source_id, block_id, page, 'page ' || page AS label FROM b""")
def quotation_spans(t):
    b = _lines(t).where("line <> ''").select(F.col("doc_id").cast("string").alias("source_id"), F.col("line_no").alias("ord"), F.concat(F.lit("b"), "line_no").alias("block_id"), F.expr("line_no div 5").alias("page"), F.col("line").alias("text"))
    return evidence.quotation_rows(b).select("span_id", "source_id", "block_id", "page", "label")


@query("U04 U03", """WITH $LINES, e AS (SELECT line AS quote, source AS locator, doc_id * 100000 + line_no AS ord FROM lines UNION ALL SELECT line, source, doc_id * 100000 + line_no + 50000 FROM lines WHERE line_no < 5) SELECT sha256(quote) AS quote_sha256, locator, min(ord) AS ord FROM e GROUP BY quote, locator""")
def evidence_union(t):
    e = _lines(t).select((F.col("doc_id") * 100_000 + F.col("line_no")).alias("ord"), F.col("line").alias("quote"), F.col("source").alias("locator"), "line_no")
    return evidence.distinct_evidence(e.drop("line_no"), e.where("line_no < 5").withColumn("ord", F.col("ord") + 50_000).drop("line_no")).select(F.sha2("quote", 256).alias("quote_sha256"), "locator", "ord")
