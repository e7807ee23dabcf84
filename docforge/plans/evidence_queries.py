"""Queries of the evidence gate, of identity and of registry payloads, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docforge.functions import registry as R
from docforge.functions import text as T
from docforge.operators import gate as G
from docforge.operators import identity, match
from docforge.plans.document_queries import _lines, q, squeeze
from docforge.plans.registry import query
from docforge.plans.tables import dealt

_FROM, _TO = "".join(T._FORMS) + "\u00ad", "".join(T._FORMS.values())  # noqa: SLF001


def _tight(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[\s\x{{3000}}\x{{200B}}\x{{FEFF}}]+', '', 'g')"


def _plain(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), {q(T.NOT_WORD_OR_LOW_LINE)}, ' ', 'g'))"


def _loose(x: str) -> str:
    return squeeze(f"replace(replace(translate({x}, {q(_FROM)}, {q(_TO)}), '\ufb01', 'fi'), '\ufb02', 'fl')")


def _found(quote: str, text: str) -> str:
    return f"""CASE WHEN instr({text}, {quote}) > 0 THEN instr({text}, {quote}) - 1
      WHEN {_tight(quote)} <> '' AND instr({_tight(text)}, {_tight(quote)}) > 0 THEN list_filter(generate_series(1, length({text})), lambda i: {_tight(f"substr({text}, i, 1)")} <> '')[instr({_tight(text)}, {_tight(quote)})] - 1
      WHEN {_loose(quote)} <> '' AND instr({_loose(text)}, {_loose(quote)}) > 0 THEN instr({_loose(text)}, {_loose(quote)}) - 1 END"""


_BLOCKS = """blocks AS (SELECT doc_id * 100000 + line_no // 6 AS source_id, 'b' || line_no AS block_id, line_no AS ord, line AS text, line_no // 3 AS page, CASE line_no % 12 WHEN 4 THEN 'uploader' WHEN 8 THEN 'date-modified' END AS metadata_key FROM lines),
places AS (SELECT source_id, max(CASE WHEN ord % 6 = 0 THEN text END) AS l0, max(CASE WHEN ord % 6 = 1 THEN text END) AS l1, max(CASE WHEN ord % 6 = 2 THEN text END) AS l2, max(CASE WHEN ord % 6 = 3 THEN text END) AS l3, max(CASE WHEN ord % 6 = 4 THEN text END) AS l4, min(ord) AS o FROM blocks GROUP BY source_id)"""
#: Fields of each source of six lines: name, value and spans (place, quote) over the columns l0 to l4 and o; every rule of the gate is met.
_FIELDS = [
    ("title", "substr(l0, 1, 30)", [("o", "substr(l0, 1, 40)")]),
    ("publisher", "substr(l1, 5, 20)", [("o + 1", "replace(substr(l1, 3, 40), ' ', '')")]),
    ("author", "substr(l2, 1, 10)", [("o + 1", "substr(l1, 1, 20)"), ("o + 2", "substr(l2, 1, 20)")]),
    ("editor", "substr(l2, 1, 10)", [("o", "substr(l0, 1, 20)"), ("o + 2", "substr(l2, 1, 20)")]),
    ("translator", "substr(l4, 1, 10)", [("o + 4", "substr(l4, 1, 20)")]),
    ("container-title", "substr(l2, 1, 12)", [("o + 1", "right(l1, 15) || ' ' || substr(l2, 1, 15)")]),
    ("edition", "substr(l3, 1, 12)", [("o + 2", "right(l2, 15) || ' ' || substr(l3, 1, 15)")]),
    ("DOI", "'10.1000/x'", [("999999", "substr(l0, 1, 5)")]),
    ("issued", "substr(l2, 1, 4)", [("o + 2", "substr(l2, 1, 8)")]),
    ("volume", "''", [("o", "substr(l0, 1, 9)")]),
    ("issue", "'qqqzzz'", [("o", "substr(l0, 1, 9)")]),
    ("accessed", "substr(l0, 1, 4)", [("o", "substr(l0, 1, 9)")]),
    ("medium", "substr(l0, 1, 4)", [("o", "'  '")]),
    ("subtitle", "replace(substr(l0, 1, 25), '.', '!')", [("o", "replace(substr(l0, 1, 40), ' ', '  ')")]),
    ("page", "substr(l0, 1, 3) || '-' || substr(l0, 9, 3)", [("o", "substr(l0, 1, 20)")]),
    ("URL", "substr(l0, 1, 4)", []),
]
_VALUES = " UNION ALL ".join(f"SELECT source_id, '{f}' AS field, {v} AS value FROM places" for f, v, _ in _FIELDS)
_SPANS = " UNION ALL ".join(f"SELECT source_id, '{f}' AS field, {i} AS span_no, 'b' || ({b}) AS block_id, {t} AS quote FROM places" for f, _, spans in _FIELDS for i, (b, t) in enumerate(spans, 1))
_WRONG = "(({f} IN ('author', 'editor', 'translator', 'interviewer', 'host') AND {k} IN ('uploader', 'channel', 'platform')) OR ({f} = 'publisher' AND {k} = 'platform') OR ({f} = 'title' AND {k} IN ('filename', 'source_path')) OR ({f} = 'accessed' AND {k} <> 'accessed') OR ({f} = 'issued' AND (contains(lower({k}), 'modified') OR lower({k}) IN ('event-date', 'event_date'))))"


def _evidence(t):
    lines = _lines(t)
    key = F.when(F.col("line_no") % 12 == 4, "uploader").when(F.col("line_no") % 12 == 8, "date-modified")
    blocks = lines.select((F.col("doc_id") * 100_000 + F.expr("line_no div 6")).alias("source_id"), F.concat(F.lit("b"), "line_no").alias("block_id"), F.col("line_no").alias("ord"), F.col("line").alias("text"), F.expr("line_no div 3").alias("page"), key.alias("metadata_key"))
    at = blocks.groupBy("source_id").agg(*(F.max(F.when(F.col("ord") % 6 == i, F.col("text"))).alias(f"l{i}") for i in range(5)), F.min("ord").alias("o"))
    each = [F.struct(F.lit(f).alias("field"), F.expr(v).alias("value"), F.array(*(F.struct(F.lit(i).alias("span_no"), F.expr(f"concat('b', {b})").alias("block_id"), F.expr(x).alias("quote")) for i, (b, x) in enumerate(spans, 1))).cast("array<struct<span_no:int,block_id:string,quote:string>>").alias("spans")) for f, v, spans in _FIELDS]
    rows = at.select("source_id", F.explode(F.array(*each)).alias("x")).select("source_id", "x.*")
    return rows.select("source_id", "field", "value"), rows.select("source_id", "field", F.explode("spans").alias("s")).select("source_id", "field", "s.*"), blocks


@query(
    "E02 W03",
    f"""WITH $LINES, {_BLOCKS}, vals AS ({_VALUES}), spans AS ({_SPANS}),
    held AS (SELECT *, row_number() OVER w AS place, lead(text) OVER w AS after, lead(page) OVER w AS after_page, lead(metadata_key) OVER w AS after_key FROM blocks WINDOW w AS (PARTITION BY source_id ORDER BY ord)),
    s1 AS (SELECT s.*, count(*) OVER (PARTITION BY s.source_id, s.field) AS n, h.text, h.page, h.place, h.after, h.after_page, coalesce(h.metadata_key, '') AS k, coalesce(h.after_key, '') AS k2 FROM spans s LEFT JOIN held h ON s.source_id = h.source_id AND s.block_id = h.block_id),
    s2 AS (SELECT *, {_found("quote", "text")} AS start, {_WRONG.format(f="field", k="k")} AS bad_role, {_WRONG.format(f="field", k="k2")} AS bad_next FROM s1),
    s3 AS (SELECT *, n = 1 AND start IS NULL AND NOT bad_role AND NOT bad_next AND coalesce(page = after_page, true) AND len(list_filter(list_filter(generate_series(2, length(quote) - 1), lambda i: substr(quote, i, 1) IN (' ', chr(10)) AND NOT regexp_matches(substr(quote, i - 1, 1), '\\s') AND NOT regexp_matches(substr(quote, i + 1, 1), '\\s')),
        lambda i: (contains({_tight("text")}, {_tight("substr(quote, 1, i - 1)")}) OR contains({_loose("text")}, {_loose("substr(quote, 1, i - 1)")})) AND (contains({_tight("after")}, {_tight("substr(quote, i + 1)")}) OR contains({_loose("after")}, {_loose("substr(quote, i + 1)")})))) > 0 AS runs_on FROM s2),
    s4 AS (SELECT *, CASE WHEN trim(quote) = '' THEN 'empty' WHEN text IS NULL THEN 'not_found' WHEN start IS NULL AND coalesce(runs_on, false) THEN NULL WHEN start IS NULL THEN 'quote_mismatch' WHEN bad_role THEN 'wrong_role' END AS reason, lag(place) OVER w AS place1, lag(page) OVER w AS page1 FROM s3 WINDOW w AS (PARTITION BY source_id, field ORDER BY span_no)),
    own AS (SELECT source_id, field, max(n) AS n, arg_min(reason, span_no) FILTER (reason IS NOT NULL) AS bad, bool_or(span_no > 1 AND NOT (coalesce(place = place1 + 1, false) AND coalesce(page = page1, true))) AS apart, string_agg(quote, ' ' ORDER BY span_no) AS quote, max(block_id) FILTER (span_no = 1) AS block_id, max(start) FILTER (span_no = 1) AS char_start FROM s4 GROUP BY source_id, field),
    v AS (SELECT vals.source_id, vals.field, value, n, bad, apart, quote, block_id, char_start, list_filter(regexp_split_to_array(value, '\\s*[-–—/]\\s*'), lambda p: trim(p) <> '') AS ends FROM vals LEFT JOIN own ON vals.source_id = own.source_id AND vals.field = own.field),
    r AS (SELECT *, CASE WHEN coalesce(trim(value), '') = '' THEN 'empty' WHEN n IS NULL OR n > 8 THEN 'not_found' WHEN bad IS NOT NULL THEN bad WHEN apart OR NOT (contains(lower({squeeze("quote")}), lower({squeeze("value")})) OR (field = 'page' AND len(ends) > 1 AND len(list_filter(ends, lambda p: NOT contains({_tight("quote")}, {_tight("p")}))) = 0)
      OR (field IN ('author', 'editor', 'translator', 'title', 'subtitle', 'publisher', 'publisher-place') AND (contains({_plain("quote")}, {_plain("value")}) OR contains({_tight("quote")}, {_tight("value")})))) THEN 'quote_mismatch' END AS reason FROM v)
    SELECT source_id, field, reason IS NULL AS supported, reason, CASE WHEN reason IS NULL THEN block_id END AS block_id, CASE WHEN reason IS NULL THEN char_start END::BIGINT AS char_start FROM r""",
)
def evidence_gate(t):
    return G.gate(*_evidence(t))


# Records and candidates made of parts: each size of a part is one way in which a pair may agree or differ.
_PAIR = {
    "l_title": "CASE WHEN p_size % 13 = 9 THEN 'Tin' WHEN p_size % 13 = 2 THEN p_type || ' part ii' ELSE 'The ' || p_name || ' ' || p_type END",
    "l_subtitle": "CASE WHEN p_size % 2 = 0 THEN 'A study' END",
    "r_title": "CASE WHEN p_size % 13 = 1 THEN 'Another ' || p_brand WHEN p_size % 13 = 9 THEN 'Tin' WHEN p_size % 13 = 2 THEN p_type || ' part iii' WHEN p_size % 2 = 0 THEN 'The ' || p_name || ' ' || p_type || ': a study' ELSE upper('The ' || p_name || ' ' || p_type) END",
    "r_subtitle": "CASE WHEN p_size % 13 = 9 AND p_size % 2 = 0 THEN 'A study' WHEN p_size % 13 = 2 AND p_size % 2 = 0 THEN 'A study' END",
    "l_type": "CASE WHEN p_size % 3 = 0 THEN 'article' ELSE 'book' END",
    "r_type": "CASE WHEN p_size % 13 = 3 THEN 'report' WHEN p_size % 3 = 0 THEN 'article-journal' ELSE 'book' END",
    "l_edition": "CASE WHEN p_size % 13 = 4 THEN '2nd' END",
    "r_edition": "CASE WHEN p_size % 13 = 4 THEN '3rd' END",
    "l_language": "'en'",
    "r_language": "CASE WHEN p_size % 13 = 5 THEN 'de' ELSE 'EN' END",
    "l_family": "split_part(p_name, ' ', 1)",
    "l_given": "split_part(p_name, ' ', 2) || ' M'",
    "r_literal": "CASE WHEN p_size % 13 = 6 THEN 'Nobody, N.' WHEN p_size % 13 = 7 THEN split_part(p_name, ' ', 1) || ', Zz' WHEN p_size % 4 = 0 THEN substr(split_part(p_name, ' ', 2), 1, 1) || '. M. ' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) END",
    "l_year": "1900 + p_size",
    "r_year": "1900 + p_size + CASE WHEN p_size % 13 = 8 THEN 3 WHEN p_size % 5 = 0 THEN 1 ELSE 0 END",
    "l_publisher": "p_brand",
    "r_publisher": "CASE WHEN p_size % 13 = 10 THEN p_type ELSE lower(p_brand) || '.' END",
    "known": "p_size % 13 = 11",
    "isbn": "p_size % 13 = 12",
    "years_only": "p_size % 13 IN (9, 11, 12)",
}
_PAIRS = "pairs AS (SELECT p_partkey AS record_id, " + ", ".join(f"{v} AS {k}" for k, v in _PAIR.items()) + " FROM part)"
_NUMBERS = lambda c: f"flatten(list_transform(generate_series(1, len(string_split({c}, ' '))), lambda i: CASE WHEN i > 1 AND string_split({c}, ' ')[i - 1] IN ('volume', 'vol', 'part', 'tome', 'book') AND regexp_full_match(string_split({c}, ' ')[i], '[ivxlcdm]+') THEN [string_split({c}, ' ')[i]] ELSE regexp_extract_all(string_split({c}, ' ')[i], '\\d+') END))"
_KEY = lambda s: f"CASE WHEN {_plain(f'coalesce({s}_subtitle, {q(str())})')} = '' OR contains({_plain(f'{s}_title')}, {_plain(f'coalesce({s}_subtitle, {q(str())})')}) THEN {_plain(f'{s}_title')} ELSE {_plain(f'{s}_title')} || ' ' || {_plain(f'{s}_subtitle')} END"
_JUDGED = f"""{_PAIRS}, k AS (SELECT *, {_KEY("l")} AS lt, {_KEY("r")} AS rt FROM pairs), sc AS (SELECT *, CASE WHEN lt = '' OR rt = '' THEN 0.0 ELSE 1 - levenshtein(lt, rt) / greatest(length(lt), length(rt)) END AS score,
    {_plain("l_family")} AS lf, {_plain("l_given")} AS lg, {_plain("CASE WHEN contains(r_literal, ',') THEN regexp_replace(r_literal, '^[^,]*,', '') ELSE regexp_replace(trim(r_literal), '\\s*\\S+$', '') END")} AS rg, {_plain("r_literal")} AS rn FROM k),
    nm AS (SELECT *, (lf = rn OR lf = regexp_extract(rn, '([^ ]+)$', 1)) AND len(list_filter(generate_series(1, least(len(string_split(lg, ' ')), len(string_split(rg, ' ')))), lambda i: string_split(lg, ' ')[i] <> string_split(rg, ' ')[i] AND NOT (substr(string_split(lg, ' ')[i], 1, 1) = substr(string_split(rg, ' ')[i], 1, 1) AND least(length(string_split(lg, ' ')[i]), length(string_split(rg, ' ')[i])) = 1))) = 0 AS names FROM sc),
    an AS (SELECT *, NOT years_only AND names AS a_author, abs(l_year - r_year) <= 1 AS a_issued, NOT years_only AND {_plain("l_publisher")} = {_plain("r_publisher")} AS a_publisher FROM nm),
    judged AS (SELECT *, CASE WHEN score < 0.9 THEN 'title_mismatch' WHEN {_NUMBERS("lt")} <> {_NUMBERS("rt")} THEN 'title_numeral_mismatch' WHEN l_type <> r_type AND NOT (l_type = 'article' AND r_type IN ('article-journal', 'paper-conference')) THEN 'work_type_mismatch'
      WHEN lower(l_edition) <> lower(r_edition) THEN 'edition_mismatch' WHEN lower(l_language) <> lower(r_language) THEN 'language_mismatch' WHEN NOT years_only AND NOT names AND (NOT known OR isbn) THEN 'author_mismatch' WHEN isbn AND NOT a_author THEN 'isbn_requires_title_author_agreement'
      WHEN NOT a_issued AND NOT known THEN 'issued_mismatch' WHEN NOT years_only AND NOT a_publisher AND NOT known THEN 'publisher_mismatch'
      WHEN a_author::INT + a_issued::INT + a_publisher::INT < CASE WHEN known AND NOT isbn THEN 0 WHEN length(replace(lt, ' ', '')) < 12 OR len(string_split(lt, ' ')) < 3 THEN 2 ELSE 1 END THEN 'insufficient_source_anchors' ELSE 'host_identity_agreement' END AS reason FROM an)"""


def _judged(t):
    cols = t("part").select(F.col("p_partkey").alias("record_id"), *(F.expr(v).alias(k) for k, v in _PAIR.items()))
    person = lambda family, given, literal: F.array(F.struct(family.alias("family"), given.alias("given"), literal.alias("literal"))).cast(R.PEOPLE)
    none, nobody = F.lit(None).cast("string"), F.array().cast(R.PEOPLE)
    pairs = cols.select(
        "*", person(F.col("l_family"), F.col("l_given"), none).alias("l_author"), person(none, none, F.col("r_literal")).alias("r_author"), nobody.alias("l_editor"), nobody.alias("r_editor"), none.alias("l_container"), none.alias("r_container"),
        F.when(F.col("years_only"), F.array(F.lit("issued"))).otherwise(F.array(*map(F.lit, ("author", "issued", "publisher")))).alias("supported"),
    )
    return identity.judged(pairs, match.edit_similarity(F.col("lt"), F.col("rt")))


@query("J17", f"WITH {_JUDGED} SELECT record_id, round(score, 6) AS score, reason = 'host_identity_agreement' AS accepted, reason FROM judged")
def identity_match(t):
    return _judged(t).select("record_id", F.round("score", 6).alias("score"), "accepted", "reason")


@query(
    "E08",
    f"""WITH {_JUDGED}, c AS (SELECT record_id, 'doi:10.1000/' || record_id AS identity, score FROM judged WHERE reason = 'host_identity_agreement' UNION ALL SELECT record_id, 'title:' || rt, score - CASE WHEN record_id % 3 = 0 THEN 0.01 ELSE 0.06 END FROM judged WHERE reason = 'host_identity_agreement' AND record_id % 4 <> 0),
    r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM c WINDOW w AS (PARTITION BY record_id ORDER BY score DESC, identity))
    SELECT record_id, CASE WHEN second IS NULL OR round(score - second, 9) >= 0.05 THEN identity END AS identity, round(score, 6) AS score, CASE WHEN second IS NULL OR round(score - second, 9) >= 0.05 THEN 'linked' ELSE 'ambiguous_identity' END AS decision FROM r WHERE r = 1""",
)
def identity_choice(t):
    j = _judged(t)
    one = j.withColumn("identity", identity.identity_key(F.concat(F.lit("10.1000/"), "record_id"), F.lit(None).cast("string"), F.concat(F.lit("title:"), "rt")))
    two = j.where("record_id % 4 <> 0").withColumn("score", F.col("score") - F.when(F.col("record_id") % 3 == 0, 0.01).otherwise(0.06)).withColumn("identity", identity.identity_key(F.lit(None).cast("string"), F.lit(None).cast("string"), F.concat(F.lit("title:"), "rt")))
    return identity.selected(one.unionByName(two), "record_id", "identity").withColumn("score", F.round("score", 6))


# Payloads as texts: lists and plain values, blanks, missing keys, dates of several kinds and names with and without families.
_CROSSREF = """'{"type": ' || CASE p_size % 4 WHEN 0 THEN '"journal-article"' WHEN 1 THEN '"monograph"' WHEN 2 THEN '"dissertation"' ELSE 'null' END || ', "title": ' || CASE p_size % 3 WHEN 0 THEN '[" ", "' || p_name || ' "]' WHEN 1 THEN '"' || p_name || '"' ELSE '[]' END
 || ', "container-title": ["' || p_type || '"], "publisher": " ' || p_type || '", "publisher-location": "", "page": "' || p_size || '-' || (p_size + 9) || '", "DOI": "https://doi.org/10.1000/P' || p_partkey || ').", "ISSN": ["1234-567' || (p_size % 10) || '", "0"], "author": [{"family": "' || p_brand || '", "given": " A "}, {"name": "Team ' || p_size || '"}, {"given": "x"}]'
 || CASE p_size % 5 WHEN 0 THEN ', "published-print": {"date-parts": [[' || (1900 + p_size) || ', 5]]}' WHEN 1 THEN ', "issued": {"date-parts": [[null]]}, "published-online": {"date-parts": [[' || (1800 + p_size) || ', 2, 3]]}' ELSE '' END || ', "editor": []}'"""


def _first_sql(j: str, path: str) -> str:
    return f"""CASE WHEN json_type({j}, '{path}') = 'ARRAY' THEN list_filter(list_transform(from_json(json_extract({j}, '{path}'), '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> '')[1] ELSE nullif(trim(json_extract_string({j}, '{path}')), '') END"""


def _dates_sql(j: str) -> str:
    def one(k: str) -> str:
        path = f'$."{k}"."date-parts"[0]'
        parts = f"""from_json(json_extract({j}, '{path}'), '["INTEGER"]')"""
        return f"CASE WHEN len({parts}) > 0 AND len(list_filter({parts}, lambda x: x IS NULL)) = 0 THEN array_to_string({parts}, '-') END"

    return f"coalesce({', '.join(one(k) for k in R.DATES)})"


_PEOPLE_SQL = """list_filter(list_transform(from_json(json_extract(j, '$.author'), '[{"family": "VARCHAR", "given": "VARCHAR", "name": "VARCHAR"}]'), lambda p: CASE WHEN coalesce(trim(p.family), '') <> '' THEN trim(p.family) || ', ' || coalesce(trim(p.given), '') ELSE nullif(trim(p.name), '') END), lambda x: x IS NOT NULL)"""


def _names(c):
    return F.array_join(F.transform(c, lambda p: F.when(p.family.isNotNull(), F.concat(p.family, F.lit(", "), F.coalesce(p.given, F.lit("")))).otherwise(p.literal)), "; ")


@query(
    "S10 S11 H10",
    f"""WITH p AS (SELECT p_partkey, {_CROSSREF} AS j FROM part)
    SELECT p_partkey, CASE {_first_sql("j", "$.type")} WHEN 'journal-article' THEN 'article-journal' WHEN 'dissertation' THEN 'thesis' ELSE CASE WHEN json_extract_string(j, '$.type') IS NOT NULL THEN 'article' END END AS type, {_first_sql("j", "$.title")} AS title, {_first_sql("j", '$."container-title"')} AS container, {_first_sql("j", "$.publisher")} AS publisher, {_first_sql("j", '$."publisher-location"')} AS place,
    {_first_sql("j", "$.page")} AS page, rtrim(rtrim(lower(regexp_extract(json_extract_string(j, '$.DOI'), '10\\.\\d+/\\S+')), '.'), ')') AS doi, {_first_sql("j", "$.ISSN")} AS issn, {_dates_sql("j")} AS issued, array_to_string({_PEOPLE_SQL}, '; ') AS author, NULL::VARCHAR AS editor FROM p""",
)
def crossref_records(t):
    x = dealt(t("part"), "p_partkey").select("p_partkey", R.crossref(F.expr(_CROSSREF)).alias("x"))
    return x.select("p_partkey", *(f"x.{c}" for c in ("type", "title", "container", "publisher", "place", "page", "doi", "issn")), F.array_join("x.issued", "-").alias("issued"), _names(F.col("x.author")).alias("author"), _names(F.col("x.editor")).alias("editor"))


_OPENLIBRARY = """'{"title": "' || p_name || '", "subtitle": ' || CASE WHEN p_size % 2 = 0 THEN '" "' ELSE '"' || p_type || '"' END || ', "publishers": ["' || p_type || ' ", "", "' || p_brand || '"], "publish_places": ' || CASE WHEN p_size % 3 = 0 THEN '[]' ELSE '"Berlin "' END || ', "publish_date": "' || CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE 'May 3, ' || (1900 + p_size) END
 || '", "edition_name": " 2nd", "languages": [{"key": "/languages/eng"}], "authors": [{"key": "/authors/1"}, {"name": "' || p_brand || '"}]}'"""


@query(
    "S11",
    f"""WITH p AS (SELECT p_partkey, {_OPENLIBRARY} AS j FROM part), x AS (SELECT *, list_filter(list_transform(from_json(json_extract(j, '$.publishers'), '["VARCHAR"]'), lambda v: trim(v)), lambda v: v <> '') AS pubs FROM p)
    SELECT p_partkey, 'book' AS type, {_first_sql("j", "$.title")} AS title, {_first_sql("j", "$.subtitle")} AS subtitle, array_to_string(pubs, ' and ') AS publisher, CASE WHEN json_type(j, '$.publish_places') = 'ARRAY' THEN NULL ELSE trim(json_extract_string(j, '$.publish_places')) END AS place, nullif(regexp_extract(json_extract_string(j, '$.publish_date'), '\\d{{4}}'), '') AS issued, trim(json_extract_string(j, '$.edition_name')) AS edition, replace(json_extract_string(j, '$.languages[0].key'), '/languages/', '') AS language, json_extract_string(j, '$.authors[1].name') AS author FROM x""",
)
def openlibrary_records(t):
    x = dealt(t("part"), "p_partkey").select("p_partkey", R.openlibrary(F.expr(_OPENLIBRARY), F.lit("9780000000002")).alias("x"))
    return x.select("p_partkey", "x.type", "x.title", "x.subtitle", "x.publisher", "x.place", F.array_join("x.issued", "-").alias("issued"), "x.edition", "x.language", _names(F.col("x.author")).alias("author"))


_DATACITE = """'{"attributes": {"doi": "10.5072/D' || p_partkey || '", "titles": [{"lang": "en"}, {"title": "' || p_name || '"}], "publisher": "' || p_type || '", "publicationYear": ' || CASE WHEN p_size % 3 = 0 THEN '"n.d."' ELSE (1900 + p_size)::VARCHAR END || ', "types": {"resourceTypeGeneral": "' || CASE p_size % 4 WHEN 0 THEN 'Dataset' WHEN 1 THEN 'Text' WHEN 2 THEN 'Software' ELSE '' END || '", "resourceType": "' || CASE WHEN p_size % 2 = 0 THEN 'x' ELSE ' Thesis' END
 || '"}, "creators": [{"familyName": "' || p_brand || '", "givenName": "A"}, {"name": "Lab"}], "contributors": [{"contributorType": "Editor", "name": "Ed ' || p_size || '"}, {"contributorType": "Other", "name": "No"}]}}'"""
_OPENALEX = """'{"doi": "https://doi.org/10.5555/A' || p_partkey || '", "title": ' || CASE WHEN p_size % 2 = 0 THEN 'null' ELSE '"' || p_name || '"' END || ', "display_name": "' || p_type || '", "type": "' || CASE p_size % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'book-chapter' ELSE 'editorial' END || '", "authorships": [{"author": {"display_name": "' || p_brand || '"}}, {"author": null}], "primary_location": ' || CASE WHEN p_size % 5 = 0 THEN 'null' ELSE '{"source": {"display_name": "' || p_type || '", "issn": ["0000-000' || (p_size % 10) || '"]}}' END
 || ', "biblio": {"volume": "' || p_size || '", "first_page": "10", "last_page": "' || (10 + p_size % 3) || '"}, "publication_year": ' || (1950 + p_size) || '}'"""


@query(
    "S11",
    f"""WITH p AS (SELECT p_partkey, p_size, {_DATACITE} AS d, {_OPENALEX} AS a FROM part), x AS (SELECT *, json_extract_string(d, '$.attributes.types.resourceTypeGeneral') AS g, lower(trim(json_extract_string(d, '$.attributes.types.resourceType'))) AS s, json_extract_string(d, '$.attributes.publicationYear') AS y FROM p)
    SELECT p_partkey, CASE WHEN g IN ('Text', 'Other', '') AND s = 'thesis' THEN 'thesis' WHEN g = 'Dataset' THEN 'dataset' ELSE 'article' END AS data_type, json_extract_string(d, '$.attributes.titles[1].title') AS data_title, CASE WHEN regexp_full_match(y, '\\d{{4}}') THEN y END AS data_issued, lower(json_extract_string(d, '$.attributes.doi')) AS data_doi, json_extract_string(d, '$.attributes.creators[0].familyName') || ', A; Lab' AS data_author, json_extract_string(d, '$.attributes.contributors[0].name') AS data_editor,
    CASE json_extract_string(a, '$.type') WHEN 'article' THEN 'article-journal' WHEN 'book-chapter' THEN 'chapter' ELSE 'article' END AS open_type, coalesce(json_extract_string(a, '$.title'), json_extract_string(a, '$.display_name')) AS open_title, json_extract_string(a, '$.primary_location.source.display_name') AS open_container, json_extract_string(a, '$.primary_location.source.issn[0]') AS open_issn,
    json_extract_string(a, '$.biblio.first_page') || CASE WHEN json_extract_string(a, '$.biblio.last_page') <> json_extract_string(a, '$.biblio.first_page') THEN '-' || json_extract_string(a, '$.biblio.last_page') ELSE '' END AS open_page, json_extract_string(a, '$.publication_year') AS open_issued, json_extract_string(a, '$.authorships[0].author.display_name') AS open_author FROM x""",
)
def open_registries(t):
    sql = _DATACITE.replace("::VARCHAR", "::string")
    x = dealt(t("part"), "p_partkey").select("p_partkey", R.datacite(F.expr(sql)).alias("d"), R.openalex(F.expr(_OPENALEX)).alias("a"))
    return x.select(
        "p_partkey", F.col("d.type").alias("data_type"), F.col("d.title").alias("data_title"), F.array_join("d.issued", "-").alias("data_issued"), F.col("d.doi").alias("data_doi"), _names(F.col("d.author")).alias("data_author"), _names(F.col("d.editor")).alias("data_editor"),
        F.col("a.type").alias("open_type"), F.col("a.title").alias("open_title"), F.col("a.container").alias("open_container"), F.col("a.issn").alias("open_issn"), F.col("a.page").alias("open_page"), F.array_join("a.issued", "-").alias("open_issued"), _names(F.col("a.author")).alias("open_author"),
    )
