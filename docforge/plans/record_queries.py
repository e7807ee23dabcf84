"""Queries over records, events and scores, with the SQL that gives the same rows.

Parts and orders play the part of records, events that of segments and attempts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import ident as I
from docforge.functions import python
from docforge.functions import text as T
from docforge.operators import evidence, incremental, library, match, score, sequential, structure
from docforge.plans.document_queries import q
from docforge.plans.registry import query

_SEG = "seg AS (SELECT user_id, event_id, event_id * 600 AS at_s, value, event_type FROM events)"


def _segments(t):
    return t("events").select("user_id", "event_id", (F.col("event_id") * 600).alias("at"), "value", "event_type")


@query(
    "W07",
    """WITH b AS (SELECT user_id, value AS x0, value + 5 AS x1, max(value + 5) OVER (PARTITION BY user_id ORDER BY value, value + 5 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM events),
    c AS (SELECT *, sum(CASE WHEN x0 - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS column_no FROM b)
    SELECT user_id, column_no::BIGINT AS column_no, count(*) AS n, min(x0) AS x0, max(x1) AS x1 FROM c GROUP BY user_id, column_no""",
)
def column_islands(t):
    return structure.columns_of(t("events").select("user_id", F.col("value").alias("x0"), (F.col("value") + 5).alias("x1")), "user_id", "x0", "x1", 10)


_IDX = "i AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS idx FROM events)"


def _indexed(t):
    return t("events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("idx"))


@query(
    "A04 J12",
    f"""WITH {_IDX}, v AS (SELECT user_id, idx + event_id % 3 - idx AS "offset", count(*) AS votes, min(idx) AS f FROM i GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS r FROM (SELECT user_id, "offset", sum(votes) AS votes, min(f) AS f FROM (SELECT user_id, event_id % 3 AS "offset", count(*) AS votes, min(idx) AS f FROM i GROUP BY ALL) GROUP BY ALL))
    SELECT user_id, "offset", votes::BIGINT AS votes FROM r WHERE r = 1""",
)
def offset_vote(t):
    return structure.offset_vote(_indexed(t).withColumn("candidate", F.col("idx") + F.col("event_id") % 3), "user_id")


@query(
    "W11",
    f"""WITH {_IDX}, b AS (SELECT user_id, idx, CASE WHEN event_id % 4 = 0 THEN 10 + event_id % 7 END AS base FROM i)
    SELECT user_id, idx, idx + coalesce(last_value(base IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(base IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS number FROM b""",
)
def fill_page_numbers(t):
    return structure.filled_numbers(_indexed(t).withColumn("number", F.when(F.col("event_id") % 4 == 0, F.col("idx") + 10 + F.col("event_id") % 7)), "user_id")


@query(
    "J02",
    f"""WITH {_SEG}, turns AS (SELECT user_id, event_id AS interval_id, at_s AS start_s, at_s + 200000 AS stop_s FROM seg WHERE event_type = 'purchase'),
    k AS (SELECT s.user_id, s.event_id AS point_id, interval_id, row_number() OVER (PARTITION BY s.user_id, s.event_id ORDER BY start_s, interval_id) AS r FROM seg s JOIN turns u ON s.user_id = u.user_id AND s.at_s BETWEEN start_s AND stop_s)
    SELECT user_id, point_id, interval_id FROM k WHERE r = 1""",
)
def speaker_lookup(t):
    s = _segments(t)
    turns = s.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("interval_id"), F.col("at").alias("start"), (F.col("at") + 200_000).alias("stop"))
    return structure.first_interval(s.select("user_id", F.col("event_id").alias("point_id"), "at"), turns, "user_id")


@query("F09", f"WITH {_SEG} SELECT event_id, at_s AS start_s, at_s + floor(value)::BIGINT AS end_s FROM seg WHERE floor(value) > 0 AND value < 400 AND event_type <> 'error'")
def valid_segments(t):
    s = _segments(t).where((F.floor("value") > 0) & (F.col("value") < 400) & (F.col("event_type") != "error"))
    return s.select("event_id", F.col("at").alias("start_s"), (F.col("at") + F.floor("value")).alias("end_s"))


@query("W09", "WITH p AS (SELECT DISTINCT user_id, event_id FROM events), c AS (SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) > 200 THEN 1 ELSE 0 END AS cut FROM p), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r WHERE run = 0 GROUP BY user_id")
def front_run(t):
    return structure.title_runs(t("events").select("user_id", "event_id").distinct(), "user_id", "event_id", 200)


_ATT = "att AS (SELECT user_id AS id, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value AS seconds FROM events), last_att AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY attempt DESC) AS r FROM att) WHERE r = 1)"


def _attempts(t):
    return t("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("seconds"))


@query("W02 K06", f"WITH {_ATT} SELECT id, attempt, status, seconds FROM last_att")
def latest_attempt(t):
    return score.latest(_attempts(t), "id", ["attempt"])


@query("F15 Z03", f"WITH {_ATT} SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM last_att WHERE status = 'ok')")
def pending(t):
    return score.pending(t("customer").select(F.col("c_custkey").alias("id")), score.latest(_attempts(t), "id", ["attempt"]), "id")


@query("A17", f"WITH {_ATT} SELECT status, count(*) AS n, round(count(*) / (SELECT count(*) FROM att), 6) AS share, round(sum(seconds), 4) AS seconds FROM att GROUP BY status")
def status_counts(t):
    a = _attempts(t)
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy(F.lit(1)))
    return a.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / total, 6).alias("share"), F.round(F.sum("seconds"), 4).alias("seconds"))


@query("Z02", "WITH c AS (SELECT event_id AS key, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'missing' ELSE 'ok' END AS status, 1704067200 + event_id * 60 AS stored_at FROM events) SELECT key, status, stored_at + CASE WHEN status = 'ok' THEN 604800 ELSE 3600 END AS expires_at FROM c WHERE status <> 'error' AND stored_at + CASE WHEN status = 'ok' THEN 604800 ELSE 3600 END > 1704672000")
def ttl_cache(t):
    c = t("events").select(F.col("event_id").alias("key"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "missing").otherwise("ok").alias("status"), (F.col("event_id") * 60 + 1_704_067_200).alias("stored_at"))
    return incremental.usable(c, F.lit(1_704_672_000)).select("key", "status", "expires_at")


_SNAP = "new AS (SELECT url, sha256(html) AS hash FROM pages), old AS (SELECT url, CASE WHEN page_id % 5 = 0 THEN sha256(url) ELSE sha256(html) END AS stored FROM pages WHERE page_id % 3 <> 0)"


@query("Z01 J13", f"WITH {_SNAP} SELECT new.url, hash, CASE WHEN stored IS NULL THEN 'ingested' WHEN stored = hash THEN 'unchanged' ELSE 'updated' END AS state FROM new LEFT JOIN old ON new.url = old.url")
def change_detect(t):
    p = t("pages")
    stored = p.where("page_id % 3 <> 0").select("url", F.when(F.col("page_id") % 5 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("hash"))
    return incremental.changes(p.select("url", F.sha2("html", 256).alias("hash")), stored)


_GOLD = r"""pairs AS (SELECT l.doc_id, d.lang, d.source, 'quality' AS field, quality AS gold, CASE WHEN regexp_matches(text, '!!|\|') THEN 0 ELSE 1 END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id
UNION ALL SELECT l.doc_id, d.lang, d.source, 'toxic', toxic, CASE WHEN n_chars > 5000 THEN NULL WHEN regexp_matches(text, '(?i)idiot|moron|trash|stupid') THEN 1 ELSE 0 END FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
_COUNTS = "count(*) AS n, count(*) FILTER (gold IS NOT NULL AND predicted IS NOT NULL AND gold = predicted) AS tp, count(*) FILTER (predicted IS NOT NULL AND (gold IS NULL OR gold <> predicted)) AS fp, count(*) FILTER (gold IS NOT NULL AND (predicted IS NULL OR gold <> predicted)) AS fn"


def _pairs(t):
    j = t("labels").join(t("documents"), "doc_id")
    quality = F.when(F.col("text").rlike(r"!!|\|"), 0).otherwise(1)
    toxic = F.when(F.col("n_chars") > 5000, None).when(F.col("text").rlike("(?i)idiot|moron|trash|stupid"), 1).otherwise(0)
    one = lambda name, p: j.select("doc_id", "lang", "source", F.lit(name).alias("field"), F.col(name).alias("gold"), p.alias("predicted"))
    return one("quality", quality).unionByName(one("toxic", toxic))


def _wilson_sql(k: str, n: str) -> tuple[str, str]:
    z = "1.959963984540054"
    centre, half = f"(({k}) / ({n}) + {z} * {z} / (2 * ({n}))) / (1 + {z} * {z} / ({n}))", f"{z} * sqrt(({k}) / ({n}) * (1 - ({k}) / ({n})) / ({n}) + {z} * {z} / (4 * ({n}) * ({n}))) / (1 + {z} * {z} / ({n}))"
    return f"CASE WHEN {k} <= 0 THEN 0.0 ELSE greatest(0.0, {centre} - {half}) END", f"CASE WHEN {k} >= {n} THEN 1.0 ELSE least(1.0, {centre} + {half}) END"


_LOW, _HIGH = _wilson_sql("tp", "(tp + fn)")


@query("J06 A05 A06 X21", f"WITH {_GOLD}, c AS (SELECT field, {_COUNTS} FROM pairs GROUP BY field) SELECT field, n, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM c")
def score_fields(t):
    c = score.field_counts(_pairs(t), ["field"])
    low, high = score.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    r = lambda x, n: F.round(x, 6).alias(n)
    return c.select("field", "n", "tp", "fp", "fn", r(F.col("precision"), "precision"), r(F.col("recall"), "recall"), r(F.col("f1"), "f1"), r(low, "low"), r(high, "high"))


@query("A09 A08", f"WITH {_GOLD} SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, {_COUNTS} FROM pairs GROUP BY GROUPING SETS ((lang), (source), ())")
def score_by_facet(t):
    hit = F.col("gold").isNotNull() & F.col("predicted").isNotNull() & (F.col("gold") == F.col("predicted"))
    sets = _pairs(t).groupingSets([["lang"], ["source"], []], "lang", "source")
    c = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("tp"), F.count_if(~hit & F.col("predicted").isNotNull()).alias("fp"), F.count_if(~hit & F.col("gold").isNotNull()).alias("fn"))
    return c.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "tp", "fp", "fn")


_TWO = r"a AS (SELECT doc_id AS id, lang AS v FROM documents WHERE n_chars > 200), b AS (SELECT doc_id AS id, CASE WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(der|die|und)(?:$|[^\p{L}\p{N}_])') THEN 'de' WHEN regexp_matches(text, '(?i)(?:^|[^\p{L}\p{N}_])(the|and|of)(?:$|[^\p{L}\p{N}_])') THEN 'en' ELSE 'fr' END AS v FROM documents WHERE n_chars < 4000)"


def _two(t):
    d = t("documents")
    guess = F.when(F.col("text").rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(der|die|und)(?:$|[^\p{L}\p{N}_])"), "de").when(F.col("text").rlike(r"(?i)(?:^|[^\p{L}\p{N}_])(the|and|of)(?:$|[^\p{L}\p{N}_])"), "en").otherwise("fr")
    return d.where("n_chars > 200").select(F.col("doc_id").alias("id"), F.col("lang").alias("v")), d.where("n_chars < 4000").select(F.col("doc_id").alias("id"), guess.alias("v"))


@query("J07 U02", f"WITH {_TWO} SELECT count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS n_both, count(*) FILTER (b.v IS NULL) AS a_only, count(*) FILTER (a.v IS NULL) AS b_only, count(*) FILTER (a.v = b.v) AS n_agree FROM a FULL JOIN b ON a.id = b.id")
def oracle_audit(t):
    return score.presence_split(*_two(t), "id", "v")


@query("J08", f"WITH {_TWO} SELECT coalesce(a.id, b.id) AS id, a.v AS first, b.v AS second, coalesce(a.v = b.v, false) AS agreed FROM a FULL JOIN b ON a.id = b.id")
def adjudicate(t):
    a, b = _two(t)
    j = a.withColumnRenamed("v", "first").join(b.withColumnRenamed("v", "second"), "id", "full")
    return j.select("id", "first", "second", F.coalesce(F.col("first") == F.col("second"), F.lit(False)).alias("agreed"))


_CER = rf"pairs AS (SELECT conv_id * 1000 + turn AS id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS gold, trim(regexp_replace(lower(text), {q(T.NOT_WORD_OR_LOW_LINE)}, ' ', 'g')) AS pred FROM conversations)"


def _texts(t):
    return t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.squeezed(F.col("text")).alias("gold"), T.plain(F.col("text")).alias("pred"))


@query("X20 H19 J15", f"WITH {_CER} SELECT id, length(gold)::BIGINT AS gold_chars, levenshtein(gold, pred)::BIGINT AS edits, round(levenshtein(gold, pred) / length(gold), 6) AS cer FROM pairs WHERE gold <> ''")
def cer(t):
    return score.error_rates(_texts(t).where("gold <> ''")).select("id", "gold_chars", "edits", F.round("cer", 6).alias("cer"))


@query("A07", f"WITH {_CER}, r AS (SELECT length(gold) AS g, levenshtein(gold, pred) AS e FROM pairs WHERE gold <> '') SELECT count(*) AS n, round(avg(e / g), 6) AS mean_cer, round(median(e / g), 6) AS median_cer, round(sum(e) / sum(g), 6) AS weighted_cer, count(*) FILTER (e / g <= 0.10) AS n_passed FROM r")
def cer_summary(t):
    s = score.error_summary(score.error_rates(_texts(t).where("gold <> ''")))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean_cer", "median_cer", "weighted_cer")], "n_passed")


@query("A10", "WITH v AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT event_type, v[round_even((len(v) - 1) * 0.5, 0)::BIGINT + 1] AS p50, v[round_even((len(v) - 1) * 0.95, 0)::BIGINT + 1] AS p95 FROM v")
def latency_pctl(t):
    return score.percentiles(t("events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query(
    "E11 T06 J18 X19",
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), a AS (SELECT name AS entity, name || ' co' AS label, split_part(name, ' ', 2) AS k FROM n),
    s AS (SELECT x.name, a.entity, 0.85 * (1 - levenshtein(x.name, a.label) / greatest(length(x.name), length(a.label))) + 0.15 * CASE WHEN split_part(x.name, ' ', 1) = split_part(a.entity, ' ', 1) THEN 1 ELSE 0 END AS score FROM n x JOIN a ON split_part(x.name, ' ', 2) = a.k),
    r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, entity) AS r, lead(score) OVER (PARTITION BY name ORDER BY score DESC, entity) AS second FROM s)
    SELECT name, CASE WHEN score >= 0.80 AND (second IS NULL OR round(score - second, 9) >= 0.05) THEN entity END AS entity, round(score, 6) AS score, CASE WHEN score < 0.80 THEN 'below_threshold' WHEN second IS NOT NULL AND round(score - second, 9) < 0.05 THEN 'ambiguous_identity' ELSE 'linked' END AS decision FROM r WHERE r = 1""",
)
def authority_match(t):
    n = t("part").select(F.col("p_name").alias("name")).distinct()
    word = lambda c, i: F.split(c, " ")[i]
    a = n.select(F.col("name").alias("entity"), F.concat("name", F.lit(" co")).alias("label"), word(F.col("name"), 1).alias("k"))
    j = n.withColumn("k", word(F.col("name"), 1)).join(a, "k")
    anchor = F.when(word(F.col("name"), 0) == word(F.col("entity"), 0), 1).otherwise(0)
    scored = j.select("name", "entity", match.entity_score("place", match.edit_similarity(F.col("name"), F.col("label")), anchor).alias("score"))
    return match.top_with_margin(scored, "name", "entity", "score", match.THRESHOLDS["place"]).withColumn("score", F.round("score", 6))


@query(
    "V02",
    """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label AS k, i, avg(x) AS y FROM e GROUP BY label, i),
    s AS (SELECT vec_id, k, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS score FROM e JOIN c ON e.i = c.i GROUP BY vec_id, k), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS r, lead(score) OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS second FROM s)
    SELECT vec_id, CASE WHEN score >= 0.2 AND round(score - second, 9) >= 0.05 THEN k END AS k, round(score, 6) AS score, CASE WHEN score < 0.2 THEN 'below_threshold' WHEN round(score - second, 9) < 0.05 THEN 'ambiguous_identity' ELSE 'linked' END AS decision FROM r WHERE r = 1""",
)
def cosine_top1(t):
    e = t("embeddings")
    x = e.select("label", F.posexplode("embedding").alias("i", "x"))
    mean = x.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("y"))
    centroids = mean.groupBy(F.col("label").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "y"))), lambda p: p.y).alias("c"))
    scored = match.against_few(e.select("vec_id", "embedding"), centroids, "k", "c", lambda row, few: match.cosine(row, few), "embedding")
    return match.top_with_margin(scored, "vec_id", "k", "score", 0.2).withColumn("score", F.round("score", 6))


_ISBN = "lpad(((p_partkey * 7919 + p_size * 104729) % 10000000000)::VARCHAR, 10, '0')"


@query(
    "X04",
    f"""WITH s AS (SELECT p_partkey, '978' || {_ISBN} AS d13, {_ISBN} AS d10 FROM part)
    SELECT p_partkey, list_sum(list_transform(range(1, 14), lambda i: substr(d13, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10 = 0 AS valid13, list_sum(list_transform(range(1, 11), lambda i: substr(d10, i, 1)::INT * (11 - i))) % 11 = 0 AS valid10,
    '978' || substr(d10, 1, 9) || ((10 - list_sum(list_transform(range(1, 13), lambda i: substr('978' || d10, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) % 10)::INT AS upgraded FROM s""",
)
def isbn_check(t):
    digits = F.lpad(((F.col("p_partkey") * 7919 + F.col("p_size") * 104729) % 10_000_000_000).cast("string"), 10, "0")
    core = F.concat(F.lit("978"), F.substring("d10", 1, 9))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(core, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    s = t("part").select("p_partkey", digits.alias("d10"))
    return s.select("p_partkey", I.isbn13_valid(F.concat(F.lit("978"), "d10")).alias("valid13"), I.isbn10_valid(F.col("d10")).alias("valid10"), F.concat(core, ((F.lit(10) - total % 10) % 10).cast("string")).alias("upgraded"))


@query(
    "X03 X05",
    r"""WITH s AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'https://doi.org/10.' ELSE 'doi: 10.' END || (1000 + p_size) || '/Part(' || p_partkey || CASE p_size % 2 WHEN 0 THEN ')).' ELSE '),' END AS raw FROM part),
    f AS (SELECT p_partkey, regexp_replace(regexp_extract(regexp_replace(raw, '(?i)^(?:doi\s*:\s*|https?://(?:dx\.)?doi\.org/)', ''), '(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+', 0), '[.,;:!?]+$', '') AS d FROM s)
    SELECT p_partkey, lower(CASE WHEN length(replace(d, '(', '')) > length(replace(d, ')', '')) THEN substr(d, 1, length(d) - (length(replace(d, '(', '')) - length(replace(d, ')', '')))) ELSE d END) AS doi FROM f""",
)
def doi_norm(t):
    raw = F.concat(F.when(F.col("p_size") % 3 == 0, "https://doi.org/10.").otherwise("doi: 10."), F.col("p_size") + 1000, F.lit("/Part("), "p_partkey", F.when(F.col("p_size") % 2 == 0, ")).").otherwise("),"))
    return t("part").select("p_partkey", I.doi(raw).alias("doi"))


@query("X06", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE NULL END AS title, CASE WHEN p_size % 2 = 0 THEN p_type ELSE NULL END AS subtitle, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_size % 3 = 0 THEN p_brand END AS place, CASE WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 3 = 0 THEN p_name || ' Press' END AS publisher FROM part")
def title_split(t):
    even, third = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    title = F.when(even, F.concat("p_name", F.lit(": "), "p_type")).otherwise(F.concat("p_name", F.lit(":"), "p_type"))
    imprint = F.when(even, F.concat("p_brand", F.lit(" : "), "p_name")).when(third, F.concat("p_brand", F.lit(", "), "p_name", F.lit(" Press"))).otherwise(F.concat("p_brand", F.lit(", "), "p_name"))
    a, b = I.split_title(title)
    c, d = I.split_publisher(imprint)
    return t("part").select("p_partkey", a.alias("title"), b.alias("subtitle"), c.alias("place"), d.alias("publisher"))


@query("X30 X31", "SELECT o_orderkey, year(o_orderdate) || CASE WHEN o_orderkey % 6 = 5 THEN '' ELSE '-' || month(o_orderdate) END || CASE WHEN o_orderkey % 6 >= 4 THEN '' ELSE '-' || day(o_orderdate) END AS parts FROM orders")
def date_parts(t):
    d = F.col("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, "January February March April May June July August September October November December".split())), F.month(d))
    forms = [F.concat_ws("-", F.year(d), F.lpad(F.month(d).cast("string"), 2, "0"), F.lpad(F.day(d).cast("string"), 2, "0")), F.concat(month, F.lit(" "), F.day(d), F.lit(", "), F.year(d)), F.concat(F.day(d), F.lit(" "), month, F.lit(" "), F.year(d)), F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.day(d), F.lit("日")), F.concat(month, F.lit(" "), F.year(d)), F.concat(F.lit("c. "), F.year(d))]
    text = forms[5]
    for i in range(5):
        text = F.when(F.col("o_orderkey") % 6 == i, forms[i]).otherwise(text)
    return t("orders").select("o_orderkey", I.date_parts(text).alias("parts"))


@query("J16 U05", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ' ') AS tokens, true AS same, split_part(p_name, ' ', 1) = split_part(p_name, ' ', 2) AS given_agrees FROM part")
def name_match(t):
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    turned = F.concat(last, F.lit(", "), F.upper(first))
    return t("part").select("p_partkey", F.array_join(match.name_tokens(F.col("p_name")), " ").alias("tokens"), match.same_names(F.array("p_name"), F.array(turned)).alias("same"), match.given_agrees(first, last).alias("given_agrees"))


@query(
    "E10 E09 X51",
    """WITH r AS (SELECT p_partkey AS record_id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS value, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS c1, p_name AS c2 FROM part)
    SELECT record_id, 'title' AS field, coalesce(value, c1, c2) AS value, CASE WHEN value IS NULL THEN CASE WHEN c1 IS NOT NULL THEN 'first' ELSE 'second' END END AS provider, CASE WHEN value IS NULL THEN 'filled' WHEN lower(value) = lower(coalesce(c1, c2)) THEN 'kept' ELSE 'conflict' END AS action FROM r""",
)
def field_fill(t):
    p = t("part").withColumnRenamed("p_partkey", "record_id").withColumn("field", F.lit("title"))
    records = p.select("record_id", "field", F.when(F.col("p_size") % 3 == 0, None).otherwise(F.col("p_name")).alias("value"))
    one = p.select("record_id", "field", F.lit("first").alias("provider"), F.lit(1).alias("priority"), F.when(F.col("p_size") % 4 == 0, None).otherwise(F.col("p_brand")).alias("candidate"))
    two = p.select("record_id", "field", F.lit("second").alias("provider"), F.lit(2).alias("priority"), F.col("p_name").alias("candidate"))
    return evidence.filled(records, one.unionByName(two))


@query(
    "E03 E16",
    """WITH c AS (SELECT l_orderkey AS record_id, l_linenumber::BIGINT AS field, l_returnflag AS old, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS new, l_quantity > 10 AS supported FROM lineitem), k AS (SELECT *, new IS NOT NULL AND lower(old) <> lower(new) AND NOT supported AS conflict FROM c), v AS (SELECT *, bool_or(conflict) OVER (PARTITION BY record_id) AS void FROM k)
    SELECT record_id, field, CASE WHEN NOT void AND new IS NOT NULL AND supported THEN new ELSE old END AS value, CASE WHEN conflict THEN 'conflicting' WHEN supported AND new IS NOT NULL THEN 'source-supported' ELSE 'unverified' END AS state, void FROM v""",
)
def conflict_void(t):
    c = t("lineitem").select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").cast("long").alias("field"), F.col("l_returnflag").alias("old"), F.when(F.col("l_linestatus") == "O", None).otherwise(F.col("l_linestatus")).alias("new"), (F.col("l_quantity") > 10).alias("supported"))
    return evidence.merged_without_conflict(c)


_LADDER = """e AS (SELECT user_id AS record_id, 'f' || event_id AS field, event_type, CASE event_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'publisher' ELSE 'page' END AS kind, CASE event_id % 5 WHEN 0 THEN 'title' WHEN 1 THEN 'imprint' WHEN 2 THEN 'running_head' ELSE 'body' END AS zone, CASE event_type WHEN 'click' THEN 'exact' WHEN 'view' THEN 'normalised' WHEN 'signup' THEN 'joined' ELSE 'weak_marker' END AS reason FROM events),
s AS (SELECT *, CASE WHEN zone IN ('running_head', 'contents') THEN 0.60 WHEN reason = 'weak_marker' THEN 0.50 WHEN reason = 'exact' AND CASE kind WHEN 'title' THEN zone IN ('title', 'cover', 'statement_of_responsibility') WHEN 'publisher' THEN zone IN ('imprint', 'copyright', 'cip') ELSE true END THEN 0.95 WHEN reason = 'exact' THEN 0.80 WHEN reason = 'normalised' THEN 0.90 ELSE 0.85 END::DOUBLE AS confidence FROM e)"""


def _ladder(t):
    pick = lambda c, m, other: F.coalesce(*(F.when(c == k, v) for k, v in m.items()), F.lit(other))
    kind = pick(F.col("event_id") % 3, {0: "title", 1: "publisher"}, "page")
    zone = pick(F.col("event_id") % 5, {0: "title", 1: "imprint", 2: "running_head"}, "body")
    reason = pick(F.col("event_type"), {"click": "exact", "view": "normalised", "signup": "joined"}, "weak_marker")
    return t("events").select(F.col("user_id").alias("record_id"), F.concat(F.lit("f"), "event_id").alias("field"), "event_type", evidence.confidence(reason, kind, zone).alias("confidence"))


@query("A20 X41 T08 H14", f"WITH {_LADDER}, u AS (SELECT record_id, field, confidence FROM s WHERE event_type <> 'error' AND confidence < 0.8 UNION ALL SELECT record_id, field, 0.0 FROM s WHERE event_type = 'error') SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY confidence, field) AS place FROM u")
def review_queue(t):
    s = _ladder(t)
    return evidence.review_queue(s.where("event_type <> 'error'"), s.where("event_type = 'error'"))


@query("J09", "WITH a AS (SELECT user_id AS doc_id, event_id // 400 AS page, event_type AS quote, CASE WHEN event_id % 2 = 0 THEN 'b' || event_id END AS block_id, CASE WHEN event_id % 2 = 1 THEN event_id END AS bbox FROM events), w AS (SELECT *, count(*) OVER p = 2 AND count(block_id) OVER p = 1 AS pair, max(block_id) OVER p AS b, max(bbox) OVER p AS x FROM a WINDOW p AS (PARTITION BY doc_id, page, quote)) SELECT doc_id, page, quote, CASE WHEN pair THEN b ELSE block_id END AS block_id, CASE WHEN pair THEN x ELSE bbox END AS bbox FROM w WHERE NOT pair OR block_id IS NOT NULL")
def paired_anchors(t):
    a = t("events").select(F.col("user_id").alias("doc_id"), F.expr("event_id div 400").alias("page"), F.col("event_type").alias("quote"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("b"), "event_id")).alias("block_id"), F.when(F.col("event_id") % 2 == 1, F.col("event_id")).alias("bbox"))
    return evidence.paired_anchors(a)


@query("T09", "WITH f AS (SELECT user_id, floor(value)::BIGINT AS identity, min(event_id) AS ord FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord, identity) AS place FROM f) SELECT * FROM r WHERE place <= 5")
def first_identities(t):
    return library.distinct_identities(t("events").select("user_id", F.floor("value").alias("identity"), F.col("event_id").alias("ord")), "user_id", "identity", "ord")


@query("T07", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', floor(value / 250), value, event_id) AS place FROM events")
def reading_order(t):
    w = Window.partitionBy("user_id").orderBy(F.col("event_type") == "error", F.floor(F.col("value") / 250), "value", "event_id")
    return t("events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place"))


@query("X32", "WITH s AS (SELECT event_id, floor(value * 20)::BIGINT AS s FROM events) SELECT event_id, CASE WHEN s >= 3600 THEN lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') ELSE lpad((s // 60)::VARCHAR, 2, '0') END || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS label FROM s")
def time_labels(t):
    return t("events").select("event_id", T.timestamp_label(F.col("value") * 20).alias("label"))


@query("X50 S21 G07", "WITH s AS (SELECT p_partkey, 1 + p_size % 5 AS a, 3 + p_size % 11 AS b, 20 + p_size AS n, 1 + p_size % 4 AS k FROM part), p AS (SELECT DISTINCT p_partkey, unnest(list_concat(range(a, least(b, n) + 1), range(greatest(1, n - k + 1), n + 1))) AS page FROM s) SELECT p_partkey, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM p GROUP BY p_partkey")
def page_ranges(t):
    a, b, n, k = (F.lit(1) + F.col("p_size") % 5, F.lit(3) + F.col("p_size") % 11, F.lit(20) + F.col("p_size"), F.lit(1) + F.col("p_size") % 4)
    spec = F.concat(a, F.lit("-"), b, F.lit(", -"), k)
    return t("part").select("p_partkey", F.array_join(I.page_list(spec, n), ",").alias("pages")).where("pages <> ''")


@query("X09", "SELECT p_partkey, (1900 + p_size)::BIGINT AS year FROM part")
def roman_years(t):
    n = F.col("p_size")
    tens = F.element_at(F.array(*map(F.lit, ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"])), (F.floor(n / 10) + 1).cast("int"))
    ones = F.element_at(F.array(*map(F.lit, ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"])), (n % 10 + 1).cast("int"))
    return t("part").select("p_partkey", I.roman_value(F.concat(F.lit("mcm"), tens, ones)).alias("year"))


@query("X14 T10", "SELECT p_partkey, CASE p_size % 4 WHEN 3 THEN NULL ELSE p_size END::BIGINT AS page FROM part")
def page_numbers(t):
    n = F.col("p_size")
    text = F.when(n % 4 == 0, F.concat(F.lit("- "), n, F.lit(" -"))).when(n % 4 == 1, F.concat(F.lit("Page "), n)).when(n % 4 == 2, F.concat(F.lit("  "), n, F.lit(" "))).otherwise(F.lit("no number"))
    return t("part").select("p_partkey", I.page_candidates(text).alias("page"))


@query("K07 K08 H09", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Unknown' ELSE p_brand END || '. *' || p_name || ': ' || p_type || '*. ' || CASE WHEN p_size % 3 = 0 THEN 'n.d.' ELSE (1900 + p_size)::VARCHAR END || '.' AS citation FROM part")
def citations(t):
    none = F.lit(None).cast("string")
    author = F.when(F.col("p_size") % 2 == 0, none).otherwise(F.col("p_brand"))
    year = F.when(F.col("p_size") % 3 == 0, none).otherwise((F.col("p_size") + 1900).cast("string"))
    return t("part").select("p_partkey", library.citation(author, F.concat("p_name", F.lit(": "), "p_type"), none, none, none, year, none).alias("citation"))


@query("X64", "SELECT event_id, regexp_extract('log line ' || props, '(\\{.*\\})\\s*$', 1) AS tail, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_tail(t):
    tail = F.regexp_extract(F.concat(F.lit("log line "), "props"), r"(\{.*\})\s*$", 1)
    return t("events").select("event_id", tail.alias("tail"), F.get_json_object(tail, "$.k").cast("long").alias("k"))


@query("G09", "SELECT p_brand, p_name, 'part-' || lpad((row_number() OVER (PARTITION BY p_brand ORDER BY p_name))::VARCHAR, 4, '0') AS id FROM (SELECT DISTINCT p_brand, p_name FROM part)")
def sequential_ids(t):
    w = Window.partitionBy("p_brand").orderBy("p_name")
    return t("part").select("p_brand", "p_name").distinct().select("p_brand", "p_name", F.concat(F.lit("part-"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("id"))


@query("F12", "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS n_types, count(DISTINCT p_type) > 1 AS leaks, count(*) <> count(DISTINCT p_partkey) AS repeats FROM part GROUP BY p_brand")
def manifest_checks(t):
    return t("part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("n_types"), (F.countDistinct("p_type") > 1).alias("leaks"), (F.count(F.lit(1)) != F.countDistinct("p_partkey")).alias("repeats"))


@query("A14 H15", "WITH m AS (SELECT event_id, user_id, value, median(value) OVER (PARTITION BY user_id) AS mid FROM events) SELECT event_id, CASE WHEN value / mid < 0.93 THEN 'small' WHEN value / mid > 1.15 THEN 'large' ELSE 'medium' END AS size FROM m WHERE mid <> 0")
def font_sizes(t):
    mid = t("events").groupBy("user_id").agg(F.median("value").alias("mid"))
    r = F.col("value") / F.col("mid")
    return t("events").join(mid, "user_id").where("mid <> 0").select("event_id", F.when(r < 0.93, "small").when(r > 1.15, "large").otherwise("medium").alias("size"))


@query("W13", "WITH p AS (SELECT user_id, min(event_id) FILTER (event_type = 'click') AS a, max(event_id) FILTER (event_type = 'click') AS b, min(event_id) FILTER (event_type = 'view') AS c, max(event_id) FILTER (event_type = 'view') AS d FROM events GROUP BY user_id) SELECT user_id, CASE WHEN c - b > 0 AND c - b <= greatest(20, 10) THEN a ELSE CASE WHEN d - c >= b - a THEN c ELSE a END END AS first, CASE WHEN c - b > 0 AND c - b <= greatest(20, 10) THEN d ELSE CASE WHEN d - c >= b - a THEN d ELSE b END END AS last FROM p WHERE a IS NOT NULL AND c IS NOT NULL")
def joined_runs(t):
    ends = lambda kind, f: f(F.when(F.col("event_type") == kind, F.col("event_id")))
    p = t("events").groupBy("user_id").agg(ends("click", F.min).alias("a"), ends("click", F.max).alias("b"), ends("view", F.min).alias("c"), ends("view", F.max).alias("d")).where("a is not null and c is not null")
    near, tail = (F.col("c") - F.col("b")).between(1, 20), F.col("d") - F.col("c") >= F.col("b") - F.col("a")
    return p.select("user_id", F.when(near, F.col("a")).when(tail, F.col("c")).otherwise(F.col("a")).alias("first"), F.when(near | tail, F.col("d")).otherwise(F.col("b")).alias("last"))


@query("W06")
def asr_chunks(t):
    return structure.folded_chunks(_segments(t), "user_id", "event_id", "at", 86_400)


@query("W14")
def strata_split(t):
    return sequential.split_groups(t("part").select(F.col("p_brand").alias("stratum"), F.col("p_name").alias("family"), F.col("p_partkey").alias("id")))


@query("Z01", f"WITH {_SNAP}, v AS (SELECT url, 1 AS version, stored AS hash FROM old UNION ALL SELECT url, 2, hash FROM new), k AS (SELECT *, lag(hash) OVER (PARTITION BY url ORDER BY version) AS last FROM v) SELECT url, version::BIGINT AS version, hash, CASE WHEN last IS NULL THEN 'ingested' WHEN last = hash THEN 'unchanged' ELSE 'updated' END AS state FROM k")
def stream_change(t):
    from docforge.plans.tables import new_path
    from docforge.streaming import changes

    p = t("pages")
    old = p.where("page_id % 3 <> 0").select("url", F.lit(1).cast("long").alias("version"), F.when(F.col("page_id") % 5 == 0, F.sha2("url", 256)).otherwise(F.sha2("html", 256)).alias("hash"))
    both = old.unionByName(p.select("url", F.lit(2).cast("long").alias("version"), F.sha2("html", 256).alias("hash")))
    folder = new_path(p.sparkSession, "snapshots")
    both.write.parquet(folder)
    return changes.detect_available(p.sparkSession, folder, "url string, version bigint, hash string")


@query("X19 X21")
def sequence_match(t):
    n = t("part").select(F.col("p_name").alias("name")).distinct()
    a = n.select(F.col("name").alias("other"), F.split("name", " ")[1].alias("k"))
    return n.withColumn("k", F.split("name", " ")[1]).join(a, "k").select("name", "other", F.round(python.sequence_ratio("name", "other"), 6).alias("ratio"))


@query("X17 U05 H18")
def folded_names(t):
    return t("conversations").select("conv_id", "turn", python.folded("text").alias("folded"), python.nfkc("text").alias("nfkc"))
