"""The registered queries of this sub-package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docforge.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import search

    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0"), k=10).withColumn("score", F.round("score", 6))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import substring_dedup

    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents"), with_kept=False)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import language_model

    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from docforge.llm import token_counts

    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import near_dup

    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import decontaminate

    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docforge.llm import warc

    root, _ = warc.write_warc(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_warc(spark, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def queries() -> dict[str, Query]:
    return {
        "op1_bpe": op1_bpe,
        "op2_search": op2_search,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_language_model": op4_language_model,
        "op5_html_text": op5_html_text,
        "op6_toxicity": op6_toxicity,
        "op7_token_counts": op7_token_counts,
        "op8_near_dup": op8_near_dup,
        "op9_decontaminate": op9_decontaminate,
        "op10_warc": op10_warc,
    }


_WORDS = r"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents)"""
_ITEMS = _WORDS.replace("w AS", "v AS").replace("doc_id", "item_id").replace("FROM documents", "FROM benchmark")


def _runs(words: str, k: int) -> str:
    """SQL of the runs of k words of a list; the whole list where it is shorter, nothing where it is empty."""
    return f"CASE WHEN len({words}) >= {k} THEN list_transform(range(1, len({words}) - {k - 2}), lambda i: array_to_string({words}[i : i + {k - 1}], ' ')) WHEN len({words}) > 0 THEN ['#' || array_to_string({words}, ' ')] ELSE [] END"


_OP2 = f"""WITH {_WORDS}, tf AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS t FROM w) GROUP BY ALL), size AS (SELECT doc_id, len(w) AS n FROM w), a AS (SELECT count(*) AS docs, avg(n) AS mean FROM size),
df AS (SELECT t, ln(1 + ((SELECT docs FROM a) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY t),
s AS (SELECT q.doc_id AS query_id, d.doc_id, sum(q.n * idf * d.n * 2.2 / (d.n + 1.2 * (0.25 + 0.75 * size.n / a.mean))) AS score FROM tf q JOIN tf d ON q.t = d.t JOIN df ON df.t = q.t JOIN size ON size.doc_id = d.doc_id, a WHERE q.doc_id % 100 = 0 GROUP BY ALL),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id, round(score, 6) AS score FROM s) SELECT query_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10"""
_OP8 = f"""WITH RECURSIVE {_WORDS}, s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest({_runs("w", 2)}) AS sh FROM w)), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL), l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 80 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l), r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x, min(y) AS m FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id, m = w.doc_id AS kept FROM w JOIN c ON c.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id"""
_OP9 = f"""WITH {_WORDS}, {_ITEMS}, d AS (SELECT DISTINCT doc_id, unnest({_runs("w", 5)}) AS sh FROM w), i AS (SELECT DISTINCT item_id, unnest({_runs("w", 5)}) AS sh FROM v), k AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i ON d.sh = i.sh GROUP BY ALL) SELECT doc_id, c.item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment FROM c JOIN k ON c.item_id = k.item_id WHERE 100 * c >= 80 * n"""
_CHARS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_OP10 = f"""WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS x FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr({_CHARS}, ((('0x' || substr(x, 1 + 5 * (i // 4)::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL expresses; the others are tested against brute force (tests/llm)."""
    return {"op2_search": _OP2, "op8_near_dup": _OP8, "op9_decontaminate": _OP9, "op10_warc": _OP10}
