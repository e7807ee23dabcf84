"""Exact top-k search by BM25: an inverted index in shards, pruned by block maxima.

Each shard holds the postings of some thousand documents, renumbered so that alike documents lie
together. A frequent term's list is cut into blocks of documents, a rarer term's into blocks of one
posting each (blocks of variable size, as in variable-block WAND); every block has its greatest impact.
For a query the maxima of its lists add up to a bound of each document. Ranges of documents are taken by
falling bound; the pivot is the first whose bound can reach the k-th best score so far, and what lies
below is skipped with all of its postings in frequent lists.

A query does not start from nothing in a shard: the shards that come first in a fixed order (a bounded
number) are searched beforehand, and the k-th best score in them is a threshold for all the others. Scores use the document count,
average length and document frequencies of the whole corpus, so merging the shards' lists is exact.

The sums of a range only select candidates, with a margin; each candidate's score is then summed again
in one fixed order. Queries are taken in blocks of bounded size, in passes whose results are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docforge.llm.common import as_bytes, id_text, packed, ranges, tidied, tidied_group, unpacked, Words
from docforge.plans.tables import bounded_arrow, release, written

#: Documents and bytes of a shard; documents of a block; queries that are scored together.
SHARD_DOCS, SHARD_BYTES, BLOCK_DOCS, TOGETHER = 8192, 16 << 20, 128, 64
#: Bytes of queries that are broadcast at once; more are taken in further passes over the index.
QUERY_BYTES = 32 << 20
QUERY_BLOCK = 256
#: Shards' lists that are merged at once, and shards that are searched first for the queries' thresholds.
MERGED, SEEDS = 16, 4
K1, B = 1.2, 0.75


def _order(doc: np.ndarray, term: np.ndarray, df: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A numbering that puts alike documents together: signs of the main components of frequent terms, then length."""
    top = np.argsort(-df, kind="stable")[:64]
    column = np.full(len(df), -1)
    column[top] = np.arange(len(top))
    own = column[term] >= 0
    x = np.zeros((len(size), len(top)), np.float32)
    x[doc[own], column[term[own]]] = 1
    x -= x.mean(0) if len(x) else 0
    _, v = np.linalg.eigh(x.T @ x)
    signs = (x @ v[:, ::-1][:, :3]) > 0
    group = (signs * (1 << np.arange(signs.shape[1]))).sum(1)
    rank = np.empty(len(size), np.int64)
    rank[np.lexsort((size, group))] = np.arange(len(size))
    return rank


def build_shard(ids: np.ndarray, texts: pa.BinaryArray) -> tuple[int, np.ndarray, np.ndarray, bytes]:
    """Words in all, terms, document frequencies, and the packed index of a shard."""
    words = Words(texts)
    size = np.bincount(words.doc, minlength=len(ids))
    by = np.argsort(words.hash, kind="stable")
    h, d = words.hash[by], words.doc[by]
    if not len(h):
        return 0, h, np.zeros(0, np.uint32), packed(ids=ids, size=size.astype(np.uint32), terms=h, df=np.zeros(0, np.uint32), doc=np.zeros(0, np.uint32), tf=np.zeros(0, np.uint32))
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
    tf, doc, ph = np.diff(np.append(first, len(h))), d[first], h[first]
    begin = np.flatnonzero(np.concatenate([[True], ph[1:] != ph[:-1]]))
    df = np.diff(np.append(begin, len(ph)))
    term = np.repeat(np.arange(len(begin)), df)
    rank = _order(doc, term, df, size)
    again = np.argsort(term << 32 | rank[doc])
    back = np.argsort(rank)
    return len(h), ph[begin], df.astype(np.uint32), packed(ids=ids[back], size=size[back].astype(np.uint32), terms=ph[begin], df=df.astype(np.uint32), doc=rank[doc][again].astype(np.uint32), tf=tf[again].astype(np.uint32))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = size = 0

    def shard() -> pa.RecordBatch:
        ids = pa.concat_arrays([b.column(0) for b in held]).to_numpy()
        total, terms, df, index = build_shard(ids, pa.concat_arrays([as_bytes(b.column(1)) for b in held]))
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([total], pa.int64()), pa.array([terms.astype("<u8").tobytes()], pa.binary()), pa.array([df.astype("<u4").tobytes()], pa.binary()), pa.array([index], pa.binary()), pa.array([ids[0]], pa.int64())], names=["n_docs", "n_words", "terms", "df", "index", "first"])

    for batch in batches:
        for i in range(0, len(batch), 1024):
            part = batch.slice(i, 1024)
            held.append(part)
            n, size = n + len(part), size + part.nbytes
            if n >= SHARD_DOCS or size >= SHARD_BYTES:
                yield shard()
                held, n, size = [], 0, 0
    if n:
        yield shard()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            terms, df = np.frombuffer(batch.column(0)[i].as_buffer(), "<i8"), np.frombuffer(batch.column(1)[i].as_buffer(), "<u4")
            for a in range(0, len(terms), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(terms[a : a + (1 << 17)]), pa.array(df[a : a + (1 << 17)].astype(np.int64))], names=["term", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(as_bytes(batch.column(1)))
        by = np.lexsort((words.hash, words.doc))
        h, d = words.hash[by], words.doc[by]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else by
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d[first])), pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h))).astype(np.int64))], names=["query_id", "term", "qtf"])


def _query_block(table: pa.Table) -> pa.Table:
    q, term, weight = (table.column(n).to_numpy() for n in ("query_id", "term", "weight"))
    term = term.view(np.uint64)
    by = np.lexsort((term, q))
    ids, at = np.unique(q[by], return_index=True)
    return pa.Table.from_arrays([pa.array([packed(ids=ids, n=np.diff(np.append(at, len(q))).astype(np.uint32), term=term[by], weight=weight[by])], pa.binary())], names=["block"])


class Shard:
    """A shard ready to be searched."""

    def __init__(self, index: bytes, average: float) -> None:
        self.counted = False  # whether search() counts what it adds up in frequent lists
        x = unpacked(index)
        self.ids, self.terms, self.df = x["ids"], x["terms"], x["df"].astype(np.int64)
        self.doc, tf = x["doc"].astype(np.int64), x["tf"].astype(np.float64)
        self.at = np.cumsum(self.df) - self.df
        self.n = len(self.ids)
        self.blocks = -(-self.n // BLOCK_DOCS)
        norm = K1 * (1 - B + B * x["size"] / average) if average else np.ones(self.n)
        self.impact = tf * (K1 + 1) / (tf + norm[self.doc])
        self.term = np.repeat(np.arange(len(self.terms)), self.df)
        head = self.df >= max(32, self.n // 16)
        self.head = np.where(head, np.cumsum(head) - 1, -1)
        own = np.flatnonzero(head[self.term])
        self.dense = np.zeros((int(head.sum()), self.blocks * BLOCK_DOCS), np.float32)
        self.dense[self.head[self.term[own]], self.doc[own]] = self.impact[own]
        self.most = self.dense.reshape(len(self.dense), self.blocks, BLOCK_DOCS).max(2)
        self.light = self.impact.astype(np.float32)
        self.by_doc = np.argsort(self.doc, kind="stable")
        self.doc_at = np.searchsorted(self.doc[self.by_doc], np.arange(self.n + 1))

    def search(self, term: list[np.ndarray], weight: list[np.ndarray], k: int, floor: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
        """For each query (places of its terms here, and their weights) the best documents and exact scores.

        ``floor`` is a score that k documents somewhere reach: less is no result. Also returned: postings
        of the queries' terms, and how many of them were added up, for each query.
        """
        m = len(term)
        q = np.zeros((m, len(self.dense)), np.float32)
        s = np.zeros((m, self.blocks * BLOCK_DOCS), np.float32)
        for i, (t, w) in enumerate(zip(term, weight, strict=True)):
            h = self.head[t]
            q[i, h[h >= 0]] = w[h >= 0]
            rare = t[h < 0]
            if len(rare):
                at = ranges(self.at[rare], self.df[rare])
                s[i] = np.bincount(self.doc[at], weights=self.light[at] * np.repeat(w[h < 0], self.df[rare]), minlength=s.shape[1])
        bound = q @ self.most + s.reshape(m, self.blocks, BLOCK_DOCS).max(2)
        seen = np.zeros((m, self.blocks), bool)
        best = np.zeros((m, k), np.float32)
        least = floor.astype(np.float32)
        held = (self.dense > 0).reshape(len(self.dense), self.blocks, BLOCK_DOCS).sum(2) if self.counted else None
        listed = np.array([self.df[t].sum() for t in term])
        added = np.array([self.df[t[self.head[t] < 0]].sum() for t in term], float)
        for b in np.argsort(-bound.max(0), kind="stable"):
            live = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] >= least - 1e-4 * (1 + least)))
            if not len(live):
                continue
            span = slice(b * BLOCK_DOCS, (b + 1) * BLOCK_DOCS)
            now = s[live, span] + q[live] @ self.dense[:, span]
            s[live, span] = now
            seen[live, b] = True
            best[live] = np.partition(np.concatenate([best[live], now], 1), -k, axis=1)[:, -k:]
            least[live] = np.maximum(least[live], best[live].min(1))
            if self.counted:
                added[live] += (q[live] > 0) @ held[:, b]
        out = []
        exact = np.zeros(len(self.terms))
        for i in range(m):
            found = np.flatnonzero(np.repeat(seen[i], BLOCK_DOCS) & (s[i] > 0) & (s[i] >= least[i] - 1e-4 * (1 + least[i])))
            exact[term[i]] = weight[i]
            size = self.doc_at[found + 1] - self.doc_at[found]
            at = self.by_doc[ranges(self.doc_at[found], size)]  # a document's terms in rising order
            score = np.add.reduceat(exact[self.term[at]] * self.impact[at], np.cumsum(size) - size) if len(found) else np.zeros(0)
            exact[term[i]] = 0
            by = np.lexsort((self.ids[found], -score))[:k]
            out.append((self.ids[found][by], score[by]))
        return out, listed, added


def _searcher(held, average: float, k: int):
    """Shards to the best documents of each query of the broadcast blocks; a threshold goes with each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, floors = held.value
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard(batch.column(0)[i].as_buffer(), average)
                if not len(shard.terms):
                    continue
                for block in blocks:
                    x = unpacked(block)
                    place = np.minimum(np.searchsorted(shard.terms, x["term"]), len(shard.terms) - 1)
                    there = shard.terms[place] == x["term"]
                    cut = np.cumsum(x["n"])[:-1]
                    term, weight = ([a[b] for a, b in zip(np.split(v, cut), np.split(there, cut), strict=True)] for v in (place, x["weight"]))
                    floor = np.array([floors.get(q, 0.0) for q in x["ids"].tolist()])
                    rows = []
                    for a in range(0, len(term), TOGETHER):
                        rows += shard.search(term[a : a + TOGETHER], weight[a : a + TOGETHER], k, floor[a : a + TOGETHER])[0]
                    some = np.flatnonzero([len(r[0]) for r in rows])
                    yield pa.RecordBatch.from_arrays([pa.array(x["ids"][some]), pa.array(np.full(len(some), shard.ids[0])), pa.array([rows[j][0] for j in some], pa.list_(pa.int64())), pa.array([rows[j][1] for j in some], pa.list_(pa.float64()))], names=["query_id", "part", "docs", "scores"])

    return run


_FOUND = "query_id bigint, part bigint, docs array<bigint>, scores array<double>"


def _searched(shards: DataFrame, asked: tuple[list[bytes], dict[int, float]], average: float, k: int) -> DataFrame:
    """Lists of some shards."""
    return shards.mapInArrow(tidied(_searcher(shards.sparkSession.sparkContext.broadcast(asked), average, k)), _FOUND)


def _merged(found: DataFrame, groups: int, k: int) -> DataFrame:
    """The k best of each query's lists. Lists are merged by 16 at most, so no group grows with the number of shards."""
    lists = found.selectExpr("query_id", "part", "transform(docs, (d, i) -> struct(-scores[i] as s, d as doc_id)) as hits")
    while groups > 1:
        groups = -(-groups // MERGED)
        lists = lists.groupBy("query_id", F.pmod(F.hash("part"), F.lit(groups)).alias("part")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, k).alias("hits"))
    return lists


def top_k(docs: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The k best documents of each query by BM25 (k1 1.2, b 0.75): query_id, rank (from 1), doc_id, score.

    ``queries`` has the same two columns; a query is the bag of all words of its whole text, and a query
    that is in docs finds itself too. Words are lower-cased (A-Z) and split at ASCII white space. Equal
    scores go by the smaller doc_id; documents that share no word with the query are no results. Rows
    with a null id are left out of both tables; null or empty texts find nothing and are found by
    nothing, but count as documents; rows that repeat a doc_id are documents of their own, and rows that
    repeat a query's id are one query, by its smallest text. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_arrow(spark)
    shards = written(id_text(docs, id_col, text_col).where("doc_id is not null").mapInArrow(tidied(_index), "n_docs bigint, n_words bigint, terms binary, df binary, index binary, first bigint"), "index")
    n_docs, n_words = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    df = shards.select("terms", "df").mapInArrow(tidied(_frequencies), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    asked = id_text(queries, id_col, text_col).where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    n_asked = asked.count()
    terms = asked.mapInArrow(tidied(_query_terms), "query_id bigint, term bigint, qtf bigint")
    idf = F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = terms.join(df, "term").select(F.pmod(F.xxhash64("query_id"), F.lit(max(1, math.ceil(n_asked / QUERY_BLOCK)))).alias("b"), "query_id", "term", (F.col("qtf") * idf).alias("weight"))
    blocks = written(weighted.groupBy("b").applyInArrow(tidied_group(_query_block), "block binary"), "queries")
    size = blocks.agg(F.coalesce(F.sum(F.octet_length("block")), F.lit(0))).first()[0]
    passes = max(1, math.ceil(size / QUERY_BYTES))
    average, n_shards = n_words / max(1, n_docs), shards.count()
    first = sorted({r.first for r in shards.orderBy(F.xxhash64("first"), "first").select("first").limit(SEEDS).collect()})
    results = []
    for p in range(passes):  # one after the other: a pass's queries are held only while it runs
        own = [bytes(r.block) for r in blocks.where(F.pmod(F.xxhash64("block"), F.lit(passes)) == p).collect()]
        floors: dict[int, float] = {}
        if n_shards > 2 * len(first):
            seeds = shards.where(F.col("first").isin(first)).select("index")
            best = _merged(_searched(seeds, (own, floors), average, k), len(first), k).where(F.size("hits") == k)
            floors = {r.query_id: r.score * (1 - 1e-9) for r in best.select("query_id", (-F.element_at("hits", k)["s"]).alias("score")).collect()}
        held = spark.sparkContext.broadcast((own, floors))
        results.append(written(shards.select("index").mapInArrow(tidied(_searcher(held, average, k)), _FOUND), "found"))
        held.destroy()
    release(blocks)
    found = reduce(DataFrame.unionByName, results)
    ranked = _merged(found, n_shards, k).select("query_id", F.posexplode("hits").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.doc_id").alias("doc_id"), (-F.col("hit.s")).alias("score"))
