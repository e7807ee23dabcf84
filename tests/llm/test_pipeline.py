"""Each stage of the pipeline against a brute-force version on its own input, and the whole on an empty table."""

import collections

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from docforge.llm import toxicity  # noqa: E402
from test_operators import encoding, groups, shingles  # noqa: E402

SF = "/root/testdata/sf0.001"


def stage(spark, name, df, sf=SF):
    out = corpus_pipeline.written(dict(corpus_pipeline.STAGES)[name](spark, df, sf), f"test-{name}")
    assert name == "bpe" or out.columns == df.columns
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def cut_text(texts):
    """Texts without the characters all of whose bytes are in 50-byte strings that start in a smaller doc_id too."""
    first = {}
    for i, t in sorted((i, t or "") for i, t in texts if i is not None):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append((i, "".join(kept)))
    return collections.Counter(out)


def test_toxicity_stage(spark, docs):
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted == 0}
    assert {i for i, _ in rows(stage(spark, "toxicity", docs))} == kept and 0 < len(kept)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_near_stage(spark, request, which):
    df = request.getfixturevalue(which)
    own = rows(df)
    want = {i for i, _, _, kept in groups([(i, t or "") for i, t in own], 5) if kept and i is not None}
    got = collections.Counter(i for i, _ in rows(stage(spark, "near_dup", df)))
    assert set(got) - {None} == want and all(n == 1 for i, n in got.items() if i is not None)
    assert got[None] == sum(i is None for i, _ in own)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_substring_stage(spark, request, which):
    df = request.getfixturevalue(which)
    assert collections.Counter(rows(stage(spark, "substring_dedup", df))) == cut_text(rows(df))


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_decontaminate_stage(spark, request, which):
    df = request.getfixturevalue(which)
    items = [x for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (x := shingles(r.text or "", 5))]
    clean = lambda t: not any(100 * len(x & shingles(t or "", 5)) >= 80 * len(x) for x in items)
    assert collections.Counter(rows(stage(spark, "decontaminate", df))) == collections.Counter((i, t) for i, t in rows(df) if clean(t))


def test_bpe_stage(spark, docs):
    enc = encoding()
    assert {r.doc_id: list(r.ids) for r in stage(spark, "bpe", docs).collect()} == {i: enc.encode_ordinary(t or "") for i, t in rows(docs)}


def test_empty_table(spark, docs):
    df = docs.where("false")
    for name, _ in corpus_pipeline.STAGES:
        df = stage(spark, name, df)
        assert df.count() == 0
