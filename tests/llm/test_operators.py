"""Each operator against a brute-force version, on small tables."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import pytest

from docforge.llm import bpe, components, decontaminate, html_text, language_model, near_dup, search, substring_dedup, token_counts, toxicity, warc

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = tokenizers.path("piece_bpe_32k.model")


def words(t):
    return t.encode().lower().split()


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


# 1 ----------------------------------------------------------------------------------------------


def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("native", [False, True])
def test_bpe(docs, odd, native):
    enc = encoding()
    for df in (odd, docs.limit(40) if native else docs):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = enc.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), tuple(ids)] += 1
        got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in bpe.encode(df, RANKS, keep_ids=True, native=native).collect())
        assert got == want


def test_bpe_blocks_are_bounded(monkeypatch):
    """One Arrow batch may hold the tokens of several blocks: none has more than its bound, but for one document alone."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "BLOCK_TOKENS", 10)
    rows = [["a", "b", "a"], [], ["c"] * 7, ["d"] * 25, ["e", "a"], ["f"] * 8, ["a"]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "toks"])
    got, held = {}, []
    for x in bpe._blocks(iter([batch, batch.slice(0, 0), batch.slice(4)])):
        ids, sizes, names = x.column(0)[0].as_py(), x.column(1)[0].as_py(), x.column(3)[0].as_py()
        toks = [names[int.from_bytes(x.column(2)[0].as_py()[i : i + 4], "little")] for i in range(0, 4 * sum(sizes), 4)]
        held.append((sum(sizes), sum(n > 0 for n in sizes)))
        for i, n, end in zip(ids, sizes, itertools.accumulate(sizes), strict=True):
            got.setdefault(i, []).append(toks[end - n : end])
    assert all(total <= 10 or docs == 1 for total, docs in held)
    assert got == {i: [r] * (1 + (i >= 4)) for i, r in enumerate(rows)}


def test_heap_bpe_agrees():
    ranks, enc = bpe.read_ranks(RANKS), encoding()
    for w in ("internationalisation", "aaaaaaaaaaaaaaaaaaaaaaa", "ciónmenteasque", "x" * 900):
        assert bpe.heap_bpe(w.encode(), ranks) == enc.encode_ordinary(w)


# 2 ----------------------------------------------------------------------------------------------


def bm25(texts, asked, k=10):
    bags = [(i, collections.Counter(words(t))) for i, t in texts]
    n, average = len(bags), sum(sum(b.values()) for _, b in bags) / max(1, len(bags))
    df = collections.Counter(w for _, b in bags for w in b)
    out = {}
    for qi, t in asked.items():
        q, rows = collections.Counter(words(t)), []
        for i, b in bags:
            size = sum(b.values())
            s = sum(m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * size / average)) for w, m in q.items() if w in b)
            if s > 0:
                rows.append((-round(s, 6), i))
        out[qi] = sorted(rows)[:k]
    return out


@pytest.mark.parametrize("passes", [False, True])
def test_search(docs, odd, monkeypatch, passes):
    monkeypatch.setattr(search, "SHARD_DOCS", 60)
    monkeypatch.setattr(search, "MERGED", 2)
    monkeypatch.setattr(search, "SEEDS", 1)
    if passes:
        monkeypatch.setattr(search, "QUERY_BYTES", 2_000)
        monkeypatch.setattr(search, "QUERY_BLOCK", 1)
    for df in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect() if r.doc_id is not None]
        want = {q: [x for x in w] for q, w in bm25(rows, dict(sorted((i, t) for i, t in rows if i % 100 == 0))).items() if w}
        got = collections.defaultdict(list)
        for r in sorted(search.top_k(df, df.where("doc_id % 100 = 0")).collect(), key=lambda r: r.rank):
            got[r.query_id].append((-round(r.score, 6), r.doc_id))
        assert {q: [s for s, _ in v] for q, v in got.items()} == {q: [s for s, _ in v] for q, v in want.items()}
        assert {q: v for q, v in got.items()} == want


def test_search_threshold_skips_postings(texts):
    """A threshold from elsewhere changes no result above it and saves postings of frequent lists."""
    import numpy as np
    import pyarrow as pa

    from docforge.llm.common import Words

    ids = np.array(sorted(texts))
    built = search.build_shard(ids, pa.array([texts[i].encode() for i in ids], pa.binary()))
    shard = search.Shard(built[3], built[0] / len(ids))
    shard.counted = True
    asked = []
    for i in ids[::40]:
        h = np.unique(Words(pa.array([texts[i].encode()], pa.binary())).hash)
        asked.append(np.flatnonzero(np.isin(shard.terms, h)))
    weight = [np.linspace(1, 3, len(t)) for t in asked]
    free, listed, added = shard.search(asked, weight, 5, np.zeros(len(asked)))
    floor = np.array([s[1] if len(s) > 1 else 0.0 for _, s in free])
    own, _, fewer = shard.search(asked, weight, 5, floor)
    assert (added <= listed + 1e-9).all() and (fewer <= added + 1e-9).all()
    for (d, s), (e, r), least in zip(free, own, floor, strict=True):
        keep = s >= least
        assert d[keep].tolist() == e[: keep.sum()].tolist() and np.array_equal(s[keep], r[: keep.sum()])


# 3 ----------------------------------------------------------------------------------------------


def cut(rows):
    first = {}
    for i, b in sorted((i, b) for i, b in rows if i is not None):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = collections.Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i, len(b), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("chunk", [20_000, 6 << 20])
def test_substrings(docs, odd, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    for df in (docs, odd):
        rows = [(r.doc_id, (r.text or "").encode()) for r in df.select("doc_id", "text").collect()]
        got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_spans(df).collect())
        assert got == cut(rows)
    out = substring_dedup.without_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def variants():
    """Passages that meet in part, shifted, and inside periodic text."""
    import random

    rng = random.Random(5)
    base = ["".join(rng.choice("abcd ") for _ in range(160)) for _ in range(4)]
    rows = []
    for i in range(60):
        a, b = rng.randrange(4), rng.randrange(4)
        s = base[a][rng.randrange(0, 90) :][: rng.randrange(40, 100)] + rng.choice(["", "zz", base[b][:70]]) + "ab" * rng.randrange(0, 60)
        rows.append((i, s))
    return rows


def test_substring_variants(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 2_000)
    rows = variants()
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == cut([(i, s.encode()) for i, s in rows])


def test_substrings_of_one_anchor_in_parts(monkeypatch):
    """The steps run here, one bucket and few chunks, with groups of segments that are all too large to be sorted at once."""
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "SORTED_SEGMENTS", 2)
    monkeypatch.setattr(substring_dedup, "SORTED_WINDOWS", 40)
    used = []
    large = substring_dedup._large
    monkeypatch.setattr(substring_dedup, "_large", lambda *a: used.append(1) or large(*a))
    rows = variants()
    chunks = [pa.table({"__chunk": pa.array([c] * len(own), pa.int32()), "__doc_id": [i for i, _ in own], "__text": [s for _, s in own]}) for c in range(3) if (own := rows[c::3])]
    hashes = pa.concat_tables([substring_dedup._send_hashes(1)(c) for c in chunks])
    shared = substring_dedup._share(hashes)
    of = lambda t, c: t.filter(pa.compute.equal(t.column("chunk"), c))
    segments = pa.concat_tables([substring_dedup._send_segments(1)(t, of(shared, c)) for c, t in enumerate(chunks)])
    found = substring_dedup._compare(segments)
    got = collections.Counter()
    for c, t in enumerate(chunks):
        for r in substring_dedup._digest(1, False)(t, of(found, c)).to_pylist():
            got[tuple(r.values())] += 1
    assert used and got == cut([(i, s.encode()) for i, s in rows])


def test_segments_are_sent_without_a_pass_per_bucket(monkeypatch, texts):
    """A chunk's arrays are read as often for one bucket as for many: only slices are taken for each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    reads = []

    class Counted(substring_dedup.Anchors):
        def __getattribute__(self, name):
            reads.append(name)
            return super().__getattribute__(name)

    def chunk(c):
        return pa.table({"__chunk": pa.array([c] * len(texts), pa.int32()), "__doc_id": pa.array(sorted(texts), pa.int64()), "__text": pa.array([texts[i] for i in sorted(texts)], pa.string())})

    def sent(buckets):
        hashes = pa.concat_tables([substring_dedup._send_hashes(buckets)(chunk(c)) for c in (0, 1)])
        own = [hashes.filter(pc.equal(hashes["bucket"], b)) for b in sorted(set(hashes["bucket"].to_pylist()))]
        shared = pa.concat_tables([substring_dedup._share(t) for t in own])
        shared = shared.filter(pc.equal(shared["chunk"], 0))
        monkeypatch.setattr(substring_dedup, "Anchors", Counted)
        reads.clear()
        out = substring_dedup._send_segments(buckets)(chunk(0), shared)
        monkeypatch.undo()
        assert out.num_rows == buckets
        parts = [substring_dedup.unpacked(substring_dedup.SEGMENTS, x.as_buffer()) for x in out["blob"]]
        return len(reads), sorted(i for p in parts for i in p["sid"].tolist())

    (few, one), (many, all_) = sent(1), sent(40)
    assert few == many and one == all_


def test_windows_without_a_twin_are_not_sorted():
    """Exactly the windows that equal another one of their group are sorted."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (40, 60)).astype(np.uint8)
    rows[20:] = rows[rng.integers(0, 20, 20)]  # copies, which differ in one byte
    rows[20:][np.arange(20), rng.integers(0, 60, 20)] = 120
    seg, off = np.repeat(np.arange(40), 11), np.tile(np.arange(11), 40)
    group = seg % 2 * 64 + off
    window = [(int(g), bytes(rows[s, o : o + 50])) for g, s, o in zip(group, seg, off, strict=True)]
    count = collections.Counter(window)
    want = [i for i, w in enumerate(window) if count[w] > 1]
    assert substring_dedup.Suffixes(rows).twins(group, seg, off).tolist() == want and 0 < len(want) < len(window)


def test_substring_blobs_and_collisions():
    import numpy as np

    for n in (0, 1, 5_000):
        x = {name: np.arange(n, dtype=np.int64) * 7 % 251 for name, _ in substring_dedup.SEGMENTS}
        back = substring_dedup.unpacked(substring_dedup.SEGMENTS, substring_dedup.packed(substring_dedup.SEGMENTS, **x))
        assert all((back[k] == x[k]).all() and back[k].dtype == np.dtype(kind) for k, kind in substring_dedup.SEGMENTS)
    data, start, size = np.frombuffer(b"abcabcabd", np.uint8), np.array([0, 3, 6]), np.array([3, 3, 3])
    substring_dedup.checked(data, start, size, np.array([1]))
    with pytest.raises(RuntimeError, match="identity"):
        substring_dedup.checked(data, start, size, np.array([1, 2]))


# 4 ----------------------------------------------------------------------------------------------


def test_language_model(docs, odd, monkeypatch):
    monkeypatch.setattr(language_model, "HELD_WORDS", 300)
    monkeypatch.setattr(language_model, "STEPS", 300)
    for df in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        c = collections.Counter()
        for i, t in rows:
            if not out(i):
                c.update([*words(t), b"\n"])
        n, v = sum(c.values()), len(c)
        want = collections.Counter((i, out(i), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b"\n"]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), b"\n"]), 4)) for i, t in rows)
        got = language_model.score_texts(df).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
        if df is docs:
            assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_scores_are_the_plain_sums(docs, monkeypatch):
    """score is the sum over a text's tokens of log P(class | two classes before) + log P(word | class), token by token."""
    import numpy as np
    import pyarrow as pa

    from docforge.llm.common import Words

    monkeypatch.setattr(language_model, "STEPS", 100)
    monkeypatch.setattr(language_model, "EPOCHS", 2)
    kept = {}
    train = language_model.train
    monkeypatch.setattr(language_model, "train", lambda *a: kept.setdefault("table", train(*a)))
    refined = language_model.refined
    monkeypatch.setattr(language_model, "refined", lambda *a: kept.__setitem__("classes", refined(*a)) or kept["classes"])
    got = language_model.score_texts(docs).collect()
    classes, table = kept["classes"], kept["table"]
    rows = {r.doc_id: words(r.text or "") for r in docs.collect()}
    count = collections.Counter(w for i, t in rows.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    some = sorted({w for t in rows.values() for w in t})
    cls = dict(zip(some, classes.of(Words(pa.array(some, pa.binary())), np.arange(len(some))).tolist(), strict=True))
    spelled_from = classes.n - classes.logp.shape[1]
    size = collections.Counter()
    for w, n in count.items():
        size[cls[w]] += n + 1
    for r in got:
        own, total = [0, 0, *(cls[w] for w in rows[r.doc_id]), 0], 0.0
        for k, w in enumerate([*rows[r.doc_id], None]):
            total += float(table[own[k] * classes.n + own[k + 1], own[k + 2]])
            if w is not None and cls[w] >= spelled_from:
                total += math.log10((count[w] + 1) / (size[cls[w]] + 1))
        assert math.isclose(r.score, total, rel_tol=1e-4)


def test_held_out_log_probability(spark):
    """Log10 per held-out token on 1,000 documents; it was -3.629 with 48 spelling classes and -3.683 with 16."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in language_model.score_texts(docs).collect() if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -3.64


def test_spelling_classes():
    """48 spelling classes, and the best of them by the sums over byte pairs, for words of any length."""
    import numpy as np
    import pyarrow as pa

    from docforge.llm.common import Words

    top = [(b"%dw%x" % (i * 7919 % 1000, i * i), 900 - i) for i in range(600)]
    classes = language_model.fit_classes(top)
    assert classes.logp.shape[1] == 48 and classes.n == 1 + 79 + 48
    own = [w for w, _ in top[79:]] + [b"z", b"q" * 300, b"1w2" * 900]
    got = classes.of(Words(pa.array(own, pa.binary())), np.arange(len(own)))
    for w, c in zip(own, got, strict=True):
        score = sum(classes.logp[classes.pair_row[a << 8 | b]].astype(float) for a, b in itertools.pairwise((0, *w, 0)))
        assert score[c - 80] >= score.max() - 1e-3 * abs(score.max())


def test_training_passes_over_all_cells(monkeypatch):
    """However few the least steps are, every counted context is learnt from."""
    import numpy as np

    monkeypatch.setattr(language_model, "STEPS", 1)
    c = 60
    a, b = np.divmod(np.arange(c * c), c)
    table = language_model.train((a * c + b) * c + b, np.full(c * c, 5.0), c)
    assert (table[a * c + b, b] > -0.3).all()


def test_spelling_classes_follow_all_words(spark):
    """Byte pairs of rare words alone shape the classes, and more words make more classes."""
    common = [(b"a%db" % i, 1000 - i) for i in range(200)]
    rare = [(b"qz%dzq" % i, 1) for i in range(2000)]
    classes = language_model.fit_classes(common)
    pair = ord("q") << 8 | ord("z")
    assert not classes.pair_row[pair]
    counts = spark.createDataFrame([(bytearray(w), n) for w, n in [*common, *rare, (b"\n", 9)]], "word binary, n bigint")
    after = language_model.refined(classes, counts)
    assert after.pair_row[pair] and after.logp.shape[1] == classes.logp.shape[1]
    assert after.logp[after.pair_row[pair]].max() > after.logp[0].max() + 1
    sizes = [language_model.spellings_for(v) for v in (0, 1 << 17, 1 << 20, 1 << 27)]
    assert sizes == [48, 48, 60, 88]


def test_language_model_blocks_are_bounded():
    """Memory of a worker follows the block, not the batch: 12 MB in one batch, counted whole."""
    import random
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    rng = random.Random(5)
    vocabulary = [f"w{i * 7919 % 999983:x}" for i in range(20_000)]
    texts = [" ".join(rng.choices(vocabulary, k=400)) for _ in range(5_400)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    assert batch.column(1).nbytes > 12 << 20
    classes = language_model.fit_classes([(w.encode(), 20_000 - i) for i, w in enumerate(vocabulary[:2_000])])
    for f in (language_model._counter, language_model._trigrams(SimpleNamespace(value=classes))):
        tracemalloc.start()
        total = sum(sum(out.column(1).to_pylist()) for out in f(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert total == 401 * len(texts)
        assert peak < 150 << 20


def test_class_probabilities_are_normalised():
    import numpy as np

    table = language_model.train(np.array([5, 9, 20]), np.array([3.0, 1.0, 2.0]), 4)
    assert np.allclose((10.0**table).sum(1), 1)


# 5 ----------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></ul></nav>
<div class="cookie-notice">We use cookies on this site and you accept that.</div><div id=ad-1>Buy this now.</div>
<article><header><h1>The title &amp; more</h1></header><p>The first   paragraph of the text is here, and it is long enough to be kept by all of the rules that there are.<br>A line.</p>
<p>Short.<script>var x = "<p>no</p>";</script><aside>By the way, the side is not it.</aside><p>The last one of the
 text&nbsp;is this.<form><input name=q><button>Go</button></form><section class="comments"><p>I think that this is the best of all of the comments.</section></article>
<footer>&copy; the site</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "\n\n".join(["The title & more", "The first paragraph of the text is here, and it is long enough to be kept by all of the rules that there are. A line.", "Short.", "The last one of the text is this."])
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""


def test_html_without_article():
    long = "This is the main text of the page and it has to be long enough for the rules, so there is more of it than in the other blocks that are on the page. It goes on with one more sentence and then with another, as a text does."
    page = f"<body><div><a href=/1>one link</a> <a href=/2>two links</a> <a href=/3>three links of a list</a></div><h1>A heading</h1><div>{long}</div><p>Short one.</p><p>{long}</p></body>"
    assert html_text.main_text(page) == "\n\n".join(["A heading", long, "Short one.", long])


def test_html_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(html_text.html_lib.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div|article)\b[^>]*>", article)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = html_text.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    nulls = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_text.extract(nulls).collect()) == [(0, ""), (1, ""), (1, "")]


# 6 ----------------------------------------------------------------------------------------------


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    assert {"idiot ", "scum ", "trash "} <= set(model.patterns)
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, marked[r.doc_id]) for r in toxicity.score(docs, model).collect() if r.held_out and r.doc_id in marked]
    assert sum(p == t for p, t in held) / len(held) > 0.9
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_toxicity_odd(spark, odd):
    one = spark.createDataFrame([(1, 0), (1, None), (None, 1), (2, 1)], "doc_id long, toxic int")
    for labels in (one, one.where("false"), one.where("toxic = 0")):
        model = toxicity.fit(odd, labels)
        got = toxicity.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


# 7 ----------------------------------------------------------------------------------------------


def plain_viterbi(word, pieces, longest, unknown):
    """The best segmentation by (score, fewer tokens), position by position."""
    best = [(0.0, 0)] + [None] * len(word)
    for d in range(1, len(word) + 1):
        for n in range(1, min(d, longest) + 1):
            s = pieces.get(word[d - n : d], unknown if n == 1 else None)
            if s is not None and best[d - n] is not None:
                x = (best[d - n][0] + s, best[d - n][1] - 1)
                if best[d] is None or x > best[d]:
                    best[d] = x
    return best[-1][0], -best[-1][1]


def test_token_counts(docs, odd, spark):
    pieces, memo = token_counts.piece_scores(PIECES), {}
    longest, unknown = max(map(len, pieces)), min(pieces.values()) - token_counts.UNKNOWN_PENALTY
    unspaced = spark.createDataFrame([(i, "漢字かな交じり文です。" * (i + 1) + "x" * i) for i in range(30)], "doc_id long, text string")
    for df in (docs, odd, unspaced):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            t, n, s = r.text or "", 0, 0.0
            pre = re.findall(r" [^ ]*", " " + t) if t else []
            for w in pre:
                memo[w] = memo.get(w) or plain_viterbi(w.encode(), pieces, longest, unknown)
                n, s = n + memo[w][1], s + memo[w][0]
            want[r.doc_id, n, len(pre), len(t.encode()), round(s, 3)] += 1
        assert collections.Counter((r.doc_id, r.n_tokens, r.n_pretokens, r.n_bytes, round(r.log_prob, 3)) for r in token_counts.token_counts(df, PIECES).collect()) == want


# 8 ----------------------------------------------------------------------------------------------


def groups(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and rows[a][0] is not None and rows[b][0] is not None and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for x in range(len(rows)):
        if rows[x][0] is not None:
            least[find(x)] = min(least.get(find(x), rows[x][0]), rows[x][0])
    return collections.Counter((i, len(sets[x]), least[find(x)] if i is not None else None, i is None or least[find(x)] == i) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, odd, k):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df, shingle=k).collect()) == groups(rows, k)
    kept = near_dup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert collections.Counter(r.doc_id for r in kept.collect()) == {1: 1, 3: 1, 4: 1, None: 2, 5: 1, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 100: 1}


def test_near_copies_of_one_text(spark, monkeypatch):
    """A group in which many pairs are below the threshold, in small tiles and stars."""
    import random

    monkeypatch.setattr(near_dup, "STAR", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        for p in rng.sample(range(60), rng.randrange(0, 9)):
            w[p] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == groups(rows, 2)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40) if i % 10] + [(50, 50), (7, 3), (7, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got[9] == 1 and got[10] == 1 and got[20] == 11 and got[50] == 50 and len(set(got.values())) == 5


# 9 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [32 << 20, 500])
def test_contained_items(spark, docs, odd, monkeypatch, size):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    own = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, "x"), (3, None), (4, ""), (None, "w0x0 w1x1 w2x2 w3x3 w4x4 w5x5")], "item_id long, text string")
    for df, it in ((docs, items), (odd, own)):
        want = collections.Counter()
        for d in df.select("doc_id", "text").collect():
            s = shingles(d.text or "", 5)
            for i in it.collect():
                x = shingles(i.text or "", 5)
                if x and 100 * len(x & s) >= 80 * len(x):
                    want[d.doc_id, i.item_id, len(x), len(x & s)] += 1
        got = decontaminate.contained_items(df, it).collect()
        assert collections.Counter((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got) == want
        clean = decontaminate.decontaminated(df, it)
        assert clean.columns == df.columns and all(not shingles(r.text or "", 5) or (r.doc_id, r.text) for r in clean.collect())
    assert decontaminate.contained_items(odd, own.where("false")).count() == 0


def test_batches_that_only_touch_items(spark):
    """A batch that holds shingles of items, but too few of each, contains nothing (and is no error)."""
    items = spark.createDataFrame([(1, " ".join(f"v{i}" for i in range(20)))], "item_id long, text string")
    df = spark.createDataFrame([(1, "a v0 v1 v2 v3 v4 v5 b"), (2, "c d e f g h")], "doc_id long, text string").coalesce(1)
    assert decontaminate.contained_items(df, items).collect() == []
    assert decontaminate.decontaminated(df, items).collect() == df.collect()


# 10 ---------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(None, None, None), (900, "u v\r\nx", None), (901, "u", "é<p>"), (902, "u", "é<p>"), (902, "u", "é<p>"), (903, None, "")], "page_id long, url string, html string")
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.union(more).collect()]
    first = {}
    for i, h in sorted((i, h) for i, h in rows if i is not None):
        first.setdefault(h, i)
    want = collections.Counter()
    for i, h in rows:
        revisit = i is not None and first[h] != i
        want[i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", first[h] if revisit else None] += 1
    files = []
    for name in ("a", "b"):
        root, manifest = warc.write_warc(pages.union(more), f"file://{tmp_path}/{name}", roll_bytes=20_000, shard_bytes=60_000)
        got = warc.read_warc(spark, root).collect()
        assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        held = sorted((r.file, r.sha256, r.n_records) for r in manifest.collect())
        assert sorted(p.name for p in (tmp_path / name).glob("*.warc.gz")) == [f for f, _, _ in held] and len(held) > 3
        assert all(hashlib.sha256((tmp_path / name / f).read_bytes()).hexdigest() == h for f, h, _ in held)
        files.append(held)
    assert files[0] == files[1]
    root, _ = warc.write_warc(pages.where("false"))
    assert warc.read_warc(spark, root).count() == 0


def test_warc_is_what_its_manifest_lists(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    root, _ = warc.write_warc(pages, f"file://{tmp_path}/a", roll_bytes=20_000, shard_bytes=60_000)
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    (tmp_path / "a" / "part-999999-0000.warc.gz").write_bytes(files[0].read_bytes())  # a stale file is no part of it
    assert warc.read_warc(spark, root, payloads=False).count() == pages.count()
    held = files[1].read_bytes()
    files[1].write_bytes(files[0].read_bytes())  # whole records, but of another file
    with pytest.raises(Exception, match="digest that the manifest lists"):
        warc.read_warc(spark, root).collect()
    files[1].unlink()
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        warc.read_warc(spark, root).collect()
    files[1].write_bytes(held)
    (tmp_path / "a" / warc.MANIFEST).unlink()
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, root)


# all ---------------------------------------------------------------------------------------------


def test_empty_tables(odd):
    none = odd.where("false")
    for df in (bpe.encode(none, RANKS), search.top_k(none, none), substring_dedup.repeated_spans(none), language_model.score_texts(none), token_counts.token_counts(none, PIECES), near_dup.near_duplicates(none), near_dup.deduplicated(none), substring_dedup.without_repeats(none)):
        assert df.count() == 0


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    own, sf = docs, "/root/testdata/sf0.001"
    for name, stage in p.STAGES[:-1]:
        before = {r.doc_id for r in own.collect()}
        own = p.written(stage(spark, own, sf), name)
        assert own.columns == docs.columns and {r.doc_id for r in own.collect()} <= before
    left = {r.doc_id: r.text for r in own.collect()}
    enc = encoding()
    got = {r.doc_id: list(r.ids) for r in p.run(spark, sf).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in left.items()}
    assert 0 < len(left) < docs.count()
