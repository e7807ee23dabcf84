"""The toxicity model against plain Python: patterns, label model, features and scores."""

import math
import re

import numpy as np
import pyarrow as pa

from docforge.llm import toxicity


def plain_label_model(v, start, rounds, cliques):
    """The EM of label_model for given cliques, row by row."""
    q = [min(0.95, max(0.05, float(x))) for x in start]
    for _ in range(rounds):
        n1, n0 = sum(q), sum(1 - x for x in q)
        prior = (n1 + 1) / (len(q) + 2)

        def rate(j, x, toxic):
            return (sum((a if toxic else 1 - a) for a, row in zip(q, v, strict=True) if row[j] == x) + 0.5) / ((n1 if toxic else n0) + 1.5)  # noqa: B023

        def joint(c, values, toxic):
            seen = sum((a if toxic else 1 - a) for a, row in zip(q, v, strict=True) if [row[j] for j in c] == values)  # noqa: B023
            return (seen + math.prod(rate(j, x, toxic) for j, x in zip(c, values, strict=True))) / ((n1 if toxic else n0) + 1)  # noqa: B023

        new = []
        for row in v:
            odds = math.log(prior / (1 - prior))
            for c in cliques:
                values = [row[j] for j in c]
                odds += math.log(joint(c, values, True) / joint(c, values, False))
            new.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        q = new
    return q


def made_votes(n=60, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < 0.4
    a = np.where(rng.random(n) < 0.8, y, ~y).astype(int)
    b = np.where(rng.random(n) < 0.9, a, 1 - a)  # says what the first one says
    c = np.where(rng.random(n) < 0.85, np.where(y, 1, -1), 0)
    d = np.where(rng.random(n) < 0.7, y, 0).astype(int)
    return np.column_stack([a, b, c, d]).astype(np.int8), y


def test_label_model_is_the_plain_em():
    v, y = made_votes()
    cliques = toxicity.cliques_of(v, np.clip(y.astype(float), 0.05, 0.95))
    assert sorted(j for c in cliques for j in c) == [0, 1, 2, 3] and any({0, 1} <= set(c) for c in cliques)
    one = toxicity.label_model(v, y, 1)
    assert np.allclose(one, plain_label_model(v.tolist(), y, 1, cliques))
    alone = [[0], [1], [2], [3]]
    toxicity_cliques, toxicity.cliques_of = toxicity.cliques_of, lambda *_: alone
    try:
        assert np.allclose(toxicity.label_model(v, y, 6), plain_label_model(v.tolist(), y, 6, alone))
    finally:
        toxicity.cliques_of = toxicity_cliques


def test_labels_are_no_voters():
    """Rows that vote alike have one posterior, whatever their given labels."""
    v, y = made_votes(400)
    q = toxicity.label_model(v, y)
    for row in np.unique(v, axis=0):
        assert np.ptp(q[(v == row).all(1)]) < 1e-9
    assert ((q > 0.5) == y).mean() > 0.85


def test_correlated_voters_count_once():
    v, y = made_votes(2_000)
    copies = np.column_stack([v[:, :1]] * 4 + [v[:, 2:]])  # one voter four times
    assert [0, 1, 2, 3] in toxicity.cliques_of(copies, np.clip(y.astype(float), 0.05, 0.95))
    one, four = toxicity.label_model(np.delete(v, 1, axis=1), y), toxicity.label_model(copies, y)
    assert np.abs(one - four).max() < 0.02


def test_covering():
    """A pattern that only repeats better ones is left out; one that is in texts of its own, or in many, is not."""
    toxic = np.arange(200) < 80
    has = {"idiot ": range(50), "idio": range(12), "idiots ": range(10), "scum ": range(35, 80), "the ": range(200), "rare ": range(78, 80)}
    names = sorted(has)
    pairs = sorted((d, names.index(p)) for p in names for d in has[p])
    doc, entry = (np.array(x) for x in zip(*pairs, strict=True))
    assert toxicity.covering(names, doc, entry, toxic) == ["idiot ", "scum "]
    g = toxicity.gains(np.array([50.0]), np.array([0.0]), 80, 120)[0]
    assert math.isclose(g, 2 * (50 * math.log(50 * 200 / (50 * 80)) + 30 * math.log(30 * 200 / (150 * 80)) + 120 * math.log(120 * 200 / (150 * 120))))


def test_features_and_scores(texts):
    """Presence, counts and scores of real texts, computed word by word."""
    patterns = ["the ", "ther", "scum ", "idiot ", "en "]
    model = toxicity.Model(patterns, np.zeros(17), np.ones(17), np.linspace(-1, 1, 18))
    some = [*list(texts.values())[:60], "", "You are an IDIOT!!! shut up", "a**hole the thereby THE scum,scum", "NOW YOU GO", "NOW you GO AWAY ALL"]
    present, counts = toxicity.Matcher(patterns).texts(pa.array([t.encode() for t in some], pa.binary()))
    scores = model.scores(pa.array([t.encode() for t in some], pa.binary()))
    for i, text in enumerate(some):
        words = re.findall(r"[^\x20\x09-\x0d]+", text.translate({c: c + 32 for c in range(65, 91)}))
        hits = {w: {p for p in patterns for f in re.findall(r"[^\W\d_]+", w.lower()) if (f == p.strip() if p.endswith(" ") else f.startswith(p) and len(f) > len(p))} for w in set(words)}
        assert [bool(x) for x in present[i]] == [any(p in h for h in hits.values()) for p in patterns]
        assert counts[i, :4].tolist() == [len(words), len(set(words)), sum(bool(hits[w]) for w in words), sum(bool(h) for h in hits.values())]
        low = text.encode().lower()
        caps = [len(re.findall("[A-Z]", w)) >= 3 and not re.search("[a-z]", w) for w in re.findall(r"[^\x20\x09-\x0d]+", text)]
        assert counts[i, 4:].tolist() == [any(x in low for x in toxicity.ADDRESS), any(x in low for x in toxicity.DISMISSAL), re.search(rb"[a-z]\*\*", low) is not None, b"!!!" in low, any(all(caps[j : j + 3]) for j in range(len(caps) - 2))]
        x = toxicity.features(present[i : i + 1], counts[i : i + 1])[0] - model.mean
        assert len(x) == 17 and math.isclose(scores[i], 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.coef, strict=False)) + model.coef[-1])))), rel_tol=1e-9)


def test_mined_counts(spark):
    rows = [(1, "The scum, scum THE", 1), (2, "the idiots", 0), (3, "", 1), (4, "scumbag", 0)]
    got = {}
    for batch in toxicity._mine(iter([pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "toxic": [r[2] for r in rows]})])):
        for p, k, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = got.get(p, (0, 0))
            got[p] = (a + k, b + m)
    assert got["the "] == (1, 1) and got["scum "] == (1, 0) and got["scum"] == (0, 1) and got["idio"] == (0, 1)


def test_empty_and_repeatable(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    empty = docs.where("false")
    model = toxicity.fit(empty, labels)
    assert toxicity.score(empty, model).count() == 0 and toxicity.without_toxic(empty, model).count() == 0
    both = labels.select("doc_id", "toxic").union(labels.selectExpr("doc_id", "1 - toxic"))
    one, two = (toxicity.fit(docs.repartition(n), both.repartition(n)) for n in (2, 3))
    assert one.patterns == two.patterns and (one.constant == two.constant if one.constant is not None else np.allclose(one.coef, two.coef))
