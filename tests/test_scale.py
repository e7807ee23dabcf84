"""Results and plans that only show on other rows than the smallest tables have."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401 - its modules register their queries
from docforge.functions import catalog as C
from docforge.functions import text as T
from docforge.operators import gate, score
from docforge.plans.registry import QUERIES
from docforge.streaming import changes


class _State:
    exists = False

    def update(self, value):
        self.exists, self.get = True, value


def test_stream_ties_have_one_order():
    """Two snapshots of one version of a URL: their order, and so their states, don't depend on how they arrive."""
    rows = [("u", 2, "b"), ("u", 1, "b"), ("u", 2, "a"), ("u", 1, "a")]
    results = []
    for given in (rows, rows[::-1]):
        frames = iter([pd.DataFrame(given[:2], columns=["url", "version", "hash"]), pd.DataFrame(given[2:], columns=["url", "version", "hash"])])
        results.append([tuple(r) for out in changes._step(("u",), frames, _State()) for r in out.itertuples(index=False)])
    assert results[0] == results[1] == [("u", 1, "a", "ingested"), ("u", 1, "b", "updated"), ("u", 2, "a", "updated"), ("u", 2, "b", "updated")]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_is_exact(spark):
    """Against the full table: texts whose words pair up or not, that are empty, of one long word, beyond the BMP or missing."""
    r = random.Random(7)
    pick = lambda signs, n: "".join(r.choice(signs) for _ in range(r.randrange(n)))
    pairs = [(pick("abAB -.,_é", 40), pick("abAB -.,_é", 40)) for _ in range(150)]
    for _ in range(150):
        a = pick("abcABC  ,.-\U0001d54f", 120)
        b = "".join(c for c in a.lower() if r.random() > 0.05)
        pairs.append((a, b))
    pairs += [("", ""), ("", "a b"), ("a - b-c", "a b c"), ("x" * 90 + " y", "x" * 70 + "z y"), ("A B", "a b"), ("ab ba", "ba ab")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, (None, "a"), ("a", None)])], "id int, a string, b string")
    got = {x.id: x.d for x in df.select("id", score.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {i: _edits(a, b) for i, (a, b) in enumerate(pairs)} | {len(pairs): None, len(pairs) + 1: None}


def test_edit_distance_of_long_texts_is_linear(spark):
    """100,000 characters that differ in case and punctuation only: a band takes minutes."""
    df = spark.createDataFrame([("Word, other wo. " * 6_250,)], "a string").withColumn("b", F.regexp_replace(F.lower("a"), "[,.]", ""))
    began = time.time()
    assert df.select(score.edit_distance(F.col("a"), F.col("b"))).first()[0] == 3 * 6_250
    assert time.time() - began < 10


#: Queries over part, and how often a payload, a pattern or a path may be evaluated in the plan.
COSTLY = {"crossref_records": ("get_json_object", 30), "open_registries": ("get_json_object", 45), "loc_fields": ("regexp_extract", 15), "cip_fields": ("regexp_extract", 40), "tei_fields": ("xpath_string", 1), "reference_fields": ("regexp_extract", 30)}


@pytest.mark.parametrize("name", COSTLY)
def test_costly_expressions_are_dealt_and_bound(spark, sf, name):
    """A small file's rows go to all cores, and what is used often is computed once."""
    df = QUERIES[name].run(spark, sf)
    form, most = COSTLY[name]
    assert df._jdf.queryExecution().optimizedPlan().toString().count(f"{form}(") <= most
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_cip_of_a_text_with_control_signs(spark):
    """The signs that stand between groups inside may stand in the text as well."""
    block = "图书在版编目（CIP）数据\n书名：副题 / （美）诺曼著；李四译 .— 北京 : 某出版社, 2001.10"
    df = spark.createDataFrame([(0, block), (1, block + "\x01\x02"), (2, "\x02" + block)], "i int, t string")
    got = {r.i: [(f.field, f.value) for f in r.c] for r in df.select("i", C.cip(F.col("t")).alias("c")).collect()}
    assert got[0] == got[1] == got[2] == [("title", "书名"), ("subtitle", "副题"), ("authors", "诺曼"), ("translator", "李四"), ("place", "北京"), ("publisher", "某出版社"), ("year", "2001")]


def _found(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, quote string, text string")
    forms = [tuple(f(F.col(c)) for c in ("quote", "text")) for f in (T.compact, T.presented)]
    got = {r.i: r.at for r in df.select("i", gate.found_at(F.col("quote"), F.col("text"), *forms).alias("at")).collect()}
    return [got[i] for i in range(len(pairs))]


def test_found_at_counts_signs(spark):
    """A quote in compact form: its place counts code points, and each kind of white space."""
    pairs = [("bc", "a B C"), ("bc", "\U0001d54f\u3000a\t b\u200b c"), ("Cd", " \ufeff\nc D"), ("x", "abc"), ("a", "abc"), (None, "abc"), ("i\u0307x", "İx"), ("x-y", "w x\u2013y")]
    assert _found(spark, pairs) == [2, 5, 3, None, 0, None, 0, 2]


def test_found_at_is_linear(spark):
    """A text of 200,000 characters: taking each of them from the text's start takes minutes."""
    began = time.time()
    assert _found(spark, [("ENDHERE", "ab c " * 40_000 + "end here")]) == [200_000]
    assert time.time() - began < 10
