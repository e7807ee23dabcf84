"""Column expressions on literal cases."""

from pyspark.sql import functions as F

from docforge.functions import ident as I
from docforge.functions import python as P
from docforge.functions import text as T
from docforge.operators import evidence, extend, library, match, score, sequential, structure, zones
from docforge.sources import files


def one(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "c string")
    return [r[0] for r in df.select(f(F.col("c"))).collect()]


def test_canonical_is_idempotent(spark):
    got = one(spark, ["  a \t b\r\nc  ", "", None], T.canonical)
    assert got == ["a b\nc", "", ""]
    assert one(spark, got, T.canonical) == got


def test_paragraphs(spark):
    assert one(spark, ["a  b\n\n c \n\n\n"], T.paragraphs) == [["a b", "c"]]


def test_doi(spark):
    cases = {"https://doi.org/10.1234/ABC.": "10.1234/abc", "doi: 10.1000/x(1)).": "10.1000/x(1)", "see 10.5555/q;": "10.5555/q", "none": None, "10.1/x": None}
    assert one(spark, list(cases), I.doi) == list(cases.values())


def test_isbn(spark):
    cases = {"978-0-306-40615-7": "9780306406157", "0-306-40615-2": "9780306406157", "080442957X": "9780804429573", "9780306406158": None, "abc": None}
    assert one(spark, list(cases), I.isbn13) == list(cases.values())


def test_roman(spark):
    assert one(spark, ["mdccccxlix", "MCMXCIV", "iv"], I.roman_value) == [1949, 1994, 4]


def test_dates(spark):
    cases = {"2020年3月5日": "2020-3-5", "2020-03-05": "2020-3-5", "March 5, 2020": "2020-3-5", "5 March 2020": "2020-3-5", "2020-03": "2020-3", "March 2020": "2020-3", "c. 1999": "1999", "no": None}
    assert one(spark, list(cases), I.date_parts) == list(cases.values())


def test_page_list(spark):
    df = spark.createDataFrame([("1-5, -3", 10), ("0-3", 10), ("7", 5), ("x", 5), ("3-1", 9)], "c string, n int")
    assert [r[0] for r in df.select(I.page_list(F.col("c"), F.col("n"))).collect()] == [[1, 2, 3, 4, 5, 8, 9, 10], [1, 2, 3], [], [], []]


def test_splits(spark):
    df = spark.createDataFrame([("New York : Knopf",), ("Random House, Inc., New York",), ("Oxford, Oxford University Press",), ("plain",)], "c string")
    a, b = I.split_publisher(F.col("c"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("New York", "Knopf"), (None, None), ("Oxford", "Oxford University Press"), (None, None)]
    df = spark.createDataFrame([("A: bcd",), ("A:bcd",), ("题：副标题",), ("A: b",)], "c string")
    a, b = I.split_title(F.col("c"))
    assert [tuple(r) for r in df.select(a, b).collect()] == [("A", "bcd"), (None, None), ("题", "副标题"), (None, None)]


def test_urls(spark):
    cases = {"http://x.org/a?utm_source=f&id=3#top": "http://x.org/a?id=3#top", "https://x.org/a?ref=1": "https://x.org/a", "https://x.org/a": "https://x.org/a"}
    assert one(spark, list(cases), I.without_tracking) == list(cases.values())
    cases = {"https://youtu.be/x": "media", "https://a.org/b.pdf": "digital_pdf", "ftp://a/b": "unsupported", "http://localhost/x": "unsupported", "https://a.org/b": "url_article"}
    assert one(spark, list(cases), I.resource_type) == list(cases.values())


def test_only_public_urls_are_routed(spark):
    bad = ["http://10.0.0.1/a", "http://192.168.1.9/a.pdf", "https://169.254.169.254/x", "http://[::1]/x", "https://[fd00::1]/x", "http://user:pw@a.org/x", "http://@a.org/x", "http://localhost.localdomain/x", "http://LOCALHOST./x", "http://0.0.0.0/x", "http://[::1/x"]
    good = ["http://8.8.8.8/x", "https://[2606:4700::1]/x", "https://10.example.org/x"]
    assert one(spark, bad + good, I.resource_type) == ["unsupported"] * len(bad) + ["url_article"] * len(good)


def test_operators_that_no_query_does_are_not_claimed():
    from docforge.plans import document_queries, record_queries, rule_queries  # noqa: F401
    from docforge.plans.registry import QUERIES

    claimed = {o for q in QUERIES.values() for o in q.operators}
    assert not claimed & {"G05", "J20", "S14", "W16", "S09"}


def test_times(spark):
    df = spark.createDataFrame([(59.9,), (61.0,), (3661.0,)], "c double")
    assert [r[0] for r in df.select(T.timestamp_label(F.col("c"))).collect()] == ["00:59", "01:01", "01:01:01"]


def test_imprints(spark):
    cases = {"Oxford University Press": True, "CISTERCIAN PUBLICATIONS KALAMAZOO, MICHIGAN": True, "北京：商务印书馆": True, "Printed by Some Press": False, "just a line": False}
    assert one(spark, list(cases), zones.is_imprint) == list(cases.values())


def test_ladder(spark):
    df = spark.createDataFrame([("exact", "title", "title"), ("exact", "title", "body"), ("exact", "page", "body"), ("exact", "title", "running_head"), ("joined", "title", None)], "r string, f string, z string")
    assert [r[0] for r in df.select(evidence.confidence(F.col("r"), F.col("f"), F.col("z"))).collect()] == [0.95, 0.80, 0.95, 0.60, 0.85]


def test_similarity(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(P.sequence_ratio("a", "b")).collect()] == [0.75, 0.0, None]
    assert one(spark, ["Ĵosé"], lambda c: match.name_tokens(c)) == [["ĵosé"]]
    assert [r[0] for r in spark.createDataFrame([("José",)], "c string").select(P.folded("c")).collect()] == ["jose"]


def test_wilson_bounds(spark):
    df = spark.createDataFrame([(0, 0), (0, 10), (10, 10), (5, 10)], "k int, n int")
    low, high = score.wilson(F.col("k"), F.col("n"))
    got = [tuple(r) for r in df.select(low, high).collect()]
    assert got[0] == (None, None) and got[1][0] == 0.0 and got[2][1] == 1.0 and 0.23 < got[3][0] < 0.24


def test_word_errors(spark):
    df = spark.createDataFrame([(1, "a b c", "a x c d"), (2, "a", "")], "id long, gold string, pred string")
    got = {r.id: (r.word_edits, r.gold_words, round(r.wer, 3)) for r in score.error_rates(df).collect()}
    assert got == {1: (2, 3, 0.667), 2: (1, 1, 1.0)}


def test_chunks(spark):
    df = spark.createDataFrame([(1, i, float(t)) for i, t in enumerate([0, 30, 59, 61, 100, 121, 200])], "k long, i long, at double")
    got = {r.i: r.chunk_no for r in structure.folded_chunks(df, "k", "i", "at", 60).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 3}


def test_split_is_complete(spark):
    df = spark.createDataFrame([("s", f"f{i % 9}", i) for i in range(60)], "stratum string, family string, id long")
    got = sequential.split_groups(df).collect()
    assert len(got) == 9 and sum(r.n for r in got) == 60 and {r.split for r in got} == set(sequential.TARGETS)


def test_citation_and_lookup(spark):
    df = spark.createDataFrame([("A", "T", None, "P", "Pub", "2001", None), (None, "T", None, None, None, None, None)], "a string, t string, c string, p string, b string, y string, u string")
    got = [r[0] for r in df.select(library.citation(*[F.col(c) for c in "atcpbyu"])).collect()]
    assert got == ["A. *T*. P：Pub, 2001.", "Unknown. *T*. n.d.."]
    assert df.where(library.matches_id(F.lit(" PUB "), F.col("b"), F.col("a"))).count() == 1


def test_extensions(spark):
    extend.register("twice", lambda df: df.select((F.col("x") * 2).alias("y")), ("y",))
    assert [r.y for r in extend.apply("twice", spark.createDataFrame([(1,)], "x int")).collect()] == [2]
    assert extend.NoExtractor().extract(spark.createDataFrame([(1,)], "doc_id long")).count() == 0


def test_files(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1}\n{"id": 2')
    rows = files.json_lines(spark, str(p), "id long").collect()
    assert sorted((r.id or 0, r.corrupt is not None) for r in rows) == [(0, True), (1, False)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.xml").write_text('<TEI xmlns="u"><titleStmt><title>T</title></titleStmt></TEI>')
    assert files.tei_headers(spark, str(tmp_path / "t")).first().title == "T"
    assert files.sources(spark, str(p)).first().bytes == len(p.read_bytes())
    df = spark.createDataFrame([(1, 2, 3)], "csl int, blocks int, merkle int")
    assert files.projected(df, "csl_only").columns == ["csl"]
