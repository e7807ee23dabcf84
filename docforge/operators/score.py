"""Scoring of predictions against gold: honest denominators, intervals, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions.text import NOT_WORD_OR_LOW_LINE, bound

Z95 = 1.959963984540054


def latest(attempts: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last attempt of each key."""
    by = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    return attempts.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def pending(rows: DataFrame, last: DataFrame, key: str, retry_failed: bool = True) -> DataFrame:
    """Rows without a last attempt that is ok (F15); without ``retry_failed``, rows without any attempt."""
    done = last.where("status = 'ok'") if retry_failed else last
    return rows.join(done.select(key).distinct(), key, "left_anti")


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval (A06); null without trials, exact at 0 and 1."""
    p, z2 = hits / n, Z95 * Z95
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    low = F.when(n == 0, None).when(hits <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half))
    high = F.when(n == 0, None).when(hits >= n, 1.0).otherwise(F.least(F.lit(1.0), centre + half))
    return low, high


def field_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 (A05, J06): a wrong value counts as fp and as fn.

    Columns: the keys, gold, predicted (null where absent).
    """
    hit = F.col("gold").isNotNull() & F.col("predicted").isNotNull() & (F.col("gold") == F.col("predicted"))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    c = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), one(hit).alias("tp"), one(~hit & F.col("predicted").isNotNull()).alias("fp"), one(~hit & F.col("gold").isNotNull()).alias("fn"))
    rate = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("*", rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def presence_split(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Both, a only, b only, and agreement over both."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    x, y = F.col("a").isNotNull(), F.col("b").isNotNull()
    return j.agg(one(x & y).alias("n_both"), one(x & ~y).alias("a_only"), one(~x & y).alias("b_only"), one(x & y & (F.col("a") == F.col("b"))).alias("n_agree"))


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles at round((n - 1) q), halves to even, of each key (A10).

    Equal values are counted first, and ranks are running sums of these counts: no list of all values is gathered.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(key)
    ranked = counted.withColumn("upto", F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(own))
    return ranked.groupBy(key).agg(*(F.min(F.when(F.col("upto") > F.bround((F.col("total") - 1) * F.lit(q)), F.col(value))).alias(name) for name, q in shares.items()))


#: Words of more characters are not compared one by one.
LONGEST_WORD = 64


def _most_edits(a: Column, b: Column) -> Column:
    """Edits that make two texts equal, word by word and gap by gap, or null where their words don't pair up: no fewer than the edit distance."""
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))  # noqa: E731 - so that both begin and end with a gap
    one = lambda x, y: F.when(x == y, 0).when(F.greatest(F.length(x), F.length(y)) <= LONGEST_WORD, F.levenshtein(x, y))
    cut = lambda pattern: bound(F.struct(F.split(padded(a), pattern).alias("x"), F.split(padded(b), pattern).alias("y")), lambda p: F.when(F.size(p.x) == F.size(p.y), F.aggregate(F.zip_with(p.x, p.y, one), F.lit(0), lambda n, d: n + d)))
    return cut(NOT_WORD_OR_LOW_LINE) + cut(r"[\p{L}\p{N}_]+")


def _least_edits(a: Column, b: Column) -> Column:
    """Characters that one text has and the other lacks, each as often as it does: no more than the edit distance."""
    times = lambda c, x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
    lacking = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, x: n + F.greatest(F.lit(0), times(a, x) - times(b, x)))
    return lacking + F.greatest(F.lit(0), F.length(b) - F.length(a))


def edit_distance(a: Column, b: Column) -> Column:
    """Edit distance. Two bounds take linear time; where they meet it is known, else it is sought in a band around the diagonal as wide as the upper one.

    Texts whose words don't pair up: in a band an eighth and then a third of the length wide, and in full only beyond.
    """
    longer = F.greatest(F.length(a), F.length(b))
    within = lambda width: F.call_function("levenshtein", a, b, width.cast("int"))
    wider = lambda: bound(within(longer / 3 + 4), lambda two: F.when(two >= 0, two).otherwise(F.levenshtein(a, b)))
    banded = bound(within(longer / 8 + 4), lambda one: F.when(one >= 0, one).otherwise(wider()))
    known = lambda most: F.when(most.isNotNull() & (most == _least_edits(a, b)), most).when(most <= longer / 3 + 4, within(most)).otherwise(banded)
    return bound(_most_edits(a, b), known)


def error_rates(pairs: DataFrame) -> DataFrame:
    """Character and word edit rates of (id, gold, pred) (X20, H19): edits, cer, word_edits, wer, passed.

    Words are mapped to single characters of a pair's own list, so the built-in edit distance counts them.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    known = F.array_distinct(F.concat(words(F.col("gold")), words(F.col("pred"))))
    coded = lambda c: F.array_join(F.transform(words(c), lambda w: _letter(F.array_position(F.col("known"), w))), "")
    p = pairs.withColumn("known", known).withColumn("gw", coded(F.col("gold"))).withColumn("pw", coded(F.col("pred")))
    p = p.select("id", "gold", "pred", "gw", "pw", edit_distance(F.col("gold"), F.col("pred")).cast("long").alias("edits"), edit_distance(F.col("gw"), F.col("pw")).cast("long").alias("word_edits"))
    rate = lambda e, n, out: F.when(n == 0, F.when(out == 0, 0.0).otherwise(1.0)).otherwise(e / n)
    r = p.select("id", F.length("gold").cast("long").alias("gold_chars"), "edits", rate(F.col("edits"), F.length("gold"), F.length("pred")).alias("cer"), F.length("gw").cast("long").alias("gold_words"), "word_edits", rate(F.col("word_edits"), F.length("gw"), F.length("pw")).alias("wer"))
    return r.withColumn("passed", F.col("cer") <= 0.10)


def _letter(i: Column) -> Column:
    """The i-th character of the CJK block (up to 20,000 distinct words of a pair)."""
    n = i + 0x4E00
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    return F.decode(F.unhex(F.concat(byte(F.floor(n / 4096) + 224), byte(F.floor(n / 64) % 64 + 128), byte(n % 64 + 128))), "UTF-8")


def error_summary(rates: DataFrame) -> DataFrame:
    """Means, medians, weighted rates and the passing share with its interval."""
    s = rates.agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("mean_cer"), F.median("cer").alias("median_cer"), (F.sum("edits") / F.sum("gold_chars")).alias("weighted_cer"), F.avg("wer").alias("mean_wer"), (F.sum("word_edits") / F.sum("gold_words")).alias("weighted_wer"), F.sum(F.when(F.col("passed"), 1).otherwise(0)).cast("long").alias("n_passed"))
    low, high = wilson(F.col("n_passed"), F.col("n"))
    return s.select("*", (F.col("n_passed") / F.col("n")).alias("pass_rate"), low.alias("low"), high.alias("high"))


def disagreement_patterns(pairs: DataFrame) -> DataFrame:
    """Five detectors over records on which two sides differ, and those that none explains (A15): pattern, n, example (least id).

    Columns: id, and for each side a_ and b_: title, publisher, author (plain lower case or not), issued (parts joined by -).
    A record may fit several detectors.
    """
    low = lambda c: F.lower(F.col(c))
    a, b = low("a_title"), low("b_title")
    inside = lambda p, n: (F.length(p) >= 3) & (p != n) & (F.instr(n, p) > 0)
    parts = lambda c: F.split(F.col(c), "-")
    words = lambda c: F.filter(F.split(low(c), r"[\s,]+"), lambda w: w != "")
    base = lambda t: F.trim(F.split(t, r":\s|：", 2)[0])
    tests = {
        "publisher_in_author": F.coalesce(inside(low("a_publisher"), low("b_author")), F.lit(False)) | F.coalesce(inside(low("b_publisher"), low("a_author")), F.lit(False)),
        "title_prefix": (a != b) & (F.least(F.length(a), F.length(b)) >= 3) & (a.startswith(b) | b.startswith(a)),
        "date_precision": (parts("a_issued")[0] == parts("b_issued")[0]) & (F.size(parts("a_issued")) != F.size(parts("b_issued"))),
        "name_order": (F.size(words("a_author")) >= 2) & (words("a_author") != words("b_author")) & (F.array_sort(words("a_author")) == F.array_sort(words("b_author"))),
        "subtitle_split": (a != b) & (base(a) != "") & (base(a) == base(b)),
    }
    flags = pairs.select("id", *(F.coalesce(c, F.lit(False)).alias(n) for n, c in tests.items()))
    flags = flags.withColumn("unexplained", ~F.greatest(*tests))
    each = flags.select("id", F.explode(F.map_from_arrays(F.array(*map(F.lit, [*tests, "unexplained"])), F.array(*tests, "unexplained"))).alias("pattern", "hit"))
    return each.groupBy("pattern").agg(F.count_if("hit").alias("n"), F.min(F.when(F.col("hit"), F.col("id"))).alias("example"))
