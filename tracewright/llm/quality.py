"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Features of every whole text: words (``[^\\x20\\x09-\\x0D]+``), their characters, symbols, repeated lines, and words in
3-word windows found twice or more. Fixed base rules come first; the cutoffs of the other rules are learned from labelled
documents that pass them, stratum by stratum.

Method. Each rule has a list of cutoffs from lenient to strict. Step t of ``STEPS`` uses the rules together, each at the
share t / STEPS of its list, so the steps are nested: what a step rejects, every later one does. In a stratum with n good
holdout documents of which a step rejects k, the exact binomial tail P(X <= k), X ~ Bin(n, alpha), is the p-value of
"this step rejects more good documents than allowed". Steps are certified in their order while p <= delta / strata: testing
in a fixed order needs no correction within the list, and the Bonferroni share covers the strata. So with probability
1 - delta every stratum loses at most a share alpha of its good documents. Of the certified steps the one with the largest
surplus of bad over good rejections is used (the more lenient at equal surplus), none if no surplus is positive. Some
log(delta / strata) / log(1 - alpha) good documents are needed to certify anything, 217 for four strata; a stratum with
fewer has the base rules alone.

Defined cases. Null text: no words, so base_failed. Null stratum: a stratum of its own. Null quality or label without
document: ignored; a document with several labels counts once for each. No labels: base rules alone. Extra columns are
ignored (``accepted`` keeps them). Null doc_id: a row like others, without labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracewright.llm.storage import Scratch

SPACE = " \t\n\x0b\f\r"
STEPS = 24
#: Rule: (numerator, denominator, 1 to reject above the cutoff or -1 below, cutoffs in 1/10000 from lenient to strict).
RULES = {
    "symbols": ("n_symbols", "word_chars", 1, [5000, 3000, 2000, 1500, 1000, 800, 600, 400, 300, 200, 100, 50]),
    "repeats": ("n_repeat_words", "n_words", 1, [4500, 4000, 3500, 3000, 2500, 2000, 1500, 1000]),
    "lines": ("n_dup_lines", "n_words", 1, [1000, 500, 200, 100, 50]),
    "long_words": ("word_chars", "n_words", 1, [120000, 100000, 90000, 80000, 75000, 70000, 65000]),
    "short_words": ("word_chars", "n_words", -1, [20000, 25000, 30000, 35000, 38000, 40000, 42000]),
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more."""

    def gram(at: Column) -> Column:
        return F.xxhash64(F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))

    def places(ranked: Column) -> Column:
        same = lambda x, other: F.coalesce(x["h"] == other["h"], F.lit(False))
        twice = F.filter(ranked, lambda x, i: same(x, F.get(ranked, i - 1)) | same(x, F.get(ranked, i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(_let(ranked, lambda r: _let(places(r), total)))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - 3), gram)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(_let(grams, count))


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), text.alias("text"), words.alias("words"), lines.alias("lines"))
    df = df.select(
        "doc_id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _let(F.col("words"), _covered).alias("n_repeat_words"),
    )
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _level(rule: str) -> Column:
    """How many cutoffs of the rule's list reject a document."""
    top, bottom, sign, cutoffs = RULES[rule]
    over = [(sign * (10000 * F.col(top) - cut * F.col(bottom)) > 0).cast("int") for cut in cutoffs]
    return sum(over[1:], over[0])


def rejecting_step() -> Column:
    """The first step that rejects a document; STEPS + 1 if none does."""
    steps = []
    for rule, (*_, cutoffs) in RULES.items():
        n = len(cutoffs)
        steps.append(F.when(_level(rule) > 0, F.ceil((n + 1 - _level(rule)) * STEPS / n)).otherwise(STEPS + 1).cast("int"))
    return F.least(*steps)


def _log_gamma(x: Column) -> Column:
    """Stirling's series eight above x, taken back by recurrence; x >= 1, relative error below 1e-13."""
    y = x + 8
    down = sum((F.log(x + k) for k in range(1, 8)), F.log(x))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - down


def binomial_tail(k: Column, n: Column, share: float, terms: int = 4096) -> Column:
    """P(X <= k) for X ~ Bin(n, share), from the largest term down; what follows after so many terms is bounded above.

    For k at or above the mean the tail is no less than about a half, and 1 is returned.
    """
    log_top = _log_gamma(n + 1.0) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + k * math.log(share) + (n - k) * math.log1p(-share)
    ratio = lambda j: (k - j) / (n - k + j + 1) * ((1 - share) / share)  # noqa: E731  of term k-j-1 to term k-j
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, j: _let(a["term"] * ratio(j), lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum")))
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), F.least(k - 1, F.lit(terms - 1).cast("long")))).otherwise(F.array().cast("array<long>"))
    rest = F.when(k > terms, _let(ratio(F.lit(terms)), lambda r: r / (1 - r))).otherwise(0.0)
    total = F.aggregate(steps, start, step, lambda a: a["sum"] + a["term"] * rest)
    return F.when(k >= n * share, 1.0).otherwise(F.least(F.lit(1.0), F.exp(log_top) * total))


def cutoffs(found: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """stratum, limit: the certified step in use, for the strata that have one."""
    marks = labels.filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    held = marks.join(found.filter(~F.col("base_failed")), "doc_id")
    counts = held.groupBy("stratum", "step").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    # Each stratum is one row with at most STEPS + 1 steps from here on.
    per = counts.groupBy("stratum").agg(F.collect_list(F.struct("step", "good", "bad")).alias("at"), F.sum("good").alias("n"))
    strata = found.select("stratum").distinct().count()
    reject = lambda t, what: F.aggregate(F.filter("at", lambda x: x["step"] <= t), F.lit(0).cast("long"), lambda a, x: a + x[what])
    each = F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda t: F.struct(t.alias("step"), reject(t, "good").alias("good"), reject(t, "bad").alias("bad")))
    tested = per.select("stratum", "n", F.explode(each).alias("x")).select("stratum", "n", "x.*").withColumn("p", binomial_tail(F.col("good"), F.col("n"), alpha))
    so_far = W.partitionBy("stratum").orderBy("step")
    passed = tested.withColumn("worst", F.max("p").over(so_far)).filter(F.col("worst") <= delta / max(1, strata))
    best = W.partitionBy("stratum").orderBy((F.col("bad") - F.col("good")).desc(), "step")
    return passed.filter("bad > good").withColumn("r", F.row_number().over(best)).filter("r = 1").select("stratum", F.col("step").alias("limit"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The features of every document, base_failed, and kept; alpha, delta: see above."""
    scratch = Scratch(docs.sparkSession, "quality")
    found = scratch.keep(features(docs, stratum).withColumn("step", rejecting_step()), "features")
    chosen = scratch.keep(cutoffs(found, labels, alpha, delta), "cutoffs").withColumnRenamed("stratum", "_stratum")
    out = found.join(chosen, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.coalesce(F.col("step") <= F.col("limit"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~failed).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs that judge() keeps, with all their columns; rows with a null doc_id are judged by none and stay."""
    gone = judge(docs, labels, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
