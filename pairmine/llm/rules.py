"""Quality rules with risk-controlled thresholds.

Each rule is a ratio that is high for junk (symbols, repeated lines, repeated three-word
windows, capitals). The cutoffs are not set by hand but chosen per stratum (language) on the
labelled rows. The rules are tightened together, in a fixed sequence of levels; a level may be
used only if an exact binomial test shows that its rules together reject at most
``FALSE_REJECTION`` of the stratum's good documents. Levels are tested from the laxest on and
testing stops at the first that fails (fixed-sequence testing), so the sequence needs no
correction; the error probability ``DELTA`` is divided by the number of strata tested. The
strictest level that passes is used.

A stratum with too few good documents to pass any test, even without a false rejection, joins
the pooled stratum, which is tested as one and whose level holds for all that joined (the
guarantee is then one for their mixture). Whether a stratum joins depends on its number of
good documents only, never on what the rules reject. If the pool is too small as well, or its
first level fails, its strata keep the base rules alone. DataFrame functions only.

Edge cases: null text has no words; a null language is a stratum of its own; strata without a
good labelled document join nothing and keep the base rules; repeated labels of an id count once
(the better one); repeated rows each get a verdict; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmine.llm.common import SPACE, WORD, checked_broadcast, staged

FALSE_REJECTION = 0.04     # of the good documents of a stratum, over all rules
DELTA = 0.05               # probability that any of the guarantees fails
MAX_BROADCAST_STRATA = 50_000

# Rules: (name, ratio, cutoffs by level, from the laxest to the strictest).
RULES = [
    ("symbols", "n_symbols / greatest(n_words, 1)", (1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05)),
    ("dup_lines", "n_dup_lines / greatest(n_lines, 1)", (0.9, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", (0.45, 0.42, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    ("capitals", "n_capitals / greatest(word_chars, 1)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, stratum, counts...) per row; whole texts, inside one task per row.

    Words in repeated three-word windows: window hashes are sorted together with their
    position (packed into the low bits), equal neighbours mark both positions, and the
    marked windows' lengths are added up without overlap. O(n log n) in the words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"))
    d = d.select(
        "doc_id", "stratum",
        F.filter(F.split("text", SPACE, -1), lambda x: x != "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        (F.length("text") - F.regexp_count("text", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"))
    d = d.withColumns({"n_words": F.size("words").cast("long"), "n_lines": F.size("lines").cast("long")})
    d = d.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines")))
    d = d.withColumn("h", F.expr(
        "CASE WHEN n_words >= 3 THEN transform(sequence(0, cast(n_words AS int) - 3), "
        "i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))) END")).drop("words", "lines")
    # The low bits hold the position: m is the first power of two above the number of words.
    d = d.withColumn("m", F.expr("cast(pow(2, ceil(log2(n_words + 1))) AS bigint)"))
    d = d.withColumn("s", F.expr("sort_array(transform(h, (x, i) -> x - pmod(x, m) + i))"))
    d = d.withColumn("s", F.expr("transform(s, x -> cast(pmod(x, m) AS int))"))
    d = d.withColumn("e", F.expr("zip_with(s, slice(s, 2, greatest(size(s), 0)), (a, b) -> get(h, a) = get(h, b))"))
    d = d.withColumn("p", F.expr(
        "sort_array(filter(transform(s, (a, k) -> CASE WHEN get(e, k) OR (k > 0 AND get(e, k - 1)) THEN a END), "
        "x -> x IS NOT NULL))")).drop("h", "s", "e", "m")
    d = d.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(zip_with(p, slice(p, 2, greatest(size(p), 0)), (a, b) -> least(3, coalesce(b - a, 3))), "
        "0L, (acc, x) -> acc + x), 0L)")).drop("p")
    return d


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def log_binomial_cdf(n, k, p: float):
    """ln P(Bin(n, p) <= k) for k below the mean: the last term by recurrence in logs, the
    others relative to it."""
    odds = p / (1 - p)
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, n * F.lit(math.log1p(-p)), lambda a, i: a + F.log((n - i + 1) / i * F.lit(odds)))
    back = F.aggregate(F.reverse(steps), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                       lambda a, i: F.struct((a["t"] * i / ((n - i + 1) * F.lit(odds))).alias("t"),
                                             (a["s"] + a["t"] * i / ((n - i + 1) * F.lit(odds))).alias("s")))
    return last + F.log(back["s"])


def too_few(n, strata, limit: float = FALSE_REJECTION, delta: float = DELTA):
    """Whether ``n`` good documents could not pass the test of one of ``strata`` strata, even if
    none of them were rejected: (1 - limit)^n > delta / strata."""
    return n * F.lit(math.log1p(-limit)) > F.log(F.lit(delta) / strata)


def levels(good: DataFrame, rules=RULES, limit: float = FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """(stratum, tested, n, level): the strictest certified level of each stratum with good
    documents (null: none), from the features of documents labelled good that pass the base
    rules. ``tested`` is what it was tested as, null for the pool, and ``n`` its good documents."""
    n_levels = len(rules[0][2])
    if any(len(grid) != n_levels for _, _, grid in rules):
        raise ValueError("all rules need a cutoff for every level")
    over = [F.count(F.when(F.expr(" OR ".join(f"{ratio} > CAST({grid[j]!r} AS DOUBLE)" for _, ratio, grid in rules)), 1))
            for j in range(n_levels)]
    # One row per stratum from here on.
    per = good.groupBy("stratum").agg(F.count("*").alias("n"), *[c.alias(f"k{j}") for j, c in enumerate(over)])
    per = per.withColumn("strata", F.count("*").over(Window.partitionBy()))
    per = per.withColumn("tested", F.when(~too_few(F.col("n"), F.col("strata"), limit, delta), F.col("stratum")))
    members = per.select("stratum", "tested")
    tested = per.groupBy("tested").agg(F.sum("n").alias("n"), *[F.sum(f"k{j}").alias(f"k{j}") for j in range(n_levels)])
    tested = tested.withColumn("tests", F.count("*").over(Window.partitionBy()))
    long = tested.select("tested", "n", "tests", F.posexplode(F.array(*[f"k{j}" for j in range(n_levels)])).alias("level", "k"))
    n, k = F.col("n").cast("double"), F.col("k")
    passed = F.when(k < n * limit, log_binomial_cdf(n, k, limit) <= F.log(F.lit(delta) / F.col("tests"))).otherwise(False)
    upto = Window.partitionBy("tested").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    best = (long.withColumn("passed", passed).withColumn("passed", F.min("passed").over(upto))
            .groupBy("tested", "n").agg(F.max(F.when(F.col("passed"), F.col("level"))).alias("level"))
            .withColumnRenamed("tested", "_tested"))
    return members.join(best, F.col("tested").eqNullSafe(F.col("_tested"))).select("stratum", "tested", "n", "level")


def apply_rules(docs: DataFrame, labels: DataFrame, rules=RULES, limit: float = FALSE_REJECTION,
                delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, failed_rules) for every row of ``docs``."""
    f = staged(features(docs).withColumn("base_failed", base_failed()), "rules")
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = f.join(marked.filter("quality = 1"), "doc_id", "left_semi").filter(~F.col("base_failed"))
    cut = levels(good, rules, limit, delta).select("stratum", "level")
    cut = checked_broadcast(staged(cut, "cutoffs"), MAX_BROADCAST_STRATA)
    cutoff = lambda grid: F.get(F.array(*[F.lit(float(c)) for c in grid]), F.col("level"))
    over = F.filter(F.array(*[F.when(F.expr(ratio) > cutoff(grid), F.lit(name)) for name, ratio, grid in rules]),
                    lambda x: x.isNotNull())
    out = f.join(cut, "stratum", "left").withColumn("failed_rules", over)
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", kept.alias("kept"), "failed_rules")
