"""Mixing sources to target weights: repetition rates per source, whole copies per document.

Tokens are aggregated per source, the sources' targets are derived by water-filling,
and every document is emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy
with probability equal to the fraction. DataFrame functions only.

The draw hashes the id; a row without one is known by its text. Rows that are alike (same id,
source and text) would all draw alike, so they draw together: m of them get floor(m x rate)
copies plus one Bernoulli copy, dealt out evenly.

Edge cases: a null text counts 0 words; a null source is a source of its own (last in
code-point order); an empty table gives an empty result; a source without words has
target 0 and no copies; extra columns are ignored by ``rates`` and carried along by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairmine.llm.common import WORD, checked_broadcast, staged

WEIGHTS = (1, 2, 3)       # dealt to the sources in code-point order, repeating
MAX_REPEAT = 3            # a target stops at this multiple of its source's size
SEED = "mix"
REPEAT_CHUNK = 4096       # rows made from one row by one array
MAX_BROADCAST_SOURCES = 50_000   # rows of the per-source table that may be broadcast


def source_targets(sized: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): one row per source of ``sized`` (source, size).

    Water-filling: target = min(level x weight, max_repeat x size), with the level that
    makes the targets add up to all words. Sources sorted by the level at which they hit
    their limit: a source is at its limit when the level left to it and the later ones
    exceeds that. The windows run over one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("long")
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * max_repeat)
    by_limit = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("pos", F.row_number().over(by_limit))
    left = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    share = (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    per = per.withColumn("level", left.cast("double") / share.cast("double"))
    per = per.withColumn("full", F.col("level") * F.col("w") > F.col("cap"))
    # The first source below its limit fixes the level of all that follow.
    level = F.min(F.when(~F.col("full"), F.struct("pos", "level"))).over(everything)["level"]
    return per.select("source", "source_size",
                      F.when(F.col("full"), F.col("cap").cast("double"))
                      .otherwise(level * F.col("w")).alias("target"))


def seed_text(id_col, text_col):
    """What a row's draw hashes: its id, or the MD5 of its text when it has none."""
    return F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text_col, F.lit("")))))


def copies(rate, key, rows, seed: str = SEED, max_repeat: int = MAX_REPEAT):
    """Copies of ``rows`` rows that are alike: floor(rows x rate) plus one when the uniform hash
    of ``key`` falls below the fraction, at most ``max_repeat`` a row."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key, F.lit(seed))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    all_ = rows * rate
    whole = F.floor(all_)
    return F.least(whole + F.when(u < all_ - whole, 1).otherwise(0), rows * max_repeat).cast("long")


def repeated(df: DataFrame, n: str, index: str) -> DataFrame:
    """Every row ``n`` times (a BIGINT column), numbered from 1 by the column ``index``. Rows are
    made in chunks, so the longest array is small however often a row is repeated."""
    df = df.withColumn("_chunk", F.explode(F.expr(f"sequence(0L, ({n} - 1) div {REPEAT_CHUNK})")))
    inside = f"sequence(_chunk * {REPEAT_CHUNK} + 1, least({n}, (_chunk + 1) * {REPEAT_CHUNK}))"
    return df.withColumn(index, F.explode(F.expr(inside))).drop("_chunk")


def word_count(text_col):
    return F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")


def _narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key, h, m): one row per group of rows that are alike, m of them."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")
    one = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                      seed_text(F.col("doc_id"), F.col("text")).alias("key"), text)
    return staged(one.groupBy("doc_id", "source", "size", "key", "h").agg(F.count("*").alias("m")), "mix")


def _rate(max_repeat: int):
    return F.when(F.col("source_size") > 0,
                  F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(F.lit(0.0))


def rates(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies), one row per document.

    Only narrow rows are shuffled, pre-aggregated. A hot source costs nothing special: its
    words are summed map-side, and the per-source table is broadcast after its size is checked
    (beyond the bound the join shuffles, and adaptive execution splits the hot source)."""
    groups = _narrow(docs)
    sized = groups.select("source", (F.col("size") * F.col("m")).alias("size"))
    plan = staged(source_targets(sized, weights, max_repeat), "mixplan").withColumnRenamed("source", "_source")
    out = groups.join(checked_broadcast(plan, MAX_BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")))
    out = out.withColumn("rate", _rate(max_repeat))
    total = copies(F.col("rate"), F.col("key"), F.col("m"), seed, max_repeat)
    out = repeated(out.withColumn("total", total), "m", "k")
    dealt = F.expr("cast(total div m + CASE WHEN k <= total % m THEN 1 ELSE 0 END AS int)")
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", dealt.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every row of ``docs`` (all its columns) repeated ``copies`` times.

    Texts are not shuffled while the per-source table is within the broadcast bound. Rows that are
    alike are found by two hashes; only those are then counted by all their columns
    (pre-aggregated)."""
    alike_of = [F.col("doc_id"), F.col("doc_id").isNull(), F.col("source"), F.col("source").isNull(),
                F.coalesce(F.col("text"), F.lit(""))]
    hashes = {"_mix_a": F.xxhash64(*alike_of), "_mix_b": F.xxhash64(F.lit("second"), *alike_of)}
    narrow = staged(docs.select("source", word_count(F.col("text")).alias("size"),
                                *[h.alias(c) for c, h in hashes.items()]), "mix")
    plan = staged(source_targets(narrow, weights, max_repeat), "mixplan")
    plan = checked_broadcast(plan.select(F.col("source").alias("_mix_source"), _rate(max_repeat).alias("_mix_rate")),
                             MAX_BROADCAST_SOURCES)
    of_source = F.col("source").eqNullSafe(F.col("_mix_source"))
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def emitted(rows, count, key):
        n = copies(F.col("_mix_rate"), key, count, seed, max_repeat)
        out = rows.join(plan, of_source).withColumn("_mix_copies", n).filter("_mix_copies > 0")
        return repeated(out, "_mix_copies", "_mix_copy").select(*columns)

    key = seed_text(F.col("doc_id"), F.col("text"))
    alike = staged(narrow.groupBy(*hashes).count().filter("count > 1").select(*hashes), "mixalike")
    if alike.isEmpty():
        return emitted(docs, F.lit(1), key)
    keyed = docs.withColumns(hashes).withColumn("_mix_key", key)
    alike = checked_broadcast(alike, MAX_BROADCAST_SOURCES)
    single = keyed.join(alike, list(hashes), "left_anti")
    many = keyed.join(alike, list(hashes), "left_semi").groupBy("_mix_key", *columns).agg(F.count("*").alias("_mix_m"))
    # Rows of one id and text that differ elsewhere draw apart.
    apart = F.concat_ws(":", "_mix_key", F.xxhash64(*columns).cast("string"))
    return emitted(single, F.lit(1), F.col("_mix_key")).unionByName(emitted(many, F.col("_mix_m"), apart))
