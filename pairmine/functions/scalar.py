"""Scalar column expressions.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen. Parameters may be Python numbers (folded to literals) or columns (a
parameter grid joined onto the data).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values
# Characters Python's str.strip()/str.split() treat as whitespace (str.isspace):
# TAB, LF, VT, FF, CR, FS, GS, RS, US, SPACE, NEL, NO-BREAK SPACE,
# OGHAM SPACE MARK, EN QUAD .. HAIR SPACE (U+2000-U+200A), LINE SEPARATOR,
# PARAGRAPH SEPARATOR, NARROW NO-BREAK SPACE, MEDIUM MATHEMATICAL SPACE,
# IDEOGRAPHIC SPACE.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Epsilon added to the standard deviation of a local z-score, and the bound of z.
Z_EPS = 1e-8
Z_CLIP = 5.0
# Rank weights of the weighted rank score: rank 1, 2, 3, 4, 5 and beyond.
RANK_WEIGHTS = (1.0, 0.7, 0.5, 0.3, 0.1)
# Decimals similarities are rounded to before ranking (deterministic ties).
SIM_DECIMALS = 9
# ---------------------------------------------------------------------------


def _ws_class() -> str:
    """Java-regex character class of PY_WHITESPACE, written with \\uXXXX escapes."""
    return "[" + "".join(f"\\u{ord(c):04x}" for c in PY_WHITESPACE) + "]"


WS_CLASS = _ws_class()


def lit_or_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, lo, hi) -> Column:
    """bound x to [lo, hi]."""
    return F.least(F.greatest(x, lit_or_col(lo)), lit_or_col(hi))


def py_strip(text: Column) -> Column:
    """Python str.strip() on a string column (character-set trim, no regex)."""
    return F.trim(text, F.lit(PY_WHITESPACE))


def py_rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(PY_WHITESPACE))


def py_split(text: Column) -> Column:
    """Python str.split() with no argument: whitespace runs, no empty tokens."""
    return F.filter(F.split(text, f"{WS_CLASS}+"), lambda t: t != "")


def l2_similarity(dist: Column) -> Column:
    """1 / (1 + d)."""
    return F.lit(1.0) / (F.lit(1.0) + dist)


def combined_score(cosine: Column, l2: Column, cosine_weight=0.6, l2_weight=0.4) -> Column:
    """cw * cosine + lw * l2."""
    return lit_or_col(cosine_weight) * cosine + lit_or_col(l2_weight) * l2


def zscore(score: Column, mean: Column, std: Column) -> Column:
    """(s - mean) / (std + eps), clipped to [-5, 5]."""
    return clip((score - mean) / (std + F.lit(Z_EPS)), -Z_CLIP, Z_CLIP)


def adaptive_score(score: Column, z: Column, base_weight=0.6, z_weight=0.4) -> Column:
    """clip(bw * s + zw * clip(z / 3, -1, 1), 0, 1)."""
    return clip(lit_or_col(base_weight) * score
                + lit_or_col(z_weight) * clip(z / F.lit(3.0), -1.0, 1.0), 0.0, 1.0)


def density_from_avg(avg_sim: Column) -> Column:
    """clip(1 - (avg + 1) / 2, 0, 1)."""
    return clip(F.lit(1.0) - (avg_sim + F.lit(1.0)) / F.lit(2.0), 0.0, 1.0)


def density_bonus(density: Column, sparse_threshold, sparse_bonus) -> Column:
    return F.when(density > lit_or_col(sparse_threshold), lit_or_col(sparse_bonus)).otherwise(F.lit(0.0))


def density_penalty(density: Column, crowded_threshold, crowded_penalty) -> Column:
    return F.when(density < lit_or_col(crowded_threshold), lit_or_col(crowded_penalty)).otherwise(F.lit(0.0))


def rank_weight(rank: Column) -> Column:
    """1 -> 1.0, 2 -> 0.7, 3 -> 0.5, 4 -> 0.3, >= 5 -> 0.1, null -> 0."""
    w1, w2, w3, w4, w5 = RANK_WEIGHTS
    return (F.when(rank.isNull(), F.lit(0.0))
            .when(rank == 1, F.lit(w1)).when(rank == 2, F.lit(w2))
            .when(rank == 3, F.lit(w3)).when(rank == 4, F.lit(w4))
            .otherwise(F.lit(w5)))


def complement(x: Column) -> Column:
    """F8: round(1 - x, 2)."""
    return F.round(F.lit(1.0) - x, 2)


def pct(count: Column, total: Column) -> Column:
    """count / total * 100, 0 when total is 0."""
    return F.when(total > 0, count.cast("double") / total * F.lit(100.0)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """inner product of two numeric arrays, summed left to right in DOUBLE."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)


def l2_normalize(v: Column) -> Column:
    """unit length; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm)
                       .otherwise(F.lit(0.0)).cast("float"))


def truncate_to(arr: Column, n) -> Column:
    """first n elements (n >= 0)."""
    return F.slice(arr, 1, F.greatest(lit_or_col(n), F.lit(0)))


def pad_to(arr: Column, n, pad) -> Column:
    """right-pad with ``pad`` to length n (never negative padding)."""
    missing = F.greatest(lit_or_col(n) - F.size(arr), F.lit(0))
    return F.concat(arr, F.array_repeat(lit_or_col(pad).cast("long"), missing))
