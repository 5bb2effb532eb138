"""Quality classifier by co-training of a text view and a metadata view.

The text view sees only the content (character classes, repetition, word and line
shapes); the metadata view only what is recorded about the page (source, language,
length). Both are logistic regressions. In every round each view labels the pool
documents it is most sure of for the other view; a class gets as many pseudo-labels as
its share among the labelled rows allows. Both views are then calibrated on a fold that
neither has seen, and combined by a logistic function of their calibrated scores.

Fitting is on bounded samples (``TRAIN_ROWS`` labelled, ``POOL_ROWS`` unlabelled rows,
smallest id hashes first); all documents are scored, whole texts.

Edge cases: null text is empty, null metadata is a value of its own; without labels of
both classes every document scores 0.5 and is kept; repeated labels of an id count once;
repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.llm.toxicity import FOLDS, fold_of, logistic_fit

TRAIN_ROWS = 8_000
POOL_ROWS = 8_000
ROUNDS = 5
SHARE = 0.03            # of the pool that a view labels per round
SURE = 0.9              # calibrated confidence a pseudo-label needs
SOURCE_CELLS, LANG_CELLS = 64, 16

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def text_features(text: str | None) -> list[float]:
    """Ratios that describe a whole text, each in a bounded range."""
    data = (text or "").encode()
    n = max(len(data), 1)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    nw = max(len(words), 1)
    lines = [x for x in data.split(b"\n") if x.strip()]
    nl = max(len(lines), 1)
    symbols = count[_SYMBOLS].sum()
    pairs = len(set(zip(words, words[1:])))
    return [
        min(symbols / nw, 2.0), min(count[ord("|")] / nw, 1.0), min(count[ord("!")] / nw, 2.0),
        min(count[65:91].sum() / n * 4, 4.0), count[48:58].sum() / n * 4, min(count[ord(".")] / nw, 1.0),
        min(count[ord(",")] / nw, 1.0), min(n / nw / 10.0, 5.0), len(set(words)) / nw, pairs / nw,
        1 - len(set(lines)) / nl, min(np.log1p(nw) / 5.0, 4.0), min(nl / nw * 5, 5.0),
        float(nw < 50), float(nw < 15), float(count[128:].sum() / n),
    ]


N_TEXT = 16


def _cell(value, cells: int) -> int:
    return zlib.crc32(("" if value is None else "=" + str(value)).encode()) % cells


def views(text, lang, source, n_chars) -> tuple[np.ndarray, np.ndarray]:
    """Design matrices (with intercept) of the text and the metadata view."""
    n = len(text)
    t = np.ones((n, 1 + N_TEXT))
    m = np.zeros((n, 3 + SOURCE_CELLS + LANG_CELLS))
    m[:, 0] = 1
    for i, (a, b, c, d) in enumerate(zip(text, lang, source, n_chars)):
        t[i, 1:] = text_features(a)
        size = 0.0 if d is None or d != d else max(float(d), 0.0)
        m[i, 1], m[i, 2] = np.log1p(size) / 10, np.log1p(size) ** 2 / 100
        m[i, 3 + _cell(c, SOURCE_CELLS)] = 1
        m[i, 3 + SOURCE_CELLS + _cell(b, LANG_CELLS)] = 1
    return t, m


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def co_train(t, m, y, known, calib):
    """Coefficients of both views and their combination. ``known`` and ``calib`` mark rows
    with labels used for fitting and for calibration; the others are the pool."""
    labels = [np.where(known, y, -1.0), np.where(known, y, -1.0)]
    xs = [t, m]
    pool = ~known & ~calib
    good = y[known].mean()
    coef, platt = [None, None], [None, None]
    for turn in range(ROUNDS + 1):
        for v in (0, 1):
            has = labels[v] >= 0
            coef[v] = logistic_fit(xs[v][has], labels[v][has])
            z = xs[v][calib] @ coef[v]
            platt[v] = logistic_fit(np.column_stack([np.ones(len(z)), z]), y[calib], 0.1)
        if turn == ROUNDS:
            break
        for v in (0, 1):
            other = 1 - v
            open_ = np.nonzero(pool & (labels[other] < 0))[0]
            p = _sigmoid(platt[v][0] + platt[v][1] * (xs[v][open_] @ coef[v]))
            k = SHARE * len(np.nonzero(pool)[0])
            for value, conf, share in ((1.0, p, good), (0.0, 1 - p, 1 - good)):
                pick = np.argsort(-conf, kind="stable")[:int(np.ceil(k * share))]
                pick = pick[conf[pick] >= SURE]
                labels[other][open_[pick]] = value
    # Both calibrated views, combined on the calibration fold.
    p = [_sigmoid(platt[v][0] + platt[v][1] * (xs[v][calib] @ coef[v])) for v in (0, 1)]
    both = logistic_fit(np.column_stack([np.ones(int(calib.sum())), _logit(p[0]), _logit(p[1])]), y[calib], 0.1)
    return [np.round(c, 9) for c in (*coef, *platt, both)]


def sample(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS) -> DataFrame:
    """(doc_id, fold, y or null, text, lang, source, n_chars) of bounded samples."""
    marked = (labels.filter("doc_id is not null and quality is not null").groupBy("doc_id")
              .agg(F.max("quality").cast("int").alias("y")))
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ids = ids.join(marked, "doc_id", "left").withColumn("fold", fold_of(F.col("doc_id"))).filter("fold <> 0")
    order = [F.xxhash64("doc_id", F.lit("quality")), F.col("doc_id")]
    chosen = (ids.filter("y is not null").orderBy(*order).limit(train_rows)
              .unionByName(ids.filter("y is null").orderBy(*order).limit(pool_rows)))
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    return cols.join(F.broadcast(chosen), "doc_id")


class Model:
    def __init__(self, parts):
        self.parts = None if parts is None else [p.tolist() for p in parts]

    def udf(self):
        parts = self.parts

        @F.pandas_udf("score double, text_score double, meta_score double")
        def quality(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
            if parts is None or not len(text):
                return pd.DataFrame({c: np.full(len(text), 0.5) for c in ("score", "text_score", "meta_score")})
            ct, cm, pt, pm, both = (np.array(p) for p in parts)
            t, m = views(text, lang, source, n_chars)
            a, b = _sigmoid(pt[0] + pt[1] * (t @ ct)), _sigmoid(pm[0] + pm[1] * (m @ cm))
            return pd.DataFrame({"score": _sigmoid(both[0] + both[1] * _logit(a) + both[2] * _logit(b)),
                                 "text_score": a, "meta_score": b})

        return quality


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS) -> Model:
    def measure(batches):
        import pyarrow as pa

        for b in batches:
            t, m = views(*(b.column(i).to_pylist() for i in range(3, 7)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(list(t)), pa.array(list(m))],
                names=["doc_id", "fold", "y", "t", "m"])

    rows = sample(docs, labels, train_rows, pool_rows).select(
        "doc_id", F.col("fold").cast("int").alias("fold"), "y", "text", "lang", "source", F.col("n_chars").cast("double"))
    # Bounded by the two sample sizes; features only, no texts.
    pdf = (rows.mapInArrow(measure, "doc_id long, fold int, y int, t array<double>, m array<double>")
           .dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id"))
    y = pdf["y"].to_numpy(dtype=float, na_value=np.nan)
    labelled = ~np.isnan(y)
    calib = labelled & (pdf["fold"].to_numpy() == FOLDS - 1)
    known = labelled & ~calib
    if any(len(np.unique(y[s])) < 2 for s in (calib, known)):
        return Model(None)
    return Model(co_train(np.array(pdf["t"].tolist()), np.array(pdf["m"].tolist()), y, known, calib))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, kept, text_score, meta_score) for every row."""
    s = model.udf()(F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("double"))
    out = docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), s.alias("s"))
    return out.select("doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
                      (F.col("s.score") >= 0.5).alias("kept"), "s.text_score", "s.meta_score")
