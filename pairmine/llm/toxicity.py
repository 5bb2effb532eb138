"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts and lexicon are folded alike: compatibility forms (mathematical and full-width letters,
ligatures) to their plain letters, accents and invisible format characters away, lower case,
homoglyphs of other scripts to the Latin letters they imitate, digit and sign substitutions
to letters (0 o, 1 i, 3 e, $ s, @ a, ...; l counts as i, since 1 stands for both), single letters
that are spelled out with dots, dashes or stars between them to a word, other marks to spaces. The lexicon holds words and word
beginnings with weights: the log odds of their document frequency in toxic against other
training documents, and a prior list. All entries and the exception phrases are matched
in one pass; a hit inside an exception phrase does not count. A text's score is a
logistic function of its weighted hits, in total and normalised by length.

Learning uses a bounded, documented number of labelled rows (``TRAIN_ROWS``, smallest id
hashes first) outside the held-out fold: the lexicon from three of the four training
folds, the logistic function from the fourth. Only the text enters a score.

Edge cases: null or empty text gets the score of a text without hits; rows without an id
are held out of learning and scored; without usable labels the prior list and fixed
coefficients are used; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmine.process_cache import process_latest

TRAIN_ROWS = 12_000     # labelled rows used for learning, at most
FOLDS = 5               # crc32(doc_id) mod 5; fold 0 is held out
MIN_DOCS = 5            # toxic training documents that hold an entry, at least
MIN_LOG_ODDS = 2.5
MAX_ENTRIES = 4_000     # learned entries, at most (highest weight first)
PREFIX = range(4, 13)   # lengths of word beginnings that may become entries
PRIOR_WEIGHT = 4.0
SATURATE = 60.0

# Common insults of the prior list.
PRIOR = ["asshole", "bastard", "bitch", "clown", "cretin", "dimwit", "disgusting", "dumbass", "fuck", "idiot",
         "imbecile", "loser", "moron", "pathetic", "scum", "shit", "stupid", "trash", "vermin", "worthless"]

# Phrases in which a lexicon word is harmless.
EXCEPTIONS = ["class clown", "clown fish", "rodeo clown", "trash can", "trash bin", "trash bag", "pond scum",
              "sore loser award", "idiot proof", "shit take"]

# Letters of other scripts by the Latin letter they imitate.
HOMOGLYPHS = {
    "a": "аαａ", "b": "Ьвｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "f": "ｆ", "g": "ɡｇ", "h": "һｈ",
    "i": "іιıｉ", "j": "јｊ", "k": "кκｋ", "l": "ӏⅼｌ", "m": "мｍ", "n": "ոｎ", "o": "оοσｏ", "p": "рρｐ",
    "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ", "u": "υսｕ", "v": "νѵｖ", "w": "ԝｗ", "x": "хχｘ",
    "y": "уγｙ", "z": "ᴢｚ",
}
# Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}


def _table() -> dict[int, str]:
    table = {i: " " for i in range(128) if not chr(i).isalnum()}
    table |= {ord(c): " " for c in "2690 «»“”‘’–—…"}
    table |= {ord(g): letter for letter, glyphs in HOMOGLYPHS.items() for g in glyphs}
    table |= {ord(d): letter for d, letter in DIGITS.items()}
    return {k: "i" if v == "l" else v for k, v in table.items()} | {ord("l"): "i"}


_FOLD = _table()


# Accents, zero-width and other format characters, which are dropped.
_DROPPED = {i: None for i in range(0x110000) if unicodedata.category(chr(i)) in ("Mn", "Me", "Cf")}
# Signs that stand for a letter inside or at the beginning of a word.
_SIGNS = [(re.compile(r"\$(?=[a-z$])|(?<=[a-z])\$"), "s"), (re.compile(r"@(?=[a-z])"), "a"),
          (re.compile(r"(?<=[a-z])!(?=[a-z])"), "i")]
_SPELLED = re.compile(r"(?<![a-z0-9])(?:[a-z0-9$@!][.\-_*]){2,}[a-z0-9$@!](?![a-z0-9])")
_BETWEEN = re.compile(r"[.\-_*]")


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text).translate(_DROPPED)
    text = _SPELLED.sub(lambda m: _BETWEEN.sub("", m[0]), text.lower())
    for sign, letter in _SIGNS:
        text = sign.sub(letter, text)
    return text.translate(_FOLD)


class Matcher:
    """Aho-Corasick automaton of folded entries (anchored at word starts) and exceptions."""

    def __init__(self, entries: list[tuple[str, float]], exceptions=EXCEPTIONS):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for e, weight in entries:       # "word " is a whole word, "word" a beginning
            self.auto.add_word(" " + e, (len(e) + 1, weight))
        for e in exceptions:
            e = " " + " ".join(fold(e).split()) + " "
            self.auto.add_word(e, (len(e), None))
        self.auto.make_automaton()

    def features(self, text: str | None) -> tuple[float, float, float]:
        """(weight of the hits, hits, words); of the entries that match at one place the
        heaviest counts."""
        folded = " " + fold(text or "") + " "
        best: dict[int, float] = {}
        excepted = []
        for end, (n, weight) in self.auto.iter(folded):
            start = end - n + 1
            if weight is None:
                excepted.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if excepted:
            best = {s: w for s, w in best.items() if not any(a <= s < z for a, z in excepted)}
        return sum(best.values()), float(len(best)), float(len(folded.split()))


def design(weight, hits, words) -> np.ndarray:
    """Features of the logistic function: intercept, any hit, total and length-normalised weight."""
    weight, hits, words = (np.asarray(x, dtype=float) for x in (weight, hits, words))
    return np.column_stack([np.ones(len(weight)), np.minimum(hits, 3.0), np.log1p(np.minimum(weight, SATURATE)),
                            np.minimum(100.0 * weight / (words + 20.0), SATURATE) / 10.0])


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps (the intercept is free)."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fold_of(id_col):
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, fold, y) of at most ``rows`` labelled ids outside the held-out fold."""
    marked = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .groupBy("doc_id").agg(F.max(label).alias("y"))
              .withColumn("fold", fold_of(F.col("doc_id"))).filter("fold <> 0"))
    chosen = marked.orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id").limit(rows)
    # The limit bounds the broadcast; texts of the training rows are not shuffled.
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id").select("doc_id", "text", "fold", "y")


def _beginnings(batches):
    """Document frequencies of word beginnings, summed per task."""
    import pyarrow as pa

    toxic, other = Counter(), Counter()
    for b in batches:
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            seen = set()
            for w in set(fold(text or "").split()):
                if len(w) >= PREFIX.start:
                    seen.add(w + " ")
                    seen.update(w[:n] for n in PREFIX if n <= len(w))
            (toxic if y else other).update(seen)
    words = list(toxic.keys() | other.keys())
    for at in range(0, len(words), 50_000):
        part = words[at:at + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([toxic[w] for w in part], pa.int64()),
             pa.array([other[w] for w in part], pa.int64())], names=["w", "pos", "neg"])


def learn_lexicon(train: DataFrame) -> list[tuple[str, float]]:
    """Entries with weights from labelled texts (doc_id, text, fold, y)."""
    entries = {fold(w): PRIOR_WEIGHT for w in PRIOR}
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if n_pos and n_neg:
        counts = (train.select("text", "y").mapInArrow(_beginnings, "w string, pos long, neg long")
                  .groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
        odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
        top = (counts.filter(F.col("pos") >= MIN_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_LOG_ODDS)
               .orderBy(F.desc("odds"), F.desc(F.length("w")), "w").limit(MAX_ENTRIES).collect())
        found = {r["w"]: (r["pos"], r["neg"]) for r in top}
        # Of beginnings that occur in the same documents the longest stands for all: a
        # shorter one would only reach words that nothing is known about.
        longer = {(w[:-1], n) for w, n in found.items() if not w.endswith(" ")}
        for r in top:
            w, n = r["w"], found[r["w"]]
            if (found.get(w[:-1]) == n) if w.endswith(" ") else ((w, n) in longer):
                continue
            entries[w] = max(float(r["odds"]), entries.get(w, 0.0))
    return sorted(entries.items())


class Model:
    """A lexicon with the coefficients of its logistic function; small, sent to the tasks."""

    def __init__(self, entries, coef):
        self.entries, self.coef = entries, [float(c) for c in coef]
        self.key = f"toxicity:{hash((tuple(entries), tuple(self.coef)))}"

    def udf(self):
        entries, coef, key = self.entries, np.array(self.coef), self.key

        @F.pandas_udf("double")
        def toxicity(texts: pd.Series) -> pd.Series:
            m = process_latest("toxicity-matcher", key, lambda: Matcher(entries))
            found = [m.features(t) for t in texts]
            if not found:
                return pd.Series([], dtype=float)
            return pd.Series(1 / (1 + np.exp(-np.clip(design(*zip(*found)) @ coef, -30, 30))))

        return toxicity


#: Without labels: one hit of the prior list makes a short text toxic.
DEFAULT_COEF = [-4.0, 2.0, 1.5, 1.0]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    train = training_rows(docs, labels, "toxic", rows)
    entries = learn_lexicon(train.filter(F.col("fold") < FOLDS - 1))

    def measure(batches):
        import pyarrow as pa

        m = Matcher(entries)
        for b in batches:
            f = [m.features(t) for t in b.column(0).to_pylist()]
            cols = [pa.array([x[i] for x in f], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, b.column(1)], names=["weight", "hits", "words", "y"])

    # Bounded by ``rows``.
    pdf = (train.filter(F.col("fold") == FOLDS - 1).select("text", F.col("y").cast("int").alias("y"))
           .mapInArrow(measure, "weight double, hits double, words double, y int").toPandas())
    if pdf["y"].nunique() < 2:
        return Model(entries, DEFAULT_COEF)
    pdf = pdf.sort_values(["weight", "hits", "words", "y"])     # the same sums whatever the order of tasks
    x = design(pdf["weight"], pdf["hits"], pdf["words"])
    return Model(entries, np.round(logistic_fit(x, pdf["y"].to_numpy(float)), 9))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    out = docs.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"),
                      model.udf()(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) whose score is below 0.5."""
    return docs.filter(model.udf()(F.col("text")) < 0.5)
