"""Batch model jobs (the plug-in surface): M1 embed, M3 translate, M4 model_metric.

A model is given as a ``Factory``: a string key and a callable that builds it. The factory
is shipped, not the model; it is called once per Python worker process and the model kept
under its key (``process_cache``). Models are applied to Arrow batches inside
``mapInPandas`` and keys travel with the batch, so nothing is re-attached by position. A
failing batch is retried row by row and a failing row gets NULL plus an error message
(M5). The networks themselves are not part of this library.

A network pads every batch to its longest text. The rows of an Arrow batch are therefore
taken in the order of their length, and a model batch holds at most ``batch_size`` rows and,
padded, at most ``TOKEN_BUDGET`` tokens (white-space words; a longer text is a batch of its own).

``hashed_char_embedder`` is a deterministic **stand-in** (hashed character trigrams,
L2-normalised), not a sentence encoder; ``copy_translator`` returns its input.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pairmine.process_cache import process_cached


@dataclass(frozen=True)
class Factory:
    key: str                  # names the model, and its configuration
    build: Callable[[], Callable]

    def model(self):
        return process_cached(f"model:{self.key}", self.build)


def model_key(m) -> str:
    """Name of a model: a factory's key, or the place of a plain function."""
    return m.key if isinstance(m, Factory) else f"{getattr(m, '__module__', '')}.{getattr(m, '__qualname__', repr(m))}"


def model_of(m):
    """The model of a factory; a plain function is used as it is (and shipped with the task)."""
    return m.model() if isinstance(m, Factory) else m


TOKEN_BUDGET = 16_384      # tokens of a padded batch


def token_counts(pdf: pd.DataFrame, cols) -> np.ndarray:
    """White-space words of each row, of its longest column; a null has none."""
    counts = [np.fromiter((len(t.split()) if isinstance(t, str) else 0 for t in pdf[c]), np.int64, len(pdf)) for c in cols]
    return np.max(counts, axis=0) if counts else np.zeros(len(pdf), np.int64)


def length_batches(tokens: np.ndarray, batch_size: int, budget: int | None = TOKEN_BUDGET) -> list[np.ndarray]:
    """Row numbers of the model batches: rows by length, the longest first, up to ``batch_size``
    rows and ``budget`` padded tokens. Without a budget the rows in their own order."""
    if budget is None:
        return [np.arange(s, min(s + batch_size, len(tokens))) for s in range(0, len(tokens), batch_size)]
    order = np.argsort(-tokens, kind="stable")
    out, at = [], 0
    while at < len(order):
        n = max(1, min(batch_size, budget // max(1, int(tokens[order[at]]))))
        out.append(order[at:at + n])
        at += n
    return out


def padding(tokens: np.ndarray, batches) -> int:
    """Tokens that only pad: what the batches hold beyond their texts."""
    return int(sum(len(b) * tokens[b].max() - tokens[b].sum() for b in batches if len(b)))


def model_batches(it, cols, batch_size: int, budget: int | None = TOKEN_BUDGET):
    """The model batches of a partition, data frames with a new index."""
    for pdf in it:
        for rows in length_batches(token_counts(pdf, cols), batch_size, budget):
            yield pdf.iloc[rows].reset_index(drop=True)


def hashed_char_embedder(dim: int = 64, n: int = 3) -> Callable[[pd.Series], np.ndarray]:
    """Stand-in encoder: signed counts of character n-grams hashed by MD5, L2-normalised.
    The first hex digit's parity gives the sign, the next four the cell."""
    cells: dict[str, tuple[int, float]] = {}

    def cell(gram: str) -> tuple[int, float]:
        if gram not in cells:
            if len(cells) > 500_000:
                cells.clear()
            h = hashlib.md5(gram.encode()).hexdigest()
            cells[gram] = int(h[1:5], 16) % dim, 1.0 if int(h[0], 16) % 2 else -1.0
        return cells[gram]

    def encode(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float64)
        for i, t in enumerate(texts.fillna("")):
            if not t:
                continue                      # empty text -> zero vector
            s = f" {t} "
            for j in range(max(1, len(s) - n + 1)):
                c, sign = cell(s[j:j + n])
                out[i, c] += sign
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
    return encode


EMBEDDER = Factory("hashed-char-64-3", hashed_char_embedder)


def safe_batch(call: Callable[..., object], rows: list[pd.Series | None], n: int) -> tuple[list, list]:
    """M5: (results, errors) of ``call`` on one batch of ``n`` rows. A failing batch, or one
    that returns another number of results, is retried row by row; a failing row gets None
    and an error."""
    try:
        out = list(call(*rows))
        if len(out) == n:
            return out, [None] * n
    except Exception:  # noqa: BLE001 - one bad row must not stop the batch
        pass
    out, err = [None] * n, [None] * n
    for i in range(n):
        try:
            one = list(call(*[r if r is None else r.iloc[i:i + 1].reset_index(drop=True) for r in rows]))
            if len(one) != 1:
                raise ValueError(f"{len(one)} results for one row")
            out[i] = one[0]
        except Exception as e:  # noqa: BLE001
            err[i] = f"{type(e).__name__}: {e}"
    return out, err


def unit_vectors(vecs: list) -> list:
    """each vector divided by its norm (zero vectors stay), as 32-bit floats; None stays."""
    good = [i for i, v in enumerate(vecs) if v is not None]
    out: list = [None] * len(vecs)
    if good:
        x = np.asarray([vecs[i] for i in good], dtype=np.float64)
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0).astype(np.float32)
        for i, v in zip(good, x):
            out[i] = v
    return out


def embed(df: DataFrame, text_col: str, id_col: str = "idx", factory: Factory | Callable = EMBEDDER,
          batch_size: int = 128, errors: bool = False) -> DataFrame:
    """M1 + F9 + M5: text -> unit vector ``ARRAY<FLOAT>`` in batches. A text that fails gets a
    NULL vector (which takes no part in a search); ``errors`` adds the column ``error``."""

    def run(it):
        model = model_of(factory)
        for part in model_batches(it, [text_col], batch_size):
            vecs, err = safe_batch(model, [part[text_col]], len(part))
            out = pd.DataFrame({id_col: part[id_col].to_numpy(np.int64), "vec": unit_vectors(vecs)})
            yield out.assign(error=err) if errors else out

    return df.select(id_col, text_col).mapInPandas(
        run, f"{id_col} long, vec array<float>" + (", error string" if errors else ""))


def copy_translator(texts: pd.Series, src_lang: str, tgt_lang: str) -> list:
    """Stand-in translator: returns the input text. Not a translation model."""
    return texts.tolist()


TRANSLATOR = Factory("copy", lambda: copy_translator)


def translate(df: DataFrame, text_col: str, src_lang: str, tgt_lang: str, id_col: str = "idx",
              translator: Factory | Callable = TRANSLATOR, batch_size: int = 8) -> DataFrame:
    """M3: batched text -> text; the output keeps ``id_col`` (order = input order by key)."""

    def run(it):
        fn = model_of(translator)
        for part in model_batches(it, [text_col], batch_size):
            out, err = safe_batch(lambda x: fn(x, src_lang, tgt_lang), [part[text_col]], len(part))
            yield pd.DataFrame({id_col: part[id_col].to_numpy(np.int64), "translation": out, "error": err})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} long, translation string, error string")


def model_metric(df: DataFrame, scorer: Factory | Callable, name: str, src: str | None, hyp: str, ref: str,
                 batch_size: int = 16) -> DataFrame:
    """M4: a learned metric (BERTScore, COMET, BLEURT ...) per row; NULL on failure or
    for a blank reference."""
    cols = ["row_id", hyp, ref] + ([src] if src else [])

    def run(it):
        metric = model_of(scorer)
        for part in model_batches(it, cols[1:], batch_size):
            got, _ = safe_batch(metric, [part[src] if src else None, part[hyp], part[ref]], len(part))
            vals = np.array([np.nan if v is None else float(v) for v in got])
            blank = part[ref].isna() | (part[ref].fillna("").str.strip() == "")
            vals[blank.to_numpy()] = np.nan
            yield pd.DataFrame({"row_id": part["row_id"].to_numpy(np.int64),
                                name: pd.array([None if np.isnan(v) else v for v in vals], dtype="Float64")})

    return df.select(*cols).mapInPandas(run, f"row_id long, {name} double")

