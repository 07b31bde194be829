"""Model endpoints behind plain callables: embeddings, chat and OCR run per Arrow batch.

The engine ships no client. A callable takes a list and returns a list of the same length. Calls
that fail are repeated with growing waits, then halved until the rows that fail are alone: these get
null and the error, all others their answers. When more than a share of a task's rows fails, the
task does, for an endpoint that is down must not look like answers.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _called(rows: DataFrame, column: str, call: Callable[[list], list], made: str, kind: str, size: int = 64, retries: int = 2, wait: float = 0.5, most_failed: float = 0.1) -> DataFrame:
    """size: values of a call. wait: seconds before the first repeat. Up to `size` failed rows never end a task."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {made} {kind}, error string"

    def asked(values: list) -> tuple[list, list]:
        """Answers and errors; a call that fails is repeated, then its rows are halved until those that fail are alone."""
        for turn in range(retries + 1):
            try:
                out = list(call(values))
                if len(out) != len(values):
                    raise ValueError("an answer for each row is needed")
                return out, [None] * len(out)
            except Exception as e:
                error = f"{type(e).__name__}: {e}"[:200]
                if turn < retries and len(values) > 1:
                    time.sleep(wait * 2**turn)
        if len(values) == 1:
            return [None], [error]
        half = len(values) // 2
        (a, x), (b, y) = asked(values[:half]), asked(values[half:])
        return a + b, x + y

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows_, failed = 0, 0
        for b in batches:
            values = b[column].tolist()
            out, errors = [], []
            for i in range(0, len(values), size):
                a, x = asked(values[i : i + size])
                out, errors = out + a, errors + x
            rows_, failed = rows_ + len(values), failed + sum(e is not None for e in errors)
            if failed > max(size, most_failed * rows_):
                raise RuntimeError(f"{failed} of {rows_} rows failed, the last with {next(e for e in reversed(errors) if e)}")
            yield b.assign(**{made: pd.Series(out, index=b.index, dtype=object), "error": pd.Series(errors, index=b.index, dtype=object)})

    return rows.mapInPandas(run, schema)


def embed(rows: DataFrame, column: str, call: Callable[[list[str]], list[list[float]]], **how) -> DataFrame:
    return _called(rows, column, call, "embedding", "array<float>", **how)


def answer(prompts: DataFrame, column: str, call: Callable[[list[str]], list[str]], **how) -> DataFrame:
    return _called(prompts, column, call, "answer", "string", **how)


def ocr(images: DataFrame, column: str, call: Callable[[list[bytes]], list[str]], **how) -> DataFrame:
    """OCR results as JSON text, which layout.decode_tokens reads."""
    return _called(images, column, call, "result", "string", **how)


def shrink(width: Column, height: Column, longest: int = 1920) -> Column:
    """Scale that brings the longer side to at most `longest`."""
    return F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))


def _weights(window: int) -> np.ndarray:
    """Gaussian weights of a window, as wide as image libraries take it by default."""
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(window) - window // 2) ** 2) / (2 * sigma**2))
    return w / w.sum()


def denoise(gray: np.ndarray) -> np.ndarray:
    """The median of each pixel's 3 x 3 window: single wrong pixels go, edges stay."""
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def enhance(gray: np.ndarray, window: int = 11, offset: int = 2, gaussian: bool = True) -> np.ndarray:
    """A page image in black and white against the weighted (or plain) mean of each pixel's window."""
    pad = window // 2
    w = _weights(window) if gaussian else np.full(window, 1 / window)
    p = np.pad(gray.astype(np.float64), pad, mode="edge")
    rows = sum(w[i] * p[i : i + gray.shape[0]] for i in range(window))
    mean = sum(w[j] * rows[:, j : j + gray.shape[1]] for j in range(window))
    return np.where(gray > mean - offset, 255, 0).astype(np.uint8)
