"""User functions over batches of strings or feature vectors.

Spark moves the data and runs the batches; what happens inside one batch is the
caller's own feature or model code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

FEATURES: dict[str, Callable[[list[str]], np.ndarray]] = {}


def register_feature(name: str):
    """Make a feature function available by name."""
    def keep(fn):
        FEATURES[name] = fn
        return fn

    return keep


def _schema(df: DataFrame, ids: Sequence[str], extra: str) -> str:
    kinds = StructType([df.schema[c] for c in ids])
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kinds], extra])


def extract_features(
    df: DataFrame,
    fn: Callable[[list[str]], np.ndarray] | str,
    text: str,
    ids: Sequence[str],
    name: str = "features",
    dtype: str = "float",
    batch_size: int | None = None,
    hook: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """``(ids, features)``: ``fn`` maps a list of strings to a 2-D array, in
    parallel over batches; ``hook`` post-processes each result."""
    call = FEATURES[fn] if isinstance(fn, str) else fn
    keep = list(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            step = batch_size or max(1, len(pdf))
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                out = np.asarray(call(part[text].tolist()))
                if hook is not None:
                    out = hook(out)
                if out.ndim != 2 or len(out) != len(part):
                    raise ValueError("a feature function returns one row per input string")
                yield part[keep].assign(**{name: list(out)})

    return df.select(*keep, text).mapInPandas(run, _schema(df, keep, f"`{name}` array<{dtype}>"))


def predict_batches(
    df: DataFrame,
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    features: str,
    ids: Sequence[str],
    name: str = "pred",
    sigmoid: bool = False,
) -> DataFrame:
    """``(ids, pred)``: ``load`` is called once per task and returns a scorer of
    a 2-D feature array (one output column per target)."""
    keep = list(ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = None
        for pdf in batches:
            if pdf.empty:
                continue
            score = score or load()
            out = np.asarray(score(np.stack(pdf[features].to_numpy())), dtype=float)
            out = out.reshape(len(pdf), -1)
            if sigmoid:
                out = 1.0 / (1.0 + np.exp(-out))
            yield pdf[keep].assign(**{name: list(out)})

    return df.select(*keep, features).mapInPandas(run, _schema(df, keep, f"`{name}` array<double>"))
