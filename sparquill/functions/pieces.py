"""Columns cut small for Python: what a worker holds does not hang on Arrow's batches."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Tuple  # noqa: UP035  (the spelling that Spark's type hints know)

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters (or bytes) of a piece, and rows.
PIECE, ROWS = 1 << 20, 4096
#: Of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(spark) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, where 64 MB is usual."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def uncollected(f: Callable) -> Callable:
    """``f`` without searches for cycles while it runs: what it makes is large and has none."""

    @wraps(f)
    def run(*args, **kwargs):
        paused = gc.isenabled()
        gc.disable()
        try:
            return f(*args, **kwargs)
        finally:
            if paused:
                gc.enable()

    return run


def _size(value: object) -> int:
    return len(value) if hasattr(value, "__len__") else 1


def cut(columns: tuple[pd.Series, ...], most: int = PIECE, rows: int = ROWS) -> Iterator[tuple[pd.Series, ...]]:
    """The columns in pieces of about ``most`` in all (or of one row), and ``rows`` rows at most."""
    start, size, n = 0, 0, len(columns[0])
    for i, values in enumerate(zip(*columns, strict=True)):
        own = sum(map(_size, values))
        if i > start and (size + own > most or i - start >= rows):
            yield tuple(c.iloc[start:i] for c in columns)
            start, size = i, 0
        size += own
    if start < n:
        yield tuple(c.iloc[start:] for c in columns)


def by_pieces(kind: T.DataType, n_columns: int = 1) -> Callable:
    """A pandas UDF of ``n_columns`` that is called with one small piece after
    another, and whose results go back piece by piece."""
    given = Iterator[pd.Series] if n_columns == 1 else Iterator[Tuple[pd.Series, ...]]  # noqa: UP006
    made = Iterator[pd.DataFrame] if isinstance(kind, T.StructType) else Iterator[pd.Series]

    def decorate(f: Callable) -> Callable:
        def run(batches):
            for batch in batches:
                for piece in cut((batch,) if n_columns == 1 else batch):
                    yield f(*piece)

        run.__annotations__ = {"batches": given, "return": made}
        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return F.pandas_udf(run, kind)

    return decorate
