"""Arrow functions over one text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def array_udf(run: Callable[[Iterator[pa.Array]], Iterator[pa.Array]], schema: str) -> Callable[..., Column]:
    """An iterator of Arrow arrays to another.  Marked nondeterministic so that
    a filter on its result does not make Spark run it once more."""
    return F.arrow_udf(run, schema).asNondeterministic()
