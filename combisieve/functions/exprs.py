"""Expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An outer expression used inside a lambda is evaluated again for every
    element (projections are merged into it); a bound variable is not.
    """
    return F.transform(F.array(value), body)[0]
