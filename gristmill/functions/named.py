"""Values with a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))
