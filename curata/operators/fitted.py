"""Learned parameters of an operator, applied as column expressions.

``fit_*`` functions run Spark aggregates on a table and return a ``Fitted``
holding only small parameters (means, quantiles, breaks, a lambda, a level
list).  ``Fitted.transform`` needs no aggregate of its own, so it also works
on a streaming DataFrame (see ``curata.streaming``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


@dataclass
class Fitted:
    kind: str
    column: str
    params: dict[str, Any]
    apply: Callable[[DataFrame], DataFrame] = field(repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.apply(df)
