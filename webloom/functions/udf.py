"""Arrow UDFs that are made when first used, as their types need a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(kind: str) -> Callable[[Callable[..., pa.Array]], Callable[..., Column]]:
    def decorate(f: Callable[..., pa.Array]) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns: Column) -> Column:
            return F.arrow_udf(f, kind)(*columns)

        call.kind = kind
        return call

    return decorate
