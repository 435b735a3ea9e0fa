"""Arrow functions declared at import time."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorized(schema: str) -> Callable[[Callable], Callable[..., Column]]:
    """pandas_udf with a schema in text, which is parsed at the call: parsing needs a session."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, schema)(*columns)

        return call

    return wrap
