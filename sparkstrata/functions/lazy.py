"""Arrow functions that can be defined before there is a session."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_function(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf``, but the type is parsed when the function is first used on columns."""

    def wrap(f: Callable) -> Callable[..., Column]:
        @functools.wraps(f)
        def on_columns(*columns: Column) -> Column:
            return F.pandas_udf(f, return_type)(*columns)

        return on_columns

    return wrap
