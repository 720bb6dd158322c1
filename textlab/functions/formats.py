"""Fixed-decimal formatting with Python's rounding (correct rounding of the
binary value, as the reference prints), for the small run/report tables.

Java's ``format_string('%.3f')`` rounds the shortest decimal string half-up
(0.2125 -> 0.213) where Python rounds the binary value (0.2125 -> 0.212), so the
report layer formats through an Arrow-batched pandas UDF. It only ever sees
result tables (one row per run), never row-level data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _make(spec: str):
    @F.pandas_udf(StringType())
    def _fmt(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or pd.isna(v) else format(float(v), spec))
    return _fmt


_CACHE: dict[str, object] = {}


def py_format(col, digits: int = 4, missing: str | None = "N/A", signed: bool = False) -> Column:
    spec = f"{'+' if signed else ''}.{digits}f"
    if spec not in _CACHE:
        _CACHE[spec] = _make(spec)
    c = F.col(col) if isinstance(col, str) else col
    out = _CACHE[spec](c.cast("double"))
    return out if missing is None else F.coalesce(out, F.lit(missing))
