"""Time helpers that accept timestamps with and without a zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(value: Column | str) -> Column:
    """Microseconds since 1970 in the session's (UTC) zone."""
    col = F.col(value) if isinstance(value, str) else value
    return F.unix_micros(col.cast("timestamp"))
