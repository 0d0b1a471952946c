"""Keys that are compared without surrounding white space and letter case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"


def stripped(col: Column | str) -> Column:
    """Text without white space at either end; NULL stays NULL."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITE))


def key(col: Column | str) -> Column:
    """Comparable key: stripped and in lower case, NULL where nothing is left."""
    k = F.lower(stripped(col))
    return F.when(k != "", k)
