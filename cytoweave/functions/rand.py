"""Keyed draws: a uniform number is a pure function of its key.

Results do not depend on partitioning, retries or row order, and any SQL engine
with ``md5`` can recompute them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column | str | int) -> Column:
    """Uniform [0, 1) from the first 32 bits of ``md5('part|part|...')``.

    Strings and numbers are literals; pass ``F.col`` for row values.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
