"""Ad-hoc filtered fetch of the reference's remote client."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filtered_fetch(df: DataFrame, equals: Mapping[str, object], cols: Sequence[str], n: int = 10,
                   order_by: Sequence[str] = ()) -> DataFrame:
    """``SELECT cols FROM df WHERE k = v AND ... LIMIT n``. With ``order_by`` the result is
    deterministic and Spark plans a bounded top-n (TakeOrderedAndProject)."""
    cond = F.lit(True)
    for k, v in equals.items():
        cond = cond & (F.col(k) == F.lit(v))
    out = df.where(cond).select(*cols)
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(n)
