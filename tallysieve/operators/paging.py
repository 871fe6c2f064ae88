"""How far a search reads its result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: listings of a full page.
PAGE_ROWS = 10


def pages_read(pages: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The pages that are read, with ``stopped``: why the search ends there, or null.

    ``pages`` is (search, page, error, n_listings, n_retry, n_stored): listings on the
    first try and, where that gave none, on the second, and how many the store has.
    A search ends on an error, on a page that is empty twice, on one that the store
    has in full, and on one that is not full.
    """
    n = F.when(F.col("n_listings") > 0, F.col("n_listings")).otherwise(F.coalesce("n_retry", F.lit(0)))
    why = F.when(F.col("error") == "rate_limited", "rate_limited").when(F.coalesce("error", F.lit("")) != "", "error").when(n == 0, "empty").when(F.col("n_stored") >= n, "known").when(n < page_rows, "short")
    before = Window.partitionBy("search").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    judged = pages.withColumn("stopped", why).withColumn("__ended__", F.coalesce(F.bool_or(F.col("stopped").isNotNull()).over(before), F.lit(False)))
    return judged.where(~F.col("__ended__")).drop("__ended__")
