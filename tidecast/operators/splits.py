"""Train/test splits and cross-validation folds as columns.

Folds are expressed as data (a ``fold`` and ``role`` column), so one Spark
job can fit or score every fold of every series; nothing loops over rows on
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "series_key"


def time_series_folds(df: DataFrame, k: int = 5, key: str = KEY, order: str = "date") -> DataFrame:
    """``time_series_folds``: ``k`` expanding folds per series.

    With n rows and ts = n // (k + 1), fold f (1..k) tests 1-based rows
    (n - (k+1-f)*ts, n - (k-f)*ts] and trains on every earlier row; the
    remainder of n / (k + 1) lands in the first training window. Rows
    appear once per fold that uses them (``role`` = train / test).
    """
    w = Window.partitionBy(key).orderBy(order)
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    ts = F.floor(F.col("_n") / (k + 1))
    # A row belongs to fold f when rn <= n - (k - f) * ts, i.e. to every
    # fold from first_fold to k: emit exactly those (no join).
    first_fold = F.greatest(F.lit(1), F.ceil(F.lit(k) - (F.col("_n") - F.col("_rn")) / ts))
    exploded = ranked.where(ts > 0).withColumn("fold", F.explode(F.sequence(first_fold.cast("int"), F.lit(k))))
    test_start = F.col("_n") - (k + 1 - F.col("fold")) * ts
    return exploded.withColumn("role", F.when(F.col("_rn") <= test_start, "train").otherwise("test")).drop("_rn", "_n")


def time_series_parts(df: DataFrame, k: int = 5, key: str = KEY, order: str = "date") -> DataFrame:
    """The folds of :func:`time_series_folds` with every row once: ``part`` 0
    is the first training window, ``part`` f the test rows of fold f, so fold
    f trains on parts below f. Series too short for a test row are left out."""
    by_key = Window.partitionBy(key)
    rank, n = F.row_number().over(by_key.orderBy(order)), F.count(F.lit(1)).over(by_key)
    ranked = df.withColumns({"_rn": rank, "_n": n})
    ts = F.floor(F.col("_n") / (k + 1))
    part = F.greatest(F.lit(0), F.lit(k + 1) - F.ceil((F.col("_n") - F.col("_rn") + 1) / ts))
    return ranked.where(ts > 0).withColumn("part", part.cast("int")).drop("_rn", "_n")


def time_series_train(k: int = 5) -> list[tuple[list[int], int]]:
    """(Train parts, test part) of each fold of ``time_series_parts``."""
    return [(list(range(f)), f) for f in range(1, k + 1)]


def contiguous_folds(df: DataFrame, k: int = 3, key: str = KEY, order: str = "date") -> DataFrame:
    """``contiguous_folds``: ``k`` unshuffled blocks in date order, the
    first ``n % k`` one row larger (``ntile``)."""
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(key).orderBy(order)))


#: Ranges of the hash that rows of one label are counted by: a window never
#: holds more than a label's share of one range.
HASH_RANGES = 4096


def _hash(id_col: str, seed: int) -> Column:
    """A 52-bit number from the md5 of the id and the seed."""
    text = F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _rank_in_label(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    """``df`` with ``_rank`` (1, 2, ... by hash within its label) and ``_n``
    (rows of the label), exact and without sorting a label in one task: rows
    are numbered inside ranges of the hash, ranges by the counts before them."""
    x = df.withColumn("_h", _hash(id_col, seed)).withColumn("_range", F.floor(F.col("_h") / float((1 << 52) // HASH_RANGES)))
    counts = x.groupBy(label, "_range").agg(F.count(F.lit(1)).alias("_c"))
    by_label = Window.partitionBy(label)
    before = by_label.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(label).alias("_label"), F.col("_range").alias("_r"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(by_label).alias("_n")
    )
    inside = F.row_number().over(Window.partitionBy(label, "_range").orderBy("_h", id_col))
    x = x.withColumn("_rank", inside).join(counts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_range") == F.col("_r")))
    return x.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_label", "_r", "_before", "_range", "_h")


def stratified_split(df: DataFrame, label: str = "churn_label", test_frac: float = 0.2, seed: int = 42, id_col: str = "customer_no") -> DataFrame:
    """``stratified_split``: of each class, the rows with the smallest seeded
    hashes are the test rows, ``round(n * test_frac)`` of them exactly."""
    ranked = _rank_in_label(df, label, id_col, seed)
    test = F.col("_rank") <= F.floor(F.col("_n") * F.lit(test_frac) + 0.5)
    return ranked.withColumn("role", F.when(test, "test").otherwise("train")).drop("_rank", "_n")


def stratified_folds(df: DataFrame, label: str = "churn_label", k: int = 5, seed: int = 42, id_col: str = "customer_no") -> DataFrame:
    """``stratified_folds``: fold 0..k-1 in turn along each class's seeded
    hash order, so a class's fold sizes differ by one at the most (usable as
    ``CrossValidator(foldCol=...)``)."""
    ranked = _rank_in_label(df, label, id_col, seed + 1)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_n")
