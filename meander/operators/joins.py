"""Equi-joins that hold when a few keys own much of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

# A key with more than this share of the rows is spread over several tasks.
# It also bounds how many such keys there can be: 1 / HOT_SHARE.
HOT_SHARE = 1e-3

_SALT = "__salt"


def planned_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the table's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def has_lists(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, (ArrayType, MapType, StructType)) for f in df.schema)


def fits_broadcast(df: DataFrame) -> bool:
    """True if Spark may broadcast this side by itself, so that no key can become hot.

    Spark knows the size of a table's files only.  Lists are packed in files, often to a
    twentieth, so a table with lists may not be broadcast whatever size is planned.
    """
    if has_lists(df):
        return False
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= planned_bytes(df) <= limit


def frequent_keys(rows: DataFrame, columns: list[str], share: float = HOT_SHARE) -> dict[str, list]:
    """Per column, every value that holds more than ``share`` of the rows.

    One pass without a shuffle: a frequent-items sketch never misses such a
    value and returns at most 1 / share values; the extra ones it may return
    are merely spread needlessly.
    """
    found = rows.select(*columns).freqItems(columns, share).first()
    return {c: [v for v in (found[i] or []) if v is not None] for i, c in enumerate(columns)}


def hot_keys(table: DataFrame, columns: list[str], share: float = HOT_SHARE) -> dict[str, list]:
    """``frequent_keys`` of a written table without the extra ones: what the sketch found is counted.

    So that a table without hot keys is joined plainly, as it lies; the columns are read once more each.
    """
    found = frequent_keys(table, columns, share)
    if not any(found.values()):
        return found
    least = share * table.count()
    counts = {c: table.where(F.col(c).isin(keys)).groupBy(c).count().where(F.col("count") > least)
              for c, keys in found.items() if keys}
    return {c: [row[0] for row in counts[c].collect()] if c in counts else [] for c in found}


def attach(rows: DataFrame, table: DataFrame, on: str, how: str = "inner",
           hot: list | None = None) -> DataFrame:
    """Join ``rows``, which may be skewed on the key, to ``table``, which has few rows per key.

    A table small enough to broadcast needs no more.  Otherwise rows of hot
    keys are spread by a salt and the table's rows of these keys are repeated
    once per salt; all other keys join as usual.
    """
    if fits_broadcast(table):
        return rows.join(table, on, how)
    if has_lists(table):
        table = table.hint("merge")
    hot = frequent_keys(rows, [on])[on] if hot is None else hot
    if not hot:
        return rows.join(table, on, how)
    copies = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    # The partition number spreads identical rows; it is the same in a retried task.
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *rows.columns), F.lit(copies)).cast("int")
    salted = rows.withColumn(_SALT, F.when(is_hot, spread).otherwise(F.lit(0)))
    repeated = table.withColumn(
        _SALT, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(copies - 1)))
                          .otherwise(F.array(F.lit(0)))))
    if has_lists(table):
        repeated = repeated.hint("merge")
    return salted.join(repeated, [on, _SALT], how).drop(_SALT)
