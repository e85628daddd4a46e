"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Byte table that lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Byte table for alphanumeric words: lower-cases A-Z, keeps 0-9, a-z and all
#: bytes of non-ASCII characters, turns every other byte into a space.
ALNUM_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


#: Texts of an Arrow batch that exist as Python objects at a time.
LOT = 256


def lots(texts) -> Iterator[list[bytes]]:
    """The UTF-8 bytes of an Arrow array of texts, ``LOT`` at a time."""
    import pyarrow as pa

    texts = texts.cast(pa.binary())
    for at in range(0, len(texts), LOT):
        yield [t or b"" for t in texts.slice(at, LOT).to_pylist()]


#: Rows of an Arrow batch in stages that carry whole texts.
TEXT_ROWS = 1000


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Let the session hand Python at most ``rows`` rows at a time: Spark's
    default of 10,000 keeps tens of megabytes of text a task in Arrow buffers
    and worker memory. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that clash with no column of ``df``
    (column names are case-insensitive in Spark)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_struct(df: DataFrame, value: Column, fields: list[str]) -> DataFrame:
    """``df`` without columns named like ``fields``, plus the fields of the
    struct ``value``: a clashing input column gives way to the result."""
    (tmp,) = fresh(df, "_result")
    gone = {f.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in gone]
    out = df.withColumn(tmp, value)
    return out.select(*[col(c) for c in kept], *[out[tmp][f].alias(f) for f in fields])


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: later steps read the files
    instead of computing ``df`` again, also after an executor is lost."""
    from tidecast.session import cut_lineage

    return cut_lineage(df)

