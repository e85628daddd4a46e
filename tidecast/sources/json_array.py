"""Records of JSON array files, read by byte ranges.

Spark's JSON reader takes a file that holds one array as a single task. Here
a file of any size is cut into byte ranges of ``range_bytes``, a task each. A
range cannot tell by itself whether it starts inside a string or how deep it
starts, so the files are read twice:

1. every range is summed up in one row: the parity of its quotes, and by how
   much its braces change the depth if it starts outside or inside a string;
   running sums of these rows over a file's ranges give each range's state;
2. from that state every range emits the texts of the records that start in
   it (outermost ``{...}``), the last one read past the range's end.

Defined cases: elements of an array that are not objects are no records; an
empty array or file has none; braces, quotes and escapes inside strings and
nested objects are part of their record; a record cut off by the file's end is
emitted as it stands (its fields are then NULL); text around the array, a byte
order mark or several arrays in a row do no harm. Compressed files cannot be
cut and raise an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_BYTES = 64 << 20
#: Bytes of a range that are held at a time.
CHUNK_BYTES = 1 << 20
#: Records of an emitted batch.
BATCH_RECORDS = 5_000
_RANGE = "path string, start long, end long"
_SUMMARY = f"{_RANGE}, quotes int, depth_outside long, depth_inside long"
_COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
_ESCAPE = re.compile(rb"\\.", re.DOTALL)


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def _escaped(file, at: int) -> bool:
    """Whether the byte at ``at`` follows an odd run of backslashes."""
    run = 0
    while at > 0:
        step = min(at, 4096)
        file.seek(at - step)
        data = file.read(step)
        tail = len(data) - len(data.rstrip(b"\\"))
        run, at = run + tail, at - step
        if tail < step:
            break
    return run % 2 == 1


def _chunks(file, start: int, end: int | None) -> Iterator[tuple[bytes, np.ndarray]]:
    """The bytes of a range, a chunk at a time, as they are and with every
    escape blanked out (same length)."""
    escaped = _escaped(file, start)
    at = start
    while end is None or at < end:
        file.seek(at)
        data = file.read(CHUNK_BYTES if end is None else min(CHUNK_BYTES, end - at))
        if not data:
            return
        body = b" " + data[1:] if escaped else data
        body = _ESCAPE.sub(b"  ", body)
        escaped = body.endswith(b"\\")
        at += len(data)
        yield data, np.frombuffer(body, np.uint8)


def _braces(body: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the braces of a chunk, +1 or -1 for each, whether each lies
    inside a string, and whether the chunk's end does."""
    quotes = np.flatnonzero(body == 34)
    places = np.flatnonzero((body == 123) | (body == 125))
    sign = np.where(body[places] == 123, 1, -1)
    within = (np.searchsorted(quotes, places) + inside) % 2
    return places, sign, within, (inside + len(quotes)) % 2


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            inside, depth = 0, [0, 0]
            with _open(row["path"]) as file:
                for _, body in _chunks(file, row["start"], row["end"]):
                    _, sign, within, inside = _braces(body, inside)
                    for side in (0, 1):
                        depth[side] += int(sign[within == side].sum())
            yield pa.RecordBatch.from_pylist(
                [{**row, "quotes": inside, "depth_outside": depth[0], "depth_inside": depth[1]}],
                schema=pa.schema(
                    [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("quotes", pa.int32()), ("depth_outside", pa.int64()), ("depth_inside", pa.int64())]
                ),
            )


def _range_records(file, start: int, end: int, inside: int, depth: int) -> Iterator[bytes]:
    """The records that start in ``[start, end)``, given the state there."""
    open_record: list[bytes] | None = None
    at = start
    for data, body in _chunks(file, start, None):
        places, sign, within, inside = _braces(body, inside)
        places, sign = places[within == 0], sign[within == 0]
        after = depth + np.cumsum(sign)
        begin = 0
        # Only places where a record starts or ends.
        edges = np.flatnonzero(((sign > 0) & (after == 1)) | ((sign < 0) & (after == 0)))
        for place, up in zip(places[edges].tolist(), (sign[edges] > 0).tolist()):
            if up:
                if at + place >= end:
                    return
                open_record, begin = [], place
            elif open_record is not None:
                open_record.append(data[begin : place + 1])
                yield b"".join(open_record)
                open_record = None
        if open_record is not None:
            open_record.append(data[begin:])
        at += len(data)
        depth = int(after[-1]) if len(after) else depth
        if at >= end and open_record is None:
            return
    if open_record is not None:
        yield b"".join(open_record)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lot(records: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(records, pa.string())], names=["record"])

    for batch in batches:
        for row in batch.to_pylist():
            found: list[str] = []
            with _open(row["path"]) as file:
                for record in _range_records(file, row["start"], row["end"], row["inside"], row["depth"]):
                    found.append(record.decode("utf-8", "replace"))
                    if len(found) >= BATCH_RECORDS:
                        yield lot(found)
                        found = []
            if found:
                yield lot(found)


def array_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, int]:
    """The byte ranges of all files under ``path``, (path, start, end), and
    their number; a partition for each. Spark lists the files (only their
    names and lengths are read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.filter("length > 0")
    n, packed = files.agg(F.sum(F.ceil(F.col("length") / range_bytes)), F.min(F.when(F.col("path").rlike(_COMPRESSED), F.col("path")))).first()
    if packed:
        raise ValueError(f"compressed JSON array file cannot be cut into byte ranges: {packed}")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(range_bytes))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    parts = max(1, int(n or 0))
    return ranges.repartition(parts), parts


def settled_ranges(ranges: DataFrame, parts: int) -> DataFrame:
    """``ranges`` with the state each starts in: ``inside`` a string (0 or 1)
    and ``depth`` of braces, from running sums over its file's ranges."""
    summed = ranges.mapInArrow(_summaries, _SUMMARY)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    with_side = summed.withColumn("inside", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    change = F.when(F.col("inside") == 0, F.col("depth_outside")).otherwise(F.col("depth_inside"))
    settled = with_side.withColumn("depth", F.coalesce(F.sum(change).over(before), F.lit(0)))
    return settled.select("path", "start", "end", "inside", "depth").repartition(parts)


def array_records(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The record texts (column ``record``) of the JSON array files under
    ``path``, a file or a folder, in no particular order."""
    return settled_ranges(*array_ranges(spark, path, range_bytes)).mapInArrow(_records, "record string")


def write_arrays(records: DataFrame, path: str) -> None:
    """Write the record texts in the first column as JSON array files, one a
    partition."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([lead + texts[0], *["," + t for t in texts[1:]]], pa.string())], names=["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"], pa.string())], names=["value"])

    records.mapInArrow(framed, "value string").write.mode("overwrite").text(path)
