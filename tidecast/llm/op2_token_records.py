"""Token ids as length-delimited binary records with an offset index.

A record file is a plain concatenation of frames:

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked CRC-32 of the 8 length bytes
    payload  1 byte with the id width (2 or 4), then the ids, little-endian
    check    4 bytes: masked CRC-32 of the payload

A masked checksum is the CRC-32 rotated right by 15 bits plus a constant, so
that a checksum stored in data that is checksummed again stays harmless. The
index is a separate Parquet table with one row per record (file, byte offset
and length, number of ids, ids before it in its file): any subset of records,
in any order, is read with one seek each.

Documents are range-partitioned by doc_id, sorted within partitions and
encoded where they are written; a file holds one partition, and every file's
rows of the index are committed by Spark with it, so files of lost or
repeated task attempts are never referenced. Ids of common words are encoded
once per worker: byte-level BPE never merges across the start of a space that
follows and precedes text, so encodings of space-led chunks are kept in a
bounded table and joined; texts where white space follows a space go to the
tokenizer whole.

Defined cases: a null or empty text is a record with the end id alone; null
doc_ids come first; rows with one doc_id stand in order of their text's hash;
an empty table gives no records; extra columns are not written.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidecast.llm.common import col, table

END_ID = 2
#: Encoded chunks in each of a worker's two generations.
CACHE_CHUNKS = 500_000
#: Documents encoded at a time.
LOT = 200
#: Fixed value: the constant of the masked checksum of TFRecord files.
MASK_DELTA = 0xA282EAD8

INDEX = "part int, file string, doc_id long, offset long, length long, n_tokens long, local_start long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked_crc(size)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(record: bytes) -> bytes:
    """Payload of one frame; raises ValueError if a check or length fails."""
    size, check = record[:8], struct.unpack("<I", record[8:12])[0]
    if masked_crc(size) != check:
        raise ValueError("the length's checksum differs")
    payload, check = record[12:-4], struct.unpack("<I", record[-4:])[0]
    if len(payload) != struct.unpack("<Q", size)[0] or masked_crc(payload) != check:
        raise ValueError("the payload's checksum differs")
    return payload


class Encoder:
    """Whole texts to little-endian id bytes, through a table of chunks."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS) -> None:
        # Tasks already use every core; threads of one worker only cost memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.limit = cache_chunks
        pre = self.tokenizer.pre_tokenizer
        self.by_chunk = (
            type(pre).__name__ == "ByteLevel" and pre.use_regex and not pre.add_prefix_space and self.tokenizer.normalizer is None
        )
        self.leads = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.leads[i] = token.startswith("Ġ")
        self.heads: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in got]

    def _learn(self, wanted: set[str]) -> None:
        """Ids of chunks that are not in the table; empty bytes stand for
        white space after a space, which other chunks may merge with."""
        if len(self.chunks) > self.limit:
            # Chunks in use come back from the older generation.
            self.older, self.chunks = self.chunks, {}
        new, older, chunks = [], self.older.get, self.chunks
        for c in wanted:
            ids = older(c)
            if ids is not None:
                chunks[c] = ids
            elif not c or c[0].isspace() or c[0] == "\u180e":
                chunks[c] = b""
            else:
                new.append(c)
        lots = [new[i : i + 1000] for i in range(0, len(new), 1000)]
        joined = self.tokenizer.encode_batch_fast([" " + " ".join(lot) for lot in lots], add_special_tokens=False)
        for lot, e in zip(lots, joined):
            ids = np.array(e.ids, self.dtype)
            at = np.flatnonzero(self.leads[ids])
            if len(at) != len(lot) or at[0]:
                chunks.update(zip(lot, self.whole([" " + c for c in lot])))
                continue
            data, w = ids.tobytes(), self.dtype.itemsize
            bounds = (at * w).tolist()
            chunks.update({c: data[a:b] for c, a, b in zip(lot, bounds, [*bounds[1:], len(data)])})

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return self.whole(texts)
        heads, rests, parts, holes, wanted = [], [], [], [], set()
        known = self.chunks.get
        for text in texts:
            head, _, rest = text.partition(" ")
            chunks = rest.split(" ") if len(head) < len(text) else []
            got = list(map(known, chunks))
            at = [i for i, ids in enumerate(got) if ids is None]
            wanted.update([chunks[i] for i in at])
            heads.append(head)
            rests.append(chunks)
            parts.append(got)
            holes.append(at)
        self._learn(wanted)
        if len(self.heads) > self.limit:
            self.heads.clear()
        new = list(set(heads).difference(self.heads))
        self.heads.update(zip(new, self.whole(new)))
        out, learnt = [], self.chunks
        for text, head, chunks, got, at in zip(texts, heads, rests, parts, holes):
            for i in at:
                got[i] = learnt[chunks[i]]
            out.append(self.whole([text])[0] if b"" in got else self.heads[head] + b"".join(got))
        return out


@lru_cache(maxsize=1)
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker: the tokenizer is read and the
    table of chunks filled once, not once a task."""
    return Encoder(path)


def _store(folder: str):
    """File system and path of a shared folder's address."""
    from pyarrow import fs

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def write_records(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Write record files to ``folder``/records and their offset index to
    ``folder``/index. ``tokenizer`` is a tokenizer file that every executor
    can open; ``folder`` lies in a store that all executors share."""
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), F.coalesce(col(text), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, out = TaskContext.get(), None, None
        offset = local_start = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = worker_encoder(tokenizer)
                end = np.array([end_id], encoder.dtype).tobytes()
                width = bytes([encoder.dtype.itemsize])
                store, path = _store(f"{folder}/records")
                store.create_dir(path, recursive=True)
                file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.rec"
                out = store.open_output_stream(f"{path}/{file}")
            for at in range(0, batch.num_rows, LOT):
                ids_, texts = (batch.column(i).slice(at, LOT).to_pylist() for i in (0, 1))
                index = []
                for i, ids in zip(ids_, encoder.encode(texts)):
                    payload = width + ids + end
                    record = frame(payload)
                    out.write(record)
                    n = len(payload) // encoder.dtype.itemsize
                    index.append((task.partitionId(), file, i, offset, len(record), n, local_start))
                    offset += len(record)
                    local_start += n
                types = (pa.int32(), pa.string(), *[pa.int64()] * 5)
                arrays = [pa.array(c, t) for c, t in zip(zip(*index), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in INDEX.split(", ")])
        if out is not None:
            out.close()

    ordered.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index with ``start``: ids of all documents before a record."""
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return index.join(base, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The ids of every row of ``index`` (any subset, any order), both
    checksums verified, as little-endian unsigned 32-bit integers."""
    keep = index.select("file", "offset", "length", "doc_id", "start")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(f"{folder}/records")
        name = opened = None
        for batch in batches:
            for at in range(0, batch.num_rows, LOT):
                part = batch.slice(at, LOT)
                ids = []
                for file, offset, length in zip(*[part.column(i).to_pylist() for i in range(3)]):
                    if file != name:
                        name, opened = file, store.open_input_file(f"{path}/{file}")
                    opened.seek(offset)
                    payload = unframe(opened.read(length))
                    ids.append(np.frombuffer(payload, f"<u{payload[0]}", offset=1).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(3), part.column(4), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    return keep.mapInArrow(read, "doc_id long, start long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidecast.session import scratch_path

    folder = scratch_path(spark, "token-records")
    write_records(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    # Spark's crc32() is the unsigned checksum of the bytes as they are.
    return read_records(read_index(spark, folder), folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
