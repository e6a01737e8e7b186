"""Length-delimited binary records of token ids, with a separate index of offsets.

A data file is a row of records, each framed so that damage is noticed:

    length of the payload   unsigned 64-bit
    masked crc32 of the eight bytes of the length   unsigned 32-bit
    payload                 one byte (1: the id is null), the id as signed 64-bit, then the token ids
    masked crc32 of the payload                     unsigned 32-bit

All numbers are little-endian; token ids take two bytes where the vocabulary allows, else four. A mask (rotation by 15 and
a constant) keeps a checksum that is itself data from checking out by chance. The index file beside a data file holds the
offset of every record and the size of the file as unsigned 64-bit numbers: record ``i`` is read with two seeks, in any
order, without a look at the others.

Files are sorted: the first file holds the smallest document ids, and inside a file ids ascend.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import arrow_rows, local_path, shared_path, shuffle_partitions, trim, written
from concord.llm.wordids import LedWords, tokenizer, word_ids

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FRAME = struct.Struct("<QI")
HEAD = struct.Struct("<?q")
SUM = struct.Struct("<I")
#: Bytes of a record that are not token ids.
OVERHEAD = FRAME.size + HEAD.size + SUM.size
MASK_DELTA = 0xA282EAD8
BLOCK_RECORDS = 1024
#: Documents that go to a worker together, which holds several copies of them.
BATCH_ROWS = 1000
#: Bytes of ids that a reader hands on together.
BATCH_BYTES = 8 << 20
FILES = "file string, records long, bytes long, width int"
READ = "file string, ordinal long, doc_id long, start long, ids binary"


def masked_crc32(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """One record."""
    payload = HEAD.pack(doc_id is None, doc_id or 0) + ids
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, SUM.pack(masked_crc32(length)), payload, SUM.pack(masked_crc32(payload))))


def unframe(record: bytes, where: str) -> tuple[int | None, bytes]:
    """Document id and ids of one record; raises ``ValueError`` for a damaged one."""
    if len(record) < OVERHEAD:
        raise ValueError(f"{where}: the record is cut off")
    length, length_sum = FRAME.unpack_from(record)
    if masked_crc32(record[:8]) != length_sum or length != len(record) - FRAME.size - SUM.size:
        raise ValueError(f"{where}: the length does not check out")
    payload = record[FRAME.size : -SUM.size]
    if masked_crc32(payload) != SUM.unpack_from(record, len(record) - SUM.size)[0]:
        raise ValueError(f"{where}: the payload does not check out")
    is_null, doc_id = HEAD.unpack_from(payload)
    return (None if is_null else doc_id), payload[HEAD.size :]


def write_records(
    docs: DataFrame,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Encodes every document and writes the files into a mounted shared ``folder`` (a new one by default).

    Returns one row per data file: file, records, bytes, width of an id; its index is the same name with ``.idx``. Rows are
    sorted by id (null first; rows of one id by hash of the text), split over as many files as the shuffle has partitions,
    also where one id holds a large part of all rows. Null and empty texts have the end id alone, whole texts are encoded
    whatever their length, repeated rows are records of their own, other columns are not looked at, and an empty table
    writes no file. A file appears by rename under its partition's name, so that a task run again leaves the same file.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    folder = local_path(folder or shared_path(docs.sparkSession))
    width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, LedWords()).encode_all
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}"
        draft, end = f"{folder}/.{uuid4().hex}", np.array([end_id], dtype=f"<u{width}").tobytes()
        offset, records = 0, 0
        with open(f"{draft}.rec", "wb") as data, open(f"{draft}.idx", "wb") as index:
            for batch in batches:
                ids = encode(x.as_py() or "" for x in batch.column(1))
                for doc_id, wide in zip(batch.column(0).to_pylist(), ids):
                    record = frame(doc_id, wide.astype(f"<u{width}").tobytes() + end)
                    data.write(record)
                    index.write(offset.to_bytes(8, "little"))
                    offset += len(record)
                    records += 1
            index.write(offset.to_bytes(8, "little"))
        trim()  # what a task took for its texts would add up with the next stage's memory
        if not records:
            os.remove(f"{draft}.rec")
            os.remove(f"{draft}.idx")
            return
        os.replace(f"{draft}.idx", f"{name}.idx")
        os.replace(f"{draft}.rec", f"{name}.rec")
        yield pa.RecordBatch.from_pydict(
            {
                "file": [f"{name}.rec"],
                "records": [records],
                "bytes": [offset],
                "width": pa.array([width], pa.int32()),
            }
        )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keyed = plain.withColumns({"__tie": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first("doc_id"), F.col("__tie"), F.col("__row")]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return written(placed.mapInArrow(run, FILES))


def with_starts(files: DataFrame) -> DataFrame:
    """``files`` with ``first_token``: token ids in all files before. One row per file, so one window over all of them."""
    tokens = (F.col("bytes") - F.col("records") * OVERHEAD) / F.col("width")
    return files.withColumn("tokens", tokens.cast("long")).selectExpr(
        "*", "coalesce(sum(tokens) over (order by file rows between unbounded preceding and 1 preceding), 0L) AS first_token"
    )


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads runs of records (file, first_token, width, first, count) by way of the index."""
    trim()  # of what this worker freed after writing
    out: list[tuple] = []
    size = 0

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array(list(values), kind) for values, kind in zip(zip(*rows), types)]
        return pa.RecordBatch.from_arrays(columns, names=["file", "ordinal", "doc_id", "start", "ids"])

    for batch in batches:
        for file, base, width, first, count in zip(*(batch.column(i).to_pylist() for i in range(5))):
            with open(f"{file[:-4]}.idx", "rb") as index:
                index.seek(8 * first)
                offsets = np.frombuffer(index.read(8 * (count + 1)), dtype="<u8")
            if len(offsets) != count + 1:
                raise ValueError(f"the index of {file} is cut off")
            with open(file, "rb") as data:
                data.seek(int(offsets[0]))
                for i in range(count):
                    ordinal = first + i
                    record = data.read(int(offsets[i + 1] - offsets[i]))
                    doc_id, ids = unframe(record, f"record {ordinal} of {file}")
                    start = base + (int(offsets[i]) - ordinal * OVERHEAD) // width
                    wide = np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes()
                    out.append((file, ordinal, doc_id, start, wide))
                    size += len(wide)
                    if size >= BATCH_BYTES or len(out) >= 4096:
                        yield batch_of(out)
                        out, size = [], 0
    if out:
        yield batch_of(out)


def read_records(files: DataFrame, block_records: int = BLOCK_RECORDS) -> DataFrame:
    """Every record of the files of ``write_records``: file, ordinal, doc_id, start, ids.

    ``start`` counts the token ids of all records before, as the offsets tell it; ``ids`` are little-endian unsigned 32-bit
    integers, the end id included. Runs of ``block_records`` are dealt over the tasks; a damaged record raises.
    """
    last = F.floor((F.col("records") - 1) / block_records)
    blocks = with_starts(files).select(
        "file", "first_token", "width", "records", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")
    )
    runs = blocks.select(
        "file",
        "first_token",
        "width",
        (F.col("block") * block_records).alias("first"),
        F.least(F.lit(block_records), F.col("records") - F.col("block") * block_records).alias("count"),
    )
    return runs.repartition(shuffle_partitions(files.sparkSession)).mapInArrow(_fetch, READ)


def read_shuffled(files: DataFrame, seed: int, tasks: int | None = None) -> DataFrame:
    """The same records in an order that ``seed`` alone decides: the index makes each one a read of its own.

    Only places are shuffled, no content. Each of the ``tasks`` partitions (shuffle partitions by default) is a random part
    of all records, in random order.
    """
    last = F.col("records") - 1
    places = with_starts(files).select(
        "file", "first_token", "width", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("first")
    )
    places = places.withColumn("count", F.lit(1)).withColumn("__order", F.xxhash64(F.lit(seed), "file", "first"))
    tasks = tasks or shuffle_partitions(files.sparkSession)
    placed = places.repartitionByRange(tasks, "__order", "file", "first").sortWithinPartitions("__order", "file", "first")
    return placed.drop("__order").mapInArrow(_fetch, READ)


def document_digests(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (unsigned) of records that were read."""
    return read.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the records of ``docs`` and describes each document from what is read back."""
    return document_digests(read_records(write_records(docs, id_col=id_col, text_col=text_col)))
