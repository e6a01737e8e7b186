"""Token counts of flat token files by a separator scan.

A flat file is nothing but token ids of fixed width, documents one after the other, each closed by the end-of-document id;
there is no index. The file is cut into blocks, every block is searched for the separator with one vectorised comparison,
and yields what it knows alone: tokens before its first separator, whole documents, tokens behind its last. A prefix scan
over the blocks of a file stitches documents that cross block boundaries and numbers all documents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import local_path, shared_path, shuffle_partitions, written

VOCABULARY = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50_256
BLOCK_TOKENS = 1 << 16
SCANNED = "file string, block long, seps long, head long, tail long, whole array<int>"


def scan(tokens: np.ndarray, end_id: int) -> tuple[int, int, int, np.ndarray]:
    """Separators, tokens before the first, tokens behind the last, and lengths of the documents between them."""
    at = np.flatnonzero(tokens == end_id)
    if not len(at):
        return 0, len(tokens), 0, np.empty(0, dtype=np.int64)
    return len(at), int(at[0]), len(tokens) - int(at[-1]) - 1, np.diff(at) - 1


def scan_blocks(blocks: DataFrame, end_id: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """What each block (file, block, data) knows alone. Blocks are pieces of a file in order, each of whole tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(np.frombuffer(x.as_buffer(), dtype=dtype), end_id) for x in batch.column("data")]
            columns = [
                batch.column("file"),
                batch.column("block"),
                *(pa.array([x[i] for x in found], pa.int64()) for i in range(3)),
                pa.array([x[3] for x in found], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "seps", "head", "tail", "whole"])

    return blocks.select("file", "block", "data").mapInArrow(run, SCANNED)


def stitched(scanned: DataFrame, span: int = 4096) -> DataFrame:
    """(file, ordinal, n_tokens) of every document, from what the blocks know alone.

    The prefix scan has two levels, so that no task holds all blocks of a long file: inside spans of ``span`` blocks, and
    over the spans of a file. Tokens behind a file's last separator are a document without an end and count as the last.
    """
    blocks = scanned.withColumn("span", F.floor(F.col("block") / span))
    # Of a run of blocks: its separators, the tokens before its first and those behind its last.
    order = "partition by file, span order by block"
    closed = f"max(case when seps > 0 then block end) over ({order} rows between unbounded preceding and 1 preceding)"
    inner = blocks.withColumn("closed", F.expr(closed)).withColumns(
        {
            "seps_before": F.expr(
                f"coalesce(sum(seps) over ({order} rows between unbounded preceding and 1 preceding), 0)"
            ),
            # Without a separator a block is all head, with one only its tail stays open behind it.
            "open": F.expr("case when seps > 0 then tail else head end"),
            "resets": F.expr(f"sum(case when seps > 0 then 1 else 0 end) over ({order})"),
        }
    )
    carry = (
        "coalesce(sum(open) over (partition by file, span, resets order by block"
        " rows between unbounded preceding and current row), 0)"
    )
    inner = written(
        inner.withColumn("running", F.expr(carry)).withColumn(
            "carried", F.expr(f"coalesce(lag(running) over ({order}), 0)")
        )
    )
    spans = inner.groupBy("file", "span").agg(
        F.sum("seps").alias("s"), F.max_by("running", "block").alias("left_open")
    )
    order = "partition by file order by span"
    spans = spans.withColumns(
        {
            "span_seps": F.expr(f"coalesce(sum(s) over ({order} rows between unbounded preceding and 1 preceding), 0)"),
            "resets": F.expr(f"sum(case when s > 0 then 1 else 0 end) over ({order})"),
            "last": F.expr(f"lead(span) over ({order}) is null"),
        }
    )
    carry = "sum(left_open) over (partition by file, resets order by span rows between unbounded preceding and current row)"
    spans = spans.withColumn("kept", F.expr(carry)).withColumn(
        "span_open", F.expr(f"coalesce(lag(kept) over ({order}), 0)")
    )
    joined = inner.join(spans.select("file", "span", "span_seps", "span_open"), ["file", "span"])
    before = F.when(F.col("closed").isNull(), F.col("span_open")).otherwise(0) + F.col("carried")
    first = F.when(F.col("seps") > 0, F.struct((F.col("head") + before).cast("long").alias("n"), F.lit(0).alias("at")))
    lengths = F.transform("whole", lambda n, i: F.struct(n.cast("long").alias("n"), (i + 1).alias("at")))
    per_block = joined.where("seps > 0").select(
        "file",
        (F.col("span_seps") + F.col("seps_before")).alias("start"),
        F.inline(F.concat(F.array(first), lengths)),
    )
    whole = per_block.select("file", (F.col("start") + F.col("at")).alias("ordinal"), F.col("n").alias("n_tokens"))
    loose = spans.where("last and kept > 0").select(
        "file", (F.col("span_seps") + F.col("s")).alias("ordinal"), F.col("kept").cast("long").alias("n_tokens")
    )
    return whole.unionByName(loose)


def file_blocks(spark: SparkSession, folder: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, block, data) of the flat files of a mounted folder, read by ranges; only names and sizes are listed first.

    Bytes beyond the last whole token of a file are refused.
    """
    listed = spark.read.format("binaryFile").load(folder).select("path", "length")
    step = width * block_tokens
    ranges = listed.where("length > 0").select(
        F.col("path").alias("file"),
        "length",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("block"),
    )
    ranges = ranges.repartition(4 * shuffle_partitions(spark))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if length % width:
                    raise ValueError(f"{file} is not a whole number of tokens")
                with open(local_path(file), "rb") as source:
                    source.seek(block * step)
                    data = source.read(step)
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "data": [data]})

    return ranges.mapInArrow(read, "file string, block long, data binary")


def token_counts(spark: SparkSession, folder: str, end_id: int = END_OF_DOCUMENT, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, n_tokens) of every document of the flat files in ``folder``; empty files hold no document."""
    width = np.dtype(dtype).itemsize
    return stitched(scan_blocks(file_blocks(spark, folder, width), end_id, dtype))


# ---- flat files of a table of texts


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                vocabulary: str | None = None, end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """Writes one flat file per partition of ``docs`` below a mounted ``folder`` and gives (file, ordinal, doc_id).

    A file appears by rename under its partition's name, so that a repeated task leaves the same file. Null texts are
    empty. The result has to be evaluated once, as ``written`` does, for the files to be there.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary_batch
        os.makedirs(folder, exist_ok=True)
        name = f"part-{TaskContext.get().partitionId():06d}"
        draft, ordinal = f"{folder}/.{name}-{uuid4().hex}", 0
        with open(draft, "wb") as out:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    some = batch.slice(start, 256)
                    for ids in encode(some.column(1).to_pylist(), num_threads=1):
                        out.write(np.array([*ids, end_id], dtype="<u2").tobytes())
                    n = some.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), some.column(0)],
                        names=["file", "ordinal", "doc_id"],
                    )
                    ordinal += n
        os.replace(draft, f"{folder}/{name}")

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "file string, ordinal long, doc_id long")


_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    if path not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding(
            "flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODINGS[path]


def document_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, file, ordinal, n_tokens) of every row of ``docs``: its flat files written, and then counted by a scan that
    knows nothing but the files.

    Null and empty texts have no token; repeated rows and null ids are rows like any other; other columns are not looked
    at; an empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = local_path(shared_path(spark))
    index = written(write_files(docs, folder, id_col, text_col))
    if index.isEmpty():
        return spark.createDataFrame([], "doc_id long, file string, ordinal long, n_tokens long")
    found = token_counts(spark, f"file://{folder}").withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    return index.join(found, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "n_tokens")
