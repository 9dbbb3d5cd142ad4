"""Token counts of documents by a separator scan over flat, unindexed token files.

A flat file is nothing but little-endian token ids of one width; documents end with the end-of-document id and lie where
they lie. `count_tokens` cuts the files into blocks of bytes without regard to documents. Every block is searched for the
separator at once and keeps only: its number of tokens, of separators, where its separators are. A prefix scan over the
blocks of a file (running sums of separators and tokens, last separator before the block) then turns these into document
numbers, starts and lengths; a document that spans blocks gets its start from an earlier block. No task holds more than one
file's content, and the scan sees one row per block.

Empty documents (two separators in a row) count 0 tokens. Tokens after a file's last separator are a document without an end
(`ended` false). Empty files and an empty folder give no rows. A file whose size is no multiple of the id width is an error.

`write_files` makes such files of (doc_id, text): the tasks' ids in files of at most FILE_BYTES, whole documents each, and a
table (file, ordinal, doc_id) of what was put where. Null and empty texts are documents of 0 tokens. Strings of added tokens
(<|endoftext|>) are encoded as ordinary text, so no text can hold the separator; an `eod` that ordinary text yields is an error. A file gets its final name when it is
whole; files of task attempts that did not count may be searched, but the table does not name them, so none of their counts is returned.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_dir
from .base import text_slices, texts_of
from .bytebpe import ByteBpe

FILE_BYTES = 8 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024


def write_files(docs: DataFrame, folder: str, json_path: str, ranks_path: str, pattern: str, eod: int, dtype: str = "<u2",
                most: int = FILE_BYTES) -> DataFrame:
    """Write the token files below `folder` and return (file, ordinal, doc_id), itself written beside them."""
    spark = docs.sparkSession

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(f"{root}/tokens", recursive=True)
        bpe = ByteBpe(json_path, ranks_path, pattern)
        close = np.array([eod], dtype)
        held, ids, size = [], [], 0

        def flush():
            name = f"{uuid.uuid4().hex}.bin"
            with store.open_output_stream(f"{root}/tokens/{name}.part") as f:
                f.write(b"".join(held))
            store.move(f"{root}/tokens/{name}.part", f"{root}/tokens/{name}")
            return pa.record_batch([pa.array([name] * len(ids), pa.string()), pa.array(range(len(ids)), pa.int64()), pa.array(ids, pa.int64())],
                                   names=["file", "ordinal", "doc_id"])

        for part in text_slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part)):
                tokens = bpe.encode_ordinary(text)
                if (tokens == eod).any():
                    raise ValueError("the end-of-document id is an id of ordinary text")
                if len(tokens) and int(tokens.max()) > np.iinfo(dtype).max:
                    raise ValueError("ids do not fit the file's width")
                data = tokens.astype(dtype).tobytes() + close.tobytes()
                if held and size + len(data) > most:
                    yield flush()
                    held, ids, size = [], [], 0
                held.append(data)
                ids.append(doc)
                size += len(data)
        if held:
            yield flush()

    docs.select("doc_id", "text").mapInArrow(run, "file string, ordinal long, doc_id long").write.parquet(f"{folder}/placed")
    return spark.read.parquet(f"{folder}/placed")


def blocks_of(files: DataFrame, width: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, data) of (file, content): consecutive cuts of a whole number of ids."""
    step = block_bytes // width * width
    number = F.ceil(F.length("content") / F.lit(step)).cast("int")
    cut = F.explode(F.sequence(F.lit(0), number - 1)).alias("block")
    checked = F.when(F.length("content") % width != 0, F.raise_error(F.lit("size is no multiple of the id width"))).otherwise(F.col("content"))
    return (files.where(F.length("content") > 0).select("file", checked.alias("content"), cut)
            .select("file", "block", F.substring("content", F.col("block") * step + 1, F.lit(step)).alias("data")))


def count_tokens(files: DataFrame, eod: int, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in (file, content) rows."""
    width = np.dtype(dtype).itemsize

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column("data").to_pylist():
                ids = np.frombuffer(data, dtype)
                at = np.flatnonzero(ids == eod)
                rows.append((len(ids), len(at), int(at[-1]) if len(at) else None, at.tolist()))
            yield pa.record_batch([batch.column("file"), batch.column("block"), pa.array([r[0] for r in rows], pa.int64()),
                                   pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
                                   pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["file", "block", "n", "k", "last", "at"])

    found = blocks_of(files, width, block_bytes).mapInArrow(run, "file string, block int, n long, k long, last long, at array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    base = F.coalesce(F.sum("n").over(before), F.lit(0))
    scanned = found.withColumn("base", base).withColumn("total", F.sum("n").over(whole)).withColumn("docs", F.coalesce(F.sum("k").over(before), F.lit(0)))
    scanned = scanned.withColumn("opened", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
    # Ends of this block's documents; the file's last block adds the rest after the last separator, if any.
    ends = F.transform("at", lambda p: F.struct((F.col("base") + p).alias("e"), F.lit(True).alias("ended")))
    is_last = (F.col("base") + F.col("n")) == F.col("total")
    open_from = F.when(F.col("k") > 0, F.col("base") + F.col("last") + 1).otherwise(F.col("opened"))
    tail = F.when(is_last & (open_from < F.col("total")), F.array(F.struct(F.col("total").alias("e"), F.lit(False).alias("ended")))).otherwise(
        F.array().cast("array<struct<e:bigint,ended:boolean>>"))
    ends = F.concat(ends, tail)
    listed = scanned.select("file", "docs", "opened", ends.alias("ends"))
    each = listed.select("file", "docs", "opened", "ends", F.posexplode("ends").alias("i", "d"))
    start = F.when(F.col("i") == 0, F.col("opened")).otherwise(F.element_at("ends", F.col("i"))["e"] + 1)
    return each.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("d.e") - start).alias("n_tokens"),
                       F.col("d.ended").alias("ended"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the token files below `folder`."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(f"{folder}/tokens")
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def document_counts(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, eod: int, dtype: str = "<u2",
                    block_bytes: int = BLOCK_BYTES, most: int = FILE_BYTES) -> DataFrame:
    """doc_id, file, ordinal, start, n_tokens per row of (doc_id, text), by way of flat files in the shared folder."""
    spark = docs.sparkSession
    folder = scratch_dir(spark, "tokens")
    placed = write_files(docs, folder, json_path, ranks_path, pattern, eod, dtype, most)
    if placed.isEmpty():
        return placed.selectExpr("doc_id", "file", "ordinal", "0L AS start", "0L AS n_tokens")
    # Contents go straight from the scan into the search and are never exchanged; this join leaves out files the table does not name.
    counts = count_tokens(read_files(spark, folder), eod, dtype, block_bytes)
    return placed.join(counts, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
