"""Token ids as fixed-length sequences in Arrow files, and reading them back.

One file per range of documents, in ascending ``doc_id`` order.  A file holds record
batches with two fixed-size-list columns: ``ids`` (16 bits when the vocabulary allows)
and ``mask`` (true where an id belongs to a document; only a file's last sequence has
padding).  Any sequence is found by its number and read from a mapped file without
copying (``TokenFile``).

Each task writes under a name of its own, and the index (a Parquet table committed by
Spark) names only the files of successful tasks, so a repeated or lost task leaves
nothing behind that counts.

Defined results: a null text counts as empty and gives the end id alone; rows with a
null ``doc_id`` come first; repeated rows are written one after the other; an empty table
gives an index without rows.  Extra columns do not matter.
"""

from __future__ import annotations

import sys
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leakguard.llm import tokens
from leakguard.llm.shared import text_or_empty

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 2048
SEQUENCES_PER_BATCH = 256
_INDEX = "doc_id bigint, file string, shard int, begin bigint, n_tokens bigint"


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


class _Writer:
    """Sequences of one file; holds at most one record batch of ids."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        ids = pa.list_(pa.from_numpy_dtype(self.dtype), length)
        self.schema = pa.schema([("ids", ids), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> int:
        """Append ids; returns the place of the first in the file."""
        begin = self.written + self.held
        self.parts.append(ids)
        self.held += len(ids)
        step = self.length * SEQUENCES_PER_BATCH
        if self.held >= step:
            flat = np.concatenate(self.parts)
            full = len(flat) // step * step
            for i in range(0, full, step):
                self._put(flat[i : i + step])
            self.parts, self.held = [flat[full:]], len(flat) - full
        return begin

    def _put(self, flat: np.ndarray) -> None:
        count = len(flat)
        padded = -(-count // self.length) * self.length
        ids, mask = np.zeros(padded, self.dtype), np.zeros(padded, bool)
        ids[:count], mask[:count] = flat, True
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), type=field.type)
            for values, field in zip((ids, mask), self.schema, strict=True)
        ]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))
        self.written += count

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.parts))
        self.out.close()


class TokenFile:
    """Random access to the sequences of one file."""

    def __init__(self, uri: str):
        system, path = _filesystem(uri)
        local = isinstance(system, fs.LocalFileSystem)
        self._source = pa.memory_map(path) if local else system.open_input_file(path)
        self._file = pa.ipc.open_file(self._source)
        self.length = self._file.schema.field("ids").type.list_size
        self._at = (-1, None, None)

    def _batch(self, i: int) -> tuple[np.ndarray, pa.Array]:
        if self._at[0] != i:
            batch = self._file.get_batch(i)
            self._at = (i, batch.column(0).flatten().to_numpy(zero_copy_only=True), batch.column(1).flatten())
        return self._at[1:]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file where it is mapped) and mask of a sequence."""
        batch, row = divmod(number, SEQUENCES_PER_BATCH)
        ids, mask = self._batch(batch)
        at = slice(row * self.length, (row + 1) * self.length)
        return ids[at], mask[at.start : at.stop].to_numpy(zero_copy_only=False)

    def span(self, begin: int, count: int) -> np.ndarray:
        """``count`` ids from place ``begin`` of the file."""
        step, parts = self.length * SEQUENCES_PER_BATCH, []
        while count > 0:
            batch, at = divmod(begin, step)
            ids, mask = self._batch(batch)
            take = min(count, step - at)
            part = ids[at : at + take]
            if len(part) < take or not mask[at : at + take].true_count == take:
                raise ValueError("the index points behind the ids of the file")
            parts.append(part)
            begin, count = begin + take, count - take
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)

    def close(self) -> None:
        self._source.close()


def _write_task(folder: str, tokenizer: str, end_id: int, length: int):
    def write(batches):
        from pyspark import TaskContext

        dtype = np.uint16 if _vocabulary(tokenizer) <= 1 << 16 else np.uint32
        shard = TaskContext.get().partitionId()
        file = f"{folder}/ids-{shard:06d}-{uuid.uuid4().hex}.arrow"
        system, path = _filesystem(file)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        end = np.array([end_id], dtype)
        sink = writer = None
        for batch in batches:
            docs, texts = batch.column(0), (x.as_py() for x in batch.column(1))
            begins, counts = [], []
            for encoded in tokens.encode_all(tokenizer, texts):
                if writer is None:
                    sink = system.open_output_stream(path)
                    writer = _Writer(sink, length, dtype)
                ids = np.concatenate([np.frombuffer(encoded, "<u4").astype(dtype), end])
                begins.append(writer.add(ids))
                counts.append(len(ids))
            n = len(begins)
            yield pa.RecordBatch.from_arrays(
                [
                    docs.cast(pa.int64()),
                    pa.array([file] * n, pa.string()),
                    pa.array([shard] * n, pa.int32()),
                    pa.array(begins, pa.int64()),
                    pa.array(counts, pa.int64()),
                ],
                ["doc_id", "file", "shard", "begin", "n_tokens"],
            )
        if writer is not None:
            writer.close()
            sink.close()

    return write


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = SEQUENCE) -> DataFrame:
    """Write the files into ``folder`` (a URI all executors reach); returns the index."""
    spark = docs.sparkSession
    ordered = (
        docs.select(F.col("doc_id").cast("bigint"), text_or_empty("text").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
    )
    index = f"{folder}/index"
    ordered.mapInArrow(_write_task(folder, tokenizer, end_id, length), _INDEX).write.parquet(index)
    return spark.read.schema(_INDEX).parquet(index)


def _read_task(batches):
    file = reader = None
    for batch in batches:
        sums = []
        for name, begin, count in zip(*(batch.column(c).to_pylist() for c in ("file", "begin", "n_tokens")), strict=True):
            if name != file:
                if reader is not None:
                    reader.close()
                file, reader = name, TokenFile(name)
            sums.append(zlib.crc32(reader.span(begin, count).astype("<u4").tobytes()))
        columns = [batch.column(c) for c in ("doc_id", "shard", "begin", "n_tokens")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(sums, pa.int64())], ["doc_id", "shard", "begin", "n_tokens", "ids_crc32"]
        )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it; the totals of the files that it
    needs are one row per file.
    """
    index = spark.read.schema(_INDEX).parquet(f"{folder}/index")
    sums = (
        index.repartition("shard")
        .sortWithinPartitions("shard", "begin")
        .mapInArrow(_read_task, "doc_id bigint, shard int, begin bigint, n_tokens bigint, ids_crc32 bigint")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return sums.join(base, "shard").selectExpr("doc_id", "base + begin as start", "n_tokens", "ids_crc32")
