"""Documents in blocks, for operators that look at every byte or word of a corpus several times.

A block is one row that holds some megabytes of consecutive documents as an Arrow batch. The blocks are written
once, bucketed by block number, so each later pass reads them next to the small answers of the pass before
without shuffling any text. Between passes only arrays of hashes are exchanged: a block sends each distinct hash
once to the hash's bucket, and the bucket answers with one value for each. A passage that a third of all documents
share therefore costs a bucket one entry per block.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shipping import ship
from tidemark.session import materialize, scratch_path

BLOCK_BYTES = 3 << 20
ROW_BITS = 24  # rows of a block; a row's key is block << ROW_BITS | its place
SEED = "block long, ids binary, shas binary, sizes binary, data binary"


@dataclass
class Block:
    """One block in memory. Documents stand in order of their id (null ids first, then the order of storage)."""

    number: int
    batch: pa.RecordBatch
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @classmethod
    def read(cls, number: int, packed: bytes) -> Block:
        with pa.ipc.open_stream(packed) as reader:
            batch = reader.read_next_batch()
        texts = batch.column("__text")
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
        return cls(number, batch, data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])

    def __len__(self) -> int:
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    @property
    def order(self) -> np.ndarray:
        """The documents' ids as numbers; null counts as the smallest."""
        return pc.fill_null(self.batch.column("__id"), -(1 << 63)).to_numpy(zero_copy_only=False)

    @property
    def rows(self) -> np.ndarray:
        return (self.number << ROW_BITS) + np.arange(len(self), dtype=np.int64)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Write the blocks of a table: block, ids, shas (SHA-256 of each text, null as empty), sizes, data."""
    spark = docs.sparkSession
    ship(spark)
    shown = docs.select(
        docs[doc_id].cast("long").alias("__id"),
        F.coalesce(docs[text], F.lit("")).alias("__text"),
        F.unhex(F.sha2(F.coalesce(docs[text], F.lit("")), 256)).alias("__sha"),
        F.struct(*[docs[c].alias(c) for c in keep]).alias("__kept") if keep else F.lit(0).alias("__kept"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 18
        for batch in batches:
            sizes = pc.binary_length(batch.column("__text")).to_numpy(zero_copy_only=False).astype(np.int64)
            upto, start = np.cumsum(sizes + 64), 0
            while start < len(batch):
                before = upto[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(upto, before + BLOCK_BYTES, "right")))
                part = batch.slice(start, end - start)
                part = part.take(pc.sort_indices(part, [("__id", "ascending")], null_placement="at_start"))
                texts = part.column("__text").cast(pa.large_binary())
                held = pa.RecordBatch.from_arrays([part.column("__id"), texts, part.column("__kept")], ["__id", "__text", "__kept"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, held.schema) as writer:
                    writer.write_batch(held)
                ids = pc.fill_null(part.column("__id"), -(1 << 63)).to_numpy(zero_copy_only=False)
                length = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("<i8")
                values = [number, ids.astype("<i8").tobytes(), b"".join(part.column("__sha").to_pylist()), length.tobytes(), sink.getvalue().to_pybytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64()] + [pa.binary()] * 4)], ["block", "ids", "shas", "sizes", "data"])
                number, start = number + 1, end

    name = f"blocks_{uuid.uuid4().hex}"
    count = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = shown.mapInArrow(cut, SEED).write.format("parquet").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "blocks")).bucketBy(count, "block").sortBy("block").saveAsTable(name)
    return spark.table(name)


def rows(blocks: DataFrame) -> DataFrame:
    """One lean row per document: row, doc_id, sha, size."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                ids, n = np.frombuffer(x["ids"], "<i8"), len(x["ids"]) // 8
                keys = (x["block"] << ROW_BITS) + np.arange(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(ids, mask=ids == -(1 << 63)), pa.array([x["shas"][i : i + 32] for i in range(0, 32 * n, 32)], pa.binary()), pa.array(np.frombuffer(x["sizes"], "<i8"))],
                    ["row", "doc_id", "sha", "size"],
                )

    return blocks.select("block", "ids", "shas", "sizes").mapInArrow(unpack, "row long, doc_id long, sha binary, size long")


def first_rows(lean: DataFrame) -> DataFrame:
    """Of each text that occurs again: sha, and the row with the smallest id (null first), then the smallest row."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "row"))
    return lean.groupBy("sha").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1").select("sha", F.col("f.row").alias("rep"))


def copies(lean: DataFrame) -> DataFrame:
    """Per block, the places of documents whose text stands in an earlier row: block, copies."""
    again = lean.join(first_rows(lean), "sha").where("row <> rep")
    block, place = F.shiftright("row", ROW_BITS), F.col("row").bitwiseAND((1 << ROW_BITS) - 1)
    return again.groupBy(block.alias("block")).agg(F.collect_list(place).alias("copies"))


def beside(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks with the answers for them; the blocks stay where they are."""
    out = blocks.select("block", "data")
    for x in answers:
        out = out.join(x.hint("shuffle_hash"), "block", "left")
    return out


def bucket_count(blocks: DataFrame, bytes_each: int = 32 << 20) -> int:
    """Buckets for an exchange: proportional to the text, so that a bucket's memory stays the same at any size."""
    spark = blocks.sparkSession
    total = blocks.select(F.sum(F.octet_length("data"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bytes_each))


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit keys fall into buckets by their high bits: the buckets met and where each begins and ends."""
    which = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    met, begins = np.unique(which, return_index=True)
    return met.astype(np.int64), np.append(begins, len(keys))


def blob_schema() -> str:
    return "block long, bucket int, keys binary, extra binary"


def blobs(number: int, keys: np.ndarray, buckets: int, width: str, extra: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """What a block sends: sorted distinct keys (their low ``width`` part) and a value for each."""
    met, at = in_buckets(keys, buckets)
    if not len(met):
        return
    if width == "<u4":
        # the 32 bits that follow the ones which choose the bucket
        low = (keys >> np.uint64(16)).astype("<u4")
    else:
        low = keys.astype("<u8")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(met), number, np.int64)),
            pa.array(met.astype(np.int32)),
            pa.array([low[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
            pa.array([b"" if extra is None else extra[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
        ],
        ["block", "bucket", "keys", "extra"],
    )


def exchange(sent: DataFrame, answer: Callable[[list[int], list[bytes], list[bytes]], list[bytes]], name: str) -> DataFrame:
    """Bring each bucket's arrays together, and each block's answers back: block, ``name`` (in order of buckets)."""

    def reply(frame: pd.DataFrame) -> pd.DataFrame:
        said = answer(list(frame.block), list(frame["keys"]), list(frame["extra"]))
        return pd.DataFrame({"block": frame.block, "bucket": frame.bucket, "said": said})

    said = sent.groupBy("bucket").applyInPandas(reply, "block long, bucket int, said binary")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "said"))), lambda x: x["said"])
    return materialize(said.groupBy("block").agg(ordered.alias(name)), name)


def bits(flags: np.ndarray) -> bytes:
    """Flags as bytes that know their length."""
    return bytes([len(flags) % 8]) + np.packbits(flags).tobytes()


def flags(said: list[bytes] | None) -> np.ndarray:
    """The flags of several answers, one after another."""
    parts = []
    for x in said or []:
        found = np.unpackbits(np.frombuffer(x, np.uint8, offset=1))
        parts.append(found[: len(found) - (8 - x[0]) % 8])
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
