"""Repeated passages by a difference cover and blockwise suffix buckets.

A start repeats when the ``LENGTH`` bytes from it also start earlier (smaller doc_id, or same document and earlier).
All bytes of repeating strings are removed; strings are judged on the input.

1. Cover: within a document the starts whose place modulo 57 lies in a difference cover are the sample. Two equal
   strings of 100 bytes hold, at some common shift below 57, a sampled start in both, and the 44 bytes from it are equal.
   Sampled starts are put into suffix buckets by those bytes; what meets nothing there proves its neighbourhood unique.
2. Ranks: the surviving sampled starts are sorted bucket by bucket on 156 bytes. One that also starts earlier settles 57 starts
   at once, since the next common sampled start is at most 57 bytes away. This resolves long ties.
3. Suffixes: only starts that are still open (the first copies, and the edges of repeated runs) are sorted on their
   100 bytes, again bucket by bucket.

A bucket holds a fixed share of the text whatever its size. Blocks send each distinct string once, so a passage in a
third of all documents costs a bucket one entry per block. Whole copies of a text of at least 100 bytes are settled by
their SHA-256 before. Strings are compared by 64 hash bits, the bits that choose the bucket among them; no bytes are compared.

Defined results: null text is empty; a null doc_id is the smallest; rows that share a doc_id are ordered as stored, and
of repeated rows only the first keeps its text. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.llm import blocks as B
from tidemark.llm.hashing import Rolling
from tidemark.session import materialize

LENGTH = 100
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)  # every difference modulo 57 occurs
SHORT = LENGTH - PERIOD + 1
LONG = LENGTH + PERIOD - 1


class Pass:
    """What one block knows after the answers it has."""

    def __init__(self, rolling: Rolling, block: B.Block, copies: list[int] | None) -> None:
        self.block, self.rolling = block, rolling
        sizes = block.ends - block.starts
        self.copy = np.zeros(len(block), bool)
        self.copy[copies or []] = True
        self.copy &= sizes >= LENGTH
        n = len(block.data)
        self.doc = np.repeat(np.arange(len(block), dtype=np.int32), sizes)
        place = np.arange(n, dtype=np.int32)
        self.room = block.ends.astype(np.int32)[self.doc] - place
        live = ~self.copy[self.doc]
        in_cover = np.zeros(PERIOD, bool)
        in_cover[list(COVER)] = True
        self.sums = rolling.prefix(block.data)
        self.sample = np.flatnonzero(in_cover[(place - block.starts.astype(np.int32)[self.doc]) % PERIOD] & live & (self.room >= SHORT))
        self.live = live

    def short(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings at sampled starts, where each start's string stands among them, how often each occurs here."""
        return np.unique(self.rolling.windows(self.sums, self.sample, SHORT), return_inverse=True, return_counts=True)

    def long(self, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sampled starts that met another, with room for a long string: distinct strings, first starts, all starts, inverse."""
        _, inverse, counts = self.short()
        self.met = self.sample[((counts > 1) | short)[inverse]]
        starts = self.met[self.room[self.met] >= LONG]
        keys, first, inverse = np.unique(self.rolling.windows(self.sums, starts, LONG), return_index=True, return_inverse=True)
        return keys, starts[first], starts, inverse

    def open(self, short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for the starts that the long strings leave open; settles the others in ``repeats``."""
        _, first, starts, inverse = self.long(short)
        settled = starts[long[inverse] | (starts != first[inverse])]
        n = len(self.block.data)
        self.repeats = self._reach(settled, PERIOD, n)
        near = self._reach(self.met - (PERIOD - 1), PERIOD, n)
        starts = np.flatnonzero(near & ~self.repeats & self.live & (self.room >= LENGTH))
        keys, first, inverse = np.unique(self.rolling.windows(self.sums, starts, LENGTH), return_index=True, return_inverse=True)
        return keys, starts[first], starts, inverse

    @staticmethod
    def _reach(starts: np.ndarray, length: int, n: int) -> np.ndarray:
        """Which of n places lie within ``length`` from any of the starts."""
        steps = np.zeros(n + 1, np.int32)
        np.add.at(steps, np.clip(starts, 0, n), 1)
        np.add.at(steps, np.clip(starts + length, 0, n), -1)
        return np.cumsum(steps[:n], dtype=np.int32) > 0

    def removed(self, short: np.ndarray, long: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        """Which bytes go."""
        _, first, starts, inverse = self.open(short, long)
        again = starts[suffix[inverse] | (starts != first[inverse])]
        n = len(self.block.data)
        gone = self._reach(np.concatenate([np.flatnonzero(self.repeats), again]), LENGTH, n)
        return gone | ~self.live

    def sent(self, keys: np.ndarray, first: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
        yield from B.blobs(self.block.number, keys, buckets, "<u8", self.block.order[self.doc[first]].astype("<i8"))


def _met(_: list[int], keys: list[bytes], __: list[bytes]) -> list[bytes]:
    """For each block's strings, whether another block sent the same."""
    every = np.concatenate([np.frombuffer(x, "<u4") for x in keys])
    ordered = np.sort(every)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(again):
        return [B.bits(np.zeros(len(x) // 4, bool)) for x in keys]
    place = np.minimum(np.searchsorted(again, every), len(again) - 1)
    hit, at = again[place] == every, np.cumsum([0] + [len(x) // 4 for x in keys])
    return [B.bits(hit[a:b]) for a, b in zip(at, at[1:])]


def _earlier(numbers: list[int], keys: list[bytes], ids: list[bytes]) -> list[bytes]:
    """For each block's strings, whether another block has the same earlier."""
    sizes = [len(x) // 8 for x in keys]
    every = np.frombuffer(b"".join(keys), "<u8")
    owner = np.frombuffer(b"".join(ids), "<i8")
    block = np.repeat(np.array(numbers, np.int64), sizes)
    order = np.lexsort((block, owner, every))
    ordered = every[order]
    hit = np.zeros(len(every), bool)
    hit[order[1:]] = ordered[1:] == ordered[:-1]
    at = np.cumsum([0, *sizes])
    return [B.bits(hit[a:b]) for a, b in zip(at, at[1:])]


def _passed(x: dict, rolling: Rolling) -> tuple[Pass, list[np.ndarray]]:
    state = Pass(rolling, B.Block.read(x["block"], x["data"]), x.get("copies"))
    return state, [B.flags(x[k]) for k in ("short", "long", "suffix") if k in x]


def _step(level: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            for i in range(len(batch)):
                state, said = _passed(batch.slice(i, 1).to_pylist()[0], rolling)
                if level == 0:
                    keys = state.short()[0]
                    yield from B.blobs(state.block.number, keys, buckets, "<u4")
                    continue
                short = _sized(said[0], len(state.short()[0]))
                if level == 1:
                    keys, first = state.long(short)[:2]
                else:
                    long = _sized(said[1], len(state.long(short)[0]))
                    keys, first = state.open(short, long)[:2]
                yield from state.sent(keys, first, buckets)

    return run


def _sized(said: np.ndarray, n: int) -> np.ndarray:
    if len(said) != n:
        raise ValueError(f"{len(said)} answers for {n} strings")
    return said


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """The blocks of a table and the answers that tell which of their bytes go."""
    blocks = B.build(docs, doc_id, text, keep)
    buckets = B.bucket_count(blocks)
    answers = [materialize(B.copies(B.rows(blocks)), "copies")]
    for level, (name, how) in enumerate((("short", _met), ("long", _earlier), ("suffix", _earlier))):
        sent = B.beside(blocks, answers).mapInArrow(_step(level, buckets), B.blob_schema())
        answers.append(B.exchange(sent, how, name))
    return blocks, answers


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pass, np.ndarray]]:
    rolling = Rolling()
    for batch in batches:
        for i in range(len(batch)):
            state, (short, long, suffix) = _passed(batch.slice(i, 1).to_pylist()[0], rolling)
            short = _sized(short, len(state.short()[0]))
            long = _sized(long, len(state.long(short)[0]))
            yield state, state.removed(short, long, _sized(suffix, len(state.open(short, long)[0])))


def removal_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the remaining bytes) per document."""
    blocks, answers = removals(docs, doc_id, text)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state, gone in _gone(batches):
            block, n_removed, n_spans, kept = state.block, [], [], []
            for a, b in zip(block.starts, block.ends):
                part = gone[a:b]
                count = int(part.sum())
                n_removed.append(count)
                n_spans.append(int(part[0]) + int((part[1:] & ~part[:-1]).sum()) if count else 0)
                kept.append(hashlib.sha256(block.data[a:b][~part] if count else block.data[a:b]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [block.batch.column("__id"), pa.array(block.ends - block.starts, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return B.beside(blocks, answers).mapInArrow(report, schema)


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length_column: str | None = None) -> DataFrame:
    """The table with repeated passages taken out of the text; every row stays.

    A cut may fall inside a character; its remaining bytes go as well. ``length_column`` then holds the characters left.
    """
    others = tuple(c for c in docs.columns if c not in (doc_id, text))
    blocks, answers = removals(docs, doc_id, text, others)
    names = docs.columns
    schema = StructType([docs.schema[c] for c in names])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for state, gone in _gone(batches):
            block = state.block
            texts = [block.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore") for a, b in zip(block.starts, block.ends)]
            columns = {doc_id: block.batch.column("__id"), text: pa.array(texts, pa.string())}
            if others:
                columns |= dict(zip(others, block.batch.column("__kept").flatten()))
            if length_column in columns:
                columns[length_column] = pa.array(list(map(len, texts)), columns[length_column].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return B.beside(blocks, answers).mapInArrow(cleaned, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return removal_report(spark.read.parquet(f"{folder}/documents.parquet"))


#: Strings are taken as hex text, two characters a byte; a string's first place is the least of its copies.
ORACLE = """
WITH texts AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 99)) AS i FROM texts WHERE len(h) >= 200)),
again AS MATERIALIZED (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM strings) WHERE nth > 1),
islands AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM again)) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM islands UNION ALL SELECT doc_id, 0, min(a) FROM islands GROUP BY doc_id),
kept AS (SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS k FROM gaps g JOIN texts t ON t.doc_id = g.doc_id GROUP BY g.doc_id),
runs AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM islands GROUP BY doc_id)
SELECT t.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id LEFT JOIN runs r ON r.doc_id = t.doc_id
"""
