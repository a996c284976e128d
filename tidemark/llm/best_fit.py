"""Packing whole documents into as few sequences as possible by a configuration linear program.

Only the histogram of lengths decides: at most one number per length up to the window, whatever the size of the corpus. A
configuration is a set of lengths that fit one sequence. The program (least number of sequences so that every length is
covered as often as it occurs) is solved by multiplicative weights: lengths covered less than others gain price, a knapsack
by dynamic programming over the prices yields the best configurations around the lengths that lag, and they are
taken in small amounts, level by level. Rounding takes whole numbers of configurations as far as pieces last; what is left is
solved again, and the last few sequences take the longest piece and the pieces that fill the rest best.

Spark does all that grows: texts become pieces in one pass, pieces are counted per task and length, running sums give each
piece its place among those of its length, and a table of configurations (its size depends on the window alone) gives the
sequence and place. A length with a third of all pieces is numbered task by task, so no task holds them.

Defined results: null and empty texts are one end id; repeated rows, and rows without a doc_id, are packed as they stand; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.byte_words import spelled
from tidemark.llm.shipping import ship
from tidemark.session import materialize

WINDOW = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
LEVELS, PER_PRICING, PRICINGS, SPREAD = 12, 24, 240, 0.25
Configuration = tuple[tuple[int, int], ...]  # (length, how often), longest first


class WordIds(dict):
    """Token ids of texts as bytes of 32-bit numbers, for a lower-casing tokenizer that never joins what white space separates.

    The tokenizer divides a text into endings after an apostrophe, runs of letters, digits and runs of marks. Where a text holds ASCII
    and Latin letters only, the same division is made here, and the model turns each distinct run into ids once. Other words
    go through the whole tokenizer. A worker process keeps one bounded table for all its tasks.
    """

    LIMIT = 250_000
    PLAIN = re.compile(r"[\x20-;=-{}~\t\n\rÀ-ÖØ-öø-ÿ]*")  # without what may open a special token
    RUNS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[!-/:;=-@\[-`{}~]+")
    kept: dict[str, WordIds] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.each = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    @classmethod
    def at(cls, path: str) -> WordIds:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        if self.PLAIN.fullmatch(text):
            runs = self.RUNS.findall(text.lower())
        else:
            runs = []
            for word in text.split(" "):
                runs += self.RUNS.findall(word.lower()) if self.PLAIN.fullmatch(word) else [word]
        if len(self) > self.LIMIT:
            self.clear()
        return b"".join(map(self.__getitem__, runs))

    def __missing__(self, run: str) -> bytes:
        if self.RUNS.fullmatch(run):  # one word for the model
            each = self.each
            packed = b"".join([each[t.id] for t in self.model.tokenize(spelled(run))])
        else:
            packed = self.whole(run)
        self[run] = packed
        return packed


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most a window, each with the task that made it and its number among that task's pieces of its length."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part, seen = WordIds.at(tokenizer_path), TaskContext.get().partitionId(), [0] * (window + 1)
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = t.as_py()
                packed = memoryview((ids.of(t) if t else b"") + end)
                total = len(packed) // 4
                for piece, start in enumerate(range(0, total, window)):
                    length = min(window, total - start)
                    rows.append((d, piece, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
            if rows:
                kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in PIECES.split(", ")])

    shown = docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t"))
    return shown.mapInArrow(run, PIECES)


def knapsack(lengths: np.ndarray, prices: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For every size the greatest price of pieces that fit it, and the last piece of such a choice (-1: the next smaller size)."""
    value, last = np.zeros(window + 1), np.full(window + 1, -1)
    upto = np.searchsorted(lengths, np.arange(window + 1), "right")  # lengths increase
    for size in range(1, window + 1):
        best, kind = value[size - 1], -1
        n = upto[size]
        if n:
            sums = value[size - lengths[:n]] + prices[:n]
            i = int(sums.argmax())
            if sums[i] > best + 1e-9:
                best, kind = sums[i], i
        value[size], last[size] = best, kind
    return value, last


def fractional(lengths: np.ndarray, wanted: np.ndarray, window: int) -> dict[Configuration, float]:
    """Configurations and how often each is taken, by multiplicative weights. Each length's coverage rises level by level."""
    covered = np.zeros(len(lengths))
    amounts: dict[Configuration, float] = {}
    pricings = 0
    for level in range(1, LEVELS + 1):
        target = level / LEVELS
        while pricings < PRICINGS:
            share = covered / wanted
            late = np.flatnonzero(share < target - 1e-9)
            if not len(late):
                break
            pricings += 1
            prices = lengths * np.exp(-SPREAD * (share - target))
            value, last = knapsack(lengths, prices, window)
            with_it = prices[late] + value[window - lengths[late]]
            for number, i in enumerate(late[np.argsort(-with_it, kind="stable")][:PER_PRICING]):
                if covered[i] >= wanted[i] * target:
                    continue
                held, size = {int(i): 1}, window - int(lengths[i])
                while size > 0:
                    j = int(last[size])
                    if j < 0:
                        size -= 1
                    else:
                        held[j] = held.get(j, 0) + 1
                        size -= int(lengths[j])
                amount = (wanted[i] * target - covered[i]) / held[int(i)]
                room = min((wanted[j] * (target + 1 / LEVELS) - covered[j]) / m for j, m in held.items())
                if number:  # the first is taken in full, so that every pricing covers something
                    amount = min(amount, room)
                if amount <= 0:
                    continue
                for j, m in held.items():
                    covered[j] += m * amount
                key = tuple(sorted(((int(lengths[j]), m) for j, m in held.items()), reverse=True))
                amounts[key] = amounts.get(key, 0.0) + amount
    return amounts


def fullest(left: dict[int, int], window: int) -> Configuration:
    """The longest piece with those that fill the rest best, long ones first. Sums that can be reached are the bits of a number."""
    longest = max(left)
    room = window - longest
    mask = (1 << (room + 1)) - 1
    sums, trail = 1, []
    for length in sorted((x for x in left if x <= room), reverse=True):
        most = min(left[length] - (length == longest), room // length)
        take = 1
        while most > 0:  # 1, 2, 4 ... copies
            n = min(take, most)
            trail.append((length, n, sums))
            sums |= (sums << (length * n)) & mask
            most -= n
            take *= 2
        if sums >> room & 1:
            break
    total, held = sums.bit_length() - 1, {longest: 1}
    for length, n, before in reversed(trail):
        if total and not before >> total & 1:
            held[length] = held.get(length, 0) + n
            total -= length * n
    return tuple(sorted(held.items(), reverse=True))


def configurations(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[Configuration, int]]:
    """Configurations with how many sequences use each; together they hold every piece of the histogram once."""
    left = {length: n for length, n in histogram.items() if n and length < window}
    out: list[tuple[Configuration, int]] = []
    if histogram.get(window):
        out.append((((window, 1),), histogram[window]))

    def use(configuration: Configuration, times: int) -> int:
        times = min([times, *(left.get(length, 0) // m for length, m in configuration)])
        if times > 0:
            out.append((configuration, times))
            for length, m in configuration:
                left[length] -= m * times
                if not left[length]:
                    del left[length]
        return times

    while left:
        volume = sum(length * n for length, n in left.items())
        lengths = np.array(sorted(left))
        solved = fractional(lengths, np.array([left[x] for x in lengths.tolist()], float), window)
        taken = 0
        for configuration, amount in sorted(solved.items(), key=lambda x: (-x[1], x[0])):
            full = sum(length * m for length, m in configuration) == window
            taken += use(configuration, int(np.ceil(amount)) if full else int(amount))
        if taken * window * 2 < volume or volume < 64 * window:
            break
    while left:
        use(fullest(left, window), max(left.values()))
    return out


def slots(chosen: list[tuple[Configuration, int]]) -> np.ndarray:
    """Rows (length, first number, copies per sequence, first sequence, offset), by length and number."""
    rows, given, sequence = [], {}, 0
    for configuration, times in chosen:
        offset = 0
        for length, m in configuration:
            rows.append((length, given.get(length, 0), m, sequence, offset))
            given[length] = given.get(length, 0) + m * times
            offset += length * m
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(numbered: DataFrame, table: np.ndarray) -> DataFrame:
    """Pieces with their number among all of their length, to sequences and places in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        lengths = np.unique(table[:, 0])
        edges = {int(x): (int(a), int(b)) for x, a, b in zip(lengths, np.searchsorted(table[:, 0], lengths), np.searchsorted(table[:, 0], lengths, "right"))}
        for b in batches:
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = np.zeros(len(b), np.int64)
            for x in np.unique(length).tolist():
                first, end = edges[x]
                mine = length == x
                row[mine] = first + np.searchsorted(table[first:end, 1], number[mine], "right") - 1
            _, begin, copies, sequence, offset = table[row].T
            nth = number - begin
            columns = [b.column(c) for c in names[:5]] + [pa.array(sequence + nth // copies), pa.array(offset + nth % copies * length)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return numbered.mapInArrow(run, RESULT)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents placed in as few sequences as found."""
    held = materialize(pieces(docs, tokenizer_path, window, end_id, doc_id, text), "pieces")
    counted = materialize(held.groupBy("part", "length").agg(F.count("*").alias("n")), "counted")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length
    if not histogram:
        return docs.sparkSession.createDataFrame([], RESULT)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = held.join(based.hint("merge"), ["part", "length"]).withColumn("number", F.col("base") + F.col("nth"))
    return place(numbered, slots(configurations(histogram, window)))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary_path())
