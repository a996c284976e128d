"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition follow one another in their stored order, each closed by an end id. A stretch of them is
cut into sequences of at most ``WINDOW`` ids. A sequence is padded to the window unless its length is a power of two.
Cuts are free after a document, cost little after a sentence and more anywhere else, and the cuts of least total cost
(padding plus penalties) are found exactly: the padding of the window ending at a cut is linear in where it begins,
so the best beginning is the front of a monotone queue; lengths that are a power of two are single transitions beside it (those below
a sixteenth of the window only within a stretch's last window).
No row is shuffled, and a task holds one stretch of tokens and some megabytes of text at a time, up to the end of a document.

Defined results: null and empty texts are one end id; a long document spans sequences; repeated rows, and rows without a
doc_id, are packed as they stand; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_words import SPACE, spelled
from tidemark.llm.shipping import ship

WINDOW = 2048
END_ID = 1
TOGETHER = 1 << 22  # bytes of text whose words are looked up together, up to the end of a document
STRETCH = 1 << 19  # ids that are cut together, up to the end of a document
AFTER_SENTENCE, ANYWHERE, EACH = 4, 48, 1  # penalties in tokens, and a sequence's own
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Ids(dict):
    """Token ids of texts, as bytes of 32-bit numbers; each distinct word is tokenized once.

    Between words that one space or one line break separates the tokenizer's splits are independent, so the ids of a text are those of its
    words. Words are kept as they follow a space; ``BARE`` stands before a line break and before a word that follows one or begins the text.
    Letters are one split, and so are marks after them; letters are turned into ids by the model directly. Other words go through the
    tokenizer. Words without ids depend on what stands beside them (adjoining white space, what may be a special token): their texts go
    through the tokenizer as a whole.
    A task keeps one bounded table: a word not met while ``LIMIT`` others came leaves it. A worker process keeps the tokenizer for all its
    tasks and no words, since an idle worker's table would stand beside the memory of the stages that follow.
    """

    LIMIT = 450_000
    LONGEST = 64  # characters of a word that is kept
    BARE = "\0"
    LINE = f" {BARE}\n {BARE}"
    kept: dict[str, Ids] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.line = self.whole("\n")
        self.older: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> Ids:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def made(self, word: str) -> bytes:
        """Ids of a word that is not in the table."""
        bare = word[:1] == self.BARE
        shown = word[1:] if bare else word
        if shown.isalpha():
            spelt = spelled(shown) if bare else SPACE + spelled(shown)
            return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
        letters = shown.rstrip(punctuation)
        if letters.isalpha():
            marks = self[self.BARE + shown[len(letters) :]]
            return marks and self[word[: len(letters) - len(shown)]] + marks
        if shown == "\n":
            return self.line
        if not shown or "<|" in shown or shown[0].isspace() or shown[-1].isspace():
            return b""
        return self.whole(shown if bare else " " + shown)

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.made(word)
        if len(word) <= self.LONGEST:
            self[word] = found
        return found

    def of(self, texts: pa.LargeStringArray) -> list[np.ndarray]:
        """Ids of each text. The distinct words of all are looked up once."""
        if not len(texts):
            return []
        if len(self) > self.LIMIT:
            self.older = dict(self)
            self.clear()
        bare, nothing, space = (pa.scalar(x, pa.large_string()) for x in (self.BARE, "", " "))
        lines = pc.replace_substring(pc.binary_join_element_wise(bare, texts, nothing), "\n", self.LINE)
        words = pc.split_pattern(lines, " ")
        coded = words.flatten().dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), space)[0].as_py().split(" ")
        found = list(map(self.__getitem__, distinct))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        word = coded.indices.to_numpy()
        size, bounds = sizes[word], words.offsets.to_numpy()
        ends = np.cumsum(size)
        place = np.repeat((np.cumsum(sizes) - sizes)[word] - (ends - size), size)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(found), "<u4")[place]
        last = bounds[1:] - 1
        closed = [not size[i] and distinct[word[i]] == self.BARE for i in last.tolist()]  # empty, or a line break ends it
        odd = np.add.reduceat((size == 0).astype(np.int64), bounds[:-1]) > closed
        odd |= pc.match_substring(texts, self.BARE).to_numpy(zero_copy_only=False)
        parts = np.split(ids, ends[last[:-1]])
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.frombuffer(self.whole(texts[i].as_py()), "<u4")
        return parts

    def forget(self) -> None:
        """Give back the words, and what Arrow holds for later."""
        self.clear()
        self.older = {}
        pa.default_memory_pool().release_unused()

    def ends_sentence(self) -> np.ndarray:
        names = (self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size()))
        return np.array([x.endswith((".", "!", "?", "Ċ")) for x in names])


def cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Which of the places (the first is 0, gaps of at most a window) end a sequence, at least total cost."""
    n = len(places)
    steps = []  # from place to place, a power of two apart
    for power in (1 << p for p in range(window.bit_length())):
        wanted = places - power
        at = np.searchsorted(places, wanted)
        met = places[at] == wanted
        if power < window // 16:  # so short only near the end, where the last window may be made of them
            met &= wanted >= places[-1] - window
        steps.append((np.flatnonzero(met), at[met]))
    to, since = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(to, kind="stable")
    first, since = np.searchsorted(to[order], np.arange(n + 1)).tolist(), since[order].tolist()
    place = places.tolist()
    came, ready = [0] * n, [0.0] * n  # ready: cost with the penalty of cutting there
    spent, lowest = (penalties + EACH).tolist(), (places - window).tolist()
    keys, begins, front = [0.0], [0], 0  # a queue: cost of beginning + its place, increasing, and the index
    for j in range(1, n):
        while place[begins[front]] < lowest[j]:
            front += 1
        value, best = keys[front] - lowest[j], begins[front]
        for i in since[first[j] : first[j + 1]]:
            if ready[i] < value:
                value, best = ready[i], i
        came[j] = best
        ready[j] = value = value + spent[j]
        value += place[j]
        while len(keys) > front and keys[-1] >= value:
            keys.pop()
            begins.pop()
        keys.append(value)
        begins.append(j)
    chosen, j = [], n - 1
    while j:
        chosen.append(place[j])
        j = came[j]
    return chosen[::-1]


def _candidates(ids: np.ndarray, ends: np.ndarray, closing: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    total = int(ends[-1])
    penalties = np.full(total + 1, -1.0)
    penalties[max(0, total - window) :] = ANYWHERE  # the last window may be made of powers of two
    penalties[1:][closing[ids]] = AFTER_SENTENCE
    penalties[ends] = 0
    penalties[0] = 0
    places = np.flatnonzero(penalties >= 0)
    gaps = np.flatnonzero(np.diff(places) > window // 16)  # a stretch without sentences
    extra = [np.arange(places[g] + window // 64, places[g + 1], window // 64) for g in gaps]
    if extra:
        penalties[np.concatenate(extra)] = ANYWHERE
        places = np.flatnonzero(penalties >= 0)
    return places, penalties[places]


def _together(texts: pa.LargeStringArray) -> list[int]:
    """Where runs of some ``TOGETHER`` bytes of text end."""
    if not len(texts):
        return []
    run = np.cumsum(pc.binary_length(texts).to_numpy()) // TOGETHER
    return [*(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]


class Packer:
    """Turns documents into pieces, stretch by stretch."""

    def __init__(self, tokenizer: Ids, first: int, window: int, end_id: int, with_ids: bool) -> None:
        self.tokenizer, self.number, self.window, self.with_ids = tokenizer, first, window, with_ids
        self.closing, self.end = tokenizer.ends_sentence(), np.array([end_id], "<u4")
        self.docs, self.parts, self.size = [], [], 0

    def add(self, doc_ids: pa.Array, texts: pa.LargeStringArray) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in zip(doc_ids.to_pylist(), self.tokenizer.of(texts)):
            self.docs.append((doc_id, len(ids) + 1))
            self.parts += [ids, self.end]
            self.size += len(ids) + 1
            if self.size >= STRETCH:
                yield self.close()

    def close(self) -> pa.RecordBatch:
        ids, sizes = np.concatenate(self.parts), np.array([n for _, n in self.docs], np.int64)
        ends = np.cumsum(sizes)
        cut = np.array([0, *cuts(*_candidates(ids, ends, self.closing, self.window), self.window)], np.int64)
        at = np.union1d(cut, np.concatenate([[0], ends]))
        starts, length = at[:-1], np.diff(at)
        doc = np.searchsorted(ends, starts, "right")
        sequence = np.searchsorted(cut, starts, "right") - 1
        packed = memoryview(ids.tobytes())
        checks = [zlib.crc32(packed[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), length.tolist())]
        names = pa.array([d for d, _ in self.docs], pa.int64())
        columns = [names.take(pa.array(doc)), starts - (ends - sizes)[doc], length, checks, sizes[doc], self.number + sequence, starts - cut[sequence]]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
        columns = [x.split()[0] for x in SCHEMA.split(", ")]
        if self.with_ids:
            at32 = pa.array(at, pa.int32())
            arrays.append(pa.ListArray.from_arrays(at32, pa.array(ids.astype(np.int32))))
            columns.append("ids")
        self.number += len(cut) - 1
        self.docs, self.parts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays(arrays, columns)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents placed in sequences; with their token ids if asked for."""
    ship(docs.sparkSession)

    def pieces(batches: Iterator[pa.RecordBatch], ids: Ids) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer = Packer(ids, TaskContext.get().partitionId() << 33, window, end_id, with_ids)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            first = 0
            for end in _together(texts):
                yield from packer.add(batch.column(0)[first:end], texts[first:end])
                first = end
        if packer.docs:
            yield packer.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.at(tokenizer_path)
        try:
            yield from pieces(batches, ids)
        finally:  # its batches are gone by now
            ids.forget()

    shown = docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t"))
    return shown.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"), vocabulary_path())
