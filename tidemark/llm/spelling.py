"""Spelling variants: words one edit apart, each led to its most frequent neighbour.

Words are counted over all texts and merged before they are shuffled. Two words one edit apart share the first half of the
shorter one, or its second half. So each word stands in lists of words that share a half, read forwards or backwards; a list is
sorted by what is left of its words. A word is compared with a list by the rows of its edit matrix, three
cells wide: of the next word only the rows beyond the prefix it shares with the one before are made anew, and where no cell of
a row is at most one, all words that share the prefix so far are skipped. A pair is taken in the half that holds its first
difference, so it comes once. A list with more than ``LIST`` words is divided, and its parts
meet two by two, so a task holds at most twice as many words.

Defined results: null and empty texts hold no words; a null id counts as empty text in the choice of the deleted letter;
repeated rows count as often as they stand there; words of equal count compete by code points; an empty table gives no
rows. Very long words take part whole. Other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shipping import ship
from tidemark.llm.vectors import runs
from tidemark.session import materialize

LETTERS = "[A-Za-zÀ-ÿ]+"
SHORTEST, SELDOM, RATIO = 6, 5, 5
EVERY = 199  # a run in so many loses a letter
LIST = 20_000
PAIRS = "word string, near string, near_n long"
FLUSH = 50_000


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """One row per run of letters, lower-cased in A-Z, some with a letter deleted: word."""
    lower = F.translate(docs[text], string.ascii_uppercase, string.ascii_lowercase)
    runs_ = docs.select(
        F.concat(F.coalesce(docs[doc_id].cast("string"), F.lit("")), F.lit(":")).alias("of"),
        F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"),
    )
    hashed = runs_.select("run", F.crc32(F.concat("of", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, seldom: int = SELDOM) -> DataFrame:
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= seldom)


def lists(words: DataFrame, most: int = LIST) -> DataFrame:
    """Every word in its lists: key (with the parts that meet), rest, its length's role, and whether it is listed, visits, or both."""
    length = F.length("word")
    entries = []
    for longer in (0, 1):  # as the shorter word of a pair or one of two equally long ones, and as the longer one
        short = length - longer
        half = F.floor(short / 2).cast("int")
        rest = short - half
        entries.append(F.struct(short.alias("of"), F.lit("f").alias("way"), F.substring("word", F.lit(1), half).alias("kept"), F.substring("word", half + 1, length).alias("rest"), F.lit(longer).alias("longer")))
        entries.append(F.struct(short.alias("of"), F.lit("b").alias("way"), F.substring("word", length - rest + 1, length).alias("kept"), F.reverse(F.substring("word", F.lit(1), length - rest)).alias("rest"), F.lit(longer).alias("longer")))
    held = words.select("word", "n", F.explode(F.array(*entries)).alias("e")).select(
        "word", "n", F.concat_ws("\t", F.col("e.of").cast("string"), "e.way", "e.kept").alias("key"), "e.rest", "e.longer"
    )
    large = held.groupBy("key").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = (
        held.join(large, "key", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
        .select("word", "n", "key", "rest", "longer", "mine", other)
    )
    # Listed in its own part's meetings with every part, visiting every part's meeting with its own.
    same = F.col("mine") == F.col("other")
    meetings = F.when(same, F.array(F.struct(F.col("mine").alias("a"), F.col("mine").alias("b"), F.lit(True).alias("listed"), F.lit(True).alias("visits")))).otherwise(
        F.array(
            F.struct(F.col("mine").alias("a"), F.col("other").alias("b"), F.lit(True).alias("listed"), F.lit(False).alias("visits")),
            F.struct(F.col("other").alias("a"), F.col("mine").alias("b"), F.lit(False).alias("listed"), F.lit(True).alias("visits")),
        )
    )
    return dealt.select("word", "n", "key", "rest", "longer", F.explode(meetings).alias("m")).select(
        "word", "n", F.concat_ws("\t", "key", F.col("m.a").cast("string"), F.col("m.b").cast("string")).alias("key"), "rest", "longer", "m.listed", "m.visits"
    )


def shared(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


class SortedList:
    """Sorted texts with the prefixes that neighbours share."""

    def __init__(self, texts: list[str]) -> None:
        self.texts = texts
        n = len(texts)
        self.common = [0, *map(shared, texts, texts[1:])]
        self.after = [n] * n  # the next place whose common prefix is shorter than this one's
        open_: list[int] = []
        for i in range(n - 1, -1, -1):
            while open_ and self.common[open_[-1]] >= self.common[i]:
                open_.pop()
            if open_:
                self.after[i] = open_[-1]
            open_.append(i)

    def within_one(self, word: str) -> list[int]:
        """Places of the texts at most one edit from a word.

        Row i holds the distances of the text's first i letters to the word's first i - 1, i and i + 1.
        """
        texts, common, after, n, m = self.texts, self.common, self.after, len(self.texts), len(word)
        found = []
        rows = [(2, 0, 1 if m else 2)]
        k = 0
        while k < n:
            text = texts[k]
            del rows[common[k] + 1 :]
            i = len(rows) - 1
            low, mid, high = rows[-1]
            end, size = False, len(text)
            while i < size:
                c = text[i]
                i += 1
                left = min(low + (c != word[i - 2]) if 2 <= i <= m + 1 else 2, mid + 1)
                centre = min(mid + (c != word[i - 1]), left + 1, high + 1) if i <= m else 2
                right = min(high + (c != word[i]), centre + 1) if i < m else 2
                low, mid, high = left, centre, right
                rows.append((low, mid, high))
                if low > 1 and mid > 1 and high > 1:
                    end = True
                    break
            if end:
                k += 1
                while k < n and common[k] >= i:
                    k = after[k]
                continue
            if -1 <= m - size <= 1 and (low, mid, high)[m - size + 1] <= 1:
                found.append(k)
            k += 1
        return found


def scanned(key: str, words: list[str], n: list[int], rest: list[str], longer: list[int], listed: list[bool], visits: list[bool]) -> Iterator[tuple[str, str, int]]:
    """Ordered pairs of near words of one list: word, near word and its count."""
    backwards, half = key.split("\t")[1] == "b", int(key.split("\t")[0]) // 2
    here = [i for i in range(len(words)) if listed[i]]
    held = SortedList([rest[i] for i in here])
    for q in range(len(words)):
        if not visits[q]:
            continue
        for place in held.within_one(rest[q]):
            i = here[place]
            if i == q or (longer[i] and longer[q]):  # two longer words meet under their own length
                continue
            if backwards and shared(words[i], words[q]) >= half:  # these meet forwards
                continue
            yield words[q], words[i], n[i]


def near_pairs(words: DataFrame, most: int = LIST) -> DataFrame:
    """Ordered pairs of words one edit apart."""
    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[str, str, int]] = []

        def flush() -> pa.RecordBatch:
            a, b, n = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

        for one in runs(batches, ["key"]):
            if len(one) < 2:
                continue
            d = one.to_pydict()
            for pair in scanned(d["key"][0], d["word"], d["n"], d["rest"], d["longer"], d["listed"], d["visits"]):
                out.append(pair)
                if len(out) >= FLUSH:
                    yield flush()
        if out:
            yield flush()

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given: little is read for much work
    dealt = lists(words, most).repartition(tasks, "key").sortWithinPartitions("key", "rest")
    return dealt.mapInArrow(run, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """Where the forms of words lead in the end: word, root. Each step doubles the stretch; counts grow fivefold per form, so there are few."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went"))
        now = materialize(joined, "roots")
        if now.where("went").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO, most: int = LIST) -> DataFrame:
    """Every frequent word with the form it is a variant of: word, form, root, n, n_near, form_n."""
    words = materialize(vocabulary(occurrences(docs, doc_id, text)), "words")
    best = near_pairs(words, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best")
    )
    is_form = -F.col("best.least") >= ratio * F.col("n")
    held = materialize(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.least")).alias("form_n"),
        ),
        "variants",
    )
    led = roots(held.where("form is not null"))
    return held.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return variants(spark.read.parquet(f"{folder}/documents.parquet"))


#: The checksum is computed byte by byte from the table of its polynomial; near words meet where one letter is left out or replaced.
ORACLE = f"""
WITH RECURSIVE bits(b, step, v) AS (
  SELECT b, 0, b FROM (SELECT unnest(range(256))::BIGINT AS b)
  UNION ALL SELECT b, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE step < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
hex AS MATERIALIZED (SELECT list(printf('%02X', i) ORDER BY i) AS x FROM (SELECT unnest(range(256)) AS i)),
runs AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
  translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{LETTERS}')) AS w FROM documents),
per AS MATERIALIZED (SELECT d, w, count(*) AS c, hex(encode(d || ':' || w)) AS b FROM runs WHERE length(w) >= {SHORTEST} GROUP BY d, w),
hashed AS MATERIALIZED (SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(b) // 2),
  lambda i: list_position(hex.x, b[2 * i + 1 : 2 * i + 2])::BIGINT - 1)), lambda s, y: xor(s >> 8, tab.t[(xor(s, y) & 255) + 1])), 4294967295) AS h
  FROM per, tab, hex),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM
  (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM hashed)
  WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {SELDOM}),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN cut b ON a.word = b.k
  UNION SELECT b.word, a.word, a.n FROM words a JOIN cut b ON a.word = b.k),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, min(struct_pack(least := -near_n, near := near)) AS m FROM near GROUP BY word),
held AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m.least >= {RATIO} * w.n THEN m.near END AS form,
  CASE WHEN -m.least >= {RATIO} * w.n THEN -m.least END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
led(word, goal) AS (SELECT word, word FROM held UNION ALL SELECT l.word, h.form FROM led l JOIN held h ON h.word = l.goal WHERE h.form IS NOT NULL)
SELECT h.word, h.form, l.goal AS root, h.n, h.n_near, h.form_n FROM held h JOIN led l ON l.word = h.word JOIN held e ON e.word = l.goal AND e.form IS NULL
"""
