"""Documents whose sets of word shingles have a high Jaccard similarity, by prefixes under several token orders.

Two sets that are similar enough share a token within a short prefix of each, under every global order of the tokens.

1. Order by hash: each distinct text sends an extended prefix. It stays only if so many of these tokens occur in another
   text as any similar pair must share. A common passage that is a small part of a text does not keep it.
2. Order by document frequency among the texts that stay, rare first: their prefixes give the candidates, and tokens that
   occur once give none. A popular token stands in a prefix only if nearly the whole text is as popular.
3. Order by another hash: candidates must share a prefix token there as well before their sets are compared.

Only components are asked for: in the group of a token every text is first compared with one leader (the text with the fewest
tokens of its own). Groups that still hold several components are then completed: the members outside the group's largest
component are compared with all others, by the bound that the places of the token give. If the G texts of a token hardly link
(texts mixed from the same stock lines), up to G * G / 2 pairs pass these bounds, each shipped with both texts.

Equal texts are one text from the start. Texts with fewer words than a shingle are one shingle; texts without words, null
and empty ones link with nothing. A null doc_id counts as a document of its own and is no component's id unless all its ids are null;
rows that share a doc_id are separate rows. An empty table gives no rows. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm import blocks as B
from tidemark.llm.components import components
from tidemark.llm.hashing import Words, mixed, shingles
from tidemark.session import materialize

DOWN = np.int64(-(1 << 63))


class Rule:
    """Link when den * |x and y| >= num * |x or y|, over k-word shingles."""

    def __init__(self, k: int, num: int, den: int) -> None:
        self.k, self.num, self.den = k, num, den

    def slack(self, n: int) -> int:
        """How many of n tokens a similar set may lack."""
        return n * (self.den - self.num) // self.den

    def shared(self, n: int) -> int:
        """Tokens that the extended prefixes of a set of n and one as large share at least."""
        return max(1, self.slack(n))

    def needed(self, n: int) -> int:
        """The same for the smallest set that can be similar."""
        return self.shared(-(-n * self.num // self.den))

    def similar(self, x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return self.den * both >= self.num * (len(x) + len(y) - both)

    def overlap(self, n: Column, m: Column) -> Column:
        """Tokens that similar sets of these sizes share at least."""
        return F.ceil((n + m) * F.lit(self.num) / F.lit(self.num + self.den) - F.lit(1e-9))

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * F.lit(self.den) >= F.greatest(n, m) * F.lit(self.num)


def _each(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[B.Block, dict, list[tuple[int, np.ndarray]]]]:
    """Blocks with the sets of their documents, later copies of a text left out."""
    words = Words()
    for batch in batches:
        for i in range(len(batch)):
            x = batch.slice(i, 1).to_pylist()[0]
            block = B.Block.read(x["block"], x["data"])
            skipped = set(x["copies"] or [])
            yield block, x, [(d, shingles(words.of(block.text(d)), rule.k)) for d in range(len(block)) if d not in skipped]


def _prefixes(rule: Rule, sets: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The extended prefixes by hash: distinct tokens, where each stands among them, how often each occurs, its document."""
    parts = [np.partition(s, p - 1)[:p] for d, s in sets if len(s) for p in [min(len(s), rule.slack(len(s)) + rule.shared(len(s)))]]
    owner = np.repeat([d for d, s in sets if len(s)], [len(p) for p in parts])
    return *np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_inverse=True, return_counts=True), owner


def _sizes(number: int, block: B.Block, sets: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    n = np.full(len(block), -1, "<i8")
    for d, s in sets:
        n[d] = len(s)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([n.tobytes()], pa.binary()), pa.array([block.order.astype("<i8").tobytes()], pa.binary())],
        ["block", "bucket", "keys", "extra"],
    )


def _first(rule: Rule, buckets: int):
    def run(batches):
        for block, _, sets in _each(batches, rule):
            yield _sizes(block.number, block, sets)
            yield from B.blobs(block.number, _prefixes(rule, sets)[0], buckets, "<u4")

    return run


def _staying(rule: Rule, sets: list[tuple[int, np.ndarray]], met: np.ndarray) -> list[tuple[int, np.ndarray]]:
    keys, inverse, counts, owner = _prefixes(rule, sets)
    if len(met) != len(keys):
        raise ValueError(f"{len(met)} answers for {len(keys)} tokens")
    common = np.bincount(owner[((counts > 1) | met)[inverse]], minlength=max((d for d, _ in sets), default=-1) + 1) if len(owner) else []
    return [(d, s) for d, s in sets if len(s) and common[d] >= rule.needed(len(s))]


def _tokens(sets: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    every = np.concatenate([s for _, s in sets]) if sets else np.zeros(0, np.uint64)
    return np.unique(every, return_inverse=True, return_counts=True)


def _second(rule: Rule, buckets: int):
    def run(batches):
        for block, x, sets in _each(batches, rule):
            keys, _, counts = _tokens(_staying(rule, sets, B.flags(x["met"])))
            yield from B.blobs(block.number, keys, buckets, "<u4", counts.astype("<u4"))

    return run


def _third(rule: Rule):
    """Prefixes under the order by frequency."""

    def run(batches):
        for block, x, sets in _each(batches, rule):
            sets = _staying(rule, sets, B.flags(x["met"]))
            keys, inverse, _ = _tokens(sets)
            classes = np.frombuffer(b"".join(x["often"] or []), np.uint8)
            if len(classes) != len(keys):
                raise ValueError(f"{len(classes)} answers for {len(keys)} tokens")
            at, columns = 0, [[] for _ in range(5)]
            for d, s in sets:
                n, own = len(s), classes[inverse[at : at + len(s)]]
                at += n
                order = np.lexsort((mixed(s, 2), own))[: rule.slack(n) + 1]
                order = order[own[order] > 0]
                if len(order):
                    alone = int((own == 0).sum())
                    for c, v in zip(columns, (s[order].view(np.int64), (block.number << B.ROW_BITS) + d, n, alone + np.arange(len(order)), alone)):
                        c.append(np.broadcast_to(v, len(order)))
            if columns[0]:
                token, row, n, place, alone = map(np.concatenate, columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token), pa.array(row.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(alone.astype(np.int32))],
                    ["token", "row", "n", "place", "alone"],
                )

    return run


def _met(_, keys: list[bytes], __) -> list[bytes]:
    """For each block's tokens, whether another block sent the same."""
    every = np.concatenate([np.frombuffer(x, "<u4") for x in keys])
    values, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    hit, at = (counts > 1)[inverse], np.cumsum([0] + [len(x) // 4 for x in keys])
    return [B.bits(hit[a:b]) for a, b in zip(at, at[1:])]


def _often(_, keys: list[bytes], counts: list[bytes]) -> list[bytes]:
    """A class of each token's document frequency: 0 if it occurs once, then eight classes for each doubling."""
    every = np.concatenate([np.frombuffer(x, "<u4") for x in keys])
    values, inverse = np.unique(every, return_inverse=True)
    total = np.bincount(inverse, np.concatenate([np.frombuffer(x, "<u4") for x in counts]))
    classes = np.where(total > 1, np.minimum(255, 1 + (8 * np.log2(np.maximum(total, 1))).astype(np.int64)), 0).astype(np.uint8)[inverse]
    at = np.cumsum([0] + [len(x) // 4 for x in keys])
    return [classes[a:b].tobytes() for a, b in zip(at, at[1:])]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the wanted places of each block."""
    for batch in batches:
        for i in range(len(batch)):
            x = batch.slice(i, 1).to_pylist()[0]
            if x["wanted"]:
                block = B.Block.read(x["block"], x["data"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.rows[x["wanted"]]), pa.array([block.text(d) for d in x["wanted"]], pa.binary())], ["row", "body"]
                )


def _verify(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Those of the candidate pairs (a, b) that link."""

    def check(batches):
        words, held = Words(), OrderedDict()

        def sets(row: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
            if row not in held:
                s = shingles(words.of(body), rule.k)
                held[row] = s, np.sort(mixed(s, 3))[: rule.slack(len(s)) + 1]
                if len(held) > 64:
                    held.popitem(last=False)
            held.move_to_end(row)
            return held[row]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            linked = []
            for i in range(len(batch)):
                (x, px), (y, py) = sets(a[i], batch.column("body_a")[i].as_py()), sets(b[i], batch.column("body_b")[i].as_py())
                linked.append(len(np.intersect1d(px, py, assume_unique=True)) > 0 and rule.similar(x, y))
            found = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(found), batch.column("b").filter(found)], ["a", "b"])

    beside_b = pairs.join(texts.select(F.col("row").alias("b"), F.col("body").alias("body_b")), "b")
    both = beside_b.join(texts.select(F.col("row").alias("a"), F.col("body").alias("body_a")), "a")
    return materialize(both.select("a", "b", "body_a", "body_b").mapInArrow(check, "a long, b long"), "links")


def _links(postings: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links that connect every component: first with one leader for each token, then what that leaves open."""
    leaders = (
        postings.groupBy("token").agg(F.min(F.struct("alone", "row", "n")).alias("l"), F.count("*").alias("size")).where("size > 1")
        .select("token", F.col("l.row").alias("a"), F.col("l.n").alias("m"))
    )
    star = postings.join(leaders, "token").where(F.col("row") != F.col("a")).where(rule.sizes_fit(F.col("n"), F.col("m")))
    links = _verify(materialize(star.select("a", F.col("row").alias("b")).distinct(), "pairs"), texts, rule)
    found = components(links)

    placed = materialize(
        postings.join(found.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row")), "placed"
    )
    by_component = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    largest = by_component.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    opened = placed.join(largest.select("token", F.col("top.component").alias("top")), "token")
    few = opened.where("component <> top").select("token", F.col("row").alias("a"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("component").alias("other"))
    bound = rule.overlap(F.col("n"), F.col("m"))
    pairs = (
        opened.join(few, "token")
        .where((F.col("component") != F.col("other")) & ((F.col("component") == F.col("top")) | (F.col("row") < F.col("a"))))
        .where(rule.sizes_fit(F.col("n"), F.col("m")))
        .where((F.col("n") - F.col("place") >= bound) & (F.col("m") - F.col("at") >= bound))
    )
    pairs = materialize(pairs.select("a", F.col("row").alias("b")).distinct(), "pairs")
    if pairs.isEmpty():
        return links
    return links.union(_verify(pairs, texts, rule))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            ids, n = np.frombuffer(x["extra"], "<i8"), np.frombuffer(x["keys"], "<i8")
            rows = (x["block"] << B.ROW_BITS) + np.arange(len(n), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(ids, mask=ids == DOWN), pa.array(n)], ["row", "doc_id", "n"])


def members(blocks: DataFrame, rule: Rule) -> DataFrame:
    """Every row of the blocks: row, doc_id, n (size of its set), component (a row of its group)."""
    buckets = B.bucket_count(blocks)
    lean = B.rows(blocks)
    again = materialize(lean.join(B.first_rows(lean), "sha").where("row <> rep").select("row", "rep"), "again")
    place = F.col("row").bitwiseAND((1 << B.ROW_BITS) - 1)
    answers = [materialize(again.groupBy(F.shiftright("row", B.ROW_BITS).alias("block")).agg(F.collect_list(place).alias("copies")), "copies")]

    sent = materialize(B.beside(blocks, answers).mapInArrow(_first(rule, buckets), B.blob_schema()), "prefixes")
    answers.append(B.exchange(sent.where("bucket >= 0"), _met, "met"))
    answers.append(B.exchange(B.beside(blocks, answers).mapInArrow(_second(rule, buckets), B.blob_schema()), _often, "often"))
    schema = "token long, row long, n int, place int, alone int"
    postings = materialize(B.beside(blocks, answers).mapInArrow(_third(rule), schema), "postings")
    wanted = (
        postings.select("row").distinct()
        .groupBy(F.shiftright("row", B.ROW_BITS).alias("block")).agg(F.collect_list(place).alias("wanted"))
    )
    texts = materialize(B.beside(blocks, [materialize(wanted, "wanted")]).mapInArrow(_texts, "row long, body binary"), "texts")
    linked = components(_links(postings, texts, rule)).select(F.col("node").alias("rep"), "component")

    every = sent.where("bucket = -1").select("block", "keys", "extra").mapInArrow(_members, "row long, doc_id long, n long")
    sizes = every.where("n >= 0").select(F.col("row").alias("rep"), F.col("n").alias("size"))
    copied = every.where("n < 0").drop("n").join(again, "row").join(sizes, "rep").select("row", "doc_id", F.col("size").alias("n"), "rep")
    rows = every.where("n >= 0").select("row", "doc_id", "n", F.col("row").alias("rep")).union(copied)
    component = F.when(F.col("n") == 0, F.col("row")).otherwise(F.coalesce("component", "rep"))
    return materialize(rows.join(linked, "rep", "left").select("row", "doc_id", "n", component.alias("component")), "members")


def similarity_groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id that links reach) for every row."""
    rows = members(B.build(docs, doc_id, text), Rule(k, num, den))
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size")
    shown = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(least, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), shown.alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with one row of each group left: the smallest doc_id (null first), then the first stored."""
    others = tuple(c for c in docs.columns if c not in (doc_id, text))
    blocks = B.build(docs, doc_id, text, others)
    rows = members(blocks, Rule(k, num, den))
    least = rows.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(int(DOWN))), "row")).alias("k"), F.count("*").alias("size"))
    gone = rows.join(least.where("size > 1").select("component", F.col("k.row").alias("kept")), "component").where("row <> kept")
    place = F.col("row").bitwiseAND((1 << B.ROW_BITS) - 1)
    dropped = materialize(gone.groupBy(F.shiftright("row", B.ROW_BITS).alias("block")).agg(F.collect_list(place).alias("dropped")), "dropped")
    names = docs.columns
    schema = StructType([docs.schema[c] for c in names])

    def remaining(batches):
        for batch in batches:
            for i in range(len(batch)):
                x = batch.slice(i, 1).to_pylist()[0]
                block = B.Block.read(x["block"], x["data"])
                left = np.ones(len(block), bool)
                left[x["dropped"] or []] = False
                columns = {doc_id: block.batch.column("__id"), text: block.batch.column("__text").cast(pa.large_string())}
                if others:
                    columns |= dict(zip(others, block.batch.column("__kept").flatten()))
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names).filter(pa.array(left))

    return B.beside(blocks, [dropped]).mapInArrow(remaining, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_groups(spark.read.parquet(f"{folder}/documents.parquet"))


#: Pairs meet where they share a shingle; equal sets are one row until the end.
ORACLE = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
sorted AS MATERIALIZED (SELECT doc_id, list_sort(s) AS s FROM sets),
reps AS MATERIALIZED (SELECT min(doc_id) AS rep, len(s) AS n, s FROM sorted WHERE len(s) > 0 GROUP BY s),
flat AS MATERIALIZED (SELECT rep, n, unnest(s) AS x FROM reps),
links AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM flat a JOIN flat b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
linked AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM reps UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(least, s.doc_id) AS component_id FROM sorted s LEFT JOIN reps r ON r.s = s.s
LEFT JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) c ON c.a = r.rep
"""
