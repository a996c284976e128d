"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to some exponent, normalised. The exponent is bisected: down until the mixture reaches the
target entropy (a fraction of what equal weights have), but not so far that a source is repeated more than the limit. The budget is
such that the source that is repeated least is used exactly once, so no document is left out.

The weights are realised as budgeted block permutations. A source's documents fall into blocks by a hash of their id; each pass over
the source takes its blocks in an order of its own, and the last pass ends where the source's budget does, inside a block at a document.
The order of the mixture interleaves the sources: a block's place is how far its source's budget is used when it begins.

A hot source has more blocks, so its rows spread over as many tasks. Windows see one row per block of a source (at most
``MOST_BLOCKS``) or the documents of the one block where its budget ends. The driver sees one total per source.

Defined results: tokens are words between white space; null and empty texts have none, and are kept in each whole pass; a null
source is a source of its own; rows that share an id stay together; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

ENTROPY, MOST_REPEATS = 0.95, 2.0
BLOCK_TOKENS, MOST_BLOCKS = 1 << 16, 4096
ROUNDS = 60


def exponent(tokens: list[int], entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS) -> float:
    """The exponent in [0, 1] that reaches the entropy, raised where a source would be repeated too often."""
    sizes = [n for n in tokens if n > 0]
    total = sum(sizes)
    shares = [n / total for n in sizes]
    if len(shares) < 2:
        return 1.0

    def spread(a: float) -> float:
        powers = [p**a for p in shares]
        whole = sum(powers)
        return -sum(x / whole * math.log(x / whole) for x in powers)

    def repeats(a: float) -> float:
        return max((max(shares) / p) ** (1 - a) for p in shares)

    def highest(holds) -> float:
        """The largest exponent for which something holds that holds for all smaller ones."""
        low, high = 0.0, 1.0
        if holds(high):
            return high
        for _ in range(ROUNDS):
            middle = (low + high) / 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low

    reached = highest(lambda a: spread(a) >= entropy * math.log(len(shares)))
    return max(reached, highest(lambda a: repeats(a) > most_repeats))


def budgets(tokens: dict, entropy: float = ENTROPY, most_repeats: float = MOST_REPEATS) -> dict[object, float]:
    """How often each source is used: once for the least repeated, rounded to six places."""
    most = max(tokens.values(), default=0)
    a = exponent(list(tokens.values()), entropy, most_repeats)
    return {s: round((most / n) ** (1 - a), 6) if n else 1.0 for s, n in tokens.items()}


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f\x0B]+")), F.lit(0)).cast("long")


def schedule(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per source, pass and block: where it begins and, in the last block of a budget, the order up to which documents count.

    Also the lean rows (id, source, tokens, block count) it was made from.
    """
    spark = docs.sparkSession
    lean = materialize(docs.select(docs[doc_id].alias("id"), docs[source].alias("src"), word_count(docs[text]).alias("tokens")), "tokens")
    totals = {r["src"]: r["n"] for r in lean.groupBy("src").agg(F.sum("tokens").alias("n")).collect()}  # one row per source
    rows = [
        (s, n, float(r), min(MOST_BLOCKS, max(1, -(-n // BLOCK_TOKENS))))
        for (s, n), r in zip(totals.items(), budgets(totals).values())
    ]
    kind = docs.schema[source].dataType.simpleString()
    sources = spark.createDataFrame(rows, f"src {kind}, total long, repeats double, blocks long")
    sources = sources.withColumn("passes", F.ceil("repeats").cast("int")).withColumn("budget", F.floor(F.col("repeats") * F.col("total")))
    lean = lean.join(F.broadcast(sources), lean["src"].eqNullSafe(sources["src"])).select(
        "id", lean["src"], "tokens", "total", "budget", "passes", F.pmod(_number(_hash(F.col("id"))), F.col("blocks")).alias("block")
    )
    by_block = lean.groupBy("src", "block", "total", "budget", "passes").agg(F.sum("tokens").alias("size"))
    turns = by_block.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    in_pass = Window.partitionBy("src", "pass").orderBy("turn", "block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("turn", _hash(F.col("src"), F.col("pass"), F.col("block")))
    turns = turns.withColumn("at", F.col("pass") * F.col("total") + F.coalesce(F.sum("size").over(in_pass), F.lit(0)))
    wordless = (F.col("size") == 0) & ((F.col("pass") + 1) * F.col("total") <= F.col("budget"))  # last in a whole pass that ends with the budget
    turns = turns.where((F.col("at") < F.col("budget")) | (F.col("total") == 0) | wordless).select("src", "pass", "block", "at", "size", "budget")
    turns = materialize(turns, "turns")
    ending = turns.where("at + size > budget").select("src", "pass", "block", (F.col("budget") - F.col("at")).alias("left"))
    rows = lean.join(F.broadcast(ending), lean["src"].eqNullSafe(ending["src"]) & (lean["block"] == ending["block"]))  # one block per source
    rows = rows.select(lean["src"], "pass", lean["block"], "left", "tokens", _hash(F.col("id"), F.col("pass")).alias("order"))
    each = rows.groupBy("src", "pass", "block", "left", "order").agg(F.sum("tokens").alias("tokens"))
    upto = Window.partitionBy("src", "pass", "block").orderBy("order")
    last = each.withColumn("sum", F.sum("tokens").over(upto)).where("sum <= left").groupBy("src", "pass", "block").agg(F.max("order").alias("upto"))
    last = last.select(F.col("src").alias("s"), F.col("pass").alias("p"), F.col("block").alias("b"), "upto")
    same = F.col("src").eqNullSafe(F.col("s")) & (F.col("pass") == F.col("p")) & (F.col("block") == F.col("b"))
    cut = turns.join(F.broadcast(last), same, "left").select(
        "src", "pass", "block", "at", "budget", F.when(F.col("at") + F.col("size") > F.col("budget"), F.coalesce("upto", F.lit(""))).alias("upto")
    )
    blocks = sources.select(F.col("src").alias("__s"), F.col("blocks").alias("__of"))
    return materialize(cut, "schedule"), blocks


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The documents as often as the mixture has them: doc (a struct of all their columns), pass, block, at, place (0 to 1), order."""
    turns, blocks = schedule(docs, doc_id, source, text)
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("doc"))
    mine = F.col("doc").getField(source)
    named = F.col("doc").getField(doc_id)
    placed = rows.join(F.broadcast(blocks), blocks["__s"].eqNullSafe(mine)).select("doc", F.pmod(_number(_hash(named)), F.col("__of")).alias("block"))
    turns = turns.select(F.col("block").alias("b"), "src", "pass", "at", "budget", "upto")
    met = placed.join(turns, mine.eqNullSafe(F.col("src")) & (F.col("block") == F.col("b")))
    place = F.when(F.col("budget") > 0, F.col("at") / F.col("budget")).otherwise(F.lit(0.0))
    met = met.select("doc", "pass", "block", "at", place.alias("place"), _hash(named, F.col("pass")).alias("order"), "upto")
    return met.where("upto IS NULL OR order <= upto").drop("upto")


def in_order(docs: DataFrame) -> DataFrame:
    """The mixture's documents, with their own columns whatever their names, in its order."""
    spread = mixed(docs).repartitionByRange("place", "order").sortWithinPartitions("place", "order")
    return spread.select("doc.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text")
    return mixed(docs).select("doc.doc_id", "doc.source", "pass", "block", F.col("at").alias("begins"))


ORACLE = f"""
WITH RECURSIVE lean AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS tokens FROM documents
), totals AS (
  SELECT source, sum(tokens)::BIGINT AS total FROM lean GROUP BY source
), shares AS (
  SELECT total / (SELECT sum(total) FROM totals)::DOUBLE AS p FROM totals WHERE total > 0
), facts AS (
  SELECT list(p) AS ps, max(p) / min(p) AS spread, count(*) AS n FROM shares
), search AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, ps, n FROM facts
  UNION ALL
  SELECT i + 1, CASE WHEN h >= {ENTROPY} * ln(n) THEN m ELSE low END, CASE WHEN h >= {ENTROPY} * ln(n) THEN high ELSE m END, ps, n
  FROM (
    SELECT *, -list_sum(list_transform(ps, lambda p: (p ** m / z) * ln(p ** m / z))) AS h
    FROM (SELECT *, list_sum(list_transform(ps, lambda p: p ** m)) AS z FROM (SELECT *, (low + high) / 2 AS m FROM search WHERE i < {ROUNDS}))
  )
), chosen AS (
  SELECT CASE WHEN n < 2 OR -list_sum(list_transform(ps, lambda p: p * ln(p))) >= {ENTROPY} * ln(n) THEN 1.0
    ELSE greatest((SELECT low FROM search WHERE i = {ROUNDS}), CASE WHEN spread > {MOST_REPEATS} THEN 1 - ln({MOST_REPEATS}) / ln(spread) ELSE 0 END) END AS a
  FROM facts
), sources AS (
  SELECT source, total, CASE WHEN total = 0 THEN 1.0 ELSE round(((SELECT max(total) FROM totals) / total::DOUBLE) ** (1 - a), 6) END AS repeats,
    least({MOST_BLOCKS}, greatest(1, ceil(total / {BLOCK_TOKENS})::BIGINT)) AS blocks
  FROM totals, chosen
), placed AS (
  SELECT doc_id, lean.source, tokens, total, floor(repeats * total)::BIGINT AS budget, ceil(repeats)::INTEGER AS passes,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % blocks AS block
  FROM lean JOIN sources ON lean.source IS NOT DISTINCT FROM sources.source
), turns AS (
  SELECT *, md5(concat_ws('|', coalesce(source, ''), pass, block)) AS turn
  FROM (
    SELECT source, block, total, budget, size, unnest(range(passes))::INTEGER AS pass
    FROM (SELECT source, block, total, budget, passes, sum(tokens)::BIGINT AS size FROM placed GROUP BY ALL)
  )
), begun AS (
  SELECT source, block, pass, total, budget, size,
    (pass * total + coalesce(sum(size) OVER (PARTITION BY source, pass ORDER BY turn, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS begins
  FROM turns
), met AS (
  SELECT doc_id, b.source, pass, b.block, begins, begins + size > b.budget AS ends, b.budget - begins AS room, p.tokens,
    md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), pass)) AS ord
  FROM begun b JOIN placed p ON b.source IS NOT DISTINCT FROM p.source AND b.block = p.block
  WHERE begins < b.budget OR b.total = 0 OR (b.size = 0 AND (pass + 1) * b.total <= b.budget)
)
SELECT doc_id, source, pass, block, begins
FROM (SELECT *, sum(tokens) OVER (PARTITION BY source, pass, block ORDER BY ord) AS upto FROM met)
WHERE NOT ends OR upto <= room
"""
