"""Tables in parts: what a change reads and writes, and what a repeated one leaves."""


import pytest
from pyspark.sql import functions as F

from tidemark.session import child_folders
from tidemark.sources import parts

SCHEMA = "k BIGINT, v BIGINT"


def table(spark, path, **more):
    return parts.Parts(spark, str(path), SCHEMA, **more)


def rows(spark, pairs, width=4):
    return spark.createDataFrame(pairs, SCHEMA).withColumn(parts.PART, (F.col("k") % width).cast("string"))


def content(frame):
    return sorted((r.k, r.v) for r in frame.collect())


def test_upsert_writes_only_parts_with_changes(spark, tmp_path):
    held = table(spark, tmp_path)
    held.append(rows(spark, [(k, 0) for k in range(40)]))
    before = held._now()[1]
    assert parts.upsert(held, rows(spark, [(5, 1), (41, 1)]), ["k"]) == ["1"]
    after = held._now()[1]
    assert [p for p in after if after[p] != before[p]] == ["1"]
    assert child_folders(spark, f"{tmp_path}/data/__version=1") == ["__part=1"]
    assert content(held.read()) == sorted([(k, int(k == 5)) for k in range(40)] + [(41, 1)])
    assert content(held.read(["1", "9"])) == sorted((k, v) for k, v in content(held.read()) if k % 4 == 1)


def test_a_repeated_change_is_left_out_and_a_failed_one_unseen(spark, tmp_path, monkeypatch):
    held = table(spark, tmp_path)
    held.append(rows(spark, [(1, 1)]), "w", 0)
    held.append(rows(spark, [(1, 1)]), "w", 0)
    assert content(held.read()) == [(1, 1)] and held.done("w", 0) and not held.done("w", 1) and not held.done("x", 0)
    with monkeypatch.context() as broken:
        broken.setattr(parts, "LISTED", "wrong STRING")
        with pytest.raises(Exception):
            held.rewrite(rows(spark, [(1, 2)]), ["1"], "w", 1)
    assert content(held.read()) == [(1, 1)]
    held.rewrite(rows(spark, [(1, 3)]), ["1"], "w", 1)
    held.append(rows(spark, [(2, 2)]), "x", 0)
    assert content(held.read()) == [(1, 3), (2, 2)]


def test_folders_of_a_part_stay_few_and_old_versions_go(spark, tmp_path):
    def summed(frame):
        return frame.groupBy("k", parts.PART).agg(F.sum("v").alias("v"))

    held = table(spark, tmp_path, combine=summed)
    for number in range(30):
        held.append(rows(spark, [(number % 2, 1)], width=2), "w", number)
        assert all(len(folders) <= 2 * parts.MOST for folders in held._now()[1].values())
    assert content(held.reduced()) == [(0, 15), (1, 15)]
    assert len(held.versions()) == parts.KEPT
    stored = [f for v in child_folders(spark, f"{tmp_path}/data") for f in child_folders(spark, f"{tmp_path}/data/{v}")]
    assert len(stored) <= 2 * (parts.KEPT + 2 * parts.MOST)


def test_drop_reads_nothing_and_an_empty_table_is_empty(spark, tmp_path):
    held = table(spark, tmp_path)
    assert held.parts() == [] and content(held.read()) == []
    held.append(rows(spark, []))
    assert held.parts() == []
    held.append(rows(spark, [(k, k) for k in range(8)]))
    held.drop(["0", "3", "7"])
    assert held.parts() == ["1", "2"] and content(held.read()) == [(1, 1), (2, 2), (5, 5), (6, 6)]


def test_insert_adds_absent_keys_only(spark, tmp_path):
    held = table(spark, tmp_path)
    parts.insert(held, rows(spark, [(1, 1), (2, 1)]), ["k"])
    parts.insert(held, rows(spark, [(2, 2), (3, 2)]), ["k"])
    assert content(held.read()) == [(1, 1), (2, 1), (3, 2)]


def test_rows_without_a_part_have_one_of_their_own(spark, tmp_path):
    held = table(spark, tmp_path)
    lost = spark.createDataFrame([(7, 0)], SCHEMA).withColumn(parts.PART, F.lit(None).cast("string"))
    held.append(lost)
    assert held.parts() == [parts.NONE]
    assert parts.upsert(held, lost.withColumn("v", F.lit(1).cast("bigint")), ["k"]) == [parts.NONE]
    parts.insert(held, lost, ["k"])
    assert content(held.read()) == [(7, 1)]


def test_buckets_are_spread(spark):
    found = spark.range(5000).select(parts.bucket(["id"], 64).alias("b")).groupBy("b").count().collect()
    assert len(found) == 64 and max(r["count"] for r in found) < 200 and all(len(r.b) == 5 for r in found)
