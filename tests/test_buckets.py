"""The keyed table: what a change rewrites, unique keys, writers that meet, and versions."""

import pytest
from pyspark.sql import functions as F

from vellum.operators import buckets
from vellum.operators.buckets import Buckets, Conflict, DuplicateKey

SCHEMA = "id string, n long, note string, createdAt long"


def table(spark, tmp_path, number=8):
    held = Buckets(spark, f"{tmp_path}/t", SCHEMA, "id", ("createdAt",), number)
    held.merge(spark.range(200).select(F.concat(F.lit("k"), "id").alias("id"), F.col("id").alias("n"), F.lit("old").alias("note"), F.lit(1).alias("createdAt")))
    return held


def changed(held, before):
    after = held.manifest()["folders"]
    return sum(before.get(b) != f for b, f in after.items())


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    held = table(spark, tmp_path)
    before = held.manifest()["folders"]
    assert len(before) == 8
    held.merge(spark.createDataFrame([("k7", "new", 2)], "id string, note string, createdAt long"))
    assert changed(held, before) == 1
    assert tuple(held.get("k7", "nobody").first()) == ("k7", 7, "new", 1)  # n is kept, and so is createdAt
    assert held.read().count() == 200 and held.read(1).where("note = 'new'").count() == 0


def test_changes_touch_their_buckets(spark, tmp_path):
    held = table(spark, tmp_path, 64)
    before = held.manifest()["folders"]
    assert held.update(F.col("n") == 5, note="five") == 1 and changed(held, before) == 1
    assert held.remove(F.col("n").isin(5, 6)) == 2 and held.remove(F.col("n") == 5) == 0
    before = held.manifest()["folders"]
    assert held.replace(F.col("n") == 9, spark.createDataFrame([("k9", 900), ("x", 901)], "id string, n long")) == 2
    assert changed(held, before) <= 2
    assert sorted(tuple(r) for r in held.read().where("n in (9, 900, 901)").select("id", "n", "note").collect()) == [("k9", 900, None), ("x", 901, None)]


def test_keys_are_unique(spark, tmp_path):
    held = table(spark, tmp_path)
    for ids in (["a", "a"], ["a", None]):
        with pytest.raises(DuplicateKey):
            held.merge(spark.createDataFrame([(i, 1) for i in ids], "id string, n long"))
    with pytest.raises(DuplicateKey):
        held.replace(F.col("n") == 1, spark.createDataFrame([("k2", 1)], "id string, n long"))
    assert held.versions() == [1]


def test_two_writers_and_old_versions(spark, tmp_path):
    held = table(spark, tmp_path)
    old = held.manifest()
    held.merge(spark.createDataFrame([("a", 1)], "id string, n long"))
    with pytest.raises(Conflict):
        held._store(old, held.read(1), None)
    assert held.read().count() == 201
    for i in range(4):
        held.merge(spark.createDataFrame([("a", i)], "id string, n long"))
    assert held.versions() == [5, 6] and held.read(5).where("id = 'a'").first().n == 2
    assert len(list((tmp_path / "t" / "data").glob("*/_bucket=*"))) == len({f for v in (5, 6) for f in held.manifest(v)["folders"].values()})


def test_growth_and_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "MOST", 30)
    held = Buckets(spark, f"{tmp_path}/t", SCHEMA, "id", buckets=2)
    assert held.read().count() == 0 and held.remove(F.col("n") > 0) == 0 and not held.grow()
    assert held.merge(spark.createDataFrame([], "id string, n long")) == 0 and held.versions() == []
    held.merge(spark.range(200).select(F.col("id").cast("string"), F.col("id").alias("n")))
    assert held.grow() and held.manifest()["buckets"] == 8 and held.read().count() == 200
    assert held.get("17").first().n == 17
