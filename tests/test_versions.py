"""Versions, refreshes and kept tables: what readers see when writers die, meet or are refused."""

import pytest
from pyspark.sql import functions as F

from pitrec.operators import refresh
from pitrec.sources import io, kept, versions


def values(df):
    return sorted(r["v"] for r in df.collect())


class Killed(BaseException):
    pass


def test_versions_and_roll_back(spark, tmp_path):
    table = str(tmp_path / "t")
    assert versions.current(spark, table) is None
    with pytest.raises(FileNotFoundError):
        versions.read(spark, table)
    assert versions.write(spark.range(5).toDF("v"), table) == 1
    old = versions.read(spark, table)
    assert versions.write(versions.read(spark, table).where("v > 2"), table) == 2
    assert values(versions.read(spark, table)) == [3, 4] and values(old) == [0, 1, 2, 3, 4]  # a reader keeps its version
    assert versions.roll_back(spark, table, 1) == 3 and values(versions.read(spark, table)) == [0, 1, 2, 3, 4]
    assert values(versions.read(spark, table, 2)) == [3, 4]
    with pytest.raises(FileNotFoundError):
        versions.roll_back(spark, table, 9)
    assert versions.expire(spark, table, 1) and values(versions.read(spark, table)) == [0, 1, 2, 3, 4]


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    versions.write(spark.range(2).toDF("v"), table)

    def dies(*_):
        raise Killed

    with pytest.raises(Killed):  # after the rows, before the entry
        versions.write(spark.range(9).toDF("v"), table, check=dies)
    assert values(versions.read(spark, table)) == [0, 1]
    fs, path = io.store(spark, f"{table}/log/{2:012d}")
    fs.create(path, False).close()  # died between making the entry and writing it
    assert values(versions.read(spark, table)) == [0, 1]
    assert versions.write(spark.range(3).toDF("v"), table) == 3 and values(versions.read(spark, table)) == [0, 1, 2]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "t")
    versions.write(spark.range(1).toDF("v"), table)
    first = iter([2])
    own = versions._next
    monkeypatch.setattr(versions, "_next", lambda s, t: next(first, None) or own(s, t))
    versions._append(spark, table, 2, versions.entries(spark, table)[0][1])  # the other one was faster
    with pytest.raises(versions.Conflict):
        versions.write(spark.range(4).toDF("v"), table)
    first = iter([2])
    assert versions.write(spark.range(4).toDF("v"), table, retries=1) == 3 and values(versions.read(spark, table)) == [0, 1, 2, 3]


META = "item_id long, rating_number long, store string, main_category string, price string, categories array<string>"


def _inputs(spark, n=6, boost=1):
    meta = spark.createDataFrame([(k, boost * k, f"s{k % 2}", "c", f"${k}.50", ["a", "b"]) for k in range(n)] + [(99, 1, "x", "c", "$1", [])], META)
    mapping = spark.createDataFrame([(k, k - k % 2) for k in range(n)], "raw_item_id long, canonical_item_id long")
    train = spark.createDataFrame([(1, 0, 5, 1), (2, 2, 1, 0)], "user_id long, item_id long, rating int, label int")
    return meta, mapping, train, train.select("item_id")


def test_refresh_and_every_place_to_die(spark, tmp_path):
    folder = str(tmp_path)
    meta, mapping, train, universe = _inputs(spark)
    shown = lambda: {r["item_id"]: r["rating_number"] for r in versions.read(spark, f"{folder}/item_features").collect()}
    report = refresh.refresh(meta, mapping, train, universe, folder).collect()
    assert [tuple(r) for r in report] == [("metadata", 1, 6), ("item_features", 1, 3)] and shown() == {0: 0, 2: 2, 4: 4}
    newer = _inputs(spark, boost=10)[0]
    for where in ("metadata", "features written"):
        def step(name, where=where):
            if name == where:
                raise Killed

        with pytest.raises(Killed):
            refresh.refresh(newer, mapping, train, universe, folder, step=step)
        assert shown() == {0: 0, 2: 2, 4: 4}  # features of the old version, whole
        assert versions.read(spark, f"{folder}/metadata").count() == 6
    refresh.refresh(newer, mapping, train, universe, folder)
    assert shown() == {0: 0, 2: 20, 4: 40}


def test_refresh_refuses_other_keys(spark, tmp_path):
    folder = str(tmp_path)
    meta, mapping, train, universe = _inputs(spark)
    refresh.refresh(meta, mapping, train, universe, folder)
    with pytest.raises(ValueError, match="1 canonical items"):
        refresh.refresh(meta.where("item_id <> 2"), mapping, train, universe, folder)
    more = spark.createDataFrame([(99, 99)], mapping.schema).unionByName(mapping)
    with pytest.raises(refresh.KeysChanged, match=r"\+1 / -0 keys, among them 99"):
        refresh.refresh(meta, more, train, universe, folder)
    now = versions.read(spark, f"{folder}/metadata")
    assert now.where("item_id = 99").count() == 0  # the version before is current again
    with pytest.raises(refresh.KeysChanged):
        refresh.demand_equal_keys(meta.select("item_id"), meta.select(F.when(F.col("item_id") > 0, F.col("item_id")).alias("item_id")))


def test_kept_tables_are_made_once(spark, tmp_path):
    source, made = str(tmp_path / "in"), []

    def make():
        made.append(1)
        return spark.read.parquet(source).withColumn("v", F.col("v") + 1)

    ask = lambda config: values(kept.stored(spark, "plus", config, [source], make, str(tmp_path / "store")))
    spark.range(3).toDF("v").write.parquet(source)
    assert ask({"k": 1}) == ask({"k": 1}) == [1, 2, 3] and len(made) == 1
    assert ask({"k": 2}) == [1, 2, 3] and len(made) == 2
    spark.range(1).toDF("v").write.mode("append").parquet(source)
    assert ask({"k": 1}) == [1, 1, 2, 3] and len(made) == 3  # a changed input is another address
    with pytest.raises(FileNotFoundError):
        kept.stored(spark, "plus", {}, [str(tmp_path / "none")], make)
