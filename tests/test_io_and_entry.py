import importlib
import sys

import pytest

from pitrec.sources import io


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"user_id":"u","parent_asin":"a","rating":5.0,"timestamp":1}\n{broken\n{"user_id":"v","parent_asin":"b","rating":1.0,"timestamp":2}\n')
    rows = io.read_jsonl(spark, str(tmp_path / "r.jsonl"), io.REVIEWS)
    assert sorted(r["user_id"] for r in rows.collect()) == ["u", "v"]
    wanted = spark.createDataFrame([("b",)], "parent_asin string")
    assert [r["user_id"] for r in io.read_jsonl(spark, str(tmp_path / "r.jsonl"), io.REVIEWS, wanted).collect()] == ["v"]
    out = io.jsonl_to_parquet(spark, str(tmp_path / "r.jsonl"), str(tmp_path / "p"), max_rows=1)
    assert out.count() == 1
    assert io.jsonl_to_parquet(spark, str(tmp_path / "missing"), str(tmp_path / "p")).count() == 1
    assert io.read_metadata(spark, [str(tmp_path / "p"), str(tmp_path / "none")]).count() == 1
    with pytest.raises(FileNotFoundError):
        io.read_metadata(spark, [str(tmp_path / "none")])


def test_inter_files_and_dumps(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "i1", 5, 3), ("u1", "i0", 4, 1)], "user_id string, item_id string, rating int, ts long")
    io.write_inter(rows, str(tmp_path / "inter"))
    back = io.read_typed_csv(spark, str(tmp_path / "inter"), "`user_id:token` string, `item_id:token` string, `rating:float` double, `timestamp:float` double", "\t")
    assert [r[1] for r in back.collect()] == ["i0", "i1"]
    with pytest.raises(Exception):
        io.write_inter(spark.createDataFrame([("u\t", "i", 5, 3)], rows.schema), str(tmp_path / "bad"))
    with pytest.raises(Exception):
        io.read_typed_csv(spark, str(tmp_path / "inter"), "a string, b string, c double, d double", "\t").collect()
    dump = spark.createDataFrame([(1, 2, 1, 0.5, 3, 4)], "user_id long, item_id long, label int, logit double, n_history_events long, item_n_reviews long")
    io.write_dump(dump, str(tmp_path / "d"), 1)
    assert io.read_dump(spark, str(tmp_path / "d")).count() == 1
    with pytest.raises(ValueError):
        io.write_dump(dump, str(tmp_path / "e"), 2)


def test_reports_replace_only_their_partitions(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "name string, value int")
    io.write_report(make([("a", 1), ("b", 2)]), str(tmp_path / "rep"), "name")
    io.write_report(make([("b", 3)]), str(tmp_path / "rep"), "name")
    assert sorted((r["name"], r["value"]) for r in spark.read.parquet(str(tmp_path / "rep")).collect()) == [("a", 1), ("b", 3)]


def test_npz_files(spark, tmp_path):
    import numpy as np

    for k in range(2):
        np.savez(tmp_path / f"{k}.npz", ids=np.arange(3) + 10 * k, vectors=np.full((3, 4), k, dtype=np.float32))
    got = {r["item_id"]: r["embedding"] for r in io.read_npz(spark, str(tmp_path)).collect()}
    assert got == {i + 10 * k: [float(k)] * 4 for k in range(2) for i in range(3)}
    again = io.npz_rows(io.npz_blobs(io.read_npz(spark, str(tmp_path)), rows=2))
    assert {r["item_id"]: r["embedding"] for r in again.collect()} == got
    np.savez(tmp_path / "bad.npz", ids=np.arange(2), vectors=np.zeros((3, 4)))
    with pytest.raises(Exception):
        io.read_npz(spark, str(tmp_path / "bad.npz")).collect()


def test_outputs_are_removed_by_name(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.range(5).toDF("v"), path)
    (tmp_path / "notes.txt").write_text("abc")
    assert io.digests(spark, str(tmp_path / "notes.txt")) == {"notes.txt": "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"}
    assert io.remove_outputs(spark, str(tmp_path), {"t", "u"}) == ["t"] and io.outputs(spark, str(tmp_path)) == ["notes.txt"]
    with pytest.raises(FileNotFoundError):
        io.digests(spark, path)
    assert io.outputs(spark, str(tmp_path / "none")) == []


def test_prefixes(spark):
    rows = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3), (2, 7, 1)], "user_id long, item_id long, ts long")
    got = sorted((r["user_id"], r["target"], r["items"]) for r in io.prefix_sequences(rows, 1).collect())
    assert got == [(1, 8, [7]), (1, 9, [8])]


def test_entry_and_names(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() == 3
    assert set(E.oracle_sql()) <= set(E.queries()) and len(E.queries()) > 150


def test_entry_without_the_text_subpackage(monkeypatch):
    """The other queries stay when the subpackage and the pipeline are gone."""

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("pitrec.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name=name)

    for name in [m for m in sys.modules if m.startswith("pitrec.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    import pitrec

    monkeypatch.delattr(pitrec, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    E = importlib.import_module("__spark_entry__")
    assert "pipeline" not in E.queries() and not any(n.startswith("op") for n in E.queries()) and len(E.queries()) > 140
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_entry_does_not_hide_a_failing_import(monkeypatch):
    class Broken:
        def find_spec(self, name, path=None, target=None):
            if name == "pitrec.llm.registry":
                raise ModuleNotFoundError("xxhash", name="xxhash")

    for name in [m for m in sys.modules if m.startswith("pitrec.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    import pitrec

    monkeypatch.delattr(pitrec, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Broken(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("__spark_entry__")


def test_twins_agree_on_the_smallest_tables(spark, sf):
    """Some queries of each group against their twins in another engine."""
    import glob
    import os

    import duckdb

    import __spark_entry__ as E

    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    for name in ("p2_count_percentiles", "n12_merge_options", "t7_snapshot_stats", "f3_item_features", "r10_rule_top_k", "r15_covisitation_top_k", "e19_full_evaluation", "b10_threshold_sweep", "c10_frozen_guard"):
        got = E.queries()[name](spark, sf)
        want = c.execute(E.oracle_sql()[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(got.columns), name
        norm = lambda rows: sorted((tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows), key=str)
        assert norm(tuple(r) for r in got.select(*names).collect()) == norm(want.fetchall()), name
