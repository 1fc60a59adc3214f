import json
import os

import numpy as np
import pytest

from conftest import frame_of
from vectorloom.errors import LoomError
from vectorloom.plans import catalog, registry, results
from vectorloom.streaming import events, series


def test_catalog_changes(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "cat"))
    c.add("datasets", {"dataset_id": "d1", "name": "one", "fingerprint": "f1"}, {"dataset_id": "d2", "name": "two", "fingerprint": "f2"})
    c.add("runs", {"run_id": "r1", "dataset_id": "d1", "fingerprint": "f0", "status": "COMPLETED"}, {"run_id": "r2", "dataset_id": "d2", "fingerprint": "f2", "status": "COMPLETED"})
    c.add("analyses", {"analysis_id": "a1", "run_ids": json.dumps(["r1", "r2"]), "status": "COMPLETED"}, {"analysis_id": "a2", "run_ids": json.dumps(["r2"]), "status": "RUNNING"})
    c.add("jobs", {"job_id": "j1", "dataset_id": "d1", "status": "RUNNING", "category": "generation"})
    assert c.dataset_status("d1", "f1") == "CURRENT" and c.dataset_status("d1", "x") == "CHANGED" and c.dataset_status("d1", None) == "UNAVAILABLE"
    c.mark_stale("d1", "f1")
    with pytest.raises(LoomError):
        c.require_fresh("r1")
    with pytest.raises(LoomError):
        c.remove_dataset("d1")
    with pytest.raises(LoomError):
        c.remove_analysis("a2")
    c.sweep()
    assert c.read("jobs").first()["status"] == "INTERRUPTED"
    c.remove_dataset("d1")
    assert [r["analysis_id"] for r in c.read("analyses").collect()] == ["a2"] and c.read("runs").count() == 1
    c.set("k", "1")
    c.set("k", "2")
    assert c.get("k") == "2" and c.read("settings").count() == 1
    view = c.create_view("d2", "v", [3, 1, 3], 10, "f2")
    assert c.list_views("d2", "new").first()["stale"] and c.read("views").first()["frames"] == [3, 1]
    with pytest.raises(LoomError):
        c.create_view("d2", "v", [1], 10, "f2")
    c.rename_view(view, "w")
    c.remove_view(view)
    assert c.read("views").count() == 0


def test_splits_cover_everything(spark):
    assert catalog.split_sizes(10, (0.8, 0.1, 0.1)) == (8, 1, 1)
    assert catalog.split_sizes(3, (0.98, 0.01, 0.01)) == (1, 1, 1)
    parts = catalog.split(spark.range(50).withColumnRenamed("id", "i"), "i", (0.6, 0.2, 0.2))
    assert parts.count() == 50 and {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 30, "validation": 10, "test": 10}


def test_results_publish_whole_or_not_at_all(spark, tmp_path):
    good = results.AnalysisResult({"t": spark.range(5)}, {"x": 1})
    results.commit(good, str(tmp_path / "ok"), {})
    assert results.load(spark, str(tmp_path / "ok")).tables["t"].count() == 5
    bad = results.AnalysisResult({"t": spark.createDataFrame([(float("nan"),)], "x double")})
    with pytest.raises(LoomError):
        results.commit(bad, str(tmp_path / "bad"), {})
    assert not os.path.exists(tmp_path / "bad")
    cache, calls = results.ResultCache(spark, str(tmp_path / "cache")), []

    def build():
        calls.append(1)
        return good

    for params in ({"a": 1.0, "b": 2}, {"b": 2, "a": 1.0}):
        cache.run("n", params, ["in"], build)
    assert len(calls) == 1
    with pytest.raises(LoomError):
        results.cache_key("n", {"a": float("inf")}, [])
    _part, cut = results.chunk(frame_of(spark, np.zeros((10, 4))), 2, 5, 1, 2, vector="features")
    assert not cut and [r["i"] for r in _part.collect()] == [2, 3, 4, 5, 6]


def test_registry_runs_what_it_names(spark):
    df = frame_of(spark, np.random.default_rng(0).normal(size=(40, 4)))
    assert registry.canonical("iforest")[0] == "isolation_forest" and registry.canonical("per_element")[1]["mode"] == "atom"
    assert registry.canonical("outlier_analysis", {"algorithm": "lof", "k": 5}) == ("lof", {"k": 5})
    for name in ("pca", "neighbors", "effective_dimension", "pairwise", "kmeans", "knn", "random"):
        out = registry.run(name, [df], {"n_samples": 5, "k": 3, "n_clusters": 2})
        assert all(t.count() >= 1 for t in out.tables.values())
    with pytest.raises(LoomError):
        registry.run("coverage", [df])
    assert registry.run("coverage", [df, df]).summary["q95"] >= 0
    with pytest.raises(LoomError):
        registry.register(registry.Analysis("pca", "engine", lambda *a: None))
    with pytest.raises(LoomError):
        catalog.validate_parameters({"n": "x"}, {"n": {"type": "int"}})


def test_streams_equal_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    os.makedirs(folder)
    rows = spark.createDataFrame([(k % 3, k, float(k * k % 17)) for k in range(60)], "u bigint, i bigint, v double")
    rows.where("i < 30").coalesce(1).write.parquet(folder + "/a.parquet")
    rows.where("i >= 30").coalesce(1).write.parquet(folder + "/b.parquet")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
    log = events.watch(spark)
    got = {r["i"]: r["step"] for r in series.live_steps(stream, "u", "i", ["v"]).collect()}
    assert got == {k: abs((k * k % 17) - ((k - 3) ** 2 % 17)) if k >= 3 else 0.0 for k in range(60)}
    profile = {r["u"]: r["n"] for r in series.drain(series.running_profile(stream, "u", "v"), "complete").collect()}
    assert profile == {0: 20, 1: 20, 2: 20}
    seen = series.drain(series.first_seen(stream.selectExpr("cast(v as string) v"), "v"))
    assert seen.count() == rows.select("v").distinct().count()
    spark.streams.removeListener(log)


def test_keyed_state_goes_on_after_a_stop_and_is_bounded(spark, tmp_path):
    """Stopped after each file and started again, the stream gives what one pass over all rows gives; old keys leave the state."""
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    rows = [(k % 3 if k < 60 else 100 + k, k, float(k * k % 17), start + timedelta(minutes=k if k < 60 else 60 * 24 * 30 + k)) for k in range(64)]
    df = spark.createDataFrame(rows, "u bigint, i bigint, v double, at timestamp")
    folder, base = str(tmp_path / "in"), str(tmp_path / "run")
    states = []
    for name, part in (("a", "i < 30"), ("b", "i >= 30 AND i < 60"), ("c", "i >= 60 AND i < 62"), ("d", "i >= 62")):
        df.where(part).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(folder)
        got = {r["i"]: r["step"] for r in series.drain(series.keyed_steps(stream, "u", "i", ["v"], "at"), folder=f"{base}/steps").collect()}
        copies = {r["i"]: r["first"] for r in series.drain(series.repeated(stream, "v", "i", "at"), folder=f"{base}/copies").collect()}
        states.append((len(got), len(copies)))
    assert [n for n, _ in states] == [30, 60, 62, 64]
    assert got == {k: abs((k * k % 17) - ((k - 3) ** 2 % 17)) if 3 <= k < 60 else 0.0 for k in range(64)}
    firsts = {}
    for _, i, v, _ in rows[:60]:
        firsts.setdefault(v, i)
    assert {i: f for i, f in copies.items() if i < 60} == {i: firsts[v] for _, i, v, _ in rows[:60] if firsts[v] != i}
    held = spark.read.format("statestore").load(f"{base}/steps/state").select("key").collect()
    # The three users of January's first hour are gone; those of the last files are held.
    assert {r["key"][0] for r in held} == {160, 161, 162, 163}


def test_first_seen_holds_a_span_of_contents(spark, tmp_path):
    from datetime import datetime, timedelta

    at = datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    for n, (shift, value) in enumerate([(0, "x"), (1, "x"), (48 * 60, "y"), (49 * 60, "x")]):
        spark.createDataFrame([(value, at + timedelta(minutes=shift))], "v string, t timestamp").coalesce(1).write.parquet(f"{folder}/{n}.parquet")
        stream = spark.readStream.schema("v string, t timestamp").option("recursiveFileLookup", True).parquet(folder)
        seen = series.drain(series.first_seen(stream, "v", "t"), folder=str(tmp_path / "run"))
    assert sorted(r["v"] for r in seen.collect()) == ["x", "x", "y"]
