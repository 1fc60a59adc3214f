"""Catalog tables as parquet snapshots, and the queries asked of them.

A change writes a whole new snapshot beside the old one and then swaps a
pointer file, so readers never see half a table.  The tables list datasets,
runs and jobs, not data rows, and stay small.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DATASET_CHANGED, INVALID_DATASET, UNSUPPORTED_PERIODICITY, LoomError, invalid
from ..operators.ordering import recent_values, running_max, running_totals

# Table layouts and states.
SCHEMAS = {
    "datasets": "dataset_id string, name string, path string, format string, n_frames bigint, fingerprint string, periodicity string, created_at string",
    "runs": "run_id string, dataset_id string, descriptor string, signature string, fingerprint string, status string, created_at string",
    "analyses": "analysis_id string, analysis_type string, run_ids string, params string, cache_key string, status string, created_at string",
    "jobs": "job_id string, category string, dataset_id string, run_id string, status string, created_at string",
    "views": "view_id string, dataset_id string, name string, role string, frames array<bigint>, selection_hash string, fingerprint string, created_at string",
    "lineage": "dataset_id string, parent_id string, relation string",
    "settings": "key string, value string, written_at string",
}
ACTIVE = ("QUEUED", "RUNNING")


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    def _pointer(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.json")

    def read(self, name: str) -> DataFrame:
        if os.path.isfile(self._pointer(name)):
            with open(self._pointer(name), encoding="utf-8") as stream:
                return self.spark.read.schema(SCHEMAS[name]).parquet(json.load(stream)["path"])
        return self.spark.createDataFrame([], SCHEMAS[name])

    def write(self, name: str, rows: DataFrame) -> None:
        path = os.path.join(self.folder, f"{name}-{time.time_ns()}")
        rows.select(*[f.split(" ")[0] for f in SCHEMAS[name].split(", ")]).coalesce(1).write.parquet(path)
        with open(self._pointer(name) + ".part", "w", encoding="utf-8") as stream:
            json.dump({"path": path}, stream)
        os.replace(self._pointer(name) + ".part", self._pointer(name))

    def add(self, name: str, *rows: dict) -> None:
        fresh = self.spark.createDataFrame([tuple(r.get(f.split(" ")[0]) for f in SCHEMAS[name].split(", ")) for r in rows], SCHEMAS[name])
        self.write(name, self.read(name).unionByName(fresh))

    # -- datasets and runs

    def dataset_status(self, dataset_id: str, current: str | None) -> str:
        """Whether the stored fingerprint still describes the source."""
        row = self.read("datasets").where(F.col("dataset_id") == dataset_id).first()
        if row is None:
            raise LoomError(INVALID_DATASET, "unknown dataset", dataset=dataset_id)
        if current is None:
            return "UNAVAILABLE"
        return "CURRENT" if current == row["fingerprint"] else "CHANGED"

    def mark_stale(self, dataset_id: str, fingerprint: str) -> None:
        """Runs made from another state of the source can no longer be used."""
        old = (F.col("dataset_id") == dataset_id) & (F.col("fingerprint") != fingerprint) & (F.col("status") == "COMPLETED")
        self.write("runs", self.read("runs").withColumn("status", F.when(old, "STALE").otherwise(F.col("status"))))

    def require_fresh(self, run_id: str) -> None:
        row = self.read("runs").where(F.col("run_id") == run_id).first()
        if row is None or row["status"] != "COMPLETED":
            raise LoomError(DATASET_CHANGED, "run cannot feed an analysis", run=run_id, status=row and row["status"])

    def rename_dataset(self, dataset_id: str, name: str) -> None:
        if not name.strip() or len(name) > 200:
            raise invalid("name must have 1 to 200 characters")
        self.write("datasets", self.read("datasets").withColumn("name", F.when(F.col("dataset_id") == dataset_id, name.strip()).otherwise(F.col("name"))))

    def remove_dataset(self, dataset_id: str) -> None:
        """Refused while a linked job is active; takes its runs and analyses along."""
        self._refuse_active(F.col("dataset_id") == dataset_id)
        runs = self.read("runs")
        gone = runs.where(F.col("dataset_id") == dataset_id).select("run_id")
        self.write("analyses", without_members(self.read("analyses"), "run_ids", gone, "run_id"))
        for name in ("runs", "jobs", "views", "lineage", "datasets"):
            self.write(name, self.read(name).where(F.col("dataset_id") != dataset_id))

    def remove_run(self, run_id: str) -> None:
        self._refuse_active(F.col("run_id") == run_id)
        runs = self.read("runs")
        self.write("analyses", without_members(self.read("analyses"), "run_ids", runs.where(F.col("run_id") == run_id).select("run_id"), "run_id"))
        self.write("runs", runs.where(F.col("run_id") != run_id))

    def remove_analysis(self, analysis_id: str) -> None:
        rows = self.read("analyses")
        row = rows.where(F.col("analysis_id") == analysis_id).first()
        if row is not None and row["status"] in ACTIVE:
            raise invalid("analysis is still running", status=row["status"])
        self.write("analyses", rows.where(F.col("analysis_id") != analysis_id))

    def _refuse_active(self, condition: Column) -> None:
        if not self.read("jobs").where(condition & F.col("status").isin(*ACTIVE)).isEmpty():
            raise invalid("a linked job is still active")

    # -- jobs

    def cancel_job(self, job_id: str) -> None:
        """Settles the row at once and stops its Spark jobs; finished jobs stay as they are."""
        hit = (F.col("job_id") == job_id) & F.col("status").isin(*ACTIVE)
        self.write("jobs", self.read("jobs").withColumn("status", F.when(hit, "CANCELLED").otherwise(F.col("status"))))
        self.spark.sparkContext.cancelJobGroup(job_id)

    def sweep(self) -> None:
        """Rows left active by a previous session: expansions can resume, others cannot."""
        left = F.col("status").isin(*ACTIVE)
        state = F.when(left & (F.col("category") == "generation"), "INTERRUPTED").when(left, "CANCELLED").otherwise(F.col("status"))
        self.write("jobs", self.read("jobs").withColumn("status", state))

    # -- settings and views

    def set(self, key: str, value: str) -> None:
        row = {"key": key, "value": value, "written_at": f"{time.time_ns():020d}"}
        fresh = self.spark.createDataFrame([tuple(row.values())], SCHEMAS["settings"])
        self.write("settings", latest(self.read("settings").unionByName(fresh), "key", "written_at"))

    def get(self, key: str) -> str | None:
        row = self.read("settings").where(F.col("key") == key).first()
        return row and row["value"]

    def create_view(self, dataset_id: str, name: str, frames: list[int], n_frames: int, fingerprint: str, role: str = "subset") -> str:
        chosen = validated_frames(frames, n_frames)
        self._free_name(dataset_id, name)
        digest = self.spark.range(1).select(selection_hash(F.array(*[F.lit(f) for f in chosen]))).first()[0]
        view_id = f"view-{time.time_ns()}"
        self.add("views", {"view_id": view_id, "dataset_id": dataset_id, "name": name, "role": role, "frames": chosen,
                           "selection_hash": digest, "fingerprint": fingerprint, "created_at": f"{time.time_ns():020d}"})
        return view_id

    def rename_view(self, view_id: str, name: str) -> None:
        rows = self.read("views")
        row = rows.where(F.col("view_id") == view_id).first()
        if row is None:
            raise invalid("unknown view")
        self._free_name(row["dataset_id"], name)
        self.write("views", rows.withColumn("name", F.when(F.col("view_id") == view_id, name).otherwise(F.col("name"))))

    def remove_view(self, view_id: str) -> None:
        self.write("views", self.read("views").where(F.col("view_id") != view_id))

    def list_views(self, dataset_id: str, fingerprint: str) -> DataFrame:
        """With a flag for views made from another state of the source."""
        return self.read("views").where(F.col("dataset_id") == dataset_id).withColumn("stale", F.col("fingerprint") != fingerprint)

    def _free_name(self, dataset_id: str, name: str) -> None:
        if not name.strip() or not self.read("views").where((F.col("dataset_id") == dataset_id) & (F.col("name") == name)).isEmpty():
            raise invalid("view names are unique within a dataset and not empty")


# --- queries -----------------------------------------------------------------


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row per key, as an aggregate."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(F.max_by(packed, order).alias("_row")).select("_row.*")


def without_members(rows: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose JSON list holds none of the ids."""
    listed = rows.select(*rows.columns, F.explode_outer(F.from_json(column, "array<string>")).alias("_id"))
    touched = listed.join(gone.select(F.col(key).alias("_id")), "_id", "left_semi").select(rows.columns[0]).distinct()
    return rows.join(touched, rows.columns[0], "left_anti")


def json_holds(column: str, value: str) -> Column:
    """Whether a JSON list of strings contains a value."""
    return F.array_contains(F.from_json(column, "array<string>"), value)


def newest(rows: DataFrame, order: str, tie: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(limit)


def page(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(limit)


def runs_with_datasets(runs: DataFrame, datasets: DataFrame, key: str, order: str, tie: str, limit: int | None = None) -> DataFrame:
    """Runs beside their dataset, newest first; all of them unless a limit is asked for."""
    joined = runs.join(datasets, key)
    return joined.orderBy(F.desc(order), tie) if limit is None else newest(joined, order, tie, limit)


def queue_positions(jobs: DataFrame, category: str, order: str, position: str = "position") -> DataFrame:
    """1-based place in each category's queue, cut into ranges of the order key."""
    run = running_totals(jobs.withColumn("_one", F.lit(1)), [category], order, "_one")
    return run.select(*jobs.columns, (F.col("before") + 1).cast("bigint").alias(position))


def validated_frames(frames: list[int], n_frames: int) -> list[int]:
    """Integers in range, first mention kept."""
    if any(isinstance(f, bool) or not isinstance(f, int) or not 0 <= f < n_frames for f in frames):
        raise invalid("frame indices must be integers in range", n_frames=n_frames)
    if not frames:
        raise invalid("a selection cannot be empty")
    return list(dict.fromkeys(frames))


def first_mentions(rows: DataFrame, value: str, place: str) -> DataFrame:
    """The same over a table: distinct values with the place of their first mention."""
    return rows.groupBy(value).agg(F.min(place).alias(place))


def selection_hash(frames: Column) -> Column:
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(frames))), 256)


def view_slice(df: DataFrame, view: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows whose frame is in the view; Spark broadcasts the view only if it is small."""
    return df.join(view.select(frame), frame, "left_semi")


def require_same_source(run: dict, view: dict) -> None:
    if run["dataset_id"] != view["dataset_id"] or run["fingerprint"] != view["fingerprint"]:
        raise LoomError(DATASET_CHANGED, "view and run describe different data")


def require_periodicity(kind: str, accepted: tuple[str, ...]) -> None:
    if kind not in accepted:
        raise LoomError(UNSUPPORTED_PERIODICITY, f"descriptor does not accept {kind} data", accepted=accepted)


def validate_parameters(values: dict, schema: dict[str, dict]) -> dict:
    """Descriptor parameters against their declared type, choices and bounds."""
    unknown = set(values) - set(schema)
    if unknown:
        raise invalid(f"unknown parameters {sorted(unknown)}")
    out = {}
    for name, rule in schema.items():
        value = values.get(name, rule.get("default"))
        if value is None:
            if rule.get("required"):
                raise invalid(f"{name} is required")
            continue
        kind = {"int": int, "float": (int, float), "bool": bool, "str": str, "list": list}[rule["type"]]
        if not isinstance(value, kind) or (isinstance(value, bool) and rule["type"] != "bool"):
            raise invalid(f"{name} must be of type {rule['type']}")
        if "enum" in rule and value not in rule["enum"]:
            raise invalid(f"{name} must be one of {rule['enum']}")
        if ("min" in rule and value < rule["min"]) or ("max" in rule and value > rule["max"]):
            raise invalid(f"{name} is out of range")
        out[name] = value
    return out


# --- splits ------------------------------------------------------------------


def split_sizes(n: int, ratios: tuple[float, float, float]) -> tuple[int, int, int]:
    """Sizes for train, validation and test.

    Train and validation are rounded, test is the rest; each part with a ratio
    gets at least one.
    """
    if min(ratios) < 0 or sum(ratios) <= 0:
        raise invalid("ratios must be non-negative and not all zero")
    wanted = [r for r in ratios if r > 0]
    if n < len(wanted):
        raise invalid("too few frames for the split")
    share = [r / sum(ratios) for r in ratios]
    least = [int(r > 0) for r in ratios]
    train = min(max(round(n * share[0]), least[0]), n - least[1] - least[2])
    validation = min(max(round(n * share[1]), least[1]), n - train - least[2]) if least[2] else n - train
    return train, validation, n - train - validation


def split(df: DataFrame, key: str, ratios: tuple[float, float, float], seed: int = 42) -> DataFrame:
    """Every row with its part, in seeded hash order."""
    train, validation, _test = split_sizes(df.count(), ratios)
    ticket = df.select(key, F.xxhash64(key, F.lit(seed)).alias("_ticket"), F.lit(1).alias("_one"), F.lit(0).alias("_all"))
    placed = running_totals(ticket, ["_all"], "_ticket", "_one")
    part = F.when(F.col("before") < train, "train").when(F.col("before") < train + validation, "validation").otherwise("test")
    return placed.select(key, part.alias("part"))


# --- series kept by runs -----------------------------------------------------


def trailing_sum(rounds: DataFrame, group: str, order: str, value: str, width: int) -> DataFrame:
    """Sum over the last ``width`` rounds of a run."""
    near = recent_values(rounds, order, value, width - 1, (group,), "_recent")
    return near.withColumn("trailing", F.aggregate("_recent", F.col(value), lambda a, x: a + x)).drop("_recent")


def stagnation(rounds: DataFrame, group: str, order: str, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rounds since the best value last improved."""
    best = running_max(rounds, order, value, (group,), "_best")
    better = F.col("_best").isNull() | (F.col(value) > F.col("_best") + tolerance)
    placed = running_totals(best.withColumn("_one", F.lit(1)), [group], order, "_one")
    marked = placed.withColumn("_hit", F.when(better, F.col("before")))
    last = running_max(marked, order, "_hit", (group,), "_last")
    since = F.col("before") - F.coalesce("_hit", "_last")
    return last.withColumn("stagnant", since).drop("_best", "_one", "before", "total", "_hit", "_last")

