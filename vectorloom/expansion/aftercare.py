"""What is done with a finished run: its key, its candidates by number, its course, its frames as part of a dataset."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ANALYSIS_INPUT_INVALID, LoomError, invalid
from ..operators.ordering import positions
from ..plans.results import cache_key
from ..sources.extxyz import read_extxyz, write_extxyz
from .mutations import Rules
from .search import Budget, Expansion, Settings

FRAME = ("numbers", "positions", "cell", "pbc")
PROPERTIES = {"forces": "array<array<double>>", "energy": "double", "virial": "array<array<double>>"}


def run_key(settings: Settings, budget: Budget, rules: Rules, fingerprint: str, signature: str, seeds: str | None = None,
            target: dict | None = None, screen: str | None = None) -> str | None:
    """A key under which an equal run may be found again; none without an explicit whole-number seed.

    ``fingerprint`` is of the dataset, ``signature`` of the feature space,
    ``seeds`` a digest of the seeds where they were chosen, ``screen`` the
    screen's version.
    """
    if isinstance(settings.seed, bool) or not isinstance(settings.seed, int):
        return None
    params = {"settings": asdict(settings), "budget": asdict(budget), "rules": asdict(rules), "seeds": seeds, "target": target, "screen": screen}
    return cache_key("expansion", params, [fingerprint, signature])


def candidates(spark: SparkSession, run: Expansion) -> DataFrame:
    """Every evaluated candidate of all rounds, numbered from zero as ``index``, with whether it was ``accepted``."""
    judged = [f"{run.folder}/evaluated-{r.generation}" for r in run.rounds if r.evaluations]
    taken = [f"{run.folder}/accepted-{r.generation}" for r in run.rounds if r.accepted]
    if not judged:
        raise invalid("the run has evaluated nothing")
    rows = positions(spark.read.parquet(*judged), "i", "index")
    if not taken:
        return rows.withColumn("accepted", F.lit(False))
    kept = spark.read.parquet(*taken).select("i", F.lit(True).alias("accepted"))
    return rows.join(kept, "i", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def candidate(spark: SparkSession, run: Expansion, index: int) -> DataFrame:
    """The one candidate with a number, also of rounds before the run was resumed."""
    if isinstance(index, bool) or not isinstance(index, int) or not 0 <= index < sum(r.evaluations for r in run.rounds):
        raise invalid("no candidate has this number", index=index)
    return candidates(spark, run).where(F.col("index") == index)


def course(spark: SparkSession, run: Expansion) -> DataFrame:
    """A row per round with what was reached by its end; a run has few rounds."""
    schema = "generation int, proposed bigint, evaluations bigint, duplicates bigint, accepted bigint, best_fitness double"
    rows = spark.createDataFrame([(r.generation, r.proposed, r.evaluations, r.duplicates, r.accepted, r.best_fitness) for r in run.rounds], schema)
    so_far = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("*", F.sum("evaluations").over(so_far).alias("evaluations_so_far"), F.sum("accepted").over(so_far).alias("accepted_so_far"),
                       F.max("best_fitness").over(so_far).alias("best_so_far"))


def appended(frames: DataFrame, accepted: DataFrame) -> DataFrame:
    """``frames`` and after them the ``accepted`` ones in the order of ``i``.

    Properties that accepted frames lack are null; columns that only they have
    are left out.  New numbers follow the largest one there is.
    """
    last = frames.agg(F.coalesce(F.max("frame_index"), F.lit(-1)).alias("m")).first()["m"]
    shared = [c for c in accepted.columns if c in frames.columns and c != "frame_index"]
    placed = positions(accepted.select("i", *[c for c in shared if c != "i"]), "i", "_place")
    new = placed.withColumn("frame_index", (F.col("_place") + F.lit(last + 1)).cast(frames.schema["frame_index"].dataType)).drop("_place", *([] if "i" in frames.columns else ["i"]))
    return frames.unionByName(new, allowMissingColumns=True)


def add_to_dataset(spark: SparkSession, frames: DataFrame, accepted: DataFrame, path: str) -> DataFrame:
    """Writes the dataset with the accepted frames as a new extended XYZ folder and reads it back.

    The old dataset stays as it is, and a folder that exists is refused.  The
    new one is counted, and an error where frames are missing leaves it for inspection.
    """
    missing = [c for c in ("i", *FRAME) if c not in accepted.columns]
    if missing:
        raise invalid("accepted frames lack columns", missing=missing)
    expected = frames.count() + accepted.count()
    grown = appended(frames, accepted)
    for name, kind in PROPERTIES.items():
        if name not in grown.columns:
            grown = grown.withColumn(name, F.lit(None).cast(kind))
    write_extxyz(grown, path)
    found = read_extxyz(spark, path)
    n = found.count()
    if n != expected:
        raise LoomError(ANALYSIS_INPUT_INVALID, f"{n} frames were read back where {expected} were written")
    return found
