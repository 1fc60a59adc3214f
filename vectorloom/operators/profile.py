"""Dataset profile and health checks over frame rows.

One projection turns every frame into a row of scalars; all counts, histograms
and findings are aggregates of that projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import elements, geometry
from ..functions.vec import finite
from .contacts import CELL_TOLERANCE, frame_geometry
from .ordering import histogram, quantile_values

FRAME_SCHEMA = (
    "frame_index bigint, id string, numbers array<int>, positions array<array<double>>, cell array<array<double>>, "
    "pbc array<boolean>, energy double, forces array<array<double>>, virial array<array<double>>"
)

# Thresholds of the health checks.
EXTREME_FORCE = 50.0
NET_FORCE = 1e-3
BINS = 40
CHECKS = ("missing", "energy_anomaly", "extreme_force", "net_force_violation", "invalid_cell", "nonphysical", "duplicate")


def content_key(df_numbers: Column, positions: Column, cell: Column) -> Column:
    """Hash of the structure alone; labels do not count."""
    return F.sha2(F.to_json(F.struct(df_numbers.alias("n"), positions.alias("p"), cell.alias("c"))), 256)


def frame_facts(frames: DataFrame) -> DataFrame:
    """One row of scalars per frame."""
    n = F.size("numbers")
    det = F.abs(geometry.determinant(F.col("cell")))
    sizes = geometry.magnitudes(F.col("forces"))
    biggest = finite(F.array_max(sizes))
    periodic = F.exists("pbc", lambda p: p)
    flat = F.flatten("cell")
    broken = F.exists(flat, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    balance = finite(geometry.net_force(F.col("forces")))
    return frames.select(
        "frame_index",
        n.alias("natoms"),
        elements.hill_formula(F.col("numbers")).alias("formula"),
        elements.element_set(F.col("numbers")).alias("element_set"),
        F.col("energy").isNotNull().alias("has_energy"),
        F.col("forces").isNotNull().alias("has_forces"),
        F.col("virial").isNotNull().alias("has_virial"),
        finite(F.round(F.col("energy") / n, 6)).alias("energy_per_atom"),
        F.round(biggest, 5).alias("force_max"),
        balance.alias("net_force"),
        F.when(det > CELL_TOLERANCE, det).alias("volume"),
        geometry.periodic_axes(F.col("pbc")).alias("axes"),
        F.coalesce(finite(F.col("energy")) / n >= 0, F.lit(False)).alias("energy_anomaly"),
        F.coalesce(biggest > EXTREME_FORCE, F.lit(False)).alias("extreme_force"),
        F.coalesce(balance > NET_FORCE, F.lit(False)).alias("net_force_violation"),
        (periodic & (broken | F.coalesce(det <= CELL_TOLERANCE, F.lit(True)))).alias("invalid_cell"),
        content_key(F.col("numbers"), F.col("positions"), F.col("cell")).alias("content"),
    )


def declared(facts: DataFrame) -> dict[str, bool]:
    """Which properties any frame carries."""
    row = facts.agg(*[F.bool_or(f"has_{p}").alias(p) for p in ("energy", "forces", "virial")]).first()
    return {p: bool(row[p]) for p in ("energy", "forces", "virial")}


def first_occurrences(facts: DataFrame) -> DataFrame:
    """``frame_index, first``: later copies point at the lowest frame.

    The lowest frame per content is an aggregate with partial sums, then an
    equi-join, so a content shared by most frames is no single task's group.
    """
    firsts = facts.groupBy("content").agg(F.min("frame_index").alias("first"), F.count(F.lit(1)).alias("copies"))
    repeated = firsts.where("copies > 1")
    return facts.select("frame_index", "content").join(repeated, "content", "left").select(
        "frame_index", F.coalesce("first", "frame_index").alias("first"))


def health(frames: DataFrame) -> DataFrame:
    """Every frame with one flag per check."""
    facts = frame_facts(frames)
    present = declared(facts)
    absent = F.lit(False)
    for name, shown in present.items():
        if shown:
            absent = absent | ~F.col(f"has_{name}")
    first = first_occurrences(facts)
    return (
        facts.withColumn("missing", absent)
        .join(first, "frame_index")
        .withColumn("duplicate", F.col("first") < F.col("frame_index"))
        .join(frame_geometry(frames), "frame_index")
        .drop("content")
    )


def check_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(*[F.count_if(c).alias(c) for c in CHECKS])


def findings(checked: DataFrame, check: str, shown: int | None = None) -> DataFrame:
    """Frames failing one check: all of them, or the first ``shown`` for a display."""
    failed = checked.where(F.col(check)).select("frame_index").orderBy("frame_index")
    return failed if shown is None else failed.limit(shown)


def all_findings(checked: DataFrame) -> DataFrame:
    """``frame_index, check``: a row for every check that a frame fails."""
    failed = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in CHECKS]), lambda c: c.isNotNull())
    return checked.select("frame_index", F.explode(failed).alias("check"))


def totals(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count(F.lit(1)).alias("structures"), F.coalesce(F.sum(F.size("numbers")), F.lit(0)).cast("bigint").alias("atoms_total"))


def element_totals(frames: DataFrame) -> DataFrame:
    exploded = frames.select(F.explode("numbers").alias("z")).groupBy("z").agg(F.count(F.lit(1)).alias("atoms"))
    return exploded.select(elements.symbol(F.col("z")).alias("element"), "atoms").orderBy("element")


def compositions(facts: DataFrame) -> DataFrame:
    counts = facts.groupBy("element_set").agg(F.count(F.lit(1)).alias("frames"))
    return counts.orderBy(F.size(F.split("element_set", "-")), F.desc("frames"), "element_set")


def formulas(facts: DataFrame) -> DataFrame:
    return facts.groupBy("formula").agg(F.count(F.lit(1)).alias("frames")).orderBy(F.desc("frames"), "formula")


def element_count_histogram(frames: DataFrame) -> DataFrame:
    """Per element, how many frames hold each atom count; absence counts as zero."""
    held = frames.select("frame_index", F.explode(elements.element_counts(F.col("numbers"))).alias("c")).select(
        F.col("c.s").alias("element"), F.col("c.n").cast("bigint").alias("atoms"))
    counted = held.groupBy("element", "atoms").agg(F.count(F.lit(1)).alias("frames"))
    every = frames.count()
    present = counted.groupBy("element").agg(F.sum("frames").alias("with_it"))
    zero = present.where(F.col("with_it") < every).select("element", F.lit(0).cast("bigint").alias("atoms"), (F.lit(every) - F.col("with_it")).alias("frames"))
    return counted.unionByName(zero)


def force_values(frames: DataFrame) -> DataFrame:
    return frames.select(F.explode(geometry.magnitudes(F.col("forces"))).alias("value")).select(finite(F.col("value")).alias("value")).where("value IS NOT NULL")


def value_summary(values: DataFrame, value: str) -> DataFrame:
    """Minimum, maximum, mean and exact median, rounded."""
    middle = quantile_values(values, value, [0.5])[0]
    base = values.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")).withColumn("median", F.lit(middle).cast("double"))
    return base.select(*[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "median")])


def value_histogram(values: DataFrame, value: str) -> DataFrame:
    return histogram(values, [], value, BINS)


def periodicity(frames: DataFrame) -> DataFrame:
    """Which periodic-axis patterns occur and the overall kind."""
    counts = frames.groupBy(geometry.periodic_axes(F.col("pbc")).alias("axes")).agg(F.count(F.lit(1)).alias("frames"))
    everything = Window.partitionBy(F.lit(0))
    kind = F.when(F.min(F.col("axes") == "XYZ").over(everything), "fully periodic").when(
        F.min(F.col("axes") == "—").over(everything), "isolated").otherwise("mixed")
    return counts.withColumn("kind", kind)


def atom_rows(frames: DataFrame) -> DataFrame:
    """One row per atom with position and force."""
    joined = F.arrays_zip(F.col("numbers").alias("z"), F.col("positions").alias("p"), F.coalesce("forces", F.array()).alias("f"))
    return frames.select("frame_index", F.posexplode(joined).alias("row", "a")).select(
        "frame_index", "row", F.col("a.z").alias("element"), F.col("a.p")[0].alias("x"), F.col("a.p")[1].alias("y"), F.col("a.p")[2].alias("z"),
        F.col("a.f")[0].alias("fx"), F.col("a.f")[1].alias("fy"), F.col("a.f")[2].alias("fz"))


def atom_page(frames: DataFrame, frame: int, offset: int, limit: int) -> DataFrame:
    """A window of one frame's atoms."""
    rows = atom_rows(frames.where(F.col("frame_index") == frame))
    return rows.where((F.col("row") >= offset) & (F.col("row") < offset + limit)).orderBy("row")


def pooled(rows: DataFrame, frame: str = "frame") -> DataFrame:
    """Atom vectors averaged per frame.

    Averages per (frame, feature) combine before the shuffle, so a frame with
    very many atoms is no larger a group than any other.
    """
    long = rows.select(frame, F.posexplode("features").alias("f", "x"))
    means = long.groupBy(frame, "f").agg(F.avg("x").alias("m"))
    packed = F.array_sort(F.collect_list(F.struct("f", "m")))
    return means.groupBy(frame).agg(F.transform(packed, lambda s: s["m"]).alias("features"))
