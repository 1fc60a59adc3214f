"""Format detection, named readers, fingerprints and descriptor files."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import ints, matrix
from ..errors import ARTIFACT_INVALID, INVALID_DATASET, RESULT_INCOMPATIBLE, LoomError
from ..session import broadcast_bytes
from .deepmd import read_deepmd
from .extxyz import ExtXyzSource, read_extxyz

_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_reader(name: str, factory: Callable[[SparkSession, str], DataFrame]) -> None:
    if name in _READERS:
        raise LoomError(INVALID_DATASET, f"reader {name!r} already exists")
    _READERS[name] = factory


register_reader("extxyz", read_extxyz)
register_reader("deepmd", read_deepmd)
register_reader("parquet", lambda spark, path: spark.read.parquet(path))


def register_formats(spark: SparkSession) -> None:
    """Makes ``spark.read.format("extxyz")`` available."""
    spark.dataSource.register(ExtXyzSource)


def detect_format(path: str) -> str:
    if os.path.isdir(path) and os.path.isfile(os.path.join(path, "type.raw")):
        if any(d.startswith("set.") and os.path.isfile(os.path.join(path, d, "coord.npy")) for d in os.listdir(path)):
            return "deepmd"
    if os.path.isfile(path) and path.lower().endswith((".xyz", ".extxyz")):
        return "extxyz"
    raise LoomError(INVALID_DATASET, "unrecognised dataset format", path=path)


def read_frames(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    name = fmt or detect_format(path)
    if name not in _READERS:
        raise LoomError(INVALID_DATASET, f"no reader named {name!r}", known=sorted(_READERS))
    return _READERS[name](spark, path)


# --- fingerprints ------------------------------------------------------------

# How much of a file is sampled.
SAMPLE_BLOCK = 1 << 20
SAMPLE_BUDGET = 32 << 20


def source_fingerprint(path: str) -> str:
    """Digest of names, sizes, times and sampled content of a dataset's files."""
    root = os.path.abspath(path)
    files = [root] if os.path.isfile(root) else sorted(os.path.join(d, f) for d, _s, names in os.walk(root) for f in names)
    digest, spent = hashlib.sha256(f"v1\0{root}".encode()), 0
    for name in files:
        info = os.stat(name)
        digest.update(f"\0{os.path.relpath(name, root)}\0{info.st_size}\0{info.st_mtime_ns}".encode())
        spots = [0] if info.st_size <= 3 * SAMPLE_BLOCK else [0, (info.st_size - SAMPLE_BLOCK) // 2, info.st_size - SAMPLE_BLOCK]
        length = info.st_size if len(spots) == 1 else SAMPLE_BLOCK
        if spent + length * len(spots) <= SAMPLE_BUDGET:
            spent += length * len(spots)
            with open(name, "rb") as stream:
                for spot in spots:
                    stream.seek(spot)
                    digest.update(stream.read(length))
    return digest.hexdigest()


def content_fingerprint(df: DataFrame) -> str:
    """Order-free digest of a table: count and two hash sums."""
    h = F.xxhash64(*df.columns)
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("a"),
        F.sum(F.pmod(F.shiftright(h, 31), F.lit(1 << 31))).alias("b")).first()
    return hashlib.sha256(json.dumps([sorted(df.columns), row["n"], row["a"], row["b"]]).encode()).hexdigest()


# --- descriptor files --------------------------------------------------------


def import_npz(spark: SparkSession, path: str, frames: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """A values file as ``i, frame, row, sample_id, features`` and its metadata.

    One file is one machine's array; it must fit the broadcast bound.
    """
    with np.load(path, allow_pickle=False) as pack:
        values = np.asarray(pack["values"])
        meta = json.loads(str(pack["metadata"]))
        offsets = np.asarray(pack["row_offsets"], dtype=np.int64) if "row_offsets" in pack else None
    if values.ndim != 2 or not np.isfinite(values).all():
        raise LoomError(ARTIFACT_INVALID, "values must be a finite 2-D array")
    if values.nbytes > broadcast_bytes(spark):
        raise LoomError(ARTIFACT_INVALID, "values exceed the single-file bound; store them as parquet", bytes=values.nbytes)
    if "descriptor" not in meta or meta.get("row_semantics") not in ("structure", "atom"):
        raise LoomError(ARTIFACT_INVALID, "metadata must name the descriptor and its row meaning")
    n = len(values)
    if meta["row_semantics"] == "atom":
        if offsets is None or offsets[0] != 0 or offsets[-1] != n or (np.diff(offsets) < 0).any():
            raise LoomError(ARTIFACT_INVALID, "row_offsets do not describe the rows")
        sizes = np.diff(offsets)
        frame = np.repeat(np.arange(len(sizes)), sizes)
        row = np.arange(n) - offsets[frame]
        ids = [f"frame:{f}:row:{r}" for f, r in zip(frame, row)]
    else:
        frame, row, ids = np.arange(n), None, [f"frame:{f}" for f in range(n)]
    out = spark.createDataFrame(pa.table({
        "i": pa.array(np.arange(n), pa.int64()), "frame": pa.array(frame, pa.int64()),
        "row": pa.array([None] * n if row is None else row, pa.int32()), "sample_id": ids,
        "features": pa.array(values.astype(float).tolist(), pa.list_(pa.float64()))}))
    if frames is not None:
        have = out.groupBy("frame").agg(F.count(F.lit(1)).alias("rows"))
        need = frames.select(F.col("frame_index").alias("frame"), (F.size("numbers") if row is not None else F.lit(1)).alias("need"))
        wrong = need.join(have, "frame", "full_outer").where(~F.col("need").eqNullSafe(F.col("rows"))).count()
        if wrong:
            raise LoomError(RESULT_INCOMPATIBLE, "rows do not match the dataset's frames", frames=wrong)
    return out, meta


def export_npz(df: DataFrame, path: str, meta: dict) -> int:
    """The reverse, for sets inside the single-file bound."""
    spark = df.sparkSession
    atom = "row" in df.columns and df.where("row IS NOT NULL").limit(1).count() > 0
    rows = df.select("frame", *(["row"] if atom else []), "features").orderBy("frame", *(["row"] if atom else []))
    width = len(df.first()["features"])
    if df.count() * width * 8 > broadcast_bytes(spark):
        raise LoomError(ARTIFACT_INVALID, "set exceeds the single-file bound; write it as parquet")
    table = rows.toArrow()
    arrays = {"values": matrix(table.column("features")), "metadata": np.array(json.dumps(meta))}
    if atom:
        frame = ints(table.column("frame").combine_chunks())
        arrays["row_offsets"] = np.searchsorted(frame, np.arange(frame.max() + 2))
    private = f"{path}.part"
    with open(private, "wb") as out:
        np.savez(out, **arrays)
    os.replace(private, path)
    return table.num_rows
