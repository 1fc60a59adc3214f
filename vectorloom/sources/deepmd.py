"""Frame sets stored as NumPy arrays per ``set.*`` folder."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import INVALID_DATASET, LoomError
from ..functions.elements import NUMBERS, SYMBOLS
from ..operators.profile import FRAME_SCHEMA
from .extxyz import ARROW_FRAME

# The largest inputs accepted.
MAX_FRAMES = 250_000
MAX_ATOMS = 10_000_000
MAX_BYTES = 2 << 30
MAX_FILES = 100_000
SLICE_FRAMES = 2048
OPTIONAL = {"energy.npy": "energy", "force.npy": "forces", "virial.npy": "virial"}


def _bad(message: str, **details) -> LoomError:
    return LoomError(INVALID_DATASET, message, **details)


def _sets(path: str) -> list[str]:
    found = sorted(
        os.path.join(path, d) for d in os.listdir(path) if d.startswith("set.") and os.path.isfile(os.path.join(path, d, "coord.npy")))
    if not found or not os.path.isfile(os.path.join(path, "type.raw")):
        raise _bad("no frame arrays found (expected type.raw and set.*/coord.npy)", path=path)
    return found


def _words(path: str) -> list[str]:
    if not os.path.isfile(path):
        raise _bad(f"{os.path.basename(path)} is required", path=path)
    with open(path, encoding="utf-8") as stream:
        return stream.read().split()


def _header(path: str, frames: int | None, width: int) -> int:
    array = np.load(path, mmap_mode="r", allow_pickle=False)
    if not np.issubdtype(array.dtype, np.number) or array.ndim == 0 or int(np.prod(array.shape[1:])) != width:
        raise _bad(f"{os.path.basename(path)} has an invalid shape", path=path)
    if frames is not None and len(array) != frames:
        raise _bad(f"{os.path.basename(path)} does not match the frame count", path=path)
    return len(array)


def layout(path: str) -> dict:
    """Elements, per-set frame counts and which properties every set carries.

    Array headers only; the size limits are refused here, before any job.
    """
    sets = _sets(path)
    kinds = [int(w) for w in _words(os.path.join(path, "type.raw"))]
    names = _words(os.path.join(path, "type_map.raw"))
    unknown = [n for n in names if n not in NUMBERS]
    if not names or unknown:
        raise _bad("type_map.raw must list real elements", unknown=unknown)
    if not kinds or len(kinds) > MAX_ATOMS or min(kinds) < 0 or max(kinds) >= len(names):
        raise _bad("type.raw does not fit type_map.raw")
    counts, files, size = [], 0, 0
    for folder in sets:
        frames = _header(os.path.join(folder, "coord.npy"), None, 3 * len(kinds))
        counts.append(frames)
        for name in os.listdir(folder):
            files += 1
            size += os.path.getsize(os.path.join(folder, name))
    if sum(counts) > MAX_FRAMES or sum(counts) * len(kinds) > MAX_ATOMS or size > MAX_BYTES or files > MAX_FILES:
        raise _bad("dataset exceeds the supported size", frames=sum(counts), bytes=size, files=files)
    present = {}
    for name, width in (("energy.npy", 1), ("force.npy", 3 * len(kinds)), ("virial.npy", 9)):
        have = [os.path.isfile(os.path.join(s, name)) for s in sets]
        if any(have) and not all(have):
            raise _bad(f"{name} must be present in every set or none")
        if all(have):
            for folder, frames in zip(sets, counts):
                _header(os.path.join(folder, name), frames, width)
            present[name] = width
    free = os.path.isfile(os.path.join(path, "nopbc"))
    boxed = False
    for folder, frames in zip(sets, counts):
        box = os.path.join(folder, "box.npy")
        if not free and os.path.isfile(box):
            _header(box, frames, 9)
            cells = np.load(box, mmap_mode="r").reshape(-1, 3, 3)
            for start in range(0, len(cells), 8192):
                part = np.asarray(cells[start:start + 8192], dtype=float)
                good = np.isfinite(part).all(axis=(1, 2))
                boxed = boxed or bool((np.abs(np.linalg.det(part[good])) > 1e-8).any())
    return {"sets": sets, "counts": counts, "numbers": [NUMBERS[names[k]] for k in kinds], "present": present, "free": free, "boxed": boxed}


def read_deepmd(spark: SparkSession, path: str) -> DataFrame:
    """Frame rows; every task maps only its slice of a set's arrays."""
    plan = layout(path)
    slices, base = [], 0
    for folder, frames in zip(plan["sets"], plan["counts"]):
        slices += [(folder, base, a, min(a + SLICE_FRAMES, frames)) for a in range(0, frames, SLICE_FRAMES)]
        base += frames
    listing = spark.createDataFrame(slices, "folder string, base bigint, first bigint, last bigint").repartition(max(1, len(slices)))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = slice(row["first"], row["last"])

                def rows(name: str, shape: tuple) -> np.ndarray:
                    return np.asarray(np.load(os.path.join(row["folder"], name), mmap_mode="r")[part], dtype=float).reshape(shape)

                places = rows("coord.npy", (-1, len(plan["numbers"]), 3))
                if not np.isfinite(places).all():
                    raise _bad("frame contains non-finite positions", folder=row["folder"])
                boxes = np.zeros((len(places), 3, 3))
                if not plan["free"] and os.path.isfile(os.path.join(row["folder"], "box.npy")):
                    boxes = rows("box.npy", (-1, 3, 3))
                extra = {key: rows(name, (-1, 3, 3) if key == "virial" else (-1,) if key == "energy" else places.shape)
                         for name, key in OPTIONAL.items() if name in plan["present"]}
                out = []
                for k in range(len(places)):
                    index, box = row["base"] + row["first"] + k, boxes[k]
                    whole = np.isfinite(box).all()
                    repeats = plan["boxed"] or (whole and abs(np.linalg.det(box)) > 1e-8)
                    energy, virial = extra.get("energy"), extra.get("virial")
                    out.append({
                        "frame_index": index, "id": f"frame_{index}", "numbers": plan["numbers"], "positions": places[k].tolist(),
                        "cell": (box if repeats and whole else np.zeros((3, 3))).tolist(), "pbc": [bool(repeats)] * 3,
                        "energy": float(energy[k]) if energy is not None and np.isfinite(energy[k]) else None,
                        "forces": extra["forces"][k].tolist() if "forces" in extra else None,
                        "virial": virial[k].tolist() if virial is not None and np.isfinite(virial[k]).all() else None,
                    })
                    if len(out) == 256:
                        yield pa.RecordBatch.from_pylist(out, schema=ARROW_FRAME)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=ARROW_FRAME)

    return listing.mapInArrow(load, FRAME_SCHEMA)


def write_deepmd(frames: DataFrame, path: str) -> int:
    """One ``set.*`` per range of frames; returns the frame count.

    All frames must list the same elements in the same order.  A property is
    written only if every frame has it; a marker says when nothing repeats.
    Tasks write under a private name and rename, so a retried task is harmless.
    """
    facts = frames.agg(
        F.count(F.lit(1)).alias("n"), F.min("numbers").alias("low"), F.max("numbers").alias("high"), F.min("frame_index").alias("first"),
        F.bool_and(F.col("energy").isNotNull()).alias("energy"), F.bool_and(F.col("forces").isNotNull()).alias("forces"),
        F.bool_and(F.col("virial").isNotNull()).alias("virial"), F.bool_or(F.exists("pbc", lambda p: p)).alias("repeats")).first()
    if not facts["n"]:
        raise _bad("nothing to write")
    if facts["low"] != facts["high"]:
        raise _bad("all frames must share species and order")
    if os.path.exists(path) and os.listdir(path):
        raise _bad("destination is not empty", path=path)
    os.makedirs(path, exist_ok=True)
    names = sorted({SYMBOLS[z - 1] for z in facts["low"]})
    with open(os.path.join(path, "type_map.raw"), "w", encoding="utf-8") as out:
        out.write("\n".join(names) + "\n")
    with open(os.path.join(path, "type.raw"), "w", encoding="utf-8") as out:
        out.write("\n".join(str(names.index(SYMBOLS[z - 1])) for z in facts["low"]) + "\n")
    if not facts["repeats"]:
        open(os.path.join(path, "nopbc"), "w").close()
    have = {k: facts[k] for k in ("energy", "forces", "virial")}
    columns = frames.select(
        "frame_index", F.flatten("positions").alias("coord"), F.flatten("cell").alias("box"), "energy",
        F.flatten("forces").alias("forces"), F.flatten("virial").alias("virial"),
        F.floor((F.col("frame_index") - F.lit(facts["first"])) / SLICE_FRAMES).alias("slot"))

    def save(key: tuple, rows: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        rows = rows.sort_by("frame_index")
        final = os.path.join(path, f"set.{slot:06d}")
        private = os.path.join(path, f".part-{slot}-{uuid.uuid4().hex}")
        os.makedirs(private)

        def put(name: str, column: str) -> None:
            np.save(os.path.join(private, name), np.array(rows.column(column).to_pylist(), dtype=float))

        put("coord.npy", "coord")
        if facts["repeats"]:
            put("box.npy", "box")
        for name, key_ in OPTIONAL.items():
            if have[key_]:
                put(name, key_)
        try:
            os.rename(private, final)
        except OSError:
            # Another attempt of this task finished first with the same rows.
            pass
        return pa.table({"slot": [slot], "n": [rows.num_rows]})

    return columns.groupBy("slot").applyInArrow(save, "slot bigint, n bigint").agg(F.sum("n")).first()[0]
