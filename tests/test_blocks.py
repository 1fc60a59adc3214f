"""Named blocks of frames: values, refusals, scaling on another set."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.errors import LoomError
from vectorloom.operators import blocks, sampling
from vectorloom.operators.profile import FRAME_SCHEMA


def frames_of(spark, n=12, without=None):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(n):
        numbers = [14, 8, 8, 1][: 2 + k % 3]
        forces = rng.normal(size=(len(numbers), 3)).tolist()
        energy = float(k * k) if k != without else None
        rows.append((k, f"frame_{k}", numbers, rng.normal(size=(len(numbers), 3)).tolist(), (np.eye(3) * (5 + k)).tolist(), [True] * 3, energy, forces, None))
    return spark.createDataFrame(rows, FRAME_SCHEMA), rows


def test_values_of_each_block(spark):
    frames, rows = frames_of(spark)
    vectors = spark.createDataFrame([(k, [float(k), 2.0, -1.0]) for k in range(12)], "i bigint, features array<double>")
    made = {name: {r["i"]: r["features"] for r in block.collect()} for name, block in blocks.block_vectors(blocks.BLOCKS, frames, vectors).items()}
    assert blocks.listed_elements(frames) == [1, 8, 14]
    for k, _, numbers, _, _, _, energy, forces, _ in rows:
        np.testing.assert_allclose(made["lattice"][k], [5 + k] * 3 + [90] * 3)
        np.testing.assert_allclose(made["composition"][k], [numbers.count(z) / len(numbers) for z in (1, 8, 14)])
        np.testing.assert_allclose(made["energy"][k], [energy / len(numbers)])
        size = np.linalg.norm(forces, axis=1)
        np.testing.assert_allclose(made["force"][k], [size.mean(), size.max(), size.std()])
        x = np.array([k, 2.0, -1.0])
        np.testing.assert_allclose(made["descriptor_summary"][k], [x.mean(), x.std(), np.linalg.norm(x)])
        assert made["descriptor"][k] == x.tolist()


def test_missing_facts_and_unknown_names_are_refused(spark):
    frames, _ = frames_of(spark, without=4)
    vectors = spark.createDataFrame([(k, [1.0]) for k in range(5)], "i bigint, features array<double>")
    flat = frames.withColumn("cell", F.transform("cell", lambda r: F.transform(r, lambda x: x * 0)))
    for names, given, more in ((["energy"], frames, None), (["lattice"], flat, None), (["force"], frames.withColumn("forces", F.lit(None).cast("array<array<double>>")), None),
                               (["mass"], frames, None), (["force", "force"], frames, None), ([], frames, None), (["force"], None, vectors),
                               (["descriptor"], frames, None), (["force", "descriptor"], frames, vectors)):
        with pytest.raises(LoomError):
            blocks.block_vectors(names, given, more)
    with pytest.raises(LoomError):
        blocks.block_vectors(["composition"], frames, elements=[])


def test_space_is_scaled_on_the_other_set_and_can_be_sampled(spark):
    frames, rows = frames_of(spark)
    base = frames.where("frame_index < 6")
    space = {r["i"]: r["features"] for r in blocks.blocks_space(("energy", "force"), frames, weights={"energy": 3.0}, scaling="standardized", fitted_on=(base, None)).collect()}
    energy = np.array([r[6] / len(r[2]) for r in rows])
    np.testing.assert_allclose([space[k][0] for k in range(12)], 3 * (energy - energy[:6].mean()) / energy[:6].std())
    picked = sampling.sample(blocks.blocks_space(("energy", "composition"), frames), "fps", {"n_samples": 4, "scaling": "raw"})
    assert len(set(picked.ids)) == 4
