"""Descriptor diagnostics on the derived frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import descriptors
from ...operators import diagnostics as dg
from ...operators import environments as env
from .frames import PAIRS, frames
from .inputs import RAW, embeddings, tidy


def _energy(spark, sf):
    return frames(spark, sf).select(F.col("frame_index").alias("frame"), (F.col("energy") / F.size("numbers")).alias("energy"))


def fingerprints(spark, sf):
    s = dg.structure_fingerprints(frames(spark, sf))
    return tidy(s.select("frame", "atoms", F.array_min("shape").alias("low"), F.array_max("shape").alias("high"),
                         F.aggregate("shape", F.lit(0.0), lambda a, x: a + x).alias("total")))


def environments(spark, sf):
    e = dg.environment_fingerprints(frames(spark, sf), 4.0, 6)
    return tidy(e.select("frame", "row", "element", F.aggregate("shape", F.lit(0.0), lambda a, x: a + x).alias("length"),
                         F.aggregate("species", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("charge")))


def degeneracy(spark, sf):
    found = dg.degeneracy_search(embeddings(spark, sf), dg.structure_fingerprints(frames(spark, sf)), _energy(spark, sf))
    return tidy(found["shown"].select("a", "b", "distance", F.when(F.col("structural") < float("inf"), F.col("structural")).alias("structural"), "delta_energy", "reason"))


def consistency(spark, sf):
    found = dg.distance_consistency(embeddings(spark, sf), dg.structure_fingerprints(frames(spark, sf)), None, {"max_samples": 2000})
    return tidy(spark.createDataFrame([(found["pearson"], found["spearman"], found["collapse_count"])], "pearson double, spearman double, collapsed bigint"))


def consistency_bins(spark, sf):
    found = dg.distance_consistency(embeddings(spark, sf), dg.structure_fingerprints(frames(spark, sf)), None, {"max_samples": 2000})
    return tidy(found["bins"])


def invariance(spark, sf):
    out = dg.formal_invariance(frames(spark, sf), descriptors.radial_histogram(4.0, 8))
    return out.agg(F.count(F.lit(1)).alias("frames"), F.count_if("passed").alias("passed"), F.count_if("sees_chirality").alias("chiral"))


def perturbation(spark, sf):
    return tidy(dg.response_summary(dg.perturbation_response(frames(spark, sf), descriptors.radial_histogram(4.0, 8))))


def smoothness(spark, sf):
    return tidy(dg.cutoff_smoothness(frames(spark, sf), lambda o: descriptors.radial_histogram(4.0 + o, 8)).select("frame", "jump_ratio", "worst_response"))


def jacobian(spark, sf):
    return dg.frame_jacobian(frames(spark, sf), descriptors.coulomb_spectrum(16)).select("frame", "rank", "deficiency")


def neighbor_responses(spark, sf):
    """How strongly each atom's faded number of neighbours answers to their moves."""
    rows = env.environment_jacobian(frames(spark, sf), descriptors.smooth_coordination(4.0), {"cutoff": 4.0, "displacement": 1e-5})
    return tidy(rows.select("frame", "atom", "species", "neighbor_count", "expected_rank", "sigma_max", "rotational_residual"))


def descriptor_rows(spark, sf):
    rows = descriptors.compute(frames(spark, sf), descriptors.composition_vector((1, 6, 8, 14)))
    return tidy(rows.select("frame", *[F.col("features")[k].alias(n) for k, n in enumerate(("h", "c", "o", "si"))]))


QUERIES = {
    "dia8_structure_fingerprint": fingerprints, "dia9_environment_fingerprint": environments, "dia6_degeneracy": degeneracy,
    "dia7_consistency": consistency, "dia7_consistency_bins": consistency_bins, "dia3_invariance": invariance, "dia2_perturbation": perturbation,
    "dia4_cutoff_smoothness": smoothness, "dia5_jacobian": jacobian, "dia5_environments": neighbor_responses, "udf3_composition_descriptor": descriptor_rows,
}

_BASE = PAIRS.split(",\n w AS")[0]
MIN_IMAGE = f"""{_BASE},
 raw AS (SELECT i.frame_index, i.row AS ra, j.row AS rb, j.element AS eb, c.A, c.t, c.pa AND c.solid AS pa, c.pc AND c.solid AS pc, i.x - j.x AS dx, i.y - j.y AS dy, i.z - j.z AS dz
   FROM atoms i JOIN atoms j ON i.frame_index = j.frame_index AND i.row <> j.row JOIN cells c ON c.frame_index = i.frame_index),
 mi AS (SELECT frame_index, ra, rb, eb, sqrt((dx - CASE WHEN pa THEN round_even((dx - dy / 20 * t) / A, 0) * A + round_even(dy / 20, 0) * t ELSE 0 END) ** 2
   + (dy - CASE WHEN pa THEN round_even(dy / 20, 0) * 20 ELSE 0 END) ** 2 + (dz - CASE WHEN pc THEN round_even(dz / 20, 0) * 20 ELSE 0 END) ** 2) AS d FROM raw),
 shp AS (SELECT frame_index, any_value(n) AS n, list(d ORDER BY d) AS shape FROM mi JOIN fr USING (frame_index) WHERE ra < rb GROUP BY 1)"""
_STRUCT = "CASE WHEN len(x.shape) = len(y.shape) THEN list_distance(x.shape, y.shape) END"
_ALL = f"""{MIN_IMAGE}, {RAW}, pp AS (SELECT a.i AS a, b.i AS b, list_distance(a.v, b.v) AS d, {_STRUCT} AS s FROM e a JOIN e b ON a.i < b.i JOIN shp x ON x.frame_index = a.i JOIN shp y ON y.frame_index = b.i),
 q AS (SELECT * FROM pp WHERE s IS NOT NULL)"""

SQL = {
    "dia8_structure_fingerprint": f"WITH {MIN_IMAGE} SELECT frame_index AS frame, n::BIGINT AS atoms, round(shape[1], 6) + 0.0 AS low, round(shape[-1], 6) + 0.0 AS high, round(list_sum(shape), 6) + 0.0 AS total FROM shp",
    "dia9_environment_fingerprint": f"""WITH {MIN_IMAGE}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_index, ra ORDER BY d) AS nd, row_number() OVER (PARTITION BY frame_index, ra ORDER BY eb) AS ne FROM mi WHERE d <= 4)
 SELECT a.frame_index AS frame, a.row, a.element, round(coalesce(sum(d) FILTER (WHERE nd <= 6), 0), 6) + 0.0 AS length, coalesce(sum(eb) FILTER (WHERE ne <= 6), 0)::BIGINT AS charge
 FROM atoms a LEFT JOIN k ON k.frame_index = a.frame_index AND k.ra = a.row GROUP BY 1, 2, 3""",
    "dia5_environments": f"""WITH {MIN_IMAGE}, k AS (SELECT *, 4 * d / 16 * (1 - d * d / 16) AS slope FROM mi WHERE d <= 4)
 SELECT a.frame_index AS frame, a.row AS atom, a.element AS species, count(d) AS neighbor_count, greatest(3 * count(d) - 3, 0) AS expected_rank, round(coalesce(sqrt(sum(slope * slope)), 0), 6) + 0.0 AS sigma_max,
  CASE WHEN count(d) > 0 THEN 0.0 END AS rotational_residual FROM atoms a LEFT JOIN k ON k.frame_index = a.frame_index AND k.ra = a.row GROUP BY 1, 2, 3""",
    "dia6_degeneracy": f"""WITH {MIN_IMAGE}, {RAW}, nn AS (SELECT a.i, b.i AS j, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.v, b.v), b.i) AS n FROM e a JOIN e b ON a.i <> b.i),
 pr AS (SELECT least(i, j) AS a, greatest(i, j) AS b, min(d) AS d FROM nn WHERE n <= 8 GROUP BY 1, 2), en AS (SELECT frame_index, CASE WHEN label <> 4 THEN v[64] * 100 / n END AS en FROM fr),
 t AS (SELECT a, b, d, {_STRUCT} AS s, abs(ea.en - eb.en) AS de FROM pr JOIN shp x ON x.frame_index = a JOIN shp y ON y.frame_index = b JOIN en ea ON ea.frame_index = a JOIN en eb ON eb.frame_index = b),
 th AS (SELECT quantile_cont(d, 0.05) AS dq, quantile_cont(s, 0.9) AS sq, quantile_cont(de, 0.9) AS eq FROM t),
 f AS (SELECT t.*, coalesce(s, 'inf'::DOUBLE) >= sq AS far, coalesce(de >= eq, false) AS jump FROM t, th WHERE d <= dq)
 SELECT a, b, round(d, 6) + 0.0 AS distance, round(s, 6) + 0.0 AS structural, round(de, 6) + 0.0 AS delta_energy,
 CASE WHEN far AND jump THEN 'structure+energy' WHEN far AND s IS NOT NULL THEN 'structure' WHEN far THEN 'atom_count' ELSE 'energy' END AS reason
 FROM f WHERE far OR jump ORDER BY CASE WHEN s IS NULL THEN 'inf'::DOUBLE ELSE s / greatest(d, 1e-12) END DESC, a, b LIMIT 50""",
    "dia7_consistency": f"""WITH {_ALL}, r AS (SELECT d, s, row_number() OVER (ORDER BY d, a, b) AS rx, row_number() OVER (ORDER BY s, a, b) AS ry FROM q),
 th AS (SELECT quantile_cont(d, 0.05) AS dq, quantile_cont(s, 0.95) AS sq FROM q)
 SELECT round(corr(d, s), 6) + 0.0 AS pearson, round(corr(rx, ry), 6) + 0.0 AS spearman, count(*) FILTER (WHERE d <= dq AND s >= sq) AS collapsed FROM r, th""",
    "dia7_consistency_bins": f"""WITH {_ALL}, ed AS (SELECT quantile_cont(d, [{', '.join(f'{k}/12.0' for k in range(1, 12))}]) AS e FROM q), bn AS (SELECT d, s, len(list_filter(e, lambda x: x <= d))::INTEGER AS bin FROM q, ed)
 SELECT bin, count(*) AS n, round(max(d), 6) + 0.0 AS d_max, round(avg(s), 6) + 0.0 AS mean, round(quantile_cont(s, 0.5), 6) + 0.0 AS median, round(quantile_cont(s, 0.9), 6) + 0.0 AS p90 FROM bn GROUP BY bin""",
    "udf3_composition_descriptor": f"WITH {_BASE} SELECT frame_index AS frame, round(avg((s = 'H')::INTEGER), 6) AS h, round(avg((s = 'C')::INTEGER), 6) AS c, round(avg((s = 'O')::INTEGER), 6) AS o, round(avg((s = 'Si')::INTEGER), 6) AS si FROM atoms GROUP BY 1",
}
