"""Frame profile, health and geometry, on frames derived from the embeddings.

Each embedding becomes one frame of 10 to 13 atoms: its numbers are read as
positions and forces, its label picks the cell, the periodic axes and which
properties are absent.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import elements, geometry, vec
from ...operators import blocks, contacts, profile
from .inputs import embeddings, table, tidy


def frames(spark, sf):
    df = embeddings(spark, sf)
    v, label = F.col("features"), F.col("label")
    atoms = F.sequence(F.lit(0), F.lit(9) + label % 4)
    side = F.lit(20.0) + label
    tilt = F.when(label % 2 == 0, 1.0).otherwise(0.0)
    zero = F.lit(0.0)
    box = F.array(F.array(side, zero, zero), F.array(tilt, F.lit(20.0), zero), F.array(zero, zero, F.lit(20.0)))
    empty = F.array(*[F.array(zero, zero, zero) for _ in range(3)])
    return df.select(
        F.col("i").alias("frame_index"),
        F.concat(F.lit("frame_"), F.col("i").cast("string")).alias("id"),
        F.transform(atoms, lambda a: F.element_at(F.array(F.lit(6), F.lit(1), F.lit(8), F.lit(14)), (label + a * a) % 4 + 1)).alias("numbers"),
        F.transform(atoms, lambda a: F.array(*[F.get(v, 3 * a + k) * 40 + 10 for k in range(3)])).alias("positions"),
        F.when(label == 9, empty).otherwise(box).alias("cell"),
        F.array(label % 3 != 1, label % 3 != 1, label % 3 == 0).alias("pbc"),
        F.when(label != 4, F.get(v, F.lit(63)) * 100).alias("energy"),
        F.transform(atoms, lambda a: F.array(F.get(v, a + 48) * 150, F.get(v, a) * 150, F.get(v, a + 16) * 150)).alias("forces"),
        F.lit(None).cast("array<array<double>>").alias("virial"),
    )


def _facts(spark, sf):
    return profile.frame_facts(frames(spark, sf))


def summary(spark, sf):
    return tidy(_facts(spark, sf).select("frame_index", "natoms", "formula", "energy_per_atom", "force_max", F.round("volume", 4).alias("volume"), "axes"))


def totals(spark, sf):
    return profile.totals(frames(spark, sf))


def element_totals(spark, sf):
    return profile.element_totals(frames(spark, sf))


def compositions(spark, sf):
    return profile.compositions(_facts(spark, sf))


def formulas(spark, sf):
    return profile.formulas(_facts(spark, sf))


def element_histogram(spark, sf):
    return profile.element_count_histogram(frames(spark, sf))


def force_summary(spark, sf):
    return tidy(profile.value_summary(profile.force_values(frames(spark, sf)), "value"), 4)


def force_histogram(spark, sf):
    return tidy(profile.value_histogram(profile.force_values(frames(spark, sf)), "value"), 4)


def volume_summary(spark, sf):
    return tidy(profile.value_summary(_facts(spark, sf).where("volume IS NOT NULL"), "volume"), 4)


def declared(spark, sf):
    found = profile.declared(_facts(spark, sf))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} boolean" for k in found))


def checks(spark, sf):
    return profile.check_counts(profile.health(frames(spark, sf)))


def simple_checks(spark, sf):
    return _facts(spark, sf).select("frame_index", "energy_anomaly", "extreme_force", "net_force_violation", "invalid_cell")


def findings(spark, sf):
    return profile.findings(profile.health(frames(spark, sf)), "missing")


def every_finding(spark, sf):
    """All checks over all frames, one in fifty of which stands twice."""
    once = frames(spark, sf)
    again = once.where("frame_index % 50 = 0").withColumn("frame_index", F.col("frame_index") + 1_000_000)
    return profile.all_findings(profile.health(once.unionByName(again)))


def periodicity(spark, sf):
    return profile.periodicity(frames(spark, sf))


def cell_shapes(spark, sf):
    c = geometry.cell_parameters(F.col("cell"))
    return tidy(frames(spark, sf).where(F.abs(geometry.determinant(F.col("cell"))) > 1e-8).select("frame_index", c.alias("p")).select("frame_index", "p.*"))


def wrapped(spark, sf):
    usable = frames(spark, sf).where(F.abs(geometry.determinant(F.col("cell"))) > 1e-8)
    atom = usable.select("frame_index", "cell", "pbc", F.posexplode("positions").alias("row", "p"))
    w = geometry.wrapped(F.col("p"), F.col("cell"), F.col("pbc"))
    return tidy(atom.select("frame_index", "row", w.alias("w")).select("frame_index", "row", F.col("w")[0].alias("x"), F.col("w")[1].alias("y"), F.col("w")[2].alias("z")))


def minimum_image(spark, sf):
    usable = frames(spark, sf).where(F.abs(geometry.determinant(F.col("cell"))) > 1e-8)
    gap = F.zip_with(F.col("positions")[0], F.col("positions")[1], lambda a, b: (a - b) * 6)
    g = geometry.minimum_image(gap, F.col("cell"), F.col("pbc"))
    return tidy(usable.select("frame_index", g.alias("g")).select("frame_index", F.col("g")[0].alias("x"), F.col("g")[1].alias("y"), F.col("g")[2].alias("z")))


def image_limits(spark, sf):
    usable = frames(spark, sf).where(F.abs(geometry.determinant(F.col("cell"))) > 1e-8)
    lim = geometry.image_limits(F.col("cell"), 30.0, F.col("pbc"))
    return usable.select("frame_index", lim.alias("n")).select("frame_index", F.col("n")[0].alias("a"), F.col("n")[1].alias("b"), F.col("n")[2].alias("c"))


def frame_geometry(spark, sf):
    return tidy(contacts.frame_geometry(frames(spark, sf)))


def graph(spark, sf):
    edges = contacts.neighbor_graph(frames(spark, sf), 3.0)
    return tidy(edges.groupBy("frame").agg(F.count(F.lit(1)).alias("contacts"), F.sum("distance").alias("length")))


def coordination(spark, sf):
    return contacts.coordination(frames(spark, sf), 3.0, 4).select("frame", "row", "element", "coordination", F.size("neighbors").cast("bigint").alias("listed"))


def ghosts(spark, sf):
    return contacts.boundary_ghosts(frames(spark, sf), 3.0).groupBy("frame").agg(F.count(F.lit(1)).alias("ghosts"))


def labels(spark, sf):
    return frames(spark, sf).select(
        "frame_index", elements.element_set(F.col("numbers")).alias("element_set"), elements.reduced_composition(F.col("numbers")).alias("composition"))


def fractions(spark, sf):
    f = elements.fractions(F.col("numbers"), [1, 6, 8, 14])
    return tidy(frames(spark, sf).select("frame_index", *[f[k].alias(n) for k, n in enumerate(("h", "c", "o", "si"))]))


def force_block(spark, sf):
    from ...functions import vec

    m = geometry.magnitudes(F.col("forces"))
    return tidy(frames(spark, sf).select("frame_index", vec.row_mean(m).alias("mean"), F.array_max(m).alias("max"), vec.row_std(m).alias("std")))


def atoms(spark, sf):
    return tidy(profile.atom_rows(frames(spark, sf)))


def atom_page(spark, sf):
    return tidy(profile.atom_page(frames(spark, sf), 3, 2, 5).select("row", "element", "x"))


def pooled(spark, sf):
    rows = profile.atom_rows(frames(spark, sf)).select(F.col("frame_index").alias("frame"), F.array("x", "y", "z").alias("features"))
    p = profile.pooled(rows)
    return tidy(p.select("frame", *[F.col("features")[k].alias(n) for k, n in enumerate("xyz")]))


def radii(spark, sf):
    z = table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("z"))
    return tidy(z.select("p_partkey", elements.symbol(F.col("z")).alias("symbol"), elements.covalent_radius(F.col("z")).alias("radius"),
                         elements.atomic_number(elements.symbol(F.col("z"))).alias("back")))


def duplicate_documents(spark, sf):
    """Whole texts: each copy points at the first document with the same text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("frame_index"), F.sha2("text", 256).alias("content"))
    first = profile.first_occurrences(docs)
    return first.where("first < frame_index").select(F.col("frame_index").alias("doc_id"), "first")


def properties(spark, sf):
    """Atom samples with their frame's properties; absent ones are null."""
    f = frames(spark, sf)
    rows = profile.atom_rows(f).select("frame_index", "row", F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2 + F.col("fz") ** 2).alias("force_magnitude"))
    return tidy(rows.join(profile.frame_facts(f).select("frame_index", "energy_per_atom", "force_max"), "frame_index", "left"))


def block_space(spark, sf):
    """All frames by composition, forces and the summary of their vectors."""
    space = blocks.blocks_space(("composition", "force", "descriptor_summary"), frames(spark, sf), embeddings(spark, sf).select("i", "features"), {"force": 2.0}, "standardized")
    return tidy(vec.unpivot(space, "i"))


def cell_block_space(spark, sf):
    """The periodic frames that have an energy, by cell and energy per atom."""
    known = frames(spark, sf).where("energy IS NOT NULL AND cell[0][0] > 0")
    return tidy(vec.unpivot(blocks.blocks_space(("lattice", "energy"), known, weights={"lattice": 0.5}, scaling="standardized"), "i"))


QUERIES = {
    "pre5_blocks": block_space, "pre5_cell_blocks": cell_block_space,
    "prj1_frame_summary": summary, "agg1_totals": totals, "agg2_elements": element_totals, "agg3_compositions": compositions,
    "agg4_formulas": formulas, "agg5_element_histogram": element_histogram, "agg8_force_summary": force_summary, "agg6_force_histogram": force_histogram,
    "agg17_volume_summary": volume_summary, "agg9_declared": declared, "agg10_health_counts": checks, "agg11_frame_checks": simple_checks,
    "agg19_findings": findings, "agg19_every_finding": every_finding, "agg18_periodicity": periodicity, "fn7_cell_parameters": cell_shapes, "fn8_wrapped": wrapped,
    "fn9_minimum_image": minimum_image, "fn10_image_limits": image_limits, "agg15_frame_geometry": frame_geometry, "join10_contacts": graph,
    "alg12_coordination": coordination, "fn11_ghosts": ghosts, "flt14_group_labels": labels, "agg22_fractions": fractions,
    "agg23_force_block": force_block, "flt13_atom_rows": atoms, "prj2_atom_page": atom_page, "agg20_pooled": pooled, "fn2_radii": radii,
    "join11_duplicates": duplicate_documents, "join4_properties": properties,
}

BASE = """fr AS (SELECT vec_id AS frame_index, label, embedding::DOUBLE[] AS v, 10 + label % 4 AS n FROM embeddings),
 ix AS (SELECT frame_index, label, n, v, unnest(range(0, n)) AS a FROM fr),
 atoms AS (SELECT frame_index, label, n, a::INTEGER AS row, [6, 1, 8, 14][(label + a * a) % 4 + 1] AS element, ['C', 'H', 'O', 'Si'][(label + a * a) % 4 + 1] AS s,
   [0.76, 0.31, 0.66, 1.11][(label + a * a) % 4 + 1]::DOUBLE AS rad, v[3 * a + 1] * 40 + 10 AS x, v[3 * a + 2] * 40 + 10 AS y, v[3 * a + 3] * 40 + 10 AS z,
   v[a + 49] * 150 AS fx, v[a + 1] * 150 AS fy, v[a + 17] * 150 AS fz FROM ix),
 cells AS (SELECT frame_index, label, n, v, 20.0::DOUBLE + label AS A, CASE WHEN label % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS t, label % 3 <> 1 AS pa, label % 3 = 0 AS pc, label <> 9 AS solid FROM fr),
 ec AS (SELECT frame_index, s, count(*) AS c FROM atoms GROUP BY 1, 2),
 names AS (SELECT frame_index, string_agg(s || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END, '' ORDER BY CASE s WHEN 'C' THEN 0 WHEN 'H' THEN 1 ELSE 2 END, s) AS hill_c,
   string_agg(s || CASE WHEN c > 1 THEN c::VARCHAR ELSE '' END, '' ORDER BY s) AS hill_n, string_agg(s, '-' ORDER BY s) AS element_set, bool_or(s = 'C') AS carbon FROM ec GROUP BY 1),
 ff AS (SELECT frame_index, sqrt(fx ** 2 + fy ** 2 + fz ** 2) AS f FROM atoms),
 fa AS (SELECT frame_index, max(f) AS fmax, avg(f) AS fmean, stddev_pop(f) AS fstd FROM ff GROUP BY 1),
 nf AS (SELECT frame_index, sqrt(sum(fx) ** 2 + sum(fy) ** 2 + sum(fz) ** 2) AS net FROM atoms GROUP BY 1)"""
PAIRS = f"""{BASE},
 w AS (SELECT a.frame_index, row, element, rad, A, t, pa AND solid AS pa, pc AND solid AS pc, solid, x, y, z, y / 20 AS fb, (x - y / 20 * t) / A AS fa_, z / 20 AS fc FROM atoms a JOIN cells c USING (frame_index)),
 p AS (SELECT *, CASE WHEN pa THEN (fa_ - floor(fa_)) * A + (fb - floor(fb)) * t ELSE x END AS px, CASE WHEN pa THEN (fb - floor(fb)) * 20 ELSE y END AS py,
   CASE WHEN pc THEN (fc - floor(fc)) * 20 ELSE z END AS pz FROM w),
 sh AS (SELECT unnest([-1, 0, 1]) AS s),
 pr AS (SELECT i.frame_index, i.row AS src, i.element, j.row AS dst, a.s AS sa, b.s AS sb, c.s AS sc, i.rad + j.rad AS rr,
   sqrt((j.px + a.s * i.A + b.s * i.t - i.px) ** 2 + (j.py + b.s * 20 - i.py) ** 2 + (j.pz + c.s * 20 - i.pz) ** 2) AS d
   FROM p i JOIN p j ON i.frame_index = j.frame_index JOIN sh a ON a.s = 0 OR i.pa JOIN sh b ON b.s = 0 OR i.pa JOIN sh c ON c.s = 0 OR i.pc
   WHERE NOT (i.row = j.row AND a.s = 0 AND b.s = 0 AND c.s = 0))"""
AXES = "CASE label % 3 WHEN 0 THEN 'XYZ' WHEN 1 THEN '—' ELSE 'XY' END"
FORMULA = "CASE WHEN carbon THEN hill_c ELSE hill_n END"

SQL = {
    "prj1_frame_summary": f"""WITH {BASE} SELECT c.frame_index, n::INTEGER AS natoms, {FORMULA} AS formula, round(CASE WHEN label <> 4 THEN v[64] * 100 END / n, 6) + 0.0 AS energy_per_atom,
 round(fmax, 5) AS force_max, round(CASE WHEN solid THEN A * 400 END, 4) AS volume, {AXES} AS axes FROM cells c JOIN names USING (frame_index) JOIN fa USING (frame_index)""",
    "agg1_totals": f"WITH {BASE} SELECT count(*) AS structures, sum(n)::BIGINT AS atoms_total FROM fr",
    "agg2_elements": f"WITH {BASE} SELECT s AS element, count(*) AS atoms FROM atoms GROUP BY 1",
    "agg3_compositions": f"WITH {BASE} SELECT element_set, count(*) AS frames FROM names GROUP BY 1",
    "agg4_formulas": f"WITH {BASE} SELECT {FORMULA} AS formula, count(*) AS frames FROM names GROUP BY 1",
    "agg5_element_histogram": f"""WITH {BASE}, g AS (SELECT frame_index, s FROM fr, (SELECT DISTINCT s FROM atoms)) SELECT g.s AS element, coalesce(c, 0) AS atoms, count(*) AS frames
 FROM g LEFT JOIN ec USING (frame_index, s) GROUP BY 1, 2""",
    "agg8_force_summary": f"WITH {BASE} SELECT round(min(f), 4) AS min, round(max(f), 4) AS max, round(avg(f), 4) AS mean, round(quantile_cont(f, 0.5), 4) AS median FROM ff",
    "agg6_force_histogram": f"""WITH {BASE}, e AS (SELECT min(f) AS a, max(f) AS b FROM ff), c AS (SELECT least(floor((f - a) / (b - a) * 40), 39)::INTEGER AS bin, count(*) AS n FROM ff, e GROUP BY 1)
 SELECT g.bin, round(a + (b - a) / 40 * g.bin, 4) + 0.0 AS lo, round(a + (b - a) / 40 * (g.bin + 1), 4) + 0.0 AS hi, coalesce(n, 0) AS n FROM (SELECT a, b, unnest(range(0, 40))::INTEGER AS bin FROM e) g LEFT JOIN c USING (bin)""",
    "agg17_volume_summary": f"WITH {BASE}, s AS (SELECT A * 400 AS vol FROM cells WHERE solid) SELECT round(min(vol), 4) AS min, round(max(vol), 4) AS max, round(avg(vol), 4) AS mean, round(quantile_cont(vol, 0.5), 4) AS median FROM s",
    "agg9_declared": "SELECT true AS energy, true AS forces, false AS virial FROM embeddings LIMIT 1",
    "agg10_health_counts": f"""WITH {PAIRS}, np AS (SELECT frame_index, bool_or(d < 0.7 * rr) AS bad FROM pr GROUP BY 1)
 SELECT count(*) FILTER (WHERE label = 4) AS missing, count(*) FILTER (WHERE label <> 4 AND v[64] >= 0) AS energy_anomaly, count(*) FILTER (WHERE fmax > 50) AS extreme_force,
 count(*) FILTER (WHERE net > 1e-3) AS net_force_violation, count(*) FILTER (WHERE NOT solid) AS invalid_cell, count(*) FILTER (WHERE bad) AS nonphysical, 0::BIGINT AS duplicate
 FROM cells JOIN fa USING (frame_index) JOIN nf USING (frame_index) LEFT JOIN np USING (frame_index)""",
    "agg11_frame_checks": f"""WITH {BASE} SELECT frame_index, label <> 4 AND v[64] >= 0 AS energy_anomaly, fmax > 50 AS extreme_force, net > 1e-3 AS net_force_violation, NOT solid AS invalid_cell
 FROM cells JOIN fa USING (frame_index) JOIN nf USING (frame_index)""",
    "agg19_every_finding": f"""WITH {PAIRS}, np AS (SELECT frame_index, bool_or(d < 0.7 * rr) AS bad FROM pr GROUP BY 1),
 k AS (SELECT frame_index, unnest([CASE WHEN label = 4 THEN 'missing' END, CASE WHEN label <> 4 AND v[64] >= 0 THEN 'energy_anomaly' END, CASE WHEN fmax > 50 THEN 'extreme_force' END,
  CASE WHEN net > 1e-3 THEN 'net_force_violation' END, CASE WHEN NOT solid THEN 'invalid_cell' END, CASE WHEN bad THEN 'nonphysical' END]) AS "check"
  FROM cells JOIN fa USING (frame_index) JOIN nf USING (frame_index) LEFT JOIN np USING (frame_index))
 SELECT frame_index, "check" FROM k WHERE "check" IS NOT NULL UNION ALL SELECT frame_index + 1000000, "check" FROM k WHERE "check" IS NOT NULL AND frame_index % 50 = 0
 UNION ALL SELECT vec_id + 1000000, 'duplicate' FROM embeddings WHERE vec_id % 50 = 0""",
    "agg19_findings": "SELECT vec_id AS frame_index FROM embeddings WHERE label = 4",
    "agg18_periodicity": f"SELECT {AXES} AS axes, count(*) AS frames, 'mixed' AS kind FROM embeddings GROUP BY 1",
    "fn7_cell_parameters": f"""WITH {BASE} SELECT frame_index, A AS a, round(sqrt(t * t + 400), 6) + 0.0 AS b, 20.0::DOUBLE AS c, 90.0::DOUBLE AS alpha, 90.0::DOUBLE AS beta,
 round(degrees(acos(t / sqrt(t * t + 400))), 6) + 0.0 AS gamma FROM cells WHERE solid""",
    "fn8_wrapped": f"WITH {PAIRS} SELECT frame_index, row, round(px, 6) + 0.0 AS x, round(py, 6) + 0.0 AS y, round(pz, 6) + 0.0 AS z FROM p WHERE solid",
    "fn9_minimum_image": f"""WITH {BASE}, g AS (SELECT i.frame_index, (i.x - j.x) * 6 AS gx, (i.y - j.y) * 6 AS gy, (i.z - j.z) * 6 AS gz FROM atoms i JOIN atoms j USING (frame_index) WHERE i.row = 0 AND j.row = 1),
 s AS (SELECT g.frame_index, A, t, pa, pc, (gx - gy / 20 * t) / A AS fa_, gy / 20 AS fb, gz / 20 AS fc FROM g JOIN cells USING (frame_index) WHERE solid),
 m AS (SELECT frame_index, A, t, CASE WHEN pa THEN fa_ - round_even(fa_, 0) ELSE fa_ END AS ra, CASE WHEN pa THEN fb - round_even(fb, 0) ELSE fb END AS rb, CASE WHEN pc THEN fc - round_even(fc, 0) ELSE fc END AS rc FROM s)
 SELECT frame_index, round(ra * A + rb * t, 6) + 0.0 AS x, round(rb * 20, 6) + 0.0 AS y, round(rc * 20, 6) + 0.0 AS z FROM m""",
    "fn10_image_limits": f"""WITH {BASE} SELECT frame_index, CASE WHEN pa THEN ceil(30 * sqrt(1 / (A * A) + (t / (20 * A)) ** 2))::INTEGER + 1 ELSE 0 END AS a, CASE WHEN pa THEN 3 ELSE 0 END::INTEGER AS b,
 CASE WHEN pc THEN 3 ELSE 0 END::INTEGER AS c FROM cells WHERE solid""",
    "agg15_frame_geometry": f"WITH {PAIRS} SELECT frame_index, round(min(d), 6) + 0.0 AS min_distance, bool_or(d < 0.7 * rr) AS nonphysical FROM pr GROUP BY 1",
    "join10_contacts": f"WITH {PAIRS} SELECT frame_index AS frame, count(*) AS contacts, round(sum(d), 6) + 0.0 AS length FROM pr WHERE d <= 3 AND d > 1e-10 GROUP BY 1",
    "alg12_coordination": f"""WITH {PAIRS}, c AS (SELECT frame_index, src, count(*) AS n FROM pr WHERE d <= 3 AND d > 1e-10 GROUP BY 1, 2)
 SELECT p.frame_index AS frame, p.row::BIGINT AS row, p.element, coalesce(n, 0) AS coordination, least(coalesce(n, 0), 4) AS listed FROM p LEFT JOIN c ON c.frame_index = p.frame_index AND c.src = p.row""",
    "fn11_ghosts": f"WITH {PAIRS} SELECT frame_index AS frame, count(DISTINCT [dst, sa, sb, sc]) AS ghosts FROM pr WHERE d <= 3 AND NOT (sa = 0 AND sb = 0 AND sc = 0) GROUP BY 1",
    "flt14_group_labels": f"""WITH {BASE}, g AS (SELECT frame_index, max(k) AS g FROM (SELECT frame_index, unnest(range(1, n + 1)) AS k FROM fr) q
 WHERE NOT EXISTS (SELECT 1 FROM ec WHERE ec.frame_index = q.frame_index AND c % k <> 0) GROUP BY 1)
 SELECT ec.frame_index, string_agg(s, '-' ORDER BY s) AS element_set, string_agg(s || ':' || (c // g)::VARCHAR, '-' ORDER BY s) AS composition FROM ec JOIN g USING (frame_index) GROUP BY 1""",
    "agg22_fractions": f"""WITH {BASE} SELECT frame_index, round(avg((s = 'H')::INTEGER), 6) AS h, round(avg((s = 'C')::INTEGER), 6) AS c, round(avg((s = 'O')::INTEGER), 6) AS o, round(avg((s = 'Si')::INTEGER), 6) AS si FROM atoms GROUP BY 1""",
    "agg23_force_block": f"WITH {BASE} SELECT frame_index, round(fmean, 6) AS mean, round(fmax, 6) AS max, round(fstd, 6) AS std FROM fa",
    "flt13_atom_rows": f"""WITH {BASE} SELECT frame_index, row, element, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z,
 round(fx, 6) + 0.0 AS fx, round(fy, 6) + 0.0 AS fy, round(fz, 6) + 0.0 AS fz FROM atoms""",
    "prj2_atom_page": f"WITH {BASE} SELECT row, element, round(x, 6) + 0.0 AS x FROM atoms WHERE frame_index = 3 AND row >= 2 AND row < 7",
    "agg20_pooled": f"WITH {BASE} SELECT frame_index AS frame, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM atoms GROUP BY 1",
    "fn2_radii": "WITH s AS (SELECT [" + ", ".join(f"'{s}'" for s in elements.SYMBOLS) + "] AS s, [" + ", ".join(str(r) for r in elements.RADII) + "]::DOUBLE[] AS r) "
    "SELECT p_partkey, s[p_size] AS symbol, r[greatest(least(p_size, 96), 1)] AS radius, p_size AS back FROM part, s",
    "join11_duplicates": "SELECT doc_id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) WHERE first < doc_id",
    "join4_properties": f"""WITH {BASE} SELECT a.frame_index, row, round(sqrt(fx ** 2 + fy ** 2 + fz ** 2), 6) + 0.0 AS force_magnitude, round(CASE WHEN a.label <> 4 THEN v[64] * 100 END / a.n, 6) + 0.0 AS energy_per_atom,
 round(fmax, 5) + 0.0 AS force_max FROM atoms a JOIN cells c USING (frame_index) JOIN fa USING (frame_index)""",
}

_SCALED = """SELECT frame_index AS i, f::INTEGER AS f, round((x - avg(x) OVER (PARTITION BY f)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY f) > 1e-9 THEN stddev_pop(x) OVER (PARTITION BY f) ELSE 1 END * w, 6) + 0.0 AS x FROM b"""
SQL["pre5_blocks"] = f"""WITH {BASE}, sh AS (SELECT frame_index, unnest([avg((s = 'C')::INTEGER), avg((s = 'H')::INTEGER), avg((s = 'O')::INTEGER), avg((s = 'Si')::INTEGER)]) AS x, unnest(range(0, 4)) AS f, 1 / sqrt(4) AS w FROM atoms GROUP BY frame_index),
 fo AS (SELECT frame_index, unnest([fmean, fmax, fstd]) AS x, unnest(range(4, 7)) AS f, 2 / sqrt(3) AS w FROM fa),
 ds AS (SELECT frame_index, unnest([list_avg(v), list_stddev_pop(v), sqrt(list_sum(list_transform(v, lambda x: x * x)))]) AS x, unnest(range(7, 10)) AS f, 1 / sqrt(3) AS w FROM fr),
 b AS (SELECT * FROM sh UNION ALL SELECT * FROM fo UNION ALL SELECT * FROM ds) {_SCALED}"""
SQL["pre5_cell_blocks"] = f"""WITH {BASE}, k AS (SELECT * FROM cells WHERE solid AND label <> 4),
 b AS (SELECT frame_index, unnest([A, sqrt(t * t + 400), 20, 90, 90, degrees(acos(t / sqrt(t * t + 400)))]) AS x, unnest(range(0, 6)) AS f, 0.5 / sqrt(6) AS w FROM k
  UNION ALL SELECT frame_index, v[64] * 100 / n, 6, 1 FROM k) {_SCALED}"""
