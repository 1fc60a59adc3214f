"""Catalog queries, selections, sinks, streams and the expansion loop."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ...expansion import aftercare, breeding, mutations, scoring, search, swarm
from ...functions.descriptors import composition_vector, radial_histogram
from ...operators import contacts, local_diversity, profile, sampling
from ...operators.ordering import positions
from ...operators.preprocess import bounded_subset
from ...operators.spectrum import visual_plane
from ...session import shared_folder
from ...sources import deepmd, extxyz, registry
from ...streaming import series
from .. import catalog, results
from .frames import BASE, frames
from .inputs import RAW, embeddings, query_side, reference_side, standardized, table, tidy


def _folder(spark, name):
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


# --- filters, joins, sets ----------------------------------------------------


def view_slice(spark, sf):
    view = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame"), "l_quantity")
    return tidy(catalog.view_slice(lines, view).groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")))


def first_mentions(spark, sf):
    return catalog.first_mentions(table(spark, sf, "lineitem").select("l_partkey", "l_orderkey"), "l_partkey", "l_orderkey")


def bounded(spark, sf):
    df = positions(table(spark, sf, "orders").select(F.col("o_orderkey").alias("i")), "i")
    return bounded_subset(df, df.count(), 1000, "pos").select("i")


def element_rows(spark, sf):
    return tidy(embeddings(spark, sf).where("label = 3").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("features")[0]).alias("mean")), 8)


def finite_targets(spark, sf):
    from ...operators.correlation import with_target

    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("i"), F.array("l_quantity").alias("features"), F.when(F.col("l_tax") > 0, F.col("l_extendedprice") / F.col("l_tax")).otherwise(F.lit(float("inf"))).alias("t"))
    return with_target(lines, "t").agg(F.count(F.lit(1)).alias("n"))


def catalog_filter(spark, sf):
    return catalog.newest(table(spark, sf, "orders").where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"), "o_orderdate", "o_orderkey", 200).select("o_orderkey")


def json_membership(spark, sf):
    events = table(spark, sf, "events").withColumn("ids", F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
    return events.where(catalog.json_holds("ids", "error")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def runs_with_datasets(spark, sf):
    runs = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tidy(catalog.runs_with_datasets(runs, table(spark, sf, "customer"), "c_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "c_name", "o_totalprice"))


def latest_active(spark, sf):
    runs = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey").where("o_orderstatus IN ('P', 'O')")
    return catalog.runs_with_datasets(runs, table(spark, sf, "customer"), "c_custkey", "o_orderdate", "o_orderkey", 1).select("o_orderkey", "c_name")


def decorated(spark, sf):
    points = table(spark, sf, "customer").where("c_acctbal > 5000").select("c_custkey")
    facts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return tidy(results.decorate(points, facts, "c_custkey"))


def unmatched(spark, sf):
    docs, labels = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("d")), table(spark, sf, "labels").select("doc_id", F.lit(1).alias("l"))
    both = docs.join(labels, "doc_id", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l").isNull()).alias("unlabelled"), F.count_if(F.col("d").isNull()).alias("orphans"))


def union_elements(spark, sf):
    sides = [frames(spark, sf).where(c).select(F.explode("numbers").alias("z")) for c in ("frame_index < 100", "frame_index >= 100")]
    return sides[0].union(sides[1]).distinct()


def stacked(spark, sf):
    df = embeddings(spark, sf)
    both = reference_side(df).select("i", F.lit(0).alias("source")).unionByName(query_side(df).select("i", F.lit(1).alias("source")))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def seed_pool(spark, sf):
    f = frames(spark, sf).select("frame_index")
    rows = f.count()
    pool = search.seed_pool(f, rows, 200, frames(spark, sf).where("energy IS NULL").select("frame_index"))
    return pool


def distinct_frames(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame")).distinct().agg(F.count(F.lit(1)).alias("frames"))


def split_counts(spark, sf):
    parts = catalog.split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", (0.8, 0.1, 0.1))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def page(spark, sf):
    return catalog.page(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 120, 40)


def elite(spark, sf):
    scored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), F.floor(F.col("o_totalprice") / 10000).cast("double").alias("fitness"))
    return scoring.elite(scored, 25).select("i", "fitness")


def queue(spark, sf):
    return catalog.queue_positions(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


def trailing(spark, sf):
    rounds = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tidy(catalog.trailing_sum(rounds, "o_custkey", "o_orderkey", "o_totalprice", 3).select("o_orderkey", "trailing"), 2)


def stagnant(spark, sf):
    rounds = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return catalog.stagnation(rounds, "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", F.col("stagnant").cast("bigint").alias("stagnant"))


def text_copies(spark, sf):
    docs = table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    return docs.where("copies > 1")


def latest_settings(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("value"), F.col("event_id").alias("written"))
    return tidy(catalog.latest(events, "key", "written"))


def removed(spark, sf):
    """Cascade: orders that mention a removed customer's id in a JSON list."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.to_json(F.array(F.col("o_custkey").cast("string"), F.lit("x"))).alias("ids"))
    gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("id"))
    return catalog.without_members(rows, "ids", gone, "id").agg(F.count(F.lit(1)).alias("left"))


def chunk(spark, sf):
    df = embeddings(spark, sf).select("i", "features")
    part, _cut = results.chunk(df, 10, 50, 5, 3, vector="features")
    return tidy(part.select("i", F.explode("features").alias("x")).groupBy("i").agg(F.sum("x").alias("total"), F.count(F.lit(1)).alias("n")))


def heatmap(spark, sf):
    rows = profile.atom_rows(frames(spark, sf)).select(F.col("frame_index").alias("frame"), "row", F.array("x", "y", "z").alias("features"))
    return results.heatmap(rows, 7).select("row", F.col("features")[0].alias("x"), F.col("features")[2].alias("z"))


def preview(spark, sf):
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), "o_totalprice")
    who = table(spark, sf, "orders").select(F.col("o_orderkey").alias("i"), "o_orderstatus")
    return tidy(results.preview(points, who, points.count(), limit=3000))


def text_digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


def table_digest(spark, sf):
    return spark.createDataFrame([(registry.content_fingerprint(table(spark, sf, "orders")),)], "digest string")


# --- sinks -------------------------------------------------------------------


def text_round_trip(spark, sf):
    path = _folder(spark, "frames")
    extxyz.write_extxyz(frames(spark, sf), path)
    back = profile.atom_rows(extxyz.read_extxyz(spark, path))
    return tidy(back.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("fx").alias("fx")), 5)


def array_round_trip(spark, sf):
    """First ten atoms of every frame, all given one composition."""
    path = _folder(spark, "arrays")
    kinds = F.array(*[F.lit(z) for z in (6, 1, 8, 14, 6, 1, 8, 14, 6, 1)])
    same = frames(spark, sf).withColumn("numbers", kinds).withColumn("positions", F.slice("positions", 1, 10)).withColumn("forces", F.slice("forces", 1, 10))
    deepmd.write_deepmd(same, path)
    back = profile.atom_rows(registry.read_frames(spark, path))
    return tidy(back.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("fz").alias("fz")), 4)


def committed(spark, sf):
    from ..registry import run

    path = _folder(spark, "result")
    results.commit(run("knn", [embeddings(spark, sf)], {"k": 5}), path, {"analysis": "knn"})
    return tidy(results.load(spark, path).tables["scores"])


def exported(spark, sf):
    path = _folder(spark, "selection")
    chosen = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("frame_index"), "o_totalprice")
    results.export_selection(chosen, None, path, "csv")
    back = spark.read.option("header", True).schema("frame_index bigint, o_totalprice double").csv(path)
    return tidy(back.agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


def report(spark, sf):
    run = sampling.sample(embeddings(spark, sf), "fps", {"n_samples": 10, "scaling": "raw", "initialization": "first"})
    return results.sampling_report(run, {"n_samples": 10}, spark)


# --- streams -----------------------------------------------------------------


def stream_profile(spark, sf):
    return tidy(series.drain(series.running_profile(series.follow(spark, sf, "events.parquet"), "event_type", "value"), "complete"))


def stream_histogram(spark, sf):
    return series.drain(series.running_histogram(series.follow(spark, sf, "events.parquet"), "value", 0.5), "complete")


def stream_first_seen(spark, sf):
    return series.drain(series.first_seen(series.follow(spark, sf, "documents.parquet"), "text")).agg(F.count(F.lit(1)).alias("distinct_texts"))


def stream_steps(spark, sf):
    live = series.live_steps(series.follow(spark, sf, "events.parquet"), "user_id", "event_id", ["value"])
    return tidy(live.select("i", "step"))


def keyed_steps(spark, sf):
    live = series.drain(series.keyed_steps(series.follow(spark, sf, "events.parquet"), "user_id", "event_id", ["value"], "ts"))
    return tidy(live.select("i", "step"))


def stream_copies(spark, sf):
    return series.drain(series.repeated(series.follow(spark, sf, "events.parquet"), "props", "event_id", "ts")).select("i", "first")


# --- expansion ---------------------------------------------------------------


def novelty(spark, sf):
    df = embeddings(spark, sf)
    archive = scoring.Archive.of(reference_side(df))
    return tidy(archive.nearest(query_side(df)))


def duplicates(spark, sf):
    df = embeddings(spark, sf)
    archive = scoring.Archive.of(reference_side(df))
    scored = archive.nearest(query_side(df)).select("i", F.col("distance").alias("fitness"), F.col("distance").alias("novelty"))
    return scoring.reject_duplicates(scored, 9.0).agg(F.count_if(F.col("fitness") == float("-inf")).alias("rejected"), F.count(F.lit(1)).alias("n"))


def coverage_gain(spark, sf):
    df = embeddings(spark, sf)
    archive = scoring.Archive.of(reference_side(df))
    return tidy(scoring.coverage_gain(archive, archive.scaled(query_side(df))))


def coverage_radius(spark, sf):
    df = embeddings(spark, sf)
    archive = scoring.Archive.of(reference_side(df))
    later = archive.with_accepted(archive.scaled(query_side(df)).select("i", "features"))
    return tidy(spark.createDataFrame([(later.coverage_radius(),)], "radius double"))


def local_novelty(spark, sf):
    """Embeddings as atoms of their label's structure."""
    df = embeddings(spark, sf)
    atoms = query_side(df).select(F.col("label").cast("bigint").alias("i"), F.col("i").cast("int").alias("row"), "features")
    archive = scoring.Archive.of(reference_side(df))
    whole = profile.pooled(atoms.select(F.col("i").alias("frame"), "features")).withColumnRenamed("frame", "i")
    spec = scoring.check_objective({"type": "composite", "aggregation": "mean", "novelty_threshold": 9.5})
    return tidy(scoring.score(spec, whole, atoms, archive, archive).select("i", "fitness", "local", "novel"))


def _small_run(spark, sf, optimizer, objective):
    base = frames(spark, sf).where(F.abs(F.col("cell")[0][0]) > 0).withColumnRenamed("frame_index", "i")
    settings = search.Settings(optimizer=optimizer, objective=objective, operators={"atomic_displacement": {}, "cell_shear": {}}, children_per_seed=1, batch_accept=8)
    found = search.run(base, base, radial_histogram(4.0, 8), settings, search.Budget(max_generations=2), mutations.Rules(min_distance_mode="none"))
    return tidy(spark.createDataFrame(
        [(r.generation, r.proposed, r.invalid, r.evaluations, r.accepted, float(r.best_fitness), r.unique_novel_environments) for r in found.rounds],
        "generation int, proposed bigint, invalid bigint, evaluations bigint, accepted bigint, best double, novel bigint"))


def random_run(spark, sf):
    return _small_run(spark, sf, "random", {"type": "novelty"})


def genetic_run(spark, sf):
    return _small_run(spark, sf, "genetic", {"type": "local_environment_novelty", "novelty_threshold": 2.0})


def swarm_run(spark, sf):
    return _small_run(spark, sf, "pso", {"type": "novelty"})


SWARM_DRAWS = ("u_reset", "u_best", "u_leader", "u_change", "u_anchor", "u_seed", "u_operator")


def swarm_state(spark, sf):
    """Ten particles after two rounds of given children, and where their next children start."""
    rows = embeddings(spark, sf).select(F.col("label").cast("bigint").alias("slot"), "i", F.col("features")[0].alias("fitness"), F.col("features").alias("at"))
    state = swarm.newborn(spark, 10)
    for rest in (0, 1):
        state = swarm.advanced(state, rows.where(F.col("i") % 3 == rest))
    cells = state.select("slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("child"))
    draws = cells.select("slot", "child", *[((F.col("slot") * 37 + F.col("child") * 11 + 29 * k) % 101 / 101).alias(name) for k, name in enumerate(SWARM_DRAWS)])
    anchor = rows.where("i = 2").select(F.col("i").alias("anchor"), F.col("at").alias("anchor_at"))
    toward = swarm.targets(state, draws, swarm.Pulls(change=15.0), 0.1, anchor)
    return tidy(toward.join(state, "slot").select("slot", "child", "parent", "position", "best", "best_z"))


def parent_pool(spark, sf):
    """Sixteen parents kept of the embeddings: those of labels below five were there, the others arrive."""
    rows = embeddings(spark, sf)
    nothing = [F.lit(None).cast("array<double>").alias(name) for name in ("genes", "shares")]
    there, arrived = rows.where("label < 5"), rows.where("label >= 5")
    pool = positions(there, "i").select(F.col("pos").alias("rank"), "i", F.col("features").alias("at"), *nothing)
    accepted = positions(arrived, "i").select(F.col("pos").alias("place"), "i", F.col("features").alias("at"), *nothing)
    return tidy(breeding.renewed(pool, accepted, 16).select("rank", "i"))


def bred_children(spark, sf):
    """A child per embedding, whose first values are its noise; a label's first row is a parent, its last one a seed."""
    rows = embeddings(spark, sf)
    ends = rows.groupBy(F.col("label").cast("bigint").alias("rank")).agg(F.min("i").alias("i"), F.max("i").alias("seed"))
    pool = ends.select("rank", "i", F.lit(None).cast("array<double>").alias("at"), F.array(F.lit(0.15) + F.col("rank") / 100, F.lit(0.05), F.lit(0.05)).alias("genes"),
                       F.array(F.lit(1.0), F.lit(0.5)).alias("shares"))
    part = lambda k: ((F.col("i") * 31 + 17 * k) % 97 + 0.5) / 97
    draws = rows.select("i", F.floor(F.col("i") / 8).alias("slot"), (F.col("i") * 7919 % 10007 / 10007).alias("u_parent"), F.slice("features", 1, 5).alias("normals"), F.array(part(0), part(1)).alias("u_order"))
    size, how = ends.count(), breeding.Breeding()
    fresh = breeding.immigrant_slots(-(-rows.count() // 8), size, 0.15, how.warm_pool)
    made = breeding.children(draws, pool, ends.select(F.col("rank").alias("place"), "seed"), {"atomic_displacement": {}, "cell_shear": {"max_shear": 0.1}},
                             breeding.rank_weights(size, how).tolist(), [1.0] * size, fresh, how, {"cell_shear": 1.5})
    return tidy(made.select("i", "parent", "operator", F.col("genes")[0].alias("sigma"), F.col("genes")[2].alias("shear"), F.col("shares")[1].alias("share")))


def success(spark, sf):
    """Events as changes, accepted where their value is above one."""
    rows = spark.read.parquet(f"{sf}/events.parquet")
    return tidy(breeding.success_factors(rows.groupBy(F.col("event_type").alias("operator")).agg(F.count(F.lit(1)).alias("proposed"), F.count_if(F.col("value") > 1).alias("accepted"))))


def grown_dataset(spark, sf):
    """The frames, and after them those of more than eleven atoms once more, written and read back."""
    base = frames(spark, sf)
    more = base.where(F.size("numbers") > 11).withColumnRenamed("frame_index", "i")
    found = aftercare.add_to_dataset(spark, base, more, _folder(spark, "grown"))
    return found.select(F.col("frame_index").cast("bigint").alias("frame_index"), F.size("numbers").cast("bigint").alias("atoms"))


def proposals(spark, sf):
    """One proposal of every kind per frame, with the rule it breaks."""
    base = frames(spark, sf).withColumnRenamed("frame_index", "i")
    names = F.array(*[F.lit(n) for n in sorted(mutations.CHANGES)])
    plan = base.select(F.col("i").alias("parent"), F.posexplode(names).alias("k", "operator")).select((F.col("parent") * 8 + F.col("k")).alias("i"), "parent", "operator")
    made = mutations.propose(plan, base, {}, mutations.Rules(min_distance_mode="none", composition_locked=False), 42)
    return made.groupBy("operator").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reason").isNull()).alias("valid"))


def space_map(spark, sf):
    df = embeddings(spark, sf)
    return tidy(visual_plane(df.select("i", "features")).select("i", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")))


def composition_archive(spark, sf):
    from ...functions.descriptors import compute

    rows = compute(frames(spark, sf), composition_vector((1, 6, 8, 14)))
    counts = rows.groupBy("features").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("largest"))


def values_window(spark, sf):
    """A row window of one vector column: filter and columns reach the scan."""
    rows = table(spark, sf, "embeddings").where((F.col("vec_id") >= 100) & (F.col("vec_id") < 300)).select("vec_id", F.col("embedding")[3].cast("double").alias("x"))
    return tidy(rows)


def _atom_samples(spark, sf):
    rows = profile.atom_rows(frames(spark, sf))
    return rows.select((F.col("frame_index") * 64 + F.col("row")).alias("i"), "element", F.array("x", "y", "z", "fx", "fy", "fz").alias("features"))


def diversity(spark, sf):
    return tidy(local_diversity.scores(_atom_samples(spark, sf)))


def diversity_summary(spark, sf):
    found = local_diversity.scores(_atom_samples(spark, sf)).persist()
    around = contacts.coordination(frames(spark, sf), 3.0).select("element", F.col("coordination").cast("double").alias("coordination"))
    return tidy(local_diversity.summary(found, around))


def diversity_clusters(spark, sf):
    return local_diversity.clusters(_atom_samples(spark, sf)).groupBy("element").agg(F.countDistinct("cluster").alias("clusters"), F.count(F.lit(1)).alias("n"))


QUERIES = {
    "src9_values_window": values_window, "alg11_local_diversity": diversity, "alg11_diversity_summary": diversity_summary, "alg11_diversity_clusters": diversity_clusters,
    "flt1_view_slice": view_slice, "flt3_first_mentions": first_mentions, "flt7_bounded_subset": bounded, "flt8_element_rows": element_rows,
    "flt9_finite_targets": finite_targets, "flt11_catalog_filter": catalog_filter, "flt12_json_membership": json_membership, "join1_runs_datasets": runs_with_datasets,
    "join2_latest_active": latest_active, "join5_decorated": decorated, "join13_unmatched": unmatched, "set1_union_elements": union_elements, "set3_stacked": stacked,
    "set4_seed_pool": seed_pool, "set5_distinct_frames": distinct_frames, "set6_split": split_counts, "top5_page": page, "top8_elite": elite, "agg24_queue": queue,
    "win11_trailing": trailing, "win12_stagnation": stagnant, "agg16_text_copies": text_copies, "cat7_latest_settings": latest_settings, "cat2_cascade": removed,
    "src13_chunk": chunk, "src14_heatmap": heatmap, "prj3_preview": preview, "fn14_text_digest": text_digest, "src11_table_digest": table_digest,
    "snk1_extxyz_round_trip": text_round_trip, "snk2_array_round_trip": array_round_trip, "snk6_committed_result": committed, "snk3_exported_csv": exported,
    "snk4_sampling_report": report, "str1_stream_profile": stream_profile, "str2_stream_histogram": stream_histogram, "str3_stream_first_seen": stream_first_seen,
    "str4_stream_steps": stream_steps, "str4_keyed_steps": keyed_steps, "str3_stream_copies": stream_copies, "gen8_novelty": novelty, "gen13_duplicates": duplicates, "gen11_coverage_gain": coverage_gain, "gen12_coverage_radius": coverage_radius,
    "gen9_local_novelty": local_novelty, "gen18_random_run": random_run, "gen19_genetic_run": genetic_run, "gen20_swarm_run": swarm_run, "gen20_swarm_state": swarm_state,
    "gen30_parent_pool": parent_pool, "gen19_children": bred_children, "gen31_success_factors": success, "gen34_grown_dataset": grown_dataset, "gen3_proposals": proposals,
    "gen26_space_map": space_map, "gen28_composition_kinds": composition_archive,
}

L2 = "list_distance(a.v, b.v)"
PAIR = f"{RAW}, {standardized('e', 'r', 'label < 5')}, {standardized('e', 'q', 'label >= 5', 'label < 5')}"
_DIVERSE = f"""{BASE}, s0 AS (SELECT frame_index * 64 + row AS i, element, unnest([x, y, z, fx, fy, fz]) AS x, unnest(range(0, 6)) AS f FROM atoms), sm AS (SELECT f, avg(x) AS m, stddev_pop(x) AS s FROM s0 GROUP BY f),
 sz AS (SELECT i, element, list((x - m) / s ORDER BY f) AS v FROM s0 JOIN sm USING (f) GROUP BY 1, 2), nn AS (SELECT a.i, a.element, {L2} AS d, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM sz a JOIN sz b ON a.element = b.element AND a.i <> b.i),
 sc AS (SELECT i, element, avg(d) AS score FROM nn WHERE n <= 10 GROUP BY 1, 2), qq AS (SELECT element, quantile_cont(score, 0.9) AS q90, quantile_cont(score, 0.99) AS q99 FROM sc GROUP BY 1),
 ct AS (SELECT i, element, score, CASE WHEN score <= q90 THEN 0 WHEN score <= q99 THEN 1 ELSE 2 END AS category FROM sc JOIN qq USING (element))"""
SQL = {
    "src9_values_window": "SELECT vec_id, round(embedding[4]::DOUBLE, 6) + 0.0 AS x FROM embeddings WHERE vec_id >= 100 AND vec_id < 300",
    "alg11_local_diversity": f"WITH {_DIVERSE} SELECT i, element, round(score, 6) AS score, category FROM ct",
    "alg11_diversity_clusters": f"WITH {BASE} SELECT element, 6::BIGINT AS clusters, count(*) AS n FROM atoms GROUP BY 1",
    "flt1_view_slice": "SELECT l_orderkey AS frame, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "flt3_first_mentions": "SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem GROUP BY 1",
    "flt7_bounded_subset": """WITH p AS (SELECT o_orderkey AS i, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
 k AS (SELECT CASE WHEN k = 999 THEN n - 1 ELSE trunc(k * ((n - 1)::DOUBLE / 999))::BIGINT END AS pos FROM (SELECT max(n) AS n FROM p), range(0, 1000) t(k)) SELECT i FROM p WHERE pos IN (SELECT pos FROM k)""",
    "flt8_element_rows": "SELECT count(*) AS n, round(avg(embedding[1]::DOUBLE), 8) AS mean FROM embeddings WHERE label = 3",
    "flt9_finite_targets": "SELECT count(*) AS n FROM lineitem WHERE l_tax > 0",
    "flt11_catalog_filter": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200",
    "flt12_json_membership": "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1",
    "join1_runs_datasets": "SELECT o_orderkey, c_name, round(o_totalprice, 6) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
    "join2_latest_active": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('P', 'O') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1",
    "join5_decorated": "SELECT c_custkey, round(max(o_totalprice), 6) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 5000 GROUP BY 1",
    "join13_unmatched": "SELECT count(*) AS n, count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE d.doc_id IS NULL) AS orphans FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id",
    "set1_union_elements": f"WITH {BASE} SELECT DISTINCT element AS z FROM atoms",
    "set3_stacked": "SELECT (label >= 5)::INTEGER AS source, count(*) AS n FROM embeddings GROUP BY 1",
    "set4_seed_pool": """WITH n AS (SELECT count(*) AS n FROM embeddings), k AS (SELECT DISTINCT CASE WHEN k = 199 THEN n - 1 ELSE trunc(k * ((n - 1)::DOUBLE / 199))::BIGINT END AS f FROM n, range(0, 200) t(k)),
 a AS (SELECT vec_id AS f FROM embeddings WHERE label = 4) SELECT f AS frame_index, true AS anchor FROM a UNION ALL SELECT f, false FROM k WHERE f NOT IN (SELECT f FROM a)""",
    "set5_distinct_frames": "SELECT count(DISTINCT l_orderkey) AS frames FROM lineitem",
    "set6_split": "WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'train' AS part, round(n * 0.8)::BIGINT AS n FROM n UNION ALL SELECT 'validation', round(n * 0.1)::BIGINT FROM n UNION ALL SELECT 'test', (n - round(n * 0.8) - round(n * 0.1))::BIGINT FROM n",
    "top5_page": "SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 40 OFFSET 120",
    "top8_elite": "SELECT o_orderkey AS i, floor(o_totalprice / 10000) AS fitness FROM orders ORDER BY fitness DESC, i DESC LIMIT 100",
    "agg24_queue": "SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS position FROM orders",
    "win11_trailing": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS trailing FROM orders",
    "win12_stagnation": """WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER w AS n, coalesce(o_totalprice > max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1e-9, true) AS up FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
 SELECT o_orderkey, n - max(CASE WHEN up THEN n END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stagnant FROM m""",
    "agg16_text_copies": "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1",
    "cat7_latest_settings": "SELECT user_id AS key, round(arg_max(value, event_id), 6) + 0.0 AS value, max(event_id) AS written FROM events GROUP BY 1",
    "cat2_cascade": "SELECT count(*) AS left FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')".replace("AS left", 'AS "left"'),
    "src13_chunk": f"WITH {RAW} SELECT i, round(v[6] + v[7] + v[8], 6) + 0.0 AS total, 3::BIGINT AS n FROM e WHERE i >= 10 AND i < 60",
    "src14_heatmap": f"WITH {BASE} SELECT row, round(x, 6) AS x, round(z, 6) AS z FROM atoms WHERE frame_index = 7",
    "prj3_preview": """WITH p AS (SELECT o_orderkey AS i, o_totalprice, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
 k AS (SELECT CASE WHEN k = 2999 THEN n - 1 ELSE trunc(k * ((n - 1)::DOUBLE / 2999))::BIGINT END AS pos FROM (SELECT max(n) AS n FROM p), range(0, 3000) t(k)) SELECT i, round(o_totalprice, 6) AS o_totalprice, o_orderstatus FROM p WHERE n <= 3000 OR pos IN (SELECT pos FROM k)""",
    "fn14_text_digest": "SELECT doc_id, sha256(text) AS digest FROM documents",
    "snk1_extxyz_round_trip": f"WITH {BASE} SELECT frame_index, count(*) AS n, round(sum(round(x, 8)), 5) + 0.0 AS x, round(sum(round(fx, 8)), 5) + 0.0 AS fx FROM atoms GROUP BY 1",
    "snk2_array_round_trip": f"WITH {BASE} SELECT row, count(*) AS n, round(sum(x), 4) + 0.0 AS x, round(sum(fz), 4) + 0.0 AS fz FROM atoms WHERE row < 10 GROUP BY 1",
    "snk6_committed_result": f"""WITH {RAW}, {standardized('e', 'z')}, d AS (SELECT a.i, b.i AS j, {L2} AS d, row_number() OVER (PARTITION BY a.i ORDER BY {L2}, b.i) AS n FROM z a JOIN z b ON a.i <> b.i),
 s AS (SELECT i, avg(d) AS score FROM d WHERE n <= 5 GROUP BY i) SELECT i, round(score, 6) AS score, (score > (SELECT quantile_cont(score, 0.99) FROM s))::INTEGER AS label FROM s""",
    "snk3_exported_csv": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'P'",
    "str1_stream_profile": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY 1",
    "str2_stream_histogram": "SELECT floor(value / 0.5)::BIGINT AS slot, count(*) AS n FROM events GROUP BY 1",
    "str3_stream_first_seen": "SELECT count(DISTINCT text) AS distinct_texts FROM documents",
    "str4_stream_steps": "SELECT event_id AS i, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)), 0), 6) + 0.0 AS step FROM events",
    "str4_keyed_steps": "SELECT event_id AS i, round(coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id)), 0), 6) + 0.0 AS step FROM events",
    "str3_stream_copies": "SELECT * FROM (SELECT event_id AS i, min(event_id) OVER (PARTITION BY props) AS first FROM events) WHERE i <> first",
    "gen20_swarm_state": f"""WITH {RAW}, z AS (SELECT label AS slot, i, v, i % 3 AS rest, (v[1] - avg(v[1]) OVER (PARTITION BY i % 3)) / stddev_pop(v[1]) OVER (PARTITION BY i % 3) AS z FROM e),
 top AS (SELECT * FROM z WHERE rest < 2 QUALIFY row_number() OVER (PARTITION BY rest, slot ORDER BY z DESC, i) = 1),
 s AS (SELECT p.slot, coalesce(b.i, a.i) AS position, coalesce(b.v, a.v) AS pv, CASE WHEN a.z IS NULL OR b.z > a.z THEN b.i ELSE a.i END AS best,
  CASE WHEN a.z IS NULL OR b.z > a.z THEN b.v ELSE a.v END AS bv, CASE WHEN a.z IS NULL OR b.z > a.z THEN b.z ELSE a.z END AS best_z
  FROM range(10) p(slot) LEFT JOIN top a ON a.slot = p.slot AND a.rest = 0 LEFT JOIN top b ON b.slot = p.slot AND b.rest = 1),
 l AS (SELECT best AS leader, bv AS lv FROM s WHERE best_z IS NOT NULL ORDER BY best_z DESC, slot LIMIT 1), an AS (SELECT v AS av FROM e WHERE i = 2),
 c AS (SELECT *, list_transform(range(0, 7), lambda k: ((slot * 37 + child * 11 + 29 * k) % 101) / 101) AS u FROM s, range(8) g(child), l, an),
 d AS (SELECT *, u[2] * 1.0 * coalesce(list_distance(pv, bv), 0) AS db, u[3] * 1.5 * coalesce(list_distance(pv, lv), 0) AS dl, u[4] * 15.0 AS dc, u[5] * coalesce(list_distance(pv, av), 0) AS da FROM c)
 SELECT slot, child, CASE WHEN best IS NULL OR u[1] < 0.1 THEN NULL WHEN da >= greatest(db, dl, dc) THEN 2 WHEN dl >= greatest(db, dc) THEN leader WHEN db >= dc THEN best ELSE position END AS parent,
 position, best, round(best_z, 6) + 0.0 AS best_z FROM d""",
    "gen30_parent_pool": f"""WITH RECURSIVE {RAW}, m AS (SELECT list(x ORDER BY f) AS c FROM (SELECT f, avg(x) AS x FROM (SELECT unnest(v) AS x, unnest(range(0, 64)) AS f FROM e) GROUP BY f)),
 s AS (SELECT i FROM e, m ORDER BY list_distance(v, c), label >= 5, i LIMIT 1), p AS (SELECT 0 AS rank, i, [i] AS seen FROM s
 UNION ALL SELECT p.rank + 1, n.i, list_append(p.seen, n.i) FROM p, LATERAL (
   SELECT a.i, min(list_distance(a.v, b.v)) AS d FROM e a, e b WHERE list_contains(p.seen, b.i) AND NOT list_contains(p.seen, a.i)
   GROUP BY a.i, a.label ORDER BY d DESC, a.label >= 5, a.i LIMIT 1) n WHERE p.rank < 15) SELECT rank::BIGINT AS rank, i FROM p""",
    "gen19_children": f"""WITH {RAW}, g AS (SELECT label AS rank, min(i) AS parent, max(i) AS seed, 0.15::DOUBLE + label / 100 AS sigma FROM e GROUP BY 1), z AS (SELECT count(*) AS m, round_even(0.7 * count(*), 0)::BIGINT AS k FROM g),
 w AS (SELECT rank, parent, sigma, sum((k - rank) * (k - rank)) OVER (ORDER BY rank) AS upto, sum((k - rank) * (k - rank)) OVER () AS total FROM g, z WHERE rank < k),
 d AS (SELECT i, v, (i * 7919 % 10007) / 10007::DOUBLE AS u, i // 8 < (SELECT round_even(0.15 * ceil(count(*) / 8), 0) FROM e) AS fresh, ((i * 31) % 97 + 0.5::DOUBLE) / 97 AS o0, ((i * 31 + 17) % 97 + 0.5::DOUBLE) / 97 AS o1 FROM e),
 q AS (SELECT d.i, min(w.rank) AS rank FROM d JOIN w ON w.upto > d.u * w.total WHERE NOT fresh GROUP BY 1),
 c AS (SELECT d.i, g.seed AS parent, o0, o1, 0.15::DOUBLE AS sigma, 0.1::DOUBLE AS shear, 1.0::DOUBLE AS s0, 1.0::DOUBLE AS s1 FROM d, z, g WHERE fresh AND g.rank = floor(u * m)
  UNION ALL SELECT d.i, g.parent, o0, o1, greatest(0.01, least(5.0, g.sigma * (1 + 0.3 * v[1]))), greatest(0.005, least(0.5, 0.05 * (1 + 0.3 * v[3]))),
   greatest(0.05, least(1.0, 1 + 0.3 * v[4])), greatest(0.05, least(1.0, 0.5 * (1 + 0.3 * v[5]))) FROM d JOIN q USING (i) JOIN g USING (rank))
 SELECT i, parent, CASE WHEN -ln(o0) / s0 < -ln(o1) / (s1 * 1.5) THEN 'atomic_displacement' ELSE 'cell_shear' END AS operator, round(sigma, 6) + 0.0 AS sigma, round(shear, 6) + 0.0 AS shear, round(s1, 6) + 0.0 AS share FROM c""",
    "gen34_grown_dataset": f"""WITH {BASE}, u AS (SELECT frame_index, n, 0 AS later FROM fr UNION ALL SELECT frame_index, n, 1 FROM fr WHERE n > 11)
 SELECT CASE WHEN later = 0 THEN frame_index ELSE (SELECT max(frame_index) FROM fr) + row_number() OVER (PARTITION BY later ORDER BY frame_index) END AS frame_index, n::BIGINT AS atoms FROM u""",
    "gen31_success_factors": """WITH t AS (SELECT event_type AS operator, count(*) FILTER (WHERE value > 1) / count(*) AS rate FROM events GROUP BY 1)
 SELECT operator, round(CASE WHEN avg(rate) OVER () = 0 THEN 1 ELSE greatest(0.5, least(2.0, 0.55 + 0.45 * rate / avg(rate) OVER ())) END, 6) + 0.0 AS factor FROM t""",
    "gen8_novelty": f"WITH {PAIR} SELECT a.i, round(min({L2}), 6) AS distance FROM q a, r b GROUP BY a.i",
    "gen13_duplicates": f"WITH {PAIR}, d AS (SELECT a.i, min({L2}) AS d FROM q a, r b GROUP BY a.i) SELECT count(*) FILTER (WHERE d < 9.0) AS rejected, count(*) AS n FROM d",
    "gen11_coverage_gain": f"WITH {PAIR} SELECT a.i, round(-max({L2}), 6) AS gain FROM q a, r b GROUP BY a.i",
    "gen12_coverage_radius": f"WITH {PAIR}, d AS (SELECT b.i, min({L2}) AS d FROM q a, r b GROUP BY b.i) SELECT round(max(d), 6) AS radius FROM d",
    "gen9_local_novelty": f"""WITH {PAIR}, d AS (SELECT a.i, a.label, min({L2}) AS d FROM q a, r b GROUP BY 1, 2), l AS (SELECT label, avg(d) AS local, count(*) FILTER (WHERE d > 9.5) AS novel FROM d GROUP BY label),
 u AS (SELECT label, unnest(v) AS x, unnest(range(0, 64)) AS f FROM q), m AS (SELECT label, f, avg(x) AS x FROM u GROUP BY 1, 2), w AS (SELECT label, list(x ORDER BY f) AS v FROM m GROUP BY 1),
 s AS (SELECT a.label, min({L2}) AS d FROM w a, r b GROUP BY 1) SELECT l.label::BIGINT AS i, round(0.3 * s.d + 0.7 * local, 6) AS fitness, round(local, 6) AS local, novel FROM l JOIN s USING (label)""",
    "gen28_composition_kinds": f"WITH {BASE}, c AS (SELECT frame_index, list(c ORDER BY s) AS k, list(s ORDER BY s) AS s, sum(c) AS n FROM ec GROUP BY 1), g AS (SELECT list_transform(k, lambda x: x / n) AS k, s, count(*) AS n FROM c GROUP BY 1, 2) SELECT count(*) AS kinds, max(n) AS largest FROM g",
}
