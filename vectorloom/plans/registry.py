"""Analyses by name: category, aliases, defaults and the plan they build."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..operators import clusters, correlation, crossset, diagnostics, environments, feature_stats, information, local_diversity, neighbors, outliers, sampling, spectrum, trajectory
from ..operators import preprocess
from .results import AnalysisResult

CATEGORIES = ("engine", "pair", "cluster", "outlier", "sampling", "sensitivity", "perturbation", "diagnostics", "wrapper")

# Other names for the same analysis.
ALIASES = {
    "hierarchical": "agglomerative", "iforest": "isolation_forest", "isolation-forest": "isolation_forest", "farthest_point": "fps",
    "k-nearest-neighbor": "knn", "mahalanobis_distance": "mahalanobis", "element": "per_element",
    "spectral_effective_dimension": "effective_dimension",
}


# Requests by category, and what they run where no algorithm is named.
WRAPPERS = {
    "cluster": ("cluster", "kmeans"), "cluster_analysis": ("cluster", "kmeans"), "outlier": ("outlier", "lof"), "outlier_analysis": ("outlier", "lof"),
    "sampling": ("sampling", "fps"), "sampling_analysis": ("sampling", "fps"),
}


@dataclass(frozen=True)
class Analysis:
    name: str
    category: str
    build: Callable
    inputs: int = 1
    defaults: tuple = ()


_REGISTRY: dict[str, Analysis] = {}


def register(analysis: Analysis) -> None:
    if analysis.category not in CATEGORIES:
        raise invalid(f"unknown category {analysis.category!r}")
    if analysis.name in _REGISTRY or analysis.name in ALIASES:
        raise invalid(f"{analysis.name!r} is already registered")
    _REGISTRY[analysis.name] = analysis


def canonical(name: str, params: dict | None = None) -> tuple[str, dict]:
    """The concrete analysis a request means."""
    params = dict(params or {})
    if name in WRAPPERS:
        category, default = WRAPPERS[name]
        name = str(params.pop("algorithm", default))
        # Under sampling, a cluster request is for representatives.
        name = "cluster_representative" if category == "sampling" and name == "cluster" else ALIASES.get(name, name)
        if name in _REGISTRY and _REGISTRY[name].category != category:
            raise invalid(f"{name!r} is no {category} analysis")
    name = ALIASES.get(name, name)
    if name not in _REGISTRY:
        raise invalid(f"unknown analysis {name!r}")
    if name == "per_element":
        params["mode"] = "atom"
    return name, params


def run(name: str, inputs: list[DataFrame], params: dict | None = None, **extra) -> AnalysisResult:
    """Builds the named analysis over rows of ``i, features`` (and what it needs)."""
    name, params = canonical(name, params)
    entry = _REGISTRY[name]
    if len(inputs) != entry.inputs:
        raise invalid(f"{name} takes {entry.inputs} input(s)", given=len(inputs))
    return entry.build(*inputs, {**dict(entry.defaults), **params}, **extra)


def names() -> list[str]:
    return sorted(_REGISTRY)


def _one(table: str, build: Callable) -> Callable:
    return lambda df, params: AnalysisResult({table: build(df, params)})


def _summary(build: Callable) -> Callable:
    def wrapped(*args, **kwargs):
        found = build(*args, **kwargs)
        tables = {k: v for k, v in found.items() if isinstance(v, DataFrame)}
        return AnalysisResult(tables, {k: v for k, v in found.items() if isinstance(v, (int, float, str, dict, list)) or v is None})
    return wrapped


def _pca(df, params):
    p = spectrum.pca(df, params)
    return AnalysisResult({"coords": p.table.select("i", "coords")}, {"explained_variance": p.explained.tolist()})


def _spectrum(df, params):
    found = spectrum.effective_dimension(df, params)
    return AnalysisResult({}, {k: v.tolist() if hasattr(v, "tolist") else v for k, v in found.items()})


def _kernel(df, params):
    found = spectrum.kernel_spectrum(df, params)
    params = {"max_samples": spectrum.KERNEL_SUBSET, **params}
    return AnalysisResult({"kernel_matrix": spectrum.kernel_rows(df, params)}, {k: v.tolist() if hasattr(v, "tolist") else v for k, v in found.items()})


def _neighbors(df, params):
    scaled = preprocess.fit(df, params.get("preprocess", "raw")).apply(df)
    return AnalysisResult({"neighbors": neighbors.self_nearest(scaled, int(params.get("k", 10)), params.get("metric", "euclidean"))})


def _similarity(df, params):
    scaled = preprocess.fit(df, params.get("preprocess", "raw")).apply(df)
    return AnalysisResult({"similar": neighbors.similar_to(scaled, int(params.get("query_index") or 0), int(params.get("k", 10)), params.get("metric", "cosine"))})


def _trajectory(df, params):
    scaled = preprocess.fit(df, params.get("preprocess", "standardized")).apply(df)
    found = trajectory.trajectory(scaled, params)
    return AnalysisResult({"steps": found["table"].drop("features"), "events": found["events"]}, vars(found["threshold"]))


def _feature_correlation(df, params):
    found = correlation.feature_correlation(df, params)
    pairs = df.sparkSession.createDataFrame(correlation.top_pairs(found, int(params.get("top_k", 50))), "a int, b int, r double")
    extra = correlation.redundancy(found, float(params.get("correlation_threshold", 0.95)))
    return AnalysisResult({"pairs": pairs}, {**extra, "clustered_feature_order": correlation.clustered_order(found)})


def _property_correlation(df, params):
    target = params.get("property", "energy_per_atom")
    rows = correlation.with_target(df, target)
    held = correlation.cross_validated(df, target, params)
    quality = correlation.scores(held)
    per_feature = correlation.property_pearson(rows).join(correlation.property_spearman(rows), "f")
    per_feature = per_feature.join(information.mutual_information(rows), "f", "left")
    best = per_feature.agg(F.max(F.abs("pearson"))).first()[0]
    strength, pattern = correlation.verdict(quality["r2"], best)
    return AnalysisResult({"features": per_feature, "held_out": held, "pairs": correlation.distance_versus_property(df, target, params)},
                          {**quality, "encoding": strength, "pattern": pattern})


def _sampled(algorithm):
    def build(df, params, group=None, existing=None):
        found = sampling.sample(df, algorithm, params, group, existing)
        chosen = df.sparkSession.createDataFrame([(i,) for i in found.ids], "i bigint")
        return AnalysisResult({"selected": chosen}, {"stopped_by": found.stopped_by, "radius_curve": found.radius_curve, "r2_curve": found.r2_curve})
    return build


def _acquire(reference, query, params):
    picks = crossset.acquire(reference, query, params)
    return AnalysisResult({"selected": query.sparkSession.createDataFrame([(n, i, s) for n, (i, s) in enumerate(picks)], "pick int, i bigint, score double")})


def _diversity(df, params):
    scored = local_diversity.scores(df, params)
    return AnalysisResult({"scores": scored, "elements": local_diversity.summary(scored), "clusters": local_diversity.clusters(df, params)})


def _responses(build: Callable) -> Callable:
    """Of frames; ``descriptor`` is given beside them."""
    return lambda frames, params, descriptor: AnalysisResult({"responses": build(frames, descriptor, params)})


def _degeneracy(df, params, shapes, energy=None):
    found = diagnostics.degeneracy_search(df, shapes, energy, params)
    return AnalysisResult({"pairs": found["pairs"], "dangerous": found["dangerous"], "shown": found["shown"]}, found["thresholds"])


def _consistency(df, params, shapes, energy=None):
    return _summary(diagnostics.distance_consistency)(df, shapes, energy, params)


for _entry in (
    Analysis("local_diversity", "engine", _diversity), Analysis("degeneracy_search", "diagnostics", _degeneracy),
    Analysis("distance_consistency", "diagnostics", _consistency),
    *[Analysis(n, c, _responses(fn)) for n, c, fn in (
        ("formal_invariance", "diagnostics", diagnostics.formal_invariance), ("perturbation_sensitivity", "perturbation", diagnostics.perturbation_response),
        ("cutoff_smoothness", "diagnostics", diagnostics.cutoff_smoothness), ("environment_jacobian", "diagnostics", environments.environment_jacobian),
    )],
    Analysis("sensitivity", "sensitivity", lambda p, runs: AnalysisResult({}, {"records": diagnostics.run_sensitivity(runs, p)}), 0),
    Analysis("pca", "engine", _pca, 1, (("preprocess", "center"),)),
    Analysis("kernel", "engine", _kernel), Analysis("effective_dimension", "engine", _spectrum),
    Analysis("two_nn_intrinsic_dimension", "engine", _summary(spectrum.two_nn_dimension)),
    Analysis("neighbors", "engine", _neighbors), Analysis("similarity", "engine", _similarity),
    Analysis("pairwise", "engine", _one("rows", spectrum.pairwise_rows)),
    Analysis("feature_variance", "engine", _one("features", feature_stats.feature_variance)), Analysis("trajectory", "engine", _trajectory),
    Analysis("feature_correlation", "engine", _feature_correlation), Analysis("property_correlation", "engine", _property_correlation),
    Analysis("kmeans", "cluster", lambda df, p: AnalysisResult({"labels": (f := clusters.kmeans(df, p))["labels"]}, {"centers": f["centers"].tolist(), "inertia": f["inertia"]})),
    *[Analysis(n, "cluster", _one("labels", fn)) for n, fn in clusters.ALGORITHMS.items()],
    *[Analysis(n, "outlier", _one("scores", fn)) for n, fn in outliers.ALGORITHMS.items()],
    *[Analysis(n, "sampling", _sampled(n)) for n in ("random", "fps", "stratified", "cluster_representative", "per_element")],
    Analysis("coverage", "pair", _summary(crossset.coverage), 2), Analysis("overlap", "pair", _summary(crossset.overlap), 2),
    Analysis("drift", "pair", _summary(crossset.drift), 2), Analysis("acquisition", "pair", _acquire, 2),
    Analysis("mantel", "pair", _summary(crossset.mantel), 2), Analysis("compare", "pair", _summary(crossset.compare), 2),
    Analysis("information_imbalance", "pair", _summary(crossset.information_imbalance), 2),
):
    register(_entry)
