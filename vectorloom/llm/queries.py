"""The registered queries of the document operators, and their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ctw, iblt, licenses, merkle, mixing, packing, quality, search, secrets, sharding, simhash, toxicity, wordpieces
from .common import documents


def op1_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.scored(documents(spark, sf_dir))


def op2_paragraph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprinted(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir)).drop("h1", "h2")


def op5_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpieces.token_counts(documents(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(documents(spark, sf_dir))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {query.__name__: query for query in (
    op1_context_tree_scores, op2_paragraph_fingerprints, op3_secret_scan, op4_quality_rules, op5_jump_sharding,
    op6_source_mix, op7_toxicity, op8_simhash_near_dedup, op9_best_fit_packing, op10_token_counts,
    op11_merkle_manifest, op12_license_scan, op13_lexical_search,
)}

# crc32 of a decimal number's digits, a bit at a time.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _record(text: str) -> str:
    """SQL for the digest of a row's fields, with that expression as its text."""
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _beside(nodes: str, group: str) -> str:
    """SQL for the digests before and after each node of a table of levels."""
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in group.split(", ") if c)
    return f"""SELECT {group + "," if group else ""} a.lvl, a.pos,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS before,
        coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS after
        FROM {nodes} a JOIN {nodes} b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 {"AND " + same if same else ""}
        WHERE a.n > 1 GROUP BY ALL""".replace("SELECT source", "SELECT a.source")


_MERKLE = f"""
WITH RECURSIVE told AS (
    SELECT doc_id, source, {_record("text")} AS leaf,
        CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN {_record("replace(text, chr(10), '')")} END AS tampered
    FROM documents),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM told),
nodes AS (
    SELECT 0 AS lvl, source, pos, n, leaf AS h FROM leaves
    UNION ALL
    SELECT lvl + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lvl, source, pos // 3, n),
subroots AS (
    SELECT source, lvl, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS lvl, pos, n, h FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lvl, pos // 3, n),
beside AS ({_beside("nodes", "source")}),
above AS ({_beside("tops", "")}),
walk AS (
    SELECT doc_id, source, leaf, 0 AS lvl, pos, coalesce(tampered, leaf) AS node, '' AS proof FROM leaves
    UNION ALL
    SELECT w.doc_id, w.source, w.leaf, w.lvl + 1, w.pos // 3, sha256(s.before || w.node || s.after), w.proof || s.before || s.after
    FROM walk w JOIN beside s ON w.source IS NOT DISTINCT FROM s.source AND w.lvl = s.lvl AND w.pos = s.pos),
climb AS (
    SELECT w.doc_id, w.leaf, r.h AS subroot, 0 AS lvl, r.pos, w.node, w.proof
    FROM walk w JOIN subroots r ON w.source IS NOT DISTINCT FROM r.source AND w.lvl = r.lvl
    UNION ALL
    SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.pos // 3, sha256(s.before || c.node || s.after), c.proof || s.before || s.after
    FROM climb c JOIN above s ON c.lvl = s.lvl AND c.pos = s.pos)
SELECT c.doc_id, c.leaf, c.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root, c.node = t.h AS verified
FROM climb c JOIN tops t ON t.n = 1 AND c.lvl = t.lvl
"""

# Only A-Z are lowered, as translate does; the classes name what parts terms.
_TERMS = r"""regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

_SEARCH = f"""
WITH said AS (SELECT row_number() OVER () AS r, doc_id, unnest({_TERMS.format("text")}) AS term FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT r, count(*) AS n FROM said GROUP BY r),
facts AS (SELECT count(*) AS documents, sum(n)::BIGINT AS length FROM sizes),
counts AS (SELECT r, doc_id, term, count(*) AS tf FROM said GROUP BY ALL),
holding AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, facts GROUP BY term),
asked AS (SELECT item, item_id, term, count(*) AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY ALL),
scored AS (
    SELECT item, item_id, c.r, c.doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * documents) // length))))::BIGINT AS score
    FROM asked JOIN counts c USING (term) JOIN holding USING (term) JOIN sizes s ON c.r = s.r, facts GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM placed WHERE place <= 20
"""

SQL: dict[str, str] = {"op11_merkle_manifest": _MERKLE, "op13_lexical_search": _SEARCH}
