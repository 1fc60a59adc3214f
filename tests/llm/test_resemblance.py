"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import random
import re

import corpus_pipeline
from vectorloom.llm import components, resemblance

from .conftest import SF


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def least_ids(texts, close=lambda a, b: 5 * len(a & b) >= 4 * len(a | b)):
    """The smallest id of each component of all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(texts)
    for n, a in enumerate(names):
        for b in names[:n]:
            if close(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted({find(k) for k in names})


def edited(words, share, rng):
    return " ".join(rng.choice("abcdefgh") * 9 if rng.random() < share else w for w in words)


def test_copies_with_edited_words_are_one(spark, table):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(100, 300))]
        texts += [" ".join(words), *(edited(words, share, rng) for share in (0.005, 0.01, 0.02, 0.04))]
    stay = corpus_pipeline.without_copies(spark, table(texts), SF).collect()
    assert sorted(r["doc_id"] for r in stay) == least_ids(dict(enumerate(texts)))
    assert len(stay) < 200


def test_stage_is_all_pairs_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stay = corpus_pipeline.without_copies(spark, docs.unionByName(docs.limit(20)), SF)
    assert sorted(r["doc_id"] for r in stay.collect()) == least_ids(texts) and stay.columns == docs.columns


def test_blocks_of_a_large_group(spark, table):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(60)]
    texts = {k: edited(words, 0.03, rng) for k in range(90)}
    docs = table(list(texts.items()))
    rows = resemblance._named(docs)
    joined = resemblance.components(resemblance.links(rows, docs, block_rows=8))
    roots = {r["node"]: r["root"] for r in joined.collect()}
    named = {r["doc_id"]: r["node"] for r in rows.collect()}
    least = {}
    for k in sorted(named):
        least.setdefault(roots.get(named[k], named[k]), k)
    assert sorted(least.values()) == least_ids(texts)


def test_simhash_makes_candidates(spark, table):
    """Close copies are joined by their fingerprints alone, with no minhash key in common."""
    rng = random.Random(13)
    words = [f"w{rng.randrange(4000)}" for _ in range(3000)]
    texts = {k: " ".join(["edge" + str(k), *words[:-1], "end" + str(k)]) for k in range(20)}
    docs = table(list(texts.items()))
    rows = resemblance._named(docs).withColumn("bands", resemblance.F.array(resemblance.F.xxhash64("node")))
    joined = resemblance.components(resemblance.links(rows, docs))
    assert len({r["root"] for r in joined.collect()}) == 1 and joined.count() == 20


def test_joined_nodes_are_not_compared_again(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "leader bigint, node bigint")
    edges = spark.createDataFrame([(1, 7), (7, 2)], "a bigint, b bigint")
    assert sorted(map(tuple, resemblance._apart(pairs, edges).collect())) == [(1, 3), (4, 5)]


def test_components_of_short_and_long_lists(spark, monkeypatch):
    rng = random.Random(14)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    short = sorted(map(tuple, components.components(df).collect()))
    monkeypatch.setattr(components, "_settled", None)
    monkeypatch.setattr(components, "LOCAL_EDGES", -1)
    assert short == sorted(map(tuple, components.components(df).collect()))
    assert components.components(df.where("a = b")).count() == 0
