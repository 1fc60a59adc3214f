"""Shards, mix, near-duplicates, packing and the pipeline against plain versions."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from vectorloom.llm import components, mixing, packing, sharding, simhash

from .conftest import SF


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def jump(key, shards):
    at, after = -1, 0
    while after < shards:
        at = after
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        after = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_walk(spark):
    keys = [0, 1, -1, 2**62, -(2**63), 2**63 - 1] + [random.Random(8).getrandbits(64) - 2**63 for _ in range(300)]
    rows = spark.createDataFrame([(k,) for k in keys], "key bigint")
    for shards in (1, 2, 16, 100):
        found = {r["key"]: r["w"] for r in rows.select("key", sharding.jump_walk(rows["key"], shards).alias("w")).collect()}
        for k in keys:
            assert found[k]["shard"] == jump(k % (1 << 64), shards) and found[k]["grown"] == jump(k % (1 << 64), shards + 1)


def test_shards_of_documents(spark, table):
    docs = documents(spark)
    docs = docs.unionByName(docs.limit(30)).unionByName(table([(5, "copy")] * 25_000))
    found = sharding.sharded(docs).collect()
    assert len(found) == docs.count()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.sharded(docs.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found))


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * share > 2 * sizes[s]}
        if not over:
            return target | {s: weights[s] * share for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_reaches_its_targets(spark, table):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randint(0, 40 if k % 7 else 900), "en", rng.choice(["a", "B", "é", None, "", "a" if k % 3 else "zz"]), 1) for k in range(700)]
    docs = table(rows)
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(row[1].split())
    expected = brute_targets(sizes)
    named, taken = mixing.mix(mixing.sized_rows(docs), block_words=64)
    words, of = defaultdict(int), {r["_row"]: r for r in named.collect()}
    spans = defaultdict(list)
    for r in taken.collect():
        words[of[r["_row"]]["source"]] += r["words"]
        spans[r["_row"], r["epoch"]].append((r["first"], r["words"]))
    for source, target in expected.items():
        assert words[source] == pytest.approx(target, abs=0.51)
    for (row, _), parts in spans.items():
        # What is taken of a document is a stretch from its first word, in pieces that do not overlap.
        at = 0
        for first, n in sorted(parts):
            assert first == at and n > 0
            at += n
        assert at <= of[row]["size"]
    out = mixing.mixed(docs).collect()
    assert all(r["taken"] <= 2 * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed(docs.repartition(5)).collect()))


def test_schedule_spreads_sources(spark):
    targets = spark.createDataFrame([("a", 0, 4000, 6000.0), ("b", 1, 3000, 2000.0), ("c", 2, 1000, 10.0)], "source string, rank bigint, source_size bigint, target double")
    slots = sorted(mixing.schedule(targets, 10).collect())
    assert [sum(r["words"] for r in slots if r["rank"] == k) for k in range(3)] == [6000, 2000, 10]
    order = [r["rank"] for r in slots]
    for k, share in ((0, 600 / 801), (1, 200 / 801)):
        seen = np.cumsum([r == k for r in order])
        assert np.abs(seen - share * np.arange(1, len(order) + 1)).max() < 12
    for k in range(3):
        assert [r["block"] for r in slots if r["rank"] == k] == list(range(sum(r == k for r in order)))


def test_first_words(spark):
    rows = spark.createDataFrame([(" a  b\tc\nd ", k) for k in range(1, 7)], "text string, n int")
    from pyspark.sql import functions as F

    assert [r[0] for r in rows.select(mixing.first_words(F.col("text"), F.col("n"))).collect()] == ["a", "a  b", "a  b\tc", "a  b\tc\nd", "a  b\tc\nd", "a  b\tc\nd"]


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    names = list(prints)
    parent = {k: k for k in names}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in names}


def test_near_duplicates_of_documents(spark):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {k: brute_simhash(t) for k, t in texts.items()}
    roots = brute_components(prints)
    for r in simhash.near_duplicates(docs).collect():
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == roots[r["doc_id"]]
    stay = simhash.representatives(docs.unionByName(docs.limit(20)))
    assert sorted(r["doc_id"] for r in stay.collect()) == sorted(set(roots.values())) and stay.columns == docs.columns


def test_every_close_pair_meets_under_some_mask():
    masks = [m % (1 << 64) for m in simhash.covering_masks()]
    rng = random.Random(10)
    assert len(masks) == 15
    for _ in range(3000):
        flip = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        assert any(flip & m == 0 for m in masks)


@pytest.mark.parametrize("block", [1024, 3])
def test_links_of_crowded_buckets(spark, block):
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(150)}
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    edges = simhash.links(frame, block_rows=block).collect()
    assert all((signed[r["a"]] ^ signed[r["b"]]).bit_count() <= 3 for r in edges)
    found = {r["node"]: r["root"] for r in components.components(simhash.links(frame, block_rows=block)).collect()}
    expected = brute_components({s: signed[s] for s in sorted(signed)})
    assert {s: found.get(s, s) for s in signed} == expected


def test_components_of_chains_and_stars(spark):
    rng = random.Random(12)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(5, 5), (260, 100), (260, 100)]
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert set(found.values()) == {100, 7} and found[260] == 100 and found[259] == 7 and len(found) == 62 + 61


def test_pieces_hold_the_tokens(spark, table):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["a  b", " lead", "trail ", "\n\nx\n y\n", "tab\tand space", "non break   wide", "it's we'll 'S", "x" * 3000, "<|endoftext|> in text", "é 日本語 😀 1234 ##", "\x1c \x1d", "a\u0085 b"]
    texts = [r["text"] for r in documents(spark).collect()] + odd
    pieces = packing.pack_documents(table(texts), shard_items=64).collect()
    parts = defaultdict(dict)
    for r in pieces:
        parts[r["doc_id"]][r["piece"]] = r
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        mine = [parts[k][p] for p in range(len(parts[k]))]
        assert [r["start"] for r in mine] == np.cumsum([0] + [r["length"] for r in mine])[:-1].tolist() and sum(r["length"] for r in mine) == len(ids), repr(text[:40])
        assert all(r["length"] == 1024 for r in mine[1:]) and len(mine) == -(-len(ids) // 1024)
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.asarray(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.02 * sum(r["length"] for r in pieces) / 1024 + 4


def test_sum_of_squares_choice():
    rng = np.random.default_rng(13)
    lengths = rng.integers(1, 40, 300)
    bins, offsets, room = packing.sum_of_squares(lengths, 40)
    gaps: dict[int, int] = {}
    for item in np.argsort(-lengths, kind="stable"):
        size, chosen = int(lengths[item]), int(bins[item])

        def squares(b):
            after = {**gaps, b: gaps.get(b, 40) - size}
            return sum(n * n for n in np.bincount([g for g in after.values() if g], minlength=41)[:40])

        fits = [b for b, gap in gaps.items() if gap >= size]
        if fits:
            assert chosen in gaps and squares(chosen) == min(squares(b) for b in fits)
        else:
            assert chosen not in gaps
        assert offsets[item] == 40 - gaps.get(chosen, 40)
        gaps[chosen] = gaps.get(chosen, 40) - size
    assert all(room[k] == gaps[int(bins[k])] for k in range(len(lengths)))


def test_pipeline_is_its_stages(spark):
    docs = documents(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    from vectorloom.llm import quality

    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in quality.judged(docs).where("kept").collect())
    single = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    clean = corpus_pipeline.STAGES[2][1](spark, single, SF)
    assert clean.count() == single.count()
    changed = [r for r in clean.collect() if r["text"] != texts[r["doc_id"]]]
    assert all("[secret]" in r["text"] and r["n_chars"] == len(r["text"]) for r in changed)
    mix = corpus_pipeline.STAGES[3][1](spark, clean, SF)
    shares = {r["doc_id"]: r for r in mixing.mixed(clean).collect()}
    taken = defaultdict(int)
    for r in mix.collect():
        taken[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert {k: n for k, n in taken.items() if n} == {k: r["taken"] for k, r in shares.items() if r["taken"]}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sum(1 for r in rows if r["piece"] == 0) == mix.count()
