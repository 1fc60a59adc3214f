"""The manifest, the license scan and the ranked search against plain versions."""

import math
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest

from vectorloom.llm import licenses, merkle, search

from .conftest import SF


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def hashed(text):
    return sha256(text.encode()).hexdigest()


def leaf(row, text):
    return hashed("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def tree(nodes):
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(own):
            run = at - at % 3
            proofs[k].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 3])))
        own = [at // 3 for at in own]
        nodes = [hashed("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]
    return nodes[0], proofs


def plain_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row["source"], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        order = sorted(by_source[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[name] = order, *tree([leaf(r, r["text"]) for r in order])
    root, above = tree([trees[name][1] for name in names])
    out = []
    for name, rest in zip(names, above):
        order, subroot, proofs = trees[name]
        for row, proof in zip(order, proofs):
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node, steps = leaf(row, text), proof + rest
            for before, after in steps:
                node = hashed(before + node + after)
            out.append((row["doc_id"], leaf(row, row["text"]), subroot, root, hashed("".join(b + a for b, a in steps)), node, node == root))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_of_documents(spark, levels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert in_order(merkle.checked(docs, levels).collect()) == in_order(plain_manifest(docs.collect()))


def test_manifest_of_ragged_trees(table):
    """Every count of leaves up to 40, in blocks of three: last subtrees of every size."""
    rows = [(n * 100 + k, f"text {k}\nof {n}", "en", f"s{n}", 9) for n in range(1, 41) for k in range(n)]
    random.Random(5).shuffle(rows)
    docs = table(rows)
    assert in_order(merkle.checked(docs, 1).collect()) == in_order(plain_manifest(docs.collect()))


def test_manifest_of_odd_rows(odd, nothing):
    found = in_order(merkle.checked(odd, 1).collect())
    assert found == in_order(plain_manifest(odd.collect())) and len(found) == 11
    assert merkle.checked(nothing).collect() == []
    spread = merkle.manifest(odd).collect()
    assert {r["tree"] for r in spread} == {"", "=", "=a", "=b"} and len({r["root"] for r in spread}) == 1


def test_many_equal_rows_are_placed_apart(table):
    found = merkle.manifest(table([(1, "same", "en", "a", 4)] * 3000), 2)
    assert found.count() == 3000 and found.select("proof").distinct().count() > 1 and found.select("subroot").distinct().count() == 1


def test_altered_proof_is_found_out(spark, table):
    spread = merkle.manifest(table([f"t{k}" for k in range(10)]), 1)
    assert all(r["f"] == r["root"] for r in spread.withColumn("f", merkle.folded(spread["leaf"], spread["proof"])).collect())
    wrong = spread.withColumn("f", merkle.folded(merkle.digest(spread["leaf"]), spread["proof"]))
    assert all(r["f"] != r["root"] for r in wrong.collect())


def plain_scan(row):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(row["text"]))
    places, base, labels = [], set(), set()
    for phrases, kept in ((licenses.BASE_PHRASES, base), (licenses.OWN_PHRASES, labels)):
        for phrase, label in phrases.items():
            phrase = phrase.split()
            found = [k for k in range(len(words)) if words[k : k + len(phrase)] == phrase]
            if found:
                kept.add(label)
            if kept is base:
                places += found
    first, last = (min(places), max(places)) if places else (None, None)
    return row["doc_id"], len(words), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), float(bool(base | labels))


def test_phrases_of_documents(spark, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(40)).unionByName(table([
        (10_001, "cc by cc by-cc BY; the MIT  License/mit licenses, Apache\nLicense version 2.0 GNU general public license"),
        (10_002, "cc"), (10_003, "mit license"), (10_004, "license mit"), (10_005, "x " * 5000 + "CC-BY-SA " * 400), (None, "cc by"), (None, "cc by"),
    ]))
    assert in_order(licenses.scan(docs).collect()) == in_order(map(plain_scan, docs.collect()))


def test_notices_with_changed_words(table):
    rng = random.Random(3)
    notice = licenses.words(licenses.NOTICES["bsd"].encode())
    notice = [w.decode() for w in notice]
    filler = [f"w{rng.randrange(900)}" for _ in range(3000)]
    few, many = notice[:], notice[:]
    for k in range(0, len(few), 12):
        few[k] = "other"
    few.insert(20, "added")
    del few[40]
    for k in range(0, len(many), 2):
        many[k] = "other"
    texts = {"few": filler[:50] + few + filler[50:], "many": filler[:50] + many, "none": filler, "whole": notice + notice, "cut": notice[: len(notice) // 2]}
    found = dict(zip(texts, sorted(licenses.scan(table([" ".join(t) for t in texts.values()])).collect())))
    assert [found[k]["labels"] for k in texts] == ["bsd", "", "", "bsd", ""]
    assert 0.85 < found["few"]["score"] < 1 and found["none"]["score"] == 0 and found["whole"]["score"] == 1 and 0.4 < found["cut"]["score"] < 0.6
    assert all(found[k]["n_base"] == 0 for k in texts)


def test_order_of_words_by_bits():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *_next(row, x, b)]
        assert licenses.words_in_order(tuple(a), b) == row[-1]


def _next(row, x, b):
    out, left = [], 0
    for k, y in enumerate(b):
        left = row[k] + 1 if x == y else max(row[k + 1], left)
        out.append(left)
    return out


def test_candidates_beyond_the_broadcast_bound(spark, table):
    docs = table([(k, "the mit license, cc by" if k % 3 else "nothing") for k in range(30)])
    want = in_order(licenses.scan(docs).collect())
    spark.conf.set("vectorloom.broadcast.bytes", "1")
    try:
        assert in_order(licenses.scan(docs).collect()) == want
    finally:
        spark.conf.unset("vectorloom.broadcast.bytes")


def plain_search(docs, items, top=20):
    term = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    held = [(r["doc_id"], Counter(term.findall(lowered(r["text"])))) for r in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, length, df = len(held), sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item in items:
        scores = []
        asked = Counter(term.findall(lowered(item["text"])))
        for i, c, n in held:
            m = 75 + 25 * n * total // length
            score = sum(k * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in asked.items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item["item_id"], k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize("block_terms", [1 << 15, 2000])
def test_search_of_documents(spark, block_terms):
    docs, items = (spark.read.parquet(f"{SF}/{name}.parquet") for name in ("documents", "benchmark"))
    docs = docs.unionByName(docs.limit(30))
    found = search.ranked(docs, items, block_terms=block_terms)
    assert in_order(found.collect()) == in_order(plain_search(docs.collect(), items.collect()))


def test_search_of_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame(
        [(1, "same text"), (1, "w1x1 w1x1 W2X2 same"), (2, None), (3, ""), (None, "ÇÖDÉ çödé ünï 日本"), (4, "absent"), (5, "a"), (5, "a")], "item_id bigint, text string")
    found = search.ranked(odd, items, top=3)
    assert in_order(found.collect()) == in_order(plain_search(odd.collect(), items.collect(), 3))
    assert search.ranked(nothing, items).collect() == [] and search.ranked(odd, items.where("false")).collect() == []
    assert found.columns == ["item_id", "rank", "doc_id", "score"]


def test_equal_scores_rank_by_id(spark, table):
    docs = table([(k, "one two") for k in (9, 4, 7, 1, 30, 2)] + [(50, "three")] * 3)
    items = spark.createDataFrame([(0, "one")], "item_id bigint, text string")
    assert [(r["rank"], r["doc_id"]) for r in search.ranked(docs, items, top=4).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 4), (4, 7)]


def test_shared_graph_adds_up():
    """Every root is the item's terms, with fewer joins than the items have alone."""
    rng = random.Random(6)
    items = [[f"t{min(rng.randrange(40), rng.randrange(40))}".encode() for _ in range(rng.randrange(25))] for _ in range(60)] + [[]]
    graph = search.shared_graph(items)
    sums = {k: Counter({graph.words[w]: t for w, t in leaf}) for k, leaf in enumerate(graph.leaves)}
    joins = 0
    for made, left, right in graph.levels:
        for m, a, b in zip(made.tolist(), left.tolist(), right.tolist()):
            sums[m] = sums[a] + sums[b]
            joins += 1
    assert [sums.get(r, Counter()) for r in graph.roots.tolist()] == [Counter(words) for words in items]
    assert joins < 0.65 * sum(len(set(words)) for words in items)
