import math
import random
import zlib
from collections import Counter

import numpy as np

from vectorloom.llm import ctw


def brute_log10(train, texts, depth=ctw.DEPTH):
    """Context-tree weighting written as its recursion over dictionaries of counts."""
    counts = Counter()
    children = {}

    def bits(byte):
        node = 1
        for k in range(7, -1, -1):
            yield node, (byte >> k) & 1
            node = node * 2 + ((byte >> k) & 1)

    def places(text):
        full = b"\n" * depth + text
        return [(full[i : i + depth], full[i + depth]) for i in range(len(text))]

    for text in train:
        for context, byte in places(text):
            for node, bit in bits(byte):
                for d in range(depth + 1):
                    near = context[depth - d :]
                    counts[near, node, bit] += 1
                    if d:
                        children.setdefault((near[1:], node), set()).add(near)

    def estimate(near, node):
        a, b = counts[near, node, 0], counts[near, node, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(near, node):
        if (near, node) not in memo:
            own = estimate(near, node)
            if len(near) == depth:
                memo[near, node] = own, 1.0
            else:
                below = sum(weighted(child, node)[0] for child in children.get((near, node), ()))
                both = np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
                memo[near, node] = both, math.exp(math.log(0.5) + own - both)
        return memo[near, node]

    def chance(context, node, bit, d=0):
        near = context[depth - d :]
        n = counts[near, node, 0] + counts[near, node, 1]
        own = (counts[near, node, bit] + 0.5) / (n + 1)
        if d == depth:
            return own
        child = context[depth - d - 1 :]
        if not counts[child, node, 0] + counts[child, node, 1]:
            return own
        stay = weighted(near, node)[1]
        return stay * own + (1 - stay) * chance(context, node, bit, d + 1)

    return [sum(math.log10(chance(context, node, bit)) for context, byte in places(text) for node, bit in bits(byte)) for text in texts]


def test_scores_are_the_recursion(table):
    random.seed(5)
    words = ["the", "then", "hen", "Théo", "on", "onion", "日本", "x"]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(0, 30))) for _ in range(60)] + ["unseen zebra words", ""]
    docs = table(texts)
    # Small heads, so that looked-up and joined keys both occur.
    found = {r["doc_id"]: r for r in ctw.scored(docs, head_words=3, head_grams=40).collect()}
    whole = {r["doc_id"]: r for r in ctw.scored(docs).collect()}
    held = {k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 10 == 0}
    assert held and {k for k, r in found.items() if r["held_out"]} == held
    split = [text.encode().lower().split() for text in texts]
    bodies = [b" ".join(words) + b"\n" for words in split]
    expected = brute_log10([bodies[k] for k in range(len(texts)) if k not in held], bodies)
    counts = Counter(word for k, words in enumerate(split) if k not in held for word in [*words, b"<end>"])
    mass = sum(counts.values()) + 0.1 * (len(counts) + 1)
    for k, words in enumerate(split):
        base = sum(math.log10((counts[word] + 0.1) / mass) for word in [*words, b"<end>"])
        for rows in (found, whole):
            assert math.isclose(rows[k]["score"], expected[k], rel_tol=1e-9), k
            assert math.isclose(rows[k]["base_score"], base, rel_tol=1e-9)
            assert rows[k]["n_tokens"] == len(words) + 1 and rows[k]["n_known"] == sum(counts[w] > 0 for w in [*words, b"<end>"])
            assert rows[k]["train_tokens"] == sum(counts.values())


def test_chances_sum_to_one():
    grams, _ = ctw.text_grams([b"abracadabra\n", b"abra cad\n"])
    keys, times = np.unique(grams, return_counts=True)
    # One context with all 256 bytes after it.
    context = int(keys[3]) & ~255
    every = np.unique(np.concatenate([keys[(keys >> 32) == (context >> 32)], context + np.arange(256)]))
    n = np.asarray([dict(zip(keys.tolist(), times.tolist())).get(k, 0) for k in every.tolist()])
    flat = {name: np.zeros((256, 256)) for name in ("zeros", "ones", "stay")} | {name: np.zeros(256) for name in ("all_zeros", "all_ones", "stay_all")}
    values = ctw.gram_log10(every, n, flat)
    assert math.isclose((10 ** values[(every & ~255) == context]).sum(), 1.0, rel_tol=1e-9)


def test_gamma():
    x = np.asarray([0.5, 1.0, 1.5, 7.25, 30.0, 1e6])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)
