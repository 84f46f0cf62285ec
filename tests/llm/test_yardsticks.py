"""Operators whose queries have no SQL, or SQL without a part of the method, against plain Python."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from reviewmill.llm import language_id, mixing, spotsigs


def _chains(text):
    """Each anchor that a content word follows, with the next content words; else all words as one."""
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    out = set()
    for i, word in enumerate(words):
        if word in spotsigs.ANCHORS and i + 1 < len(words) and words[i + 1] not in spotsigs.ANCHORS:
            content = [w for w in words[i + 1 :] if w not in spotsigs.ANCHORS][: spotsigs.CHAIN]
            if len(content) == spotsigs.CHAIN:
                out.add(" ".join([word, *content]))
    return out or {" " + " ".join(words) + " "}


def test_spot_signatures_against_brute_force(spark):
    rng = random.Random(15)
    vocabulary = ["the", "of", "a", "der", "que", "is", "cat", "Dog", "house", "é7", "tree,", "now.", "The", "blue-green"]
    texts = {3 * i - 40: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for i in range(60)}
    texts |= {500: None, 501: "", 502: "the of", 503: texts[-40], 504: texts[-40], 505: "?!"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    ids = sorted(texts)
    edited = {}
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        own, other = texts[i] or "", texts[following] or ""
        half = len(own) // 2
        edited[i] = own[: len(own) - half] + other[:half]
    chains = {i: (_chains(texts[i]), _chains(edited[i])) for i in ids}
    every = sorted({c for pair in chains.values() for one in pair for c in one})
    hashed = {r.c: r.h for r in spark.createDataFrame([(c,) for c in every], "c string").select("c", F.hash("c").alias("h")).collect()}
    sets = {i: tuple({hashed[c] for c in one} for one in pair) for i, pair in chains.items()}
    told = lambda one: "".join(f"{h % (1 << 32):08X}" for h in sorted(one))
    alike = lambda a, b: len(a & b) / len(a | b)
    got = {r.doc_id: r for r in spotsigs.fingerprints(docs).collect()}
    assert set(got) == set(ids)
    for i, following in zip(ids, [*ids[1:], ids[0]], strict=True):
        row, (own, cut) = got[i], sets[i]
        assert (row.n_chars, row.edited_sha256) == (len(texts[i] or ""), hashlib.sha256(edited[i].encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (told(own), told(cut)), texts[i]
        assert abs(row.near_edited - alike(own, cut)) < 1e-12 and abs(row.near_next - alike(own, sets[following][0])) < 1e-12


def test_backpropagation_against_differences():
    """Gradients through time, of both directions, against the loss on either side of a weight."""
    rng = np.random.default_rng(16)
    net = language_id.Network(["a", "b", "c"], seed=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    data, labels = rng.integers(97, 103, (9, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.positions(data)
        return -np.log(p[:, np.arange(len(labels)), labels]).mean()

    step = 1e-2
    for name, grad in net.gradients(data, labels).items():
        weight = net.weights[name]
        places = [np.unravel_index(i, grad.shape) for i in np.argsort(-np.abs(grad), axis=None)[:6]]
        for at in places + [tuple(int(rng.integers(n)) for n in grad.shape) for _ in range(4)]:
            kept = weight[at]
            weight[at] = kept + step
            above = loss()
            weight[at] = kept - step
            below = loss()
            weight[at] = kept
            assert abs((above - below) / (2 * step) - grad[at]) < 0.02 * abs(grad[at]) + 5e-5, (name, at)


def test_quotas_of_the_tree_add_up(spark):
    quotas = {"=a": 300, "=b": 41, "": 7, "=c": 1}
    leaves = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "skey string, quota long"), 3).collect()
    for source, quota in quotas.items():
        assert sum(r.quota for r in leaves if r.skey == source) == quota
    total = sum(quotas.values())
    by_shard = [sum(r.quota for r in leaves if r.shard == s) for s in range(8)]
    assert all(abs(n - total / 8) < 1 for n in by_shard)
    # A draw without replacement gives each shard about its share of a large source.
    assert all(20 <= r.quota <= 55 for r in leaves if r.skey == "=a")


def test_dealt_blocks_are_disjoint(spark):
    blocks = [(s, b, p) for s, n in (("=a", 90), ("", 13)) for b in range(n) for p in (0, 1) if not (p and b % 3)]
    taken = spark.createDataFrame([(*x, None) for x in blocks], "skey string, block int, pass int, need double")
    got = mixing.dealt(taken, 2).collect()
    assert sorted((r.skey, r.block, r["pass"]) for r in got) == sorted(blocks)
    assert {r.shard for r in got} == {0, 1, 2, 3}


def test_taken_words_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.taken(docs).join(docs.select("doc_id", "source"), "doc_id")
    sums = rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert sums and all(abs(r.taken - r.target) <= r.most for r in sums)
    assert not rows.where("taken > 2 * size").count()
