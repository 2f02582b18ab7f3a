from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lodestar.llm import near_dedup, packing
from tests.llm.helpers import DOCS, documents, rows_of


def brute_pack(rows, capacity):
    """Best fit with plain lists: the tightest compatible bin, the oldest among equals."""
    bins, out = [], []
    for size, source, cluster in rows:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and source not in b["sources"] and cluster not in b["clusters"]]
        if fits:
            i = min(fits)[1]
        else:
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
            i = len(bins) - 1
        bins[i]["left"] -= size
        bins[i]["sources"].add(source)
        bins[i]["clusters"].add(cluster)
        out.append(i)
    return out


@pytest.mark.parametrize("seed, n, capacity, sources, clusters", [(1, 400, 100, 5, 300), (2, 700, 50, 130, 40), (3, 1500, 10, 2, 1500), (4, 1, 7, 1, 1), (5, 300, 20, 300, 70)])
def test_block_is_best_fit(seed, n, capacity, sources, clusters):
    rng = random.Random(seed)
    block = pd.DataFrame({"doc_id": range(n), "piece": 0, "copy": 1, "n_words": [rng.randrange(capacity + 1) for _ in range(n)], "source": [f"s{rng.randrange(sources)}" for _ in range(n)], "cluster": [rng.randrange(clusters) for _ in range(n)]})
    got = packing.pack_block(block, capacity)
    assert got["n_words"].is_monotonic_decreasing
    assert got["bin"].tolist() == brute_pack(list(zip(got["n_words"], got["source"], got["cluster"], strict=True)), capacity)


@pytest.mark.parametrize("extra", [False, True])
def test_packing_is_whole_and_without_conflicts(spark, extra):
    docs = documents(spark, extra=extra)
    rows = rows_of(packing.pack(docs, capacity=64, block_items=16))
    source = {r["doc_id"]: r["source"] for r in rows_of(docs)}
    texts = {r["doc_id"]: r["text"] or "" for r in rows_of(docs)}
    words, held = Counter(), defaultdict(list)
    for r in rows:
        words[r["doc_id"], r["copy"]] += r["n_words"]
        held[r["bin_id"]].append(r)
    assert sum(words.values()) == sum(len([w for w in (r["text"] or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]) for r in rows_of(docs))
    assert len(words) == docs.count()
    for group in held.values():
        assert sum(r["n_words"] for r in group) <= 64 and {sum(r["n_words"] for r in group)} == {r["bin_words"] for r in group}
        assert len({source[r["doc_id"]] for r in group}) == len(group) == group[0]["bin_items"]
        # Equal texts with letter case and white space folded are one cluster.
        members = [" ".join(texts[r["doc_id"]].lower().split()) for r in group]
        assert len(set(members)) == len(members)
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_blocks_are_bounded_by_pieces(spark):
    docs = spark.createDataFrame([(i, "w " * 900, "en", f"s{i}", 1800) for i in range(5)], DOCS)
    rows = rows_of(packing.pack(docs, capacity=10, block_items=50))
    blocks = Counter(r["bin_id"].split("-")[0] for r in rows)
    assert len(rows) == 450 and len(blocks) > 5 and max(blocks.values()) < 90


def bag(text):
    w = (text or "").lower().replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter({tuple(w): 1} if w else {})


def brute_classes(rows):
    big = 2**63 - 1
    nodes = sorted({(big if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in rows})
    bags = [bag(t) for _, t in nodes]
    label = list(range(len(nodes)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            a, b = bags[i], bags[j]
            total = sum((a | b).values())
            if nodes[i][1] == nodes[j][1] or (sum((a & b).values()) / total >= 0.8 if total else True):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    ids = {n: nodes[find(i)][0] for i, n in enumerate(nodes)}
    return sorted(((r["doc_id"], None if (c := ids[big if r["doc_id"] is None else r["doc_id"], r["text"] or ""]) == big else c) for r in rows), key=str)


def near_texts():
    rng = random.Random(5)
    word = lambda: rng.choice("lorem ipsum dolor sit amet consectetur elit sed eiusmod tempor".split()) + str(rng.randrange(90))
    texts = []
    for base_words, copies, edits in ((200, 12, 2), (300, 30, 5), (80, 4, 1), (400, 8, 24), (60, 5, 0), (12, 6, 1)):
        base = [word() for _ in range(base_words)]
        texts.append(" ".join(base))
        for _ in range(copies):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(50)) + " " + passage for _ in range(40)]
    return texts + [None, "", "one", "one", "One", "one two three", "one two three four", "one two three four", "  one\ttwo three"]


@pytest.mark.parametrize("extra", [False, True])
def test_near_duplicates_match_brute_force(spark, extra):
    docs = documents(spark, near_texts(), extra=extra)
    got = sorted(((r["doc_id"], r["class_id"]) for r in rows_of(near_dedup.classes(docs))), key=str)
    want = brute_classes(rows_of(docs))
    assert got == want
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in rows_of(kept)) == sorted({c for _, c in want if c is not None})


def test_texts_of_one_id_or_none_are_judged_apart(spark):
    rng = random.Random(8)
    say = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n)]
    near = lambda words: " ".join([*words[:-1], "changed"])
    one, two, three, four = (say(120) for _ in range(4))
    lone = [" ".join(say(60)) for _ in range(6)]
    rows = [(5, " ".join(one)), (None, near(one)), (None, lone[0]), (None, lone[1]), (None, lone[1])]  # one text without id is near document 5
    rows += [(7, " ".join(two)), (7, lone[2]), (7, lone[3]), (3, near(two))]  # one of three texts of id 7 is near document 3
    rows += [(9, " ".join(three)), (9, near(three)), (None, " ".join(four)), (None, near(four)), (11, lone[4]), (12, lone[5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    want = {t: i for i, t in rows} | {near(one): 5, " ".join(two): 3}
    got = Counter((r["doc_id"], r["class_id"]) for r in rows_of(near_dedup.classes(docs)))
    assert got == Counter((i, want[t]) for i, t in rows)
    kept = rows_of(near_dedup.one_of_each(docs))
    texts = [r["text"] for r in kept]
    assert len(texts) == len(set(texts)) == 10
    assert {*lone, " ".join(one), near(two)} <= set(texts) and near(one) not in texts and " ".join(two) not in texts
    assert sum(t in texts for t in (" ".join(three), near(three))) == sum(t in texts for t in (" ".join(four), near(four))) == 1


def test_near_duplicates_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET", 6)
    docs = documents(spark, near_texts())
    assert sorted(((r["doc_id"], r["class_id"]) for r in rows_of(near_dedup.classes(docs))), key=str) == brute_classes(rows_of(docs))


def test_near_duplicates_empty(spark):
    assert near_dedup.classes(spark.createDataFrame([], DOCS)).count() == 0
    assert near_dedup.classes(documents(spark, ["nothing alike here", "something else there", "third of them all"])).count() == 3


def test_near_duplicates_beyond_all_splits(spark, monkeypatch):
    """Buckets that no split makes small go to a grid of slices, and no link is lost."""
    monkeypatch.setattr(near_dedup, "BUCKET", 6)
    monkeypatch.setattr(near_dedup, "SPLIT_ROUNDS", 0)
    docs = documents(spark, near_texts())
    assert sorted(((r["doc_id"], r["class_id"]) for r in rows_of(near_dedup.classes(docs))), key=str) == brute_classes(rows_of(docs))


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_signatures_estimate_weighted_jaccard(share):
    rng = np.random.default_rng(1)
    found = []
    for n in (1, 20, 400):
        k = round(2 * n * share / (1 + share))
        for _ in range(20):
            x = rng.integers(0, 2**63, 2 * n - k, dtype=np.uint64)
            v = near_dedup.dart_signatures(np.repeat([0, 1], n), np.concatenate([x[:n], x[n - k :]]), np.ones(2 * n), 2)
            found.append((v[0] == v[1]).mean() - k / (2 * n - k))
    assert abs(np.mean(found)) < 0.02


@pytest.mark.parametrize("scale, k", [(1.0, 192), (0.01, 192), (300.0, 192), (5000.0, 1024)])
def test_signatures_estimate_real_weights(scale, k):
    rng = np.random.default_rng(2)
    found = []
    for n in (1, 3, 60):
        for _ in range(10):
            x = rng.integers(0, 2**63, n, dtype=np.uint64)
            a, b = rng.random(n) * scale, rng.random(n) * scale
            v = near_dedup.dart_signatures(np.repeat([0, 1], n), np.r_[x, x], np.r_[a, b], 2, k)
            found.append((v[0] == v[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(found)) < 0.02


def test_elements_weigh_repeats():
    doc, x, weight = near_dedup.elements(pa.array(["a b c d e a b c d e a", "", "a", "a b c d e"]))
    assert np.bincount(doc, weight, minlength=4).tolist() == [7, 0, 1, 1]
    assert len(x[doc == 0]) == 5 and sorted(weight[doc == 0]) == [1, 1, 1, 2, 2] and x[doc == 3][0] in x[doc == 0]
