"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np

from campaignlens.llm import lexical


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    of = {}
    for item, text in items:
        if item is not None:
            of.setdefault(item, set()).update(terms(text))
    out = set()
    for item, own in of.items():
        scored = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, i))
        out |= {(item, rank, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def tables(seed=4):
    rnd = random.Random(seed)
    words = ["the", "Of", "a1"] * 30 + [f"w{i}é" for i in range(60)] + [f"rare{i}" for i in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    docs = [(i, text(rnd.randrange(1, 120))) for i in range(400)] + [(1000 + i, "same_old-words the w1é") for i in range(90)]
    docs += [(2000, None), (2001, ""), (2002, "?! \x7f"), (None, "the rare1"), (7, "w2é the"), (7, "w2é the")]
    items = [(f"i{i}", text(rnd.randrange(1, 30))) for i in range(30)] + [("x", "words OLD, same"), ("none", "!?"), ("null", None), (None, "the"), ("far", "notthere"), ("i1", "rare7 rare8")]
    rnd.shuffle(docs)
    return docs, items


def test_hits_as_all_scores_give_them(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", lexical.F.lit(1)).repartition(3)
    q = spark.createDataFrame(items, "item_id string, text string").withColumn("score", lexical.F.lit(1))
    for k, block_terms, size in ((50, 1_000_000, 2000), (7, 100, 40)):
        lexical.BLOCK, before = size, lexical.BLOCK
        try:
            got = lexical.ranked_search(d, q, k=k, block_terms=block_terms).collect()
        finally:
            lexical.BLOCK = before
        want = brute(docs, items, k)
        assert {tuple(r) for r in got} == want and len(got) >= len(want)


def test_empty_tables(spark):
    docs, items = tables()
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert lexical.ranked_search(d.limit(0), q).count() == 0
    assert lexical.ranked_search(d, q.limit(0)).count() == 0
    assert lexical.ranked_search(d, q).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.ranked_search(d.select(d.doc_id.cast("string").alias("doc_id"), "text"), q, k=3).where("item_id = 'x'").count() == 3


def postings(seed=1, n=2000, vocabulary=300):
    rng = np.random.default_rng(seed)
    counts = rng.poisson(rng.gamma(0.15, 1.0, vocabulary), (n, vocabulary)).T
    term, place = np.nonzero(counts)
    there, sizes = np.unique(term, return_counts=True)
    df = np.bincount(term, minlength=vocabulary)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    lengths = counts.sum(axis=0)
    return lexical.Block(lengths, there, sizes, place.astype(np.int32), counts[term, place], weights, n, int(lengths.sum())), weights, rng


def test_pairs_lower_bounds_and_reads():
    block, weights, rng = postings()
    read = {True: 0, False: 0}
    tighter = 0
    for _ in range(40):
        query = lexical.Query(rng.choice(300, 12, replace=False).tolist(), weights)
        block.intersect(query.pairs)
        full = np.zeros(block.n, np.int64)
        for t in query.terms:
            if t in block.lists:
                full[block.lists[t][0]] += block.lists[t][1]
        floor = int(np.sort(full)[-10])
        for paired in (True, False):
            found, scores = block.search(query, 10, floor, paired)
            assert set(np.flatnonzero(full >= max(floor, 1)).tolist()) == set(found.tolist()) and (full[found] == scores).all()
            read[paired] += block.read
        bounds = [block.bounds(query, p)[1][-1] for p in (True, False)]
        assert full.max() <= bounds[0] <= bounds[1]
        tighter += bounds[0] < bounds[1]
    assert tighter == 40 and read[True] < 0.95 * read[False], read
