"""Near duplicates against all pairs."""

import math
import random
import re

import numpy as np

from campaignlens.llm import minhash


def brute(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def documents(seed=5):
    rnd = random.Random(seed)
    words = [a + b for a in "abcdefgh" for b in ("a", "é", "X")]
    text = lambda n: [rnd.choice(words) for _ in range(n)]
    docs = [None, "", " \n", "one", "One", "one two", "two one"]
    base = text(150)
    for _ in range(60):  # similarities on both sides of the threshold, and chains
        own = list(base)
        for _ in range(rnd.randrange(6)):
            own[rnd.randrange(len(own))] = rnd.choice(words)
        docs.append(" ".join(own))
    step = text(120)
    for k in range(12):
        step = step[:]
        step[(k * 17) % 120] = f"n{k}"
        step[(k * 29) % 120] = f"m{k}"
        docs.append("\t".join(step))
    docs += [" ".join(text(rnd.randrange(1, 80))) for _ in range(60)]
    docs += docs[10:20] + ["same words here now"] * 20
    rnd.shuffle(docs)
    return list(enumerate(docs, 3))


def test_components_as_all_pairs_give_them(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Kept", minhash.F.lit("x")).repartition(7)
    got = minhash.near_duplicates(df, size=4).collect()
    assert {tuple(r) for r in got} == brute(docs, 4, 80) and len(got) == len(docs)


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (6, "a b c d e"), (7, None)], "doc_id long, text string")
    got = sorted(minhash.near_duplicates(df).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, None, True), (4, 1, 4, True), (4, 1, 4, True), (6, 1, 4, False), (7, 0, 7, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    bits = []
    for _ in range(300):
        x = rng.integers(0, 2**63, 900, np.uint64)
        low = np.array([minhash.signature(x[:810]), minhash.signature(x[90:])])
        a, b = minhash.sketches(low)
        bits.append(sum(int(v).bit_count() for v in (a ^ b).view(np.uint64)))
    assert abs(np.mean(bits) - minhash.bits_at(0.8)) < 3 and max(bits) <= minhash.bits_at(0.8 - minhash.MARGIN)


def chance_of_loss(samples, bits, limit, similarity):
    """That sketches of sets of a similarity differ in more than ``limit`` bits: each sample that differs flips two bits."""
    odd, dist, ways = np.arange(bits + 1), [np.eye(1, bits + 1)[0]], 0.0
    for _ in range(2 * samples):
        p, q = dist[-1], np.zeros(bits + 1)
        q[1:] += p[:-1] * (bits - odd[:-1]) / bits
        q[:-1] += p[1:] * odd[1:] / bits
        dist.append(q)
    for d in range(samples + 1):
        chance = math.exp(math.lgamma(samples + 1) - math.lgamma(d + 1) - math.lgamma(samples - d + 1) + d * math.log(1 - similarity) + (samples - d) * math.log(similarity))
        ways += chance * dist[2 * d][limit + 1 :].sum()
    return ways


def test_margins_lose_links_as_rarely_as_stated():
    assert chance_of_loss(minhash.SAMPLES, minhash.SKETCH_BITS, minhash.bits_at(0.8 - minhash.MARGIN), 0.8) < 1.3e-7
    assert chance_of_loss(minhash.WIDE_SAMPLES, minhash.WIDE_BITS, minhash.bits_at(0.8 - minhash.WIDE_MARGIN, minhash.WIDE_SAMPLES, minhash.WIDE_BITS), 0.8) < 1.9e-7
    assert (1 - 0.8**minhash.ROWS) ** minhash.BANDS < 5e-7


def test_pairs_of_one_bucket_in_many_tasks(spark):
    docs = documents(9)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in minhash.near_duplicates(df, size=4, cell_pairs=2, broadcast_bytes=1, broadcast_ids=1).collect()} == brute(docs, 4, 80)


def test_sketches_of_a_batch_take_little_memory():
    import tracemalloc

    low = np.random.default_rng(1).integers(0, 2**64, (2000, minhash.WIDE_SAMPLES), np.uint64)
    tracemalloc.start()
    made = minhash.sketches(low, minhash.WIDE_BITS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # all rows at once took hundreds of MB in each worker
    assert (made == minhash.sketches(low, minhash.WIDE_BITS, 1 << 40)).all() and (made[:7] == minhash.sketches(low[:7], minhash.WIDE_BITS, 1)).all()
