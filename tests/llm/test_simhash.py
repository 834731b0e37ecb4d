"""SimHash near duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from campaignlens.llm import queries, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    values = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute(fps, radius=3):
    """(id, fingerprint, smallest linked id) of (id, fingerprint)."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x) in enumerate(fps):
        for j, y in fps[:k]:
            if (x ^ y).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {(i, f"{x:016x}", find(i)) for i, x in fps}


def documents(seed=3):
    rnd = random.Random(seed)
    words = [a + b for a in "abcdefgh" for b in ("a", "é", "X")]
    docs = [None, "", " \n\t", "one", "One", "one two", "a\x1cb c\x85d e\xa0f g"]
    for _ in range(4):
        base = [rnd.choice(words) for _ in range(300)]
        for _ in range(25):
            own = list(base)
            for _ in range(rnd.randrange(8)):
                own[rnd.randrange(300)] = rnd.choice(words)
            docs.append(" ".join(own))
    docs += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(60)] + docs[8:18]
    rnd.shuffle(docs)
    return list(enumerate(docs, 3))


def test_components_as_all_pairs_give_them(spark):
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("FP", simhash.F.lit("x")).repartition(5)
    want = brute([(i, brute_fingerprint(t)) for i, t in docs])
    assert len({c for _, _, c in want}) < len(docs) - 40
    for size in (4096, 3):  # of few fingerprints a tree: several trees a shard
        got = simhash.simhash_duplicates(df, tree_size=size, broadcast_keys=0 if size == 3 else 10).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(docs)


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (6, "A B C D"), (7, None), (9, " ")], "doc_id long, text string")
    got = [(r.doc_id, r.component_id) for r in simhash.simhash_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(None, None), (4, 4), (4, 4), (6, 4), (7, 7), (9, 7)], key=str)
    assert simhash.simhash_duplicates(df.limit(0)).count() == 0
    text_ids = df.where("doc_id > 4").select(simhash.F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert {tuple(r)[::2] for r in simhash.simhash_duplicates(text_ids).collect()} == {("6", "6"), ("7", "7"), ("9", "7")}


@pytest.mark.parametrize("blocks", [4, 5, 6, 9])
def test_links_share_a_shard(spark, blocks):
    rng = random.Random(blocks)
    pairs = []
    for _ in range(200):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 3):
            y ^= 1 << b
        pairs.append([int(np.uint64(v).view(np.int64)) for v in (x, y)])
    df = spark.createDataFrame(pairs, "x long, y long")
    same = simhash.F.arrays_overlap(simhash.shard_keys("x", 3, blocks), simhash.shard_keys("y", 3, blocks))
    assert df.where(same).count() == 200


def test_tree_finds_all_and_follows_few_edges():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 1500, np.uint64)
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    values = np.unique(np.concatenate([base, near]))
    tree = simhash.BKTree(values)
    assert sorted(tree.order.tolist()) == list(range(len(values)))
    got = {(int(tree.order[n]), int(q)) for n, found in tree.within(values, 3) for q in found}
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    assert got == set(zip(*map(list, np.nonzero(apart <= 3))))
    assert tree.visits < 0.5 * len(values) ** 2
    once = {frozenset((int(tree.order[n]), int(tree.order[q]))) for n, found in tree.within(tree.values, 3, later=True) for q in found}
    assert once == {frozenset(p) for p in got if p[0] != p[1]}


def test_query_over_whole_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in queries.QUERIES["op13_simhash"](spark, sf_dir).collect()}
    assert {(i, x) for i, x, _ in got} >= {(i, f"{brute_fingerprint(t):016x}") for i, t in docs if len(t or "") < 1500}
    assert got == brute(sorted((i, int(x, 16)) for i, x, _ in got))
