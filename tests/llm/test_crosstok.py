"""Alignment of two tokenizers against all token ends, with the libraries' own tokens."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from campaignlens.llm import crosstok, queries
from campaignlens.llm.bpe import byte_chars

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "a ", " a  b ", "\n\n x\t\ty \n", "café naïve 日本語の文 \U0001f600\U0001f600", "a▁b", "▁", "<|endoftext|> <s></s><unk> <0x41>", "it's we'll 12345 ½ Ⅷ \x00\x1f\x85\xa0 x",
    "x" * 3000, "ab" * 500 + " " * 300, "don't-stop... (now)!? https://a.b/c?d=e", "ffi ﬁ ẛ̣ é ́a",
]


def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute(texts):
    """Rows of the query without the id, in order."""
    a, b = libraries()
    chars = {c: i for i, c in enumerate(byte_chars())}
    docs, counts = [], Counter()
    for text in texts:
        text = text or ""
        whole = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        of_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        of_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(of_a) != whole or b"".join(of_b) != whole:
            docs.append(None)
            continue
        ends = [list(accumulate(map(len, of))) for of in (of_a, of_b)]
        groups, links, i = [], [], 0
        at_b = {}
        for j, e in enumerate(ends[1]):
            at_b.setdefault(e, []).append(j)
        j0 = 0
        for k, e in enumerate(ends[0]):
            for j in at_b.get(e, []):
                links.append((ids_a[k], ids_b[j]))
            if e in at_b:
                j1 = at_b[e][-1] + 1
                groups.append(",".join(map(str, ids_a[i : k + 1])) + "|" + ",".join(map(str, ids_b[j0:j1])))
                i, j0 = k + 1, j1
        counts.update(links)
        docs.append((len(ids_a), len(ids_b), groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [
        (0, 0, 0, 0, 0, 0, "") if d is None
        else (d[0], d[1], len(d[2]), len(d[3]), sum(counts[x] == top[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), hashlib.sha256(";".join(d[2]).encode()).hexdigest())
        for d in docs
    ]


def test_odd_texts(spark):
    rnd = random.Random(2)
    letters = "ab ▁é中\n'1 \U0001f600\x1c"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(300)] + ["some words"] * 50
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("N_A", crosstok.F.lit(1)).repartition(3)
    want = sorted(((i if i else None, *row) for i, row in enumerate(brute(texts))), key=str)
    for common in (200_000, 5):  # of the latter most pairs are joined
        got = crosstok.align_corpus(df, BYTES, PIECES, common=common)
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert crosstok.align_corpus(df.limit(0), BYTES, PIECES).count() == 0


def test_words_have_the_tokens_of_whole_texts(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [t or "" for t in ODD]
    a, b = libraries()
    assert [x.tolist() for x in crosstok.PieceTokenizer(PIECES).encode(texts)] == b.encode(texts)
    own = crosstok.ByteTokenizer(BYTES).encode(texts)
    assert all(x.tolist() == e.ids for x, e in zip(own, a.encode_batch([" " + t for t in texts], add_special_tokens=False)))


def test_windows_are_looked_up():
    one = crosstok.Aligner(BYTES, PIECES)
    one.batch(["The quick brown fox jumps over the lazy dog. " * 40, "no other words"])
    assert one.made < 30 and one.asked > 300


def test_sizes_of_batches_change_nothing(monkeypatch):
    texts = ["one two three", "four five six", "one two", None, "x " * 50, "中文 a▁b"]
    want = [list(map(str, c)) for c in crosstok.Aligner(BYTES, PIECES).batch(texts)]
    monkeypatch.setattr(crosstok, "BATCH", 1)
    monkeypatch.setattr(crosstok, "KEPT_PIECES", 1)
    own = crosstok.Aligner(BYTES, PIECES)
    assert all([list(map(str, c)) for c in own.batch(texts)] == want for _ in range(3))


def test_hashes_are_verified(monkeypatch):
    texts = ["one two three one two", "three one"]
    want = [list(map(str, c)) for c in crosstok.Aligner(BYTES, PIECES).batch(texts)]
    monkeypatch.setattr(crosstok, "MIX", np.uint64(0))  # windows of as many tokens have one hash
    own = crosstok.Aligner(BYTES, PIECES)
    assert [list(map(str, c)) for c in own.batch(texts)] == want and own.made == own.asked


def test_query_over_whole_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op12_token_alignment"](spark, sf_dir).collect()))
    assert got == sorted((i, *row) for (i, _), row in zip(docs, brute([t for _, t in docs])))
