"""Secrets, BPE and decontamination against brute force and the tokenizers library."""

import hashlib
import random
import re
import subprocess
import sys
import time

import numpy as np
import public_tokenizers
import pytest

from campaignlens.llm import bpe, decontam, queries, secrets

TEXTS = [None, "", " ", "x", "token = \"24be64439e3e49cf46b2d7c9\" é " * 3, "the end <|endoftext|> the  end\n\n", "é" * 30000 + " a" * 30000]


@pytest.fixture(scope="module")
def scanner():
    return secrets.Scanner()


def brute_secrets(text):
    rules = [
        ("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m)]
    return [(rules[i][0], a, b) for a, i, b in sorted(found)]


def base(spans):
    return [s for s in spans if s[0] in ("assign", "access", "hex")]


def test_secrets_as_regular_expressions_find_them(scanner):
    rnd = random.Random(1)
    parts = ["token", "Secret", "=", ":", " ", "'", '"', "abc", "api_key", "AKIA", "ABCDEFGH12", "0123456789abcdef", "f" * 9, "é", "passwd", "==", "日", "AKIAAKIA", "\n"]
    for text in TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)]:
        assert base(scanner.spans(text)) == brute_secrets(text), text


def test_more_secrets(scanner):
    text = "ghp_" + "a1B2" * 10 + " -----BEGIN RSA PRIVATE KEY-----"
    assert [s[0] for s in scanner.spans(text)] == ["github", "pem"]


def test_secrets_in_linear_time(scanner):
    head = "eyJa.eyJb.eyJc.eyJ"
    for text in (head + "a" * 1_000_000, head * 50_000, "token=" * 150_000, "AKIA" * 250_000, "eyJa." * 200_000, "-----BEGIN " * 90_000, "ghp_" * 250_000):
        began = time.perf_counter()
        scanner.spans(text)
        assert time.perf_counter() - began < 4, text[:20]


def test_overlapping_matches_of_one_rule():
    rules = (secrets.Rule("jwt", r"eyJ[a-z]+\.eyJ[a-z]+\.[a-z]+"), secrets.Rule("pair", r"ab|bc"))
    rnd = random.Random(3)
    own = secrets.Scanner(rules)
    for _ in range(3000):
        text = "".join(rnd.choice(["eyJ", "a", ".", "eyJb.", "b", "c", " "]) for _ in range(rnd.randrange(20)))
        want = [(m.start(), i, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern, text)]
        assert own.byte_spans(text.encode()) == sorted(want), text


def test_secret_query_and_redaction(spark, sf_dir):
    rows = queries.op2_secret_scan(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and sum(r.n_assign for r in rows) > 0
    for r in rows:
        want = brute_secrets(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
    df = spark.createDataFrame([(1, None, "a"), (2, "é token=abcdefgh.", "b"), (2, "", "c")], "doc_id int, text string, SPANS string")
    out = secrets.scan_secrets(df).withColumn("clean", secrets.redact_spans("text", "spans")).collect()
    assert {r.clean for r in out} == {None, "", "é [secret]"}
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_bpe_as_the_library_does(spark, sf_dir):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = bpe.PairIndexTokenizer(path), Tokenizer.from_file(path)
    rnd = random.Random(2)
    parts = ["a", "aa", " ", "  ", "\n", "the", "'s", "'S", "éé", "日本語", "1", "23", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|endoftext", "!!", "...", "\t", "\r\n", "👍🏽", "a" * 40, "don't", "́", "Ⅷ", "½", "​"]
    texts = TEXTS + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    for i in range(0, len(texts), 500):
        own._forget(50)
        for text, got in zip(texts[i : i + 500], own.encode_batch(texts[i : i + 500])):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(got, "<u4").tolist() == want
            assert own.decode(got) == library.decode(want, skip_special_tokens=False)
    assert own.decode(np.array([own.codes and 127], "<u4").tobytes()) == library.decode([127], skip_special_tokens=False)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op4_bpe(spark, sf_dir).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()


def brute_hits(text, items, size):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in decontam.WORD.findall(text or "")]
    hit, found = set(), set()
    for item, t in items:
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in decontam.WORD.findall(t or "")]
        n = min(size, len(own))
        for i in range(len(own) - n + 1) if own else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_as_brute_force_finds_it(spark, block):
    rnd = random.Random(3)
    word = lambda: rnd.choice(["a", "B", "é", "c1", "Éa", "dd"])
    items = [(i, rnd.choice([" ", "-"]).join(word() for _ in range(rnd.randrange(9)))) for i in range(12)] + [(3, "x y"), (99, None), (None, "a a")]
    docs = [(i, ", ".join(word() for _ in range(rnd.randrange(60)))) for i in range(60)] + [(100, None), (101, ""), (101, "")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("N_HIT", decontam.F.lit("x"))
    got = decontam.find_contamination(df, bench, size=5, block_bytes=block).collect()
    kept = [(str(a), b) for a, b in items if a is not None]
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_hit, list(r.item_ids)) == brute_hits(r.text, kept, 5), r
        assert sum(len(decontam.WORD.findall(r.text[s.start : s.end])) for s in r.hit_spans) == r.n_hit
    assert decontam.find_contamination(df, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13])
def test_windows_through_half_windows(size):
    rnd = random.Random(size)
    words = ["a", "b", "c"]
    for _ in range(40):
        text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
        shared = text(size + 3)
        items = [(str(i), text(rnd.randrange(4)) + " " + shared[: rnd.randrange(len(shared))] + " " + text(rnd.randrange(3 * size))) for i in range(25)]
        matcher = decontam.Matcher(items, size)
        for _ in range(6):
            doc = text(rnd.randrange(10)) + " " + rnd.choice(items)[1] + " x " + shared + " " + text(rnd.randrange(40))
            n, runs, found = matcher.hits(doc)
            assert (n, sum(b - a for a, b in runs), sorted(found)) == brute_hits(doc, items, size)


def test_memory_of_the_automaton():
    script = """
import random, resource
from campaignlens.llm import decontam
rnd = random.Random(1)
words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(20000)]
items = [(str(i), " ".join(rnd.choice(words) for _ in range(150))) for i in range(2000)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
matcher = decontam.Matcher(items, 13)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / 300000)
"""
    a_word = float(subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True).stdout)
    print("bytes a word:", a_word)
    assert a_word < 200
