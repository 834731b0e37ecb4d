"""Personal data against regular expressions of the standard library."""

import hashlib
import random
import re
import time

from campaignlens.llm import pii, queries


def luhn(t):
    d = [int(c) for c in t if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def brute(text):
    digits = lambda t: sum(c.isdigit() for c in t)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 14 <= digits(t) <= 19 and luhn(t)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 10 <= digits(t) <= 15),
    ]
    found = [(m.start(), i, m.end()) for i, (_, p, ok) in enumerate(rules) for m in re.finditer(p, text or "", re.ASCII) if ok(m[0])]
    return [(rules[i][0], a, b) for a, i, b in sorted(found)]


def base(spans):
    return [(s.kind, s.start, s.end) for s in spans if s.kind in pii.BASE_KINDS]


def test_base_spans(spark):
    rnd = random.Random(4)
    parts = ["a@b.com", "@", "x", "_c@d.e", ".", "1.2.3.4", "256", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (743) 555-3824", "+", "7", "99", "é", "👍", "\n", "a.b-c", "(", "0000", "+49 30 1234567", " at ", " dot "]
    texts = [None, "", "1 " * 50_000, "a." * 20_000 + "@" + "b." * 20_000 + "c", "9" * 30_000, "+1" + "(" * 9_000, "a@b.c" * 3_000]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Spans", pii.F.lit(1))
    for r in pii.find_personal_data(df).collect():
        assert base(r.spans) == brute(texts[r.doc_id]), (texts[r.doc_id] or "")[:200]
    assert pii.find_personal_data(df.limit(0)).count() == 0


def announced(i):
    """A document and the added spans that it holds; every fourth has nothing that announces them."""
    said = i % 4 > 0
    phone, ssn, mail = f"({200 + i % 700}) 555-{1000 + i}", f"{100 + i}-{10 + i % 80}-{1000 + i}", f"joe{i} (at) mail (dot) com"
    parts = [
        ("order 12345", None), (f"on 2024-{1 + i % 12:02d}-{1 + i % 28:02d}", None), ("call me at " if said else "or then ", phone), ("paid", None), (f"{i}.{i % 99:02d} at noon", None),
        ("my ssn " if said else "also ", ssn), (f"version 1.{i % 9}.{i % 7}", None), ("write ", mail), (f"part no {1000000 + 37 * i} in stock. Look at me", None),
    ]
    text, spans = "", []
    for lead, span in parts:
        text += lead
        if span:
            spans.append((len(text), len(text) + len(span)))
            text += span
        text += " "
    return text, spans


def test_added_spans_and_their_held_out_precision(spark):
    docs = [announced(i) for i in range(300)]
    rows = [(i, text) for i, (text, _) in enumerate(docs)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind in pii.ADDED_KINDS] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(len(v) for v in got.values())
    right = sum(span in docs[i][1] for i, spans in got.items() for span in spans)
    silent = sum(span in docs[i][1] for i, spans in got.items() if i % 4 == 0 for span in spans)
    print(found, right, silent)
    assert right > 600 and silent > 150 and right >= 0.95 * found


def test_no_combination_is_left_out_of_training(spark):
    """Training that reads few combinations at once equals that which reads all."""
    texts = [(i, announced(i)[0]) for i in range(200)]
    proposed = pii.propose(spark.createDataFrame(texts, "doc_id long, text string")).localCheckpoint()
    whole, spread = pii.train(proposed), pii.train(proposed, 5)
    assert whole.thresholds.keys() == spread.thresholds.keys() and len(whole.thresholds) >= 2
    assert all(abs(whole.thresholds[k] - spread.thresholds[k]) < 1e-6 for k in whole.thresholds)
    spans = proposed.select(pii.F.explode("found").alias("s")).select("s.*")
    differ = spans.where(pii.F.abs(whole.score(spans) - spread.score(spans)) > 1e-6).count()
    assert differ == 0 and spans.count() >= 1000
    assert pii.train(proposed.withColumn("found", pii.F.filter("found", lambda x: ~x["ok"])), 5) is None


def test_trees_decide(spark):
    """Formats that nothing ever announces are not found; without the trees' threshold they would be."""
    rows = [(i, f"call 555-{1000 + i} now, item {1000000 + i} of 2024-01-{10 + i % 20}") for i in range(60)] + [(99, "say 555-4321 twice")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] == ["number"] and all(got[i] == ["number"] for i in range(60))


def test_many_spans_in_one_text(spark):
    text = "1.2.3.4 a@b.cd " * 20_000
    began = time.perf_counter()
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert len(row.spans) == 40_000 and (row.spans[-1].start, row.spans[-1].end) == (len(text) - 7, len(text) - 1)
    print(time.perf_counter() - began)
    assert time.perf_counter() - began < 60


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op7_personal_data(spark, sf_dir).collect()
    assert len(rows) == len(texts) and sum(r.n_phone for r in rows) > 0
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.BASE_KINDS)
