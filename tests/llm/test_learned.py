"""Held-out accuracy of the trained operators."""

from campaignlens.llm import quality, queries, toxicity


def accuracy(spark, sf_dir, name, label):
    rows = queries.QUERIES[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 for r in rows)
    one = [r.predicted for r in held if r[label] == 1]
    zero = [r.predicted for r in held if r[label] == 0]
    return sum(one) / len(one), 1 - sum(zero) / len(zero)


def test_quality(spark, sf_dir):
    good, bad = accuracy(spark, sf_dir, "op8_quality", "quality")
    print(good, bad)
    assert good > 0.95 and bad > 0.8


def test_toxicity(spark, sf_dir):
    toxic, clean = accuracy(spark, sf_dir, "op10_toxicity", "toxic")
    print(toxic, clean)
    assert toxic > 0.8 and clean > 0.97


def test_no_labels_and_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 7.0), (2, "", 7.0), (2, "", 7.0), (3, "word " * 200_000, 7.0), (None, "x. y", 7.0)], "doc_id long, text string, Score double")
    labels = spark.createDataFrame([(1, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r.score for r in quality.score_quality(docs, quality.train_quality(docs, labels)).collect()] == [0.5] * 5
    assert [r.score for r in toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels)).collect()] == [0.0] * 5
    model = quality.fit_non_negative(quality.np.zeros((3, 18)), quality.np.ones((3, 18)), 0.5)
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, model).collect())
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_offending_sentence():
    docs = [[[1], [2], [k + 10]] for k in range(20)] + [[[1], [k + 10]] for k in range(20)]
    array = quality.np.array
    model = toxicity.fit_noisy_or([array([s for x in d for s in x]) for d in docs], [array([len(x) for x in d]) for d in docs], array([1] * 20 + [0] * 20))
    assert max(model.by_slot, key=model.by_slot.get) == 2
    word = toxicity.ToxicityModel({toxicity.slots("bad")[0]: 9.0}, -5.0)
    score, found = word.scorer()("All fine. Quite BAD here! Ok")
    assert score > 0.9 and [(a, b) for a, b, _ in found] == [(9, 24)]


def numeric(f, at, step=1e-6):
    np = quality.np
    return np.array([(f(at + step * e) - f(at - step * e)) / (2 * step) for e in np.eye(len(at))])


def test_gradients():
    np = quality.np
    rng = np.random.default_rng(3)
    p, u = rng.random((7, 4)), rng.random((9, 4))
    for prior, back in ((0.3, False), (0.98, True)):
        w = np.append(rng.standard_normal(4), -3.0 if back else 0.2)
        if back:
            w[:-1], p[:, 0] = [9, 0, 0, 0], 1.0
            u = u * [0.2, 1, 1, 1]
        got = quality.risks(p, u, w[:-1], w[-1], prior)
        assert (got[1] < 0) == back
        loss = (lambda x: -quality.risks(p, u, x[:-1], x[-1], prior)[1]) if back else (lambda x: sum(quality.risks(p, u, x[:-1], x[-1], prior)[:2]))
        assert np.allclose(numeric(loss, w), got[2], atol=1e-6)
    place, sentence, doc = np.array([0, 1, 2, 1, 0]), np.array([0, 0, 1, 2, 3]), np.array([0, 0, 1, 2])
    labels, share = np.array([1, 0, 1]), np.array([0.5, 0.2, 0.3])
    w = np.array([0.4, 1.2, -0.3, -1.0])
    f = lambda x: toxicity.noisy_or_step(place, sentence, doc, x, labels, share)[0]
    assert np.allclose(numeric(f, w), toxicity.noisy_or_step(place, sentence, doc, w, labels, share)[1], atol=1e-6)


def test_prior_from_positives_and_unlabelled_rows():
    np = quality.np
    rng = np.random.default_rng(4)
    of = lambda n, at: rng.normal(at, 1, (n, 3))
    for prior in (0.2, 0.5, 0.85):
        n = int(4000 * prior)
        found = quality.estimate_prior(of(2000, 2.5), rng.permutation(np.concatenate([of(n, 2.5), of(4000 - n, -2.5)])))
        assert abs(found - prior) < 0.06, (prior, found)
    assert quality.estimate_prior(of(2, 0), of(2, 0)) == 0.5


def test_estimated_prior_is_near_the_share_of_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").dropna(subset=["quality"])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id").collect()
    x = quality.np.array([quality.features(r.text) for r in docs])
    y = quality.np.array([r.quality for r in docs])
    assert abs(quality.estimate_prior(x[y == 1], x) - y.mean()) < 0.12


def test_every_document_is_scored_as_plain_python_scores_it(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = quality.train_quality(docs, labels)
    for r in quality.score_quality(docs, model).collect():
        assert abs(r.score - float(model.score(quality.np.array([quality.features(texts[r.doc_id])]))[0])) < 1e-9
    model = toxicity.train_toxicity(docs, labels)
    for r in toxicity.score_toxicity(docs, model).collect():
        clean = 1.0
        for sentence in toxicity.re.split(r"[.!?\n]+", texts[r.doc_id]):
            if sentence:
                z = model.bias + sum(model.by_slot.get(s, 0.0) for w in {w.lower() for w in toxicity.WORD.findall(sentence)} for s in toxicity.slots(w))
                clean *= 1 - 1 / (1 + toxicity.math.exp(-min(max(z, -30.0), 30.0)))
        assert abs(r.score - (1 - clean)) < 1e-6


def test_samples_are_the_smallest_hashes(spark):
    df = spark.range(5000).selectExpr("id", "id % 7 AS other").union(spark.sql("SELECT NULL, 1"))
    want = [r.id for r in df.orderBy(quality.F.xxhash64("id"), "id").limit(300).collect()]
    assert [r.id for r in quality.first_by_hash(df, "id", 300).collect()] == want
    assert quality.first_by_hash(df.limit(0), "id", 3).count() == 0 and quality.first_by_hash(df, "id", 9000).count() == 5001


def test_bounded_bytes_of_training_text(spark):
    rows = [(i, ("bad word here. " if i % 2 else "fine thing. ") * (1 + i % 5)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    assert toxicity.train_toxicity(docs, labels, class_bytes=1500).by_slot and toxicity.train_toxicity(docs, labels, class_bytes=3) is None
    assert toxicity.train_toxicity(docs, labels.limit(0)) is None


def test_training_sample_is_bounded_by_distinct_ids(spark, monkeypatch):
    rows = [(i, f"some words of document {i} here") for i in range(40)] + [(7, f"another text {i % 3}") for i in range(400)] + [(None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40, 3)] + [(7, 1)] * 50 + [(99, 1), (None, 1), (8, None)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_non_negative", lambda p, u, prior: seen.append((len(p), len(u))))
    quality.train_quality(docs, labels)
    quality.train_quality(docs, labels, positives=3, unlabelled=5, prior=0.5)
    assert seen[0] == (15, 40) and seen[1][0] <= 3 and seen[1][1] == 5
    assert quality.train_quality(docs.limit(0), labels) is None and quality.train_quality(docs, labels.limit(0)) is None
    assert len(seen) == 2


def test_many_empty_texts_of_one_id_are_bounded(spark):
    docs = spark.createDataFrame([(1, None)] * 300 + [(2, "bad")] + [(i, "fine") for i in range(3, 20)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)] + [(i, 0) for i in range(3, 20)], "doc_id long, toxic int")
    sizes = []
    real, toxicity.fit_noisy_or = toxicity.fit_noisy_or, lambda flats, *_: sizes.append(len(flats))
    try:
        toxicity.train_toxicity(docs, labels, class_bytes=100)
    finally:
        toxicity.fit_noisy_or = real
    assert len(sizes) == 1 and 2 <= sizes[0] <= 18
