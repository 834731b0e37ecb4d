"""Analysers, policies, sequences and files by hand."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from campaignlens.operators import analysis as A
from campaignlens.operators import policies as P
from campaignlens.operators import sequences as Q
from campaignlens.operators import telemetry as T
from campaignlens.sources import readers as R

rows = lambda df: sorted(map(tuple, df.collect()), key=str)


class Odd:
    def stream_parameter(self, row, variant):
        if row["id"] == 1:
            raise ValueError
        if row["id"] == 2:
            return {"confidence": True}
        if row["id"] == 3 and variant == "yes_no":
            return {"is_byte_stream": False, "kind": "text", "confidence": 0.5}
        if row["id"] == 5:
            return {"is_byte_stream": True, "kind": "other", "confidence": 1}
        return {"is_byte_stream": True, "kind": "binary", "confidence": 1}

    def usage_patterns(self, batch):
        assert len(batch) <= 12 and len({r["kind"] for r in batch}) == 1
        if any(r["id"] == 13 for r in batch):
            raise OSError
        return [{"confidence": 0.5, "id": r["id"]} for r in batch]


class Stopping:
    def function_role(self, row):
        raise A.AnalysisStopped("budget")


def test_failed_rows_are_decisions_of_no_confidence(spark):
    df = spark.createDataFrame([(i, "urlPath" if i == 4 else "data", "x") for i in range(6)], "id long, name string, Status string")
    decided = A.decide(df, Odd, "stream_parameter", A.VARIANTS)
    assert decided.columns == ["id", "name", "variant", "data", "confidence", "status", "error"] and decided.count() == 18
    assert {(r.id, r.error) for r in decided.where("status = 'error'").collect()} == {(1, "ValueError"), (2, "TypeError")}
    assert all(json.loads(r.data)["kind"] == "other" and r.confidence == 0.0 for r in decided.where("status = 'error'").collect())
    assert rows(A.stream_votes(decided, ["id"])) == [
        (0, True, "binary", 1.0, 3, 3, "votes"), (1, False, "other", 0.0, 0, 0, "unavailable"), (2, False, "other", 0.0, 0, 0, "unavailable"),
        (3, True, "binary", 0.833333, 2, 3, "votes"), (4, False, "binary", 1.0, 0, 3, "name"), (5, False, "other", 1.0, 0, 3, "object kind"),
    ]
    assert A.decide(df.limit(0), Odd, "stream_parameter").count() == 0
    with pytest.raises(Exception, match="budget"):
        A.decide(df, Stopping, "function_role").collect()


def test_equal_questions_are_asked_once(spark, tmp_path):
    class Noting(Odd):
        def stream_parameter(self, row, variant):
            (tmp_path / __import__("uuid").uuid4().hex).touch()
            return super().stream_parameter(row, variant)

    df = spark.createDataFrame([(i, i % 6 or None, "data" if i % 2 else None) for i in range(60)], "item long, id long, name string").where("id IS NOT NULL")
    want = rows(A.stream_votes(A.decide(df, Odd, "stream_parameter", A.VARIANTS), ["item"]))
    assert rows(A.votes_by_question(df, Noting, ["item"], ["id", "name"])) == want and len(want) == 50
    assert len(list(tmp_path.iterdir())) == 5 * len(A.VARIANTS)


def test_failed_batches_are_halved(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b") for i in range(40)], "id long, kind string")
    got = A.review_patterns(df, Odd, group="kind", key="id").collect()
    assert sorted(r.id for r in got) == list(range(40))
    assert [(r.id, r.error, r.confidence) for r in got if r.status == "error"] == [(13, "OSError", 0.0)]
    assert all(json.loads(r.data)["id"] == r.id for r in got if r.status == "ok")
    assert A.review_patterns(df.limit(0), Odd, group="kind", key="id").count() == 0


def test_weights_are_checked(spark):
    for wrong in ({"new": 1.0}, {"a": 0}, {"a": -1.0}, {"a": True}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            P.weight_table(spark, wrong, ("a", "b"))
    metrics = spark.createDataFrame([(1, "a", "measured", 0.5, None), (1, "b", "measured", 1.0, None), (2, "a", "error", None, None), (3, "b", "unavailable", None, None)], "candidate long, metric string, status string, score double, weight double")
    assert rows(P.weighted(P.weight_table(spark, {"a": 3.0}, ("a", "b")))(metrics)) == [(1, 0.625, "eligible"), (2, None, "insufficient_evidence"), (3, None, "insufficient_evidence")]
    assert rows(P.weighted(least=3)(metrics))[0] == (1, None, "insufficient_evidence")
    names = spark.createDataFrame([(1, "x"), (2, "y")], "candidate long, artefact string")
    assert rows(P.plan_round(metrics, names, P.Policies("p"), 5, 3)) == [("p", "1", 1, 1, 0.75, 1, 1)]
    with pytest.raises(ValueError):
        P.compare_policies(metrics, names, [P.Policies("p"), P.Policies("p")], 5, 3)
    with pytest.raises(ValueError):
        P.plan_round(metrics, names, P.Policies("p"), 0, 3)


def plain(candidate, source):
    it = iter(source)
    return all(x in it for x in candidate)


def test_random_sequences(spark):
    rnd = random.Random(3)
    data = []
    for i in range(300):
        seq = [rnd.randrange(5) for _ in range(rnd.randrange(9))]
        required = [x for x in seq if rnd.random() < 0.7] if rnd.random() < 0.7 else [rnd.randrange(5) for _ in range(rnd.randrange(5))]
        data.append((i, seq, required, seq[0] if seq else None, seq[-1] if seq else 3, [x for x in seq if x < 2], [rnd.randrange(5) for _ in range(rnd.randrange(3))]))
    data.append((300, None, None, None, None, None, None))
    df = spark.createDataFrame(data, "id int, sequence array<int>, required array<int>, producer int, cleanup int, fixed array<int>, optional array<int>")
    seen = 0
    for r in Q.safe_reviews(df).collect():
        _, seq, req, first, last, fixed, optional = data[r.id]
        want = (False,) * 4 if seq is None else (
            plain(req, seq), bool(req) and req[0] == first and req[-1] == last, all(req.count(x) >= seq.count(x) for x in fixed), all(x in seq for x in optional)
        )
        assert (r.is_subsequence, r.ends, r.counts, r.known) == want and r.safe == all(want), (r, want)
        seen += r.safe
    assert 20 < seen < 280


def test_files(spark, tmp_path):
    (tmp_path / "src/deep").mkdir(parents=True)
    (tmp_path / "tests_old").mkdir()
    (tmp_path / "src/build").mkdir()
    for name, text in {"src/a.C": "one", "src/deep/b.h": "two", "src/deep/harness.c": "no", "tests_old/c.c": "no", "src/build/d.c": "no", "src/e.txt": "one"}.items():
        (tmp_path / name).write_text(text)
    tree = R.source_tree(spark, str(tmp_path), ignored=("tests*", "buil?"))
    assert sorted((r.name, bytes(r.content).decode()) for r in tree.collect()) == [("a.C", "one"), ("b.h", "two")]
    seeds = R.seed_corpus(spark, str(tmp_path)).collect()
    assert sorted((r.copies, r.sha256) for r in seeds) == sorted((n, hashlib.sha256(t.encode()).hexdigest()) for t, n in (("one", 2), ("two", 1), ("no", 3)))
    (tmp_path / "logs").mkdir()
    lines = [f"line {i} " + "x" * (i % 90) for i in range(3000)]
    (tmp_path / "logs/run.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = R.numbered_log_lines(spark, str(tmp_path / "logs"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_no, r.line) for r in got.collect()) == list(enumerate(lines, 1))
    (tmp_path / "facts").mkdir()
    for name, text in {"a": '{"schema_version": 1, "rows": []}', "b": '{"schema_version": 2}', "c": "{}", "d": "{nothing"}.items():
        (tmp_path / f"facts/{name}.json").write_text(text)
    bad = R.rejected_documents(spark, str(tmp_path / "facts"))
    assert sorted((r.path[-6:], r.version, r.reason) for r in bad.collect()) == [("b.json", 2, "other version"), ("c.json", None, "no version"), ("d.json", None, "not readable")]


def test_statistics_of_a_log(spark):
    text = ["#2\tINITED cov: 3 ft: 4 corp: 1/1b exec/s: 0 rss: 30Mb", "#64\tpulse  cov: 9 ft: 12 corp: 5/8b lim: 4 exec/s: 32.5 crashes: 1", "#70\tRELOAD cov: 10", "stat::average_exec_per_sec:     21.75", "stat::number_of_executed_units: 900", "nothing here"]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)] + [(2, 0, "#5 DONE exec/s: 7"), (3, 0, "quiet")], "run int, line_no int, line string")
    saved = spark.createDataFrame([(1, "crash-a"), (2, "leak-b"), (2, "crash-c"), (2, "timeout-d"), (2, "other")], "run int, name string")
    assert rows(T.final_statistics(lines, saved)) == [
        (1, 10.0, 12.0, 5.0, 21.75, 900.0, 1.0, 0.0, 0.0, True), (2, None, None, None, 7.0, 5.0, 2.0, 0.0, 1.0, False), (3, None, None, None, None, None, 0.0, 0.0, 0.0, False)
    ]
    assert T.log_fields(lines).where(F.col("run") == 3).isEmpty()


def test_many_tasks_write_the_small_files(spark, sf_dir, tmp_path, monkeypatch):
    """One task a file after the other would take all of the time."""
    from campaignlens.plans import q_hooks
    from campaignlens.plans.tables import Tables

    monkeypatch.setattr(q_hooks, "folder", lambda t, name: f"{tmp_path}/{name}")
    assert q_hooks.corpus(Tables(spark, sf_dir)).count() > 1
    assert not [p for p in (tmp_path / "seeds").iterdir() if p.is_dir()]
    q_hooks.run_logs(Tables(spark, sf_dir))
    for name in ("seeds", "logs"):
        assert len({p.name.split("-")[1] for p in (tmp_path / name).rglob("part-*")}) > 4
