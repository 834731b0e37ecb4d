"""Names, roles and failing evaluators by hand."""

import pytest
from pyspark.sql import functions as F

from campaignlens.operators import candidates, scoring


def test_identifier_words(spark):
    names = [("XMLParser2_buf",), ("filePath",), ("__n",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(names, "n string").select(candidates.identifier_words(F.col("n"))).collect()]
    assert got == [["xml", "parser", "2", "buf"], ["file", "path"], ["n"], [], []]


PARAM = "function_id long, pos int, name string, base_type string, depth int, is_struct boolean"


def test_byte_streams(spark):
    given = [
        (1, 0, "payload", "void", 1, False), (1, 1, "opts", "T", 0, True), (1, 2, "nbytes", "size_t", 0, False),  # a buffer's name, a length somewhere
        (2, 0, "thing", "void", 1, False), (2, 1, "Len", "long", 0, False),  # right before a length
        (3, 0, "thing", "void", 1, False), (3, 1, "flag", "int", 0, False), (3, 2, "len", "int", 0, False),  # neither
        (4, 0, "user_data", "void", 1, False), (4, 1, "len", "int", 0, False),  # a cookie
        (5, 0, "input", "void", 1, False), (5, 1, "len", "double", 0, False),  # no length
        (6, 0, "name", "signed char", 1, False), (6, 1, None, "int8_t", 2, False), (6, 2, "c", "char", 0, False), (6, 3, "v", None, 1, False),
    ]
    got = candidates.byte_streams(spark.createDataFrame(given, PARAM)).collect()
    assert sorted((r.function_id, r.pos) for r in got) == [(1, 0), (2, 0), (6, 0), (6, 1)]


def test_function_roles(spark):
    given = [(1, "ImageCreate", True, None), (2, "pool_free_all", None, True), (3, "resetAll", False, False), (4, "convert", None, True), (5, "peek", True, None), (6, None, None, None), (7, "destroy_freelist", None, True)]
    got = {r.function_id: tuple(r)[1:] for r in candidates.function_roles(spark.createDataFrame(given, "function_id long, name string, returns_struct boolean, takes_struct boolean")).collect()}
    assert got == {1: ("allocate", False, True), 2: ("free", False, True), 3: ("init", False, False), 4: ("transform", True, False), 5: ("read", True, False), 6: ("process", False, False), 7: ("cleanup", False, True)}


def test_a_failing_evaluator_is_an_error_row(spark):
    ids = spark.createDataFrame([(1,), (2,), (2,)], "candidate long")
    scores = spark.createDataFrame([(1, 0.5), (3, 0.1), (2, None)], "candidate long, score double")

    def broken():
        raise OSError("no probe")

    made = {"a": lambda: scores, "b": lambda: scores.select("candidate", "missing"), "c": broken, "d": lambda: scores.select("candidate")}
    got = sorted((r.candidate, r.metric, r.status, r.score) for r in scoring.evaluation_report(ids, made, ("a", "b", "c", "d", "e")).collect())
    assert got == [(1, "a", "measured", 0.5)] + [(1, m, "error", None) for m in "bcd"] + [(1, "e", "not_implemented", None), (2, "a", "unavailable", None)] + [(2, m, "error", None) for m in "bcd"] + [(2, "e", "not_implemented", None)]
    assert {r.status for r in scoring.evaluation_report(ids, {}, ("a",)).collect()} == {"not_implemented"}
    with pytest.raises(ValueError, match="unknown"):
        scoring.evaluation_report(ids, made, ("a",))


def test_path_kinds_and_stream_kinds(spark):
    paths = {"src/a.c": "production", "latest.c": "test", "Testing/a.c": "test", "check/a.c": "test", "checks/a.c": "production", "demo/a.c": "example", "src/my_sample.tar.c": "example", "contest/x.c": "production", "a/tests": "test", ".demo": "example"}
    df = spark.createDataFrame(list(paths.items()), "path string, want string")
    assert [r.path for r in df.where(~candidates.path_kind(F.col("path")).eqNullSafe(F.col("want"))).collect()] == []
    functions = spark.createDataFrame([(1, "parse_it", False), (2, "make", False), (3, None, None)], "function_id int, name string, returns_struct boolean")
    rows = [
        (1, 0, "errmsg", "char", 1, False, False), (1, 1, "text", "char", 1, False, True), (1, 2, "result", "char", 1, False, True), (2, 0, "p", "void", 1, False, False), (2, 1, "len", "int", 0, False, False),
        (2, 2, "user_data", "char", 1, False, False), (2, 3, "data", "uint8_t", 2, False, False), (3, 0, None, "char", 1, True, False), (3, 1, "filename", "char", 1, False, True), (3, 2, "q", "void", 1, False, False),
    ]
    params = spark.createDataFrame(rows, "function_id int, pos int, name string, base_type string, depth int, is_struct boolean, is_const boolean")
    got = {(r.function_id, r.pos): (r.kind, r.accepted) for r in candidates.stream_kinds(functions, params).collect()}
    assert got == {
        (1, 0): ("other", False), (1, 1): ("text", True), (1, 2): ("text", False), (2, 0): ("binary", True), (2, 2): ("text", False), (2, 3): ("binary", True), (3, 0): ("struct", False), (3, 1): ("filename", False),
    }
    found = {r.function_id: (r.isf, r.streams, r.prf, r.struct_parameters, r.return_struct) for r in candidates.candidate_records(functions.select("function_id", F.when(F.col("function_id") == 1, "S").alias("return_struct")), params).collect()}
    assert found == {1: (True, [0, 1, 2], True, [], "S"), 2: (True, [0, 2, 3], False, [], None), 3: (True, [0, 1], True, [0], None)}
