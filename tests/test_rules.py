"""Type names, frames, argument sources, guards and windows by hand."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from campaignlens import streaming as ST
from campaignlens.operators import closure, conformance, frames, typedefs

rows = lambda df: sorted(map(tuple, df.collect()), key=str)


def follow(links, name):
    depth, const, seen = 0, False, set()
    while name in links:
        if name in seen:
            return None, 0, False
        seen.add(name)
        name, d, c = links[name]
        depth, const = depth + d, const or c
    return name, depth, const


def test_typedef_chains(spark):
    rnd = random.Random(1)
    links = {f"n{i}": (f"n{rnd.randrange(60)}", rnd.randrange(3), rnd.random() < 0.2) for i in range(40)}
    links |= {f"c{i}": (f"c{i + 1}", 1, i == 30) for i in range(70)} | {"h": ("n0", 1, False)}
    aliases = spark.createDataFrame([(n, *v) for n, v in links.items()] + [(None, "x", 1, True), ("c3", "zz", 1, True), ("y", None, 0, False)], "name string, target string, depth int, is_const boolean")
    handles = spark.createDataFrame([("c70", 2), ("h", 1)], "name string, depth int")
    structs = spark.createDataFrame([("n55", "Canon"), ("n50", "n50")], "name string, canonical string")
    got = {r.name: tuple(r)[1:] for r in typedefs.typedef_details(aliases, handles, structs).collect()}
    del links["h"]
    assert set(got) == set(links)
    for name in links:
        base, depth, const = follow(links, name)
        opaque, struct = base == "c70", base in ("n55", "n50", "c70")
        assert got[name] == ({"n55": "Canon"}.get(base, base), depth + 2 * opaque, opaque, struct, const), name
    assert typedefs.typedef_details(aliases.limit(0), handles, structs).isEmpty()


def test_struct_groups(spark):
    data = [(1, "A", ["a", "x"], "struct A;"), (2, "B", ["b", "y"], "  typedef struct B"), (3, "C", ["x", "y"], "struct C {"), (4, "D", None, "typedef D {"), (5, "E", ["e"], None), (6, "F", ["e", None], "struct F")]
    df = spark.createDataFrame(data, "id int, name string, aliases array<string>, declaration string")
    assert rows(typedefs.struct_groups(df)) == [(1, "A", "B", 3), (2, "B", "B", 3), (3, "C", "B", 3), (4, "D", "D", 4), (5, "E", "E", 5), (6, "F", "E", 5)]
    assert typedefs.struct_groups(df.limit(0)).isEmpty()


def test_argument_sources(spark):
    flows = spark.createDataFrame([(1, "in", "a"), (1, "a", "b"), (1, "n", "b"), (1, "b", "a"), (2, "in", "z"), (1, None, "q")], "caller int, src string, dst string")
    inputs = spark.createDataFrame([(1, "in", "data"), (1, "n", "size"), (None, "b", "data")], "caller int, name string, label string")
    arguments = spark.createDataFrame([(1, "f", "a"), (1, "g", "n"), (1, "h", "q"), (2, "f", "z")], "caller int, call string, name string")
    assert rows(closure.argument_sources(flows, inputs, arguments)) == [(1, "f", "data,size"), (1, "g", "size"), (1, "h", ""), (2, "f", "")]
    assert rows(closure.argument_sources(flows.limit(0), inputs, arguments))[0] == (1, "f", "")


def test_frame_fields_and_their_differences(spark):
    at = lambda *places: spark.createDataFrame([("h", p) for p in places], "handler string, at int")
    loads = spark.createDataFrame([("h", 4, 4, 9), ("h", 8, 2, 1), ("h", 12, 4, 3), ("h", 0, 1, 7)], "handler string, at int, width int, value int")
    literals = spark.createDataFrame([("h", 0, 77, True), ("h", 1, 78, True), ("h", 2, 79, True), ("h", 3, 1, False), ("h", 5, 5, True)], "handler string, at int, value int, is_magic boolean")
    found = frames.frame_fields(loads, literals, at(4), at(4, 8), at(5), at(16))
    want = [
        ("h", 0, 1, "unknown", 7, "field_0"), ("h", 1, 1, "magic", 78, "magic0"), ("h", 2, 1, "magic", 79, "magic1"), ("h", 3, 1, "version", 1, "version"), ("h", 4, 4, "checksum", 9, "checksum"),
        ("h", 5, 1, "opcode", 5, "opcode"), ("h", 8, 2, "payload_length", 1, "payload_length"), ("h", 12, 4, "unknown", 3, "field_12"), ("h", 16, -1, "payload", None, "payload"),
    ]
    assert [tuple(r) for r in found.orderBy("at").collect()] == want
    assert ("h", 30, 1, "opcode", None, "opcode") in rows(frames.frame_fields(loads, literals, at(), at(), at(30), at()))
    plan = found.withColumn("role", F.when(F.col("at") == 3, "magic").otherwise(F.col("role"))).withColumn("value", F.when(F.col("at") != 2, F.col("value"))).withColumn("name", F.when(F.col("at") != 4, F.col("name")).otherwise(F.lit("sum")))
    contract = found.withColumn("value", F.when(F.col("at") < 5, F.col("value")))
    assert rows(frames.contract_differences(plan, contract)) == [("h", 2, "value", None, "79"), ("h", 3, "role", "magic", "version"), ("h", 4, "name", "sum", "checksum")]
    assert rows(frames.contract_differences(plan.where("at > 0"), contract))[0][:3] == ("h", None, "fields")
    assert rows(frames.contract_differences(plan.limit(0), contract))[0][3] is None and frames.contract_differences(plan, contract.limit(0)).isEmpty()


def test_null_guards(spark):
    yes = ["p != NULL", "(p!=0)", "NULL != p", "0 < p", "p > 0", "p", " ( p ) ", "nullptr!=p"]
    no = ["p == NULL", "q != NULL", "p != 1", "pp", "", "p != NULL && q", None]
    df = spark.createDataFrame([(c, "p") for c in yes + no], "c string, i string")
    assert [r.g for r in df.select(conformance.non_null_guard(F.col("c"), F.col("i")).alias("g")).collect()] == [True] * len(yes) + [False] * len(no)


def test_late_lines_are_counted(spark, tmp_path):
    base = datetime(2024, 1, 1)
    part = lambda *minutes: spark.createDataFrame([(base + timedelta(minutes=m), 1, f"cov: {m}") for m in minutes], "ts timestamp, run long, line string")
    got = ST.windows_in_time([part(1, 2, 95), part(3, 31, 200), part(32, 150, 201)], str(tmp_path / "w"))
    found = {int((r.start - base).total_seconds() // 60): (r.n, r.cov, r.late, r.state) for r in got.collect()}
    # after the first part the watermark is at minute 35, after the second at 140
    assert found == {0: (2, 2, 1, "closed"), 30: (1, 31, 1, "closed"), 90: (1, 95, 0, "closed"), 150: (1, 150, 0, "open"), 200: (2, 201, 0, "open")}
    items = spark.createDataFrame([(base, "a"), (base + timedelta(1), "b"), (base, "a")], "ts timestamp, artefact string")
    assert rows(ST.copies_of([items, items.where("artefact = 'a'")], str(tmp_path / "c")).select("artefact", "copies")) == [("a", 4), ("b", 1)]
