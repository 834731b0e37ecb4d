"""Fields of message frames from what a handler loads and compares, and their differences from a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that fields get from their role; a magic field gets a running number too.
NAMES = {"version": "version", "opcode": "opcode", "payload_length": "payload_length", "checksum": "checksum", "payload": "payload"}


def frame_fields(loads: DataFrame, literals: DataFrame, checksums: DataFrame, lengths: DataFrame, dispatch: DataFrame, payloads: DataFrame) -> DataFrame:
    """(handler, at, width, role, value, name): the fields of each handler's frame by offset.

    ``loads`` (handler, at, width, value) win over ``literals`` (handler, at, value, is_magic) of the same offset. A load is a checksum, else a length, else the
    opcode, if its offset is one of ``checksums``, ``lengths`` or ``dispatch`` (each handler, at), else unknown. A literal is the opcode, else magic, else the version. Magic fields
    are numbered by offset. The offset of ``payloads`` is a field of variable width (-1) beside any other there; a dispatch offset that is neither loaded nor compared is an opcode of width 1.
    Of several rows of an offset the least value counts.
    """
    key = ["handler", "at"]
    flags = [(checksums, "is_checksum"), (lengths, "is_length"), (dispatch, "is_dispatch")]
    load = loads.groupBy(*key).agg(F.min(F.struct("value", "width")).alias("load"))
    literal = literals.groupBy(*key).agg(F.min("value").alias("literal"), F.bool_or("is_magic").alias("is_magic"))
    rows = load.join(literal, key, "full")
    for marks, name in flags:
        rows = rows.join(marks.select(*key).distinct().withColumn(name, F.lit(True)), key, "full" if name == "is_dispatch" else "left")
    loaded, compared = F.col("load").isNotNull(), F.col("literal").isNotNull()
    role = (
        F.when(loaded & F.col("is_checksum"), "checksum").when(loaded & F.col("is_length"), "payload_length").when(F.col("is_dispatch"), "opcode")
        .when(loaded, "unknown").when(F.col("is_magic"), "magic").otherwise("version")
    )
    rows = rows.select(*key, F.when(loaded, F.col("load.width")).otherwise(1).alias("width"), role.alias("role"), F.when(loaded, F.col("load.value")).when(compared, F.col("literal")).alias("value"))
    rows = rows.unionByName(payloads.select(*key, F.lit(-1).alias("width"), F.lit("payload").alias("role"), F.lit(None).cast(rows.schema["value"].dataType).alias("value")).distinct())
    order = Window.partitionBy("handler").orderBy("at", "width").rowsBetween(Window.unboundedPreceding, 0)
    number = F.count_if(F.col("role") == "magic").over(order) - 1
    fixed = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return rows.withColumn("name", F.when(F.col("role") == "magic", F.concat(F.lit("magic"), number.cast("string"))).otherwise(F.coalesce(F.element_at(fixed, F.col("role")), F.concat(F.lit("field_"), F.col("at").cast("string")))))


def positions(fields: DataFrame) -> DataFrame:
    """A handler's fields as one array by offset, a payload last of its offset."""
    return fields.groupBy("handler").agg(F.sort_array(F.collect_list(F.struct("at", F.when(F.col("width") < 0, 1).otherwise(0).alias("late"), "role", "width", "value", "name"))).alias("fields"))


def contract_differences(plans: DataFrame, contracts: DataFrame) -> DataFrame:
    """(handler, position, key, actual, wanted) of each difference between the fields of a plan and of the contract, both as ``frame_fields`` gives them.

    Fields are compared in turn. A role, offset or width must be equal; a value only where the contract states one, a name only where the plan does.
    Frames of unequal length are one difference, in the lists of their roles, as is a plan that is missing. Plans without a contract are left out.
    """
    both = positions(contracts).withColumnRenamed("fields", "wanted").join(positions(plans).withColumnRenamed("fields", "actual"), "handler", "left")
    roles = lambda c: F.array_join(F.transform(c, lambda f: f["role"]), ",")
    same = F.size("wanted") == F.coalesce(F.size("actual"), F.lit(0))
    whole = both.where(~same).select("handler", F.lit(None).cast("int").alias("position"), F.lit("fields").alias("key"), roles("actual").alias("actual"), roles("wanted").alias("wanted"))
    pairs = both.where(same).select("handler", F.posexplode(F.arrays_zip("actual", "wanted")).alias("position", "f")).select("handler", "position", F.col("f.actual").alias("a"), F.col("f.wanted").alias("w"))
    text = lambda side, name: F.col(f"{side}.{name}").cast("string")

    def differs(name: str, asked: Column) -> Column:
        return F.when(asked & ~text("a", name).eqNullSafe(text("w", name)), F.struct(F.lit(name).alias("key"), text("a", name).alias("actual"), text("w", name).alias("wanted")))

    found = F.array_compact(
        F.array(*[differs(n, F.lit(True)) for n in ("role", "at", "width")], differs("value", F.col("w.value").isNotNull()), differs("name", F.col("a.name").isNotNull()))
    )
    return pairs.select("handler", "position", F.inline(found)).unionByName(whole)
