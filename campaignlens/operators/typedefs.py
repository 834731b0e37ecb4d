"""Type names: chains of aliases with what they hide, and groups of structure declarations that share an alias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlens.operators.graph import star_roots
from campaignlens.plans.fixpoint import written
from campaignlens.storage import discard


def folded_chains(aliases: DataFrame) -> DataFrame:
    """(name, base, depth, is_const, cyclic): where the chain of each name of (name, target, depth, is_const) ends, the sum of the depths and whether any link is const.

    Pointer doubling: each round joins every chain with the chain of where it stands, so that rounds grow with the logarithm of the longest one. A name that leads into a
    cycle has no end: its chain is longer than there are names, and rounds stop there.
    """
    now, hops = written(aliases.select("name", F.col("target").alias("base"), "depth", "is_const", F.lit(True).alias("going"))), 1
    while n := now.where("going").count():
        to = now.select(F.col("name").alias("base"), F.col("base").alias("next"), F.col("depth").alias("more"), F.col("is_const").alias("also"))
        joined = now.join(to, "base", "left")
        older, now = now, written(
            joined.select("name", F.coalesce("next", "base").alias("base"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("is_const") | F.coalesce("also", F.lit(False))).alias("is_const"), F.col("next").isNotNull().alias("going"))
        )
        discard(older)
        if hops > 2 * n:
            break
        hops *= 2
    return now.withColumnRenamed("going", "cyclic")


def typedef_details(aliases: DataFrame, handles: DataFrame, structs: DataFrame) -> DataFrame:
    """(name, base, depth, opaque, struct_like, is_const) of each aliased name.

    ``handles`` (name, depth) are opaque: their depth is added. ``structs`` (name, canonical) give the canonical name. What is a handle or structure is no alias, whatever ``aliases`` say.
    A cycle is unresolved: no base, depth 0, and nothing else true. Of several targets of a name the least counts; null depths are 0, rows without a name or target are left out.
    """
    fixed = handles.select("name").union(structs.select("name")).distinct()
    link = F.min(F.struct("target", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.coalesce("is_const", F.lit(False)).alias("is_const"))).alias("t")
    links = aliases.where("name IS NOT NULL AND target IS NOT NULL").groupBy("name").agg(link).select("name", "t.*").join(fixed, "name", "left_anti")
    ends = folded_chains(written(links))
    named = ends.join(handles.groupBy(F.col("name").alias("base")).agg(F.max("depth").alias("handle")), "base", "left").join(structs.groupBy(F.col("name").alias("base")).agg(F.min("canonical").alias("canonical")), "base", "left")
    known, opaque = ~F.col("cyclic"), F.col("handle").isNotNull()
    return named.select(
        "name",
        F.when(known, F.coalesce("canonical", "base")).alias("base"),
        F.when(known, F.col("depth") + F.coalesce("handle", F.lit(0))).otherwise(0).alias("depth"),
        (known & opaque).alias("opaque"),
        (known & (opaque | F.col("canonical").isNotNull())).alias("struct_like"),
        (known & F.col("is_const")).alias("is_const"),
    )


def struct_groups(structs: DataFrame) -> DataFrame:
    """(id, name, canonical, definition) of ``structs`` (id, name, aliases, declaration): declarations that share an alias, over others too, are one structure.

    Its canonical name is that of the first declaration that is a typedef, else of the first one; its ``definition`` is the id of the first with a body, else of the first. First is by id.
    A declaration without aliases is a group of its own.
    """
    rows = structs.select("id", "name", "aliases", F.ltrim("declaration").startswith("typedef").alias("typedef"), F.col("declaration").contains("{").alias("body"))
    ends = rows.select("id", F.explode("aliases").alias("alias")).where("alias IS NOT NULL")
    # each declaration is linked with the first one of every alias
    links = ends.join(ends.groupBy("alias").agg(F.min("id").alias("first")), "alias").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    placed = rows.join(star_roots(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    key = lambda c: F.struct((~F.coalesce(F.col(c), F.lit(False))).alias("no"), F.col("id"))
    groups = placed.groupBy("root").agg(F.min_by("name", key("typedef")).alias("canonical"), F.min_by("id", key("body")).alias("definition"))
    return placed.join(groups, "root").select("id", "name", "canonical", "definition")
