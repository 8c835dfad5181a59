"""Mixing sources to target weights by systematic sampling.

Every document of a source expects target / source size copies. Documents of a source stand in a fixed order (by size, so
that the sample takes its share of short and long ones), their expected copies are added up along it, and one random offset is
added: a document is emitted once for each integer the running total crosses at it.

A source may hold any share of all rows, so its running total is never one task's window: narrow rows are
range-partitioned by (source, size, hash), counted per range, and numbered inside ranges. Table work only, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.llm.common import WORD
from contrapair.session import materialise, scratch


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_hash(text: Column) -> Column:
    """60 bits of the text's MD5, a number that SQL engines agree on."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) with the words each source is to give.

    Sources by code point, null last, take the weights in turn. All targets together are ``share`` of all sizes; a target
    stops at ``most`` times its source's size, and what is above is shared again by weight until none is. Water finds
    its level: sources sorted by how soon they fill up are full as long as the level of the rest lies above them.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("place", place).withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("most") / F.col("weight"), "place")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("full_before", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("left", F.sum("weight").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
                     - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    everything = F.sum("source_size").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s = s.withColumn("level", (F.lit(float(share)) * everything - F.col("full_before")) / F.col("left"))
    rest = F.col("most") / F.col("weight") > F.col("level")
    settled = F.min(F.when(rest, F.struct(F.col("most") / F.col("weight"), "place", "level"))).over(
        Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    return s.select("source", "source_size", F.coalesce(F.least("most", F.col("weight") * settled), F.col("most")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, *,
        weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """How often the mix takes each document: id, source, size, source_size, target, copies, taken (copies * size).

    One row per input row; ``size`` defaults to the words of the column ``text``.

    * Null and empty texts have size 0 and take copies like others, of no words. A source of size 0 has target 0 and no copies.
    * A null source is a source of its own, after all others; an empty string is a source, too.
    * Rows with equal ids are ordered among themselves arbitrarily but their results, as a multiset, are always the same;
      a null id counts as an id. An empty table gives no rows; other columns are not looked at.
    * The offset and the order come from hashes of source and id with ``seed``: reruns agree.
    """
    size = word_count(F.col("text")) if size is None else size
    taken = place_copies(docs, id_col, source_col, size, weights, share, most, seed)
    return taken.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def place_copies(docs: DataFrame, id_col: str, source_col: str, size: Column, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                 most: float = 2.0, seed: str = "mix", carry: dict[str, Column] | None = None) -> DataFrame:
    """What ``mix`` gives, with the columns ``carry``; the first of these orders rows that are equal in source, size and id."""
    carry = carry or {}
    order = ["size", "h", *list(carry)[:1]]
    h = text_hash(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    offset = text_hash(F.concat(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("")))) / F.lit(float(1 << 60))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    with scratch(docs.sparkSession) as tables:
        rows = materialise(docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), h.alias("h"),
            *[c.alias(name) for name, c in carry.items()]))
        aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        aims = aims.withColumn("rate", rate).withColumn("offset", offset)
        placed = tables.keep(rows.repartitionByRange("source", *order).withColumn("range", F.spark_partition_id()))
        held = placed.groupBy("source", "range").agg(F.count("*").alias("n"))
        # a range with smaller number holds smaller keys, so a source's earlier documents
        before = held.withColumn("before", F.coalesce(F.sum("n").over(
            Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        facts = tables.keep(before.drop("n").withColumnRenamed("source", "s").join(
            aims.withColumnRenamed("source", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2").withColumnRenamed("range", "r"))
    inside = F.row_number().over(Window.partitionBy("range", "source").orderBy(*order))
    numbered = placed.withColumn("inside", inside).join(
        facts, (F.col("range") == F.col("r")) & F.col("source").eqNullSafe(F.col("s")))
    k = F.col("before") + F.col("inside")
    crossed = F.floor(F.col("rate") * k + F.col("offset")) - F.floor(F.col("rate") * (k - 1) + F.col("offset"))
    copies = F.least(crossed, F.lit(int(-(-most // 1)))).cast("long")
    return numbered.select("id", "source", "size", "source_size", "target", copies.alias("copies"), *carry)


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row as often as ``mix`` takes it, with all its columns.

    Rows are numbered as they are written, and the copies are placed on numbers without texts: a text is moved once, to the copies of
    its number. So rows are not found again by id, and null and repeated ids are rows of their own source.
    """
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(names)])
    text = F.col(f"`{text_col}`")
    with scratch(docs.sparkSession) as tables:
        rows = tables.keep(docs.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                                       word_count(text).alias("size"), F.xxhash64(text).alias("tie"), row.alias("row")))
        taken = place_copies(rows, "id", "source", F.col("size"), carry={"tie": F.col("tie"), "at": F.col("at")}, **options)
        taken = tables.keep(taken.where("copies > 0").select("at", "copies"))
    # numbers in sequence take far less in a file than in memory, so the file's size must not choose a broadcast
    both = rows.select("at", "row").join(taken.hint("merge"), "at").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return both.select(*[F.col("row").getField(f"c{n}").alias(c) for n, c in enumerate(names)])
