"""Filter interaction audit: what each filter removes in every order of applying them.

A document's verdicts are a mask with a bit for each filter it fails, and all that an order can remove follows from how many
documents a part has with each mask. So texts are read once, documents are counted per (part, mask), and a recursive common
table expression enumerates the orders: it extends each prefix of filters by every unused letter, joins the part's mask cells,
carries the bits applied so far, and each level of the recursion emits the metrics of that step. Table work only, no Python.

Bounds: a part has at most 2 ** filters cells, held in one row, and the recursion makes 326 rows a part for five filters. Spark
limits the rows of a recursion, so parts take turns in groups of ``PARTS`` (one for any usual number of languages).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrapair.session import materialise

#: Parts that one recursion enumerates; far below Spark's limit of a million rows at 326 rows a part.
PARTS = 1000

_BLANKS = r"[\x20\x09-\x0D]+"


def text_checks(text: Column, words: Column) -> list[Column]:
    """The contract's conditions that a text meets on its own: A few words, B few distinct ones, C many capitals, D symbols."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]


def masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, digest, mask) of each document with the bits of the text's own conditions; a narrow table."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    x = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("__text"),
                    F.array_remove(F.split(text, _BLANKS), "").alias("__words"))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(text_checks(F.col("__text"), F.col("__words")))]
    return x.select("id", "part", F.unhex(F.sha2(F.col("__text").cast("binary"), 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def marked(found: DataFrame, labels: DataFrame, id_col: str, good_col: str, toxic_col: str) -> DataFrame:
    """Beside each row whether some label of its id says good or toxic. Null ids have none."""
    said = labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id")).agg(
        F.max(F.coalesce(F.col(f"`{good_col}`") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col(f"`{toxic_col}`") == 1, F.lit(False))).alias("toxic")).where("good OR toxic")
    none = [F.lit(False).alias(c) for c in ("good", "toxic")]
    kept = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    with_id = found.where("id IS NOT NULL").join(said, "id", "left").select(*found.columns, *kept)
    return with_id.unionByName(found.where("id IS NULL").select(*found.columns, *none))


def mask_cells(found: DataFrame, repeat_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic) with the bit of repeated texts: rows whose text a smaller id has.

    Copies may be any share of all rows, so rows are first counted by id and text and then by text and part, and only
    these counts, one per text, part and label, meet to learn the smallest id.
    """
    kinds = ["digest", "part", "mask", "good", "toxic"]
    rows = found.groupBy("id", *kinds).agg(F.count(F.lit(1)).alias("c"))
    groups = rows.groupBy(*kinds).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("no_id"),
                                      F.min("id").alias("least"), F.min_by("c", "id").alias("at_least"))
    x = groups.withColumn("first", F.min("least").over(Window.partitionBy("digest")))
    alone = F.col("no_id") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    two = F.array(F.struct(F.col("mask").alias("mask"), alone.alias("n")), F.struct((F.col("mask") + repeat_bit).alias("mask"), (F.col("n") - alone).alias("n")))
    x = x.select("part", "good", "toxic", F.inline(two))
    return x.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _total(of: str, condition: str) -> str:
    """Sum of a count over the part's cells that meet a condition on the cell's mask."""
    return f"aggregate(filter(cells, x -> {condition}), 0L, (a, x) -> a + x.{of})"


def orders(cells: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of every order and step."""
    hit, past = "(x.mask & l.bit) <> 0", "(x.mask & p.applied)"
    step = f"""named_struct('letter', l.letter, 'kept', {_total('n', '(x.mask & (p.applied | l.bit)) = 0')},
      'removed', {_total('n', f'{hit} AND {past} = 0')}, 'redundant', {_total('n', f'{hit} AND {past} <> 0')},
      'unique_fails', {_total('n', 'x.mask = l.bit')},
      'good_lost', {_total('good', f'{hit} AND {past} = 0')}, 'toxic_lost', {_total('toxic', f'{hit} AND {past} = 0')})"""
    none = ("CAST(array() AS array<struct<letter:string,kept:bigint,removed:bigint,redundant:bigint,unique_fails:bigint,"
            "good_lost:bigint,toxic_lost:bigint>>)")
    unused = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(letters))
    sql = f"""
    WITH RECURSIVE prefixes(part, taken, applied, steps) AS (
      SELECT part, '', 0, {none} FROM {{cells}}
      UNION ALL
      SELECT p.part, concat(p.taken, l.letter), p.applied | l.bit, concat(p.steps, array({step}))
      FROM prefixes p JOIN (VALUES {unused}) AS l(letter, bit) ON (p.applied & l.bit) = 0 JOIN {{cells}} c ON c.part = p.part)
    SELECT part, taken AS filter_order, posexplode(steps) AS (at, s) FROM prefixes WHERE length(taken) = {len(letters)}"""
    found = cells.sparkSession.sql(sql, cells=cells)
    return found.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "s.*")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per part, filter_order and step for the five filters of the contract, with shapley: the removals of the step's
    filter summed over all orders.

    * Null texts are empty ones: they fail filter A alone, and as texts that repeat, E. A null or empty part is the part ''.
    * A row is a repeat if some row of a smaller id has the same text; of rows with one id and one text none repeats the
      other, and rows without an id repeat nothing and make nothing a repeat.
    * Rows of equal ids count one by one. An id with several rows in ``labels`` is good or toxic if one of them says so.
    * Texts are compared by their SHA-256, and read whole. Without documents there are no rows; other columns take no part.
    """
    letters = "ABCDE"
    found = materialise(masks(docs, id_col, text_col, part_col))
    cells = materialise(mask_cells(marked(found, labels, id_col, good_col, toxic_col), 1 << letters.index("E")))
    packed = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    turns = -(-packed.count() // PARTS)
    packed = materialise(packed.withColumn("turn", F.pmod(F.xxhash64("part"), F.lit(max(1, turns)))))
    steps = None
    for turn in range(max(1, turns)):
        some = orders(packed.where(F.col("turn") == turn).select("part", "cells"), letters)
        steps = some if steps is None else steps.unionByName(some)
    steps = materialise(steps)
    shapley = steps.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
