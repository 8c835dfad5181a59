"""Gates, audits, ledgers and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from contrapair.functions.ordered import exact_quantiles, with_running
from contrapair.functions.vectors import let, safe_div
from contrapair.session import materialise


def ledger_check(ledger: DataFrame, got: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """name, expected, got, status: SKIP without a recomputed value, INFO without an expected one."""
    x = ledger.join(got, "name", "full_outer")
    rel = F.abs(F.col("got") - F.col("expected")) / F.greatest(F.abs("expected"), F.lit(1e-30))
    status = (F.when(F.col("got").isNull(), "SKIP").when(F.col("expected").isNull(), "INFO")
              .when(rel <= F.coalesce("tol", F.lit(tolerance)), "OK").otherwise("DISAGREE"))
    return x.select("name", "expected", "got", status.alias("status"))


def superseded(values: DataFrame, corrections: DataFrame, name: str, value: str) -> DataFrame:
    """The value to report, beside the archived one and its correction."""
    x = values.select(name, F.col(value).alias("archived")).join(corrections.select(name, F.col(value).alias("corrected")), name, "left")
    return x.withColumns({"reported": F.coalesce("corrected", "archived"), "superseded": F.col("corrected").isNotNull()})


def integrity_problems(df: DataFrame, tag: str, value: str, expected: DataFrame, other: DataFrame) -> DataFrame:
    """problem, tag, detail: nulls, row parity, zero variance, missing tags, tag sets that differ between tables."""
    per = df.groupBy(tag).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.stddev_samp(value).alias("sd"))
    most = per.agg(F.max("n"))
    per = per.select("*", most.scalar().alias("most"))

    def rows(cond: Column, name: str, detail: Column) -> DataFrame:
        return per.where(cond).select(F.lit(name).alias("problem"), tag, detail.cast("long").alias("detail"))

    def missing(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        gone = a.select(tag).distinct().join(b.select(tag).distinct(), tag, "left_anti")
        return gone.select(F.lit(name).alias("problem"), tag, F.lit(0).cast("long").alias("detail"))

    parts = [
        rows(F.col("nulls") > 0, "null values", F.col("nulls")),
        rows(F.col("n") != F.col("most"), "row parity", F.col("most") - F.col("n")),
        rows(F.col("sd") == 0, "zero variance", F.col("n")),
        missing(expected, df, "missing tag"),
        missing(df, other, "tag absent from second table"),
        missing(other, df, "tag absent from first table"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_candidates(df: DataFrame, keys: list[str], cand: str, candidates: list[str]) -> DataFrame:
    """Candidates each item lacks, without building the full grid."""
    have = df.groupBy(*keys).agg(F.collect_set(cand).alias("have"))
    gone = F.array_except(F.array(*[F.lit(c) for c in candidates]), F.col("have"))
    return have.select(*keys, F.explode(gone).alias(cand))


#: Stretches of items that a task compares together.
STRETCHES = 8


def absent_items(df: DataFrame, tag: str, cand: str, item: str, cells: DataFrame, expected: DataFrame) -> DataFrame:
    """tag, cand, item: each expected item that an expected cell (tag, candidate) has no row of, cells without any row included.

    ``cells`` has the columns tag and cand, ``expected`` the whole number ``item``. Items are held as bitmaps of 32,768 numbers, so
    the rows are cells times stretches of numbers, not cells times items. Null items and cells are ignored, repeated rows count once.
    """
    stretch, place = F.bitmap_bucket_number(F.col(item)), F.bitmap_bit_position(F.col(item))
    held = df.where(F.col(item).isNotNull()).groupBy(tag, cand, stretch.alias("stretch")).agg(F.bitmap_construct_agg(place).alias("held"))
    want = expected.where(F.col(item).isNotNull()).groupBy(stretch.alias("stretch")).agg(F.bitmap_construct_agg(place).alias("want"))
    listed = cells.select(tag, cand).dropna().distinct().agg(F.collect_list(F.struct(tag, cand))).scalar()
    grid = want.select("stretch", "want", F.inline(listed)).join(held, [tag, cand, "stretch"], "left")
    number = df.schema[item].dataType
    out = StructType([cells.schema[tag], cells.schema[cand], StructField(item, LongType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row makes up to 32,768 rows, so a few are looked at together
        for batch in (b.slice(at, STRETCHES) for b in batches for at in range(0, b.num_rows, STRETCHES)):
            rows, items = [], []
            for n, (at, want_bits, held_bits) in enumerate(zip(*[batch.column(c).to_pylist() for c in (2, 3, 4)], strict=True)):
                gone = np.frombuffer(want_bits, dtype=np.uint8)
                if held_bits is not None:
                    gone = gone & ~np.frombuffer(held_bits, dtype=np.uint8)
                bit = np.flatnonzero(np.unpackbits(gone, bitorder="little"))
                items.append((at - 1) * 32768 + bit + 1 if at > 0 else at * 32768 - bit)
                rows.append(np.full(len(bit), n))
            rows, items = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64), np.concatenate([np.zeros(0, dtype=np.int64), *items])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(items)], names=[tag, cand, item])

    found = grid.select(tag, cand, "stretch", "want", "held").mapInArrow(compare, out)
    return found.withColumn(item, F.col(item).cast(number))


def failing_gates(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """fails: names of the gates whose condition holds."""
    fails = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in gates.items()]))
    return df.withColumns({"fails": fails, "passes": F.size(fails) == 0})


def config_stamp(config: dict) -> str:
    return json.dumps(config, sort_keys=True, separators=(",", ":"))


def manifest_stamp(df: DataFrame, columns: list[str], config: dict) -> DataFrame:
    """One hash of a table's rows, in any order, and of the configuration that produced it.

    Row hashes are summed, so the stamp is a plain aggregate and needs no sort.
    """
    def cell(c: str) -> Column:  # its length marks where a value ends, and a null is unlike any value
        text = F.col(c).cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    row = F.sha2(F.concat(*[cell(c) for c in columns]), 256)
    part = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    s = df.select(part.alias("h")).agg(F.sum("h").cast("decimal(38,0)").cast("string").alias("s"), F.count(F.lit(1)).alias("n_rows"))
    text = F.concat_ws(":", "s", F.col("n_rows").cast("string"), F.lit(config_stamp(config)))
    return s.select("n_rows", F.sha2(text, 256).alias("stamp"))


def is_current(stored_stamp: str | None, current: DataFrame) -> bool:
    """Whether an output carrying this stamp may be reused."""
    return stored_stamp is not None and current.select("stamp").first()["stamp"] == stored_stamp


def verdict(primary: Column, causal: Column, clean: Column, existence: Column) -> Column:
    """The C0 to C4 ladder."""
    return (F.when(primary & causal & clean, "C4").when(primary & causal, "C3").when(primary, "C2").when(existence, "C1").otherwise("C0"))


def findings_index(rows: DataFrame, expected: DataFrame) -> DataFrame:
    """Every expected finding with its value, or PENDING; unexpected findings are listed too."""
    x = expected.join(rows, ["section", "finding"], "full_outer")
    return x.withColumn("status", F.when(F.col("value").isNull(), "PENDING").otherwise("measured"))


def name_problems(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Names used more than once or not of the required form."""
    x = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    bad = F.array_compact(F.array(F.when(F.col("n") > 1, "duplicate"), F.when(~F.col(name).rlike(pattern), "malformed")))
    return x.select(name, "n", F.explode(bad).alias("problem"))


def job_activity(df: DataFrame, job: str, ts: str, uid: str, gap: int) -> DataFrame:
    """Active time of jobs from event times in microseconds.

    A gap above `gap` breaks a segment; each segment starts one median step before its first
    event. In time order the previous event is the running maximum, so no session is collected.
    """
    x = with_running(df.select(job, ts, uid), [job], [ts, uid], {"prev": ("max", ts)}, inclusive=False)
    x = x.withColumn("gap", F.col(ts) - F.col("prev"))
    step = exact_quantiles(x.where(F.col("gap") > 1_000_000), [job], "gap", {"step": 0.5})
    agg = x.groupBy(job).agg(
        F.count(F.lit(1)).alias("n"), (F.max(ts) - F.min(ts)).alias("span"), (F.count_if(F.col("gap") > gap) + 1).alias("segments"),
        F.coalesce(F.sum(F.when(F.col("gap") > gap, F.col("gap"))), F.lit(0)).alias("interruptions"),
        F.coalesce(F.sum(F.when(F.col("gap") <= gap, F.col("gap"))), F.lit(0)).alias("within"))
    y = agg.join(step, job, "left")
    active = F.col("within") + F.col("segments") * F.coalesce("step", F.lit(0.0))
    return y.select(job, "n", "segments", "span", "interruptions", "step", active.alias("active"), F.coalesce(F.col("step") >= 2_000_000, F.lit(False)).alias("valid"))


def union_length(df: DataFrame, keys: list[str], start: str, end: str, uid: str) -> DataFrame:
    """Total length covered by overlapping intervals: what each adds beyond the furthest earlier end."""
    x = with_running(df, keys, [start, uid], {"__far": ("max", end)}, inclusive=False)
    add = F.greatest(F.lit(0).cast("long"), F.col(end) - F.greatest(F.col(start), F.coalesce("__far", F.col(start))))
    return x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(add).alias("covered"),
        F.count_if(F.col("__far").isNull() | (F.col(start) > F.col("__far"))).alias("islands"))


def reproduction(x: DataFrame, y: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Two row sets of the same measurement: joined rows, largest and median difference, correlation."""
    j = x.select(*keys, F.col(value).alias("a")).join(y.select(*keys, F.col(value).alias("b")), keys)
    j = materialise(j.select("a", "b", F.abs(F.col("a") - F.col("b")).alias("d")))  # four passes follow
    med = exact_quantiles(j, [], "d", {"m": 0.5})
    s = j.agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("max_abs"), F.corr("a", "b").alias("r"), F.stddev_samp("b").alias("sd"))
    return s.select("*", med.scalar().alias("median_abs"))


def keyword_hits(df: DataFrame, texts: list[str], first: list[str], second: list[str]) -> DataFrame:
    """Rows whose joined lower-case text holds a word of both lists."""
    t = F.lower(F.concat_ws(" ", *texts))
    return df.where(t.rlike("|".join(first)) & t.rlike("|".join(second)))


def inverted_index(df: DataFrame, doc: str, words: Column) -> DataFrame:
    """(doc, word, positions), computed inside each row; places are sorted by word, and each run of a word is one row."""
    places = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))

    def runs(a: Column) -> Column:
        last = F.size(a) - 1
        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(a, i)["word"] != F.get(a, i - 1)["word"]))
        return let(F.concat(starts, F.array(F.size(a))), lambda s: F.transform(F.slice(s, 1, F.size(s) - 1), lambda at, k: F.struct(
            F.get(a, at)["word"].alias("word"), F.transform(F.slice(a, at + 1, F.get(s, k + 1) - at), lambda p: p["pos"]).alias("positions"))))

    return df.where(F.size(words) > 0).select(doc, F.inline(let(places, runs)))


def rebuilt_text(index: DataFrame, doc: str) -> DataFrame:
    """Text of each document from its inverted index, whose rows are moved as they are and opened inside the document's row."""
    rows = index.groupBy(doc).agg(F.collect_list(F.struct("word", "positions")).alias("l"))
    opened = F.flatten(F.transform("l", lambda e: F.transform(e["positions"], lambda p: F.struct(p.alias("pos"), e["word"].alias("word")))))
    s = rows.select(doc, F.array_sort(opened).alias("s"))
    return s.select(doc, F.size("s").alias("n_words"), F.array_join("s.word", " ").alias("text"))


def token_set(text: Column) -> Column:
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    return F.array_distinct(F.filter(F.split(clean, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def first_differences(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Rows with `dv`, the change from the previous step."""
    prev = df.select(*keys, (F.col(step) + 1).alias(step), F.col(value).alias("__p"))
    return df.join(prev, keys + [step], "left").withColumn("dv", F.col(value) - F.col("__p")).drop("__p")


def trajectory_pairs(a: DataFrame, b: DataFrame, pair: list[str], step: str, value: str) -> DataFrame:
    """Correlation of first differences and mean offset of paired runs."""
    y = b.select(*pair, step, F.col(value).alias("__v"), F.col("dv").alias("__dv"))
    x = a.join(y, pair + [step])
    s = x.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("__v") - F.col(value)).alias("offset"), F.covar_pop("dv", "__dv").alias("c"),
        F.var_pop(F.when(F.col("__dv").isNotNull(), F.col("dv"))).alias("va"), F.var_pop(F.when(F.col("dv").isNotNull(), F.col("__dv"))).alias("vb"))
    return s.select(*pair, "n", "offset", safe_div(F.col("c"), F.sqrt(F.col("va") * F.col("vb"))).alias("r"))


def sign_agreement(means: DataFrame, group: str, value: str) -> DataFrame:
    """Whether all members of a group share a sign, and how many are positive."""
    return means.groupBy(group).agg(
        F.count(F.lit(1)).alias("k"), F.count_distinct(F.signum(value)).alias("n_signs"), F.count_if(F.col(value) > 0).alias("n_positive")
    ).withColumn("agree", F.col("n_signs") == 1)


def pool_totals(df: DataFrame, pools: DataFrame, folder: str, hit: Column) -> DataFrame:
    """Counts and shares per folder, per pool and overall."""
    x = df.join(pools, folder)
    return x.rollup("pool", folder).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")).withColumn("fraction", F.col("hits") / F.col("n"))
