"""Split and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapair.functions.hashing import portable_hash_sql
from contrapair.operators import signatures as sig
from contrapair.operators import splits as op
from contrapair.plans import derived as d
from contrapair.plans.registry import query
from contrapair.plans.sqlkit import big, i64, oracle, r, rounded, view

TARGETS = {"E1": 20, "E2": 32, "T": 16}


@query("b1_guarded_splits", oracle("SELECT doc_id, device, rn, n, split FROM v_items"))
def guarded_splits(spark, sf):
    return d.items(spark, sf).select("doc_id", "device", "rn", "n", "split")


@query("b1_sized_splits", oracle("""SELECT doc_id, device, CASE WHEN rn <= 4 THEN 'E1' WHEN rn > 6 AND rn <= 12 THEN 'E2'
    WHEN rn > 14 AND rn <= 17 THEN 'T' WHEN rn > 19 AND rn <= 22 THEN 'H' ELSE 'guard' END AS split FROM v_items"""))
def sized_splits(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", F.col("source").alias("device"))
    out = op.sized_splits(docs, "device", ["doc_id"], [("E1", 4), ("E2", 6), ("T", 3), ("H", 3)], 2)
    return out.select("doc_id", "device", "split")


@query("b2_split_collisions", oracle("""SELECT sha, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM v_items
    WHERE split <> 'guard' GROUP BY sha HAVING count(DISTINCT split) > 1"""))
def split_collisions(spark, sf):
    return op.split_collisions(d.items(spark, sf), "sha")


@query("b3_choose_pair", oracle("""SELECT lang, source, n_items, rank FROM ranked WHERE rank <= 2 AND most >= 2""",
    counts="SELECT lang, source, count(*) AS n_items FROM documents GROUP BY ALL HAVING count(*) >= 10",
    ranked="""SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_items DESC, source) AS rank,
    count(*) OVER (PARTITION BY lang) AS most FROM counts"""))
def choose_pair(spark, sf):
    return op.choose_pair(d.table(spark, sf, "documents"), "lang", "source", 10).withColumn("rank", big("rank"))


view("v_cap", """SELECT source, CASE WHEN count(*) = (SELECT count(DISTINCT lang) FROM documents) THEN min(c) ELSE 0 END AS cap
    FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) GROUP BY source""")


@query("b4_allocation", oracle(f"""SELECT source, split, cap, {i64('base + CASE WHEN place <= cap - given THEN 1 ELSE 0 END')} AS alloc FROM
    (SELECT *, sum(base) OVER (PARTITION BY source) AS given,
    row_number() OVER (PARTITION BY source ORDER BY rem DESC, ord) AS place FROM
    (SELECT source, cap, split, ord, cap * t // 68 AS base, cap * t % 68 AS rem FROM v_cap,
    (VALUES (0, 'E1', 20), (1, 'E2', 32), (2, 'T', 16)) s(ord, split, t)))"""))
def allocation(spark, sf):
    cap = op.stratum_capacity(d.table(spark, sf, "documents"), "source", "lang")
    return op.largest_remainder(cap, "source", TARGETS)


@query("b5_hold_out", oracle(f"""SELECT source, cap, {i64('coalesce(before, 0)')} AS before, coalesce(before, 0) < 60 AS held_out FROM (SELECT source, cap,
    sum(cap) OVER (ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v_cap)"""))
def hold_out(spark, sf):
    cap = op.stratum_capacity(d.table(spark, sf, "documents"), "source", "lang")
    return op.hold_out_smallest(cap, "source", 60)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("b6_burst_check", oracle(f"""SELECT user_id, a.event_type AS split_a, b.event_type AS split_b,
    {i64('min(abs(epoch_us(a.ts) - epoch_us(b.ts)))')} AS gap, min(abs(epoch_us(a.ts) - epoch_us(b.ts))) < 3000000 AS flagged
    FROM events a JOIN events b USING (user_id) WHERE a.event_type < b.event_type GROUP BY ALL"""))
def burst_check(spark, sf):
    e = d.table(spark, sf, "events").select("event_id", "user_id", "event_type", d.epoch_us("ts").alias("t"))
    gaps = op.smallest_gaps(e, "user_id", "event_type", "t", "event_id", EVENT_TYPES)
    return gaps.withColumn("flagged", F.col("gap") < 3_000_000)


@query("b7_samples", oracle(f"""SELECT 'first' AS kind, device, doc_id FROM v_items WHERE rn <= 5
    UNION ALL SELECT DISTINCT 'even', device, doc_id FROM v_items, range(0, 5) t(i)
    WHERE rn - 1 = floor(i * (n - 1) / 4.0)
    UNION ALL SELECT 'hashed', device, doc_id FROM (SELECT device, doc_id, row_number() OVER (PARTITION BY device
    ORDER BY {portable_hash_sql('doc_id', '0', 5)}, doc_id) AS k FROM v_items) WHERE k <= 5"""))
def samples(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", F.col("source").alias("device"))
    parts = [
        ("first", op.first_n(docs, "device", ["doc_id"], 5)),
        ("even", op.evenly_spaced(docs, "device", ["doc_id"], 5)),
        ("hashed", op.hashed_sample(docs, "device", "doc_id", 5, 5)),
    ]
    return sig.union_all([x.select(F.lit(k).alias("kind"), "device", "doc_id") for k, x in parts])


view("v_variant", """SELECT p.*, e.estimate FROM v_planted p, LATERAL (SELECT unnest(['pooled',
    CASE WHEN rn % 2 = 0 THEN 'even' ELSE 'odd' END, CASE WHEN rn * 2 <= n THEN 'first_half' ELSE 'second_half' END]) AS estimate) e""")


@query("b8_estimate_variants", oracle(f"""SELECT estimate, device, pos, {r('sum(w * y) / greatest(sum(y * y), 1e-6)')} AS k
    FROM v_variant GROUP BY estimate, device, pos"""))
def estimate_variants(spark, sf):
    x = op.estimate_variants(d.planted(spark, sf))
    return sig.multiplicative(x, ["estimate", "device"]).withColumn("k", rounded("k"))
