"""Measurement-shaped tables derived from the given star schema, in both dialects side by side.

Every one of them is computed from all rows of its source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrapair.functions.hashing import hash_sign, hash_sign_sql
from contrapair.functions.vectors import doubles
from contrapair.operators.signatures import standardised_residual
from contrapair.operators.splits import device_ring, percent_splits
from contrapair.plans.sqlkit import view
from contrapair.session import materialise, spread

ARMS = ["A", "B"]
CANDIDATES = ["A", "B", "C", "D", "E"]
PLANT = 0.02
SALT_PLANT = 17
LEVELS = [0.0, 0.5, 1.0, 2.0, 4.0]
# name, lower and upper percentile of the device's ordered items; the gaps are guard bands
SPLITS = [("E1", 0, 20), ("E2", 24, 56), ("T", 60, 76), ("H", 80, 100)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_us(c: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def _arm() -> Column:
    return F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("base")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem rows under measurement names, before averaging."""
    li = table(spark, sf, "lineitem")
    seed = F.col("l_partkey") % 12
    return li.select(
        _arm().alias("arm"),
        seed.alias("seed"),
        F.concat(_arm(), F.lit("_raw_s"), seed.cast("string"), F.lit("_r16")).alias("tag"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gen_idx"),
        "l_orderkey", "l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_linestatus",
    )


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (tag, gen_idx); grouping by these keys, many rows dealt out by gen_idx, lets later groupings reuse the shuffle.

    The arm travels as a number, since a string in an aggregation buffer would force a sort.
    """
    code = F.when(F.col("arm") == "A", 0).when(F.col("arm") == "B", 1).otherwise(2)
    li = lines(spark, sf).select("tag", "gen_idx", "arm", "seed", "l_discount", "l_tax", "l_quantity", "l_extendedprice")
    x = spread(li, table(spark, sf, "lineitem").count(), "gen_idx").groupBy("tag", "gen_idx").agg(
        F.min(code).alias("code"),
        F.min("seed").alias("seed"),
        F.avg("l_discount").alias("rho_A"),
        (F.avg("l_tax") * 1.25).alias("rho_B"),
        (F.avg("l_quantity") / 500).alias("rho_C"),
        (F.avg("l_extendedprice") / 1e6).alias("rho_D"),
    )
    arm = F.when(F.col("code") == 0, "A").when(F.col("code") == 1, "B").otherwise("base")
    return x.select("tag", "gen_idx", arm.alias("arm"), "seed", "rho_A", "rho_B", "rho_C", "rho_D")


def long(spark: SparkSession, sf: str, candidates: list[str] = CANDIDATES) -> DataFrame:
    """tag, gen_idx, K, rho for five candidates, or for some of them."""
    w = wide(spark, sf).withColumn("rho_E", (F.col("rho_A") + F.col("rho_B")) / 2)
    pairs = F.array(*[F.struct(F.lit(k).alias("K"), F.col(f"rho_{k}").alias("rho")) for k in candidates])
    return w.select("tag", "arm", "seed", "gen_idx", F.inline(pairs))


def contrasts(spark: SparkSession, sf: str) -> DataFrame:
    """Own minus other per item of arms A and B, already paired on the item."""
    w = wide(spark, sf).where(F.col("arm").isin(ARMS))
    d = F.col("rho_A") - F.col("rho_B")
    return w.select("tag", "arm", "seed", "gen_idx", F.when(F.col("arm") == "A", d).otherwise(-d).alias("c"))


def adapter_means(spark: SparkSession, sf: str) -> DataFrame:
    return contrasts(spark, sf).groupBy("arm", "tag").agg(
        F.min("seed").alias("seed"), F.avg("c").alias("theta"), F.count(F.lit(1)).alias("n"),
        F.var_samp("c").alias("v"),
    )


def crossed(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced grid (arm, seed, j) of mean contrasts."""
    li = lines(spark, sf).where(F.col("arm").isin(ARMS))
    d = F.avg("l_discount") - F.avg("l_tax") * 1.25
    return li.groupBy("arm", "seed", (F.col("l_orderkey") % 10).alias("j")).agg(
        F.when(F.col("arm") == "A", d).otherwise(-d).alias("x")
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, device, rn, n, split, y."""
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("device"), doubles(F.col("embedding")).alias("y")
    )
    return percent_splits(e, "device", ["vec_id"], SPLITS)


def ring(spark: SparkSession, sf: str) -> DataFrame:
    """device, next_device, ring_place of all devices of the vectors."""
    return materialise(device_ring(table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("device"))))


def ring_arm() -> Column:
    """Devices take the two arms in turn."""
    return F.when(F.col("ring_place") % 2 == 0, "A").otherwise("B")


def planted(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors carrying a multiplicative +-2 % device pattern, with their standardised residual."""
    v = vectors(spark, sf)
    host = F.transform(
        F.col("y"),
        lambda x, i: 100.0 * (1 + 0.3 * x) * (1 + PLANT * hash_sign(i, F.col("device"), SALT_PLANT)),
    )
    return standardised_residual(v.withColumn("y", host), "y", "w")


def pattern(spark: SparkSession, sf: str) -> DataFrame:
    """The pattern planted in each device: device, k."""
    dev = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("device")).distinct()
    return dev.withColumn(
        "k", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda p: PLANT * hash_sign(p, F.col("device"), SALT_PLANT))
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """documents as items of devices (source) with guarded splits."""
    d = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("device"), "lang", "n_chars", F.sha2("text", 256).alias("sha")
    )
    return percent_splits(d, "device", ["doc_id"], SPLITS)


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.join(table(spark, sf, "labels"), "doc_id")


SEED = "(l_partkey % 12)"
ARM = "(CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'base' END)"
view("v_lines", f"""SELECT {ARM} AS arm, {SEED} AS seed, {ARM} || '_raw_s' || {SEED}::VARCHAR || '_r16' AS tag,
  l_orderkey * 8 + l_linenumber AS gen_idx, l_orderkey, l_discount, l_tax, l_quantity, l_extendedprice, l_linestatus FROM lineitem""")
view("v_wide", """SELECT tag, gen_idx, min(arm) AS arm, min(seed) AS seed, avg(l_discount) AS rho_A, 1.25 * avg(l_tax) AS rho_B,
  avg(l_quantity) / 500 AS rho_C, avg(l_extendedprice) / 1e6 AS rho_D FROM v_lines GROUP BY tag, gen_idx""")
view("v_long", " UNION ALL ".join(
    f"SELECT tag, arm, seed, gen_idx, '{k}' AS K, {'(rho_A + rho_B) / 2' if k == 'E' else 'rho_' + k} AS rho FROM v_wide"
    for k in CANDIDATES))
view("v_con", """SELECT tag, arm, seed, gen_idx, CASE arm WHEN 'A' THEN rho_A - rho_B ELSE rho_B - rho_A END AS c
  FROM v_wide WHERE arm IN ('A', 'B')""")
view("v_adapter", "SELECT arm, tag, min(seed) AS seed, avg(c) AS theta, count(*) AS n, var_samp(c) AS v FROM v_con GROUP BY arm, tag")
view("v_crossed", """SELECT arm, seed, l_orderkey % 10 AS j, CASE arm WHEN 'A' THEN 1 ELSE -1 END * (avg(l_discount) - 1.25 * avg(l_tax)) AS x
  FROM v_lines WHERE arm IN ('A', 'B') GROUP BY arm, seed, l_orderkey % 10""")


def split_case(splits=SPLITS) -> str:
    arms = " ".join(f"WHEN rn * 100 > {lo} * n AND rn * 100 <= {hi} * n THEN '{s}'" for s, lo, hi in splits)
    return f"(CASE {arms} ELSE 'guard' END)"


view("v_ring", """SELECT device, coalesce(lead(device) OVER (ORDER BY device), first_value(device) OVER (ORDER BY device)) AS next_device,
  row_number() OVER (ORDER BY device) - 1 AS ring_place FROM (SELECT DISTINCT label::VARCHAR AS device FROM embeddings WHERE label IS NOT NULL)""")
view("v_vec0", """SELECT vec_id, label::VARCHAR AS device, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings""")
view("v_vec", f"SELECT vec_id, device, embedding::DOUBLE[] AS y, rn, n, {split_case()} AS split FROM v_vec0")
view("v_vecx", "SELECT vec_id, device, split, rn, n, unnest(range(0, len(y)))::BIGINT AS pos, unnest(y) AS y FROM v_vec")
view("v_host", f"""SELECT vec_id, device, split, rn, n, pos,
  100.0::DOUBLE * (1 + 0.3::DOUBLE * y) * (1 + {PLANT}::DOUBLE * {hash_sign_sql('pos', 'device', SALT_PLANT)}) AS y FROM v_vecx""")
view("v_host_r", """SELECT *, y - avg(y) OVER (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w0 FROM v_host""")
view("v_planted", """SELECT vec_id, device, split, rn, n, pos, y,
  (w0 - avg(w0) OVER (PARTITION BY vec_id)) / stddev_pop(w0) OVER (PARTITION BY vec_id) AS w FROM v_host_r""")
view("v_pattern", f"""SELECT device, pos, {PLANT}::DOUBLE * {hash_sign_sql('pos', 'device', SALT_PLANT)} AS k
  FROM (SELECT DISTINCT label::VARCHAR AS device FROM embeddings), range(0, 64) t(pos)""")
view("v_items0", """SELECT doc_id, source AS device, lang, n_chars, sha256(text) AS sha,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents""")
view("v_items", f"SELECT *, {split_case()} AS split FROM v_items0")
view("v_labelled", "SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
