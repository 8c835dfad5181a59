"""Ingest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapair.functions.ordered import with_rank, with_running
from contrapair.operators import ingest as op
from contrapair.plans import derived as d
from contrapair.plans.registry import query
from contrapair.plans.sqlkit import big, i64, oracle, r, rounded
from contrapair.session import materialise, scratch_path
from contrapair.sources import readers, writers

URL_RULES = [
    ("mobile", r"^https?://(m\.[^/]+)/([a-z]+)/(\d+)"),
    ("desktop", r"^https?://([^/]+)/([a-z]+)/(\d+)"),
]


@query("a1_discover_files", oracle(
    f"""SELECT page_id, rule, regexp_extract(url, p, 1) AS instance, regexp_extract(url, p, 2) AS model,
    {i64('regexp_extract(url, p, 3)')} AS shot FROM hit""",
    hit=f"""SELECT page_id, url, CASE WHEN regexp_matches(url, '{URL_RULES[0][1]}') THEN 'mobile' ELSE 'desktop' END AS rule,
    CASE WHEN regexp_matches(url, '{URL_RULES[0][1]}') THEN '{URL_RULES[0][1]}' ELSE '{URL_RULES[1][1]}' END AS p
    FROM pages WHERE regexp_matches(url, '{URL_RULES[1][1]}')"""))
def discover_files(spark, sf):
    pages = d.table(spark, sf, "pages").select("page_id", "url")
    return op.match_names(pages, "url", URL_RULES).select("page_id", "rule", "instance", "model", "shot")


@query("a2_screen_groups", oracle(f"""SELECT lang, {i64('count(*) FILTER (n >= 10)')} AS n_ready, count(*) AS n_devices,
    {i64('sum(n)')} AS n_items FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)
    GROUP BY lang HAVING count(*) FILTER (n >= 10) >= 2"""))
def screen_groups(spark, sf):
    return op.screen_groups(d.table(spark, sf, "documents"), "lang", "source", 10)


@query("a3_modal_size", oracle(f"""SELECT doc_id, source, i.size, n_dropped FROM sized i JOIN best b USING (source)
    WHERE i.size = b.size""",
    sized="SELECT doc_id, source, n_chars // 400 AS size FROM documents",
    counts="SELECT source, size, count(*) AS c FROM sized GROUP BY ALL",
    best=f"""SELECT source, max_by(size, c * 1000000 - size) AS size, {i64('sum(c) - max(c)')} AS n_dropped
    FROM counts GROUP BY source"""))
def modal_size(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", "source", F.floor(F.col("n_chars") / 400).alias("size"))
    return op.keep_modal_size(docs, "source", "size")


@query("a4_content_dedup", oracle("""SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS n_copies
    FROM documents GROUP BY sha256(text)"""))
def content_dedup(spark, sf):
    return op.dedup_content(d.table(spark, sf, "documents"), "text", "doc_id")


@query("a5_measurement_roots", oracle("""SELECT 'lines' AS name, 'OK' AS status, count(*) AS n_rows FROM lineitem
    UNION ALL SELECT 'labels', 'OK', count(*) FROM labels UNION ALL SELECT 'unreleased', 'SKIP', NULL"""))
def measurement_roots(spark, sf):
    paths = {"lines": f"{sf}/lineitem.parquet", "labels": f"{sf}/labels.parquet", "unreleased": f"{sf}/unreleased.parquet"}
    return readers.root_status(spark, paths)


@query("a6_pool_sources", oracle(f"""SELECT arm AS source, tag, K, count(*) AS n, {r('avg(rho)')} AS rho FROM v_long
    GROUP BY arm, tag, K"""))
def pool_sources(spark, sf):
    x = d.long(spark, sf)
    frames = {
        "A": x.where("arm = 'A'").select("tag", "gen_idx", "K", F.col("rho").alias("rho_mult")),
        "B": x.where("arm = 'B'").select("tag", F.col("gen_idx").alias("idx"), "K", F.col("rho").alias("corr")),
        "base": x.where("arm = 'base'").select("tag", F.col("gen_idx").alias("i"), "K", F.col("rho").alias("score")),
    }
    names = {"tag": ["tag"], "gen_idx": ["gen_idx", "idx", "i"], "K": ["K"], "rho": ["rho", "rho_mult", "corr", "score"]}
    pooled = op.pool_sources(frames, names)
    return pooled.groupBy("source", "tag", "K").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("rho")).alias("rho"))


@query("a7_string_keys", oracle(f"""SELECT l_suppkey::VARCHAR AS device, typeof(l_suppkey::VARCHAR) = 'VARCHAR' AS is_text, count(*) AS n,
    {r('avg(l_discount)')} AS rho FROM lineitem GROUP BY l_suppkey"""))
def string_keys(spark, sf):
    x = op.string_keys(d.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("device"), "l_discount"), ["device"])
    return x.groupBy("device").agg(
        (F.typeof(F.col("device")) == "string").alias("is_text"), F.count(F.lit(1)).alias("n"), rounded(F.avg("l_discount")).alias("rho")
    )


@query("a8_resumable_ingest", oracle(f"""SELECT tag, count(*) AS n_pending, {i64('sum(gen_idx)')} AS key_sum,
    {r('avg(rho)')} AS rho FROM v_long l WHERE NOT EXISTS (SELECT 1 FROM v_lines e WHERE e.l_linestatus = 'O' AND e.tag = l.tag
    AND e.gen_idx = l.gen_idx) GROUP BY tag"""))
def resumable_ingest(spark, sf):
    written = d.lines(spark, sf).where("l_linestatus = 'O'")
    todo = op.pending(d.long(spark, sf), written, ["tag", "gen_idx"])
    return todo.groupBy("tag").agg(
        F.count(F.lit(1)).alias("n_pending"), F.sum("gen_idx").alias("key_sum"), rounded(F.avg("rho")).alias("rho")
    )


@query("a9_collapse_duplicates", oracle(f"""SELECT tag, status, count(*) AS n_keys, {i64('sum(n_rows)')} AS n_rows,
    {r('sum(l_discount)')} AS total FROM (SELECT tag, gen_idx, count(*) AS n_rows, min(l_discount) AS l_discount,
    CASE WHEN count(*) = 1 THEN 'single' WHEN min(l_discount) <> max(l_discount) THEN 'conflict' ELSE 'identical' END AS status
    FROM v_lines GROUP BY tag, gen_idx) GROUP BY tag, status"""))
def collapse_duplicates(spark, sf):
    s = op.duplicate_status(d.lines(spark, sf), ["tag", "gen_idx"], "l_discount")
    return s.groupBy("tag", "status").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("n_rows").alias("n_rows"), rounded(F.sum("l_discount")).alias("total")
    )


@query("a10_document_paths", oracle(f"""SELECT event_type, count(k) AS n, {i64('sum(k)')} AS total, {i64('min(k)')} AS lo,
    {i64('max(k)')} AS hi FROM (SELECT event_type, (props->>'$.k')::BIGINT AS k FROM events) GROUP BY event_type"""))
def document_paths(spark, sf):
    x = op.select_paths(d.table(spark, sf, "events"), "props", {"k": ("k", "long")})
    return x.groupBy("event_type").agg(
        F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("lo"), F.max("k").alias("hi")
    )


RUN_STEPS = 4


@query("a11_last_complete_run", oracle(
    f"""SELECT job, run, step, loss FROM runs JOIN (SELECT job, max(run) AS run FROM (SELECT job, run FROM runs WHERE run > 0
    GROUP BY job, run HAVING count(*) = {RUN_STEPS} AND count(DISTINCT step) = {RUN_STEPS} AND max(step) = {RUN_STEPS})
    GROUP BY job) USING (job, run)""",
    crashes="""SELECT event_id, user_id, value, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_id) AS c FROM events""",
    steps="SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY event_id) AS step FROM crashes",
    text=f"""SELECT event_id, '[00:00:00] job' || user_id::VARCHAR || ' ' || step::VARCHAR || '/{RUN_STEPS} loss ' ||
    CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS line FROM steps WHERE step <= {RUN_STEPS}""",
    parsed="""SELECT event_id, p[2] AS job, TRY_CAST(string_split(p[3], '/')[1] AS BIGINT) AS step, TRY_CAST(p[5] AS DOUBLE) AS loss
    FROM (SELECT event_id, string_split_regex(trim(line), '\\s+') AS p FROM text) WHERE p[4] = 'loss' AND TRY_CAST(p[5] AS DOUBLE) IS NOT NULL""",
    runs=f"""SELECT *, {i64('sum(CASE WHEN step = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY event_id)')} AS run FROM parsed"""))
def last_complete_run(spark, sf):
    """Each user's events are one job's log; an error event restarts its step counter."""
    e = d.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    e = e.withColumn("crash", F.when(F.col("event_type") == "error", 1).otherwise(0))
    # each step reads its rows several times, so what comes before is written once
    e = materialise(with_running(e, ["user_id"], ["event_id"], {"c": ("sum", "crash")}).select("event_id", "user_id", "value", "c"))
    e = with_rank(e, ["user_id", "c"], ["event_id"], "step").where(F.col("step") <= RUN_STEPS)
    line = F.concat(
        F.lit("[00:00:00] job"), F.col("user_id").cast("string"), F.lit(" "), F.col("step").cast("string"),
        F.lit(f"/{RUN_STEPS} loss "), F.round(F.col("value") * 100).cast("long").cast("string"),
    )
    log = materialise(op.parse_log(e.select("event_id", line.alias("line")), "line").select("event_id", "job", "step", "loss"))
    out = op.last_complete_run(log, "job", "event_id", "step", 1, RUN_STEPS)
    return out.select("job", big("run").alias("run"), "step", "loss")


@query("a12_write_outputs", oracle(f"SELECT arm, tag, count(*) AS n, {r('avg(c)')} AS c FROM v_con GROUP BY arm, tag"))
def write_outputs(spark, sf):
    """Write the per-item table partitioned by arm, then report on what was written."""
    path = scratch_path(spark, "measurements")
    writers.write_measurements(d.contrasts(spark, sf), path, ["arm"])
    return spark.read.parquet(path).groupBy("arm", "tag").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("c")).alias("c"))
