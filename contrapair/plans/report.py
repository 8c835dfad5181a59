"""The flagship report, gates, audits and the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapair.functions.critical import t995_sql
from contrapair.functions.ordered import with_rank
from contrapair.operators import audit as op
from contrapair.operators import contrasts as cn
from contrapair.operators import models as md
from contrapair.operators import resample as rs_op
from contrapair.operators import signatures as sg
from contrapair.plans import contrasts as pc
from contrapair.plans import derived as d
from contrapair.plans import resample as pr
from contrapair.plans import signatures as ps
from contrapair.plans.registry import query
from contrapair.plans.sqlkit import big, fix, i64, oracle, r, rounded, rs, view
from contrapair.session import materialise, scratch_path
from contrapair.sources.writers import write_measurements
from contrapair.streaming import activity, resumable


def lean(spark, sf):
    """From long score rows to one row per arm: pair on the item, average per adapter, parse tags, test, limit.

    The difference of the two candidates is averaged first and given its own-minus-other sign
    per adapter, so tags are parsed once per adapter and not once per row.
    """
    x = d.long(spark, sf, d.ARMS).select("tag", "gen_idx", "K", "rho")
    diff = cn.paired_contrast(x, ["tag", "gen_idx"], "K", "rho", F.lit("A"), F.lit("B"))
    per = cn.parse_tag(diff.groupBy("tag").agg(F.avg("c").alias("m"), F.count(F.lit(1)).alias("n")))
    per = per.where(F.col("arm").isin(d.ARMS))
    means = materialise(per.select("arm", "tag", "seed", F.when(F.col("arm") == "A", F.col("m")).otherwise(-F.col("m")).alias("theta"), "n"))
    flip = rs_op.sign_flip(means, "arm", "seed", "theta").select("arm", "p", "floor")
    arms = means.groupBy("arm").agg(F.avg("theta").alias("theta"), F.stddev_samp("theta").alias("sd"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_items"))
    arms = arms.withColumn("u99", cn.upper_limit(F.col("theta"), F.col("sd"), F.col("k"))).join(flip, "arm")
    both = cn.max_arm_limit(cn.symmetric_parts(cn.two_arms(means, "arm", "theta")))
    return means, arms, both


view("v_lean", f"""SELECT arm, k, n_items, theta, theta + {t995_sql('k - 1')} * sd / sqrt(k) AS u99, hits / assignments AS p, 1 / assignments AS floor FROM
    (SELECT arm, count(*) AS k, {i64('sum(n)')} AS n_items, avg(theta) AS theta, stddev_samp(theta) AS sd FROM v_adapter GROUP BY arm) JOIN (SELECT arm, hits, assignments FROM v_flip) USING (arm)""")


@query("flagship_lean_report", oracle(f"""SELECT arm, k, n_items, {rs(9, theta='theta', u99='u99', p='p', floor='floor')}, {rs(9, theta_sym=pc.SYM, additive=pc.ADD, u_max=pc.U_MAX)},
    CASE WHEN p <= 0.01 AND theta > 0 THEN 'lean' ELSE 'no lean' END AS reading FROM v_lean, v_two"""))
def lean_report(spark, sf):
    """Is there an own-candidate lean, what is its 99 % upper limit, and what is the exact p?"""
    _, arms, both = lean(spark, sf)
    one = both.select(F.struct("theta_sym", "additive", "u_max").alias("b"))
    x = arms.select("arm", "k", "n_items", "theta", "u99", "p", "floor", one.scalar().alias("b")).select("*", "b.*").drop("b")
    x = x.withColumn("reading", F.when((F.col("p") <= 0.01) & (F.col("theta") > 0), "lean").otherwise("no lean"))
    return fix(x, 9, "theta", "u99", "p", "floor", "theta_sym", "additive", "u_max")


LEDGER = [
    ("k_A", 12.0, None), ("k_B", 12.0, None), ("floor_A", 0.000244140625, 1e-9), ("theta_sym", 0.0, None),
    ("u_max", 0.002, 0.5), ("theta_A", None, None), ("unreleased_arm", 1.0, None),
]
LEDGER_SQL = ", ".join("('{}', {}::DOUBLE, {}::DOUBLE)".format(n, "NULL" if e is None else repr(e), "NULL" if t is None else repr(t)) for n, e, t in LEDGER)
view("v_got", f"""SELECT 'k_' || arm AS name, k::DOUBLE AS got FROM v_lean UNION ALL SELECT 'floor_' || arm, floor FROM v_lean UNION ALL SELECT 'theta_' || arm, theta FROM v_lean
    UNION ALL SELECT 'p_' || arm, p FROM v_lean UNION ALL SELECT 'theta_sym', {pc.SYM} FROM v_two UNION ALL SELECT 'u_max', {pc.U_MAX} FROM v_two""")


def recomputed(spark, sf):
    """name, got: every headline number as a row."""
    _, arms, both = lean(spark, sf)
    per = F.array(*[F.struct(F.concat(F.lit(f"{c}_"), "arm").alias("name"), F.col(v).cast("double").alias("got")) for c, v in
                    (("k", "k"), ("floor", "floor"), ("theta", "theta"), ("p", "p"))])
    top = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("got")) for c in ("theta_sym", "u_max")])
    return arms.select(F.inline(per)).unionByName(both.select(F.inline(top)))


@query("g1_ledger_check", oracle(f"""SELECT coalesce(l.name, g.name) AS name, {rs(9, expected='expected', got='got')}, CASE WHEN got IS NULL THEN 'SKIP' WHEN expected IS NULL THEN 'INFO'
    WHEN abs(got - expected) / greatest(abs(expected), 1e-30) <= coalesce(tol, 0.01) THEN 'OK' ELSE 'DISAGREE' END AS status FROM (VALUES {LEDGER_SQL}) l(name, expected, tol) FULL JOIN v_got g ON g.name = l.name"""))
def ledger_check(spark, sf):
    ledger = spark.createDataFrame(LEDGER, "name string, expected double, tol double")
    return fix(op.ledger_check(ledger, recomputed(spark, sf)), 9, "expected", "got")


@query("g2_supersession", oracle(f"""SELECT tag, {rs(9, archived='x.v', corrected='CASE WHEN abs(x.v - a.theta) > 1e-5 THEN a.theta END', reported='CASE WHEN abs(x.v - a.theta) > 1e-5 THEN a.theta ELSE x.v END')},
    abs(x.v - a.theta) > 1e-5 AS superseded FROM (SELECT tag, CASE any_value(arm) WHEN 'A' THEN 1 ELSE -1 END * (avg(l_discount) - 1.25 * avg(l_tax)) AS v FROM v_lines WHERE arm <> 'base' GROUP BY tag) x
    JOIN v_adapter a USING (tag)"""))
def supersession(spark, sf):
    """Archived values averaged lines; where averaging items differs, the item value supersedes them."""
    dlt = F.avg("l_discount") - F.avg("l_tax") * 1.25
    li = d.lines(spark, sf).where("arm <> 'base'")
    old = materialise(li.groupBy("tag", "arm").agg(F.when(F.col("arm") == "A", dlt).otherwise(-dlt).alias("theta")))
    new = materialise(d.adapter_means(spark, sf).select("tag", F.col("theta").alias("t2")))
    fixed = old.join(new, "tag").where(F.abs(F.col("theta") - F.col("t2")) > 1e-5).select("tag", F.col("t2").alias("theta"))
    return fix(op.superseded(old, fixed, "tag", "theta"), 9, "archived", "corrected", "reported")


view("v_expected", "SELECT a || '_raw_s' || s::VARCHAR || '_r16' AS tag FROM (VALUES ('A'), ('B'), ('base')) x(a), range(0, 13) t(s)")


@query("g3_integrity_audit", oracle(f"""SELECT 'null values' AS problem, tag, {i64('nulls')} AS detail FROM per WHERE nulls > 0 UNION ALL SELECT 'row parity', tag, {i64('most - n')} FROM per WHERE n <> most
    UNION ALL SELECT 'zero variance', tag, n FROM per WHERE sd = 0 UNION ALL SELECT 'missing tag', tag, 0 FROM v_expected WHERE tag NOT IN (SELECT tag FROM v_lines)
    UNION ALL SELECT 'tag absent from second table', tag, 0 FROM (SELECT tag FROM v_lines EXCEPT SELECT tag FROM v_lines WHERE l_quantity >= 50 AND l_tax >= 0.08)""",
    per="SELECT *, max(n) OVER () AS most FROM (SELECT tag, count(*) AS n, count(*) FILTER (rho IS NULL) AS nulls, stddev_samp(rho) AS sd FROM v_long GROUP BY tag)"))
def integrity_audit(spark, sf):
    expected = spark.createDataFrame([(f"{a}_raw_s{s}_r16",) for a in ("A", "B", "base") for s in range(13)], "tag string")
    second = d.lines(spark, sf).where("l_quantity >= 50 AND l_tax >= 0.08")
    return op.integrity_problems(d.long(spark, sf), "tag", "rho", expected, second)


@query("g4_completeness", oracle("""SELECT arm, count(*) AS n_missing, min(gen_idx) AS first_missing FROM (SELECT gen_idx, unnest(list_filter(['A', 'B', 'base'], lambda a: NOT list_contains(have, a))) AS arm FROM
    (SELECT gen_idx, list(DISTINCT arm) AS have FROM v_lines GROUP BY gen_idx)) GROUP BY arm"""))
def completeness(spark, sf):
    x = op.missing_candidates(d.lines(spark, sf), ["gen_idx"], "arm", ["A", "B", "base"])
    return x.groupBy("arm").agg(F.count(F.lit(1)).alias("n_missing"), F.min("gen_idx").alias("first_missing"))


@query("g4_absent_items", oracle("""SELECT arm, seed, count(*) AS n_missing, min(o_orderkey) AS first_missing FROM
    (SELECT arm, seed, o_orderkey FROM (VALUES ('A'), ('B'), ('base')) x(arm), range(0, 13) t(seed), (SELECT DISTINCT o_orderkey FROM orders)
    EXCEPT SELECT arm, seed, l_orderkey FROM v_lines) GROUP BY arm, seed"""))
def absent_items(spark, sf):
    """Orders that a cell (arm, seed) has no line of; the last seed has no lines at all."""
    cells = spark.createDataFrame([(arm, seed) for arm in ("A", "B", "base") for seed in range(13)], "arm string, seed long")
    orders = d.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    x = op.absent_items(d.lines(spark, sf), "arm", "seed", "l_orderkey", cells, orders)
    return x.groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n_missing"), F.min("l_orderkey").cast("long").alias("first_missing"))


@query("g5_quality_gate", oracle("""SELECT device, concat_ws(',', CASE WHEN h < 0.55 THEN 'split_half' END, CASE WHEN abs(p) > 0.1 THEN 'pairwise' END, CASE WHEN greatest(h - p, 0) < 0.5 THEN 'device_share' END) AS fails,
    NOT (h < 0.55 OR abs(p) > 0.1 OR greatest(h - p, 0) < 0.5) AS passes FROM (SELECT a.device, corr(a.k, b.k) AS h FROM v_e1 a JOIN v_e2 b USING (device, pos) GROUP BY a.device) JOIN
    (SELECT device, avg(c) AS p FROM (SELECT a.device, b.device AS other, corr(a.k, b.k) AS c FROM v_e2 a JOIN v_e2 b USING (pos) WHERE a.device <> b.device GROUP BY ALL) GROUP BY device) USING (device)"""))
def quality_gate(spark, sf):
    q = ps.signature_quality(spark, sf)
    x = op.failing_gates(q, {"split_half": F.col("split_half") < 0.55, "pairwise": F.abs("pairwise") > 0.1, "device_share": F.col("device_share") < 0.5})
    return x.select("device", F.array_join("fails", ",").alias("fails"), "passes")


CONFIG = {"guard": 4, "splits": ["E1", "E2", "T", "H"], "version": 1}


cells = " || ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "device", "split"))


@query("g6_manifest_stamp", oracle(f"""SELECT n AS n_rows, sha256(s::VARCHAR || ':' || n::VARCHAR || ':' || '{op.config_stamp(CONFIG)}') AS stamp FROM (SELECT count(*) AS n,
    sum(('0x' || substr(sha256({cells}), 1, 15))::BIGINT) AS s FROM v_items)"""))
def manifest_stamp(spark, sf):
    return op.manifest_stamp(d.items(spark, sf), ["doc_id", "device", "split"], CONFIG)


@query("g7_verdicts", oracle("""SELECT seed, CASE WHEN pa < 0.3 AND pb < 0.3 AND ta > 0 AND tb > 0 AND rej THEN 'C4' WHEN pa < 0.3 AND pb < 0.3 AND ta > 0 AND tb > 0 THEN 'C3' WHEN pa < 0.3 AND pb < 0.3 THEN 'C2'
    WHEN least(pa, pb) < 0.3 THEN 'C1' ELSE 'C0' END AS rung FROM (SELECT seed, max(p) FILTER (arm = 'A') AS pa, max(p) FILTER (arm = 'B') AS pb, max(theta) FILTER (arm = 'A') AS ta, max(theta) FILTER (arm = 'B') AS tb,
    bool_or(p <= 0.01) AS rej FROM v_adapter a JOIN v_cell_p c ON c.tag = a.arm || a.seed::VARCHAR GROUP BY seed)"""))
def verdicts(spark, sf):
    """The ladder per seed: both arms significant, both positive, one still so at the stricter level."""
    p = pr.adapter_p_values(spark, sf).select(F.col("tag").alias("unit"), "p")
    m = d.adapter_means(spark, sf).withColumn("unit", F.concat("arm", F.col("seed").cast("string"))).join(p, "unit")

    def of(a, v):
        return F.max(F.when(F.col("arm") == a, F.col(v)))

    s = m.groupBy("seed").agg(of("A", "p").alias("pa"), of("B", "p").alias("pb"), of("A", "theta").alias("ta"), of("B", "theta").alias("tb"), F.max(F.col("p") <= 0.01).alias("rej"))
    primary = (F.col("pa") < 0.3) & (F.col("pb") < 0.3)
    return s.select("seed", op.verdict(primary, (F.col("ta") > 0) & (F.col("tb") > 0), F.col("rej"), F.least("pa", "pb") < 0.3).alias("rung"))


EXPECTED_FINDINGS = [("limits", "theta_sym"), ("limits", "u_max"), ("tests", "p_A"), ("tests", "p_B"), ("reliability", "icc"), ("replication", "second body")]


@query("g8_findings_index", oracle(f"""SELECT coalesce(e.section, f.section) AS section, coalesce(e.finding, f.finding) AS finding, {r('value', 9)} AS value, CASE WHEN value IS NULL THEN 'PENDING' ELSE 'measured' END AS status
    FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in EXPECTED_FINDINGS)}) e(section, finding) FULL JOIN found f ON f.section = e.section AND f.finding = e.finding""",
    found=f"""SELECT CASE WHEN name LIKE 'p_%' THEN 'tests' WHEN name LIKE 'k_%' THEN 'design' ELSE 'limits' END AS section, name AS finding, got AS value FROM v_got UNION ALL
    SELECT 'reliability', 'icc', coalesce(greatest((n * vm - w) / n, 0) / nullif(greatest((n * vm - w) / n, 0) + w, 0), 0) FROM (SELECT max(n) AS n, var_samp(m) AS vm,
    sum(n * v) / (count(*) * (max(n) - 1)) AS w FROM (SELECT arm, avg(theta) AS m, var_pop(theta) AS v, count(*) AS n FROM v_adapter GROUP BY arm))"""))
def findings_index(spark, sf):
    section = F.when(F.col("name").like("p_%"), "tests").when(F.col("name").like("k_%"), "design").otherwise("limits")
    rows = recomputed(spark, sf).select(section.alias("section"), F.col("name").alias("finding"), F.col("got").alias("value"))
    icc = md.one_way_icc(d.adapter_means(spark, sf), "arm", "theta").select(F.lit("reliability").alias("section"), F.lit("icc").alias("finding"), F.col("icc").alias("value"))
    expected = spark.createDataFrame(EXPECTED_FINDINGS, "section string, finding string")
    return fix(op.findings_index(rows.unionByName(icc), expected), 9, "value")


NAME = "^[a-z]+ [a-z]+$"


@query("g9_name_registry", oracle(f"""SELECT p_name, n, problem FROM (SELECT p_name, count(*) AS n, unnest(list_filter([CASE WHEN count(*) > 1 THEN 'duplicate' END,
    CASE WHEN NOT regexp_matches(p_name, '{NAME}') THEN 'malformed' END], lambda x: x IS NOT NULL)) AS problem FROM (SELECT p_name FROM part UNION ALL SELECT lower(s_name) FROM supplier) GROUP BY p_name)"""))
def name_registry(spark, sf):
    parts = d.table(spark, sf, "part").select("p_name")
    names = parts.unionByName(d.table(spark, sf, "supplier").select(F.lower("s_name").alias("p_name")))
    return op.name_problems(names, "p_name", NAME)


GAP_US = 600 * 24 * 1_000_000


@query("g10_job_activity", oracle(f"""SELECT user_id, n, segments, span, {i64('interruptions')} AS interruptions, {rs(3, step='step', active='inside + segments * coalesce(step, 0)')}, coalesce(step >= 2000000, false) AS valid FROM
    (SELECT user_id, count(*) AS n, max(t) - min(t) AS span, count(*) FILTER (g > {GAP_US}) + 1 AS segments, coalesce(sum(g) FILTER (g > {GAP_US}), 0) AS interruptions, coalesce(sum(g) FILTER (g <= {GAP_US}), 0) AS inside,
    quantile_cont(g, 0.5) FILTER (g > 1000000) AS step FROM (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM (SELECT user_id, event_id, epoch_us(ts) AS t FROM events)) GROUP BY user_id)"""))
def job_activity(spark, sf):
    e = materialise(d.table(spark, sf, "events").select("user_id", "event_id", d.epoch_us("ts").alias("t")))
    return fix(op.job_activity(e, "user_id", "t", "event_id", GAP_US), 3, "step", "active")


@query("g10_activity_stream", oracle(f"""SELECT user_id, count(*) AS n, min(t) AS first, max(t) AS last FROM (SELECT user_id, t, sum(CASE WHEN g < {GAP_US} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM
    (SELECT user_id, event_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS g FROM (SELECT user_id, event_id, epoch_us(ts) AS t FROM events))) GROUP BY user_id, s"""))
def activity_stream(spark, sf):
    """Session windows over the event stream, run to the end of the files present."""
    schema = d.table(spark, sf, "events").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    s = s.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    path = scratch_path(spark, "sessions")
    q = activity.start_activity_snapshot(activity.activity_sessions(s, "user_id", "ts", f"{GAP_US // 1_000_000} seconds", "1 day"), path, scratch_path(spark, "stream"))
    q.awaitTermination()
    return spark.read.parquet(path).select("user_id", "n", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))


@query("a8_ingest_stream", oracle("SELECT tag, count(*) AS n, CAST(sum(gen_idx) AS BIGINT) AS key_sum FROM (SELECT DISTINCT tag, gen_idx FROM v_lines) GROUP BY tag"))
def ingest_stream(spark, sf):
    """A table holding part of the keys, then a stream of all rows, then the same stream again: every key once."""
    path = scratch_path(spark, "ingest")
    done = d.lines(spark, sf).where("l_linestatus = 'O'").groupBy("tag", "gen_idx").agg(F.min("l_discount").alias("value"))
    write_measurements(done, path, ["tag"])
    schema = d.table(spark, sf, "lineitem").schema
    for _ in range(2):
        s = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
        arm = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("base")
        rows = s.select(F.concat(arm, F.lit("_raw_s"), (F.col("l_partkey") % 12).cast("string"), F.lit("_r16")).alias("tag"),
                        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("gen_idx"), F.col("l_discount").alias("value"))
        resumable.start_resumable_ingest(rows, path, ["tag", "gen_idx"], "tag", scratch_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.sum("gen_idx").alias("key_sum"))


@query("g11_union_length", oracle(f"""SELECT user_id, count(*) AS n, {i64('sum(greatest(0, e - greatest(s, coalesce(far, s))))')} AS covered, count(*) FILTER (far IS NULL OR s > far) AS islands FROM
    (SELECT user_id, s, e, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM
    (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 10000000 AS e FROM events)) GROUP BY user_id"""))
def union_length(spark, sf):
    e = d.table(spark, sf, "events").select("user_id", "event_id", d.epoch_us("ts").alias("s"), F.round(F.col("value") * 100).cast("long").alias("v"))
    e = materialise(e.select("user_id", "event_id", "s", (F.col("s") + F.col("v") * 10_000_000).alias("e")))
    return op.union_length(e, ["user_id"], "s", "e", "event_id")


@query("g12_reproduction", oracle(f"""SELECT count(*) AS n, {rs(8, max_abs='max(abs(a - b))', median_abs='quantile_cont(abs(a - b), 0.5)', sd='stddev_samp(b)')}, {r('corr(a, b)', 7)} AS r FROM
    (SELECT rho_D AS a, floor(rho_D * 200 + 0.5) / 200 AS b FROM v_wide)"""))
def reproduction(spark, sf):
    """The same rows at reduced precision."""
    x = materialise(d.wide(spark, sf).select("tag", "gen_idx", F.col("rho_D").alias("rho")))
    y = x.withColumn("rho", F.floor(F.col("rho") * 200 + 0.5) / 200)
    return fix(fix(op.reproduction(x, y, ["tag", "gen_idx"], "rho"), 8, "max_abs", "median_abs", "sd"), 7, "r")


FIRST, SECOND = ["thering", "onther", "heand"], ["ation", "tionin", "oring"]


@query("g13_keyword_filter", oracle(f"""SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 AND regexp_matches(lower(source || ' ' || text), '{'|'.join(FIRST)}')
    AND regexp_matches(lower(source || ' ' || text), '{'|'.join(SECOND)}')"""))
def keyword_filter(spark, sf):
    x = d.table(spark, sf, "documents").where("n_chars >= 200")
    return op.keyword_hits(x, ["source", "text"], FIRST, SECOND).select("doc_id", "n_chars")


@query("g14_rebuilt_text", oracle(r"""SELECT doc_id, len(string_split_regex(text, '\s+')) AS n_words, sha256(array_to_string(string_split_regex(text, '\s+'), ' ')) AS sha FROM documents"""))
def rebuilt_text(spark, sf):
    """Every document through its inverted index and back."""
    idx = op.inverted_index(d.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.split("text", r"\s+"))
    return op.rebuilt_text(idx, "doc_id").select("doc_id", big("n_words").alias("n_words"), F.sha2("text", 256).alias("sha"))


TOKENS = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''))"


@query("g15_token_jaccard", oracle(f"""SELECT conv_id, turn, {r('len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1)')} AS sim,
    len(list_intersect(x, y)) / greatest(len(list_distinct(list_concat(x, y))), 1) < 0.1 AS mismatch FROM (SELECT a.conv_id, a.turn, {TOKENS.format('a.text')} AS x, {TOKENS.format('b.text')} AS y
    FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1)"""))
def token_jaccard(spark, sf):
    c = d.table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", op.token_set(F.col("text")).alias("x"))
    b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), op.token_set(F.col("text")).alias("y"))
    s = op.jaccard(F.col("x"), F.col("y"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", rounded(s).alias("sim"), (s < 0.1).alias("mismatch"))


view("v_traj0", "SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS step FROM events")
view("v_traj", "SELECT *, value - lag(value) OVER (PARTITION BY user_id, event_type ORDER BY step) AS dv FROM v_traj0")


def _pairs(kind: str, shift: int) -> str:
    return f"""SELECT '{kind}' AS kind, a.user_id, count(*) AS n, avg(b.value - a.value) AS o, covar_pop(a.dv, b.dv) / nullif(sqrt(var_pop(a.dv) * var_pop(b.dv)), 0) AS rr FROM v_traj a JOIN v_traj b
    ON b.user_id = a.user_id + {shift} AND b.step = a.step WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY a.user_id"""


@query("g16_trajectories", oracle(f"""SELECT kind, count(*) AS pairs, {i64('sum(n)')} AS steps, {rs(7, mean_r='avg(rr)', min_r='min(rr)', mean_offset='avg(o)')} FROM ({_pairs('twin', 0)} UNION ALL {_pairs('other', 1)}) GROUP BY kind"""))
def trajectories(spark, sf):
    """Click against view series: of the same user (twins) and of neighbouring users."""
    e = materialise(d.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value"))
    t = with_rank(e, ["user_id", "event_type"], ["event_id"], "step").drop("event_id")
    t = materialise(op.first_differences(t, ["user_id", "event_type"], "step", "value"))
    a, b = t.where("event_type = 'click'"), t.where("event_type = 'view'")
    near = b.withColumn("user_id", F.col("user_id") - 1)
    parts = [op.trajectory_pairs(a, y, ["user_id"], "step", "value").withColumn("kind", F.lit(k)) for k, y in (("twin", b), ("other", near))]
    x = sg.union_all(parts).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("steps"), F.avg("r").alias("mean_r"), F.min("r").alias("min_r"), F.avg("offset").alias("mean_offset"))
    return fix(x, 7, "mean_r", "min_r", "mean_offset")


@query("g17_sign_agreement", oracle("""SELECT arm, count(*) AS k, count(DISTINCT sign(theta)) AS n_signs, count(*) FILTER (theta > 0) AS n_positive, count(DISTINCT sign(theta)) = 1 AS agree FROM v_adapter GROUP BY arm"""))
def sign_agreement(spark, sf):
    return op.sign_agreement(d.adapter_means(spark, sf), "arm", "theta")


@query("g18_pool_totals", oracle(f"""SELECT pool, source, count(*) AS n, count(*) FILTER (quality = 1) AS hits, {r('count(*) FILTER (quality = 1) / count(*)')} AS fraction FROM v_labelled JOIN
    (SELECT DISTINCT source, CASE WHEN regexp_extract(source, '(\\d+)$', 1)::INT % 3 = 0 THEN 'diverse' ELSE 'uniform' END AS pool FROM documents) USING (source) GROUP BY ROLLUP (pool, source)"""))
def pool_totals(spark, sf):
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    pools = d.table(spark, sf, "documents").select("source", F.when(number % 3 == 0, "diverse").otherwise("uniform").alias("pool")).distinct()
    return fix(op.pool_totals(d.labelled(spark, sf), pools, "source", F.col("quality") == 1), 8, "fraction")
