"""Scoring queries: items against templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrapair.functions import vectors as V
from contrapair.functions.hashing import hash_sign_sql, portable_hash_sql
from contrapair.functions.ordered import exact_quantiles, with_rank
from contrapair.operators import scoring as op
from contrapair.operators import signatures as sg
from contrapair.operators.splits import of_next_device
from contrapair.plans import derived as d
from contrapair.plans import splits  # noqa: F401  (defines v_variant)
from contrapair.plans.registry import query
from contrapair.plans.signatures import signature_arrays
from contrapair.plans.sqlkit import big, i64, oracle, r, rounded, view
from contrapair.session import materialise

NCC = "coalesce(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END, 0)"


def ncc_sql(a: str, b: str) -> str:
    return NCC.format(a=a, b=b)


view("v_h", "SELECT p.*, g.next_device, g.ring_place FROM v_planted p JOIN v_ring g USING (device) WHERE p.split = 'H'")
view("v_score", f"""SELECT h.vec_id, h.device, t.device AS K, {ncc_sql('h.w', 'h.y * t.k')} AS rho_mult, {ncc_sql('h.w', 't.k')} AS rho_add
    FROM v_h h JOIN v_e2 t USING (pos) GROUP BY h.vec_id, h.device, t.device""")


def as_templates(t):
    """Template rows under names that cannot clash with item columns (names ignore case)."""
    names = {"device": "K", "k": "tk", "split": "t_split"}
    return t.select(*[F.col(c).alias(names.get(c, c)) for c in t.columns])


def scored(spark, sf):
    """Held-out items scored against every device's E2 signature."""
    x = materialise(d.planted(spark, sf))
    t = as_templates(materialise(signature_arrays(x, "E2")))
    return op.score(x.where("split = 'H'"), t)


def held_out_and_templates(spark, sf):
    x = materialise(d.planted(spark, sf))
    return x.where("split = 'H'"), materialise(signature_arrays(x, "E2"))


@query("d1_multiplicative_score", oracle(f"SELECT vec_id, device, K, {r('rho_mult', 6)} AS rho_mult FROM v_score"))
def multiplicative_score(spark, sf):
    return scored(spark, sf).select("vec_id", "device", "K", rounded("rho_mult", 6).alias("rho_mult"))


@query("d2_component_scores", oracle(f"""SELECT h.vec_id, t.device AS K, {r(ncc_sql('h.w', 't.k'), 6)} AS rho_add,
    {r(ncc_sql('h.w', 'h.y * CASE WHEN t.defect THEN t.k ELSE 0 END'), 6)} AS rho_def,
    {r(ncc_sql('h.w', 'h.y * CASE WHEN t.defect THEN 0 ELSE t.k END'), 6)} AS rho_prnu
    FROM v_h h JOIN parts t USING (pos) GROUP BY h.vec_id, t.device""",
    dv="""SELECT device, pos, k, abs(k - median(k) OVER (PARTITION BY device ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    AS dev FROM v_e2""",
    parts="""SELECT device, pos, k, dev > 3.0 * m / 0.6745 AS defect FROM dv JOIN
    (SELECT device, quantile_cont(dev, 0.5) AS m FROM dv GROUP BY device) USING (device)"""))
def component_scores(spark, sf):
    items, t = held_out_and_templates(spark, sf)
    parts = sg.defect_split(t, ["device"], factor=3.0)
    parts = parts.withColumns({
        "kd": F.when(F.col("defect"), F.col("k")).otherwise(0.0), "kp": F.when(F.col("defect"), 0.0).otherwise(F.col("k")),
    })
    packed = parts.groupBy("device").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "kd", "kp"))).alias("a"))
    bank = materialise(packed.select(F.col("device").alias("K"), F.col("a.k").alias("tk"), F.col("a.kd").alias("kd"), F.col("a.kp").alias("kp")))
    sums = op.pair_sums(items, bank, {"add": ("tk", False), "def": ("kd", True), "prnu": ("kp", True)})
    x = op.correlations(sums, rho_add="add", rho_def="def", rho_prnu="prnu")
    return x.select("vec_id", "K", *[rounded(c, 6).alias(c) for c in ("rho_add", "rho_def", "rho_prnu")])


@query("d3_many_templates", oracle(f"""SELECT split, K, t_split, count(*) AS n, {r('avg(rho)', 6)} AS rho FROM
    (SELECT p.vec_id, p.split, t.device AS K, t.split AS t_split, {ncc_sql('p.w', 'p.y * t.k')} AS rho
    FROM v_planted p JOIN v_sig t USING (pos) GROUP BY p.vec_id, p.split, t.device, t.split) GROUP BY split, K, t_split"""))
def many_templates(spark, sf):
    """Every item against every device's signature of every split."""
    x = materialise(d.planted(spark, sf))
    sig = sg.multiplicative(x.where("split <> 'guard'"), ["device", "split"])
    t = as_templates(sg.to_arrays(sig, ["device", "split"]))
    out = op.score(x, materialise(t))
    return out.groupBy("split", "K", "t_split").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("rho_mult"), 6).alias("rho"))


SHIFTS = list(range(0, 31))


def _shifted(shifts: str) -> str:
    return f"""SELECT device, d, avg(rho) AS m, count(*) AS n FROM (SELECT h.vec_id, h.device, s.d, {ncc_sql('h.w', 'h.y * t.k')} AS rho
    FROM v_h h, {shifts} s(d), v_e2 t WHERE t.device = h.device AND t.pos = (h.pos + s.d) % 64 GROUP BY ALL) GROUP BY device, d"""


@query("d4_decoy_rank", oracle(f"""SELECT device, {r('rho', 6)} AS rho, n, {i64('1 + count(*) FILTER (m > rho)')} AS rank,
    {r('max(m)', 6)} AS best_decoy FROM (SELECT device, m FROM sh WHERE d > 0) JOIN
    (SELECT device, m AS rho, n FROM sh WHERE d = 0) USING (device) GROUP BY device, rho, n""", sh=_shifted("range(0, 31)")))
def decoy_rank(spark, sf):
    items, t = held_out_and_templates(spark, sf)
    out = op.decoy_rank(items, t, SHIFTS)
    return out.select("device", rounded("rho", 6).alias("rho"), "n", "rank", rounded("best_decoy", 6).alias("best_decoy"))


DECOYS, DECOY_SALT = 30, 37


@query("d4_independent_decoys", oracle(f"""SELECT device, {r('rho', 6)} AS rho, n, {i64('1 + count(*) FILTER (m > rho)')} AS rank, {r('max(m)', 6)} AS best_decoy FROM
    (SELECT device, m FROM fld WHERE j > 0) JOIN (SELECT device, m AS rho, n FROM fld WHERE j = 0) USING (device) GROUP BY device, rho, n""",
    fld=f"""SELECT device, j, avg(rho) AS m, count(*) AS n FROM (SELECT h.vec_id, h.device, t.j,
    {ncc_sql('h.w', f"h.y * CASE WHEN t.j = 0 THEN e.k ELSE {hash_sign_sql('h.pos', 't.j', DECOY_SALT)} END")} AS rho
    FROM v_h h JOIN v_e2 e ON e.device = h.device AND e.pos = h.pos, range(0, {DECOYS + 1}) t(j) GROUP BY h.vec_id, h.device, t.j) GROUP BY device, j"""))
def independent_decoys(spark, sf):
    items, t = held_out_and_templates(spark, sf)
    out = op.field_rank(items, t, DECOYS, DECOY_SALT)
    return out.select("device", rounded("rho", 6).alias("rho"), "n", "rank", rounded("best_decoy", 6).alias("best_decoy"))


@query("d5_shift_grid", oracle(f"""SELECT device, {r('m_on', 6)} AS m_on, {r('m_off', 6)} AS m_off, {r('m_on - m_off', 6)} AS excess,
    {r('sqrt(v_on / n_on + v_off / n_off)', 6)} AS se, n_on, n_off FROM (SELECT device, avg(m) FILTER (d % 8 = 0) AS m_on,
    avg(m) FILTER (d % 8 <> 0) AS m_off, var_samp(m) FILTER (d % 8 = 0) AS v_on, var_samp(m) FILTER (d % 8 <> 0) AS v_off,
    count(*) FILTER (d % 8 = 0) AS n_on, count(*) FILTER (d % 8 <> 0) AS n_off FROM sh GROUP BY device)""",
    sh=_shifted("range(0, 64, 2)")))
def shift_grid(spark, sf):
    items, t = held_out_and_templates(spark, sf)
    out = op.shift_grid(items, t, list(range(0, 64, 2)), 8)
    return out.select("device", *[rounded(c, 6).alias(c) for c in ("m_on", "m_off", "excess", "se")], "n_on", "n_off")


view("v_unit", """SELECT h.vec_id, h.device, t.device AS K, h.pos, h.w, h.y * t.k AS z FROM v_h h JOIN v_e2 t USING (pos)""")
view("v_unit1", """SELECT vec_id, device, K, pos, w - avg(w) OVER g AS w, z - avg(z) OVER g AS z FROM v_unit
    WINDOW g AS (PARTITION BY vec_id, K)""")
view("v_unit2", """SELECT vec_id, device, K, pos, w / sqrt(sum(w * w) OVER g) AS a, z / sqrt(sum(z * z) OVER g) AS b FROM v_unit1
    WINDOW g AS (PARTITION BY vec_id, K)""")
view("v_surface", """SELECT x.vec_id, x.device, x.K, s.s, sum(y.a * x.b) AS c FROM v_unit2 x, range(0, 64) s(s), v_unit2 y
    WHERE y.vec_id = x.vec_id AND y.K = x.K AND y.pos = (x.pos + s.s) % 64 GROUP BY ALL""")
view("v_peak", """SELECT vec_id, device, K, max(c) FILTER (s = 0) AS c0, avg(c * c) FILTER (s BETWEEN 6 AND 58) AS e,
    max_by(c, abs(c)) AS cm, max_by(s, abs(c)) AS shift FROM v_surface GROUP BY vec_id, device, K""")


def peaks(spark, sf):
    items, t = held_out_and_templates(spark, sf)
    return op.peak_energy(op.beside(items, as_templates(t), "tk"))


@query("d6_peak_energy", oracle(f"""SELECT vec_id, device, K, {r('sign(c0) * c0 * c0 / e', 4)} AS pce0,
    {r('sign(cm) * cm * cm / e', 4)} AS pce_max, shift FROM v_peak"""))
def peak_energy(spark, sf):
    return peaks(spark, sf).select("vec_id", "device", "K", rounded("pce0", 4).alias("pce0"), rounded("pce_max", 4).alias("pce_max"), "shift")


GRID = 8
view("v_surface2", f"""SELECT x.vec_id, x.device, x.K, s.s, sum(y.a * x.b) AS c FROM v_unit2 x, range(0, 64) s(s), v_unit2 y
    WHERE y.vec_id = x.vec_id AND y.K = x.K AND y.pos = (x.pos // {GRID} + s.s // {GRID}) % {GRID} * {GRID} + (x.pos % {GRID} + s.s % {GRID}) % {GRID} GROUP BY ALL""")
view("v_peak2", f"""SELECT vec_id, device, K, max(c) FILTER (s = 0) AS c0, max_by(c, abs(c)) AS cm, max_by(s, abs(c)) AS shift,
    avg(c * c) FILTER (least(s // {GRID}, {GRID} - s // {GRID}) > 1 OR least(s % {GRID}, {GRID} - s % {GRID}) > 1) AS e FROM v_surface2 GROUP BY vec_id, device, K""")


@query("d6_peak_energy_2d", oracle(f"""SELECT vec_id, device, K, {r('sign(c0) * c0 * c0 / e', 4)} AS pce0, {r('sign(cm) * cm * cm / e', 4)} AS pce_max,
    shift // {GRID} AS shift_row, shift % {GRID} AS shift_col FROM v_peak2"""))
def peak_energy_2d(spark, sf):
    """The vectors as square fields: the surface over both displacements, with an exclusion zone of 3 x 3 on the torus."""
    items, t = held_out_and_templates(spark, sf)
    x = op.peak_energy(op.beside(items, as_templates(t), "tk"), exclude=3, width=GRID)
    return x.select("vec_id", "device", "K", rounded("pce0", 4).alias("pce0"), rounded("pce_max", 4).alias("pce_max"), "shift_row", "shift_col")


@query("d7_shift_residues", oracle(f"""SELECT device, K, {r('avg((shift % 8 = 0)::INT)')} AS mod8, {r('avg((shift % 16 = 0)::INT)')} AS mod16,
    count(*) AS n, count(*) FILTER (shift = 0) AS at_zero, {r('0.125')} AS chance8, {r('0.0625')} AS chance16 FROM v_peak GROUP BY device, K"""))
def shift_residues(spark, sf):
    out = op.shift_residues(peaks(spark, sf), ["device", "K"])
    return out.withColumns({c: rounded(c) for c in ("mod8", "mod16", "chance8", "chance16")})


LEVELS_SQL = "(VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE), (4.0::DOUBLE)) lv(alpha)"


@query("d8_mark_injection", oracle(f"""SELECT kind, alpha, {r('avg(sqrt(ss / px))', 6)} AS rms_change, {r('sum(cl) / sum(px)', 8)} AS clip_frac,
    count(*) AS n, {r('10 * log10(65025.0 / (sum(ss) / sum(px)))', 6)} AS psnr FROM
    (SELECT kind, vec_id, alpha, sum((v - y) * (v - y)) AS ss, count(*) AS px, count(*) FILTER (v <= 0 OR v >= 255) AS cl FROM
    (SELECT kind, vec_id, alpha, y, greatest(least(round_even(CASE kind WHEN 'multiply' THEN y * (1 + alpha * k) ELSE y + 100 * alpha * k END, 0), 255.0), 0.0) AS v
    FROM v_planted JOIN v_pattern USING (device, pos), {LEVELS_SQL}, (VALUES ('multiply'), ('add')) kd(kind))
    GROUP BY kind, vec_id, alpha) GROUP BY kind, alpha"""))
def mark_injection(spark, sf):
    x = d.planted(spark, sf).join(d.pattern(spark, sf), "device")
    x = op.at_levels(x, d.LEVELS)
    field = F.transform("k", lambda p: p * 100)
    both = sg.union_all([
        x.select(F.lit("multiply").alias("kind"), "alpha", "y", op.stored(op.marked(F.col("y"), F.col("k"), F.col("alpha"))).alias("v")),
        x.select(F.lit("add").alias("kind"), "alpha", "y", op.stored(op.added(F.col("y"), field, F.col("alpha"))).alias("v")),
    ])
    out = op.change_report(both, "y", "v", ["kind", "alpha"])
    return out.select("kind", "alpha", rounded("rms_change", 6).alias("rms_change"), rounded("clip_frac").alias("clip_frac"), "n", rounded("psnr", 6).alias("psnr"))


def _rescored(y: str) -> str:
    """Residual of changed items: high-pass and standardise again."""
    return f"""SELECT *, (w0 - avg(w0) OVER g) / stddev_pop(w0) OVER g AS w FROM (SELECT *, yy - avg(yy) OVER
    (PARTITION BY variant, vec_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w0 FROM {y}) WINDOW g AS (PARTITION BY variant, vec_id)"""


@query("d9_suppress_and_swap", oracle(f"""SELECT {r("max(m) FILTER (variant = 'raw_own')", 6)} AS rho_own_raw,
    {r("max(m) FILTER (variant = 'clean_own')", 6)} AS rho_own_clean, {r("max(m) FILTER (variant = 'raw_other')", 6)} AS rho_other_raw,
    {r("max(m) FILTER (variant = 'swap_other')", 6)} AS rho_other_swap,
    {r("max(m) FILTER (variant = 'raw_own') / greatest(abs(max(m) FILTER (variant = 'clean_own')), 1e-12)", 3)} AS suppression_factor,
    {r("max(m) FILTER (variant = 'swap_other') / greatest(abs(max(m) FILTER (variant = 'raw_other')), 1e-12)", 3)} AS injection_gain FROM
    (SELECT variant, quantile_cont(rho, 0.5) AS m FROM (SELECT variant || '_own' AS variant, vec_id, {ncc_sql('w', 'yy * k_own')} AS rho FROM scored
    WHERE variant IN ('raw', 'clean') GROUP BY variant, vec_id UNION ALL SELECT variant || '_other', vec_id, {ncc_sql('w', 'yy * k_other')} FROM scored
    WHERE variant IN ('raw', 'swap') GROUP BY variant, vec_id) GROUP BY variant)""",
    pair="""SELECT h.vec_id, h.device, h.pos, h.y, e1.k AS k1, o1.k AS k1_other, e2.k AS k_own, o2.k AS k_other FROM v_h h
    JOIN v_e1 e1 USING (device, pos) JOIN v_e2 e2 USING (device, pos)
    JOIN v_e1 o1 ON o1.pos = h.pos AND o1.device = h.next_device
    JOIN v_e2 o2 ON o2.pos = h.pos AND o2.device = h.next_device""",
    changed="""SELECT vec_id, pos, k_own, k_other, v.variant, CASE v.variant WHEN 'raw' THEN y WHEN 'clean' THEN greatest(least(y * (1 - k1), 255.0), 0.0)
    ELSE greatest(least(y * (1 - k1) * (1 + k1_other), 255.0), 0.0) END AS yy FROM pair, (VALUES ('raw'), ('clean'), ('swap')) v(variant)""",
    scored=_rescored("changed")))
def suppress_and_swap(spark, sf):
    """Own pattern removed with E1 templates, another device's added; measured with E2 templates."""
    x = materialise(d.planted(spark, sf))
    e1, e2 = signature_arrays(x, "E1"), signature_arrays(x, "E2")
    both = materialise(e1.withColumnRenamed("k", "k1").join(e2.withColumnRenamed("k", "k2"), "device"))
    other = of_next_device(both.select("device", F.col("k1").alias("o1"), F.col("k2").alias("o2")), d.ring(spark, sf))
    h = x.where("split = 'H'").select("vec_id", "device", "y").join(both, "device").join(other, "device")
    variants = F.array(
        F.struct(F.lit("raw").alias("variant"), F.col("y").alias("yy")),
        F.struct(F.lit("clean").alias("variant"), op.suppressed(F.col("y"), F.col("k1")).alias("yy")),
        F.struct(F.lit("swap").alias("variant"), op.swapped(F.col("y"), F.col("k1"), F.col("o1")).alias("yy")),
    )
    v = h.select("vec_id", "k2", "o2", F.inline(variants))
    v = sg.standardised_residual(v, "yy", "w")
    own = v.where("variant <> 'swap'").select(
        F.concat("variant", F.lit("_own")).alias("variant"), op.ncc(F.col("w"), V.times(F.col("yy"), F.col("k2"))).alias("rho"))
    oth = v.where("variant <> 'clean'").select(
        F.concat("variant", F.lit("_other")).alias("variant"), op.ncc(F.col("w"), V.times(F.col("yy"), F.col("o2"))).alias("rho"))
    m = exact_quantiles(materialise(own.unionByName(oth)), ["variant"], "rho", {"m": 0.5})

    def med(name):
        return F.max(F.when(F.col("variant") == name, F.col("m")))

    return m.agg(
        rounded(med("raw_own"), 6).alias("rho_own_raw"), rounded(med("clean_own"), 6).alias("rho_own_clean"),
        rounded(med("raw_other"), 6).alias("rho_other_raw"), rounded(med("swap_other"), 6).alias("rho_other_swap"),
        rounded(med("raw_own") / F.greatest(F.abs(med("clean_own")), F.lit(1e-12)), 3).alias("suppression_factor"),
        rounded(med("swap_other") / F.greatest(F.abs(med("raw_other")), F.lit(1e-12)), 3).alias("injection_gain"),
    )


view("v_bank", """SELECT device, vec_id, pos, w, row_number() OVER (PARTITION BY device, pos ORDER BY vec_id) - 1 AS place
    FROM v_planted WHERE split = 'T'""")
view("v_transplant", f"""SELECT h.vec_id, h.device, h.rn, lv.s, {ncc_sql('h.w', '(h.y + lv.s * b.w) * t.k')} AS rho,
    {ncc_sql('(h.w + lv.s * b.w)', 'h.y * t.k')} AS rho_w FROM v_h h
    JOIN v_bank b ON b.device = h.next_device AND b.pos = h.pos AND b.place = h.rn % (SELECT max(place) + 1 FROM v_bank b2 WHERE b2.device = b.device)
    JOIN v_e2 t ON t.device = b.device AND t.pos = h.pos, (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) lv(s) GROUP BY ALL""")


@query("d10_residual_transplant", oracle(f"""SELECT s, count(*) AS n, {r('avg(rho)', 6)} AS rho, {r('avg(rho_w)', 6)} AS rho_w FROM v_transplant GROUP BY s"""))
def residual_transplant(spark, sf):
    out = transplants(spark, sf)
    return out.groupBy("s").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("rho"), 6).alias("rho"), rounded(F.avg("rho_w"), 6).alias("rho_w"))


def transplants(spark, sf):
    """Each held-out item receives a residual of the next device's bank, cycling through it."""
    x = materialise(d.planted(spark, sf))
    ring = d.ring(spark, sf)
    t = of_next_device(signature_arrays(x, "E2"), ring)
    donors = with_rank(x.where("split = 'T'").select("device", "vec_id", F.col("w").alias("donor")), ["device"], ["vec_id"], "place", "n_bank")
    bank = materialise(of_next_device(donors.select("device", (F.col("place") - 1).alias("place"), "n_bank", "donor"), ring))
    sizes = bank.select("device", "n_bank").distinct()
    h = x.where("split = 'H'").join(sizes, "device").withColumn("place", F.col("rn") % F.col("n_bank"))
    h = op.at_levels(h.join(bank.drop("n_bank"), ["device", "place"]).join(t, "device"), [0.0, 0.25, 0.5, 1.0], "s")
    y2 = op.transplanted(F.col("y"), F.array("donor"), F.lit(0), F.col("s"))
    w2 = op.transplanted(F.col("w"), F.array("donor"), F.lit(0), F.col("s"))
    return h.select(
        "vec_id", "device", "rn", "s", op.ncc(F.col("w"), V.times(y2, F.col("k"))).alias("rho"),
        op.ncc(w2, V.times(F.col("y"), F.col("k"))).alias("rho_w"),
    )


@query("d26_remove_templates", oracle(f"""SELECT vec_id, pos, {r('w - a * p - b * q', 6)} AS w FROM pq JOIN (SELECT vec_id,
    (sum(w * p) * sum(q * q) - sum(w * q) * sum(p * q)) / (sum(p * p) * sum(q * q) - sum(p * q) ** 2) AS a,
    (sum(w * q) * sum(p * p) - sum(w * p) * sum(p * q)) / (sum(p * p) * sum(q * q) - sum(p * q) ** 2) AS b FROM pq GROUP BY vec_id) USING (vec_id)""",
    pq="""SELECT h.vec_id, h.pos, h.w, h.y * t.k AS p, h.y * o.k AS q FROM v_h h JOIN v_e2 t USING (device, pos)
    JOIN v_e2 o ON o.pos = h.pos AND o.device = h.next_device"""))
def remove_templates(spark, sf):
    items, t = held_out_and_templates(spark, sf)
    other = of_next_device(t.select("device", F.col("k").alias("ko")), d.ring(spark, sf))
    x = items.join(t, "device").join(other, "device")
    x = x.withColumns({"p": V.times(F.col("y"), F.col("k")), "q": V.times(F.col("y"), F.col("ko"))})
    x = x.withColumn("w", op.remove_two(F.col("w"), F.col("p"), F.col("q")))
    return sg.positions(x, ["vec_id"], w="w").withColumn("w", rounded("w", 6))


@query("d27_block_shuffle", oracle(f"""SELECT p.vec_id, o.place * 8 + p.pos % 8 AS pos, {r('p.w', 6)} AS w FROM v_planted p JOIN
    (SELECT vec_id, blk, row_number() OVER (PARTITION BY vec_id ORDER BY {portable_hash_sql('blk', 'vec_id', 31)}, blk) - 1 AS place
    FROM v_vec, range(0, 8) b(blk)) o ON o.vec_id = p.vec_id AND o.blk = p.pos // 8"""))
def block_shuffle(spark, sf):
    x = d.planted(spark, sf)
    x = x.withColumn("w", sg.shuffle_blocks(F.col("w"), F.col("vec_id"), 8, 31))
    return sg.positions(x, ["vec_id"], w="w").withColumn("w", rounded("w", 6)).withColumn("pos", big("pos"))


@query("c11_estimator_sweep", oracle(f"""SELECT estimate, device, count(*) AS n, {r('avg(c)', 6)} AS theta, {r('stddev_samp(c) / sqrt(count(*))', 6)} AS se FROM
    (SELECT estimate, device, vec_id, max(rho) FILTER (K = device) - avg(rho) FILTER (K <> device) AS c FROM
    (SELECT h.vec_id, h.device, t.estimate, t.device AS K, {ncc_sql('h.w', 'h.y * t.k')} AS rho FROM v_h h JOIN
    (SELECT estimate, device, pos, sum(w * y) / greatest(sum(y * y), 1e-6) AS k FROM v_variant WHERE split IN ('E1', 'E2') GROUP BY ALL) t USING (pos)
    GROUP BY h.vec_id, h.device, t.estimate, t.device) GROUP BY estimate, device, vec_id) GROUP BY estimate, device"""))
def estimator_sweep(spark, sf):
    """Signature, score and contrast once for all estimates; the estimate is just one more key."""
    from contrapair.operators.splits import estimate_variants

    x = materialise(d.planted(spark, sf))
    sig = sg.multiplicative(estimate_variants(x.where("split IN ('E1', 'E2')")), ["estimate", "device"])
    t = materialise(as_templates(sg.to_arrays(sig, ["estimate", "device"])))
    s = op.score(x.where("split = 'H'"), t)
    own = F.col("K") == F.col("device")
    c = s.groupBy("estimate", "device", "vec_id").agg(
        (F.max(F.when(own, F.col("rho_mult"))) - F.avg(F.when(~own, F.col("rho_mult")))).alias("c"))
    return c.groupBy("estimate", "device").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("c"), 6).alias("theta"),
        rounded(F.stddev_samp("c") / F.sqrt(F.count(F.lit(1))), 6).alias("se"))
