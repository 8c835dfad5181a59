"""Published per-adapter contrasts must give the published statistics."""

from pyspark.sql import functions as F

from contrapair.operators import contrasts as cn
from contrapair.operators import resample as rs

# Fixed published values: mean own-minus-other contrast of each adapter, seeds 0 to 11.
ARM_A = [
    8.850071894000042e-06, -6.325359893399975e-06, 2.2739481611999854e-06, -2.2643461260259995e-05, 7.531645251999987e-06, 0.000103266094242,
    1.4656080383200008e-05, -9.208611264552e-05, -1.0808960947400012e-05, -1.5013951046399989e-05, -2.959544293399999e-05, -7.49431226474e-05,
]
ARM_B = [
    -3.418379579280002e-05, 1.3627266574e-05, 4.924176665400001e-05, 4.0683344752599966e-05, -1.6195523867999998e-05, 3.312410477800001e-05,
    6.442760144199999e-05, -3.4368929834000042e-06, 1.0213471175999991e-05, 2.7348091160000013e-05, 8.484031544600002e-05, -4.446196580240002e-05,
]


def test_published_limits_and_p_values(spark, near):
    rows = [(a, f"{a}{s}", s, v) for a, vs in (("A", ARM_A), ("B", ARM_B)) for s, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "arm string, tag string, seed int, theta double")
    x = cn.max_arm_limit(cn.symmetric_parts(cn.two_arms(df, "arm", "theta"))).first()
    near(x["theta_sym"], 4.5996e-06, 1e-4)
    near(x["mA"], -9.5699e-06, 1e-4)
    near(x["sB"], 3.903e-05, 1e-3)
    near(x["u_A"], 3.384e-05, 1e-3)
    near(x["u_max"], 5.3761e-05, 1e-4)
    p = {r["arm"]: r for r in rs.sign_flip(df, "arm", "seed", "theta", 10**15).collect()}
    assert round(p["A"]["p"], 4) == 0.7546 and round(p["B"]["p"], 4) == 0.0625
    assert p["A"]["floor"] == 0.000244140625
    by_arm = df.groupBy("arm").agg((F.kurtosis("theta")).alias("k"))
    assert by_arm.count() == 2
