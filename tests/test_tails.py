"""Tails and quantiles as column expressions against independent numbers."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from contrapair.functions import critical, tails


def values(spark, rows, names, column):
    schema = ", ".join(f"{n} double" for n in names.split())
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 11.5, 100.0, 5000.0]
    for x, got in zip(xs, values(spark, [(x,) for x in xs], "x", tails.log_gamma(F.col("x"))), strict=True):
        assert abs(got - math.lgamma(x)) < 1e-11 * max(1, abs(math.lgamma(x)))


def test_student_tails_in_closed_form(spark):
    rows = [(t, df) for t in (-3.0, -0.5, 0.0, 0.4, 2.0, 31.8) for df in (1.0, 2.0, 4.0)]
    got = values(spark, rows, "t df", tails.t_sf(F.col("t"), F.col("df")))
    for (t, df), p in zip(rows, got, strict=True):
        if df == 1:
            want = 0.5 - math.atan(t) / math.pi
        elif df == 2:
            want = 0.5 - t / (2 * math.sqrt(2 + t * t))
        else:
            want = 0.5 - t * (t * t + 6) / (2 * (t * t + 4) ** 1.5)
        assert abs(p - want) < 1e-12, (t, df)


@pytest.mark.parametrize("p", [0.005, 0.2, 0.5, 0.99, 0.995])
def test_quantiles_invert_tails(spark, p):
    dfs = [1.0, 2.0, 3.7, 11.0, 21.9, 400.0]
    rows = [(df,) for df in dfs]
    q = values(spark, rows, "df", tails.t_quantile(F.lit(p), F.col("df")))
    for df, x in zip(dfs, q, strict=True):
        assert abs(x - critical.t_quantile(p, df)) < 1e-8 * max(1, abs(x)), df
    z = values(spark, [(p,)], "p", tails.normal_quantile(F.col("p")))[0]
    assert abs(0.5 * math.erfc(-z / math.sqrt(2)) - p) < 1e-13


def test_f_tail_is_the_squared_student_tail(spark):
    rows = [(t, df) for t in (0.3, 1.7, 4.0) for df in (3.0, 15.0)]
    f = values(spark, rows, "t df", tails.f_sf(F.col("t") * F.col("t"), F.lit(1.0), F.col("df")))
    s = values(spark, rows, "t df", tails.t_sf(F.col("t"), F.col("df")) * 2)
    assert all(abs(a - b) < 1e-11 for a, b in zip(f, s, strict=True))


def test_outside_the_range(spark):
    rows = [(0.0, 5.0), (1.0, 5.0), (0.9, 0.0)]
    assert values(spark, rows, "p df", tails.t_quantile(F.col("p"), F.col("df"))) == [None] * 3
    assert values(spark, [(0.0,), (1.0,)], "p", tails.normal_quantile(F.col("p"))) == [None, None]
    assert values(spark, [(1.0, 0.0)], "t df", tails.t_sf(F.col("t"), F.col("df"))) == [None]
    assert values(spark, [(-2.0,)], "f", tails.f_sf(F.col("f"), F.lit(3), F.lit(4))) == [1.0]


def test_sql_says_the_same(spark):
    con = duckdb.connect()
    one = lambda e: con.execute(f"SELECT {e} FROM ({tails.NODES_SQL})").fetchall()[0][0]
    cases = [(tails.t_sf(F.col("a"), F.col("b")), tails.t_sf_sql("2.3::DOUBLE", "7.5::DOUBLE"), (2.3, 7.5)),
             (tails.t_sf(F.col("a"), F.col("b")), tails.t_sf_sql("0.0::DOUBLE", "7.5::DOUBLE"), (0.0, 7.5)),
             (tails.t_quantile(F.col("a"), F.col("b")), tails.t_quantile_sql("0.99::DOUBLE", "3.25::DOUBLE"), (0.99, 3.25)),
             (tails.f_sf(F.col("a"), F.lit(11), F.col("b")), tails.f_sf_sql("1.4::DOUBLE", "11", "99::DOUBLE"), (1.4, 99.0)),
             (tails.normal_cdf(F.col("a")), tails.normal_cdf_sql("-1.3::DOUBLE"), (-1.3, 0.0)),
             (tails.normal_quantile(F.col("a")), tails.normal_quantile_sql("0.15::DOUBLE"), (0.15, 0.0))]
    for column, sql, row in cases:
        assert abs(values(spark, [row], "a b", column)[0] - one(sql)) < 1e-11, sql[:60]
