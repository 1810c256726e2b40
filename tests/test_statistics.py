import math

from pyspark.sql import functions as F

from meltwise.functions import statistics as st


def test_tails_against_closed_forms(spark):
    xs = [0.0, 0.3, 1.0, 2.5, 7.0, 30.0, 200.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double")
    c = F.col("x")
    got = rows.select(
        "x", st.chi2_tail(c, F.lit(2.0)).alias("two"), st.chi2_tail(c, F.lit(1.0)).alias("one"), st.chi2_tail(c, F.lit(6.0)).alias("six"),
        st.t_two_sided(c, F.lit(1.0)).alias("t1"), st.t_two_sided(-c, F.lit(2.0)).alias("t2"), st.t_two_sided(c, F.lit(4.0)).alias("t4"), st.t_two_sided(c, F.lit(1e5)).alias("many"),
        st.beta_share(F.lit(3.0), F.lit(2.0), F.least(c / 8, F.lit(1.0))).alias("beta"), st.log_gamma(c + 0.5).alias("lg")).collect()
    for r in got:
        x, h = r.x, r.x / 2
        want = {
            "two": math.exp(-h), "one": math.erfc(math.sqrt(h)), "six": math.exp(-h) * (1 + h + h * h / 2), "t1": 1 - 2 / math.pi * math.atan(x), "t2": 1 - x / math.sqrt(2 + x * x),
            "t4": 1 - x * (x * x + 6) / (x * x + 4) ** 1.5, "beta": (lambda p: 4 * p**3 - 3 * p**4)(min(x / 8, 1)), "lg": math.lgamma(x + 0.5),
        }
        for name, w in want.items():
            assert abs(r[name] - w) < 1e-10 * max(1, abs(w)), (name, x, r[name], w)
        assert abs(r.many - math.erfc(x / math.sqrt(2))) < 2e-5
