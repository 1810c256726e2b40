"""Random compositions as Spark jobs: hash-drawn, so a run repeats exactly on any engine and whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise.operators.common import top_n

c = F.col
BALANCE = "Ni"
MAJOR = 1.0  # amount above which a component is a deliberate addition


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def fit(compositions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How (entity, composition) rows are built: components (component, kind, freq, lo, hi), kind major or minor, and sizes (k, before, upto, total).

    ``freq`` is the share of rows with such an amount. The sizes are the running counts of rows by their number of deliberate additions.
    Both are as large as the vocabulary.
    """
    parts = compositions.select("entity", F.explode("composition").alias("component", "amount")).where((c("amount") > 0) & (c("component") != BALANCE))
    n = compositions.agg(F.count("*").alias("_n"))
    kinds = parts.groupBy("component", F.when(c("amount") > MAJOR, "major").otherwise("minor").alias("kind")).agg(F.count("*").alias("m"), F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    model = kinds.crossJoin(F.broadcast(n)).select("component", "kind", (c("m") / c("_n")).alias("freq"), "lo", "hi")
    k = F.size(F.map_filter("composition", lambda e, a: (e != BALANCE) & (a > MAJOR)))
    sizes = compositions.select(k.alias("k")).groupBy("k").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return model, sizes.select("k", (upto - c("m")).alias("before"), upto.alias("upto"), F.sum("m").over(W.partitionBy()).alias("total"))


def _balanced(parts: DataFrame, lo: float, hi: float) -> DataFrame:
    """(id, component, amount) with the balance, for ids whose balance is within its bounds; amounts of 0 go."""
    rest = parts.groupBy("id").agg((100.0 - F.sum("amount")).alias("amount")).where(c("amount").between(lo, hi))
    kept = parts.join(rest.select(c("id").alias("_id")), c("id") == c("_id"), "left_semi")
    return kept.where(c("amount") > 1e-9).select("id", "component", "amount").unionByName(rest.select("id", F.lit(BALANCE).alias("component"), "amount"))


def uniform(ids: DataFrame, bounds: DataFrame, balance: tuple[float, float], seed: str = "42") -> DataFrame:
    """(id, component, amount): every component of ``bounds`` (component, lo, hi) uniform within them; draws whose balance is out of bounds go."""
    parts = ids.select("id").crossJoin(F.broadcast(bounds)).withColumn("amount", c("lo") + (c("hi") - c("lo")) * draw("uniform", seed, c("id"), c("component")))
    return _balanced(parts, *balance)


def sparse(ids: DataFrame, model: DataFrame, sizes: DataFrame, bounds: DataFrame, balance: tuple[float, float], seed: str = "42") -> DataFrame:
    """(id, component, amount): as many deliberate additions as a row of the fitted sizes has, chosen by frequency, and residuals by theirs.

    Sampling without replacement in proportion to the frequencies is a race: each component arrives at an exponential time whose rate is its
    frequency, and the first k are taken. Amounts are uniform in the observed range and kept within the bounds.
    """
    pick = F.floor(draw("size", seed, c("id")) * c("total"))
    sized = ids.select("id").crossJoin(F.broadcast(sizes)).where((pick >= c("before")) & (pick < c("upto"))).select("id", "k")
    major = model.where("kind = 'major'").drop("kind")
    race = sized.crossJoin(F.broadcast(major)).withColumn("_t", -F.log1p(-draw("race", seed, c("id"), c("component"))) / c("freq"))
    chosen = top_n(race, ["id"], [c("_t"), c("component")], 1 << 30, "_r").where(c("_r") <= c("k")).select("id", "component", "lo", "hi")
    minor = model.where("kind = 'minor'").drop("kind")
    some = ids.select("id").crossJoin(F.broadcast(minor)).where(draw("residual", seed, c("id"), c("component")) < c("freq"))
    left = some.join(chosen.select(c("id").alias("_i"), c("component").alias("_c")), (c("id") == c("_i")) & (c("component") == c("_c")), "left_anti").select("id", "component", "lo", "hi")
    drawn = chosen.unionByName(left).withColumn("amount", c("lo") + (c("hi") - c("lo")) * draw("amount", seed, c("id"), c("component"))).drop("lo", "hi")
    within = drawn.join(F.broadcast(bounds), "component").withColumn("amount", F.greatest(c("lo"), F.least(c("hi"), c("amount"))))
    return _balanced(within.select("id", "component", "amount"), *balance)
