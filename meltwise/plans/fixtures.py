"""Domain-shaped views over the driver tables, as lazy DataFrames.

Every view is an aggregate or projection of the given tables, so its size follows theirs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.operators.common import const_table, rnd


LINES_A_TASK = 125_000


class Tables:
    """Lazy access to the base tables and to the fixture views built from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """``lineitem`` spread by order over as many tasks as its rows ask for.

        What is grouped or joined by entity, with or without further keys, then needs no other shuffle of it, and a task's
        share stays the same however large the table is.
        """
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-self.lineitem.count() // LINES_A_TASK))
        return self.lineitem.repartition(tasks, "l_orderkey")

    @cached_property
    def element_idx(self) -> DataFrame:
        rows = [(i + 1, c) for i, c in enumerate(K.FIXTURE_COMPONENTS)]
        return const_table(self.spark, rows, "idx int, component string")

    @cached_property
    def comp(self) -> DataFrame:
        """entity, composition MAP: 45 parts shared by ordered quantity, 55 parts Ni."""
        parts = (
            self.lines.groupBy(
                "l_orderkey", (F.col("l_partkey") % 19 + 1).cast("int").alias("idx")
            )
            .agg(F.sum("l_quantity").alias("q"))
            .join(F.broadcast(self.element_idx), "idx")
            .groupBy(F.col("l_orderkey").alias("entity"))
            .agg(F.collect_list(F.struct("component", "q")).alias("parts"), F.sum("q").alias("t"))
        )
        shares = F.transform("parts", lambda p: F.struct(p["component"], p["q"] / F.col("t") * 45.0))
        nickel = F.create_map(F.lit("Ni"), F.lit(55.0))
        return parts.select(
            "entity", F.map_concat(F.map_from_entries(shares), nickel).alias("composition")
        )

    @cached_property
    def comp_raw(self) -> DataFrame:
        """As ``comp`` but with totals of 85 to 124, for the closure rules."""
        scale = 0.853 + (F.col("entity") % 40) / 100.0
        return self.comp.select(
            "entity", F.transform_values("composition", lambda _, v: v * scale).alias("composition")
        )

    @cached_property
    def comp_long(self) -> DataFrame:
        return self.comp.select("entity", F.explode("composition").alias("component", "amount"))

    @cached_property
    def entity(self) -> DataFrame:
        suffix = F.element_at(
            F.array(*[F.lit(s) for s in (" bar", "(SC)", " cast", " wrought", "")]),
            (F.col("o_orderkey") % 5 + 1).cast("int"),
        )
        conf = F.element_at(
            F.array(*[F.lit(s) for s in ("HIGH", "MEDIUM", "LOW", "UNKNOWN")]),
            (F.col("o_orderkey") % 4 + 1).cast("int"),
        )
        return self.orders.select(
            F.col("o_orderkey").alias("entity"),
            F.concat(F.lit("ALLOY* "), (F.col("o_custkey") % 300).cast("string"), suffix).alias("name"),
            F.when(F.col("o_orderkey") % 2 == 0, "wrought").otherwise("cast").alias("route"),
            F.col("o_orderstatus").alias("src"),
            conf.alias("conf"),
        )

    @cached_property
    def measurement_set(self) -> DataFrame:
        """entity, property, temp_c, value without list positions (no window needed)."""
        prop = F.element_at(
            F.array(*[F.lit(p) for p in K.PROPERTIES]), (F.col("l_linenumber") % 4 + 1).cast("int")
        )
        return self.lines.groupBy(
            F.col("l_orderkey").alias("entity"),
            prop.alias("property"),
            (20 + 93 * (F.col("l_suppkey") % 13)).cast("int").alias("temp_c"),
        ).agg(rnd(F.avg("l_extendedprice") / 100.0, 6).alias("value"))

    @cached_property
    def measurement(self) -> DataFrame:
        series = W.partitionBy("entity", "property").orderBy(F.desc("temp_c"))
        return self.measurement_set.withColumn("pos", F.row_number().over(series))

    @cached_property
    def pred(self) -> DataFrame:
        """Three arms by three seeds over every measurement."""
        arms = F.explode(F.array(*[F.lit(a) for a in range(3)])).alias("arm")
        seeds = F.explode(F.array(*[F.lit(s) for s in (42, 43, 44)])).alias("seed")
        noise = (
            (F.col("entity") * 31 + F.col("temp_c") * 17 + F.col("arm") * 7 + F.col("seed")) % 41 - 20
        ) / 100.0
        return (
            self.measurement_set.select("*", arms)
            .select("*", seeds)
            .where(~((F.col("arm") == 2) & (F.col("entity") % 17 == 0)))
            .select(
                "arm", "seed", "entity", "temp_c", "property",
                F.when(F.col("entity") % 97 == 0, 0.0).otherwise(F.col("value")).alias("actual"),
                (F.col("value") * (1 + noise)).alias("pred"),
            )
        )

    @cached_property
    def stratum(self) -> DataFrame:
        from meltwise.functions.buckets import stratum_of

        distance = (F.col("o_orderkey") % 90) / 10.0
        return self.orders.select(
            F.col("o_orderkey").alias("entity"),
            distance.alias("distance"),
            stratum_of(distance).alias("stratum"),
        )

    @cached_property
    def interval(self) -> DataFrame:
        value = F.col("value")
        return (
            self.pred.where((F.col("arm") == 0) & (F.col("seed") == 42))
            .select(
                "entity", "temp_c", "property", "actual", "pred",
                (F.col("pred") - 0.15 * F.col("pred")).alias("lower"),
                (F.col("pred") + 0.15 * F.col("pred")).alias("upper"),
            )
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Edits on one component per listed entity: set, add or withdraw."""
        component = F.element_at(
            F.array(F.lit("Cr"), F.lit("Y"), F.lit("Al")), (F.col("entity") % 3 + 1).cast("int")
        )
        value = F.when(F.col("entity") % 3 == 2, F.lit(None).cast("double")).otherwise(
            (F.col("entity") % 7) * 1.5
        )
        return self.orders.select(F.col("o_orderkey").alias("entity")).where(
            F.col("entity") % 50 == 0
        ).select("entity", F.lit("composition").alias("field"), component.alias("component"),
                 value.alias("to_value"))

    @cached_property
    def job(self) -> DataFrame:
        status = (
            F.when(F.col("event_type") == "signup", "pending")
            .when(F.col("event_type").isin("view", "click"), "running")
            .when(F.col("event_type") == "purchase", "done")
            .otherwise("failed")
        )
        return self.events.select(
            F.col("user_id").alias("key"),
            F.when(F.col("user_id") % 2 == 0, "evaluate").otherwise("design").alias("kind"),
            status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("payload"), "event_id",
        )

    @cached_property
    def question(self) -> DataFrame:
        """Multiple-choice items: one value and three others from neighbouring parts."""
        price = self.part.select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
        p = self.part.select(
            F.col("p_partkey").alias("id"), "p_brand", "p_retailprice",
        )
        for i, name in enumerate(("d1", "d2", "d3"), start=1):
            p = p.join(price.select((F.col("k") - i).alias("id"), F.col("v").alias(name)), "id")
        fmt = lambda c: F.format_string("%.2f", F.col(c))
        slot = F.col("id") % 4
        options = [
            F.when(slot == i, fmt("p_retailprice")).when(slot > i, fmt(lo)).otherwise(fmt(hi))
            for i, (lo, hi) in enumerate((("d1", "d1"), ("d2", "d1"), ("d3", "d2"), ("d3", "d3")))
        ]
        letter = F.element_at(
            F.array(*[F.lit(x) for x in "ABCD"]), (F.col("id") * 7 % 4 + 1).cast("int")
        )
        kind = F.col("id") % 5
        response = (
            F.when(kind == 0, F.concat(F.lit("I compared them.\nANSWER: "), letter))
            .when(kind == 1, F.concat(F.lit("("), letter, F.lit(") because it is larger")))
            .when(kind == 2, F.concat(F.lit("So **"), letter, F.lit(")** holds")))
            .when(kind == 3, F.concat(F.lit("the value is "), fmt("d2"), F.lit(" MPa")))
            .otherwise(F.lit("no idea"))
        )
        return p.select(
            "id", F.col("p_brand").alias("subtype"),
            *[o.alias(f"option_{x}") for o, x in zip(options, "abcd")],
            F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), (slot + 1).cast("int")).alias("correct"),
            response.alias("response"),
        )

    @cached_property
    def answer(self) -> DataFrame:
        """Panel scores 1 to 5 per question, system and criterion; some are missing."""
        return (
            self.part.select(F.col("p_partkey").alias("question_id"),
                             F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("system"))
            .select("*", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("criterion"))
            .select(
                "question_id", "system", "criterion",
                F.when((F.col("question_id") + F.col("system") * 3 + F.col("criterion") * 5) % 11 == 0,
                       F.lit(None).cast("int"))
                .otherwise(((F.col("question_id") * 7 + F.col("system") * 13 + F.col("criterion") * 3)
                            % 5 + 1).cast("int")).alias("score"),
            )
        )

    @cached_property
    def features(self) -> DataFrame:
        from meltwise.operators.features import featurize

        return featurize(self.comp)
