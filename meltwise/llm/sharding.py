"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension.

A unit is all documents of one text, so copies share a shard; a group heavier than an eighth of a shard is first cut
into pieces by a hash of the id, because no shard could stay near its size with it whole. Each level of the tree
takes three small aggregations: the extents of every node (which dimension is widest), the weights along it in 256
cells, and the weights inside the median's cell in 4,096 ranges of the text hash. No rows are sorted to find a
median and no node is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltwise.llm.common import ROW, cut, pack, row_key, sums_before, text_column, unpack

BINS = 4096
PIECES = 8


def _name_cell(c: Column) -> Column:
    """A category's place among 256 cells, the same in every run; null is cell 0."""
    return F.coalesce(F.conv(F.substring(F.md5(c.cast("string")), 1, 2), 16, 10).cast("int"), F.lit(0))


def _size_cell(c: Column) -> Column:
    return F.least(F.floor(F.log2(c) * 8), F.lit(255)).cast("int")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("source", "lang"), seed: str = "shard") -> DataFrame:
    """Every row of ``docs`` with its shard and its place in it.

    Give the number of ``shards``, or ``target_bytes`` for as many as that takes. Adds ``size`` (UTF-8 bytes of the text
    plus 1), ``text_crc32``, ``shard``, and ``slot`` (0, 1, ... in each shard, in hash order). ``dimensions`` are the category columns
    beside the size; those that ``docs`` lacks are left out.

    Null text: size 1, one group with the empty text. Null metadata: cell 0. Null id: ordered by its text. Repeated rows each
    get a slot. Empty table: no rows. With fewer groups than shards some shards stay empty.
    """
    spark, text = docs.sparkSession, F.coalesce(text_column(docs), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    names = [c for c in dimensions if c in docs.columns]
    facts = docs.select(F.md5(text).alias("_g"), size.alias("_w"), F.xxhash64(docs["doc_id"]).alias("_r"), _size_cell(size).alias("_d0"), *[_name_cell(docs[c]).alias(f"_d{i + 1}") for i, c in enumerate(names)])
    total = facts.agg(F.coalesce(F.sum("_w"), F.lit(0))).first()[0]
    leaves = shards or max(1, -(-total // target_bytes))
    heavy_from = max(1, total // leaves // PIECES)
    groups = facts.groupBy("_g").agg(F.sum("_w").alias("_gw"))
    heavy = cut(groups.where(F.col("_gw") > heavy_from).select(F.col("_g").alias("_hg"), F.ceil(F.col("_gw") / heavy_from).cast("int").alias("_pieces")))  # at most leaves x PIECES rows

    def piece(df: DataFrame) -> DataFrame:
        df = df.join(F.broadcast(heavy), F.col("_g") == F.col("_hg"), "left")
        return df.withColumn("_piece", F.pmod(F.col("_r"), F.coalesce("_pieces", F.lit(1)))).drop("_hg", "_pieces")

    dims = [f"_d{i}" for i in range(len(names) + 1)]
    units = piece(facts).groupBy("_g", "_piece").agg(F.sum("_w").alias("_w"), *[F.min(d).alias(d) for d in dims])
    units = units.withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws(":", "_g", "_piece")), 1, 8), 16, 10).cast("long"))
    units = cut(units.withColumn("_lo", F.lit(0)).withColumn("_n", F.lit(leaves)))
    depth = (leaves - 1).bit_length()
    for _ in range(depth):
        units = _split(units, dims)
    tree = units.select(F.col("_g").alias("_ug"), F.col("_piece").alias("_up"), F.col("_lo").alias("_shard"))
    rows = pack(docs, _g=F.md5(text), _w=size, _crc=F.crc32(text), _r=F.xxhash64(docs["doc_id"]), _key=row_key(seed, docs["doc_id"], text_column(docs)))
    rows = piece(rows).join(tree, (F.col("_g") == F.col("_ug")) & (F.col("_piece") == F.col("_up")))
    rows = rows.select(ROW, "_w", "_crc", "_key", "_g", "_shard", F.substring("_key", 1, 3).alias("_bucket"), F.lit(1).alias("_one"))
    rows = sums_before(rows, "_shard", "_bucket", ["_key", "_g"], "_one", "_slot")
    return unpack(rows, docs.columns, size=F.col("_w"), text_crc32=F.col("_crc"), shard=F.col("_shard").cast("int"), slot=F.col("_slot"))


def _split(units: DataFrame, dims: list[str]) -> DataFrame:
    """One level: every node (_lo, _n) of more than one leaf is cut in two at its weighted median.

    The node tables have at most one row per leaf, a parameter; they are what is broadcast here.
    """
    open_units = units.where("_n > 1")
    extents = open_units.groupBy("_lo").agg(
        F.sum("_w").alias("_total"), F.min("_h").alias("_h0"), F.max("_h").alias("_h1"),
        F.max("_n").alias("_leaves"), *[(F.max(d) - F.min(d)).alias(f"{d}x") for d in dims],
    )
    widest = F.greatest(*[F.col(f"{d}x") for d in dims]) if len(dims) > 1 else F.col(f"{dims[0]}x")
    axis = F.coalesce(*[F.when(F.col(f"{d}x") == widest, F.lit(i)) for i, d in enumerate(dims)])
    left = F.ceil(F.col("_leaves") / 2).cast("int")
    nodes = cut(extents.select(F.col("_lo").alias("_node"), "_h0", "_h1", left.alias("_left"), (F.col("_total") * left / F.col("_leaves")).alias("_goal"), axis.alias("_axis")))
    cell = F.coalesce(*[F.when(F.col("_axis") == i, F.col(d)) for i, d in enumerate(dims)])
    slot = F.floor((F.col("_h") - F.col("_h0")) * F.lit(float(BINS)) / (F.col("_h1") - F.col("_h0") + 1)).cast("int")
    placed = units.join(F.broadcast(nodes), F.col("_lo") == F.col("_node"), "left").withColumn("_cell", cell).withColumn("_bin", slot)
    upto = Window.partitionBy("_node").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)

    by_cell = placed.where("_node is not null").groupBy("_node", "_goal", F.col("_cell").alias("_at")).agg(F.sum("_w").alias("_s")).withColumn("_c", F.sum("_s").over(upto))
    mid = by_cell.where(F.col("_c") >= F.col("_goal")).groupBy("_node").agg(F.min(F.struct("_at", (F.col("_c") - F.col("_s")).alias("before"))).alias("_m"))
    mid = cut(mid.select(F.col("_node").alias("_mnode"), F.col("_m._at").alias("_mcell"), F.col("_m.before").alias("_mbefore")))
    placed = placed.join(F.broadcast(mid), F.col("_node") == F.col("_mnode"), "left")
    by_bin = placed.where(F.col("_cell") == F.col("_mcell")).groupBy("_node", "_goal", "_mbefore", F.col("_bin").alias("_at")).agg(F.sum("_w").alias("_s")).withColumn("_c", F.sum("_s").over(upto) + F.col("_mbefore"))
    # the cut lies after the range whose sum is nearest to the goal, or before the first range of the cell
    gap = lambda c: F.abs(c - F.col("_goal"))
    ends = by_bin.groupBy("_node").agg(F.min(F.struct(gap(F.col("_c")).alias("gap"), F.col("_at").alias("at"))).alias("_b"), F.min(gap(F.col("_mbefore"))).alias("_gap0"))
    ends = ends.select(F.col("_node").alias("_enode"), F.when(F.col("_gap0") < F.col("_b.gap"), F.lit(-1)).otherwise(F.col("_b.at")).alias("_end"))
    placed = placed.join(F.broadcast(ends), F.col("_node") == F.col("_enode"), "left")
    right = (F.col("_cell") > F.col("_mcell")) | ((F.col("_cell") == F.col("_mcell")) & (F.col("_bin") > F.col("_end")))
    lo = F.when(F.col("_node").isNull() | ~right, F.col("_lo")).otherwise(F.col("_lo") + F.col("_left"))
    n = F.when(F.col("_node").isNull(), F.col("_n")).when(right, F.col("_n") - F.col("_left")).otherwise(F.col("_left"))
    return cut(placed.select("_g", "_piece", "_w", *dims, "_h", lo.alias("_lo"), n.alias("_n")))
