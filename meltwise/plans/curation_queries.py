"""Joins, ledgers, splits, provenance and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions import classify, text
from meltwise.functions.routes import compatible, mismatch
from meltwise.operators import joins, ranks
from meltwise.operators.common import const_table, first_row, part_of as p, rnd, top_n
from meltwise.plans.fixture_sql import FIXTURE_SQL
from meltwise.plans.metric_queries import arms_wide
from meltwise.plans.registry import query

c = F.col


@query("tolerance_join", """
    SELECT entity, "at", property, arg_min(value, pos) AS value, arg_min(temp_c, pos) AS temp_c
    FROM (SELECT DISTINCT entity, temp_c + 3 AS "at" FROM f_measurement) r JOIN f_measurement m USING (entity)
    WHERE abs(m.temp_c - "at") < 5 GROUP BY ALL""")
def tolerance_join(t):
    rows = t.measurement_set.select("entity", (c("temp_c") + 3).alias("at")).distinct()
    return joins.tolerance_join(rows, t.measurement, ["entity"])


@query("nearest_temp", """
    SELECT entity, property, arg_min(value, (abs(temp_c - 600), pos)) AS value, arg_min(temp_c, (abs(temp_c - 600), pos)) AS temp_c,
      arg_min(value, (abs(temp_c - 600), pos)) FILTER (abs(temp_c - 600) < 50) AS bounded_value,
      CASE WHEN bool_or(temp_c = 600) THEN 'exact' ELSE 'nearest' END AS how
    FROM f_measurement GROUP BY ALL""")
def nearest_temp(t):
    keys = ["entity", "property"]
    free = joins.exact_then_nearest(t.measurement, keys, 600)
    bounded = joins.nearest_temperature(t.measurement, keys, F.lit(600), 50.0).select(*keys, c("value").alias("bounded_value"))
    return free.join(bounded, keys, "left")


@query("route_compat", """
    WITH r AS (SELECT * FROM (VALUES ('wrought'), ('cast'), ('wrought bar'), (''), (NULL), ('unknown')) r(kg_route))
    SELECT route, kg_route, count(*) AS n,
      route <> '' AND coalesce(kg_route, '') <> '' AND (contains(route, kg_route) OR contains(kg_route, route)) AS same,
      coalesce(kg_route, '') NOT IN ('', 'unknown') AND NOT (contains(route, kg_route) OR contains(kg_route, route)) AS clash
    FROM f_entity, r GROUP BY ALL""")
def route_compat(t):
    """Entities per route against declared neighbour routes; counted before the pairing."""
    routes = const_table(t.spark, [("wrought",), ("cast",), ("wrought bar",), ("",), (None,), ("unknown",)], "kg_route string")
    n = t.entity.groupBy("route").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(routes), F.lit(True)).select(
        "route", "kg_route", "n", compatible(c("route"), c("kg_route")).alias("same"), mismatch(c("route"), c("kg_route")).alias("clash"))


@query("fallback_fill", """
    SELECT entity, name, coalesce(own, first_value(own IGNORE NULLS) OVER (PARTITION BY name ORDER BY entity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS size,
      own IS NULL AND max(own) OVER (PARTITION BY name) IS NOT NULL AS filled
    FROM (SELECT entity, name, CASE WHEN entity % 3 = 0 THEN NULL ELSE n END AS own FROM f_entity
      JOIN (SELECT entity, count(*) AS n FROM f_comp_long GROUP BY 1) USING (entity))""")
def fallback_fill(t):
    """A variant without composition takes the first non-empty one of the same name (shown as its size)."""
    size = F.size("composition").cast("long")
    x = t.comp.join(t.entity.select("entity", "name"), "entity").select(
        "entity", "name", F.when(c("entity") % 3 != 0, size).alias("size"))
    return joins.fallback_fill(x, "name", "size", "entity").select("entity", "name", "size", "filled")


@query("leakage_by_name", """
    WITH n AS (SELECT entity, route, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM f_entity)
    SELECT count(*) AS evaluated, count(*) FILTER (k IN (SELECT k FROM n WHERE route = 'wrought')) AS leaked,
      count(DISTINCT k) AS names FROM n WHERE route = 'cast'""")
def leakage_by_name(t):
    x = t.entity.select("entity", "route", text.compact_name(c("name")).alias("k"))
    train = x.where(c("route") == "wrought").select("k", F.lit(True).alias("seen")).distinct()
    return x.where(c("route") == "cast").join(train, "k", "left").agg(
        F.count("*").alias("evaluated"), F.count("seen").alias("leaked"), F.count_distinct("k").alias("names"))


@query("seen_unseen", """
    WITH n AS (SELECT entity, route, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM f_entity),
     s AS (SELECT a.entity, CASE WHEN a.k IN (SELECT k FROM n WHERE route = 'wrought' AND entity % 2 = 0) THEN 'seen' ELSE 'unseen' END AS split FROM n a)
    SELECT property, CASE WHEN grouping(split) = 1 THEN 'ALL' ELSE split END AS split, count(*) AS n, round(avg(abs(p0 - actual)), 6) AS mae
    FROM f_arms JOIN s USING (entity) WHERE actual <> 0 GROUP BY GROUPING SETS ((property, split), (property))""")
def seen_unseen(t):
    x = t.entity.select("entity", "route", text.compact_name(c("name")).alias("k"))
    train = x.where(c("route") == "wrought").select("k", F.lit("seen").alias("split")).distinct()
    s = x.join(train, "k", "left").select("entity", F.coalesce("split", F.lit("unseen")).alias("split"))
    y = arms_wide(t).where(c("actual") != 0).join(s, "entity")
    keys = [c("property"), c("split")]
    return y.groupingSets([keys, keys[:1]], *keys).agg(
        F.grouping("split").alias("g"), F.count("*").alias("n"), rnd(F.avg(F.abs(c("p0") - c("actual")))).alias("mae")
    ).select("property", F.when(c("g") == 1, "ALL").otherwise(c("split")).alias("split"), "n", "mae")


def cells(t):
    return t.comp_long.select("entity", "component", c("amount").alias("value"))


def ledger_edits(t):
    return t.ledger.select("entity", "component", "to_value")


FIXTURE_SQL["f_edited"] = """
    SELECT coalesce(c.entity, l.entity) AS entity, coalesce(c.component, l.component) AS component,
      CASE WHEN l.entity IS NOT NULL THEN to_value ELSE amount END AS value,
      CASE WHEN l.entity IS NULL THEN 'kept' WHEN c.entity IS NOT NULL AND to_value IS NULL THEN 'withdrawn' WHEN c.entity IS NULL AND to_value IS NULL THEN 'absent'
        WHEN c.entity IS NULL THEN 'added' WHEN amount = to_value THEN 'unchanged' ELSE 'set' END AS outcome
    FROM f_comp_long c FULL JOIN f_ledger l ON c.entity = l.entity AND c.component = l.component"""


@query("apply_ledger", "SELECT entity, component, round(value, 8) AS value, outcome FROM f_edited")
def apply_ledger(t):
    x = joins.apply_ledger(cells(t), ledger_edits(t), ["entity", "component"])
    return x.withColumn("value", rnd(c("value"), 8))


@query("cell_diff", """
    SELECT kind, count(*) AS cells, count(DISTINCT entity) AS entities FROM (
      SELECT coalesce(a.entity, b.entity) AS entity, CASE WHEN a.entity IS NULL THEN 'added' WHEN b.entity IS NULL THEN 'removed' ELSE 'changed' END AS kind
      FROM f_comp_long a FULL JOIN (SELECT * FROM f_edited WHERE outcome NOT IN ('withdrawn', 'absent')) b ON a.entity = b.entity AND a.component = b.component
      WHERE a.amount IS DISTINCT FROM b.value) GROUP BY kind""")
def cell_diff(t):
    """Cell-level comparison of the records before and after the ledger."""
    edited = joins.apply_ledger(cells(t), ledger_edits(t), ["entity", "component"])
    new = edited.where(~c("outcome").isin("withdrawn", "absent")).select("entity", "component", "value")
    return joins.cell_diff(cells(t), new, ["entity", "component"]).groupBy("kind").agg(
        F.count("*").alias("cells"), F.count_distinct("entity").alias("entities"))


@query("apply_cell_edit", """
    WITH e AS (SELECT o_orderkey AS entity, 'ys' AS property, 20.3::DOUBLE + 93 * (o_orderkey % 13) AS t, 111.0::DOUBLE AS to_value FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT p.arm, count(*) AS rows, count(e.entity) AS edited, round(sum(coalesce(to_value, actual)), 2) AS actual_sum
    FROM f_seed42 p LEFT JOIN e ON p.entity = e.entity AND p.property = e.property AND abs(p.temp_c - e.t) < 0.5 GROUP BY p.arm""")
def apply_cell_edit(t):
    """Named cells of run tables edited with a temperature tolerance, counted before anything is written."""
    edits = t.orders.where(c("o_orderpriority") == "1-URGENT").select(
        c("o_orderkey").alias("entity"), F.lit("ys").alias("property"), (20.3 + 93 * (c("o_orderkey") % 13)).alias("t"), F.lit(111.0).alias("to_value"))
    rows = t.pred.where(c("seed") == 42)
    a, b = rows.alias("a"), edits.alias("b")
    x = a.join(b, (c("a.entity") == c("b.entity")) & (c("a.property") == c("b.property")) & (F.abs(c("temp_c") - c("t")) < 0.5), "left")
    return x.groupBy("arm").agg(F.count("*").alias("rows"), F.count("to_value").alias("edited"),
                                rnd(F.sum(F.coalesce("to_value", "actual")), 2).alias("actual_sum"))


@query("exclusion_list", """
    SELECT entity, CASE WHEN al >= 7 THEN 'rule' WHEN disposition = 'drop' THEN 'declared drop' WHEN disposition IS NOT NULL THEN 'routed to ' || disposition ELSE category END AS verdict
    FROM f_scope LEFT JOIN (SELECT 'ALLOY* ' || i || s AS name, CASE WHEN i % 2 = 0 THEN 'drop' ELSE 'other' END AS disposition
      FROM range(10) r(i), (VALUES (' bar'), ('(SC)'), (' cast'), (' wrought'), ('')) x(s)) USING (name)""")
def exclusion_list(t):
    """Rules first, then the declared list (drop or route elsewhere), then the class."""
    declared = const_table(t.spark, [
        (f"ALLOY* {i}{s}", "drop" if i % 2 == 0 else "other") for i in range(10) for s in (" bar", "(SC)", " cast", " wrought", "")],
        "name string, disposition string")
    x = t.comp.join(t.entity.select("entity", "name"), "entity").join(F.broadcast(declared), "name", "left")
    return x.select("entity", F.when(p("Al") >= 7.0, "rule").when(c("disposition") == "drop", "declared drop").when(
        c("disposition").isNotNull(), F.concat(F.lit("routed to "), c("disposition"))).otherwise(
        classify.scope_class(c("name"))["category"]).alias("verdict"))


@query("alias_match", """
    SELECT p_partkey, n_nationkey, n_name FROM (SELECT p_partkey, p_name || ' from nation ' || (p_partkey % 25) AS answer FROM part) JOIN nation
      ON regexp_matches(lower(answer), '(nation[ _]' || n_nationkey || '$)|(\\bn' || n_nationkey || '\\b)')""")
def alias_match(t):
    """Answers that name an alias: the keys that an answer can mean are read off it, then joined on equality."""
    ans = t.part.select("p_partkey", F.lower(F.concat(c("p_name"), F.lit(" from nation "), (c("p_partkey") % 25).cast("string"))).alias("answer"))
    named = F.array_union(F.regexp_extract_all("answer", F.lit(r"nation[ _](\d+)$"), F.lit(1)), F.regexp_extract_all("answer", F.lit(r"\bn(\d+)\b"), F.lit(1)))
    alias = t.nation.select("n_nationkey", "n_name", c("n_nationkey").cast("string").alias("alias"))
    return ans.select("p_partkey", F.explode(named).alias("alias")).join(alias, "alias").select("p_partkey", "n_nationkey", "n_name")


@query("unblind", """
    SELECT system, count(*) AS n, round(avg(score), 6) AS mean FROM f_answer WHERE score IS NOT NULL GROUP BY system""")
def unblind(t):
    """Scores keyed by anonymous label, mapped back through the (question, label) key."""
    label = (c("question_id") + c("system")) % 3
    blind = t.answer.select("question_id", label.alias("label"), "criterion", "score")
    key = t.answer.select("question_id", label.alias("label"), "system").distinct()
    x = blind.join(key, ["question_id", "label"]).where(c("score").isNotNull())
    return x.groupBy("system").agg(F.count("*").alias("n"), rnd(F.avg("score")).alias("mean"))


@query("fs_holdout_anti", """
    SELECT e.entity, e.name, e.route, EXISTS (SELECT 1 FROM f_entity x WHERE x.name = e.name AND x.conf = 'HIGH') AS sibling
    FROM f_entity e WHERE conf NOT IN ('HIGH', 'LOW')""")
def fs_holdout_anti(t):
    """Rows in neither train nor holdout (null-safe key), and whether a sibling name is in train."""
    x = t.entity.withColumn("form", F.when(c("entity") % 2 == 0, "bar"))
    train = x.where(c("conf") == "HIGH").select("entity", c("form").alias("f2"))
    hold = x.where(c("conf") == "LOW").select("entity", c("form").alias("f2"))
    for other in (train, hold):
        o = other.withColumnRenamed("entity", "e2")
        x = x.join(o, (c("entity") == c("e2")) & c("form").eqNullSafe(c("f2")), "left_anti")
    names = t.entity.where(c("conf") == "HIGH").select("name", F.lit(True).alias("sib")).distinct()
    return x.join(names, "name", "left").select("entity", "name", "route", F.coalesce("sib", F.lit(False)).alias("sibling"))


FIXTURE_SQL["f_ret"] = """
    SELECT r.entity, r.property, r.value AS rt, h.value AS ht FROM f_measurement r JOIN f_measurement h
      ON r.entity = h.entity AND r.property = h.property AND r.temp_c = 20 AND h.temp_c = 671"""


def retention(t, hot: int = 671):
    at = lambda x: F.max(F.when(c("temp_c") == x, c("value")))
    return t.measurement_set.where(c("temp_c").isin(20, hot)).groupBy("entity", "property").agg(
        at(20).alias("rt"), at(hot).alias("ht")).where(c("rt").isNotNull() & c("ht").isNotNull())


@query("rt_ht_pair", "SELECT entity, property, rt, ht, round(ht / rt, 8) AS retention FROM f_ret")
def rt_ht_pair(t):
    return retention(t).withColumn("retention", rnd(c("ht") / c("rt"), 8))


@query("targets_x_candidates", """
    WITH g AS (SELECT * FROM (VALUES (1, 'ys', 300.0), (1, 'uts', 400.0), (2, 'ys', 600.0), (2, 'el', 200.0), (3, 'em', 150.0)) g(target, property, goal))
    SELECT entity, target, count(*) AS goals_seen, count(*) FILTER (value >= 0.9::DOUBLE * goal) AS hits FROM
      (SELECT entity, property, max(value) AS value FROM f_measurement GROUP BY ALL) JOIN g USING (property) GROUP BY entity, target""")
def targets_x_candidates(t):
    """Every candidate against every target spec: an equi join on property with the declared goals."""
    goals = const_table(t.spark, GOALS, "target int, property string, goal double")
    best = t.measurement_set.groupBy("entity", "property").agg(F.max("value").alias("value"))
    return best.join(F.broadcast(goals), "property").groupBy("entity", "target").agg(
        F.count("*").alias("goals_seen"), F.count_if(c("value") >= 0.9 * c("goal")).alias("hits"))


GOALS = [(1, "ys", 300.0), (1, "uts", 400.0), (2, "ys", 600.0), (2, "el", 200.0), (3, "em", 150.0)]


@query("best_of_n", """
    WITH g AS (SELECT * FROM (VALUES (1, 'ys', 300.0), (1, 'uts', 400.0), (2, 'ys', 600.0), (2, 'el', 200.0), (3, 'em', 150.0)) g(target, property, goal)),
     v AS (SELECT entity, property, max(value) AS value FROM f_measurement GROUP BY ALL),
     h AS (SELECT target, entity, count(*) FILTER (value >= 0.9::DOUBLE * goal) AS hits FROM v JOIN g USING (property) GROUP BY ALL)
    SELECT DISTINCT ON (target) target, entity, hits, passes, safe FROM (
      SELECT target, h.entity, hits, len(failed) = 0 AS passes, tcp_risk <> 'Critical' AS safe FROM h JOIN f_plaus p ON p.entity = h.entity JOIN f_feat f ON f.entity = h.entity)
    ORDER BY target, passes DESC, safe DESC, hits DESC, entity""")
def best_of_n(t):
    """Best candidate per target by (plausible, not critical, hits), first wins: every candidate meets every target, one aggregate."""
    from meltwise.operators.validate import plausibility

    failed, _, _ = plausibility()
    ok = t.comp.join(t.entity.select("entity", "route"), "entity").select("entity", (F.size(failed) == 0).alias("passes"))
    safe = t.features.select("entity", (c("tcp_risk") != "Critical").alias("safe"))
    goals = const_table(t.spark, GOALS, "target int, property string, goal double")
    best = t.measurement_set.groupBy("entity", "property").agg(F.max("value").alias("value"))
    hits = best.join(F.broadcast(goals), "property").groupBy("entity", "target").agg(F.count_if(c("value") >= 0.9 * c("goal")).alias("hits"))
    x = hits.join(ok, "entity").join(safe, "entity")
    top = F.max_by(F.struct("entity", "hits", "passes", "safe"), F.struct("passes", "safe", "hits", -c("entity")))
    return x.groupBy("target").agg(top.alias("b")).select("target", "b.*")


@query("union_sources", "SELECT src, route, count(*) AS n FROM (SELECT 'orders:' || src AS src, route FROM f_entity UNION ALL SELECT 'parts', p_type FROM part) GROUP BY ALL")
def union_sources(t):
    a = t.entity.select(F.concat(F.lit("orders:"), c("src")).alias("src"), "route")
    b = t.part.select(F.lit("parts").alias("src"), c("p_type").alias("route"))
    return a.unionByName(b).groupBy("src", "route").agg(F.count("*").alias("n"))


@query("intersect_keys", """
    SELECT property, count(*) AS n FROM (SELECT entity, temp_c, property FROM f_seed42 WHERE arm = 0 INTERSECT SELECT entity, temp_c, property FROM f_seed42 WHERE arm = 2) GROUP BY 1""")
def intersect_keys(t):
    k = lambda a: t.pred.where((c("seed") == 42) & (c("arm") == a)).select("entity", "temp_c", "property")
    return k(0).intersect(k(2)).groupBy("property").agg(F.count("*").alias("n"))


@query("except_keys", """
    SELECT 'only_0' AS side, count(*) AS n FROM (SELECT entity, temp_c, property FROM f_seed42 WHERE arm = 0 EXCEPT SELECT entity, temp_c, property FROM f_seed42 WHERE arm = 2)
    UNION ALL SELECT 'only_2', count(*) FROM (SELECT entity, temp_c, property FROM f_seed42 WHERE arm = 2 EXCEPT SELECT entity, temp_c, property FROM f_seed42 WHERE arm = 0)""")
def except_keys(t):
    k = lambda a: t.pred.where((c("seed") == 42) & (c("arm") == a)).select("entity", "temp_c", "property")
    side = lambda x, n: x.agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return side(k(0).subtract(k(2)), "only_0").unionByName(side(k(2).subtract(k(0)), "only_2"))


@query("vocabulary", "SELECT component, count(*) AS entities FROM f_comp_long WHERE component NOT IN ('Bal', 'Other') GROUP BY 1")
def vocabulary(t):
    names = t.comp.select(F.explode(F.map_keys("composition")).alias("component"))
    return names.where(~c("component").isin("Bal", "Other")).groupBy("component").agg(F.count("*").alias("entities"))


@query("row_set_equal", """
    WITH l AS (SELECT seed, entity, temp_c, property FROM f_pred WHERE arm = 0), r AS (SELECT seed, entity, temp_c, property FROM f_pred WHERE arm = 2)
    SELECT 'only_left' AS side, count(*) AS n FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'only_right', count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def row_set_equal(t):
    """Whether two arms cover the same keys: arm 2 lacks some entities, and the difference says how many rows."""
    k = lambda a: t.pred.where(c("arm") == a).select("seed", "entity", "temp_c", "property")
    return joins.same_rows(k(0), k(2))


@query("first_seen", """
    SELECT name, entity, src FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE src WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, entity) AS k FROM f_entity) WHERE k = 1""")
def first_seen(t):
    rank = F.when(c("src") == "F", 0).when(c("src") == "O", 1).otherwise(2)
    return first_row(t.entity, ["name"], [rank, c("entity")]).select("name", "entity", "src")


@query("best_proposal", """
    SELECT entity, property, arm, round(pred, 8) AS pred FROM (SELECT *, row_number() OVER (PARTITION BY entity, temp_c, property
      ORDER BY (entity + arm * 7) % 3, arm) AS k FROM f_seed42) WHERE k = 1""")
def best_proposal(t):
    """One proposal per property by (confidence, source priority); the first wins."""
    x = t.pred.where(c("seed") == 42)
    best = F.min_by(F.struct("arm", "pred"), F.struct((c("entity") + c("arm") * 7) % 3, c("arm")))
    g = x.groupBy("entity", "temp_c", "property").agg(best.alias("b"))
    return g.select("entity", "property", "b.arm", rnd(c("b.pred"), 8).alias("pred"))


@query("stratified_split", """
    SELECT s.entity, s.class, s.route, k <= greatest(1, CAST(floor(n * 0.2::DOUBLE) AS BIGINT)) AS test FROM (
      SELECT *, row_number() OVER (PARTITION BY route, class ORDER BY o, entity) AS k, count(*) OVER (PARTITION BY route, class) AS n FROM (
        SELECT entity, route, o_totalprice AS o, CASE WHEN al + ti > 7 THEN 'single_crystal_type' WHEN nb >= 3 AND al + ti < 3 THEN 'gamma_double_prime'
          WHEN al + ti >= 3 THEN 'gamma_prime_high' WHEN al + ti >= 1.5 THEN 'gamma_prime_medium' WHEN mo + w > 10 THEN 'solid_solution' ELSE 'other' END AS class
        FROM f_wide JOIN f_entity USING (entity) JOIN orders ON o_orderkey = entity)) s""")
def stratified_split(t, ratio: float = 0.2):
    """Exact quota per (route, class). Ranks come from sliced running counts, so a stratum with most
    of the rows is spread over many tasks."""
    x = t.comp.join(t.entity.select("entity", "route"), "entity").join(
        t.orders.select(c("o_orderkey").alias("entity"), "o_totalprice"), "entity").select(
        "entity", "route", "o_totalprice", classify.split_class().alias("class"))
    keys = ["route", "class"]
    n = x.groupBy(*keys).agg(F.count("*").alias("n"))
    r = ranks.row_ranks(x, keys, "o_totalprice", "entity", "k").join(n, keys)
    quota = F.greatest(F.lit(1), F.floor(c("n") * ratio))
    return r.select("entity", "class", "route", (c("k") <= quota).alias("test"))


@query("ratio_split", """
    SELECT split, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (SELECT o_orderkey, CASE WHEN k <= CAST(floor(n * 0.8::DOUBLE) AS BIGINT) THEN 'train'
        WHEN k <= CAST(floor(n * 0.9::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split
      FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER () AS n FROM orders)) GROUP BY split""")
def ratio_split(t):
    x = t.orders.select("o_orderkey", "o_totalprice")
    r = ranks.row_ranks(x, [], "o_totalprice", "o_orderkey", "k").crossJoin(F.broadcast(x.agg(F.count("*").alias("n"))))
    split = F.when(c("k") <= F.floor(c("n") * 0.8), "train").when(c("k") <= F.floor(c("n") * 0.9), "val").otherwise("test")
    return r.groupBy(split.alias("split")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("group_split", """
    SELECT fold, count(DISTINCT name) AS names, count(*) AS n FROM (SELECT name, (k - 1) % 5 AS fold FROM f_entity JOIN (
      SELECT name, row_number() OVER (ORDER BY md5(name), name) AS k FROM (SELECT DISTINCT name FROM f_entity)) USING (name)) GROUP BY fold""")
def group_split(t):
    """Folds by entity group: distinct names in hash order, rank modulo K, joined back."""
    names = t.entity.select("name").distinct().withColumn("h", F.md5("name"))
    # The order value is the hash prefix as a number, so the rank needs no global sort.
    x = names.withColumn("o", F.conv(F.substring("h", 1, 12), 16, 10).cast("double"))
    r = ranks.row_ranks(x, [], "o", "h", "k").select("name", ((c("k") - 1) % 5).alias("fold"))
    return t.entity.join(r, "name").groupBy("fold").agg(F.count_distinct("name").alias("names"), F.count("*").alias("n"))


@query("blind_assign", """
    SELECT question_id, system, ['A', 'B', 'C'][row_number() OVER (PARTITION BY question_id ORDER BY md5(question_id || ':' || system))] AS label
    FROM (SELECT DISTINCT question_id, system FROM f_answer)""")
def blind_assign(t):
    w = W.partitionBy("question_id").orderBy(F.md5(F.concat_ws(":", c("question_id").cast("string"), c("system").cast("string"))))
    x = t.answer.select("question_id", "system").distinct()
    return x.select("question_id", "system", F.element_at(F.array(*[F.lit(v) for v in "ABC"]), F.row_number().over(w)).alias("label"))


@query("order_check", """
    WITH a AS (SELECT entity, property, temp_c, row_number() OVER (PARTITION BY entity, property ORDER BY temp_c DESC) AS k FROM f_measurement),
     b AS (SELECT entity, property, temp_c, row_number() OVER (PARTITION BY entity, property ORDER BY value) AS k FROM f_measurement)
    SELECT entity, property, bool_and(a.temp_c = b.temp_c) AS same_order FROM a JOIN b USING (entity, property, k) GROUP BY ALL""")
def order_check(t):
    """Two listings of a series have the same members; do they have the same order? Equal values are in the order of the first listing."""
    w = lambda *o: W.partitionBy("entity", "property").orderBy(*o)
    x = t.measurement_set.select("entity", "property", "temp_c", F.row_number().over(w(F.desc("temp_c"))).alias("k"))
    y = t.measurement_set.select("entity", "property", c("temp_c").alias("t2"), F.row_number().over(w(c("value"), F.desc("temp_c"))).alias("k"))
    return x.join(y, ["entity", "property", "k"]).groupBy("entity", "property").agg(F.bool_and(c("temp_c") == c("t2")).alias("same_order"))


@query("multi_variant", r"""
    WITH n AS (SELECT entity, trim(regexp_replace(trim(replace(lower(name), '*', '')), '\b(wrought|cast|bar|sheet|plate|forged)\b', '', 'g')) AS core FROM f_entity)
    SELECT core, entity FROM (SELECT *, count(*) OVER (PARTITION BY core) AS k FROM n) WHERE k = 1""")
def multi_variant(t):
    """Drop every record whose core name occurs more than once."""
    x = t.entity.select("entity", text.core_name(c("name")).alias("core"))
    return x.groupBy("core").agg(F.count("*").alias("k"), F.first("entity").alias("entity")).where(c("k") == 1).select("core", "entity")


@query("split_arithmetic", """
    SELECT count(*) AS upstream, count(*) FILTER (a) AS train, count(*) FILTER (b) AS hold, count(*) FILTER (NOT a AND NOT b) AS neither, count(*) FILTER (a AND b) AS overlap,
      count(*) = count(*) FILTER (a) + count(*) FILTER (b) + count(*) FILTER (NOT a AND NOT b) - count(*) FILTER (a AND b) AS adds_up
    FROM (SELECT conf = 'HIGH' OR entity % 10 = 0 AS a, conf = 'LOW' AS b FROM f_entity)""")
def split_arithmetic(t):
    flags = t.entity.select("entity", ((c("conf") == "HIGH") | (c("entity") % 10 == 0)).alias("a"), (c("conf") == "LOW").alias("b"))
    g = flags.groupBy("entity").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    s = g.agg(F.count("*").alias("upstream"), F.count_if("a").alias("train"), F.count_if("b").alias("hold"),
              F.count_if(~c("a") & ~c("b")).alias("neither"), F.count_if(c("a") & c("b")).alias("overlap"))
    return s.withColumn("adds_up", c("upstream") == c("train") + c("hold") + c("neither") - c("overlap"))


@query("curation_report", """
    SELECT 'route' AS dim, route AS item, count(*) AS n FROM f_entity GROUP BY route UNION ALL SELECT 'src', src, count(*) FROM f_entity GROUP BY src
    UNION ALL SELECT 'class', category, count(*) FROM f_scope GROUP BY category""")
def curation_report(t):
    """Counters of several dimensions from one pass: each row is exploded to its (dimension, item) pairs."""
    x = t.entity.join(t.comp, "entity", "left")
    item = lambda d, v: F.when(v.isNotNull(), F.struct(F.lit(d).alias("dim"), v.alias("item")))
    cat = F.when(c("composition").isNotNull(), classify.scope_class(c("name"))["category"])
    return x.select(F.explode(F.array_compact(F.array(item("route", c("route")), item("src", c("src")), item("class", cat)))).alias("i")).groupBy(
        c("i.dim").alias("dim"), c("i.item").alias("item")).agg(F.count("*").alias("n"))


@query("composition_model", """
    SELECT component, CASE WHEN amount > 1 THEN 'major' ELSE 'minor' END AS kind, round(count(*) / (SELECT count(DISTINCT entity) FROM f_comp_long), 8) AS frequency,
      round(min(amount), 6) AS lo, round(max(amount), 6) AS hi FROM f_comp_long WHERE component <> 'Ni' GROUP BY ALL""")
def composition_model(t):
    """Per element how often it is a deliberate addition or a residual, and in which range."""
    n = t.comp.agg(F.count("*").alias("n"))
    x = t.comp_long.where(c("component") != "Ni").groupBy("component", F.when(c("amount") > 1, "major").otherwise("minor").alias("kind")).agg(
        F.count("*").alias("k"), rnd(F.min("amount")).alias("lo"), rnd(F.max("amount")).alias("hi"))
    return x.crossJoin(F.broadcast(n)).select("component", "kind", rnd(c("k") / c("n"), 8).alias("frequency"), "lo", "hi")


@query("addition_counts", "SELECT n_major, count(*) AS entities FROM (SELECT count(*) FILTER (component <> 'Ni' AND amount > 1) AS n_major FROM f_comp_long GROUP BY entity) GROUP BY 1")
def addition_counts(t):
    majors = F.size(F.map_filter("composition", lambda k, v: (k != "Ni") & (v > 1.0))).cast("long")
    return t.comp.groupBy(majors.alias("n_major")).agg(F.count("*").alias("entities"))


@query("design_summary", """
    SELECT route, count(*) AS designs, count(*) FILTER (len(failed) > 0) AS filtered_out, count(*) FILTER (tcp_risk <> 'Critical') AS usable,
      count(*) FILTER (tcp_risk <> 'Critical' AND len(failed) = 0) AS credible, count(*) FILTER (list_contains(failed, 'R1_element_count')) AS r1, count(*) FILTER (list_contains(failed, 'R2_refractory_budget')) AS r2,
      count(*) FILTER (list_contains(failed, 'R3_trace_elements')) AS r3, count(*) FILTER (list_contains(failed, 'R4_precipitate_formers')) AS r4, round(quantile_cont(n_major, 0.5), 2) AS median_major
    FROM f_plaus JOIN f_feat USING (entity) GROUP BY route""")
def design_summary(t):
    from meltwise.operators.features import featurize
    from meltwise.operators.metrics import exact_quantiles
    from meltwise.operators.validate import plausibility

    failed, majors, _ = plausibility()
    x = featurize(t.comp.join(t.entity.select("entity", "route"), "entity")).select(
        "route", "tcp_risk", failed.alias("failed"), majors.cast("double").alias("majors"))
    usable, passes = c("tcp_risk") != "Critical", F.size("failed") == 0
    has = lambda r: F.count_if(F.array_contains("failed", r))
    g = x.groupBy("route").agg(
        F.count("*").alias("designs"), F.count_if(~passes).alias("filtered_out"), F.count_if(usable).alias("usable"),
        F.count_if(usable & passes).alias("credible"), has("R1_element_count").alias("r1"), has("R2_refractory_budget").alias("r2"),
        has("R3_trace_elements").alias("r3"), has("R4_precipitate_formers").alias("r4"))
    q = exact_quantiles(x, ["route"], "majors", [0.5]).select("route", rnd(c("q500"), 2).alias("median_major"))
    return g.join(q, "route")


@query("prf", """
    WITH x AS (SELECT property, actual AS a, CASE WHEN entity % 11 = 0 THEN NULL ELSE p1 END AS p FROM f_arms),
     k AS (SELECT property, count(*) FILTER (p IS NOT NULL AND a <> 0 AND abs(p - a) <= 0.1::DOUBLE * a) AS tp,
       count(*) FILTER (p IS NOT NULL AND (a = 0 OR abs(p - a) > 0.1::DOUBLE * a)) AS fp, count(*) FILTER (a <> 0 AND (p IS NULL OR abs(p - a) > 0.1::DOUBLE * a)) AS fn FROM x GROUP BY 1)
    SELECT *, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM k""")
def prf(t):
    """Extraction scores at a tolerance; a mismatch counts as both a false positive and a false negative."""
    x = arms_wide(t).select("property", c("actual").alias("a"), F.when(c("entity") % 11 != 0, c("p1")).alias("p"))
    off = F.abs(c("p") - c("a")) > 0.1 * c("a")
    g = x.groupBy("property").agg(
        F.count_if(c("p").isNotNull() & (c("a") != 0) & ~off).alias("tp"), F.count_if(c("p").isNotNull() & ((c("a") == 0) | off)).alias("fp"),
        F.count_if((c("a") != 0) & (c("p").isNull() | off)).alias("fn"))
    return g.select("*", rnd(c("tp") / (c("tp") + c("fp")), 8).alias("precision"), rnd(c("tp") / (c("tp") + c("fn")), 8).alias("recall"),
                    rnd(2 * c("tp") / (2 * c("tp") + c("fp") + c("fn")), 8).alias("f1"))
