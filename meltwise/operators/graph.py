"""Entity tables to typed triples and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
UNITS = {"ys": "MPa", "uts": "MPa", "el": "%", "em": "GPa"}


def triple(s: Column, p: str, o: Column, datatype: str = "string") -> tuple[str, Column]:
    return p, F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(datatype).alias("datatype"))


def iri(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.concat_ws("_", *[p.cast("string") for p in parts]))


def _emit(df: DataFrame | None, items: list[tuple[str, Column]], only: set[str] | None = None) -> DataFrame | None:
    """All triples of a row from one pass, or those of some predicates; a triple with a null object is left out."""
    wanted = [x for p, x in items if only is None or p in only]
    if df is not None and wanted:
        return df.select(F.explode(F.array(*wanted)).alias("t")).select("t.*").where(c("o").isNotNull())
    return None


def to_triples(entities: DataFrame | None, compositions: DataFrame | None, measurements: DataFrame | None, features: DataFrame | None,
               only: set[str] | None = None) -> DataFrame:
    """Entity, variant, composition, entry, quantity, property set and measurement triples.

    Each input is read once and exploded to its triples; only shared nodes (elements, methods) need
    a distinct, and those are pre-aggregated map-side. ``only`` names the predicates that are wanted; inputs that
    hold none of a pattern's nodes may be None.
    """
    alloy, variant = iri("alloy", c("name")), iri("variant", c("entity"))
    base = _emit(entities, [
        triple(variant, "type", F.lit("Variant")), triple(variant, "label", c("name")), triple(variant, "processingMethod", c("route")),
        triple(variant, "hasMethod", iri("method", c("route"))), triple(variant, "source", c("src"))], only)
    shared = _emit(None if entities is None else entities.select("name", "route").distinct(), [
        triple(alloy, "type", F.lit("Alloy")), triple(alloy, "tradeDesignation", c("name")), triple(iri("method", c("route")), "type", F.lit("Method"))], only)
    shared = None if shared is None else shared.distinct()
    links = _emit(entities, [triple(alloy, "hasVariant", variant)], only)
    comp, entry = iri("comp", c("entity")), iri("entry", c("entity"), c("component"))
    heads = _emit(compositions, [triple(comp, "type", F.lit("Composition")), triple(iri("variant", c("entity")), "hasComposition", comp)], only)
    long = None if compositions is None else compositions.select("entity", F.explode("composition").alias("component", "amount"))
    qty = iri("quantity", c("entity"), c("component"))
    parts = _emit(long, [
        triple(entry, "type", F.lit("Entry")), triple(comp, "hasComponent", entry), triple(entry, "element", iri("element", c("component"))),
        triple(entry, "hasMassFraction", qty), triple(qty, "numericValue", c("amount"), "decimal"), triple(qty, "unitSymbol", F.lit("%"))], only)
    elements = _emit(None if long is None else long.select("component").distinct(), [
        triple(iri("element", c("component")), "type", F.lit("Element")), triple(iri("element", c("component")), "label", c("component"))], only)
    pset = iri("propset", c("entity"), c("property"))
    sets = _emit(None if measurements is None else measurements.select("entity", "property").distinct(), [
        triple(pset, "type", F.lit("PropertySet")), triple(iri("variant", c("entity")), "hasPropertySet", pset), triple(pset, "measuresProperty", c("property"))], only)
    meas = iri("meas", c("entity"), c("property"), c("temp_c"))
    mq = iri("mq", c("entity"), c("property"), c("temp_c"))
    unit = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[c("property")]
    points = _emit(measurements, [
        triple(meas, "type", F.lit("Measurement")), triple(pset, "hasMeasurement", meas), triple(meas, "testTemperature", c("temp_c"), "decimal"),
        triple(meas, "hasQuantity", mq), triple(mq, "numericValue", c("value"), "decimal"), triple(mq, "unitSymbol", unit)], only)
    derived = _emit(features, [
        triple(iri("variant", c("entity")), "mdAverage", F.round("md_avg", 6), "decimal"), triple(iri("variant", c("entity")), "tcpRisk", c("tcp_risk"))], only)
    made = [x for x in (base, shared, links, heads, parts, elements, sets, points, derived) if x is not None]
    return reduce(DataFrame.unionByName, made)


def optional_pattern(triples: DataFrame, predicates: list[str], type_name: str) -> DataFrame:
    """One row per subject of a type with optional attributes, from one pivot."""
    kind = F.max(F.when((c("p") == "type") & (c("o") == type_name), True))
    wanted = triples.where(c("p").isin("type", *predicates))
    return wanted.groupBy("s").agg(kind.alias("_k"), *[F.max(F.when(c("p") == p, c("o"))).alias(p) for p in predicates]).where(c("_k")).drop("_k")


#: The predicates that the patterns below follow.
COMPOSITION_CHAIN = {"label", "numericValue", "nominal", "hasComposition", "hasComponent", "element", "hasMassFraction"}
MEASUREMENT_CHAIN = {"hasPropertySet", "measuresProperty", "hasMeasurement", "testTemperature", "hasQuantity", "numericValue"}
POINTS_CHAIN = MEASUREMENT_CHAIN - {"measuresProperty", "testTemperature"}


def edges(triples: DataFrame, predicate: str, a: str, b: str) -> DataFrame:
    return triples.where(c("p") == predicate).select(c("s").alias(a), c("o").alias(b))


def compositions_from(triples: DataFrame) -> DataFrame:
    """(variant, component, amount) by the chain variant, composition, entry, element and quantity.

    The amount is the quantity's numeric value, or else its nominal one; entries with neither are left out.
    """
    # A label for each chemical element: small whatever the number of entries.
    element = F.broadcast(edges(triples, "label", "el", "component").where(c("el").startswith("element/")))
    number = lambda p: edges(triples, p, "q", "o").select("q", c("o").try_cast("double").alias(p)).where(c("q").startswith("quantity/") & c(p).isNotNull())
    # One nominal value for a quantity, so that several do not repeat an entry that has a numeric one.
    nominal = number("nominal").groupBy("q").agg(F.max("nominal").alias("nominal"))
    amount = edges(triples, "hasMassFraction", "entry", "q").join(number("numericValue"), "q", "left").join(nominal, "q", "left")
    amount = amount.select("entry", F.coalesce("numericValue", "nominal").alias("amount")).where(c("amount").isNotNull())
    x = edges(triples, "hasComposition", "variant", "comp").join(edges(triples, "hasComponent", "comp", "entry"), "comp").select("variant", "entry")
    x = x.join(edges(triples, "element", "entry", "el").join(element, "el").select("entry", "component"), "entry").join(amount, "entry")
    return x.select("variant", "component", "amount")


def measurements_from(triples: DataFrame, asked: tuple[str, ...] = ("property", "temp_c")) -> DataFrame:
    """Measurements through a property set, plus those attached directly to a variant: variant, what is ``asked`` of them, and value."""
    via = edges(triples, "hasPropertySet", "variant", "ps")
    direct = edges(triples, "hasDirectMeasurement", "variant", "m")
    if "property" in asked:
        via = via.join(edges(triples, "measuresProperty", "ps", "property"), "ps")
        direct = direct.join(edges(triples, "measures", "m", "property"), "m")
    x = via.join(edges(triples, "hasMeasurement", "ps", "m"), "ps").drop("ps").unionByName(direct)
    if "temp_c" in asked:
        x = x.join(edges(triples, "testTemperature", "m", "temp").select("m", c("temp").try_cast("int").alias("temp_c")), "m", "left")
    x = x.join(edges(triples, "hasQuantity", "m", "q"), "m", "left")
    value = edges(triples, "numericValue", "q", "value").select("q", c("value").try_cast("double").alias("value"))
    return x.join(value, "q", "left").select("variant", *asked, "value")
