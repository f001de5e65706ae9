"""Outfit layering: where an item sits, in which order it goes on, and which items lose their place."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import lookup
from .ranking import top_k


def any_of(words: Sequence[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def keyword_rule(text: Column, rules: Sequence, pick: int, default) -> Column:
    """One field of the first keyword row contained in ``text``."""
    chain = None
    for words, spec in rules:
        hit = text.rlike(any_of(words))
        chain = F.when(hit, F.lit(spec[pick])) if chain is None else chain.when(hit, F.lit(spec[pick]))
    return chain.otherwise(F.lit(default))


def without_lookalikes(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), any_of(dims.UNDERWEAR_LOOKALIKES), " ")


def add_layers(items: DataFrame, slot: str = "slot", name: str = "name") -> DataFrame:
    """Add layer rank, body slot, small flag and label.  Underwear is judged by name first."""
    c = F.col
    base = items.withColumns({"_lower": F.lower(F.coalesce(c(name), F.lit(""))), "_clean": without_lookalikes(c(name))})
    any_word = c("_clean").rlike(any_of([w for words, _ in dims.UNDERWEAR_RULES for w in words]))
    base = base.withColumn("underwear", c(slot).isin(dims.UNDERWEAR_SLOTS) & any_word)
    place = lookup(c(slot), dims.BODY_SLOT, c(slot))
    rank = (F.when(c("underwear"), F.lit(5))
            .when(c(slot) == "bag", F.lit(dims.DEFAULT_BAG_RANK))
            .when(c(slot) == "accessory", keyword_rule(c("_lower"), dims.ACCESSORY_RULES, 0, dims.DEFAULT_ACCESSORY_RANK))
            .otherwise(F.coalesce(*[F.when(c(slot) == k, F.lit(v)) for k, v in dims.LAYER_RANK.items()], F.lit(dims.UNKNOWN_RANK))))
    under_slot = keyword_rule(c("_clean"), dims.UNDERWEAR_RULES, 1, None)
    small = (c(slot) == "accessory") & ~c("underwear") & keyword_rule(c("_lower"), dims.ACCESSORY_RULES, 2, False)
    label = F.when(c("underwear"), keyword_rule(c("_clean"), dims.UNDERWEAR_RULES, 3, None))
    return base.withColumns({
        "layer_rank": rank, "body_slot": F.when(c("underwear"), F.coalesce(under_slot, F.concat(F.lit("underwear-"), place))).otherwise(place),
        "small": small, "label": F.coalesce(label, lookup(c(slot), dims.SLOT_LABELS, c(slot)))}).drop("_lower", "_clean")


def order_outfits(items: DataFrame, outfit: str, order: str, keep: list[str], limit: int = dims.OUTFIT_LIMIT) -> DataFrame:
    """Layer order per outfit: one item per slot, a one-piece covers top and bottom, at most ``limit`` items.

    Every window is per outfit or finer, so one shuffle serves all of them, and none where the rows already come by outfit.
    """
    c = F.col
    columns = [c for c in dict.fromkeys([order, *keep, "layer_rank", "body_slot", "small", "label", "underwear", "slot"])]
    # The place in the order decides a slot; of the accessories only the first ``limit`` can find a place.
    seated = top_k(add_layers(items).select(outfit, *columns), [outfit, "body_slot"], [c("layer_rank"), c(order)], limit, "_n")
    seated = seated.where((c("body_slot") == "accessory") | ((c("body_slot") != "accessory") & (c("_n") == 1)))
    rows = seated.withColumn("_covered", _covered(outfit, order)).where(~(c("_covered") & c("body_slot").isin("torso", "legs")))
    return top_k(rows.select(outfit, *columns), [outfit], [c("layer_rank"), c(order)], limit, "place")


def _covered(outfit: str, order: str) -> Column:
    """Whether an item of the outfit covers top and bottom; in the order of the places, which then need no other sort."""
    every = Window.partitionBy(outfit).orderBy("layer_rank", order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.bool_or(F.col("body_slot") == "torso+legs").over(every), F.lit(False))


def dropped_items(items: DataFrame, outfit: str, order: str, keep: list[str], limit: int = dims.OUTFIT_LIMIT) -> DataFrame:
    """The items that ``order_outfits`` leaves out, marked in one pass over the items."""
    c = F.col
    layered = add_layers(items).select(outfit, *dict.fromkeys([order, *keep, "layer_rank", "body_slot"])).repartition(outfit)
    place = Window.partitionBy(outfit).orderBy("layer_rank", order).rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(outfit, "body_slot").orderBy("layer_rank", order)) == 1
    marked = layered.withColumn("_held", F.coalesce((c("body_slot") == "accessory") | ((c("body_slot") != "accessory") & first), F.lit(False)))
    marked = marked.withColumn("_held", c("_held") & ~(_covered(outfit, order) & F.coalesce(c("body_slot").isin("torso", "legs"), F.lit(False))))
    marked = marked.withColumn("_place", F.count_if("_held").over(place))
    return marked.where(~c("_held") | (c("_place") > limit)).select(outfit, *dict.fromkeys([order, *keep]))


def captions(ordered: DataFrame, outfit: str) -> DataFrame:
    """One caption per outfit from its ordered items (at most six), with the clauses that apply."""
    item = F.struct("place", "slot", "name", "label", "small", "underwear", "layer_rank", "body_slot")
    c = F.col
    rows = ordered.groupBy(outfit).agg(F.array_sort(F.collect_list(item)).alias("items"))
    named = lambda pred: F.array_join(F.transform(F.filter("items", pred), lambda i: F.concat(F.lit("'"), i["name"], F.lit("'"))), ", ")
    roles = F.array_join(F.transform("items", lambda i: F.concat(
        F.lit("Reference image "), (i["place"] + 1).cast("string"), F.lit(" is the "), i["label"], F.lit(" '"), i["name"], F.lit("'."))), " ")
    torso = F.transform(F.filter("items", lambda i: i["slot"].isin("overall", "upper", "outer")), lambda i: lookup(i["slot"], dims.STACK_NAMES, i["slot"]))
    under, small = named(lambda i: i["underwear"]), named(lambda i: i["small"])
    last = lambda pred, plain: F.try_element_at(F.transform(F.filter("items", pred), lambda i: F.concat(F.lit("'"), F.coalesce(i["name"], F.lit(plain)), F.lit("'"))), F.lit(-1))
    socks, shoes = last(lambda i: i["layer_rank"] == 45, "socks"), last(lambda i: i["slot"] == "shoes", "shoes")
    worn = F.transform("items", lambda i: lookup(i["slot"], dims.BODY_SLOT, i["slot"]))
    full = F.array_contains(worn, "torso+legs")
    missing = F.array_compact(F.array(
        F.when(~F.array_contains(worn, "torso") & ~full, "top"), F.when(~F.array_contains(worn, "legs") & ~full, "bottoms"),
        F.when(~F.array_contains(worn, "feet"), "shoes")))
    text = F.concat_ws(
        " ", roles,
        F.when(F.size(torso) >= 2, F.concat(F.lit("Torso layers from the skin outward: "), F.array_join(torso, " then "), F.lit("."))),
        F.when(under != "", F.concat(under, F.lit(" stays hidden as underwear."))),
        F.when(socks.isNotNull() & shoes.isNotNull(), F.concat(socks, F.lit(" goes on before "), shoes, F.lit("."))),
        F.concat(F.lit("Items worn: "), F.size("items").cast("string"), F.lit(".")),
        F.when(F.size(missing) > 0, F.concat(F.lit("Unchanged: "), F.array_join(missing, ", "), F.lit("."))),
        F.when(small != "", F.concat(small, F.lit(" must stay visible."))))
    return rows.select(c(outfit), text.alias("caption"))


def useful_pairs(pieces: DataFrame, look: str) -> DataFrame:
    """Looks whose confident pieces show layering or carried items and whose first two pieces are large enough.

    ``pieces``: look, pos, slot, name, confidence, width, height (pixels).
    """
    c = F.col
    layered = add_layers(pieces.where(c("confidence") >= 0.6))
    facts = layered.groupBy(look).agg(
        F.count("*").alias("pieces"), F.bool_or(c("slot") == "upper").alias("upper"), F.bool_or(c("slot") == "outer").alias("outer"),
        F.bool_or(c("slot").isin("bag", "accessory")).alias("carried"))
    chosen = top_k(layered, [look], [c("layer_rank"), c("pos")], 2)
    large = chosen.groupBy(look).agg(F.bool_and(F.least("width", "height") >= F.when(c("small"), 12).otherwise(40)).alias("large"))
    useful = (c("upper") & c("outer")) | (c("carried") & (c("pieces") >= 2))
    return facts.join(large, look).select(look, "pieces", useful.alias("useful"), (useful & c("large")).alias("kept"))
