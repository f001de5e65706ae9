"""Look matching: score wardrobe items against look requirements and assign them one to one.

The score of a pair depends only on the attributes of the item and of the requirement, so
scoring runs on distinct attribute groups (bounded by the vocabulary, not by the rows) and
only each requirement's best few items are expanded to rows.  Both prunings are exact:
items of one group tie on every score and differ only in the tie-break order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.color import palette_in, palette_similarity
from ..functions.rules import canonical_form, seed_attributes
from ..functions.similarity import forms_agree, set_similarity, subtype_agrees, total_similarity, visual_score
from ..functions.text import known_colors, tokens
from ..session import materialize
from . import graph

S = dims.SIM
TOP = S["top"]
LARGE = 64  # contested positions from which a look is taken apart before it is searched


ANALYSIS = ["subcategory", "material", "texture", "fit", "silhouette", "sleeve_length", "length", "neckline", "pattern", "finish",
            "construction", "primary_color", "secondary_colors"]
NEEDS = ["colors", "materials", "fits", "details", "sleeve_length", "length", "subcategory", "neckline"]
_NO_VECTOR = -1
_NOTHING = "\u0001\u0001"  # stands for tokens that no requirement can meet
_WORDS = [("material_words", "r_materials", "material_sim", dims.MATERIAL_GROUPS), ("fit_words", "r_fits", "fit_sim", dims.FIT_GROUPS),
          ("detail_words", "r_details", "detail_sim", [])]
_ITEM_PARTS = ["material_words", "fit_words", "detail_words", "form"]
_NEED_PARTS = ["r_materials", "r_fits", "r_details", "r_form"]


def _words(*parts) -> Column:
    return F.array_join(F.array_distinct(tokens(F.concat_ws(" ", *parts))), " ")


def _form(sleeve, length, category, *kind) -> Column:
    return F.struct(canonical_form(F.col(sleeve), F.col(category)).alias("sleeve"), canonical_form(F.col(length), F.col(category)).alias("length"),
                    F.concat_ws(" ", *kind).alias("kind"))


def with_analysis(items: DataFrame, analyses: DataFrame | None = None) -> DataFrame:
    """Items with the attributes of ``ANALYSIS``: the stored ones of ``analyses`` (id, attributes; lists as text), else read off the name.

    A stored analysis counts as a whole; an attribute it lacks is unknown, not read off the name.
    """
    named = items.select("category", "name", "color").distinct()  # names are read once, however many items share them
    seeds = seed_attributes(named).withColumns({"construction": F.array_join("construction", " "), "secondary_colors": F.lit("")})
    seeds = materialize(seeds.withColumnsRenamed({x: f"_{x}" for x in named.columns}))
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in named.columns]
    seeded = items.drop(*[x for x in seeds.columns if x in items.columns]).join(seeds, same[0] & same[1] & same[2], "left").drop(*[f"_{x}" for x in named.columns])
    if analyses is None:
        return seeded
    stored = analyses.select("id", F.struct(*[F.coalesce(a, F.lit("")).alias(a) for a in ANALYSIS]).alias("_stored"))
    joined = seeded.join(stored, "id", "left")
    return joined.withColumns({a: F.when(F.col("_stored").isNotNull(), F.col("_stored")[a]).otherwise(F.col(a)) for a in ANALYSIS}).drop("_stored")


def item_parts(items: DataFrame) -> DataFrame:
    """Items (with attributes) with the texts each part of the score looks at."""
    return items.withColumns({
        "palette": F.array_join(known_colors(F.concat_ws(" ", "color", "name", "primary_color", "secondary_colors")), " "),
        "material_words": _words("material", "texture", "name"), "fit_words": _words("fit", "silhouette", "name"),
        "detail_words": _words("subcategory", "pattern", "finish", "construction", "name"),
        "form": _form("sleeve_length", "length", "category", "subcategory", "neckline", "construction")})


def need_parts(requirements: DataFrame) -> DataFrame:
    """Requirements (category, fields of ``NEEDS``; lists as text) with the texts the score looks at."""
    return requirements.withColumns({
        "r_palette": F.array_join(known_colors(F.col("colors")), " "), "r_materials": _words("materials"), "r_fits": _words("fits"),
        "r_details": _words("details"), "r_form": _form("sleeve_length", "length", "category", "subcategory", "neckline", "details")})


def _pieces(text: Column, most: int) -> Column:
    """All substrings of two to ``most`` characters."""
    size = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1)))
    return F.flatten(F.transform(starts, lambda i: F.transform(
        F.sequence(F.lit(2), F.greatest(F.least(F.lit(max(2, most)), size - i + 1), F.lit(2))), lambda n: F.substring(text, i, n))))


def _meeting(own: DataFrame, asked: DataFrame) -> DataFrame:
    """Tokens (part, t) of ``own`` that score against some token (part, w) of ``asked``: equal, one within the other, or of one group."""
    sizes = own.agg(F.max(F.length("t")).alias("t")).join(asked.agg(F.max(F.length("w")).alias("w"))).first()
    whole = own.select("part", "t", F.explode(F.array_distinct(_pieces(F.col("t"), sizes["w"] or 2))).alias("w")).join(asked, ["part", "w"], "left_semi").select("part", "t")
    inside = own.join(asked.select("part", F.explode(F.array_distinct(_pieces(F.col("w"), sizes["t"] or 2))).alias("t")), ["part", "t"], "left_semi")

    def member(token: str) -> Column:
        hits = [F.when((F.col("part") == part) & F.col(token).rlike("|".join(g)), F.lit(k)) for part, _, _, groups in _WORDS for k, g in enumerate(groups)]
        return F.array_compact(F.array(*hits))

    grouped = own.select("part", "t", F.explode(member("t")).alias("g")).join(asked.select("part", F.explode(member("w")).alias("g")), ["part", "g"], "left_semi")
    return whole.unionByName(inside).unionByName(grouped.select("part", "t")).distinct()


def _only_meeting(items: DataFrame, needs: DataFrame) -> DataFrame:
    """Items whose texts keep only the tokens that some requirement can meet.

    Names and other free words vanish here, so the number of different items follows what requirements ask for, not the
    vocabulary of names.  Tokens meet over equi-joins on substrings and groups.
    """
    listed = lambda frame, columns: frame.select(F.explode(F.array(*[F.struct(F.lit(w[0]).alias("part"), F.col(c).alias("text")) for w, c in zip(_WORDS, columns)])).alias("x")).select("x.*").distinct()
    texts = materialize(listed(items, [w[0] for w in _WORDS]))
    split = texts.select("part", "text", F.explode(F.split("text", " ")).alias("t")).where("t <> ''")
    asked = materialize(listed(needs, [w[1] for w in _WORDS]).select("part", F.explode(F.split("text", " ")).alias("w")).where("w <> ''").distinct())
    meets = _meeting(split.select("part", "t").distinct(), asked)
    kept = split.join(meets, ["part", "t"]).groupBy("part", "text").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("kept"))
    known = materialize(texts.join(kept, ["part", "text"], "left").withColumn("kept", F.when(F.col("text") == "", "").otherwise(F.coalesce("kept", F.lit(_NOTHING)))))
    for part, *_ in _WORDS:
        own = known.where(F.col("part") == part).select(F.col("text").alias(part), "kept")
        items = items.join(own, part).drop(part).withColumnRenamed("kept", part)
    return items


@dataclass(frozen=True)
class Sides:
    """Items and requirements with the numbers (hashes) of the texts behind their scores."""

    own: DataFrame  # item, source_rank, category, pid (palette), aid (other texts), gender, user_added, vec
    rows: DataFrame  # look, pos, kind (fields, vector and gender), qid, sid; item if the requirements name one
    signs: DataFrame  # kind, sid (number of the signature), signature
    wanted: DataFrame  # qid, wid, r_vec, r_gender
    wishes: DataFrame  # wid, r_category, rpid, bid
    palettes: tuple[DataFrame, DataFrame]  # (pid, palette), (rpid, r_palette)
    texts: tuple[DataFrame, DataFrame]  # (aid, texts), (bid, texts)


_CLASS = ["gender", "user_added", "vec"]  # what an item's score depends on besides its texts


_TEXTS = ["category", "name", "color", *ANALYSIS]  # what the parts of an item are made of


def _key(columns: list[str]) -> Column:
    """Number (hash) of values; a null is a value of its own."""
    return F.xxhash64(*[F.coalesce(F.col(x).cast("string"), F.lit("\u0001")) for x in columns])


def sides(items: DataFrame, requirements: DataFrame) -> Sides:
    """Items (with attributes) and requirements, reduced to what a score depends on.  Texts are worked on once per different value."""
    c = F.col
    vec = F.coalesce("vec", F.lit(_NO_VECTOR)).cast("long")
    raw = ["category", *NEEDS]
    place = ["look", "pos", *[x for x in ["item"] if x in requirements.columns]]
    asked = requirements.select(*place, *[F.coalesce(x, F.lit("")).alias(x) for x in raw], vec.alias("r_vec"), c("gender").alias("r_gender"))
    asked = materialize(asked.withColumn("kind", _key([*raw, "r_vec", "r_gender"])))
    kinds = materialize(asked.drop(*place).distinct())
    needs = need_parts(kinds.select(*raw).distinct()).withColumns({"rpid": F.xxhash64("r_palette"), "bid": F.xxhash64(*_NEED_PARTS)})
    needs = materialize(needs.withColumn("wid", F.xxhash64("category", "rpid", "bid")))
    kinds = kinds.join(needs.select(*raw, "wid"), raw).withColumns({"qid": F.xxhash64("wid", "r_vec", "r_gender"), "signature": _signature()})
    kinds = materialize(kinds.withColumn("sid", F.xxhash64("signature")))
    rows = asked.select(*place, "kind").join(kinds.select("kind", "qid", "sid"), "kind")
    visible = items.where(~F.coalesce(c("deleted"), F.lit(False))).withColumn("tid", _key(_TEXTS))
    own = materialize(visible.select("tid", *_TEXTS, c("id").alias("item"), "gender", "user_added", vec.alias("vec"), F.coalesce("source_rank", F.lit(999)).alias("source_rank")))
    plain = materialize(item_parts(own.select("tid", *_TEXTS).distinct()).select("tid", "palette", *_ITEM_PARTS))
    cut = materialize(_only_meeting(plain, needs).withColumns({"pid": F.xxhash64("palette"), "aid": F.xxhash64(*_ITEM_PARTS)}))
    return Sides(materialize(own.join(cut.select("tid", "pid", "aid"), "tid").select("item", "source_rank", "category", "pid", "aid", *_CLASS)), rows.select(*place, "kind", "qid", "sid"), kinds.select("kind", "sid", "signature"),
                 materialize(kinds.select("qid", "wid", "r_vec", "r_gender").distinct()), materialize(needs.select("wid", c("category").alias("r_category"), "rpid", "bid").distinct()),
                 (cut.select("pid", "palette").distinct(), needs.select("rpid", "r_palette").distinct()),
                 (cut.select("aid", *_ITEM_PARTS).distinct(), needs.select("bid", *_NEED_PARTS).distinct()))


def color_scores(keys: DataFrame, both: Sides) -> DataFrame:
    """(pid, rpid, color_sim) of the distinct pairs of palettes in ``keys``."""
    met = keys.select("pid", "rpid").distinct().join(both.palettes[0], "pid").join(both.palettes[1], "rpid")
    return materialize(met.select("pid", "rpid", palette_similarity(palette_in(F.col("palette")), palette_in(F.col("r_palette"))).alias("color_sim")))


def text_scores(keys: DataFrame, both: Sides) -> DataFrame:
    """(aid, bid, material_sim, fit_sim, detail_sim, type_conflict) of the distinct pairs in ``keys``; a part is scored once per pair of its texts."""
    sets = lambda groups: lambda a, b: set_similarity(tokens(a), tokens(b), groups)
    conflict = lambda a, b: ~(forms_agree(a["sleeve"], b["sleeve"]) & forms_agree(a["length"], b["length"]) & subtype_agrees(a["kind"], b["kind"]))
    texts = out = materialize(keys.select("aid", "bid").distinct().join(both.texts[0], "aid").join(both.texts[1], "bid"))
    for a, b, name, value in [*[(a, b, name, sets(groups)) for a, b, name, groups in _WORDS], ("form", "r_form", "type_conflict", conflict)]:
        out = out.join(texts.select(a, b).distinct().withColumn(name, value(F.col(a), F.col(b))), [a, b])
    return materialize(out.select("aid", "bid", *[w[2] for w in _WORDS], "type_conflict"))


def with_cosine(pairs: DataFrame, cosines: DataFrame) -> DataFrame:
    """Add the cosine of comparable vectors.  Most pairs have no vectors; their keys are spread so they share no task."""
    none = (F.col("vec") == _NO_VECTOR) | (F.col("r_vec") == _NO_VECTOR)
    known = cosines.select(F.col("vec").cast("long").alias("_v"), F.col("r_vec").cast("long").alias("_r"), "cosine")
    keyed = pairs.withColumn("_k", F.when(none, -2 - F.pmod(F.xxhash64("item"), F.lit(997))).otherwise(F.col("vec")))
    return keyed.join(known, (F.col("_k") == F.col("_v")) & (F.col("r_vec") == F.col("_r")), "left").drop("_k", "_v", "_r")


def _total(same: Column, direct: Column) -> Column:
    c = F.col
    return total_similarity(c("color_sim"), c("material_sim"), c("fit_sim"), c("detail_sim"), c("visual"), c("cosine").isNotNull(), same, direct)


def _score(pairs: DataFrame, direct: bool) -> DataFrame:
    """Final similarity and the keep rule for pairs of an item and a requirement.

    Pairs of one category pass freely; other pairs need an upload and a visual score of .95.
    """
    c = F.col
    comparable = c("cosine").isNotNull()
    same = c("category") == c("r_category")
    allowed = c("user_added") | (c("gender") == "all") | (c("gender") == c("r_gender"))
    passes = allowed & (same | (c("user_added") & comparable & (c("visual") >= S["category_gate"]))) & (
        ~c("type_conflict") | F.lit(direct) | (comparable & (c("visual") >= S["type_gate"])))
    pairs = pairs.withColumn("visual", visual_score(c("cosine")))
    scored = pairs.withColumn("similarity", _total(same, F.lit(direct))).where(passes)
    if direct:
        return scored
    return scored.where((c("similarity") >= S["keep"]) | (c("visual") >= S["keep_visual"])
                        | (c("user_added") & (c("similarity") >= S["keep_user"])))


def _best(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_at") <= TOP).drop("_at")


_ITEM_ORDER = ["source_rank", "item"]
_VALUE = ["item", "source_rank", "user_added", "similarity", "color_sim", "visual"]


def _best_first() -> list:
    return [F.desc("similarity"), F.desc("color_sim"), F.desc("user_added"), *_ITEM_ORDER]


def best_lists(both: Sides, cosines: DataFrame) -> DataFrame:
    """(qid, r_category, rank, values) of the best eight items of every different requirement.

    The score is a sum of a colour part, a text part and a picture part, so lists of eight are merged part by part and no
    requirement meets all items: among items of one palette and class only the text part differs, so the eight best of them
    per text of a requirement are enough; among items of one class only colour and text differ, so eight per wish are
    enough; the picture part is one value per class.  Near-identical pictures lift scores to a floor and pass over gates,
    so the few classes with such a picture are met as they are.
    """
    c = F.col
    cell = ["category", "pid", "aid", *_CLASS]  # items of a cell differ in their order only
    at = F.row_number().over(Window.partitionBy(*cell).orderBy(*_ITEM_ORDER))
    cells = materialize(both.own.withColumn("_at", at).where(c("_at") <= TOP).withColumn("cell", _key(cell)))
    by_category = cells.select(c("category").alias("r_category"), "pid", "aid").distinct()
    asked = both.wishes
    near = materialize(cosines.withColumn("visual", visual_score(c("cosine"))).where(c("visual") >= S["type_gate"]).select(c("vec").cast("long"), c("r_vec").cast("long")))
    pictured = both.wanted.where(c("r_vec") != _NO_VECTOR).join(near, "r_vec").join(asked, "wid").join(cells.withColumnRenamed("gender", "i_gender"), "vec")
    pictured = pictured.where(c("user_added") | (c("category") == c("r_category"))).withColumnRenamed("i_gender", "gender")
    # where eight items of the category are lifted already, one of another category has to reach the floor by its own parts
    lifts = cells.groupBy(c("category").alias("r_category"), "vec").agg(F.count_if(c("user_added") | (c("gender") == "all")).alias("lifts"))
    pictured = pictured.join(lifts, ["r_category", "vec"], "left")
    reach = F.lit(S["base"] + S["material"] + S["fit"] + S["detail"] + S["visual"]) + c("color_sim") * S["color"] + 1e-8
    worth = (c("category") == c("r_category")) | (F.coalesce("lifts", F.lit(0)) < TOP) | (reach >= S["visual_floor"])

    met = by_category.join(asked.select("r_category", "rpid", "bid").distinct(), "r_category")
    others = both.wanted.where(c("r_vec") != _NO_VECTOR).select("wid", "r_vec").distinct().join(near, "r_vec").join(asked, "wid").join(cells.select("vec", "pid", "aid").distinct(), "vec")
    colors = color_scores(met.select("pid", "rpid").distinct().unionByName(others.select("pid", "rpid").distinct()), both)
    texts = text_scores(met.select("aid", "bid").distinct().unionByName(others.select("aid", "bid").distinct()), both)

    text = F.round(c("material_sim") * S["material"] + c("fit_sim") * S["fit"] + c("detail_sim") * S["detail"], 9)
    bids = asked.select(c("r_category").alias("category"), "bid").distinct()
    by_text = cells.drop("_at", "cell").join(bids, "category").join(texts.where("NOT type_conflict"), ["aid", "bid"]).withColumn("text", text)
    by_text = materialize(_best(by_text, ["category", "bid", "pid", *_CLASS], [F.desc("text"), *_ITEM_ORDER]))
    wish = asked.withColumnRenamed("r_category", "category")
    by_wish = by_text.join(wish, ["category", "bid"]).join(colors, ["pid", "rpid"]).withColumn("known", F.round(c("color_sim") * S["color"] + c("text"), 9))
    by_wish = _best(by_wish, ["wid", *_CLASS], [F.desc("known"), F.desc("color_sim"), *_ITEM_ORDER])
    by_wish = materialize(by_wish.select("wid", c("category").alias("r_category"), "category", *_CLASS, "item", "source_rank", "color_sim", "material_sim", "fit_sim", "detail_sim", "type_conflict"))

    usual = _score(with_cosine(both.wanted.join(by_wish, "wid"), cosines), direct=False).where(c("cosine").isNull() | (c("visual") < S["type_gate"]))
    # items of a cell tie on every score: the eight cells whose first items come first hold the eight best items
    first = _score(with_cosine(pictured.where(c("_at") == 1).join(colors, ["pid", "rpid"]).where(worth).join(texts, ["aid", "bid"]), cosines), direct=False)
    leading = _best(first, ["qid"], _best_first()).select("qid", "r_category", "cell", "similarity", "color_sim", "visual")
    lifted = leading.join(cells.select("cell", "item", "source_rank", "user_added"), "cell")
    both_kinds = usual.select("qid", "r_category", *_VALUE).unionByName(lifted.select("qid", "r_category", *_VALUE))
    ranked = Window.partitionBy("qid").orderBy(*_best_first())
    return materialize(both_kinds.withColumn("rank", F.row_number().over(ranked)).where(c("rank") <= TOP))


@dataclass(frozen=True)
class Lists:
    """Requirement rows and the lists of best items they have; few rows have a list of their own."""

    rows: DataFrame  # look, pos, kind, sid, lid, own (whether the list is in ``special``), first (its first item, null without any)
    common: DataFrame  # lid, options: rank, item and what a candidate has, in order
    special: DataFrame | None = None  # as ``common``
    signs: DataFrame | None = None  # kind, sid, signature

    def joined(self, rows: DataFrame) -> DataFrame:
        """``rows`` (lid, own) with the options of their lists."""
        if self.special is None:
            return rows.join(self.common, "lid")
        return rows.where("NOT own").join(self.common, "lid").unionByName(rows.where("own").join(self.special, "lid"))


_OPTION = ["rank", "item", "category", "similarity", "color_sim", "visual", "direct", "user_added"]


def _options(listed: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked values by key -> one row per key with its options in order."""
    return listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*_OPTION))).alias("options"))


def candidate_lists(items: DataFrame, requirements: DataFrame, cosines: DataFrame, references: DataFrame) -> Lists:
    """The lists of the best eight items of every requirement row; see ``candidates``."""
    c = F.col
    both, cosines = sides(items, requirements), materialize(cosines)
    shown = lambda df, direct: df.withColumns({"category": c("r_category"), "color_sim": F.round("color_sim", 9), "visual": F.round("visual", 9), "direct": direct})
    listed = best_lists(both, cosines)
    # Only looks with items cut from them deviate from the list of their requirement.
    direct = materialize(direct_candidates(both, references, cosines))
    touched = direct.select("look", "qid").distinct()
    plain = touched.join(listed, "qid").select("look", "qid", "r_category", *_VALUE, F.lit(False).alias("direct"))
    # A direct reference never scores below the plain pair, so it replaces it.
    merged = plain.unionByName(direct.withColumn("direct", F.lit(True))).groupBy("look", "qid", "r_category", "item").agg(
        F.max_by(F.struct(*_VALUE[1:], "direct"), c("direct")).alias("v")).select("look", "qid", "r_category", "item", "v.*")
    in_look = Window.partitionBy("look", "qid").orderBy(*_best_first())
    mixed = merged.withColumn("rank", F.row_number().over(in_look)).where(c("rank") <= TOP)
    special = materialize(_options(shown(mixed, c("direct")), ["look", "qid"]).withColumn("lid", F.xxhash64("look", "qid")))
    common = materialize(_options(shown(listed, F.lit(False)), ["qid"]).withColumnRenamed("qid", "lid"))
    first = c("options")[0]["item"].alias("first")
    own = special.groupBy("look").agg(F.collect_list(F.struct("qid", "lid", first)).alias("_own"))
    rows = both.rows.join(own, "look", "left").withColumn("_mine", F.try_element_at(F.filter("_own", lambda x: x["qid"] == c("qid")), F.lit(1)))
    rows = rows.join(common.select(c("lid").alias("qid"), first.alias("_first")), "qid", "left")
    rows = rows.select("look", "pos", "kind", "sid", F.coalesce("_mine.lid", "qid").alias("lid"), c("_mine").isNotNull().alias("own"), F.coalesce("_mine.first", "_first").alias("first"))
    return Lists(rows, common, special.select("lid", "options"), both.signs)


def candidates(items: DataFrame, requirements: DataFrame, cosines: DataFrame, references: DataFrame) -> DataFrame:
    """Best eight items of every requirement row, ranked from 1.

    ``items``: id, category, name, color, gender, user_added, vec, source_rank, deleted and the attributes of ``with_analysis``.
    ``requirements``: look, pos, category, vec, gender and the fields of ``NEEDS``.
    ``references``: (item, look) pairs of items cut from a look.
    ``cosines``: (vec, r_vec, cosine) of comparable vectors.
    """
    lists = candidate_lists(items, requirements, cosines, references)
    found = lists.joined(lists.rows.select("look", "pos", "lid", "own")).select("look", "pos", F.inline("options"))
    return found.select("look", "pos", *_OPTION[2:3], "item", *_OPTION[3:], "rank")


def _scored(pairs: DataFrame, both: Sides, cosines: DataFrame) -> DataFrame:
    """Given pairs of items and requirements with their part scores and cosines."""
    return with_cosine(pairs.join(color_scores(pairs, both), ["pid", "rpid"]).join(text_scores(pairs, both), ["aid", "bid"]), cosines)


def direct_candidates(both: Sides, references: DataFrame, cosines: DataFrame) -> DataFrame:
    """Pairs of a look's requirements with the items cut from that look."""
    linked = materialize(references.join(both.own, "item"))
    asking = both.rows.join(linked.select("look").distinct(), "look", "left_semi").select("look", "qid").distinct()
    pairs = materialize(asking.join(linked, "look").join(both.wanted, "qid").join(both.wishes, "wid"))
    return _score(_scored(pairs, both, cosines), direct=True).select("look", "qid", "r_category", *_VALUE)


def pair_similarity(pairs: DataFrame | None, items: DataFrame, requirements: DataFrame, cosines: DataFrame, references: DataFrame) -> DataFrame:
    """The parts of the score of given (look, pos, item) pairs; an incompatible pair has a total of 0.

    Without ``pairs`` every requirement is paired with the item it names (its column ``item``), so its row is derived once.
    """
    c = F.col
    both, cosines = sides(items, requirements), materialize(cosines)
    cut_from = references.select("look", "item").distinct().withColumn("direct", F.lit(True))
    given = both.rows if pairs is None else pairs.select("look", "pos", "item").join(both.rows, ["look", "pos"])
    # the shuffles by look and by item carry no more than the keys; what the numbers stand for is added after them
    rows = given.select("look", "pos", "item", "qid").join(cut_from, ["look", "item"], "left").join(both.own.select("item", "category", "pid", "aid", "vec"), "item")
    rows = rows.join(both.wanted.join(both.wishes, "wid").select("qid", "r_vec", "r_category", "rpid", "bid"), "qid")
    out = _scored(materialize(rows.withColumn("direct", F.coalesce("direct", F.lit(False)))), both, cosines).withColumn("visual", visual_score(c("cosine")))
    comparable, same = c("cosine").isNotNull(), c("category") == c("r_category")
    fits = (same | (comparable & (c("visual") >= S["category_gate"]))) & (~c("type_conflict") | c("direct") | (comparable & (c("visual") >= S["type_gate"])))
    part = lambda name: F.when(fits, F.round(name, 9)).otherwise(0.0).alias(name)
    return out.select("look", "pos", "item", *[part(n) for n in ("color_sim", "material_sim", "fit_sim", "detail_sim")], F.round("visual", 9).alias("visual"),
                      fits.alias("compatible"), "direct", F.when(fits, _total(same, c("direct"))).otherwise(0.0).alias("similarity"))


# ---- one-to-one assignment ---------------------------------------------------------------

def _parts(lists: list[list[tuple[int, int]]]) -> list[list[int]]:
    """Positions grouped by shared items, each group in order."""
    owner: dict[int, int] = {}
    parent = list(range(len(lists)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for at, options in enumerate(lists):
        for item, _ in options:
            parent[top(at)] = top(owner.setdefault(item, at))
    groups: dict[int, list[int]] = {}
    for at in range(len(lists)):
        groups.setdefault(top(at), []).append(at)
    return list(groups.values())


def _best_assignment(lists: list[list[tuple[int, int]]]) -> list[int]:
    """Candidate index per position (len = skip) of the best assignment.

    Most positions filled first, then the largest sum, then the earliest candidates in
    position order.  One integer per choice orders all three: a count bit above the weight
    above one digit per position.  Positions enter one by one and each takes the most
    valuable exchange chain, which keeps the assignment optimal for those entered.
    """
    picks = [len(options) for options in lists]
    for group in _parts(lists):
        digits = 4 * len(group)
        above = digits + 40 + len(group).bit_length()
        value = {}
        for j, at in enumerate(group):
            for i, (item, weight) in enumerate(lists[at]):
                value[at, item] = (1 << above) + (weight << digits) + ((15 - i) << 4 * (len(group) - 1 - j))
        holder: dict[int, int] = {}
        for start in group:
            gain, came, queue = {start: 0}, {}, [start]
            best, end = 0, (start, None)  # leave the new position empty
            while queue:
                at = queue.pop(0)
                for item, _ in lists[at]:
                    reached = gain[at] + value[at, item]
                    other = holder.get(item)
                    if other is None:
                        if reached > best:
                            best, end = reached, (at, item)
                    elif other != at and reached - value[other, item] > gain.get(other, -1 << above + 8):
                        gain[other] = reached - value[other, item]
                        came[other] = (at, item)
                        queue.append(other)
                        if gain[other] > best:
                            best, end = gain[other], (other, None)
            at, item = end
            while True:  # walk the chain back, handing items over
                if item is not None:
                    holder[item] = at
                if at == start:
                    break
                at, item = came[at]
        for item, at in holder.items():
            picks[at] = next(i for i, (x, _) in enumerate(lists[at]) if x == item)
    return picks


def _assign_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One input row per part of a look: its positions in search order with their candidates."""
    for frame in batches:
        out = []
        for look, lists in zip(frame["look"], frame["lists"]):
            options = [list(zip(entry["items"].tolist(), entry["weights"].tolist())) for entry in lists]
            for entry, option, pick in zip(lists, options, _best_assignment(options)):
                if pick < len(option):
                    out.append((look, int(entry["pos"]), int(entry["kind"]), int(entry["lid"]), bool(entry["own"]), pick))
        yield pd.DataFrame(out, columns=["look", "pos", "kind", "lid", "own", "at"])


def _in_parts(lists: DataFrame) -> DataFrame:
    """Lists with the part of their look they belong to: positions that share no item, even over others, need no common search.

    Only looks of more than ``LARGE`` positions are taken apart here, so that one such look spreads over tasks.
    """
    large = materialize(lists.groupBy("look").agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE).select("look"))
    if large.isEmpty():
        return lists.withColumn("part", F.lit(0))
    wanted = lists.join(large, "look", "left_semi").select("look", "pos", F.explode("items").alias("item"))
    first = wanted.groupBy("look", "item").agg(F.min("pos").alias("b"))
    labels = graph.components(wanted.join(first, ["look", "item"]).select("look", F.col("pos").alias("a"), "b"), ["look"])
    known = labels.select("look", F.col("node").alias("pos"), F.col("label").alias("part"))
    joined = lists.join(known, ["look", "pos"], "left").join(large.withColumn("_large", F.lit(True)), "look", "left")
    return joined.withColumn("part", F.when(F.col("_large"), F.coalesce("part", "pos")).otherwise(0)).drop("_large")


def assign(ranked: DataFrame) -> DataFrame:
    """Use every item at most once per look: most requirements first, then the largest sum."""
    values = [x for x in ranked.columns if x not in ("look", "pos")]
    order = ["rank", *[x for x in values if x != "rank"]]
    listed = ranked.groupBy("look", "pos").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("options")).withColumn("lid", F.xxhash64("options"))
    listed = materialize(listed.withColumns({"own": F.lit(False), "kind": F.lit(0).cast("long"), "sid": F.lit(0).cast("long"), "first": F.col("options")[0]["item"]}))
    common = materialize(listed.groupBy("lid").agg(F.first("options").alias("options")))
    return assign_lists(Lists(listed.drop("options"), common)).select(*ranked.columns)


def _looks(lists: Lists) -> DataFrame:
    """One row per look: asked (its positions with candidates), clash (two of them have the same first candidate), total (signatures).

    All that is known per requirement row meets here, in one shuffle; nothing after it goes back to the rows.
    """
    c = F.col
    # Positions with the same list are interchangeable: the first of them are served first and
    # a list of eight serves eight at most, so the others stay without an item.
    alike = Window.partitionBy("look", "lid").orderBy("pos")
    rows = lists.rows.repartition("look").withColumn("_n", F.row_number().over(alike))
    entry = F.when(c("first").isNotNull() & (c("_n") <= TOP), F.struct("pos", "kind", "lid", "own", "first"))
    looks = rows.groupBy("look").agg(F.collect_list(entry).alias("asked"), F.size(F.collect_set("sid")).cast("long").alias("total"))
    return materialize(looks.withColumn("clash", F.size(F.array_distinct("asked.first")) < F.size("asked")))


def assign_lists(lists: Lists, looks: DataFrame | None = None) -> DataFrame:
    """The assignment over lists: (look, pos, kind) with the values of the option it got.

    Where no two requirements of a look have the same first candidate, all of them take theirs, which nothing can exceed;
    only the other looks need a search.  What travels is the number of a list; a search sees one connected part of a look,
    and at most eight positions per distinct list, however many rows a look has.
    """
    c = F.col
    looks = _looks(lists) if looks is None else looks
    asked = lambda which: looks.where(which).select("look", F.inline("asked")).drop("first")
    weights = F.transform("options.similarity", lambda x: F.round(x * 1e9).cast("long")).alias("weights")
    contested = materialize(lists.joined(asked("clash")).select("look", "pos", "kind", "lid", "own", c("options.item").alias("items"), weights))
    entry = F.struct(F.size("items").alias("size"), "pos", "kind", "lid", "own", "items", "weights")
    packed = _in_parts(contested).groupBy("look", "part").agg(F.array_sort(F.collect_list(entry)).alias("lists"))
    picked = packed.mapInPandas(_assign_batches, "look long, pos int, kind long, lid long, own boolean, at int")
    served = asked("NOT clash").withColumn("at", F.lit(0)).unionByName(picked)
    return lists.joined(served).withColumn("_o", c("options")[c("at")]).select("look", "pos", "kind", "_o.*")


def _signature() -> Column:
    listed = lambda name: F.array_join(F.array_sort(F.filter(F.transform(F.split(F.coalesce(name, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")), ",")
    return F.concat_ws("|", F.lower(F.trim("category")), *[listed(n) for n in ("colors", "details", "subcategory", "sleeve_length", "length")])


def signature(requirements: DataFrame) -> DataFrame:
    """Requirement rows with the signature that makes two of them the same garment."""
    return requirements.select("look", "pos", "category", _signature().alias("signature"))


def collapse(assigned: DataFrame, signs: DataFrame) -> DataFrame:
    """Keep the best match per look and signature, the earliest position on ties.  ``signs``: kind, sid, signature; one row per kind."""
    rows = assigned.join(signs, "kind").repartition("look")  # what follows per look needs no other shuffle
    best = Window.partitionBy("look", "sid").orderBy(F.desc("similarity"), "pos")
    return rows.withColumn("_at", F.row_number().over(best)).where(F.col("_at") == 1).select(
        "look", "signature", "pos", "item", "category", "similarity", "color_sim", "visual")


def kept_matches(lists: Lists) -> tuple[DataFrame, DataFrame]:
    """The matches kept per look and signature, and (look, total): how many signatures every look asks for."""
    looks = _looks(lists)
    return collapse(assign_lists(lists, looks), lists.signs), looks.select("look", "total")


def look_sums(kept: DataFrame) -> DataFrame:
    """(look, fulfilled, similarity, color_similarity, usable); usable looks have at least one good apparel match."""
    good = F.col("category").isin(dims.APPAREL) & ((F.col("similarity") >= S["keep"]) | (F.col("visual") >= S["keep_visual"]))
    return kept.groupBy("look").agg(F.count("*").alias("fulfilled"), F.avg("similarity").alias("similarity"),
                                    F.avg("color_sim").alias("color_similarity"), F.bool_or(good).alias("usable"))


def match_summary(kept: DataFrame, signed: DataFrame, looks: DataFrame) -> DataFrame:
    """Fulfilment, mean similarities, weather hits and the match score of every look; see ``summarized``."""
    totals = signed.groupBy("look").agg(F.count_distinct("signature").alias("total"))
    sums = kept.groupBy("look").agg(F.count("*").alias("fulfilled"), F.avg("similarity").alias("similarity"),
                                    F.avg("color_sim").alias("color_similarity"))
    return summarized(sums, totals, looks)


def summarized(sums: DataFrame, totals: DataFrame, looks: DataFrame) -> DataFrame:
    """``match_summary`` from the sums of the matches and the number of signatures per look.

    A look that is not analysed (``analysis_ready``), or has no pieces, has zeros everywhere.
    """
    hits = F.size(F.filter(F.split("weather", ","), lambda w: w.isin(dims.TODAY_WEATHER))).cast("long")
    sums = sums.select("look", "fulfilled", "similarity", "color_similarity")
    full = looks.select(F.col("id").alias("look"), "analysis_ready", hits.alias("hits")).join(totals, "look", "left").join(sums, "look", "left")
    analyzed = F.col("analysis_ready") & F.col("total").isNotNull()
    full = full.withColumns({"analyzed": analyzed, "weather_hits": F.when(analyzed, F.col("hits")).otherwise(0)})
    known = lambda name: F.when(F.col("analyzed"), F.coalesce(name, F.lit(0))).otherwise(0)
    return full.select(
        "look", known("fulfilled").alias("fulfilled"), known("total").alias("total"), F.round(known("similarity"), 6).alias("similarity"),
        F.round(known("color_similarity"), 6).alias("color_similarity"), "weather_hits",
        F.floor(F.least(F.lit(98.0), F.round(known("similarity") * 88 + F.col("weather_hits") * 3, 6)) + 0.5).alias("score"), "analyzed")


def default_selection(ranked: DataFrame, chosen: DataFrame, most: int = 3) -> DataFrame:
    """(person, look, default): the looks a person chose, or their first ``most`` ranked ones where they chose none."""
    first = ranked.where(F.col("rank") <= most).select("person", "look").join(chosen.select("person").distinct(), "person", "left_anti")
    return chosen.select("person", "look").distinct().withColumn("default", F.lit(False)).unionByName(first.withColumn("default", F.lit(True)))
