"""Text expressions: rule tables, tokens, colour words, names and descriptors."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

# ``\b`` in the rule tables means an ASCII word boundary; Java's own ``\b`` also counts
# Hangul letters, so it is spelled out.
_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TOKEN_SPLIT = r"[\s·,/()\[\]_-]+"


def java_pattern(pattern: str) -> str:
    return pattern.replace(r"\b", _BOUNDARY)


def matches(text: Column, pattern: str) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike(java_pattern(pattern))


def first_rule(text: Column, rules: Sequence[tuple[str, str]], default: Column | str | None) -> Column:
    """Value of the first rule whose pattern occurs in ``text``."""
    chain = None
    for pattern, value in rules:
        hit = matches(text, pattern)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(key: Column, table: dict[str, str], default: Column | str | None) -> Column:
    """Value of ``key`` in a constant map; the key expression appears once."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, default if isinstance(default, Column) else F.lit(default))


def let(value: Column, body) -> Column:
    """``body`` over ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_of(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-cased pieces longer than one character."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda t: F.length(t) > 1)


def known_colors(text: Column) -> Column:
    """Named colours occurring in ``text``, in table order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(array_of(list(dims.COLOR_RGB)), lambda c: F.contains(lowered, c))


def color_word_pattern() -> str:
    """Longest words first, so that a two-word colour goes as a whole."""
    words = sorted([*dims.COLOR_RGB, *dims.EXTRA_COLOR_WORDS], key=len, reverse=True)
    return "(?i)" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def strip_colors(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), color_word_pattern(), " ")
    return F.trim(F.regexp_replace(bare, r"\s{2,}", " "))


def infer_color(name: Column) -> Column:
    hits = F.array_compact(
        F.array(*[F.when(matches(name, pattern), F.lit(label)) for pattern, label in dims.NAME_COLOR_RULES])
    )
    return (
        F.when(F.size(hits) > 0, F.array_join(F.slice(hits, 1, 3), "·"))
        .when(matches(name, dims.MANY_COLORS_PATTERN), F.lit(dims.MANY_COLORS))
        .otherwise(F.lit(dims.UNSORTED_COLOR))
    )


def infer_category(name: Column, label: Column) -> Column:
    return F.when(label != dims.ALL_LABEL, label).otherwise(first_rule(name, dims.CATEGORY_RULES, None))


def classify_filename(name: Column) -> Column:
    return first_rule(name, dims.FILENAME_RULES, "상의")


def decode_entities(text: Column) -> Column:
    for entity, char in dims.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def feature_name(category: Column, color: Column, pattern: Column, length: Column, sleeve: Column,
                 fit: Column, material: Column, subcategory: Column) -> Column:
    """Name assembled from attributes; overlapping words keep the more specific one."""
    noise = array_of([*dims.NAME_NOISE, ""])

    def push(kept: Column, token: Column) -> Column:
        clash = lambda e: F.contains(e, token) | F.contains(token, e)
        at = F.array_position(F.transform(kept, clash), True)
        replaced = F.transform(
            kept, lambda e, i: F.when((i == at - 1) & (F.length(token) > F.length(e)), token).otherwise(e)
        )
        return (
            F.when(F.array_contains(noise, token), kept)
            .when(at == 0, F.concat(kept, F.array(token)))
            .otherwise(replaced)
        )

    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    words = F.array(clean(color), clean(pattern), F.when(category == "하의", clean(length)).otherwise(clean(sleeve)),
                    clean(fit), clean(material))
    kept = F.aggregate(words, F.array().cast("array<string>"), push)
    piece = clean(subcategory)
    named = F.when(F.array_contains(noise, piece), clean(category)).otherwise(piece)
    return F.when(F.size(kept) < 2, F.lit("")).otherwise(F.substring(F.array_join(push(kept, named), " "), 1, 40))


def descriptor(*fields: Column) -> Column:
    """Colour-free attribute text, each distinct part once, at most 96 characters."""
    parts = F.array(*[strip_colors(F.replace(F.coalesce(f, F.lit("")), F.lit("|"), F.lit(" "))) for f in fields])
    return F.substring(F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), " | "), 1, 96)


def template_name(color: Column, category: Column, rank: Column) -> Column:
    kind = F.when(category == "상의", F.when(color == "화이트", F.lit("셔츠")).otherwise(F.lit("티셔츠"))).otherwise(
        lookup(category, {"하의": "팬츠", "신발": "슈즈"}, category)
    )
    return F.concat_ws(" ", color, kind, pad3(rank))


def pad3(number: Column) -> Column:
    """At least three digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= 3, text).otherwise(F.lpad(text, 3, "0"))
