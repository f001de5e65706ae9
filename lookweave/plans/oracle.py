"""SQL text for the correctness gate: rule tables and bindings as common table expressions."""

from __future__ import annotations

import re

from .. import dims
from ..functions.text import color_word_pattern
from .bindings import SHARED


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def sql_match(text: str, pattern: str) -> str:
    return f"regexp_matches(lower(coalesce({text}, '')), {quote(pattern)})"


def sql_rules(text: str, rules, default: str) -> str:
    """CASE over ordered (pattern, value) rules; ``default`` is an SQL expression."""
    return "CASE " + " ".join(f"WHEN {sql_match(text, p)} THEN {quote(v)}" for p, v in rules) + f" ELSE {default} END"


def sql_lookup(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + f" ELSE {default} END"


def sql_values(rows, columns: str) -> str:
    """Inline table; ``rows`` hold ready SQL literals."""
    return "(VALUES " + ", ".join("(" + ", ".join(r) + ")" for r in rows) + f") AS t({columns})"


def sql_tokens(text: str) -> str:
    return ("list_filter(string_split_regex(lower(coalesce(" + text + ", '')), '[\\s·,/()\\[\\]_-]+'), "
            "lambda t: length(t) > 1)")


def sql_palette(text: str) -> str:
    entries = ", ".join(
        f"{{'name': {quote(n)}, 'r': {r}.0::DOUBLE, 'g': {g}.0::DOUBLE, 'b': {b}.0::DOUBLE}}" for n, (r, g, b) in dims.COLOR_RGB.items())
    return f"list_filter([{entries}], lambda c: contains(lower(coalesce({text}, '')), c.name))"


def sql_strip_colors(text: str) -> str:
    pattern = color_word_pattern().removeprefix("(?i)")
    return (f"trim(regexp_replace(regexp_replace(coalesce({text}, ''), {quote(pattern)}, ' ', 'gi'), "
            "'\\s{2,}', ' ', 'g'))")


def sql_hue(r: str, g: str, b: str) -> str:
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    sector = (f"CASE WHEN {top} = {r} THEN ({g} - {b}) / ({top} - {low}) WHEN {top} = {g} THEN ({b} - {r}) / ({top} - {low}) + 2 "
              f"ELSE ({r} - {g}) / ({top} - {low}) + 4 END")
    return (f"CASE WHEN {top} = {low} THEN 0.0::DOUBLE WHEN 60 * ({sector}) < 0 THEN 60 * ({sector}) + 360 "
            f"ELSE 60 * ({sector}) END")


def sql_rgb_name(hue: str, sat: str, value: str) -> str:
    return (f"CASE WHEN {sat} < 0.12 THEN CASE WHEN {value} < 0.20 THEN '블랙' WHEN {value} > 0.84 THEN '화이트' "
            f"WHEN {value} > 0.62 THEN '라이트 그레이' ELSE '그레이' END "
            f"WHEN {value} < 0.22 THEN CASE WHEN {hue} >= 190 AND {hue} < 260 THEN '네이비' ELSE '블랙' END "
            f"WHEN {hue} < 15 OR {hue} >= 345 THEN CASE WHEN {value} < 0.62 OR {sat} < 0.45 THEN '브라운' ELSE '레드' END "
            f"WHEN {hue} < 45 THEN CASE WHEN {value} < 0.62 THEN '브라운' ELSE '베이지' END "
            f"WHEN {hue} < 75 THEN '베이지' WHEN {hue} < 165 THEN '그린' WHEN {hue} < 195 THEN '민트' "
            f"WHEN {hue} < 255 THEN CASE WHEN {value} < 0.48 THEN '네이비' ELSE '블루' END "
            f"WHEN {hue} < 300 THEN '퍼플' ELSE '핑크' END")


def sql_set_similarity(have: str, want: str, groups=()) -> str:
    same = " OR ".join(
        "((" + " OR ".join(f"contains(a, {quote(t)})" for t in g) + ") AND (" + " OR ".join(f"contains(b, {quote(t)})" for t in g) + "))"
        for g in groups) or "false"
    return (f"CASE WHEN len({have}) = 0 OR len({want}) = 0 THEN 0.18::DOUBLE ELSE list_max(flatten(list_transform({have}, lambda a: "
            f"list_transform({want}, lambda b: CASE WHEN a = b THEN 1.0::DOUBLE WHEN contains(a, b) OR contains(b, a) "
            f"THEN 0.82::DOUBLE WHEN {same} THEN 0.68::DOUBLE ELSE 0.0::DOUBLE END)))) END")


def sql_color_similarity(have: str, want: str) -> str:
    square = "pow(a.r - b.r, 2) + pow(a.g - b.g, 2) + pow(a.b - b.b, 2)"
    return (f"coalesce(list_max(flatten(list_transform({have}, lambda a: list_transform({want}, lambda b: "
            f"CASE WHEN a.name = b.name THEN 1.0::DOUBLE ELSE exp(-({square}) / {2 * dims.COLOR_SIGMA ** 2}::DOUBLE) END)))), 0.12::DOUBLE)")


def sql_keyword_rules(text: str, rules, field: int, default: str) -> str:
    """First keyword row contained in ``text``; yields one field of the row's value."""
    def literal(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return "true" if value else "false"
        return str(value) if isinstance(value, int) else quote(value)

    parts = []
    for words, spec in rules:
        hit = " OR ".join(f"contains({text}, {quote(w)})" for w in words)
        parts.append(f"WHEN {hit} THEN {literal(spec[field])}")
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


_construction = "list_filter([" + ", ".join(
    f"CASE WHEN {sql_match('name', p)} THEN {quote(v)} END" for p, v in dims.CONSTRUCTION_RULES) + "], lambda v: v IS NOT NULL)"

VIEWS: dict[str, str] = dict(SHARED)
VIEWS["attr_v"] = f"""
SELECT *, {sql_lookup('material', dims.TEXTURE_BY_MATERIAL, quote(dims.DEFAULT_TEXTURE))} AS texture,
  {sql_lookup('material', dims.WRINKLE_BY_MATERIAL, quote(dims.DEFAULT_WRINKLE))} AS wrinkle,
  CASE WHEN {sql_match('name', dims.WASHED_PATTERN)} THEN {quote(dims.WASHED_FINISH)} WHEN material = '레더' THEN {quote(dims.LEATHER_FINISH)}
    WHEN {sql_match('name', dims.GLOSS_PATTERN)} THEN {quote(dims.GLOSS_FINISH)} ELSE {quote(dims.DEFAULT_FINISH)} END AS finish,
  CASE WHEN len(built) > 0 THEN built ELSE [{quote(dims.DEFAULT_CONSTRUCTION)}] END AS construction,
  CASE WHEN material = '나일론' AND {sql_match('name', dims.WINTER_PATTERN)} THEN {sql_list(dims.WINTER_SEASON)}
    WHEN {sql_match('name', dims.SUMMER_PATTERN)} THEN {sql_list(dims.SUMMER_SEASON)} ELSE {sql_list(dims.DEFAULT_SEASON)} END AS season,
  {sql_lookup('fit', dims.SILHOUETTE_BY_FIT, quote(dims.DEFAULT_SILHOUETTE))} AS silhouette,
  CASE WHEN material = '나일론' THEN {sql_list(dims.NYLON_WEATHER)} WHEN {sql_match('name', dims.HOT_PATTERN)} THEN {sql_list(dims.HOT_WEATHER)}
    ELSE {sql_list(dims.DEFAULT_WEATHER)} END AS weather
FROM (SELECT category, name, color, {_construction} AS built,
  {sql_rules('name', dims.SUBCATEGORY_RULES, 'category')} AS subcategory,
  {sql_rules('name', dims.SLEEVE_RULES, quote(dims.UNKNOWN))} AS sleeve_length,
  {sql_rules('name', dims.LENGTH_RULES, "'기본'")} AS length,
  {sql_rules('name', dims.NECKLINE_RULES, "'라운드넥'")} AS neckline,
  {sql_rules('name', dims.MATERIAL_RULES, "'혼방'")} AS material,
  {sql_rules('name', dims.FIT_RULES, "'레귤러'")} AS fit,
  {sql_rules('name', dims.PATTERN_RULES, "'무지'")} AS pattern
  FROM (SELECT DISTINCT category, name, color FROM item_v))"""


def add_view(name: str, sql: str) -> None:
    """Make ``sql`` usable by name in the twins registered after it."""
    VIEWS[name] = sql


def _needs(sql: str, order: list[str], done: set[str]) -> None:
    for name in VIEWS:
        if name not in done and re.search(rf"\b{name}\b", sql):
            done.add(name)
            _needs(VIEWS[name], order, done)
            order.append(name)


def complete(sql: str) -> str:
    """Prefix the views a statement uses, in dependency order."""
    order: list[str] = []
    _needs(sql, order, set())
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    ctes = [f"{name} AS MATERIALIZED ({VIEWS[name]})" for name in order]
    if not ctes:
        return body
    if recursive:
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE"):].lstrip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + body
