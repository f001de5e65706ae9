"""Sources: JSON inside scripts, nested JSON documents, product payloads, search pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..functions.text import decode_entities, infer_category, infer_color

LINK_SCHEMA = "struct<murl:string,purl:string,turl:string,t:string,mw:int,mh:int>"


def unwrap_script(text: Column) -> Column:
    """Drop the assignment in front of a JSON value and the semicolon behind it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^window\.\w+\s*=\s*", ""), r";\s*$", "")


def parse_wrapped(frame: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of the JSON array wrapped in every script of column ``text``."""
    keep = [c for c in frame.columns if c != text]
    return frame.select(*keep, F.inline(F.from_json(unwrap_script(F.col(text)), f"array<{schema}>")))


def read_wrapped(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return parse_wrapped(spark.read.text(path, wholetext=True), "value", schema)


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Multi-line JSON documents, one per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


def flatten_items(frame: DataFrame, array: str, keep: list[str], outer: bool = True) -> DataFrame:
    """One row per array element; documents without elements stay with nulls when ``outer``."""
    explode = F.explode_outer if outer else F.explode
    return frame.select(*keep, explode(array).alias("_e")).select(*keep, "_e.*")


FIGURES = ("original_price", "price", "discount_rate", "reviewCount", "reviewScore")
PRODUCT = pa.schema([("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("brand", pa.string()), ("rank", pa.float64()), ("final_price", pa.float64()),
                     ("discount", pa.float64()), ("labels", pa.list_(pa.string())), ("click", pa.string()), ("image_url", pa.string()),
                     *[(f"a_{f}", pa.float64()) for f in FIGURES]])


def _objects(value) -> Iterator[dict]:
    """Objects of a parsed document in document order, parents first; whole-number keys come first and by value."""
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, dict):
            yield value
            keys = sorted((k for k in value if k.isdecimal() and k.isascii() and (k == "0" or k[0] != "0")), key=int)
            value = [*[value[k] for k in keys], *[v for k, v in value.items() if k not in set(keys)]] if keys else list(value.values())
        if isinstance(value, list):
            todo.extend(v for v in reversed(value) if isinstance(v, (dict, list)))


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return str(int(value)) if isinstance(value, float) and value.is_integer() else json.dumps(value, ensure_ascii=False)


def _number(value) -> float | None:
    """A figure as a number; text that is none gives null."""
    try:
        return None if value is None or isinstance(value, (dict, list)) else float(value)
    except ValueError:
        return None


def _part(value, name: str) -> dict:
    part = value.get(name)
    return part if isinstance(part, dict) else {}


def _product(node: dict) -> dict:
    """One product with the first figures below it that carry its id."""
    name = _text(node["id"])
    same = (o for o in _objects(node) if _text(o.get("product_id") or o.get("item_id") or "") == name and (o.get("reviewCount") is not None or o.get("original_price") is not None))
    figures, info, image = next(same, {}), _part(node, "info"), node["image"]
    trimmed = lambda v: v.strip() if isinstance(v, str) else None
    labels = image.get("labels") if isinstance(image.get("labels"), list) else []
    return {"id": name, "name": trimmed(info.get("productName")), "brand": trimmed(info.get("brandName")), "rank": _number(image.get("rank")), "final_price": _number(info.get("finalPrice")),
            "discount": _number(info.get("discountRatio")), "labels": [_text(x.get("text")) for x in labels if isinstance(x, dict)], "click": _text(_part(node, "onClick").get("url")),
            "image_url": _text(image["url"]), **{f"a_{f}": _number(figures.get(f)) for f in FIGURES}}


def product_rows(payloads: DataFrame, payload: str) -> DataFrame:
    """The products of every payload with their place in it and their figures, in one walk; other columns are kept.

    A product is an object of type PRODUCT_COLUMN with an id and an image address, at any depth.  Its figures are those of
    the first object below it, in document order, that names its id (``product_id``, or ``item_id`` where that is empty) and has
    a review count or an original price.  Spark's variants sort the keys of an object, which loses that order, so a
    document is parsed in a small helper, one document at a time.  Unreadable payloads have no products.
    """
    keep = [c for c in payloads.columns if c != payload]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                text = batch.column(payload)[at].as_py()
                try:
                    document = json.loads(text) if text is not None else None
                except (ValueError, RecursionError):
                    continue
                nodes = [o for o in _objects(document) if o.get("type") == "PRODUCT_COLUMN" and o.get("id") and isinstance(o.get("image"), dict) and o["image"].get("url")]
                if nodes:
                    made = pa.RecordBatch.from_pylist([{"place": k, **_product(n)} for k, n in enumerate(nodes)], PRODUCT)
                    same = batch.select(keep).take(pa.array([at] * len(nodes), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*same.columns, *made.columns], names=[*keep, *PRODUCT.names])

    figures = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'double' if f.type == pa.float64() else 'string' if f.type == pa.string() else 'array<string>'}" for f in PRODUCT)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in payloads.select(*keep).schema)
    return payloads.mapInArrow(walk, f"{fields}, {figures}" if keep else figures)


def or_else(*values: Column) -> Column:
    """First value that is neither null nor zero; zero when there is none."""
    return F.coalesce(*[F.nullif(v.cast("double"), F.lit(0.0)) for v in values], F.lit(0.0))


def normalize_products(products: DataFrame, label: str, subcategory: str, gender: str = "men") -> DataFrame:
    """Flat catalogue rows of ``product_rows`` with fallbacks for missing figures; ``label`` and ``subcategory`` are columns of the source."""
    c = F.col
    return products.withColumns({
        "source_rank": c("rank").cast("int"), "source_category": c(label), "gender": F.lit(gender), "category": infer_category(c("name"), c(label)), "subcategory": c(subcategory),
        "color": infer_color(c("name")), "price": or_else(c("final_price"), c("a_price")), "original_price": or_else(c("a_original_price"), c("final_price")),
        "discount_ratio": or_else(c("discount"), c("a_discount_rate")), "review_count": or_else(c("a_reviewCount")), "review_score": or_else(c("a_reviewScore")),
        "ranking_labels": c("labels"), "product_url": F.coalesce("click", F.concat(F.lit(dims.PRODUCT_URL), c("id"))), "image_source_url": c("image_url"),
    }).select("source_rank", "source_category", "id", "gender", "category", "subcategory", "name", "brand", "color", "price", "original_price", "discount_ratio",
              "review_count", "review_score", "ranking_labels", "product_url", "image_source_url", "place")


def extract_links(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Image results in the ``m`` attributes of a search page; unreadable ones are skipped."""
    hits = pages.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(r'\sm="([^"]+)"'), F.lit(1))).alias("raw"))
    parsed = hits.where(F.contains("raw", F.lit("murl"))).select(
        *keep, F.from_json(decode_entities(F.col("raw")), LINK_SCHEMA, {"mode": "PERMISSIVE"}).alias("l")).select(*keep, "l.*")
    return parsed.where((F.coalesce("murl", F.lit("")) != "") & (F.coalesce("purl", F.lit("")) != ""))


def preferred_image(*variants: Column) -> Column:
    """First variant with an address."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in variants])


def parse_model_json(raw: Column) -> Column:
    """The JSON object inside a model's answer as text, null when there is none."""
    cleaned = F.trim(F.regexp_replace(raw, r"(?i)```(?:json)?|```", ""))
    start = F.instr(cleaned, "{")
    end = F.length(cleaned) - F.instr(F.reverse(cleaned), "}") + 1
    body = F.substring(cleaned, start, end - start + 1)
    parsed = F.try_parse_json(F.when((start > 0) & F.contains(cleaned, F.lit("}")) & (end >= start), body))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT<"), F.to_json(parsed))
