"""Nested text cells -> rows and columns.

Booking lines arrive as the text of a Python list of dicts, event
attributes as the text of a dict.  Both are parsed by the JSON reader
(single quotes allowed) after ``pyliteral_to_json`` rewrites bare
``None``/``True``/``False``.  Cells that are valid literals but not JSON
(tuples, trailing commas, hexadecimal numbers and the like) take a branch of
their own, where Python reads them in Arrow batches; the other rows never
pass through Python.
"""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.functions.text import pyliteral_to_json

LINE_ITEM = T.StructType([
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("item_price", T.DoubleType()),
])


def _options(strict: bool) -> dict[str, str]:
    return {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true",
            "mode": "FAILFAST" if strict else "PERMISSIVE"}


def _jsonable(x):
    """A literal's value with what JSON lacks replaced: tuples and sets as
    lists, keys and bytes as text, other things as their text."""
    if isinstance(x, dict):
        return {str(k): _jsonable(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_jsonable(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted((_jsonable(v) for v in x), key=str)
    if isinstance(x, bytes):
        return x.decode("utf-8", "replace")
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def _literal_reader(strict: bool):
    @F.pandas_udf(T.StringType())
    def read(texts: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return json.dumps(_jsonable(ast.literal_eval(text.strip())), ensure_ascii=False)
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError) as e:
                if strict:
                    raise ValueError(f"not a literal: {text[:200]}") from e
                return None
        return texts.map(one)
    return read


def as_json(df: DataFrame, text_col: str, out: str = "_json", strict: bool = True) -> DataFrame:
    """``df`` with ``out``: the literal in ``text_col`` as text for the JSON
    reader.  A missing or blank cell is null.  A cell that is no literal at
    all raises, with ``strict=False`` it is null.

    Rows are split by whether the JSON reader takes them; the branch of the
    others costs a second scan of the columns it needs.
    """
    text = F.col(text_col)
    blank = text.isNull() | (F.trim(text) == "")
    rewritten = F.when(~blank, pyliteral_to_json(text))
    readable = blank | F.from_json(rewritten, "variant", _options(False)).isNotNull()
    easy = df.filter(readable).withColumn(out, rewritten)
    return easy.unionByName(df.filter(~readable).withColumn(out, _literal_reader(strict)(text)))


def parse_items(text: Column, item_schema: T.StructType = LINE_ITEM, strict: bool = True) -> Column:
    """JSON text (or a literal that the JSON reader takes) of a list of dicts
    -> ``array<struct>``.

    Strict: malformed text raises.  Lenient: malformed text gives an empty
    list.  A missing cell gives an empty list in both modes; a missing key
    gives a null field.
    """
    opts = _options(strict)
    parsed = F.from_json(pyliteral_to_json(text), T.ArrayType(item_schema), opts)
    return F.coalesce(parsed, F.array().cast(T.ArrayType(item_schema)))


def explode_items(df: DataFrame, id_col: str, items: Column, keep_empty: bool = True) -> DataFrame:
    """One row per list element.  ``keep_empty`` keeps a bookings with an
    empty list as one row of nulls; otherwise empty lists and null elements
    drop out."""
    if keep_empty:
        return df.select(id_col, F.explode_outer(items).alias("_item"))
    return df.select(id_col, F.explode(items).alias("_item")).filter(F.col("_item").isNotNull())


def booking_lines(tx: DataFrame, strict: bool = True, keep_empty: bool = True,
                  id_col: str = "booking_id", text_col: str = "product_metadata") -> DataFrame:
    """Bookings' product lines with ``product_amount = quantity * item_price``."""
    texts = as_json(tx.select(id_col, text_col), text_col, "_json", strict)
    rows = explode_items(texts, id_col, parse_items(F.col("_json"), strict=strict), keep_empty=keep_empty)
    return rows.select(
        id_col,
        F.col("_item.product_id").alias("product_id"),
        F.col("_item.quantity").alias("quantity"),
        F.col("_item.item_price").alias("item_price"),
        (F.col("_item.quantity") * F.col("_item.item_price")).alias("product_amount"),
    )


MOST_KEYS = 2000


def attribute_types(found: DataFrame, variant_col: str = "_v", most_keys: int = MOST_KEYS) -> dict[str, str]:
    """Type of every key of the dicts in ``variant_col``, in key order: one
    aggregate whose result has a row per key.  Whole numbers are ``bigint``,
    other numbers ``double``; keys of several kinds or of nested values are
    ``string``.  More keys than ``most_keys`` (keys that are data rather than
    names) are an error."""
    pairs = found.select(F.explode(F.try_variant_get(variant_col, "$", "map<string,variant>")).alias("key", "value"))
    kinds = pairs.groupBy("key").agg(F.schema_of_variant_agg("value").alias("kind")).orderBy("key").limit(most_keys + 1).collect()
    if len(kinds) > most_keys:
        raise ValueError(f"more than {most_keys} attribute names; read them as a map instead")

    def type_of(kind: str) -> str:
        if kind in ("BIGINT", "BOOLEAN", "STRING"):
            return kind.lower()
        return "double" if kind in ("DOUBLE", "FLOAT") or kind.startswith("DECIMAL") else "string"
    return {r["key"]: type_of(r["kind"]) for r in kinds}


def event_attributes(events: DataFrame, event_name: str, attr_schema: T.StructType | None = None,
                     name_col: str = "event_name", meta_col: str = "event_metadata", strict: bool = True,
                     as_map: bool = False) -> DataFrame:
    """Events of one name with their attribute dict spread into columns.

    With ``attr_schema`` the declared keys become typed columns.  Without it
    one pass over the attribute text finds every key and its type
    (``attribute_types``) and each key becomes a column; a key named like a
    column of the events is an error.  ``as_map`` keeps the keys open in
    ``attributes`` (map of text).  A missing key is null.  Malformed text
    raises; ``strict=False`` turns it into nulls.  A missing cell has no
    attributes in both modes.
    """
    ev = events.filter(F.col(name_col) == F.lit(event_name))
    base = [c for c in ev.columns if c not in (name_col, meta_col)]
    rows = as_json(ev, meta_col, "_json", strict).select(*base, "_json")
    text, opts = pyliteral_to_json(F.col("_json")), _options(strict)
    if as_map:
        return rows.select(*base, F.from_json(text, T.MapType(T.StringType(), T.StringType()), opts).alias("attributes"))
    if attr_schema is not None:
        return rows.select(*base, F.from_json(text, attr_schema, opts).alias("_m")).select(*base, "_m.*")
    found = rows.select(*base, F.from_json(text, "variant", _options(False)).alias("_v"))
    types = attribute_types(found.select("_v"))
    clashes = sorted(set(types) & set(base))
    if clashes:
        raise ValueError(f"attributes named like columns of the events: {', '.join(clashes)}")
    spread = found.select(*base, F.try_variant_get("_v", "$", "map<string,variant>").alias("_m"))
    return spread.select(*base, *[F.try_variant_get(F.try_element_at("_m", F.lit(k)), "$", t).alias(k) for k, t in types.items()])


CART_ITEM = LINE_ITEM


def cart_events(events: DataFrame, event_name: str, strict: bool = True) -> DataFrame:
    """Add-to-cart events with their product, quantity, price (rounded to
    cents after the amount is taken) and ``prod_amount = quantity * price``."""
    rows = event_attributes(events, event_name, CART_ITEM, strict=strict)
    price = F.col("item_price")
    return rows.select("event_id", "event_time", "session_id", "traffic_source", F.col("product_id").alias("prod_id"), "quantity",
                       F.bround(price, 2).alias("item_price"), (F.col("quantity") * price).alias("prod_amount"))
