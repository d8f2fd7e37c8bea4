"""JSON objects in and out."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.schema import BULK_BYTES, BULK_ITEMS, OBJECT_BYTES, InvalidRequest


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise InvalidRequest("a number is too large")
    return value


def _object(value) -> dict:
    if not isinstance(value, dict):
        raise InvalidRequest("not a JSON object")
    return {k: v for k, v in value.items() if k != "id"}


def _loads(body: str, most: int):
    if len(body.encode("utf-8", "surrogatepass")) > most:
        raise InvalidRequest("the body is too large")
    try:
        return json.loads(body, parse_int=_number, parse_float=_number, parse_constant=_number)
    except (ValueError, RecursionError) as error:
        raise InvalidRequest(f"invalid JSON: {error}") from None


def parse_object(body: str) -> dict:
    """One object: numbers are doubles, of repeated keys the last counts, a client's ``id`` is dropped."""
    return _object(_loads(body, OBJECT_BYTES))


def parse_bulk(body: str) -> list[dict]:
    """An array of objects, all of which must be good."""
    items = _loads(body, BULK_BYTES)
    if not isinstance(items, list):
        raise InvalidRequest("not a JSON array")
    if len(items) > BULK_ITEMS:
        raise InvalidRequest(f"more than {BULK_ITEMS} objects")
    return [_object(i) for i in items]


def stored(obj: dict) -> str:
    return json.dumps(obj, ensure_ascii=False, separators=(",", ":"))


def _plain(value):
    """Doubles that are whole, without their fraction."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return int(value)
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def returned(doc: str, id_: int) -> dict:
    """The object with its id, keys sorted."""
    return dict(sorted({**_plain(json.loads(doc)), "id": id_}.items()))


def parse_column(text: Column) -> Column:
    """A variant for each text that is a JSON object, else null."""
    return F.element_at(F.transform(F.array(F.try_parse_json(text)), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v)), 1)


def read_json(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``doc``, a variant, for every row; null where the text is no JSON object."""
    return df.select(*keep, parse_column(F.col(text)).alias("doc"))


def read_arrays(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """A row (``pos``, ``doc``) for each item of JSON arrays, in order."""
    return df.select(*keep, F.posexplode(F.from_json(text, "array<variant>")).alias("pos", "doc"))


def write_json(df: DataFrame, id_column: str = "id", doc: str = "doc") -> DataFrame:
    """``json``: the document's text with the id put in, keys sorted."""
    fields = F.map_filter(F.variant_get(doc, "$", "map<string,variant>"), lambda k, _: k != "id")
    entries = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))
    entries = F.array_sort(F.array_append(entries, F.struct(F.lit("id").alias("k"), F.col(id_column).cast("string").alias("v"))))
    # {"k":"name"} holds the quoted name
    quoted = F.transform(entries, lambda e: F.concat(F.regexp_extract(F.to_json(F.struct(e["k"].alias("k"))), r'(?s)\A\{"k":(.*)\}\z', 1), F.lit(":"), e["v"]))
    return df.select(id_column, F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")).alias("json"))
