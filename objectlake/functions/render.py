"""The string form of fields, on which filters compare."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def render_double(v: Column) -> Column:
    """The shortest decimal, never with an exponent: 100.0 is 100, 1e21 is written out, -0.0 is -0.

    The digits are those of the JVM's shortest form, of which the exponent is resolved.
    """
    text = F.abs(v).cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), r"0+\z", "")
    far = F.concat(whole, part, F.repeat(F.lit("0"), power - F.length(part)))
    near = F.concat(whole, part.substr(F.lit(1), power), F.lit("."), part.substr(power + 1, F.length(part)))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), whole, part)
    large = F.when(power < 0, small).when(F.length(part) <= power, far).otherwise(near)
    plain = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
    fast = (v == F.floor(v)) & (F.abs(v) < 1e15) & (v != 0)
    special = F.when(F.isnan(v), "NaN").when(v == float("inf"), "+Inf").when(v == float("-inf"), "-Inf")
    return F.when(fast, v.cast("bigint").cast("string")).otherwise(F.coalesce(special, F.concat(sign, F.when(F.instr(text, "E") > 0, large).otherwise(plain))))


def nested_text(value) -> str:
    """Lists as [a b], objects as map[k:v] with sorted keys, null as <nil>."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + " ".join(map(nested_text, value)) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{nested_text(v)}" for k, v in sorted(value.items())) + "]"
    if isinstance(value, (int, float)):
        return _general(float(value))
    return str(value)


def _general(x: float) -> str:
    """The shortest form, with an exponent of two digits or more below 1e-4 and from 1e21 on."""
    if x == 0:
        return "-0" if str(x)[0] == "-" else "0"
    digits, _, power = f"{x!r}".partition("e")
    if 1e-4 <= abs(x) < 1e21:
        text = format(Decimal(repr(x)), "f")
        return text.rstrip("0").rstrip(".") if "." in text else text
    if not power:
        sign, numbers, exponent = Decimal(repr(x)).normalize().as_tuple()
        digits = "-" * sign + str(numbers[0]) + ("." + "".join(map(str, numbers[1:])) if numbers[1:] else "")
        power = str(exponent + len(numbers) - 1)
    digits = digits.removesuffix(".0")
    return f"{digits}e{'-' if int(power) < 0 else '+'}{abs(int(power)):02d}"


def nested_udf(texts: Column) -> Column:
    """``nested_text`` of JSON, in Arrow batches."""

    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: None if t is None else nested_text(json.loads(t)))

    return F.pandas_udf(run, T.StringType())(texts)


def render(col: Column, kind: T.DataType) -> Column:
    """The string form of a typed column; null stays null and so never matches."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return render_double(col.cast("double"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return nested_udf(F.to_json(col))
    return col.cast("string")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def render_variant(doc: Column, name: str, nested: bool = True) -> Column:
    """The string form of a top-level field of a variant object, by its exact name.

    Numbers are doubles first.  Lists and objects need a Python worker for
    their text; ``nested=False`` leaves them out, so they never match.
    """
    if '"' in name or "\\" in name:
        field = F.try_variant_get(doc, "$", "map<string,variant>")[name]
    else:
        field = F.try_variant_get(doc, f'$["{name}"]', "variant")

    def scalar(v: Column) -> Column:
        parts = F.struct(F.schema_of_variant(v).alias("kind"), F.try_variant_get(v, "$", "double").alias("x"), F.try_variant_get(v, "$", "string").alias("s"))
        number = r"\A(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"
        return bind(parts, lambda p: F.when(p["kind"].rlike(number), render_double(p["x"])).when(p["kind"].isin("STRING", "BOOLEAN"), p["s"]))

    out = bind(field, scalar)
    if nested:
        out = F.coalesce(out, nested_udf(F.when(F.schema_of_variant(field).rlike(r"\A(ARRAY|OBJECT)"), F.to_json(field))))
    return out


def fixed_text(x: float) -> str | None:
    """The shortest decimal of a number that is finite and not zero, without an exponent; else None."""
    if x == 0 or not math.isfinite(x):
        return None
    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text
