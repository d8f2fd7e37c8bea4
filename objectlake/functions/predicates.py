"""Equality and LIKE filters on the string form of fields."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from objectlake.functions import render
from objectlake.sources import documents


def lower(col: Column) -> Column:
    """Lower case, code point by code point: neither final sigma nor a dotted I is special."""
    return F.lower(F.translate(col, "İΣ", "iσ"))


def like_regex(pattern: str, ci: bool) -> str:
    """A LIKE pattern as an anchored Java regular expression.

    ``%`` is any run, line feeds included, ``_`` one code point; there is no
    escape, so a backslash stands for itself.
    """
    parts = {"%": ".*", "_": "."}
    body = "".join(parts.get(c) or (c if c.isalnum() or ord(c) > 127 else "\\" + c if c.isprintable() else f"\\x{ord(c):02x}") for c in pattern)
    return f"(?s{'iu' if ci else ''})\\A{body}\\z"


def same(text: Column, value: str, ci: bool = True) -> Column:
    """Whether texts are equal.  Only values with an i or a sigma need the letters that lower case treats apart."""
    if not ci:
        return text == F.lit(value)
    plain = F.lower(text)
    if set(value.lower()) & set("iσς\u0307"):
        plain = F.when(text.contains("İ") | text.contains("Σ"), lower(text)).otherwise(plain)
    return plain == lower(F.lit(value))


def matches(text: Column, pattern: str, ci: bool = True) -> Column:
    """Case folding as in regular expressions.  Case-sensitive patterns are LIKE, of which Spark pushes prefixes down."""
    return text.rlike(like_regex(pattern, True)) if ci else text.like(pattern.replace("\\", "\\\\"))


def number(value: str) -> float | None:
    try:
        x = float(value) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", value, re.A) else math.nan
    except OverflowError:
        return None
    return x if math.isfinite(x) else None


@dataclass(frozen=True)
class Typed:
    """A typed column.  Numbers are compared as such where a value is the text of just one, so that the test reaches the scan."""

    column: Column
    kind: T.DataType

    def eq(self, value: str, ci: bool) -> Column:
        if isinstance(self.kind, T.IntegralType) and re.fullmatch(r"-?[1-9][0-9]{0,17}|0", value):
            return self.column == F.lit(int(value))
        if isinstance(self.kind, T.DoubleType) and (x := number(value)) is not None and render.fixed_text(x) == value:
            return self.column == F.lit(x)
        return same(render.render(self.column, self.kind), value, ci)

    def like(self, pattern: str, ci: bool) -> Column:
        return matches(render.render(self.column, self.kind), pattern, ci)


@lru_cache(maxsize=256)
def _form_of(column: str, name: str, nested: bool, jvm: int) -> Column:
    """Kept, as such an expression takes longer to build than a small class to be read."""
    return render.render_variant(documents.parse_column(F.col(column)), name, nested)


@dataclass(frozen=True)
class Json:
    """A top-level field of JSON text, by its exact name.

    Equality is decided on the few texts that hold the value, and of those on
    the ones whose field has it, or an equal number.  Lists and objects, whose form needs a Python worker, are left out
    where the value can't be one's.
    """

    column: str
    name: str

    @property
    def text(self) -> Column:
        return F.col(self.column)

    def _form(self, nested: bool) -> Column:
        return _form_of(self.column, self.name, nested, id(SparkContext._jvm))

    def eq(self, value: str, ci: bool) -> Column:
        nested = (value.lower() if ci else value).startswith(("[", "map["))
        exact = same(self._form(nested), value, ci)
        if nested or not re.fullmatch(r"[\w. -]+", self.name):
            return exact
        raw = F.get_json_object(self.text, f"$['{self.name}']")
        may = same(raw, value, ci)
        if (x := number(value)) is not None:
            may = may | (raw.try_cast("double") == F.lit(x))
        return F.when(self._holds(value), F.when(may, exact)).otherwise(F.lit(False))

    def _holds(self, value: str) -> Column:
        """Whether the text has the value in it, or what could stand for it: escapes, exponents, more digits than a double has."""
        if not value.isascii() or not value.isprintable() or set(value) & set('"\\'):
            return F.lit(True)
        found = F.lower(self.text).contains(value.lower()) | self.text.contains("\\")
        if "i" in value.lower():
            found = found | self.text.contains("İ")
        return found | self.text.rlike("[0-9][eE]|[0-9]{17}") if number(value) is not None else found

    def like(self, pattern: str, ci: bool) -> Column:
        return matches(self._form(pattern[:1].lower() in ("%", "_", "[", "m")), pattern, ci)


def parse_ci(value: str | None) -> bool:
    return value not in ("false", "0")


def typed_fields(df: DataFrame, id_column: str | None = None) -> Callable[[str], Typed | None]:
    """Fields of a typed table, by exact name; the id is no field."""
    kinds = {f.name: f.dataType for f in df.schema if f.name != id_column and f.name != "id"}
    return lambda name: Typed(df[f"`{name}`"], kinds[name]) if name in kinds else None


def json_fields(column: str) -> Callable[[str], Json]:
    """Fields of JSON objects in a column; what is no object has none."""
    return lambda name: Json(column, name)


def parse_filters(params: Mapping[str, str | list[str]], field: Callable[[str], Typed | Json | None]) -> Column | None:
    """All ``eq.<field>`` and ``like.<field>`` parameters, AND-combined; None if there are none.

    Of a parameter given more than once the first value counts; an empty field
    name and other parameters are ignored; a field that is missing never matches.
    The result is for ``where``, to which null is no match; left bare, equality and prefixes reach the scan.
    """
    first = {k: (v if isinstance(v, str) else v[0] if v else "") for k, v in params.items()}
    ci, found = parse_ci(first.get("ci")), []
    for key, value in first.items():
        kind, _, name = key.partition(".")
        if kind not in ("eq", "like") or not name:
            continue
        of = field(name)
        found.append(F.lit(False) if of is None else getattr(of, kind)(value, ci))
    return reduce(lambda a, b: a & b, found) if found else None
