"""Point lookups, filtered lists and pages."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from objectlake.functions.names import int_or
from objectlake.functions.predicates import parse_filters, typed_fields
from objectlake.schema import DEFAULT_LIMIT


def scope(objects: DataFrame, project: str, class_: str) -> DataFrame:
    return objects.where((F.col("project") == project) & (F.col("class") == class_))


def get(df: DataFrame, id_: int, id_column: str = "id") -> DataFrame:
    """The row with that id; the equality reaches the scan."""
    return df.where(F.col(id_column) == id_)


def page(df: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, id_column: str = "id") -> DataFrame:
    """Rows by ascending id.  No limit if ``limit`` is 0 or less; a negative offset is 0."""
    out = df.orderBy(id_column)
    if offset > 0:
        out = out.offset(offset)
    return out.limit(limit) if limit > 0 else out


def find(df: DataFrame, params: Mapping[str, str | list[str]], id_column: str = "id", field=None) -> DataFrame:
    """Filter, order by id, offset, limit, as the parameters say."""
    test: Column | None = parse_filters(params, field or typed_fields(df, id_column))
    first = {k: (v if isinstance(v, str) else v[0] if v else "") for k, v in params.items()}
    matched = df if test is None else df.where(test)
    return page(matched, int_or(first.get("limit"), DEFAULT_LIMIT), int_or(first.get("offset"), 0), id_column)
