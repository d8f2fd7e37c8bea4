"""Names, ids and paging parameters, on the driver and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from objectlake.schema import NAME_CHARS, InvalidName, InvalidRequest

# \z, as $ would let a trailing line feed pass
NAME = rf"\A[A-Za-z0-9_.-]{{1,{NAME_CHARS}}}\z"
_NAME = re.compile(rf"[A-Za-z0-9_.-]{{1,{NAME_CHARS}}}")

LONG = (1 << 63) - 1


def valid_name(name: Column) -> Column:
    return name.rlike(NAME)


def check_name(name: str) -> str:
    if not _NAME.fullmatch(name or ""):
        raise InvalidName(f"invalid name: {name!r}")
    return name


def check_project(project: str | None) -> str:
    """The project of a header: trimmed; empty is the default project."""
    project = (project or "").strip()
    return check_name(project) if project else ""


def parse_id(text: str) -> int:
    if not re.fullmatch(r"[+-]?[0-9]+", text or "") or not 0 < int(text) <= LONG:
        raise InvalidRequest(f"invalid id: {text!r}")
    return int(text)


def valid_id(text: Column) -> Column:
    """Whether a text is an id: a whole number from 1 to the largest of 64 bits."""
    return F.coalesce(text.rlike(r"\A[+-]?[0-9]+\z") & (text.try_cast("bigint") > 0), F.lit(False))


def int_or(text: str | None, default: int) -> int:
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text or "") and abs(int(text)) <= LONG else default


def object_key(project: Column, class_: Column, id_: Column) -> Column:
    """The byte key of an object: ordered by project, class and id."""
    zero = F.unhex(F.lit("00"))
    scope = F.when(project == "", F.unhex(F.lit(""))).otherwise(F.concat(F.encode(project, "utf-8"), zero))
    return F.concat(F.unhex(F.lit("02")), scope, F.encode(class_, "utf-8"), zero, F.unhex(F.lpad(F.hex(id_), 16, "0")))
