"""Schemas, limits and errors."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import types as T

#: Fixed values.
BULK_ITEMS = 10_000
OBJECT_BYTES = 8 << 20
BULK_BYTES = 256 << 20
RECORD_BYTES = 64 << 20
NAME_CHARS = 128
DEFAULT_LIMIT = 100

PUT, DELETE, CREATE_CLASS, DROP_CLASS, BATCH = "put", "delete", "create_class", "drop_class", "batch"

OBJECT = T.StructType([T.StructField("project", T.StringType(), False), T.StructField("class", T.StringType(), False), T.StructField("id", T.LongType(), False), T.StructField("doc", T.StringType())])
MUTATION = T.StructType([*[T.StructField(n, T.StringType()) for n in ("op", "project", "class")], T.StructField("id", T.LongType()), T.StructField("data", T.StringType()), T.StructField("ts", T.LongType())])
LOG = T.StructType([T.StructField("tx_id", T.LongType()), *MUTATION.fields, T.StructField("sub", T.ArrayType(MUTATION))])
CATALOG = T.StructType([T.StructField("project", T.StringType(), False), T.StructField("class", T.StringType(), False)])

KEYS = ["project", "class", "id"]


class LakeError(Exception):
    """``status`` is the HTTP status that a front end would answer with."""

    status = 500


class InvalidName(LakeError):
    status = 400


class InvalidRequest(LakeError):
    status = 400


class NoClass(LakeError):
    status = 404


class NotFound(LakeError):
    status = 404


class ClassExists(LakeError):
    status = 409


class ClassNotEmpty(LakeError):
    status = 409


@dataclass
class Config:
    """Settings of a store; a file's ``key: value`` lines override the defaults, a missing file leaves them."""

    data_dir: str = "data"
    group_commit_batch: int = 256
    checkpoint_log_bytes: int = 64 << 20
    checkpoint_seconds: int = 300

    @classmethod
    def load(cls, path: str) -> Config:
        out, kinds = cls(), {f.name: type(f.default) for f in fields(cls)}
        if Path(path).exists():
            for line in Path(path).read_text().splitlines():
                key, colon, value = line.partition("#")[0].partition(":")
                if not colon:
                    continue
                if key.strip() not in kinds:
                    raise InvalidRequest(f"unknown setting {key.strip()}")
                setattr(out, key.strip(), kinds[key.strip()](value.strip().strip("'\"")))
        out.validate()
        return out

    def validate(self) -> None:
        if not self.data_dir or min(self.group_commit_batch, self.checkpoint_log_bytes, self.checkpoint_seconds) <= 0:
            raise InvalidRequest("settings must not be empty or below 1")
