"""Immutable Parquet generations of a table, and the pointer to the current one."""

from __future__ import annotations

import json
import threading
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from objectlake.schema import KEYS, OBJECT
from objectlake.sources.files import Files


class Generations:
    """``CURRENT`` holds the number of a generation; its manifest has what was applied.

    A generation is written under a name that nothing reads, then the pointer is
    replaced.  Readers keep the generation they started with while they ``pin`` it;
    ``collect`` leaves those.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType = OBJECT, keys: list[str] = KEYS) -> None:
        self.spark, self.files, self.schema, self.keys = spark, Files(spark, root), schema, keys
        self.pins: Counter[int] = Counter()
        self.guard = threading.Lock()

    @contextmanager
    def pin(self) -> Iterator[int]:
        """Keeps the current generation from being collected by this process."""
        with self.guard:
            n = self.current()
            self.pins[n] += 1
        try:
            yield n
        finally:
            with self.guard:
                self.pins[n] -= 1

    def current(self) -> int:
        return int(self.files.read("CURRENT")) if self.files.exists("CURRENT") else 0

    def manifest(self, generation: int | None = None) -> dict:
        n = self.current() if generation is None else generation
        return json.loads(self.files.read(f"gen-{n}.json")) if n else {"applied": 0}

    def read(self, generation: int | None = None) -> DataFrame:
        n = self.current() if generation is None else generation
        return self.spark.read.schema(self.schema).parquet(f"{self.files.root}/gen-{n}") if n else self.spark.createDataFrame([], self.schema)

    def publish(self, rows: DataFrame, applied: int, **facts) -> int:
        """Writes the next generation, sorted by key over range partitions, and makes it current."""
        n = self.current() + 1
        self.files.delete(f"gen-{n}")
        rows.select(*self.schema.names).repartitionByRange(*self.keys).sortWithinPartitions(*self.keys).write.parquet(f"{self.files.root}/gen-{n}")
        self.files.write(f"gen-{n}.json", json.dumps({"applied": applied, **facts}))
        self.files.write("CURRENT", str(n))
        return n

    def numbers(self) -> list[int]:
        return sorted(int(f[4:]) for f in self.files.list("") if f.startswith("gen-") and not f.endswith((".json", ".tmp")))

    def collect(self, keep: int = 1) -> None:
        """Deletes what a broken publish left above the current generation, and all below the last ``keep``."""
        with self.guard:
            now = self.current()
            for n in self.numbers():
                if n > now or n <= now - keep and not self.pins[n]:
                    self.files.delete(f"gen-{n}")
                    self.files.delete(f"gen-{n}.json")
        for name in self.files.list(""):
            if name.endswith(".tmp"):
                self.files.delete(name)
