"""A binary file of vectors as a Spark data source: a line of JSON, then float32 numbers, read by ranges of vectors.

The header is {"key", "dims", "n", "order"}: the name of what the vectors are of, their length and number, and the byte order of the numbers,
"little" or "big". The file must be where every executor can open it by its path, such as a mounted store; each task opens it and reads its own range.

A wrong key, a header that isn't one, and a body that isn't as long as the header says are errors.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ORDERS = {"little": "<f4", "big": ">f4"}
#: Vectors of a range, if not said otherwise.
ROWS = 1 << 16


@dataclass
class Range(InputPartition):
    start: int
    stop: int


def header(path: str) -> tuple[dict, int]:
    """The header of a file, and where its body begins."""
    with open(path, "rb") as f:
        line = f.readline(1 << 16)
    try:
        head = json.loads(line)
        good = line.endswith(b"\n") and isinstance(head["key"], str) and head["order"] in ORDERS and all(isinstance(head[k], int) and head[k] >= 0 for k in ("dims", "n"))
    except (ValueError, KeyError, TypeError):
        good = False
    if not good:
        raise ValueError(f"{path} isn't a file of vectors")
    return head, len(line)


class VectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rows = options["path"], int(options.get("rows", ROWS))
        self.head, self.begin = header(self.path)
        if "key" in options and options["key"] != self.head["key"]:
            raise ValueError(f"{self.path} has the key {self.head['key']}, not {options['key']}")
        if (size := os.path.getsize(self.path)) != (want := self.begin + 4 * self.head["dims"] * self.head["n"]):
            raise ValueError(f"{self.path} has {size} bytes, not {want}")

    def partitions(self) -> list[Range]:
        n = self.head["n"]
        return [Range(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        dims, n = self.head["dims"], partition.stop - partition.start
        with open(self.path, "rb") as f:
            f.seek(self.begin + 4 * dims * partition.start)
            body = f.read(4 * dims * n)
        if len(body) != 4 * dims * n:
            raise ValueError(f"{self.path} ends early")
        flat = pa.array(np.frombuffer(body, ORDERS[self.head["order"]]).astype(np.float32))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dims), flat)
        yield pa.record_batch([pa.array(np.arange(partition.start, partition.stop, dtype=np.int64)), lists], names=["place", "vector"])


class VectorCache(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vector_cache"

    def schema(self) -> str:
        return "place bigint, vector array<float>"

    def reader(self, schema: object) -> VectorReader:
        return VectorReader(dict(self.options))


def read_vectors(spark: SparkSession, path: str, key: str | None = None, rows: int = ROWS) -> DataFrame:
    """(place, vector) of a file, place from 0 in its order."""
    spark.dataSource.register(VectorCache)
    reader = spark.read.format("vector_cache").option("rows", rows)
    return (reader if key is None else reader.option("key", key)).load(path)


def write_vectors(vectors: np.ndarray, path: str, key: str, order: str = "little") -> None:
    """A file of a matrix, put in place whole: readers never see a part of it."""
    new = f"{path}.new"
    with open(new, "wb") as f:
        f.write(json.dumps({"key": key, "dims": vectors.shape[1], "n": len(vectors), "order": order}).encode() + b"\n")
        f.write(np.ascontiguousarray(vectors, ORDERS[order]).tobytes())
    os.replace(new, path)
