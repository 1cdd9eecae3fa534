"""Round trips of the binary file of vectors, by any ranges and either byte order, and what is refused."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

from lodestar.sources.vector_cache import read_vectors, write_vectors


@pytest.mark.parametrize("order", ["little", "big"])
def test_round_trip(spark: SparkSession, tmp_path: Path, order: str) -> None:
    x = np.random.default_rng(1).normal(size=(103, 7)).astype(np.float32)
    x[3, 2], x[4, 1] = np.inf, -0.0
    path = str(tmp_path / "v.bin")
    write_vectors(x, path, "k1", order)
    got = read_vectors(spark, path, "k1", rows=10)
    assert got.rdd.getNumPartitions() == 11
    rows = got.orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(103)) and (np.array([r["vector"] for r in rows], np.float32) == x).all()
    assert read_vectors(spark, path).where("place = 50").first()["vector"] == x[50].tolist()


def test_what_is_refused(spark: SparkSession, tmp_path: Path) -> None:
    path = tmp_path / "v.bin"
    write_vectors(np.ones((5, 3)), str(path), "k1")
    with pytest.raises(Exception, match="has the key k1, not k2"):
        read_vectors(spark, str(path), "k2").count()
    whole = path.read_bytes()
    path.write_bytes(whole[:-4])
    with pytest.raises(Exception, match="bytes, not"):
        read_vectors(spark, str(path)).count()
    path.write_bytes(b"no header\n" + whole)
    with pytest.raises(Exception, match="isn't a file of vectors"):
        read_vectors(spark, str(path)).count()
    write_vectors(np.ones((0, 3)), str(path), "k1")
    assert read_vectors(spark, str(path)).count() == 0
