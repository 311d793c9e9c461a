"""What the corpus operators share: shared storage, shipping code, word hashing."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..storage import bucketed, dropped, saved, table_path  # noqa: F401  for the operators

_ROOT = Path(__file__).resolve().parents[2]
_SHIPPED: set[str] = set()


def shipped(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path has it not."""
    known = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    app = spark.sparkContext.applicationId
    if _ROOT in known or app in _SHIPPED:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="linemill-"), "linemill_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in (_ROOT / "linemill").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _sliced(fn, rows: int):
    """fn over record batches of so many rows at most."""
    return lambda batches: fn(b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows))


def mapped(df: DataFrame, fn, schema, batch: int = 2000) -> DataFrame:
    """mapInArrow with batches of so many rows at most; Spark bounds their bytes. No setting of the session changes.

    Where names of df hold dots, which mapInArrow cannot find, fn sees others in their place; schema is then a StructType.
    """
    shipped(df.sparkSession)
    fn = _sliced(fn, batch)
    if not any(c in name for name in df.columns for c in ".`"):
        return df.mapInArrow(fn, schema)
    plain = {name: f"c{i}" for i, name in enumerate(df.columns)}
    inner = StructType([StructField(plain.get(f.name, f.name), f.dataType) for f in schema.fields])
    return df.toDF(*plain.values()).mapInArrow(fn, inner).toDF(*schema.names)


def hidden(df: DataFrame, name: str) -> str:
    """A column name that df has not, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def all_of(df: DataFrame, *without: str) -> list[Column]:
    """All columns of df, whatever their names hold."""
    return [F.col(quoted(c)) for c in df.columns if c not in without]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def blank(text: str = "text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


class WordHashes(dict):
    """word (bytes) -> its 64-bit hash (8 bytes). Emptied when it holds `limit` words, so its memory is bounded."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """A cache that lives as long as the worker process, or until only() empties it."""
    _KEPT.append(cache)
    return cache


def only(*own: dict) -> None:
    """Empties all kept() caches but these. Workers go from stage to stage, and with the caches of all stages they outgrow their executor."""
    for cache in _KEPT:
        if not any(cache is c for c in own):
            cache.clear()


HASHES = kept(WordHashes())


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.lower().split()


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(31))
    x = x * _K2
    x = x ^ (x >> np.uint64(29))
    x = x * _K1
    return x ^ (x >> np.uint64(32))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; one of the whole if there are fewer, none if there are no words."""
    if not len(h):
        return h
    n = min(n, len(h))
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out *= _K1
        out ^= out >> np.uint64(33)
        out += h[i : len(h) - n + 1 + i]
    return mixed(out + np.uint64(n))
