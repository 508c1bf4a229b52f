"""Shared pieces: Arrow batch helpers and stable hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than that (small single files)."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def items(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """corpus_items with replayed rows as they are; operators count an id once."""
    return table(spark, sf, "corpus_items").select("id", *cols).where("id IS NOT NULL")


def key128(s: str) -> bytes:
    return hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def per_batch(fn: Callable[[pd.DataFrame], pd.DataFrame | None]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and (out := fn(b)) is not None and len(out):
                yield out

    return run


def sample_rows(df: DataFrame, key: str, n: int) -> list:
    """At most ``n`` rows with different keys, the same ones at every run: those with the smallest hash of their key.

    Keys first: hashes alone are cut to about ``4 * n`` and ordered, which gives
    the largest hash that belongs to the sample; only rows up to it are fetched.
    """
    h = F.xxhash64(F.col(key).cast("string"))
    rows = df.where(F.col(key).isNotNull())
    hashes = rows.select(h.alias("h"))
    share = hashes.count() // (4 * n)
    top = None
    if share > 1:
        got = hashes.where(F.pmod("h", F.lit(share)) == 0).distinct().orderBy("h").limit(n).agg(F.count("*").alias("c"), F.max("h").alias("m")).first()
        if got["c"] == n:
            top, rows = got["m"], rows.where(F.pmod(h, F.lit(share)) == 0)
    if top is None:
        top = hashes.distinct().orderBy("h").limit(n).agg(F.max("h").alias("m")).first()["m"]
    if top is None:
        return []
    picked = rows.where(h <= F.lit(top)).dropDuplicates([key])
    return sorted(picked.collect(), key=lambda r: str(r[key]))[:n]


def listed(test: Callable[[str], object], start: int = 0) -> str:
    """The characters from ``start`` to U+FFFF that pass a test, as ranges of a character class, which are looked up at once."""
    out: list[list[int]] = []
    for c in range(start, 0x10000):
        if test(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out)


def within_listed(s: str) -> bool:
    """Whether all characters are among those :func:`listed` looks at."""
    return s.isascii() or len(s.encode("utf-16-le", "surrogatepass")) == 2 * len(s)


def utf8(s: object) -> str:
    return s if isinstance(s, str) else ""


def as_int32(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.uint32)
