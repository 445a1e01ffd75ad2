"""What the operators of this package share: scratch tables, whole-text words, tokenizer files."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Bytes of a lower-cased text that are no part of a word: ASCII other than 0-9 and a-z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text whose A-Z are lower-cased, as UTF-8. Null has none."""
    return text.encode("utf-8", "replace").translate(_WORD_BYTES).split() if text else []


def words_column(text: Column) -> Column:
    """The same words with built-in functions."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


#: The temporary folder of a local session that names none.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names in spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local session; a cluster must name one,
    as executors and driver share no local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="lectern-")
        _LOCAL[spark.sparkContext.applicationId] = base
    return f"{base.rstrip('/')}/{re.sub(r'\W', '_', name)}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written to a scratch table and read again: later steps depend on no executor's disk."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    for made in _MADE:
        made.append(out)
    return out


_MADE: list[list[DataFrame]] = []


def alone(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() cuts, after the other scratch tables that it made on the way are deleted."""
    _MADE.append([])
    try:
        out = make()
    finally:
        made = _MADE.pop()
    drop(*(df for df in made if df is not out))
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() gave, once nothing that is still to run reads them."""
    for df in tables:
        drop_scratch(df.sparkSession, df._scratch)


#: Keys with a 500th of all rows are hot; so there are at most 500.
HOT = 500
HOT_LEAST = 256


def hot_keys(rows: DataFrame, on: str, counts: DataFrame | None = None) -> DataFrame | None:
    """The hot keys of rows, at most HOT of them, as a table of this one column; None, if there are none. counts: (on, n), if known."""
    total = rows.count()
    if total < HOT_LEAST:
        return None
    counts = rows.groupBy(on).agg(F.count("*").alias("n")) if counts is None else counts
    few = counts.filter((F.col("n") >= HOT_LEAST) & (F.col("n") * HOT >= total)).select(on).collect()
    return rows.sparkSession.createDataFrame(few, rows.select(on).schema) if few else None


def hot_join(rows: DataFrame, one: DataFrame, on: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with `one`, which has a row of bounded size for each key: hot keys by broadcast, as they are few by
    arithmetic, so that none of them meets in a task; the others by a shuffle. rows is read twice, if any key is hot."""
    if hot is None:
        return rows.join(one, on)
    few = F.broadcast(hot)
    often = rows.join(F.broadcast(one.join(few, on, "left_semi")), on)
    seldom = rows.join(few, on, "left_anti").join(one.join(few, on, "left_anti"), on)
    return often.unionByName(seldom)


#: Rows of text in an Arrow batch between the JVM and Python, and about its bytes, unless one row has more.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Has the session send at most BATCH_ROWS rows and about BATCH_BYTES to Python at once: texts are long, and both sides
    hold a batch whole."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        known = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if not known or not 0 < int(known[1]) <= most:
            spark.conf.set(name, str(most))


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch() gave."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text, modulo 3, is 1. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sampled(df: DataFrame, key: Column, count: int, bound: int, seed: int) -> DataFrame:
    """About `bound` of the `count` rows of df, chosen by a hash of key; all, if there are no more."""
    if count <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(bound / count * (1 << 30)))


def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Start of each list in their concatenation, with its end as a last entry, and the lengths."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    starts = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(lengths, out=starts[1:])
    return starts, lengths


def runs(lengths: list[int], most: int) -> Iterator[slice]:
    """Slices of lists that lie together, so that each slice has about `most` entries, unless one list has more."""
    block, begin = np.cumsum(lengths) // most, 0
    while begin < len(lengths):
        end = int(np.searchsorted(block, block[begin], side="right"))
        yield slice(begin, end)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], T]) -> T:
    """Something that a worker process keeps from task to task, until it is asked for something else.

    Workers outlive queries: without this, what each operator remembers would add up in them.
    """
    if name not in _HELD:
        _HELD.clear()
        trim(0)
        _HELD[name] = make()
    return _HELD[name]


_TRIMMED = [0.0]


def trim(every: float = 3.0) -> None:
    """Gives freed memory back to the system, where the C library can, if that was last done so many seconds ago."""
    import pyarrow as pa

    if time.monotonic() - _TRIMMED[0] < every:
        return
    _TRIMMED[0] = time.monotonic()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files lie on this machine."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


#: Bits of a broadcast presence filter: 16 MB whatever the corpus.
PRESENCE_BITS = 27


def presence(hashes: DataFrame) -> np.ndarray:
    """A filter of fixed size with the places of all hashes (one long column h): no misses, some false hits.

    At most 2**15 pages of at most 4096 places stream through the driver.
    """
    places = (
        hashes.select(F.shiftrightunsigned("h", 64 - PRESENCE_BITS).cast("int").alias("p"))
        .groupBy(F.shiftright("p", 12).alias("page"))
        .agg(F.collect_set(F.col("p").bitwiseAND(4095).cast("short")).alias("low"))
    )
    bits = np.zeros(1 << (PRESENCE_BITS - 3), np.uint8)
    for row in places.toLocalIterator():
        p = row["page"] * 4096 + np.array(row["low"], np.int64)
        np.bitwise_or.at(bits, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return bits


def present(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the signed 64-bit hashes may be in the filter."""
    p = (h.astype(np.int64).view(np.uint64) >> np.uint64(64 - PRESENCE_BITS)).astype(np.int64)
    return ((bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches of rows that lie sorted by keys, joined so that no group spans two; with each group's start and the end."""
    held: list[pd.DataFrame] = []

    def starts(frame: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(frame), bool)
        new[0] = True
        for k in keys:
            v = frame[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        frame = pd.concat([*held, batch], ignore_index=True) if held else batch.reset_index(drop=True)
        at = starts(frame)
        held = [frame.iloc[at[-1] :]]
        if len(at) > 1:
            yield frame.iloc[: at[-1]], at
    if held:
        frame = held[0].reset_index(drop=True)
        yield frame, np.append(starts(frame), len(frame))
