"""Words, hashes and connected components shared by the text operators.

Words are the runs of bytes other than ASCII white space in the UTF-8 text,
with A-Z lower-cased; ``bytes.split`` and ``bytes.lower`` mean exactly that.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.session import drop_shared, materialize, shared_path

#: Memos of one Python worker start again beyond this many entries, which bounds their memory.
MEMO_ENTRIES = 250_000
_PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_lists(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in lists of about a megabyte, so that a huge text never becomes one list."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    start = 0
    while start < len(data):
        end = len(data)
        if end - start > _PIECE:
            cut = _SPACE.search(data, start + _PIECE)
            end = cut.start() if cut else end
        yield data[start:end].split()
        start = end


class Memo(dict):
    """A bounded memo of a function of one key.

    What was not asked for since the last two fillings goes; strings of more than
    64 characters are not kept.
    """

    def __init__(self, function: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.function, self.entries, self.old = function, entries, {}

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if not isinstance(key, (str, bytes)) or len(key) <= 64:
            self[key] = value
        return value


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for every word of the text, in order."""
    parts = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in word_lists(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for every run of ``size`` words; a shorter text is one run, an empty one has none."""
    size = min(size, len(hashes))
    if not size:
        return hashes
    many = len(hashes) - size + 1
    out = np.full(many, size, np.uint64)
    for i in range(size):
        out = (out ^ hashes[i:i + many]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return _mix(out)


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow list per array, without a Python object for every element."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def list_rows(column: pa.Array) -> list[np.ndarray]:
    """The rows of an Arrow list column as arrays; nulls become empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = rows(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


#: Buckets of keys that are sent to all tasks; a bound on that table at any size of the input.
KEY_BUCKETS = 1 << 18


def apart(docs: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in ``keys``, rows whose key is not), without a shuffle of the documents.

    Keys are compared by bucket only, so the first part still needs a join; the
    second holds all rows with a null key.
    """
    bucket = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(KEY_BUCKETS))
    marked = docs.withColumn("_bucket", F.when(F.col(key).isNotNull(), bucket))
    buckets = F.broadcast(keys.where(F.col(key).isNotNull()).select(bucket.alias("_bucket")).distinct())
    return (marked.join(buckets, "_bucket", "left_semi").select(docs.columns),
            marked.join(buckets, "_bucket", "left_anti").select(docs.columns))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for all nodes of an edge table (a, b); component is the smallest node reachable.

    Large-star and small-star rounds on written tables.  Every round keeps at
    most as many rows as there are edges, a star's centre is found by an
    aggregation with partial sums, and long chains halve in each round.  The rounds
    end when every node has one edge to a centre that has none itself.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = shared_path(spark, name)
    both.write.parquet(path)
    while True:
        pairs = spark.read.parquet(path)
        ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(pairs.select("v", F.lit(0)))
        ups = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("many"))
        if ups.where("up > 1 OR up = 1 AND many > 1").isEmpty():
            break
        # Large star: every larger neighbour of u moves to the smallest node around u.
        near = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # Small star: u and all its smaller neighbours move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
                 .where("u <> v").distinct())
        after = shared_path(spark, name)
        small.write.parquet(after)
        drop_shared(spark, path)
        path = after
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


__all__ = ["Memo", "apart", "components", "drop_shared", "list_rows", "lists", "map_arrow", "materialize", "shared_path", "shingles", "word_hashes", "word_lists"]
