"""What filters remove in every order, from a sparse document-term matrix.

Words are the runs of bytes other than ASCII white space; case counts.  The
matrix has a row per document and a column per distinct word of the whole
table, kept as shards in compressed sparse row form: ``indptr`` (where each row
begins), ``indices`` (column numbers) and ``data`` (how often).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from urlrisk.llm.common import drop_shared, map_arrow, shared_path
from urlrisk.llm.periods import split_words

#: A shard is closed at so many words; a longer text is a shard of its own.
SHARD_WORDS = 1 << 20
#: Longer words stand in the dictionary as a blank and their digest; no word holds a blank.
_LONG = 64
_CAPITALS = bytes(range(0x41, 0x5B))
_INNER = bytes(range(0x80, 0xC0))     # bytes of UTF-8 that begin no code point
_SIGNS = b"#$%&*|"


def _entry(word: bytes) -> bytes:
    return word if len(word) <= _LONG else b" " + hashlib.sha256(word).digest()


class _Numbers(dict):
    """Numbers from 0 in the order in which keys are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


class _Shard:
    """Rows in compressed sparse form over a dictionary of their own."""

    def __init__(self):
        self.local = _Numbers()
        self.columns: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.words = 0

    def add(self, words: list[bytes]) -> None:
        counts = Counter(words)
        self.columns.append(np.fromiter(map(self.local.__getitem__, counts), np.int32, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.words += len(words)

    def close(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(indptr, indices, data, dictionary); columns are numbered in the order in which the dictionary lists words by bucket."""
        entries = [_entry(w) for w in self.local]
        bucket = np.fromiter(map(zlib.crc32, entries), np.uint32, len(entries)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        used, starts = np.unique(bucket[order], return_index=True)
        words = pa.ListArray.from_arrays(pa.array([*starts, len(order)], pa.int32()), pa.array(entries, pa.binary()).take(pa.array(order)))
        dictionary = pa.StructArray.from_arrays([pa.array(used, pa.int32()), words], ["bucket", "words"])
        indptr = np.zeros(len(self.columns) + 1, np.int32)
        np.cumsum([len(c) for c in self.columns], out=indptr[1:])
        return indptr, place[np.concatenate(self.columns)], np.concatenate(self.counts), dictionary


def _buffer(values: np.ndarray, kind: str) -> bytes:
    return values.astype(kind).tobytes()


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers from 0 at 1, 2 or 4 bytes each, as the greatest needs; the length of the row tells which."""
    most = int(values.max(initial=0))
    return _buffer(values, "<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<i4")


def _wide(buffer: bytes, entries: int) -> np.ndarray:
    return np.frombuffer(buffer, f"<u{len(buffer) // entries}" if entries else "<u1")


def _local_shards(docs: DataFrame, text: str, carry: StructType, facts: Callable | None, fact_types: list, buckets: int) -> DataFrame:
    """One row per shard: carried columns and facts as lists, the matrix over local columns, the dictionary by bucket."""
    names = carry.fieldNames() + [n for n, _ in fact_types]

    def run(batches):
        part, closed = TaskContext.get().partitionId(), 0
        shard, kept = _Shard(), []

        def flush():
            nonlocal closed, shard, kept
            indptr, indices, data, dictionary = shard.close(buckets)
            columns = [pa.concat_arrays([k[i] for k in kept]) for i in range(len(names))]
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            out = [pa.array([part << 33 | closed], pa.int64()), *map(one, columns)]
            out += [pa.array([b], pa.binary()) for b in (_buffer(indptr, "<i4"), _buffer(indices, "<i4"), _narrow(data))]
            closed, shard, kept = closed + 1, _Shard(), []
            return pa.RecordBatch.from_arrays([*out, one(dictionary)], ["_shard", *names, "indptr", "indices", "data", "_dictionary"])

        for batch in batches:
            start, found = 0, []
            carried = [batch.column(i) for i in range(len(carry))]
            for at, value in enumerate(batch.column(len(carry))):
                data = value.as_py() or b""
                shard.add(split_words(data))
                found.append(facts(data) if facts else ())
                if shard.words >= SHARD_WORDS or at + 1 == batch.num_rows:
                    fact_columns = [pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(fact_types)]
                    kept.append([c.slice(start, at + 1 - start) for c in carried] + fact_columns)
                    start, found = at + 1, []
                    if shard.words >= SHARD_WORDS:
                        yield flush()
        if kept:
            yield flush()

    sql = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
    fields = [f"`{f.name}` array<{f.dataType.simpleString()}>" for f in carry] + [f"`{n}` array<{sql[t]}>" for n, t in fact_types]
    schema = ", ".join(["_shard bigint", *fields, "indptr binary, indices binary, data binary",
                        "_dictionary array<struct<bucket:int,words:array<binary>>>"])
    return docs.select(*carry.fieldNames(), F.col(text).cast("binary")).mapInArrow(run, schema)


def _columns(local: DataFrame, buckets: int) -> DataFrame:
    """(_shard, _columns): the global number of every local column.

    Words meet by bucket, once per shard, however frequent they are.  Shards come
    in order, so a word's rank in its bucket is the same in every attempt; the number
    is that rank times the number of buckets, plus the bucket, and no count has
    to be known beforehand.  A task holds the dictionary of one bucket.
    """
    words = (local.select("_shard", F.explode("_dictionary").alias("d")).select("_shard", "d.bucket", "d.words")
             .repartition(F.col("bucket")).sortWithinPartitions("bucket", "_shard"))

    def number(batches):
        current, known = None, _Numbers()
        for batch in batches:
            for shard, bucket, entries in zip(*(batch.column(i) for i in range(3)), strict=True):
                if bucket.as_py() != current:
                    current, known = bucket.as_py(), _Numbers()
                entries = entries.as_py()
                ranks = np.fromiter(map(known.__getitem__, entries), np.int32, len(entries))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()]), pa.array([current], pa.int32()), pa.array([_buffer(ranks, "<i4")])],
                    ["_shard", "bucket", "ranks"])

    numbered = words.mapInArrow(number, "_shard bigint, bucket int, ranks binary")
    return numbered.groupBy("_shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "ranks"))).alias("_columns"))


def matrix(docs: DataFrame, text: str = "text", carry: list[str] = (), facts: Callable | None = None,
           fact_types: list = ()) -> tuple[DataFrame, Callable[[], None]]:
    """(the shards of the document-term matrix, a function that deletes what they are read from).

    A shard has its rows' ``carry`` columns and ``facts`` of the bytes of each
    text as lists, and three little-endian buffers: ``indptr`` (32 bits), global
    ``indices`` (64 bits) and ``data`` (32 bits).  A row's columns are distinct.
    A null text is an empty row, and so is one of white space; an empty table has no
    shards.  The texts are read once, and the words of a shard pass the dictionary
    once each; the rows stay where they are until their shard meets its columns.
    """
    spark = docs.sparkSession
    # More buckets than tasks, so that the dictionary of one is small.
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "shards")
    _local_shards(docs, text, docs.select(*carry).schema, facts, list(fact_types), buckets).write.option("compression", "zstd").parquet(path)
    local = spark.read.parquet(path)
    rows = local.drop("_dictionary").join(_columns(local, buckets), "_shard", "left")
    names = [c for c in rows.columns if c != "_columns"]

    def to_global(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, out = names.index("indices"), []
        for indices, columns in zip(batch.column(at), batch.column(len(names)), strict=True):
            numbers = np.concatenate([np.empty(0, np.int64)] + [
                np.frombuffer(x["ranks"], "<i4").astype(np.int64) * buckets + x["bucket"] for x in columns.as_py() or ()])
            out.append(_buffer(numbers[np.frombuffer(indices.as_py(), "<i4")], "<i8"))
        columns = [pa.array(out, pa.binary()) if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return map_arrow(rows.select(*names, "_columns"), to_global, schema), lambda: drop_shared(spark, path)


def rows_of(indptr: bytes, indices: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buffers of a shard as arrays."""
    columns = np.frombuffer(indices, "<i8")
    return np.frombuffer(indptr, "<i4"), columns, _wide(data, len(columns))


def row_statistics(shards: DataFrame, carried: list[str]) -> DataFrame:
    """(carried columns, n_words, n_distinct) per row of the matrix: its sum and its number of nonzero entries."""
    fields = [shards.schema[c].dataType.elementType for c in carried]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, nonzero = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for buffers in zip(*(batch.column(len(carried) + i) for i in range(3)), strict=True):
            indptr, _, data = rows_of(*(b.as_py() for b in buffers))
            for totals, values in ((sums, data), (nonzero, data != 0)):
                total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
                totals.append(total[indptr[1:]] - total[indptr[:-1]])
        return pa.RecordBatch.from_arrays(
            [batch.column(i).flatten() for i in range(len(carried))] + [pa.array(np.concatenate(x)) for x in (sums, nonzero)],
            [*carried, "n_words", "n_distinct"])

    kinds = ", ".join(f"`{c}` {t.simpleString()}" for c, t in zip(carried, fields, strict=True))
    return map_arrow(shards.select(*carried, "indptr", "indices", "data"), rows, f"{kinds}, n_words bigint, n_distinct bigint")


def _facts(data: bytes) -> tuple[bytes, int, int, bool]:
    """(digest, capitals, code points, holds a sign) of a text."""
    return (hashlib.sha256(data).digest(), len(data) - len(data.translate(None, _CAPITALS)),
            len(data.translate(None, _INNER)), len(data.translate(None, _SIGNS)) < len(data))


_FACT_TYPES = [("_digest", pa.binary()), ("_capitals", pa.int64()), ("_points", pa.int64()), ("_signs", pa.bool_())]


def flags(docs: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> tuple[DataFrame, Callable[[], None]]:
    """((_key, _part, _digest, _mask) per row, a function that deletes what it is read from).

    ``_mask`` has bit 0 for filter A (under 100 words), 1 for B (under 80 in
    100 words are distinct), 2 for C (over 10 in 100 code points are A-Z) and 3
    for D (a sign of ``#$%&*|``).
    """
    named = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(part), F.lit("")).alias("_part"), F.col(text).alias("_text"))
    shards, drop = matrix(named, "_text", ["_key", "_part"], _facts, _FACT_TYPES)
    rows = row_statistics(shards, ["_key", "_part", "_digest", "_capitals", "_points", "_signs"])
    bits = [F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"),
            100 * F.col("_capitals") > 10 * F.col("_points"), F.col("_signs")]
    mask = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    return rows.select("_key", "_part", "_digest", mask.alias("_mask")), drop


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """What each of the filters A to E does at each step of each order, per part; see ``order_table``.

    E fails a text that a row with a smaller key has as well, anywhere in the
    table; null texts are empty ones, null parts are the part ''.  A row with a
    null key never fails E, makes no other fail it, and has no labels.  A row is
    good or toxic if any label row of its key says so.  Repeated rows count each;
    an empty table gives an empty table; other columns are not read.

    Rows are counted by (key, text, part, flags) before any join, and the first
    key of a text comes from an aggregation and is met on key and digest
    together, so neither a group of copies nor a repeated key fills a task.
    """
    spark = docs.sparkSession
    flagged, drop = flags(docs, key, part, text)
    path = shared_path(spark, "flags")
    flagged.groupBy("_key", "_part", "_digest", "_mask").agg(F.count("*").alias("_n")).write.parquet(path)
    drop()
    rows = spark.read.parquet(path)
    firsts = rows.groupBy("_digest").agg(F.min("_key").alias("_key")).withColumn("_first", F.lit(True))
    marks = (labels.groupBy(F.col(key).alias("_key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic")))
    fails = F.col("_key").isNotNull() & F.col("_first").isNull()
    counted = (rows.join(firsts, ["_key", "_digest"], "left").join(marks, "_key", "left")
               .withColumn("_mask", F.col("_mask") + F.when(fails, 16).otherwise(0))
               .groupBy("_part", "_mask").agg(
                   F.sum("_n").alias("n"), F.sum(F.when(F.col("_good") == 1, F.col("_n")).otherwise(0)).alias("good"),
                   F.sum(F.when(F.col("_toxic") == 1, F.col("_n")).otherwise(0)).alias("toxic")))
    return order_table(counted)


def order_table(counted: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from counts by mask.

    ``counted`` has (_part, _mask, n, good, toxic) with bit i of the mask for
    the i-th filter.  A part becomes one row with an entry per mask, and that
    row becomes one row per order and step; nothing else is multiplied.
    """
    many = 1 << len(filters)
    by_mask = F.map_from_entries(F.collect_list(F.struct("_mask", F.struct("n", "good", "toxic"))))
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    steps = (counted.groupBy("_part").agg(by_mask.alias("_by"))
             .select("_part", "_by", F.explode(orders).alias("filter_order"))
             .select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")))

    letter = "shiftleft(1, locate(substring(filter_order, {}, 1), '" + filters + "') - 1)"
    before = f"aggregate(filter(sequence(1, {len(filters)}), i -> i < step), 0, (a, i) -> a | {letter.format('i')})"
    rows = steps.withColumn("_bit", F.expr(letter.format("step"))).withColumn("_before", F.expr(before))

    def total(what: str, when: str) -> Column:
        value = f"coalesce(element_at(_by, m).{what}, 0L)"
        return F.expr(f"aggregate(filter(sequence(0, {many - 1}), m -> {when}), 0L, (a, m) -> a + {value})")

    lost = "m & _bit != 0 AND m & _before = 0"
    # In how many orders the filter comes first of those that a row fails: an equal share of all orders.
    share = f"coalesce(element_at(_by, m).n, 0L) * {math.factorial(len(filters))} div bit_count(m)"
    shapley = f"aggregate(filter(sequence(0, {many - 1}), m -> m & _bit != 0), 0L, (a, m) -> a + {share})"
    return rows.select(
        F.col("_part").alias("part"), "filter_order", "step",
        total("n", "m & (_bit | _before) = 0").alias("kept"), total("n", lost).alias("removed"),
        total("n", "m & _bit != 0 AND m & _before != 0").alias("redundant"), total("n", "m = _bit").alias("unique_fails"),
        total("good", lost).alias("good_lost"), total("toxic", lost).alias("toxic_lost"),
        F.expr(shapley).alias("shapley"))
