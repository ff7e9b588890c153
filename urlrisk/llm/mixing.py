"""Mixing sources to target weights: whole copies of documents by pivotal dependent rounding.

A document of a source that is to give a share p of its words is taken
floor(p) times, and once more with probability p - floor(p).  The pivotal
method decides these fractional copies dependently: two documents meet, words of
copy mass move from one to the other until one of the two is whole, and the
other goes on to the next meeting.  The direction is random with the odds that
keep each document's expectation, and as mass only moves, the words of the
source do not drift from its target.

Documents of a source meet in leaves of about ``LEAF`` documents; each leaf
leaves at most one document undecided, and those meet in the next level of the
reduction tree.  The last undecided document of a source is taken in part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlrisk.llm.common import map_arrow, materialize

#: Weights of the sources in order, repeating, and the share of all words that the mix takes.
WEIGHTS, SHARE = (5, 2, 1), 1.5
#: No document is taken more often than this.
MOST = 2.0
#: Documents that meet in one task of the reduction tree.
LEAF = 4096
_EPS = 1e-9
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_count(data: bytes | None) -> int:
    """Number of runs of bytes other than ASCII white space; memory is a byte per byte of the text."""
    if not data:
        return 0
    white = _WHITE[np.frombuffer(data, np.uint8)]
    return int(not white[0]) + int(np.count_nonzero(white[:-1] & ~white[1:]))


def sizes(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, size): words of every whole text, 0 for a null one."""
    fields = docs.select(key, source).schema
    kinds = [f.dataType.simpleString() for f in fields]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [word_count(v.as_py()) for v in batch.column(2)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["_key", "_source", "size"])

    return map_arrow(docs.select(key, source, F.col(text).cast("binary")), rows,
                     f"_key {kinds[0]}, _source {kinds[1]}, size bigint")


def ordered(sources: DataFrame, column: str, name: str = "source_no") -> DataFrame:
    """``sources`` with their number from 0 in the order of ``column``, null last.

    Ranges are numbered apart and shifted by the rows of the ranges before, so
    no task sees all of them; the driver gets one count per range.
    """
    last = F.col(column).isNull()
    ranged = materialize(
        sources.repartitionByRange(last, column).sortWithinPartitions(last, column)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_id")), "sources")
    shift, before = {}, 0
    for part, first, count in ranged.groupBy("_range").agg(F.min("_id"), F.count("*")).sort("_range").collect():
        shift[part] = before - first
        before += count
    if not shift:
        return ranged.select(*sources.columns, F.lit(0).cast("bigint").alias(name))
    move = F.create_map(*(F.lit(v) for pair in shift.items() for v in pair))
    return ranged.select(*sources.columns, (F.col("_id") + move[F.col("_range")]).cast("bigint").alias(name))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source_no, size, ...) with ``target``: words that each source gives.

    ``share`` of all words is dealt by weight; a source stops at ``most`` times
    its words and the excess is dealt again by weight among the others, until
    none is above.  One aggregation per round; what has stopped stays stopped.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights)).cast("int")).cast("double")
    sources = materialize(sources.withColumn("_weight", weight), "weighted")
    whole = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level, stopped = 0.0, -1
    while True:
        over = most * F.col("size") <= level * F.col("_weight")
        held, still, count = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)), F.count(F.when(over, 1))).first()
        if count == stopped or not still:
            break
        stopped, level = count, max((share * whole - most * held) / still, level)
    target = F.least(most * F.col("size"), level * F.col("_weight"))
    return sources.withColumn("target", F.greatest(target, F.lit(0.0))).drop("_weight")


def meet(sizes: np.ndarray, shares: np.ndarray, chances: np.ndarray) -> tuple[np.ndarray, int]:
    """Pivotal rounding of one leaf: the shares after all meetings, and the place that stays undecided or -1.

    Shares are in (0, 1), sizes above 0.  The sum of sizes times shares stays,
    and so does each share's expectation over the chances.
    """
    out, one = shares.astype(float), -1
    for two in range(len(out)):
        if one < 0:
            one = two
            continue
        s, t, x, y = float(sizes[one]), float(sizes[two]), out[one], out[two]
        gain, loss = min(s * (1 - x), t * y), min(s * x, t * (1 - y))
        up = chances[two] * (gain + loss) < loss
        if up:
            full = s * (1 - x) <= t * y
            x, y = (1.0, y - gain / t) if full else (x + gain / s, 0.0)
        else:
            full = s * x <= t * (1 - y)
            x, y = (0.0, y + loss / t) if full else (x - loss / s, 1.0)
        x, y = (round(v) if abs(v - round(v)) < _EPS else v for v in (x, y))
        out[one], out[two] = x, y
        one = one if 0 < x < 1 else two if 0 < y < 1 else -1
    return out, one


def mix(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """(_key, _source, size, source_size, target, copies, taken) for every row of ``sizes``.

    ``copies`` counts whole copies; ``taken`` is their words, and for the one
    document of a source that stays undecided also the first words of a further
    copy, so that each source gives its target to the nearest word.  Reruns
    agree: leaves and chances come from the rows alone, not from partitions.
    Equal rows are decided together, by number, so one repeated row fills no
    task.  A null source is a source of its own, the last; empty texts and
    sources are taken 0 times; an empty table gives an empty table.
    """
    columns = sized.columns
    sized = materialize(sized, "sizes")
    sources = sized.groupBy("_source").agg(F.sum("size").alias("size"), F.count("*").alias("_rows"))
    dealt = materialize(
        targets(ordered(sources, "_source"), weights, share, most)
        .select("_source", "source_no", F.col("size").alias("source_size"), "target",
                F.ceil(F.col("_rows") / LEAF).cast("bigint").alias("_leaves")), "targets")
    same = sized.groupBy(*columns).agg(F.count("*").alias("_n")).alias("a")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0)
    # A share this near a whole number is one: it stems from the division.
    rate = F.when(F.abs(rate - F.round(rate)) < _EPS, F.round(rate)).otherwise(rate)
    rows = (same.join(dealt.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
            .withColumn("_rate", rate).withColumn("_base", F.floor("_rate").cast("bigint"))
            .withColumn("_share", F.when(F.col("size") > 0, F.col("_n") * (F.col("_rate") - F.col("_base"))).otherwise(0.0)))
    near = F.abs(F.col("_share") - F.round("_share")) < _EPS * F.col("_n")
    rows = (rows.withColumn("_share", F.when(near, F.round("_share")).otherwise(F.col("_share")))
            .withColumn("_sure", F.floor("_share").cast("bigint")).withColumn("_share", F.col("_share") - F.col("_sure"))
            .withColumn("_leaf", F.when(F.col("_share") > 0, F.pmod(F.xxhash64("_key", "size", F.lit(seed)), F.col("_leaves"))))
            .drop("_rate"))
    start = materialize(rows, "shares")
    most_leaves = start.agg(F.max("_leaves")).first()[0] or 0
    decided, open_rows, level = [start.where("_leaf IS NULL")], start.where("_leaf IS NOT NULL"), 0
    while True:
        met = materialize(_level(open_rows, level, seed), f"level-{level}")
        undecided = (F.col("_share") > 0) & (F.col("_share") < 1)
        if most_leaves <= 1:
            decided.append(met)
            break
        decided.append(met.where(~undecided))
        open_rows = met.where(undecided).withColumn("_leaf", F.floor(F.col("_leaf") / LEAF).cast("bigint"))
        level, most_leaves = level + 1, -(-most_leaves // LEAF)
    everything = decided[0]
    for part in decided[1:]:
        everything = everything.unionByName(part)
    number = F.explode(F.expr("sequence(1L, _n)")).alias("_i")
    extra = F.when(F.col("_i") <= F.col("_sure"), 1.0).when(F.col("_i") == F.col("_sure") + 1, F.col("_share")).otherwise(0.0)
    return (everything.select("*", number).withColumn("_extra", extra).select(
        "_key", "_source", "size", "source_size", "target",
        (F.col("_base") + F.floor("_extra").cast("bigint")).alias("copies"),
        (F.col("_base") * F.col("size") + F.round(F.col("_extra") * F.col("size")).cast("bigint")).alias("taken")))


def _level(open_rows: DataFrame, level: int, seed: int) -> DataFrame:
    """One level of the reduction tree: the rows of each leaf meet, largest first, so that what stays undecided is small."""
    schema = open_rows.schema

    def leaf(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("_n", "ascending"), ("_key", "ascending")])
        random = np.random.default_rng([seed, level, key[0].as_py(), key[1].as_py()])
        shares, _ = meet(table.column("size").to_numpy(), table.column("_share").to_numpy(), random.random(table.num_rows))
        return table.set_column(table.schema.get_field_index("_share"), "_share", pa.array(shares))

    return open_rows.groupBy("source_no", "_leaf").applyInArrow(leaf, schema)


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``mix`` over the documents: (key, size, source_size, target, taken, copies)."""
    return mix(sizes(docs, key, source, text), **options).select(
        F.col("_key").alias(key), "size", "source_size", "target", "taken", "copies")
