"""Nearest neighbours by inner product, from low-dimensional stable projections.

Vectors are lengthened by one component to one common norm, so that the largest
inner product is the smallest distance, and projected with Gaussian (2-stable)
numbers: the squared projected distance over the squared distance follows a
chi-square law with as many degrees of freedom as the projection has dimensions.
A kd-tree over the projections deals the vectors out to cells, and each task has
a kd-tree of its cell.  A query walks leaves by their projected distance and
verifies their vectors; it stops as soon as a vector nearer than its worst
neighbour would have been met already with the chance CERTAINTY.

Equal vectors are one point with a list of ids, so a vector that fills a third
of the table costs as much as any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urlrisk.llm.common import map_arrow, materialize

#: Dimensions of the projection (even), and the chance at which a query stops.
DIMENSIONS, CERTAINTY = 8, 0.98
#: Vectors of a cell about, of a leaf at most, and queries that meet a part of a cell in one task.
CELL_ROWS, LEAF_ROWS, QUERY_BLOCK = 4096, 32, 16_384
#: The most projections the cells are fitted on and the most cells; larger cells are cut into parts.
SAMPLE_ROWS, MOST_CELLS = 65_536, 4096
#: Leaves that are verified between two stopping tests.
_STEP = 4


def stopping_ratio(certainty: float = CERTAINTY, dimensions: int = DIMENSIONS) -> float:
    """The value below which a chi-square number with an even number of degrees of freedom lies with this chance."""
    half = dimensions // 2

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(half))

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < certainty else (low, middle)
    return high


def split(points: np.ndarray, rows: int, most: int = 1 << 30) -> list:
    """A kd-tree as nested (dimension, bound, left, right) with leaves of row numbers; widest dimension, median, ties left."""

    def grow(at: np.ndarray, leaves: int):
        if len(at) <= rows or leaves < 2:
            return at
        own = points[at]
        dimension = int(np.argmax(own.max(0) - own.min(0)))
        bound = float(np.partition(own[:, dimension], (len(at) - 1) // 2)[(len(at) - 1) // 2])
        left = own[:, dimension] <= bound
        if left.all():  # more than half lie on the upper edge
            left = own[:, dimension] < bound
            if not left.any():
                return at
            bound = float(own[left, dimension].max())
        return (dimension, bound, grow(at[left], leaves // 2), grow(at[~left], leaves // 2))

    return grow(np.arange(len(points)), most)


def leaves_of(tree) -> list[np.ndarray]:
    return [tree] if isinstance(tree, np.ndarray) else leaves_of(tree[2]) + leaves_of(tree[3])


def cells_of(tree, points: np.ndarray) -> np.ndarray:
    """The number of the cell (leaf from the left) that every point falls into."""
    out = np.zeros(len(points), np.int64)

    def walk(node, at: np.ndarray, first: int) -> int:
        if isinstance(node, np.ndarray):
            out[at] = first
            return first + 1
        left = points[at, node[0]] <= node[1]
        return walk(node[3], at[~left], walk(node[2], at[left], first))

    walk(tree, np.arange(len(points)), 0)
    return out


def _box_distance(query: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of one projected query from boxes."""
    return (np.maximum(np.maximum(low - query, query - high), 0.0) ** 2).sum(1)


class Part:
    """The vectors of one part of a cell under their kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaves = leaves_of(split(points, LEAF_ROWS))
        order = np.concatenate(leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.ends = np.cumsum([len(leaf) for leaf in leaves])
        self.begins = self.ends - [len(leaf) for leaf in leaves]
        self.low = np.array([points[leaf].min(0) for leaf in leaves])
        self.high = np.array([points[leaf].max(0) for leaf in leaves])

    def search(self, query: np.ndarray, point: np.ndarray, most: int, norm: float, worst: float, ratio: float):
        """(ids, inner products): the ``most`` best met before the stopping test holds.

        ``worst`` is a squared distance that the last neighbour is known not to exceed.
        """
        length = float(np.sqrt(query @ query))
        near = _box_distance(point, self.low, self.high)
        order = np.argsort(near, kind="stable")
        ids, found = np.empty(0, np.int64), np.empty(0)
        for begin in range(0, len(order), _STEP):
            if near[order[begin]] > ratio * worst:
                break
            leaves = order[begin:begin + _STEP]
            rows = np.concatenate([np.arange(self.begins[i], self.ends[i]) for i in leaves])
            # Plain sums, not a matrix product: a pair scores the same wherever it is met.
            ids, found = np.concatenate([ids, self.ids[rows]]), np.concatenate([found, (self.vectors[rows] * query).sum(1)])
            if len(ids) > most:
                best = np.lexsort((ids, -found))[:most]
                ids, found = ids[best], found[best]
            if len(ids) == most:
                worst = min(worst, max(0.0, 2 * norm * norm - 2 * norm / length * float(found.min())))
        return ids, found


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), size)


def _found(rows: list, name: str = "query") -> pa.Table:
    parts = list(zip(*rows, strict=True)) or [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    return pa.table([pa.array(np.concatenate(p)) for p in parts], names=[name, "point", "score"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest found of each row whose key is divisible by ``every``.

    Candidates are all rows but those with the query's own key; nearest first,
    ties to the smaller key; ``score`` is the inner product of the original
    vectors in double precision.  Rows with a null key, and vectors that are null,
    empty, zero or hold a null or non-finite component take no part; of vectors of
    several lengths those of the commonest (of equals, the shortest) do.  Rows
    that repeat key and vector count once.  Fewer candidates than ``k`` are all
    returned where the stopping test never holds.  An empty table gives an empty
    table; other columns are not read.
    """
    spark = vectors.sparkSession
    doubles = F.col(column).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = (vectors.select(F.col(key).cast("long").alias("id"), doubles.alias("vector"))
            .where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0)))
    # Adding 0.0 makes -0.0 and 0.0 equal as keys.
    good = good.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    sizes = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).first()
    schema = f"query_id bigint, rank int, `{key}` bigint, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    size = sizes["size"]
    good = good.where(F.size("vector") == size)

    # A result has at most k + 1 ids of one vector, so the smallest ones are enough.
    place = F.dense_rank().over(W.partitionBy("vector").orderBy("id"))
    points = (good.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector")
              .agg(F.sort_array(F.collect_set("id")).alias("ids")))
    points = materialize(points.select(F.monotonically_increasing_id().alias("point"), "ids", "vector"), "points")
    asked = (good.where(F.col("id") % every == 0).distinct().join(points.select("point", "vector"), "vector")
             .select(F.col("id").alias("query_id"), F.col("point").alias("query")))
    asked = materialize(asked, "asked")

    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    many, largest = points.agg(F.count("*"), F.max(squares)).first()
    norm, ratio = math.sqrt(largest), stopping_ratio()
    base = np.random.default_rng(7).standard_normal((size + 1, DIMENSIONS))

    def project(x: np.ndarray, as_query: bool) -> np.ndarray:
        own = (x * x).sum(1)
        if as_query:
            return (x * (norm / np.sqrt(own))[:, None]) @ base[:-1]
        return x @ base[:-1] + np.sqrt(np.maximum(norm * norm - own, 0.0))[:, None] * base[-1]

    def projected(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
        shadow = project(flat, False)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([row.tobytes() for row in np.ascontiguousarray(flat)], pa.binary()),
             pa.array([row.tobytes() for row in shadow], pa.binary())], ["point", "vector", "shadow"])

    shadows = materialize(map_arrow(points.select("point", "vector"), projected, "point bigint, vector binary, shadow binary"),
                          "shadows")
    # The cells are fitted on a bounded sample; all vectors are dealt out to them.
    share = 1.0 if many <= SAMPLE_ROWS else 0.9 * SAMPLE_ROWS / many
    chosen = shadows.where(F.pmod(F.xxhash64("point"), F.lit(1 << 30)) < int(share * (1 << 30))).select("shadow")
    sample = _vectors(chosen.limit(SAMPLE_ROWS).toArrow().column(0), DIMENSIONS)
    wanted = min(MOST_CELLS, max(1, 2 ** math.ceil(math.log2(max(1.0, many / CELL_ROWS)))))
    tree = split(sample, 1, wanted) if len(sample) else np.empty(0, np.int64)

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        shadow = _vectors(batch.column(2), DIMENSIONS)
        low = [pa.array(shadow[:, d]) for d in range(DIMENSIONS)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of(tree, shadow)), *low],
                                          ["point", "vector", "shadow", "cell", *(f"x{d}" for d in range(DIMENSIONS))])

    axes = ", ".join(f"x{d} double" for d in range(DIMENSIONS))
    index = materialize(map_arrow(shadows, dealt, f"point bigint, vector binary, shadow binary, cell bigint, {axes}"), "cells")
    boxes = index.groupBy("cell").agg(
        F.count("*").alias("n"), *(f(f"x{d}").alias(f"{name}{d}") for d in range(DIMENSIONS)
                                   for name, f in (("low", F.min), ("high", F.max)))).orderBy("cell").toArrow()
    numbers, counts = (boxes.column(c).to_numpy() for c in ("cell", "n"))
    low, high = (np.stack([boxes.column(f"{name}{d}").to_numpy() for d in range(DIMENSIONS)], 1) for name in ("low", "high"))
    parts = -(-counts // (2 * CELL_ROWS))
    parts_of = F.broadcast(spark.createDataFrame(list(zip(numbers.tolist(), parts.tolist(), strict=True)), "cell bigint, parts bigint"))

    queries = shadows.join(asked.select(F.col("query").alias("point")).distinct(), "point", "left_semi").select(
        F.col("point").alias("query"), "vector")
    queries = materialize(queries, "queries")
    blocks = -(-queries.count() // QUERY_BLOCK)
    block_of = F.pmod(F.xxhash64("query", F.lit(1)), F.lit(max(blocks, 1)))
    placed = index.join(parts_of, "cell").select(
        "cell", F.pmod(F.xxhash64("point"), F.col("parts")).alias("part"), "point", "vector", "shadow")
    placed = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks, 1) - 1).cast("long"))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            part = Part(left.column("point").to_numpy(), _vectors(left.column("vector"), size),
                        _vectors(left.column("shadow"), DIMENSIONS))
            asking = _vectors(right.column("vector"), size)
            for query, vector, point, worst in zip(right.column("query").to_pylist(), asking, project(asking, True),
                                                   right.column("worst").to_pylist(), strict=True):
                ids, scores = part.search(vector, point, k + 1, norm, worst, ratio)
                rows.append((np.full(len(ids), query, np.int64), ids, scores))
        return _found(rows)

    def run(where: DataFrame) -> DataFrame:
        keys = ["cell", "part", "block"]
        return placed.groupBy(*keys).cogroup(where.groupBy(*keys)).applyInArrow(search, "query bigint, point bigint, score double")

    def home(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The part of the cell nearest to each query."""
        shadow = project(_vectors(batch.column(1), size), True)
        at = np.array([int(np.argmin(_box_distance(s, low, high))) for s in shadow])
        ids = batch.column(0).to_numpy()
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(numbers[at]), pa.array(ids % parts[at]), pa.array(np.full(len(ids), np.inf))],
            ["query", "vector", "cell", "part", "worst"])

    routed = "query bigint, vector binary, cell bigint, part bigint, worst double"
    first = materialize(run(map_arrow(queries, home, routed).withColumn("block", block_of)), "first")
    # The last neighbour of the first part bounds the distance for all others.
    bounds = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    bounds = bounds.select("query", F.when(F.col("n") > k, F.col("least")).alias("least"))

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        """All parts but the first that the stopping test does not rule out."""
        vectors = _vectors(batch.column(1), size)
        rows: list = []
        for query, raw, vector, shadow, least in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), vectors, project(vectors, True),
                batch.column(2).to_pylist(), strict=True):
            length = float(np.sqrt(vector @ vector))
            worst = math.inf if least is None else max(0.0, 2 * norm * norm - 2 * norm / length * least)
            near = _box_distance(shadow, low, high)
            begun = int(np.argmin(near))
            for at in np.flatnonzero(near <= ratio * worst):
                rows.extend((query, raw, int(numbers[at]), part, worst) for part in range(int(parts[at]))
                            if at != begun or part != query % int(parts[at]))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                          ["query", "vector", "cell", "part", "worst"])

    more = map_arrow(queries.join(bounds, "query", "left").select("query", "vector", "least"), others, routed)
    found = first.union(run(more.withColumn("block", block_of)))

    # Equal scores beyond the last place keep their order by key: all points that tie with it stay.
    ranked = found.withColumn("place", F.rank().over(W.partitionBy("query").orderBy(F.desc("score")))).where(
        F.col("place") <= k + 1).join(points.select("point", "ids"), "point")
    members = ranked.select("query", "score", F.explode("ids").alias("id"))
    best = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    # One id more than needed, as the query itself may be among them; an id with several vectors may stand there twice.
    lists = (members.groupBy("query", "id").agg(F.max("score").alias("score")).withColumn("place", best)
             .where(F.col("place") <= k + 1).groupBy("query")
             .agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "score"))).alias("best")))
    answers = asked.join(lists, "query").select("query_id", F.posexplode(
        F.slice(F.filter("best", lambda x: x.id != F.col("query_id")), 1, k)).alias("at", "hit"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.id").alias(key),
                          F.col("hit.score").alias("score"))
