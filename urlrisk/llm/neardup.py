"""Near-duplicate documents from bottom-k sketches.

Every document is the set of hashes of its word shingles; its sketch is the k
smallest of them, all from one hash function.  Retained values are turned into
inverted lists.  Two sets above the threshold share at least half of their
sketches but for a chance below 10^-6, so in any common order of all values
they share one of the first half; values are ordered from rare to frequent,
and a value held by many unlike documents (a licence, a menu) generates
nothing.  Two sets can have no more in common than either shares with any other
document, which is counted beforehand on the full sets and leaves heavily edited
copies out, before the lists are made.  A list is not expanded into pairs: every
document first meets one pivot, the one that most of its lists name.  Then two
documents of one pivot have no more in common than the smaller of their parts
inside the pivot and what both hold outside it, so only those that share
something outside it, or are small enough, can still be alike.  Members of
different components that are left in a list meet each other, pass the estimate from the
sketch of the union and then the exact similarity of the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urlrisk.llm.common import (apart, components, list_rows, lists, map_arrow, materialize, shared_path, shingles,
                                word_hashes)

SKETCH = 64
#: Pairs that a list entry may come to before the lists get another round of pivots.
PAIRS = 8


def sketches(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text", size: int = SKETCH) -> DataFrame:
    """(id, n_shingles, set_hash, sketch): the sketch holds the smallest hashes, all of them for a small set.

    A text of fewer words than a shingle is one shingle; null or empty texts have none.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, hashes, kept = [], [], []
        for value in batch.column(1):
            values = np.unique(shingles(word_hashes(value.as_py()), words))
            sizes.append(len(values))
            hashes.append(xxhash.xxh3_128_digest(values.tobytes()))
            kept.append(values[:size].view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()),
             lists(kept, pa.int64())], ["id", "n_shingles", "set_hash", "sketch"])

    return map_arrow(docs.select(key, text), rows, "id bigint, n_shingles bigint, set_hash binary, sketch array<bigint>")


def shingle_sets(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, items array<bigint>): the full sets, sorted."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(word_hashes(v.as_py()), words).view(np.int64)) for v in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists(sets, pa.int64())], ["id", "items"])

    return map_arrow(docs.select(key, text), rows, "id bigint, items array<bigint>")


def _retained(sketch: DataFrame) -> DataFrame:
    """(value, id): inverted lists of the values that can generate a candidate.

    A value that one document alone holds generates nothing, and counts as the
    rarest; of a sketch of s values the s - s/2 + 1 rarest generate.
    """
    rows = sketch.select("id", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    shared = (rows.withColumn("held", F.count("*").over(W.partitionBy("value"))).where("held > 1"))
    place = F.row_number().over(W.partitionBy("id").orderBy("held", "value"))
    many = F.count("*").over(W.partitionBy("id"))
    return (shared.select("id", "s", "value", place.alias("place"), many.alias("many"))
            .where("s - many + place <= s - ceil(s / 2) + 1").select("value", "id"))


def _similar(pairs: DataFrame, sketch: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) at or above the threshold: estimate from the sketch of the union, then the exact value."""

    def estimated(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(list_rows(batch.column(2)), list_rows(batch.column(3)), strict=True):
            x, y = x.view(np.uint64), y.view(np.uint64)
            both = np.intersect1d(x, y, assume_unique=True)
            union = np.union1d(x, y)[:size]
            keep.append(2 * int(np.searchsorted(both, union[-1], "right")) >= len(union))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    def exact(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for x, y in zip(list_rows(batch.column(2)), list_rows(batch.column(3)), strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    def with_both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        left = table.select(F.col("id").alias("a"), F.col(column).alias("x"))
        right = table.select(F.col("id").alias("b"), F.col(column).alias("y"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    likely = map_arrow(with_both(pairs, sketch, "sketch"), estimated, "a bigint, b bigint")
    return map_arrow(with_both(likely, sets, "items"), exact, "a bigint, b bigint")


def _pivots(lists: DataFrame) -> DataFrame:
    """(id, p): the pivot that most lists of a document name, the member of a small component with the least of its own."""
    own = lists.withColumn("peers", F.count("*").over(W.partitionBy("value", "component")))
    first = F.min(F.struct("peers", F.expr("(n - common) / n").alias("own"), "id", "component")).over(W.partitionBy("value"))
    votes = own.withColumn("first", first).where("component <> first.component").groupBy("id", F.col("first.id").alias("p")).count()
    return votes.groupBy("id").agg(F.min(F.struct((-F.col("count")).alias("less"), "p")).alias("most")).select("id", "most.p")


def _beside(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, p, n, pn, both, linked, rest): a document beside its pivot; ``rest`` is what it holds outside the pivot."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, common, rest = [], [], []
        for x, y in zip(list_rows(batch.column(2)), list_rows(batch.column(3)), strict=True):
            out = np.setdiff1d(x, y, assume_unique=True)
            sizes.append((len(x), len(y)))
            common.append(len(x) - len(out))
            rest.append(out)
        n, pn = (pa.array(c, pa.int64()) for c in zip(*sizes, strict=True))
        linked = pa.array([100 * c >= percent * (a + b - c) for (a, b), c in zip(sizes, common, strict=True)])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pn, pa.array(common, pa.int64()), linked,
                                           lists(rest, pa.int64())], ["id", "p", "n", "pn", "both", "linked", "rest"])

    items = sets.select("id", "items")
    other = sets.select(F.col("id").alias("p"), F.col("items").alias("other"))
    return map_arrow(pairs.join(items, "id").join(other, "p").select("id", "p", "items", "other"), rows,
                     "id bigint, p bigint, n bigint, pn bigint, both bigint, linked boolean, rest array<bigint>")


def _outside(star: DataFrame, percent: int) -> DataFrame:
    """(value, id, n, common, inside, outside, unit, component): inverted lists of what documents of one pivot hold outside it.

    To be alike, two of them must share all that their parts inside the pivot leave
    to be shared, so the rarest items generate, as in a sketch.
    """
    rows = star.select("id", "n", "p", "both", "component", F.explode("rest").alias("item"))
    members = W.partitionBy("p", "item")
    rows = (rows.select("*", F.count("*").over(members).alias("held"), F.min("component").over(members).alias("low"),
                        F.max("component").over(members).alias("high")).where("low < high"))
    own = W.partitionBy("id")
    rows = rows.select("*", F.count("*").over(own).alias("outside"), F.row_number().over(own.orderBy("held", "item")).alias("place"))
    return (rows.where(f"place <= outside - greatest(1, ceil({percent} * n / 100) - both) + 1")
            .select(F.xxhash64("p", "item").alias("value"), "id", "n", (F.col("both") + F.col("outside")).alias("common"),
                    F.col("both").alias("inside"), "outside", F.col("component").alias("unit"), "component"))


def _open(lists: DataFrame) -> DataFrame:
    """The lists with members of different units and components."""
    members = W.partitionBy("value")
    ends = [f(c).over(members).alias(f"{c}_{n}") for c in ("unit", "component") for n, f in (("low", F.min), ("high", F.max))]
    return (lists.select("*", *ends).where("unit_low < unit_high AND component_low < component_high").select(lists.columns))


def _pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of one list in different units and components that may be alike; those of its largest unit only meet others."""
    members = W.partitionBy("value")
    sized = lists.withColumn("peers", F.count("*").over(W.partitionBy("value", "unit")))
    sized = sized.withColumn("major", F.col("unit") == F.max(F.struct("peers", "unit")).over(members)["unit"])
    names = ["id", "n", "inside", "outside", "unit", "component", "major"]
    other = sized.select("value", *(F.col(c).alias(f"{c}2") for c in names))
    return (sized.where("NOT major").join(other, "value").where("unit <> unit2 AND component <> component2 AND (major2 OR id < id2)")
            .where(f"{100 + percent} * (least(inside, inside2) + least(outside, outside2)) >= {percent} * (n + n2)")
            .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())


def _smaller(star: DataFrame, percent: int) -> DataFrame:
    """(a, b): documents not like their pivot, and those of the same pivot so much smaller that the part inside it may be enough."""
    least = F.min("n").over(W.partitionBy("p"))
    far = star.select("*", least.alias("least")).where(f"NOT linked AND {100 + percent} * both >= {percent} * (n + least)")
    small = star.where("n < pn").select("p", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "both", "component")))
    return (far.join(small, "p").where("component <> component2")
            .where(f"{100 + percent} * least(both, both2) >= {percent} * (n + n2)")
            .select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct())


def _links(near: DataFrame, sets: DataFrame, percent: int, size: int) -> DataFrame:
    """(node, component) of the documents that are linked; ``near`` has their sketches, ``sets`` (id, n, common, items)."""
    spark = near.sparkSession
    path = shared_path(spark, "links")

    def joined(table: DataFrame) -> DataFrame:
        return (table.join(parts, F.col("node") == F.col("id"), "left")
                .withColumn("component", F.coalesce("component", "id")).drop("node"))

    entries = materialize(_retained(near).join(sets.select("id", "n", "common"), "id"), "lists")
    star = materialize(_beside(_pivots(entries.withColumn("component", F.col("id"))), sets, percent), "pivots")
    star.where("linked").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).write.mode("append").parquet(path)
    links = spark.read.schema("a bigint, b bigint").parquet(path)
    parts = components(links)
    star = materialize(joined(star), "pivots")
    # Documents of different pivots are held by what they share with any other one, those of one pivot by the pivot.
    mixed = joined(entries.join(star.select("id", F.col("p").alias("unit")), "id", "left")).select(
        "value", "id", "n", "common", F.col("common").alias("inside"), F.lit(0).cast("long").alias("outside"),
        F.coalesce("unit", "id").alias("unit"), "component")
    lists = materialize(_open(mixed).unionByName(_open(_outside(star, percent))), "lists")
    known = links.count()
    while True:
        each = lists.groupBy("value", "unit").agg(F.count("*").alias("k")).groupBy("value").agg(
            F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k")).alias("same"))
        if not each.agg(F.sum(F.expr("n * n - same")) > 2 * PAIRS * F.sum("n")).first()[0]:
            break
        more = _beside(_pivots(lists), sets, percent).where("linked")
        more.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).write.mode("append").parquet(path)
        links = spark.read.schema("a bigint, b bigint").parquet(path)
        before, known = known, links.count()
        if known == before:
            break
        parts = components(links)
        moved = joined(lists.drop("component")).withColumn("unit", F.expr("if(outside > 0, component, unit)"))
        lists = materialize(_open(moved.select(lists.columns)), "lists")
    left = _pairs(lists, percent).union(_smaller(star, percent)).distinct()
    _similar(left, near, sets, percent, size).write.mode("append").parquet(path)
    links = spark.read.schema("a bigint, b bigint").parquet(path)
    return parts if links.count() == known else components(links)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text",
                    size: int = SKETCH) -> DataFrame:
    """(key, n_shingles, component_id, kept): every document with the smallest key that links of similar sets reach.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets, confirmed on the full sets.  Documents with equal sets are one
    from the start.  Null and empty texts are linked with nothing and kept.  Rows
    that repeat a key are one document as far as links go, and each stays a row;
    a null key is linked with nothing, has a null component and is kept.  Keys
    are whole numbers.  An empty table gives an empty table; other columns are
    not read.
    """
    spark = docs.sparkSession
    sketch = materialize(sketches(docs, words, key, text, size), "sketches")
    some = sketch.where("n_shingles > 0 AND id IS NOT NULL")
    copies = some.groupBy("set_hash").agg(F.min("id").alias("rep"))
    reps = some.join(copies.select(F.col("rep").alias("id"), F.col("set_hash")), ["id", "set_hash"], "left_semi")
    wanted = materialize(_retained(reps).select(F.col("id").alias(key)).distinct(), "wanted")
    maybe, _ = apart(docs.select(key, text), wanted, key)
    sets = materialize(shingle_sets(maybe, words, key, text).join(
        wanted.select(F.col(key).alias("id")), "id", "left_semi"), "sets")
    # How many shingles a set shares with any other one: no pair can have more in common.
    items = sets.select("id", F.explode("items").alias("item"))
    held = items.select("id", (F.count("*").over(W.partitionBy("item")) > 1).cast("int").alias("shared"))
    stats = held.groupBy("id").agg(F.count("*").alias("n"), F.sum("shared").alias("common"))
    stats = materialize(stats.where(f"100 * common >= {percent} * n"), "stats")
    near = materialize(reps.select("id", "sketch").join(stats.select("id"), "id", "left_semi"), "near-sketches")
    parts = _links(near, materialize(sets.join(stats, "id"), "near-sets"), percent, size)

    groups = copies.join(parts, F.col("rep") == F.col("node"), "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component"))
    # Rows without a group get a key of their own, so that they do not meet in one task.
    alone = F.encode(F.concat(F.lit("none "), F.coalesce(F.col("id"), F.monotonically_increasing_id()).cast("string")),
                     "UTF-8")
    own = F.when(F.expr("n_shingles > 0 AND id IS NOT NULL"), F.col("set_hash")).otherwise(alone)
    out = sketch.select("id", "n_shingles", own.alias("set_hash")).join(groups, "set_hash", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_copies(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, but one of each group of near-duplicates: that with the smallest key."""
    found = near_duplicates(docs, words, percent, key, text)
    gone = materialize(found.where(~F.col("kept")).select(key).distinct(), "copies")
    maybe, clean = apart(docs, gone, key)
    return maybe.join(gone, key, "left_anti").select(docs.columns).union(clean)
