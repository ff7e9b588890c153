"""One large JSON object of keyed sections, read in splits.

A store is ``{name: {key: record, ...}, ..., name: value}``, as one file or as a
folder whose files in name order make up that text.  Spark splits it at quotes:
every piece between two quotes is one row, so any file system that Spark reads will do,
and a split can begin anywhere, also inside a string or a record.

Two passes.  The first tells for every split how its quotes and brackets change
the state, for both states in which it may begin; adding that up over the splits
gives each its true start.  The second walks each split from there and
gathers the pieces of every entry; an entry that reaches over splits is put
together from its fragments.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlrisk.session import materialize

c = F.col
_TAIL = re.compile(r"\\*$")
_OPEN, _CLOSE = "{[", "}]"
#: What is wrong with a store that does not exist (a fixed text).
MISSING = "reputation_store.json is not built yet"
_SUMMARY = ["split", "pieces", "quotes", "depth0", "depth1", "sign0", "sign1", "first", "open_quote"]


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(split, value): the text between quotes, in order within each split."""
    text = spark.read.option("lineSep", '"').text(path)
    split = F.concat_ws(" ", F.regexp_extract("_metadata.file_path", "[^/]*$", 0), F.lpad(c("_metadata.file_block_start").cast("string"), 20, "0"))
    return text.select(split.alias("split"), c("value"))


def _quoted(value: str) -> bool:
    """Whether the quote after a piece counts; an odd number of backslashes before it takes its meaning."""
    return len(_TAIL.search(value).group()) % 2 == 0


def _delta(value: str) -> int:
    return sum(map(value.count, _OPEN)) - sum(map(value.count, _CLOSE))


def _summaries(batches):
    """Per split: pieces, quotes, for either start (outside, inside a string) the change of depth and the last sign outside.

    ``open_quote`` says that the quote behind the last piece counts.
    """
    held: dict[str, list] = {}

    def rows():
        columns = list(zip(*[(k, *v) for k, v in held.items()], strict=True))
        types = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 3, pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], _SUMMARY)

    for batch in batches:
        for split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if split not in held:
                if held:
                    yield rows()
                held = {split: [0, 0, 0, 0, None, None, value[:64], True]}
            s = held[split]
            side = s[1] % 2                       # 0: outside if the split begins outside
            s[2 + side] += _delta(value)
            stripped = value.rstrip()
            if stripped:
                s[4 + side] = stripped[-1]
            s[0] += 1
            s[7] = _quoted(value)
            s[1] += s[7]
    if held:
        yield rows()


@dataclass
class _Start:
    """State at the start of a split, and whether its file ends with it, so that no quote follows."""

    inside: int
    goes_on: bool          # within a string that began before
    depth: int
    sign: str              # the last sign outside strings
    ends_file: bool


def _starts(summaries: list) -> tuple[dict[str, _Start], str | None]:
    """(start of every split, what is wrong with the whole)."""
    inside, goes_on, depth, sign, out = 0, False, 0, "", {}
    if not summaries:
        return out, "the store is empty"
    for s, after in zip(summaries, [*summaries[1:], None], strict=True):
        ends = after is None or after.split.split(" ")[0] != s.split.split(" ")[0]
        out[s.split] = _Start(inside, goes_on, depth, sign, ends)
        depth += s.depth1 if inside else s.depth0
        sign = (s.sign1 if inside else s.sign0) or sign
        inside = (inside + s.quotes - (ends and s.open_quote)) % 2
        goes_on = bool(inside) and (ends or not s.open_quote)
    if not summaries[0].first.lstrip("\ufeff \t\r\n").startswith("{"):
        return out, "reputation store JSON must be an object"
    return out, None if depth == 0 and not inside else "reputation store JSON is not complete"


def _walk(starts: dict[str, _Start]):
    """A function over batches of pieces: (split, number, level, name, text) of every section and entry, or part of one.

    Number 0 goes on with what a split before has begun.  A key is a string at
    depth 1 or 2 behind ``{`` or ``,``.
    """
    def run(batches):
        now, number, level, name, parts = None, 0, 0, None, []

        def flush(last: bool):
            text = "".join(parts)
            row = (now, number, level, name, text[:-1] if last and starts[now].ends_file else text)
            types = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)],
                                              ["split", "number", "level", "name", "text"])

        for batch in batches:
            for split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if split != now:
                    if now is not None:
                        yield flush(True)
                    now, number, level, name, parts = split, 0, 0, None, []
                    start = starts[split]
                    inside, goes_on, depth, sign = start.inside, start.goes_on, start.depth, start.sign
                if inside:
                    if not goes_on and depth in (1, 2) and sign in ("{", ","):
                        yield flush(False)
                        number, level, parts = number + 1, depth, []
                        name = value if depth == 1 else name
                    goes_on = True
                else:
                    depth += _delta(value)
                    sign, goes_on = value.rstrip()[-1:] or sign, False
                parts.append(value + '"')
                inside ^= _quoted(value)
        if now is not None:
            yield flush(True)

    return run


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str | None]:
    """(entries (section, key, record as JSON, position), values (name, value), what is wrong or null).

    ``position`` numbers sections and entries in the order of the text, strings within a list included.
    Of a repeated key the last record stays.  A section that is no object has no
    entries.  A store that is missing, no object or cut short has none at all.
    """
    empty = (spark.createDataFrame([], "section string, key string, record string, position bigint"), spark.createDataFrame([], "name string, value string"))
    try:
        found = pieces(spark, path)
    except AnalysisException as problem:
        missing = problem.getCondition() == "PATH_NOT_FOUND"
        return *empty, MISSING if missing else str(problem).splitlines()[0]
    summaries = found.mapInArrow(
        _summaries, "split string, pieces bigint, quotes bigint, depth0 bigint, depth1 bigint, sign0 string, sign1 string, "
                    "first string, open_quote boolean")
    starts, error = _starts(sorted(summaries.collect(), key=lambda s: s.split))     # one row per split
    if error:
        return *empty, error
    fragments = materialize(found.mapInArrow(_walk(starts), "split string, number bigint, level int, name string, text string"), "fragments")
    # What a split goes on with: the last item that began before it, and the section it was in.
    last = {r.split: (r.number, r.item["level"], r.item["name"]) for r in fragments.groupBy("split").agg(
        F.max("number").alias("number"), F.max_by(F.struct("level", "name"), "number").alias("item")).collect()}
    section, level, before, rows = None, 0, 0, []
    for split in sorted(starts):
        rows.append((split, section, level, before))
        number, own, name = last.get(split, (0, 0, None))
        section, level, before = name if name is not None else section, own if number else level, before + number
    context = spark.createDataFrame(rows, "split string, began_in string, of_level int, before bigint")
    items = (fragments.join(context, "split").select(
        "split", (c("before") + c("number")).alias("position"),
        F.when(c("number") == 0, c("of_level")).otherwise(c("level")).alias("level"), F.coalesce("name", "began_in").alias("section"), "text")
        .groupBy("position").agg(
            F.max("level").alias("level"), F.min_by("section", "split").alias("section"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "").alias("text")))
    # The text of an entry ends with the quote that opens the next key.
    parsed = F.from_json(F.concat(F.lit('{"'), F.regexp_replace("text", r',\s*"$', ""), F.lit("}")), "map<string,string>")
    items = materialize(items.where("level > 0").withColumn("entry", F.explode_outer(F.map_entries(parsed))), "store-items")
    headers = items.where("level = 1")
    objects = headers.where(c("text").rlike(r'^[^"]*"\s*:\s*\{')).select("section").distinct()
    entries = (items.where("level = 2 AND entry IS NOT NULL").join(objects, "section", "left_semi")
               .groupBy("section", c("entry.key").alias("key"))
               .agg(F.max_by(c("entry.value"), "position").alias("record"), F.min("position").alias("position")))
    values = headers.where("entry IS NOT NULL").groupBy(c("entry.key").alias("name")).agg(
        F.max_by(c("entry.value"), "position").alias("value"))
    return entries, values, None


def write_store(entries: DataFrame, values: dict, path: str) -> None:
    """Write at least one value and all (section, key, record) as one JSON object in a folder of files in order.

    Lines are sorted by section and key over all tasks; the files one after the
    other are the text.
    """
    first = entries.groupBy("section").agg(F.min("key").alias("first"))
    one = F.to_json(F.create_map("key", "record"))
    lines = entries.join(first, "section").select(
        c("section"), F.lit(1).alias("kind"), "key",
        F.concat(F.when(c("key") == c("first"), "").otherwise(","), F.substr(one, F.lit(2), F.length(one) - 2)).alias("line"))
    name = F.substr(F.to_json(F.create_map("section", F.lit(0))), F.lit(2), F.length(F.to_json(F.create_map("section", F.lit(0)))) - 3)
    heads = first.select("section", F.lit(0).alias("kind"), F.lit("").alias("key"), F.concat(F.lit(","), name, F.lit("{")).alias("line"))
    feet = first.select("section", F.lit(2).alias("kind"), F.lit("").alias("key"), F.lit("}").alias("line"))
    spark = entries.sparkSession
    head = spark.range(1).select(F.lit("").alias("section"), F.lit(-1).alias("kind"), F.lit("").alias("key"),
                                 F.lit(json.dumps(values)[:-1]).alias("line"))
    foot = spark.range(1).select(F.lit("\U0010ffff").alias("section"), F.lit(3).alias("kind"), F.lit("").alias("key"), F.lit("}").alias("line"))
    (head.unionByName(heads).unionByName(lines).unionByName(feet).unionByName(foot)
     .orderBy("section", "kind", "key").select("line").write.text(path))
