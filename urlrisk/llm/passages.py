"""Passages that repeat across documents, exactly or with changes.

Seeds are one in SAMPLE of all k-word runs, chosen by their hash alone, so that
two documents that share a run have both chosen it or neither.  An occurrence of a
rare seed meets those of all earlier documents; that of a frequent one meets the first
occurrence and the one before it, so matches grow with the text and not with the
square of a group.  Each run of ``min_words`` that is met again also meets its own
first occurrence.  The matches of two documents are chained in order with gap costs
through a Fenwick tree; those that may hold a passage, by the order of the words
around them, are aligned word by word.  What frequent seeds left out follows
then: where two of them, NEAR words apart, are in no passage that was found, the
place meets all earlier documents that hold both.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urlrisk.llm.common import _mix, apart, list_rows, lists, map_arrow, materialize, shingles, word_hashes
from urlrisk.session import scratch

#: Words of a seed, and runs of which one is chosen.
SEED, SAMPLE = 4, 3
#: Places in which a seed that comes again counts as a stretch that repeats itself.
WINDOW = 12
#: Words beyond the outermost matches in which a passage may go on with changes.
EXTEND = 48
#: Cost of a word that a chain passes over on either side; a longer gap than MAX_GAP ends a chain.
GAP_COST, MAX_GAP = 0.05, 48
#: Occurrences of a seed of which each meets all earlier ones.
ALL = 16
#: Words from one frequent seed to another one that a passage of both holds, least and most.
NEAR = (24, 48)
#: Matches that are sent on at a time.
SENT = 200_000
#: Runs of a chain of which all stretches are judged at a time.
AT_ONCE = 256
#: Rows of which the hashes are dealt at a time, and words that are hashed at a time.
ROWS = 1000
CHUNK = 200_000
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _within_repeats(runs: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The seeds at these places of the documents ``of``, with those of a stretch that repeats itself numbered.

    In a stretch of one word, or of a few in turn, all places would match all
    others.  There the n-th seed of a kind is given a hash of its own, so that it
    matches the n-th one of another document, and one in WINDOW of equal neighbours
    is kept.
    """
    change = np.concatenate([[True], (runs[1:] != runs[:-1]) | (of[1:] != of[:-1])])
    begin = np.maximum.accumulate(np.where(change, np.arange(len(runs)), 0))
    at = at[(at - begin[at]) % WINDOW == 0]
    order = np.argsort(runs[at], kind="stable")
    values, places = runs[at][order], at[order]
    again = np.concatenate([[False], (values[1:] == values[:-1]) & (np.diff(places) <= WINDOW)
                            & (of[places[1:]] == of[places[:-1]])])[:len(at)]
    index = np.arange(len(at))
    number = index - np.maximum.accumulate(np.where(again, 0, index))
    out = np.empty_like(values)
    out[order] = values ^ (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return at, out


def _word_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, words binary): 32-bit hashes of the words of all documents that can hold a seed."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, words = [], []
        for id_, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = (word_hashes(value.as_py()) >> np.uint64(32)).astype("<u4")
            if id_ is not None and len(own) >= SEED:
                ids.append(id_)
                words.append(own.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], ["id", "words"])

    return map_arrow(docs.select(key, text), rows, "id bigint, words binary")


def _stretches(ids: list[int], words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, row of each, its place, ids of the rows) of whole documents, some CHUNK words at a time."""
    low = 0
    while low < len(ids):
        high, many = low, 0
        while high < len(ids) and (high == low or many + len(words[high]) // 4 <= CHUNK):
            many += len(words[high]) // 4
            high += 1
        sizes = np.array([len(w) // 4 for w in words[low:high]])
        of = np.repeat(np.arange(high - low), sizes)
        place = np.arange(many) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        yield np.frombuffer(b"".join(words[low:high]), "<u4").astype(np.uint64), of, place, np.array(ids[low:high], np.int64)
        low = high


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for every run of ``size`` of at least as many words, at a cost that does not grow with the size."""
    base = np.uint64(0x9E3779B97F4A7C15)
    powers, inverse = (np.cumprod(np.full(len(words) + 1, b, np.uint64)) for b in (base, np.uint64(pow(int(base), -1, 1 << 64))))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words) * powers[:-1])])
    return _mix((sums[size:] - sums[:-size]) * inverse[:len(words) - size + 1])


def _seeds(words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the chosen seeds: one in SAMPLE of all runs of SEED words."""
    if len(words) < SEED:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    runs = shingles(_mix(words), SEED)
    at = np.flatnonzero((runs % np.uint64(SAMPLE) == 0) & (of[SEED - 1:] == of[:len(runs)]))
    return _within_repeats(runs, of[:len(runs)], at)


def _parts(words: np.ndarray, of: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, after, hash): winnowed runs of three fifths of ``min_words``, and the runs of ``min_words`` that chose them.

    Every run of ``min_words`` chooses the one with the least hash in it, so two
    equal runs choose equal ones.  Those that chose this one begin at ``begin`` and
    the places up to ``after``.
    """
    if len(words) < min_words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    part = max(1, 3 * min_words // 5)
    parts = _rolled(words, part)
    many = len(words) - min_words + 1
    chosen = np.lib.stride_tricks.sliding_window_view(parts, min_words - part + 1).argmin(axis=1) + np.arange(many)
    inside = of[min_words - 1:] == of[:many]
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (inside[1:] != inside[:-1])])
    begin = np.flatnonzero(new)
    after = np.append(begin[1:], many)
    kept = inside[begin]
    return begin[kept], after[kept], parts[chosen[begin[kept]]]


def _by_some(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``map_arrow`` in steps of ROWS rows, which bounds what a task holds of hashes made from texts."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                yield rows(batch.slice(begin, ROWS))

    return df.mapInArrow(run, schema)


_DEALT = "bucket int, hash array<bigint>, id array<bigint>, pos array<int>"


def _dealt(kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Hashes, ids and places of some kinds, cut by hash: the n-th kind has the buckets from n times ``buckets`` on."""
    numbers, cut = [], ([], [], [])
    for kind, (hashes, ids, places) in enumerate(kinds):
        bucket = ((hashes >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        have, begin = np.unique(bucket[order], return_index=True)
        numbers.append(have + kind * buckets)
        for columns, values in zip(cut, (hashes.view(np.int64), ids, places.astype(np.int32)), strict=True):
            columns += np.split(values[order], begin[1:]) if len(have) else []
    kind = pa.array(np.concatenate(numbers).astype(np.int32), pa.int32())
    return pa.RecordBatch.from_arrays([kind, lists(cut[0], pa.int64()), lists(cut[1], pa.int64()), lists(cut[2], pa.int32())],
                                      ["bucket", "hash", "id", "pos"])


def _sorted(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(ids, places, first of the own hash, after its last, first of the own hash and id, hashes) of a bucket, by hash, id and place."""
    hashes, ids, places = (table.column(i).combine_chunks().flatten().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
    order = np.lexsort((places, ids, hashes))
    hashes, ids, places = hashes[order], ids[order], places[order]
    index = np.arange(len(ids))
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    own = new | np.concatenate([[True], ids[1:] != ids[:-1]])
    begin = np.flatnonzero(new)
    after = np.repeat(np.append(begin[1:], len(ids)), np.diff(np.append(begin, len(ids))))
    first, mine = (np.maximum.accumulate(np.where(c, index, 0)) for c in (new, own))
    return ids, places, first, after, mine, hashes


#: Rows of matches and of places, cut by document or by pair of documents: a list has all that one task found for a part.
MET, AGAIN, FREQUENT = range(3)
_MET = "kind int, part int, id array<bigint>, source array<bigint>, pos array<int>, source_pos array<int>, hash array<bigint>"
_MET_KINDS = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())


def _parted(kind: int, parts: int, ids: np.ndarray, places: np.ndarray, sources: np.ndarray | None = None,
            source_places: np.ndarray | None = None, hashes: np.ndarray | None = None) -> pa.Table:
    """These rows as one row of lists for each part; what is not given is an empty list."""
    number = _mix(ids.view(np.uint64))
    if sources is not None:
        number = _mix(number ^ (sources.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    part = ((number >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    have, begin = np.unique(part[order], return_index=True)
    columns = [lists([] if not len(have) else [np.empty(0, kind_.to_pandas_dtype())] * len(have) if values is None
                     else np.split(values[order], begin[1:]), kind_)
               for values, kind_ in zip((ids, sources, places, source_places, hashes), _MET_KINDS, strict=True)]
    return pa.table([pa.array(np.full(len(have), kind, np.int32)), pa.array(have, pa.int32()), *columns],
                    ["kind", "part", "id", "source", "pos", "source_pos", "hash"])


def _met(ids: np.ndarray, places: np.ndarray, x: np.ndarray, y: np.ndarray, parts: int) -> pa.Table:
    return _parted(MET, parts, ids[x], places[x], ids[y], places[y])


def _flat(group: pa.Table, name: str) -> np.ndarray:
    return group.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)


def seed_matches(table: DataFrame, min_words: int) -> DataFrame:
    """Occurrences of seeds and earlier ones, as rows of lists by kind and part.

    Each occurrence of a seed with up to ALL of them meets those of all earlier
    documents (MET, by pair of documents).  Without a source are the occurrences of the others, with their hash
    (FREQUENT), and of parts that come again (AGAIN), both by document.
    """
    buckets = _buckets(table)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds: tuple[list, list] = [], []
        for words, of, place, ids in _stretches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, hashes = _seeds(words, of)
            kinds[0].append((hashes, ids[of[at]], place[at]))
            begin, _, hashes = _parts(words, of, min_words)
            kinds[1].append((hashes, ids[of[begin]], place[begin]))
        return _dealt([tuple(map(np.concatenate, zip(*kind, strict=True))) for kind in kinds], buckets)

    def met(group: pa.Table) -> pa.Table:
        ids, places, first, after, own, hashes = _sorted(group)
        index = np.arange(len(ids))
        if group.column(0)[0].as_py() >= buckets:
            again = np.flatnonzero(ids[first] < ids[after - 1])
            return _parted(AGAIN, buckets, ids[again], places[again])
        later = index[first < own]
        few = after[later] - first[later] <= ALL
        many = later[~few]
        x, y = [many, many[own[many] - 1 > first[many]]], [first[many]]
        y.append(own[x[1]] - 1)
        later = later[few]
        for back in range(1, ALL):
            later = later[later - back >= first[later]]
            x.append(later[later - back < own[later]])
            y.append(x[-1] - back)
        left = np.flatnonzero((after - first > ALL) & (ids[first] < ids[after - 1]))
        return pa.concat_tables([_met(ids, places, np.concatenate(x), np.concatenate(y), buckets),
                                 _parted(FREQUENT, buckets, ids[left], places[left], hashes=hashes[left])])

    return _by_some(table, rows, _DEALT).groupBy("bucket").applyInArrow(met, _MET)


def _buckets(table: DataFrame) -> int:
    return 4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact(table: DataFrame, places: DataFrame, min_words: int) -> DataFrame:
    """Every run of ``min_words`` that an earlier document has, and its first occurrence, as rows of lists by part.

    ``places`` has the rows of the parts that come again; the hashes of all runs would be a table as large as the text.
    """
    buckets = _buckets(table)

    def by_document(group: pa.Table) -> pa.Table:
        ids, at = _flat(group, "id"), _flat(group, "pos")
        order = np.lexsort((at, ids))
        ids, at = ids[order], at[order]
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return pa.table([pa.array(ids[begin]), lists(np.split(at, begin[1:]), pa.int32())], ["id", "places"])

    wanted = materialize(places.select("part", "id", "pos").groupBy("part").applyInArrow(
        by_document, "id bigint, places array<int>"), "places")
    maybe, _ = apart(table, wanted, "id")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        again, row = list_rows(batch.column(2)), 0
        for words, of, place, ids in _stretches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            begin, after, _ = _parts(words, of, min_words)
            chosen = np.concatenate([np.isin(place[begin[of[begin] == i]], again[row + i]) for i in range(len(ids))])
            sizes = (after - begin)[chosen]
            at = np.repeat(begin[chosen], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            runs = _rolled(words, min_words) if len(at) else np.empty(0, np.uint64)
            found.append((runs[at], ids[of[at]], place[at]))
            row += len(ids)
        return _dealt([tuple(map(np.concatenate, zip(*found, strict=True)))], buckets)

    def met(group: pa.Table) -> pa.Table:
        ids, places, first, _, own, _ = _sorted(group)
        later = np.flatnonzero(first < own)
        return _met(ids, places, later, first[later], buckets)

    return _by_some(maybe.join(wanted, "id"), rows, _DEALT).groupBy("bucket").applyInArrow(met, _MET)


def left_out(frequent: DataFrame, found: DataFrame, buckets: int) -> DataFrame:
    """Places of two frequent seeds that are in no passage, and all earlier ones of both, as rows of lists by part.

    ``frequent`` has (id, pos, hash), ``found`` the passages so far.
    """
    spans = found.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("spans"))
    held = frequent.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("at")).join(spans, "id", "left")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32))]
        at, spans = batch.column(1), batch.column(2)
        places, hashes = (at.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        starts, lengths = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        many, many_spans = (c.value_lengths().fill_null(0).to_pylist() for c in (at, spans))
        i = k = 0
        for id_, size, size_spans in zip(batch.column(0).to_pylist(), many, many_spans, strict=True):
            own, own_hashes = places[i:i + size], hashes[i:i + size].view(np.uint64)
            begin, end = starts[k:k + size_spans], starts[k:k + size_spans] + lengths[k:k + size_spans]
            i, k = i + size, k + size_spans
            low, high = np.searchsorted(own, own + NEAR[0]), np.searchsorted(own, own + NEAR[1], "right")
            counts = high - low
            if not counts.any():
                continue
            x = np.repeat(np.arange(size), counts)
            y = np.arange(len(x)) - np.repeat(np.cumsum(counts) - counts, counts) + low[x]
            ends = np.concatenate([[-1], np.maximum.accumulate(end)]) if len(end) else np.full(1, -1)
            inside = ends[np.searchsorted(begin, own[x], "right")] >= own[y] + SEED
            both = _mix(_mix(own_hashes[x]) ^ (own_hashes[y] * np.uint64(0x9E3779B97F4A7C15)))
            # A place that is to be met has its complement.
            found.append((both, np.full(len(x), id_, np.int64), np.where(inside, own[x], ~own[x])))
        return _dealt([tuple(map(np.concatenate, zip(*found, strict=True)))], buckets)

    def met(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, first, _, own, _ = _sorted(pa.Table.from_batches(list(groups)))
        later = np.flatnonzero((first < own) & (places < 0))
        places = np.where(places < 0, ~places, places)
        counts = (own - first)[later]
        total = np.concatenate([[0], np.cumsum(counts)])
        for begin in range(0, int(total[-1]), SENT):
            at = np.arange(begin, min(begin + SENT, int(total[-1])))
            row = np.searchsorted(total, at, "right") - 1
            yield from _met(ids, places, later[row], first[later[row]] + at - total[row], buckets).to_batches()

    return _by_some(held, rows, _DEALT).groupBy("bucket").applyInArrow(met, _MET)


def merged(at: list[tuple[int, int, int]], min_words: int) -> list[tuple[int, int, int]]:
    """The matches (place, source place, words) with those that go on from one another made one.

    In a stretch that repeats itself all runs of ``min_words`` meet the same place
    of the source; there as many are kept as cover the stretch.
    """
    last: dict[int, list[int]] = {}
    runs = []
    for p, s, n in at:
        run = last.get(p - s)
        if run and run[0] + run[2] >= p:
            run[2] = max(run[2], p + n - run[0])
        else:
            run = last[p - s] = [p, s, n]
            runs.append(run)
    alone: dict[int, list[int]] = {}
    for i, (_, s, n) in enumerate(runs):
        if n == min_words:
            alone.setdefault(s, []).append(i)
    left_out = set()
    for same in alone.values():
        kept = same[0]
        for i, after in zip(same[1:-1], same[2:], strict=True):
            if runs[after][0] <= runs[kept][0] + min_words:
                left_out.add(i)
            else:
                kept = i
    return sorted(tuple(run) for i, run in enumerate(runs) if i not in left_out)


class _Fenwick:
    """The greatest value at or below a place, and whose it is."""

    def __init__(self, size: int):
        self.best = [(-1e18, -1)] * (size + 1)

    def put(self, place: int, value: tuple[float, int]) -> None:
        place += 1
        while place < len(self.best):
            if value > self.best[place]:
                self.best[place] = value
            place += place & -place

    def below(self, place: int) -> tuple[float, int]:
        best = (-1e18, -1)
        while place:
            if self.best[place] > best:
                best = self.best[place]
            place -= place & -place
        return best


def chains(at: list[tuple[int, int, int]], min_words: int) -> list[list[tuple[int, int, int]]]:
    """Chains of matches (place, source place, words) that rise on both sides, the best first; each match is in one.

    A chain's score is the words of its matches less GAP_COST for every word
    between their beginnings on both sides.  With the gap costs added to the
    scores, the best match to go on from is the greatest among those before it on
    both sides.  A match of ``min_words`` shares no chain with one that overlaps it.
    """
    columns = sorted({s for _, s, _ in at})
    tree = _Fenwick(len(columns))
    scores, back = [0.0] * len(at), [-1] * len(at)
    start = 0
    while start < len(at):
        end = start
        while end < len(at) and at[end][0] == at[start][0]:
            place, source, words = at[end]
            value, who = tree.below(bisect_left(columns, source))
            value -= GAP_COST * (place + source)
            scores[end] = words + max(0.0, value)
            back[end] = who if value > 0 else -1
            end += 1
        for i in range(start, end):
            place, source, _ = at[i]
            tree.put(bisect_left(columns, source), (scores[i] + GAP_COST * (place + source), i))
        start = end
    used = [False] * len(at)
    out = []
    for last in sorted(range(len(at)), key=lambda i: (-scores[i], i)):
        chain, i = [], last
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(at[i])
            i = back[i]
        chain.reverse()
        cut, far, source_far = 0, -1, -1
        for j in range(1, len(chain) + 1):
            if j < len(chain):
                (p, s, n), (q, t, m) = chain[j - 1], chain[j]
                far, source_far = max(far, p + n), max(source_far, s + n)
                gap, least = max(q - p - n, t - s - n), min(q - far, t - source_far)
            if j == len(chain) or gap > MAX_GAP or (least < 0 and max(n, m) >= min_words):
                if j > cut:
                    out.append(chain[cut:j])
                cut, far, source_far = j, -1, -1
    return out


def chained(seeds: DataFrame, runs: DataFrame | None, min_words: int) -> DataFrame:
    """(id, source, pos, source_pos, size, each array<int>, exact): chains that may hold a passage of ``min_words``.

    ``seeds`` and ``runs``, those of ``exact``, have rows of lists by pair of documents.  Documents with no match
    but runs of ``min_words`` share those exactly, and need no alignment.
    """
    columns = ["part", "id", "source", "pos", "source_pos"]
    both = seeds.select(*columns, F.lit(SEED).alias("size"))
    if runs is not None:
        both = both.union(runs.select(*columns, F.lit(min_words)))
    kinds = (pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.bool_())
    names = ["id", "source", "pos", "source_pos", "size", "exact"]

    def rows(group: pa.Table) -> pa.Table:
        ids, sources, places, source_places = (_flat(group, c) for c in columns[1:])
        sizes = np.repeat(group.column("size").to_numpy(), group.column("id").combine_chunks().value_lengths().to_numpy())
        order = np.lexsort((sizes, source_places, places, sources, ids))
        values = [c[order] for c in (ids, sources, places, source_places, sizes)]
        change = [np.concatenate([[True], c[1:] != c[:-1]]) for c in values]
        kept = np.logical_or.reduce(change)
        pair = np.flatnonzero((change[0] | change[1])[kept])
        ids, sources, places, source_places, sizes = (c[kept] for c in values)
        many = np.diff(np.append(pair, len(ids)))
        alone = pair[many == 1]
        alone = alone[(sizes[alone] >= min_words) | may_hold(sizes[alone], min_words)]
        single = pa.table([pa.array(ids[alone]), pa.array(sources[alone]),
                           *(pa.ListArray.from_arrays(pa.array(np.arange(len(alone) + 1), pa.int32()), pa.array(c[alone], pa.int32()))
                             for c in (places, source_places, sizes)), pa.array(sizes[alone] >= min_words)], names)
        out = []
        for start, size in zip(pair[many > 1].tolist(), many[many > 1].tolist(), strict=True):
            at = list(zip(*(c[start:start + size].tolist() for c in (places, source_places, sizes)), strict=True))
            id_, source = int(ids[start]), int(sources[start])
            whole = all(n >= min_words for _, _, n in at)
            joined = merged(at, min_words)
            for chain in [[run] for run in joined] if whole else chains(joined, min_words):
                if whole or may_hold(chain[-1][0] + chain[-1][2] - chain[0][0], min_words):
                    out.append((id_, source, *(list(c) for c in zip(*chain, strict=True)), whole))
        more = list(zip(*out, strict=True)) or [()] * 6
        return pa.concat_tables([single, pa.table([pa.array(c, k) for c, k in zip(more, kinds, strict=True)], names)])

    return both.groupBy("part").applyInArrow(
        rows, "id bigint, source bigint, pos array<int>, source_pos array<int>, size array<int>, exact boolean")


def may_hold(words: int | np.ndarray, min_words: int) -> bool | np.ndarray:
    """Whether a chain of so many words is long enough with those that may be found beyond it."""
    return words + 2 * EXTEND >= min_words


def _equal(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The places of the words that two short lists have in common, in order (bit-parallel).

    From the ends, equal words are taken; else a word of ``a`` is left out if as many are equal without it.
    """
    if a == b:
        return [(i, i) for i in range(len(a))]
    held: dict[int, int] = {}
    for j, y in enumerate(b):
        held[y] = held.get(y, 0) | 1 << j
    # After i words of a, bit j is 0 where the most words in common with b[:j + 1] are one more than with b[:j].
    full = rest = (1 << len(b)) - 1
    rows = [rest]
    for x in a:
        hit = rest & held.get(x, 0)
        if hit:
            rest = (rest + hit | rest - hit) & full
        rows.append(rest)
    out, i, j, many = [], len(a), len(b), len(b) - rest.bit_count()
    while many:
        below = (1 << j) - 1
        at = held.get(a[i - 1], 0) & below
        if at >> j - 1:
            i, j, many = i - 1, j - 1, many - 1
            out.append((i, j))
        elif j - (rows[i - 1] & below).bit_count() == many:
            i -= 1
        else:
            j = at.bit_length()
    return out[::-1]


def may_align(x: list[bytes], y: list[bytes], inner: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The most words that can be equal between two sides, by the bytes of their words, for each of some chains.

    ``inner`` has begin and end of the chain on both sides.  All words between count,
    and of those before and after it as many as both sides have.
    """
    bounds = np.asarray(inner, np.int64).reshape(-1, 4)
    bags = []
    for side, begin, end in ((x, bounds[:, 0], bounds[:, 1]), (y, bounds[:, 2], bounds[:, 3])):
        sizes = np.array([len(v) for v in side])
        row = np.repeat(np.arange(len(side)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        before, after = place < begin[row], place >= end[row]
        cells = ((2 * row + after) * 256 + np.frombuffer(b"".join(side), np.uint8))[before | after]
        bags.append(np.bincount(cells, minlength=512 * len(side)))
    beyond = np.minimum(*bags).reshape(len(x), -1).sum(axis=1)
    return beyond + np.minimum(bounds[:, 1] - bounds[:, 0], bounds[:, 3] - bounds[:, 2])


def in_order(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """The most bytes that the first k of one string and all of another have in common in their order, for each k up to 64 and each pair (bit-parallel)."""
    sizes, others = (np.array([len(v) for v in side]) for side in (x, y))
    wide = [np.frombuffer(b"".join(v.ljust(64, b"\0") for v in side), np.uint8).reshape(-1, 64) for side in (x, y)]
    last = np.where(sizes < 64, (np.uint64(1) << np.minimum(sizes, 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    rest = np.full(len(x), ~np.uint64(0))
    for j in range(int(others.max(initial=0))):
        equal = np.packbits(wide[0] == wide[1][:, j:j + 1], axis=1, bitorder="little").view("<u8").ravel()
        hit = rest & equal & np.where(j < others, last, np.uint64(0))
        rest = (rest + hit) | (rest - hit)
    more = np.unpackbits((~rest).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.concatenate([np.zeros((len(x), 1), np.int16), np.cumsum(more, axis=1, dtype=np.int16)], axis=1)


def may_pass(x: list[bytes], y: list[bytes], inner: np.ndarray, min_words: int, percent: int) -> np.ndarray:
    """Whether a passage may lie along each chain, by the words before and after it in their order, of which there are 64 at most.

    All words of the chain's shorter side count as equal.  Some number of words before and after it has to hold so
    many equal ones that they and the chain are long and alike enough.
    """
    if not x:
        return np.empty(0, bool)
    inner = np.asarray(inner, np.int64).reshape(-1, 4)
    ends = inner.tolist()
    before = in_order([v[:e[0]][::-1] for v, e in zip(x, ends, strict=True)], [v[:e[2]][::-1] for v, e in zip(y, ends, strict=True)])
    after = in_order([v[e[1]:] for v, e in zip(x, ends, strict=True)], [v[e[3]:] for v, e in zip(y, ends, strict=True)])
    within = np.minimum(inner[:, 1] - inner[:, 0], inner[:, 3] - inner[:, 2])
    # The most equal words among so many before and after the chain together.
    most = np.zeros((len(x), 129), np.int16)
    for k in range(65):
        np.maximum(most[:, k:k + 65], before[:, k:k + 1] + after, out=most[:, k:k + 65])
    words = np.maximum(min_words, np.arange(129) + within[:, None])
    return (100 * (most + within[:, None]) >= percent * words).any(axis=1)


def align(x: list[int], y: list[int], at: list[tuple[int, int, int]], least: int = 0) -> list[tuple[int, int, int]]:
    """(start, source start, words) of the runs of equal words along a chain, in places of the given words.

    Between matches the longest common order of words is taken, and so beyond the
    outer ones, after equal words, for EXTEND words.  Where fewer than ``least``
    words can be equal in all, there is no run.
    """
    end, source_end, _ = at[0]
    start, source_start = end, source_end
    while start and source_start and x[start - 1] == y[source_start - 1]:
        start, source_start = start - 1, source_start - 1
    last, source_last = at[-1][0] + at[-1][2], at[-1][1] + at[-1][2]
    while last < len(x) and source_last < len(y) and x[last] == y[source_last]:
        last, source_last = last + 1, source_last + 1
    head, source_head = max(0, start - EXTEND), max(0, source_start - EXTEND)
    before, source_before = x[head:start], y[source_head:source_start]
    after, source_after = x[last:last + EXTEND], y[source_last:source_last + EXTEND]
    left, right = ((Counter(a) & Counter(b)).total() for a, b in ((before, source_before), (after, source_after)))
    if left + min(last - start, source_last - source_start) + right < least:
        return []
    runs: list[list[int]] = []

    def add(i: int, j: int, n: int) -> None:
        if runs and runs[-1][0] + runs[-1][2] == i and runs[-1][1] + runs[-1][2] == j:
            runs[-1][2] += n
        elif n:
            runs.append([i, j, n])

    # Less than three words beyond a change add nothing to a passage.
    for i, j in _equal(before, source_before) if left > 2 else ():
        add(head + i, source_head + j, 1)
    add(start, source_start, end - start)
    for p, s, n in at:
        overlap = max(end - p, source_end - s, 0)
        if not overlap:
            for i, j in _equal(x[end:p], y[source_end:s]):
                add(end + i, source_end + j, 1)
        if overlap < n:
            # Where a match overlaps the one before, only what lies beyond it on both sides counts.
            add(p + overlap, s + overlap, n - overlap)
            end, source_end = p + n, s + n
    if (end, source_end) == (at[-1][0] + at[-1][2], at[-1][1] + at[-1][2]):
        add(end, source_end, last - end)
        for i, j in _equal(after, source_after) if right > 2 else ():
            add(last + i, source_last + j, 1)
    return [tuple(r) for r in runs]


def judged(runs: list[tuple[int, int, int]], min_words: int, percent: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, source start, source end, words in common) of the passages along aligned runs.

    Of all stretches from the start of a run to the end of one that are long and
    alike enough, the one with the most equal words less the others is taken, then
    the same on both sides of it.  So each run of ``min_words`` is in a passage,
    whatever else the chain holds, and every stretch that is alike enough meets one.
    """
    if (not runs or runs[-1][0] + runs[-1][2] - runs[0][0] < min_words
            or 100 * sum(n for _, _, n in runs) < percent * min_words):
        return []
    out, todo = [], [(0, len(runs))]
    starts, sources, sizes = np.array(runs, np.int64).T
    ends, source_ends, common = starts + sizes, sources + sizes, np.concatenate([[0], np.cumsum(sizes)])

    def values(i: int, after: int, low: int, high: int) -> np.ndarray:
        """For the stretches from each of the runs from i to those from low on: equal words less the others, if they pass."""
        words = ends[low:high] - starts[i:after, None]
        longer = np.maximum(words, source_ends[low:high] - sources[i:after, None])
        same = common[low + 1:high + 1] - common[i:after, None]
        return np.where((words >= max(min_words, 1)) & (100 * same >= percent * longer), 2 * same - longer, -1 << 40)

    whole = values(0, len(runs), 0, len(runs)) if len(runs) <= AT_ONCE else None
    while todo:
        low, high = todo.pop()
        best = None
        step = high - low if whole is not None else max(1, AT_ONCE * AT_ONCE // max(1, high - low))
        for i in range(low, high, max(1, step)):
            if max(ends[high - 1] - starts[i], 0) < min_words:
                break
            after = min(i + step, high)
            value = whole[low:high, low:high] if whole is not None else values(i, after, i, high)
            row, j = divmod(int(value.argmax()), value.shape[1])
            if value[row, j] > -1 << 40 and (best is None or value[row, j] > best[0]):
                best = int(value[row, j]), i + row, i + j
        if best:
            _, i, j = best
            out.append(tuple(int(v) for v in (starts[i], ends[j], sources[i], source_ends[j], common[j + 1] - common[i])))
            todo += [(low, i), (j + 1, high)]
    return sorted(out)


_WANTED = ["chain", "id", "source", "pos", "source_pos", "size", "low", "high", "source_low", "source_high"]


def _narrow(table: DataFrame) -> DataFrame:
    """(id, words binary, others array<binary>): words by the first bytes of their hashes; where a key repeats, one row with all."""

    def narrow(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [np.frombuffer(w, np.uint8)[::4].tobytes() for w in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["id", "words"])

    twice = materialize(table.groupBy("id").count().where("count > 1").select("id"), "twice")
    some, once = apart(table, twice, "id")
    blocks = map_arrow(some, narrow, "id bigint, words binary").groupBy("id").agg(F.collect_list("words").alias("others"))
    return map_arrow(once, narrow, "id bigint, words binary").withColumn("others", F.lit(None).cast("array<binary>")).union(
        blocks.select("id", F.lit(None).cast("binary"), "others"))


def _beside(wanted: DataFrame, narrow: DataFrame) -> DataFrame:
    """``wanted`` with x and y: the narrow words from ``low`` to ``high`` on both sides."""
    for name, key, low, high in (("x", "id", "low", "high"), ("y", "source", "source_low", "source_high")):
        from_low = f"substring(%s, {low} + 1, {high} - {low})"
        wanted = wanted.join(narrow.withColumnRenamed("id", "of"), F.col(key) == F.col("of")).select(*wanted.columns, F.expr(
            f"if(others IS NULL, {from_low % 'words'}, array_max(transform(others, w -> {from_low % 'w'})))").alias(name))
    return wanted


def _slices(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chain, x binary, y binary): the words from ``low`` to ``high`` on both sides."""
    asked = wanted.select("chain", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("id").alias("of"), F.col("low").alias("low"), F.col("high").alias("high")),
        F.struct(F.lit(1).alias("side"), F.col("source").alias("of"), F.col("source_low").alias("low"),
                 F.col("source_high").alias("high")))).alias("s"))
    asked = asked.groupBy(F.col("s.of").alias("id")).agg(F.collect_list(F.struct("chain", "s.side", "s.low", "s.high")).alias("asked"))
    maybe, _ = apart(table, asked, "id")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, at = batch.column(1).to_pylist(), batch.column(2)
        flat, sizes = at.flatten(), at.value_lengths().to_pylist()
        sides, lows, highs = (flat.field(i).to_pylist() for i in (1, 2, 3))
        out, i = ([], []), 0
        for own, size in zip(words, sizes, strict=True):
            for j in range(i, i + size):
                piece = own[4 * lows[j]:4 * highs[j]]
                out[sides[j]].append(piece)
                out[1 - sides[j]].append(None)
            i += size
        return pa.RecordBatch.from_arrays([flat.field(0), *(pa.array(c, pa.binary()) for c in out)], ["chain", "x", "y"])

    pieces = _by_some(maybe.join(asked, "id").select("id", "words", "asked"), rows, "chain bigint, x binary, y binary")
    return pieces.groupBy("chain").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def repeated_passages(docs: DataFrame, min_words: int = 50, percent: int = 80, key: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """(id, start_word, n_words, source_id, source_start, source_words, similarity): passages met in an earlier document.

    A passage has at least ``min_words`` words, and of the words of its longer side
    at least ``percent`` in a hundred align.  Its source is an occurrence in a
    document with a smaller key, so the first occurrence of a passage is not
    listed.  A passage inside another one of the same document is not listed apart:
    every word that is in a passage is in one of the rows, with one source.  Repeats within one document are not listed.  Null and empty texts
    have no passages; rows with a null key take no part.  Keys are whole numbers.
    Rows that repeat a key count as one document; where their texts differ, the
    greater of two blocks of words is aligned.  An empty table gives an empty
    table; other columns are not read.
    """
    table = materialize(_word_table(docs, key, text), "words")
    with scratch(docs.sparkSession):
        narrow = materialize(_narrow(table), "narrow")
        seeds = materialize(seed_matches(table, min_words), "matches")
        runs = exact(table, seeds.where(F.col("kind") == AGAIN), min_words)
        met = chained(seeds.where(F.col("kind") == MET), runs, min_words)
        found = materialize(_maximal(_aligned(table, narrow, met, min_words, percent)), "found", keep=True)
        frequent = seeds.where(F.col("kind") == FREQUENT).select(F.explode(F.arrays_zip("id", "pos", "hash")).alias("at")).select("at.*")
        rest = chained(left_out(frequent, found, _buckets(table)), None, min_words)
        more = materialize(_aligned(table, narrow, rest, min_words, percent), "more", keep=True)
    return _maximal(found.union(more))


def _maximal(found: DataFrame) -> DataFrame:
    """The passages without those inside another one of the document, which need no source of their own."""
    end = F.col("start_word") + F.col("n_words")
    before = (W.partitionBy("id").orderBy("start_word", F.desc("n_words"), "source_id", "source_start")
              .rowsBetween(W.unboundedPreceding, -1))
    return found.withColumn("far", F.max(end).over(before)).where(F.col("far").isNull() | (F.col("far") < end)).drop("far")


def _aligned(table: DataFrame, narrow: DataFrame, found: DataFrame, min_words: int, percent: int) -> DataFrame:
    """The passages of ``repeated_passages`` along these chains."""
    margin = EXTEND + SEED
    chain = F.xxhash64("id", "source", "pos", "source_pos")
    side = [e for name, column in (("", "pos"), ("source_", "source_pos")) for e in (
        F.greatest(F.lit(0), F.element_at(column, 1) - margin).alias(f"{name}low"),
        (F.element_at(column, -1) + F.element_at("size", -1) + margin).alias(f"{name}high"))]
    links = materialize(found.select(chain.alias("chain"), "*", *side), "chains")
    least = -(-percent * min_words // 100)

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        low, source_low = (batch.column(i).to_numpy() for i in (6, 8))
        inner = np.stack([batch.column(i).to_numpy() for i in (10, 11, 12, 13)], 1) - np.stack([low, low, source_low, source_low], 1)
        x, y = ([v or b"" for v in batch.column(i).to_pylist()] for i in (14, 15))
        kept = may_align(x, y, inner) >= least
        some = np.flatnonzero(kept)
        kept[some] = may_pass([x[i] for i in some], [y[i] for i in some], inner[some], min_words, percent)
        return batch.select(_WANTED).filter(pa.array(kept))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for _, id_, source, pos, source_pos, sizes, low, _, source_low, _, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = (np.frombuffer(v or b"", "<u4").tolist() for v in (x, y))
            at = [(p - low, s - source_low, n) for p, s, n in zip(pos, source_pos, sizes, strict=True)
                  if p - low + n <= len(x) and s - source_low + n <= len(y)]
            for start, end, source_start, source_end, common in judged(align(x, y, at, least) if at else [], min_words, percent):
                out.append((id_, start + low, end - start, source, source_start + source_low, source_end - source_start,
                            common / max(end - start, source_end - source_start)))
        columns = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.float64())],
            ["id", "start_word", "n_words", "source_id", "source_start", "source_words", "similarity"])

    wanted = links.where("NOT exact").select(*_WANTED)
    # One byte a word is enough to tell most chains that are too short: equal words have equal bytes.
    ends = [e for c in ("pos", "source_pos") for e in (F.element_at(c, 1), F.array_max(F.zip_with(c, "size", lambda p, n: p + n)))]
    both = _beside(wanted.select("*", *(e.alias(f"end{i}") for i, e in enumerate(ends))), narrow)
    some = materialize(_by_some(both, likely, wanted.schema.simpleString()[7:-1]), "likely")
    aligned = _by_some(some.join(_slices(table, some), "chain").select(*_WANTED, "x", "y"), rows,
                        "id bigint, start_word bigint, n_words bigint, source_id bigint, source_start bigint, "
                        "source_words bigint, similarity double")
    first = [F.element_at(c, 1).cast("bigint") for c in ("pos", "size", "source_pos")]
    return aligned.union(links.where("exact").select("id", first[0], first[1], "source", first[2], first[1], F.lit(1.0)))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words in the spans (first word, words after the last) and the white space after them."""
    data = text.encode("utf-8", "surrogatepass")
    starts = [m.start() for m in _WORD.finditer(data)] + [len(data)]
    out, at = [], 0
    for first, after in sorted(spans):
        begin, end = starts[min(first, len(starts) - 1)], starts[min(after, len(starts) - 1)]
        if end > at:
            out.append(data[at:max(at, begin)])
            at = end
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def without_passages(docs: DataFrame, min_words: int = 50, percent: int = 80, key: str = "doc_id", text: str = "text",
                     size: str | None = "n_chars") -> DataFrame:
    """The documents, with all their columns, without the passages met in earlier documents.

    Every document stays a row, be its text empty then.  The column ``size``, if
    there is one, gets the number of characters that are left.
    """
    found = repeated_passages(docs, min_words, percent, key, text)
    spans = materialize(found.groupBy(F.col("id").alias(key)).agg(F.collect_set(F.struct(
        F.col("start_word").alias("a"), (F.col("start_word") + F.col("n_words")).alias("b"))).alias("_spans")), "spans")
    maybe, clean = apart(docs, spans, key)
    joined = maybe.join(spans, key, "left").select(*docs.columns, "_spans")
    at = docs.columns.index(text)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t if s is None or t is None else cut_words(t, [(x["a"], x["b"]) for x in s])
                 for t, s in zip(batch.column(at).to_pylist(), batch.column(len(docs_columns)).to_pylist(), strict=True)]
        columns = list(batch.columns[:-1])
        columns[at] = pa.array(texts, columns[at].type)
        if size in docs_columns:
            own = docs_columns.index(size)
            touched = [s is not None for s in batch.column(len(docs_columns)).to_pylist()]
            columns[own] = pa.array([len(t) if hit and t is not None else old for t, hit, old in
                                     zip(texts, touched, columns[own].to_pylist(), strict=True)], columns[own].type)
        return pa.RecordBatch.from_arrays(columns, docs_columns)

    docs_columns = docs.columns
    return map_arrow(joined, rows, docs.schema).union(clean)
