"""Near-duplicates, passages and benchmark items beside plain versions."""

import random
import re
from collections import Counter

from urlrisk.llm import decontam, neardup, passages

SPACE = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return SPACE.findall((text or "").encode().lower())


def shingle_list(text, size):
    own = words(text)
    size = min(size, len(own))
    return [tuple(own[i:i + size]) for i in range(len(own) - size + 1)] if size else []


def classes(rows, size, percent):
    """component of every id, by comparing all pairs"""
    sets = {}
    for key, text in rows:
        if key is not None:
            sets.setdefault(key, []).append(set(shingle_list(text, size)))
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return {k: top(k) for k in keys}


def mutated_copies():
    pick = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    licence = [pick.choice(vocabulary) for _ in range(60)]
    rows, key = [], 0
    for group in range(25):
        base = [pick.choice(vocabulary) for _ in range(pick.randint(3, 150))]
        if group % 5 == 0:
            base = licence + base
        for _ in range(pick.choice([1, 2, 5, 9])):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 4, 8])):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append((key, " ".join(copy)))
            key += 1
    pick.shuffle(rows)
    return rows


def test_components_of_near_duplicates(spark, odd):
    for rows, size, percent in ((mutated_copies(), 3, 85), (mutated_copies(), 5, 80),
                                ([(r.doc_id, r.text) for r in odd.collect()], 3, 85)):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = neardup.near_duplicates(docs, size, percent).collect()
        want = classes(rows, size, percent)
        assert len(got) == len(rows)
        texts = {}
        for key, text in rows:
            texts.setdefault(key, text)
        for row in got:
            assert row.component_id == want.get(row.doc_id)
            assert row.kept == (row.doc_id is None or row.doc_id == row.component_id)
            if row.doc_id is not None:
                assert row.n_shingles == len(set(shingle_list(texts[row.doc_id], size)))


def large_family():
    """Copies of one text with so many changes that only some are alike, copies of some of them, and shortened ones."""
    pick = random.Random(17)
    fresh = lambda n: [f"u{pick.randrange(10**9)}" for _ in range(n)]
    base = fresh(150)
    texts = [base]
    for _ in range(240):
        copy = list(pick.choice(texts[:1] * (9 * len(texts)) + texts))
        for at in pick.sample(range(len(copy)), pick.randint(2, 7)):
            copy[at] = pick.choice((fresh(1)[0], "other"))
        texts.append(copy[:pick.choice((len(copy), len(copy), len(copy) - 4))])
    return list(enumerate(" ".join(t) for t in texts))


def test_large_families_meet_few_pairs(spark, monkeypatch):
    """Most members of a family are compared with its pivot only, and no link is lost."""
    rows, compared, similar = large_family(), [], neardup._similar
    monkeypatch.setattr(neardup, "_similar", lambda pairs, *rest: compared.append(pairs.count()) or similar(pairs, *rest))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 3, 85).collect()}
    want = classes(rows, 3, 85)
    assert 20 < len(set(want.values())) < len(rows)
    assert got == want
    assert sum(compared) <= 10 * len(rows)


def test_one_of_each_group_stays(spark, odd):
    kept = neardup.without_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id != 6)
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def planted():
    pick = random.Random(11)
    fresh = lambda n: [f"u{pick.randrange(10**9)}" for _ in range(n)]
    passage, changed = fresh(70), None
    changed = list(passage)
    for at in (15, 40, 55):
        changed[at] = "other"
    rows = [(0, fresh(40) + passage + fresh(30)), (1, fresh(10) + passage + fresh(5)), (2, fresh(25) + changed),
            (3, fresh(120)), (4, passage[:30] + fresh(60)), (5, fresh(60))]
    return [(k, " ".join(t)) for k, t in rows]


def test_passages_are_found_and_cut(spark, odd):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string").selectExpr("*", "length(text) AS n_chars")
    spans = {}
    for r in passages.repeated_passages(docs).collect():
        spans.setdefault(r.id, []).append(r)
    assert sorted(spans) == [1, 2]
    assert any(r.start_word == 10 and r.n_words == 70 and r.source_id == 0 and r.similarity == 1 for r in spans[1])
    assert all(abs(r.start_word - 25) <= 1 and r.n_words >= 66 for r in spans[2] if r.source_id == 0)
    cut = {r.doc_id: r for r in passages.without_passages(docs).collect()}
    before = dict(planted())
    assert len(words(cut[1].text)) == 15
    assert all(cut[k].text == before[k] for k in (0, 3, 4, 5))
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert passages.without_passages(odd).count() == odd.count()
    assert passages.repeated_passages(odd.limit(0)).count() == 0


def test_exact_passages_beside_other_matches(spark):
    """A passage stays one when the same two documents also share something a few dozen words on."""
    pick = random.Random(5)
    fresh = lambda n: [f"u{pick.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for key in range(0, 120, 2):
        first, second = fresh(55), fresh((17, 55)[key % 4 // 2])
        gap = (25, 40)[key % 8 // 4]
        rows.append((key, fresh(30) + first + fresh(gap) + second + fresh(30)))
        rows.append((key + 1, fresh(30) + first + fresh(gap) + second + fresh(30)))
        want[key + 1] = [(30, 55)] + [(85 + gap, 55)] * (len(second) == 55)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")
    got = {}
    for r in passages.repeated_passages(docs).collect():
        got.setdefault(r.id, []).append((r.start_word, r.n_words))
    for key, spans in want.items():
        assert all(any(a <= start and start + n <= a + m for a, m in got.get(key, [])) for start, n in spans)


def uncovered(rows, found, n=50):
    """(document, place) of words in runs of n that an earlier document has and in no found passage, by comparing all."""
    first, out = {}, set()
    for key, text in sorted(rows):
        own = words(text)
        inside = {i for r in found if r.id == key for i in range(r.start_word, r.start_word + r.n_words)}
        for at in range(len(own) - n + 1):
            if first.setdefault(tuple(own[at:at + n]), key) < key:
                out |= {(key, i) for i in range(at, at + n) if i not in inside}
    return sorted(out)


def test_passages_made_of_frequent_lines(spark):
    """Lines that many documents hold in varying surroundings, and a few one after the other."""
    pick = random.Random(8)
    fresh = lambda n: [f"u{pick.randrange(10**9)}" for _ in range(n)]
    lines, rows = [fresh(n) for n in (27, 27, 40, 12)], []
    for key in range(500):
        parts = pick.sample(lines, pick.randint(1, 2))
        if key % 20 == 0:
            start = pick.choice([0, 2])
            parts = [lines[start] + lines[start + 1]]
        rows.append((key, " ".join(sum((fresh(pick.randint(1, 20)) + p for p in parts), []) + fresh(5))))
    rows += [(600, "a " * 300), (601, "b c " * 200), (602, "a " * 260 + "b c " * 70)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert uncovered(rows, passages.repeated_passages(docs).collect()) == []


def test_changed_passages(spark):
    """Substituted words at random or even places; the share found is printed by length and changes."""
    pick = random.Random(9)
    fresh = lambda n: [f"u{pick.randrange(10**9)}" for _ in range(n)]
    rows, kinds = [], {}
    for size, changes in ((60, 3), (60, 6), (60, 12), (80, 8), (120, 18), (200, 30)):
        for even in (False, True):
            for _ in range(50):
                key, passage = len(rows), fresh(size)
                changed = list(passage)
                for i in (range(size // changes // 2, size, size // changes) if even else pick.sample(range(size), changes)):
                    changed[i] = "other"
                rows += [(key, fresh(30) + passage + fresh(30)), (key + 1, fresh(40) + changed + fresh(40))]
                kinds[key + 1] = size, changes, even
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in rows], "doc_id bigint, text string")
    found = {r.id for r in passages.repeated_passages(docs).collect() if r.source_id == r.id - 1}
    share = {kind: sum(k in found for k in kinds if kinds[k] == kind) / 50 for kind in dict.fromkeys(kinds.values())}
    print(share)
    assert all(s >= 0.95 for (size, changes, _), s in share.items() if 100 * changes <= 15 * size)


def frequent_and_changed():
    """Documents with frequent lines in varying surroundings; in some of them two lines follow each other, with changed words."""
    pick = random.Random(21)
    fresh = lambda n: [f"u{pick.randrange(10**9)}" for _ in range(n)]
    lines, rows, joined = [fresh(30) for _ in range(6)], [], {}
    for key in range(600):
        if key % 20 == 10:
            first = pick.randrange(6)
            second = (first + 1 + key // 20 % 2) % 6
            passage = lines[first] + lines[second]
            for at in range(10, 60, 20):
                passage[at + pick.randrange(-3, 4)] = fresh(1)[0]
            rows.append((key, " ".join(fresh(20) + passage + fresh(20))))
            joined.setdefault((first, second), []).append(key)
        else:
            parts = pick.sample(lines, 2)
            rows.append((key, " ".join(sum((fresh(pick.randint(30, 50)) + p for p in parts), []) + fresh(5))))
    return rows, {key for keys in joined.values() for key in keys[1:]}


def test_changed_passages_of_frequent_lines(spark):
    """The only earlier document with both lines is neither the first holder of a seed nor the one before."""
    rows, again = frequent_and_changed()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.id for r in passages.repeated_passages(docs).collect() if r.n_words >= 50}
    assert len(again) > 10 and again <= found


def test_copies_are_listed_once(spark):
    """A group of copies gives one row for each copy, not one for each pair."""
    pick = random.Random(4)
    text = " ".join(f"u{pick.randrange(10**9)}" for _ in range(120))
    docs = spark.createDataFrame([(k, text) for k in range(60)], "doc_id bigint, text string")
    got = sorted((r.id, r.start_word, r.n_words, r.source_id) for r in passages.repeated_passages(docs).collect())
    assert got == [(k, 0, 120, 0) for k in range(1, 60)]


def test_long_matches_overlap_nothing_in_their_chain():
    at = [(0, 0, 20), (4, 4, 4), (12, 12, 50)]
    assert [(12, 12, 50)] in passages.chains(at, 50)


def held(docs, items, size=5, percent=80):
    """(document, item) by comparing every window"""
    out = set()
    for key, text in docs:
        own = words(text)
        for item, passage in items:
            length = min(len(words(passage)), len(own))
            if item is None or not length:
                continue
            bag = Counter(shingle_list(passage, size))
            for start in range(len(own) - length + 1):
                window = Counter(shingle_list(b" ".join(own[start:start + length]).decode(), size))
                if 100 * (bag & window).total() >= percent * (bag | window).total():
                    out.add((key, item))
                    break
    return out


def test_items_in_documents(spark, odd):
    pick = random.Random(2)
    items = [(i, " ".join(pick.choice("abcdefghijklmnopqrstuvwxyz") * pick.randint(1, 4) for _ in range(n)))
             for i, n in enumerate((3, 8, 20, 40, 40, 60))] + [(90, ""), (91, None), (None, "a row without a key")]
    docs = []
    for key in range(40):
        text = [f"v{pick.randrange(999)}" for _ in range(pick.randint(0, 30))]
        if key % 2:
            body = words(items[key // 2 % 6][1])
            for _ in range(key % 3):
                body[pick.randrange(len(body))] = b"changed"
            text += [w.decode() for w in body]
        docs.append((key, " ".join(text + [f"v{pick.randrange(999)}" for _ in range(5)])))
    docs += [(r.doc_id, r.text) for r in odd.collect()]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = held(docs, items)
    assert len(want) > 5
    for group_words in (1_000_000, 50):  # one group of items, and several
        got = decontam.contaminated(frame, bench, group_words=group_words)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    clean = decontam.without_items(frame, bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(k) for k, t in docs if not held([(k, t)], items))
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0
    assert decontam.contaminated(odd.limit(0), bench).count() == 0


def common_places(a, b):
    """The places of equal words of two lists in a longest order, from the ends, by the whole table of lengths."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1], rows


def test_words_in_order_beside_a_plain_table():
    pick = random.Random(3)
    for kinds in (2, 6, 40):
        pairs = [[[pick.randrange(kinds) for _ in range(pick.randrange(65))] for _ in range(2)] for _ in range(60)]
        bounds = passages.in_order(*([bytes(pair[k]) for pair in pairs] for k in (0, 1)))
        for (a, b), most in zip(pairs, bounds.tolist(), strict=True):
            places, rows = common_places(a, b)
            assert a == b or passages._equal(a, b) == places
            assert most[:len(a) + 1] == [row[-1] for row in rows]


def test_no_chain_with_a_passage_is_left_out():
    """Copies of a passage with changes of all kinds around a line: chains are dropped only where judging finds nothing."""
    pick = random.Random(6)
    x, y, inner, want = [], [], [], []
    for _ in range(600):
        line = [pick.randrange(256) for _ in range(pick.choice((4, 20, 38, 45)))]
        sides = [[pick.randrange(40) for _ in range(52)] for _ in range(2)]
        share = pick.choice((0, 0.3, 0.6, 0.9))
        other = [[v if pick.random() < share else pick.randrange(40) for v in side] for side in sides]
        shift = pick.randrange(8)
        other[0] = other[0][shift:] + [7] * shift
        x.append(sides[0] + line + sides[1])
        y.append(other[0] + line + other[1])
        inner.append((52, 52 + len(line), 52, 52 + len(line)))
        want.append(bool(passages.judged(passages.align(x[-1], y[-1], [(52, 52, len(line))]), 50, 80)))
    kept = passages.may_pass([bytes(v) for v in x], [bytes(v) for v in y], inner, 50, 80).tolist()
    assert 100 < sum(want) <= sum(kept) < 500
    assert all(k for k, w in zip(kept, want, strict=True) if w)


def test_holders_of_frequent_lines_are_told_by_the_order_of_words(spark, monkeypatch):
    """All pairs of documents with two frequent lines meet; words around them that are the same in another order align none of them."""
    pick = random.Random(12)
    lines = [[f"{name}{i}" for i in range(14)] for name in "pq"]
    common = [f"w{i}" for i in range(52)]
    rows = []
    for key in range(60):
        around = [pick.sample(common, 52) for _ in range(3)]
        rows.append((key, " ".join(around[0] + lines[0] + around[1][:10] + lines[1] + around[2])))
    aligned, materialize = [], passages.materialize

    def counted(df, name="table", *rest, **named):
        out = materialize(df, name, *rest, **named)
        if name == "likely":
            aligned.append(out.count())
        return out

    monkeypatch.setattr(passages, "materialize", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert uncovered(rows, passages.repeated_passages(docs).collect()) == []
    assert len(aligned) == 2 and sum(aligned) < 60 * 59 // 8
