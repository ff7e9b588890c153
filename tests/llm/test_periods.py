"""Periodic runs beside all periods at all places."""

import hashlib
import random
import zlib

from urlrisk.llm import periods, registered
from urlrisk.llm.periods import Catchers, periodic_runs, runs_of, split_words, without_repeats

WHITE = b" \t\n\x0b\x0c\r"


def plain_runs(words, least=6, times=4):
    """Every period, every place."""
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = j + 1 if j > i else i + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def some_words(pick, most=150):
    words = [pick.randrange(pick.choice([1, 2, 3, 5])) for _ in range(pick.randint(0, most))]
    for _ in range(pick.randint(0, 4)):
        if len(words) > 8:
            a, p = pick.randrange(len(words)), 1 + pick.randrange(len(words) // 4)
            for i in range(a, min(len(words), a + p * pick.randint(3, 7) + pick.randint(0, p))):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_all_periods():
    pick = random.Random(1)
    for _ in range(4000):
        words = some_words(pick)
        assert runs_of(words) == plain_runs(words), words
        least, times = pick.choice([(6, 4), (10, 4), (6, 5), (1, 6)])
        assert runs_of(words, least, times) == plain_runs(words, least, times), words


def test_catchers_are_online():
    """After each word the runs are those of the words so far."""
    pick = random.Random(2)
    for _ in range(60):
        words = some_words(pick, 40)
        for n in range(len(words) + 1):
            catchers = Catchers()
            for w in words[:n]:
                catchers.append(w)
            assert catchers.finish() == plain_runs(words[:n])


def test_long_runs_of_every_period():
    for q in [*range(1, 40), 63, 64, 65, 127, 129, 500]:
        for shift in (0, 1, 7, q):
            words = [-1 - i for i in range(shift)] + [i % q for i in range(4 * q + 5)] + [-5000]
            assert runs_of(words) == plain_runs(words) == [(shift, 4 * q + 5, q)], (q, shift)
    assert runs_of([0] * 100_000) == [(0, 100_000, 1)]


def test_kept_words():
    pick = random.Random(3)
    for _ in range(500):
        words = some_words(pick)
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert without_repeats(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def test_huge_texts_are_split_in_pieces(monkeypatch):
    pick = random.Random(4)
    texts = [bytes(pick.choice(b"ab \t\n\xc3\xa9") for _ in range(pick.randint(0, 300))) for _ in range(300)]
    for size in (1, 7, 64):
        monkeypatch.setattr(periods, "_PIECE", size)
        assert [split_words(t) for t in texts] == [t.split() for t in texts]


def plain_row(doc_id, text):
    """The contract, word by word."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_equals_the_plain_version(spark):
    got = {tuple(r) for r in registered.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {plain_row(*r) for r in docs if len((r.text or "").split()) < 1200}
    assert want <= got and len(got) == len(docs)
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark, odd):
    more = odd.unionByName(spark.createDataFrame(
        [(20, "a b " * 9 + "c"), (20, "a b " * 9 + "c"), (21, "x " * 6), (22, "x " * 5), (23, "p q r s " * 400_000)],
        "doc_id bigint, text string"), allowMissingColumns=True)
    rows = periods.digest(periodic_runs(more, rewrite=registered._repeating)).collect()
    want = [plain_row(r.doc_id, r.text) for r in more.select("doc_id", "text").collect() if r.doc_id != 23]
    assert sorted((tuple(r) for r in rows if r.doc_id != 23), key=str) == sorted(want, key=str)
    assert [tuple(r)[1:6] for r in rows if r.doc_id == 23] == [(1, 0, 1_600_000, 4, 400_000_000)]
    assert periodic_runs(odd.limit(0)).count() == 0
