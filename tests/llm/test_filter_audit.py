"""The filter audit beside plain counting, its matrix beside plain word counts."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from urlrisk.llm import filter_audit, registered
from urlrisk.llm.filter_audit import audit, matrix, row_statistics, rows_of

SF = "/root/testdata/sf0.001"


def plain(docs, labels):
    """Each document through each order, one filter after the other."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = defaultdict(lambda: [0] * 7)
    shapley = Counter()
    holders = defaultdict(list)
    for d, _, text in docs:
        holders[text or ""].append(d)
    for d, lang, text in docs:
        text, part = text or "", lang or ""
        words = text.encode().split()
        fails = {f for f, x in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text), re.search("[#$%&*|]", text) is not None,
            d is not None and any(o is not None and o < d for o in holders[text])), strict=True) if x}
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, "".join(order), step]
                if f in fails:
                    row[2 if gone else 1] += 1
                    row[3] += fails == {f}
                    if not gone:
                        row[4] += d in good
                        row[5] += d in toxic
                        shapley[part, f] += 1
                    gone = True
                row[0] += not gone
    return {(*k, *v[:6], shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def as_rows(df):
    return {(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
            for r in df.collect()}


def test_given_documents(spark, documents, labels):
    docs = [tuple(r) for r in documents.select("doc_id", "lang", "text").collect()]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert as_rows(registered.op11_filter_audit(spark, SF)) == plain(docs, marks)


def test_odd_rows_and_small_shards(spark, monkeypatch):
    docs = [(3, "en", "a b"), (1, "en", "a b"), (1, "en", "a b"), (None, "en", "a b"), (4, None, None), (5, "", ""), (6, "de", " \t"),
            (7, "de", "A# " * 120), (8, "en", " ".join(f"w{i}" for i in range(150))), (9, "en", "x" * 500 + " " + "x" * 500),
            (9, "en", None), (10, "fr", "ÄÖ Ü" * 30), (11, "de", "A# " * 120)]
    marks = [(1, 1, 0), (1, 0, 1), (7, None, 1), (None, 1, 1), (99, 1, 1)]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, lang string, text string, n_words string")
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    for words in (1, 7, 1 << 20):
        monkeypatch.setattr(filter_audit, "SHARD_WORDS", words)
        assert as_rows(audit(table, labels)) == plain(docs, marks)
    assert audit(table.limit(0), labels).count() == 0


def test_matrix_equals_word_counts(spark, documents, monkeypatch):
    """Each column is one word of the whole table, and rows hold its counts."""
    monkeypatch.setattr(filter_audit, "SHARD_WORDS", 5000)
    shards, drop = matrix(documents, "text", ["doc_id"])
    found, columns = {}, set()
    for s in shards.collect():
        indptr, indices, data = (a.tolist() for a in rows_of(s.indptr, s["indices"], s["data"]))
        for i, doc in enumerate(s.doc_id):
            row = slice(indptr[i], indptr[i + 1])
            found[doc] = dict(zip(indices[row], data[row], strict=True))
            columns |= set(indices[row])
    want = {r.doc_id: Counter((r.text or "").encode().split()) for r in documents.select("doc_id", "text").collect()}
    assert len(columns) == len(set().union(*want.values()))
    assert {d: sorted(c.values()) for d, c in found.items()} == {d: sorted(c.values()) for d, c in want.items()}
    held = defaultdict(set), defaultdict(set)
    for side, rows in zip(held, (found, want), strict=True):
        for d, row in rows.items():
            for c, n in row.items():
                side[c].add((d, n))
    assert sorted(map(sorted, held[0].values())) == sorted(map(sorted, held[1].values()))
    statistics = {r.doc_id: (r.n_words, r.n_distinct) for r in row_statistics(shards, ["doc_id"]).collect()}
    assert statistics == {d: (sum(c.values()), len(c)) for d, c in want.items()}
    drop()
