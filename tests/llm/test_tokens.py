"""Encodings and prefix counts beside the public libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from urlrisk.llm import bpe, prefix
from urlrisk.llm.bpe import coder
from urlrisk.llm.prefix import counter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def reference_bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(many=300):
    pick = random.Random(5)
    letters = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "東", "😀", "'s", "'LL", "123", "!!", "▁", " ", "A", "x" * 40]
    return ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(many)]


def test_ids_are_those_of_the_library(documents):
    enc, own = reference_bpe(), coder(RANKS, public_tokenizers.PATTERN)
    texts = [r.text for r in documents.select("text").where("text IS NOT NULL").toLocalIterator()] + random_texts()
    for text in texts:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == enc.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()


def test_round_trip_digests(odd):
    enc = reference_bpe()
    rows = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for row in odd.select("doc_id", "text").collect():
        ids = enc.encode_ordinary(row.text or "")
        want.append((row.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((row.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, (r.text for r in back))) == sorted(str(r.text or "") for r in odd.collect())
    assert bpe.round_trip(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_counts_at_every_prefix():
    model, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), counter(MODEL)
    for text in random_texts(60) + ["Hello world, these are tokens.", "  two  spaces ", "▁▁x"]:
        counts = own.prefixes(text).tolist()
        assert counts == [len(model.encode(text[:i])) for i in range(1, len(text) + 1)], repr(text)
        assert own.total(text) == len(model.encode(text))
        for limit in (0, 1, 5, 17):
            fits = [i for i, c in enumerate([0, *counts]) if c <= limit]
            assert own.longest(text, limit) == max(fits)


def test_budgets_of_whole_documents(documents, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for docs in (documents, odd):
        got = prefix.budgets(docs, MODEL, 300).drop("fit_chars").collect()
        want = []
        for row in docs.select("doc_id", "text").collect():
            n = len(model.encode(row.text or ""))
            want.append((row.doc_id, len((row.text or "").encode()), n, n > 300))
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert prefix.budgets(odd.limit(0), MODEL, 300).count() == 0


def test_questions_to_stored_counts(odd):
    own = counter(MODEL)
    stored = prefix.prefix_counts(odd.where("doc_id IN (1, 2, 7)"), MODEL)
    texts = {r.doc_id: r.text or "" for r in odd.where("doc_id IN (1, 2, 7)").collect()}
    for row in stored.select("doc_id", prefix.tokens_at(F.col("counts"), F.lit(9)).alias("t"),
                             prefix.longest_within(F.col("counts"), 6).alias("w")).collect():
        text = texts[row.doc_id]
        assert row.t == (own.total(text[:9]) if len(text) >= 9 else None)
        assert row.w == own.longest(text, 6)
