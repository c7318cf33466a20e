import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import bpe

RANKS, PATTERN = bpe.default_vocabulary()
PLAIN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(RANKS, PATTERN)


def same(texts):
    for t, got in zip(texts, CODEC.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == PLAIN.encode_ordinary(t), t
        assert CODEC.decode(got) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(), max_size=8))
def test_any_text(texts):
    same(texts)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("aehinorst'AÉé .0\n", max_size=60), max_size=8))
def test_many_merges(texts):
    same(texts)


def test_long_pieces_and_runs():
    same(["", "a" * 3001, "ab" * 900 + "c", "0" * 777, " " * 500, "é" * 400, "<|endoftext|>", "abcabcabd" * 300, "x" * 200_000])


def test_vocabulary_where_a_pair_makes_a_lower_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"xa": 256, b"abc": 257, b"ab": 300, b"bc": 299, b"aa": 301}
    plain = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, r"\w+")
    texts = ["abc", "xabc", "aabc", "abcabc", "aaaa", "aaabc", "aaaaabcbc"]
    for t, got in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain.encode_ordinary(t)


def test_query_and_round_trip(spark, tmp_path):
    texts = [None, "", "One two, two.", "One two, two.", "ü" * 9000, "\x00 tab\t"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for r in bpe.op9_bpe(spark, str(tmp_path)).collect():
        t = texts[r.doc_id] or ""
        ids = PLAIN.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS).collect()
    assert [bytes(r.decoded).decode() for r in back] == [t or "" for t in texts]
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0
    assert bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_vocabularies_that_differ_late_have_codecs_of_their_own(spark):
    """Two tables of one size whose first entries agree, used by the same Python processes."""
    swapped = dict(RANKS)
    last = sorted(RANKS.values())[-400:]
    token = {r: t for t, r in RANKS.items()}
    for r, other in zip(last, reversed(last), strict=True):
        swapped[token[r]] = other
    assert bpe._digest(RANKS) != bpe._digest(swapped) == bpe._digest(dict(reversed(swapped.items())))
    text = " ".join(token[r].decode("utf-8", "replace") for r in last)
    df = spark.createDataFrame([(text,)] * 4, "text string").repartition(4)
    for ranks in (RANKS, swapped, RANKS):
        want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
        for r in bpe.encode(df, ranks, PATTERN).collect():
            assert np.frombuffer(r.ids, "<u4").tolist() == want
