import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandworks.llm.tokenization import DEFAULT_VOCABULARY, PATTERN, Encoder, PerfectHash, encode_corpus, merge_bytes, read_vocabulary

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def encoder():
    tokens = read_vocabulary()
    return Encoder(tokens, PerfectHash(tokens))


def test_hash_is_minimal_and_perfect(encoder):
    assert encoder.table.lookup(encoder.tokens).tolist() == list(range(len(encoder.tokens)))
    assert sorted(encoder.table.slots.tolist()) == list(range(len(encoder.tokens)))


def test_every_token_is_its_own_merge(encoder):
    assert all(merge_bytes(t, encoder.ranks) == [i] for i, t in enumerate(encoder.tokens))


def test_equals_public_libraries_and_round_trips(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    public = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=["Cs"]), max_size=80))
    def check(text):
        (ids,) = encoder.encode([text])
        assert ids == public.encode_ordinary(text)
        assert b"".join(encoder.tokens[i] for i in ids).decode() == text

    check()
    long = "日本語ภาษาไทย" * 3000 + " <|endoftext|> " + "a" * 5000
    assert encoder.encode([long, long])[1] == public.encode_ordinary(long)


def test_corpus(spark, encoder):
    rows = [(1, "Hello world"), (2, ""), (3, None), (1, "Hello world"), (4, "  \n"), (None, "x")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in encode_corpus(df).collect()]
    assert got == [(k, encoder.encode([t])[0]) for k, t in rows] and got[1] == (2, []) and got[2] == (3, [])
    assert encode_corpus(df.limit(0)).count() == 0
