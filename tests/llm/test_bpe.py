import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftbase.llm import bpe
from siftbase.llm.bpe import VOCABULARY, encode_corpus, encoder

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def known():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


CASES = [
    None, "", " ", "\n\n  \t", "<|endoftext|>", "aaaaaaaaaaa" * 50, "ab" * 700, " " * 1000 + "x", "é" * 400, "日本語" * 300, "👩‍🔧🌱", "\x00\x1c\x1d\x85 a",
    "x" * 20_000, "The quick brown fox's don't 12345 ½ ٣٤", "a\r\nb c　d", "=" * 333 + "-" * 130,
]


def test_cases(known):
    assert encoder(VOCABULARY).encode(CASES) == [known.encode_ordinary(t) if t else [] for t in CASES]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab \n'st=", max_size=400)), max_size=8))
def test_any_text(known, texts):
    assert encoder(VOCABULARY).encode(texts) == [known.encode_ordinary(t) if t else [] for t in texts]


def test_short_rows_only_in_matrices(known, monkeypatch):
    monkeypatch.setattr(bpe, "LONGEST_ROW", 4)
    enc = bpe.Encoder(VOCABULARY)
    assert enc.encode(CASES) == [known.encode_ordinary(t) if t else [] for t in CASES]


def test_table(spark, known, monkeypatch):
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(CASES)] + [(None, "null id", 0), (1, "", 9)], "doc_id long, text string, ids int").repartition(3)
    got = sorted(((r["doc_id"] is None, r["doc_id"], r["ids"]) for r in encode_corpus(df, "doc_id", "text").collect()), key=str)
    want = [(False, i, known.encode_ordinary(t) if t else []) for i, t in enumerate(CASES)] + [(True, None, known.encode_ordinary("null id")), (False, 1, [])]
    assert got == sorted(want, key=str)
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counts = encode_corpus(df, "doc_id", "text", counts_only=True)
    assert sum(r["n_tokens"] for r in counts.collect()) == sum(len(x[2]) for x in want)
