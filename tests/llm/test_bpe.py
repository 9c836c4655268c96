import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

bpe = pytest.importorskip("corvane.llm.bpe")
if not os.path.exists(bpe.VOCABULARY):
    pytest.skip("no vocabulary", allow_module_level=True)
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return bpe.Vocabulary.load(), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [None, "", " ", "\n\n", "a" * 5000, "aaab" * 700, "<|endoftext|>", "it's  we'll　x", "∃hasFeature.(A ⊓ B)", "🚢✅ naïve café", "0123456789" * 50, "é", "​"]


def test_against_the_library(both):
    vocab, reference = both
    offsets, flat = vocab.encode(TEXTS)
    for i, t in enumerate(TEXTS):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == reference.encode_ordinary(t or "")


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    text = text.encode("utf-8", "ignore").decode()
    vocab, reference = both
    offsets, flat = vocab.encode([text, text])
    assert flat[: offsets[1]].tolist() == reference.encode_ordinary(text) == flat[offsets[1] :].tolist()
    assert reference.decode(flat[: offsets[1]].tolist()) == text


def test_table(spark, both):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, "x", None), (0, "x", None)], "doc_id long, text string, ids array<int>")
    got = bpe.encode_corpus(df).collect()
    assert len(got) == len(TEXTS) + 2 and all(isinstance(r.ids, list) for r in got)
    assert [r.ids for r in got if r.doc_id in (1,)] == [[]]
    assert bpe.encode_corpus(df.where("false")).count() == 0
