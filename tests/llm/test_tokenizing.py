import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.llm.tokenizing import count_tokens, default_vocabulary, encode_ids, encoder

public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_vocabulary())
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=200))
def test_any_text(reference, text):
    assert encoder(default_vocabulary()).encode(text) == reference([text])[0]


def test_hard_texts(reference):
    rng = random.Random(4)
    texts = ["a" * 4000, "ab" * 2000, "=" * 3001, " " * 500 + "x", "<|endoftext|>", "zzz" * 700, "the" * 400]
    texts += ["".join(rng.choice("etaoin shr'd\n.0") for _ in range(800)) for _ in range(40)]
    enc = encoder(default_vocabulary())
    assert [enc.encode(t) for t in texts] == reference(texts)


def test_table(spark, reference):
    rows = [(1, "Mount the wall unit.", 5), (1, "Mount the wall unit.", 5), (2, "", 5), (3, None, 5), (4, "<|endoftext|>", 5), (5, "word " * 20000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    got = encode_ids(df).collect()
    assert len(got) == 6
    by = {r.doc_id: r.ids for r in got}
    assert by[2] == [] and by[3] == [] and by[1] == reference(["Mount the wall unit."])[0] and 50256 not in by[4]
    assert {(r.doc_id, r.n_tokens) for r in count_tokens(df, ["doc_id"]).collect()} == {(k, len(v)) for k, v in by.items()}
    assert encode_ids(df.limit(0)).count() == 0
