import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens as K

PATH = os.path.join(K.FOLDER, K.NAME)
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
LETTERS = " \n\t'sréab1０9.!，中😀́　<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(K.FOLDER, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(LETTERS, max_size=60), st.text(max_size=40)))
def test_same_as_library(library, text):
    text = text.encode("utf-8", "replace").decode()
    ids = K.encoder(PATH).encode(text)
    assert ids == library(text)
    assert K.encoder(PATH).decode(ids) == text


@settings(max_examples=150, deadline=None)
@given(st.text(LETTERS, max_size=40), st.lists(st.tuples(st.integers(0, 50), st.integers(0, 10), st.text(LETTERS, max_size=8)), max_size=5))
def test_edits(start, edits):
    text = K.PrefixText(PATH, start)
    for at, size, new in edits:
        a = min(at, len(text.text))
        b = min(a + size, len(text.text))
        want = text.text[:a] + new + text.text[b:]
        text.edit(a, b, new)
        assert text.text == want and text.ids() == K.encoder(PATH).encode(want)


def test_append_splits_little():
    text = K.PrefixText(PATH, "word " * 5000)
    assert text.append("more") < 10
    assert text.ids() == K.encoder(PATH).encode("word " * 5000 + "more")


@pytest.mark.parametrize("text", ["a" * 20000, " " * 20000, "é" * 5000, "=" * 9000, "\n" * 3000 + "x"])
def test_long_runs(library, text):
    assert K.encoder(PATH).encode(text) == library(text)


def test_table(spark, library):
    rows = [(1, "Xin chào, 500 mg", "x"), (2, "", "x"), (3, None, "x"), (1, "again", None), (4, "<|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = {(r.doc_id, r.tokens): r.ids for r in K.encode_corpus(df, PATH).collect()}
    assert got[2, "x"] == [] and got[3, "x"] == [] and got[1, "x"] == library("Xin chào, 500 mg") and len(got[4, None]) > 1
    assert K.encode_corpus(df.limit(0), PATH).count() == 0
