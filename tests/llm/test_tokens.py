import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusmill.llm import tokens

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(tokens.FOLDER), reason="no vocabulary files")


def test_rows(spark):
    texts = ["Hello world", None, "", " ", "<|endoftext|>", "naïve\r\nçà 👍🏽", "a" * 5000, "Hello world"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.with_ids(df).collect()}
    assert got[1] == [] and got[2] == [] and got[0] == [15496, 995] == got[7]
    for i, t in enumerate(texts):
        assert tokens.decode(got[i]) == (t or "").encode()
    assert tokens.with_ids(df.limit(0)).count() == 0


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = tokens.encoding()
    for text in ("The gene's copy-number is 2.0!\n\n  Next", "<|endoftext|> x", "Größe =C3=9F\t\t😀 ab12"):
        assert e.encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab1'é .,\n\t\r 　😀s")), max_size=120), st.integers(1, 10))
def test_parts_keep_the_ids(text, long):
    e = tokens.encoding()
    parts = list(tokens.parts(text, long))
    assert "".join(parts) == text
    assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)


def test_long_text_is_split():
    rng = random.Random(1)
    text = "".join(rng.choice(["gene ", "\n", "  ", "copy", "12 "]) for _ in range(60_000))
    parts = list(tokens.parts(text))
    assert len(parts) > 1
    e = tokens.encoding()
    assert [i for p in parts for i in e.encode_ordinary(p)] == e.encode_ordinary(text)
