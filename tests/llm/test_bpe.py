import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vidcohort.llm import bpe

FILE = bpe.vocabulary()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = [
    "", " ", "  \n\t x", "it's we'll THEY'RE", "naïve ñandú 日本語 ½ Ⅷ ² 123", "a b c\x1c\x1d\x85d", "<|endoftext|>", "x<|endoftext|> y<|endoftext|>",
    "a" * 3000, "ab" * 2000, "\U0001f600‍\U0001f468", "end   ", "\r\n\r\n a",
]


@pytest.mark.parametrize("text", TEXTS)
def test_matches_library(library, text):
    own = bpe.codec(FILE)
    ids = own.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer

    own = bpe.codec(FILE)
    ids = own.encode(text)
    assert ids == _lib(Tokenizer).encode(text, add_special_tokens=False).ids
    assert own.decode(ids) == text


_cache = []


def _lib(kind):
    if not _cache:
        _cache.append(kind.from_file(FILE))
    return _cache[0]


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r[1:]) for r in bpe.op7_bpe(spark, sf).collect()} == want


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "hi", 6), (None, "", 7)], "doc_id long, text string, tokens int")
    rows = sorted(bpe.digests(spark, df).collect(), key=str)
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1]
    assert {(r.text, r.decoded) for r in bpe.coded(spark, df).collect()} == {(None, ""), ("hi", "hi"), ("", "")}
    assert bpe.digests(spark, df.limit(0)).count() == 0
