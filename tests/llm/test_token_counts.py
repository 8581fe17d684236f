"""Token counts against the library, text by text."""

import random

import pytest

from tidewright.llm import token_counts as C

SCHEMA = "id int, text string, n_tokens string"


@pytest.fixture(scope="module")
def vocabulary():
    return C.Vocabulary(C.default_path())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(C.default_path())
    return lambda text: len(made.encode(text, add_special_tokens=False).ids)


def test_random_texts(vocabulary, library):
    rng, own = random.Random(3), C.Counter(vocabulary)
    odd = [c for r in vocabulary.odd.split("-") for c in r][:20]
    pool = [*"abcdest  \t\n\r'019!?.,ß\xa0éα漢字🙂\u0378\u02bb\u0301\x1c\x85²½", "<|endoftext|>", "<|endof", "'ll", "'re", " the", "ing", *odd]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(5_000)]
    assert [n for n, _ in own.counts([t.encode() for t in texts])] == [library(t) for t in texts]


def test_proven_strings_are_one_token(vocabulary, library):
    assert len(vocabulary.whole) > 40_000
    assert all(library(s) == 1 for s in vocabulary.whole[::97])
    assert all(len(C.merged(s.encode(), vocabulary.ranks)) == 1 for s in vocabulary.whole[::97])


def test_matrix_and_heap_merge_alike(vocabulary):
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"abcdeinrst \xc3\xa9") for _ in range(rng.randint(1, C.SHORT))) for _ in range(2_000)]
    assert vocabulary.merged_counts(pieces).tolist() == [len(C.merged(p, vocabulary.ranks)) for p in pieces]


def test_full_memory_and_long_texts(vocabulary, library, monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 20)
    monkeypatch.setattr(C, "LONG", 1 << 10)
    own = C.Counter(vocabulary)
    texts = ["qwxz plokij " * 300 + "x" * 5_000 + "\n" * 2_000 + "α" * 1_500, "<|endoftext|>" * 3 + "zzyxw vq", ""]
    assert [n for n, _ in own.counts([t.encode() for t in texts])] == [library(t) for t in texts]


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "The cat sat.", None), (3, "The cat sat.", None), (4, "wörd<|endoftext|>", "z")]
    got = sorted(C.count_tokens(spark.createDataFrame(rows, SCHEMA)).select("id", "n_tokens").collect())
    assert got == [(1, 0), (2, 0), (3, library("The cat sat.")), (3, library("The cat sat.")), (4, library("wörd<|endoftext|>"))]
    assert C.count_tokens(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_kinds_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        C.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


def test_given_documents(spark, sf, library):
    from tidewright.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op13_token_counts"](spark, sf).collect():
        t = texts[r["doc_id"]]
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), library(t), library(t) > 512)
