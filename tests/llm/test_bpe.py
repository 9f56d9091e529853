import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gistmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(PATH))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "ab'stremvdl  \n\t1٣½é  !.世界\x1c\x85🙂ʼ''"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encodes_as_the_library(coder, library):
    texts = [*random_texts(3000, 1), "", "'s", "it's 're 'll'd can't''s ' s", "  's", "<|endoftext|>", "word " * 500]
    texts += [f"a{chr(c)}1{chr(c)} {chr(c)}." for c in range(0, 0x110000, 211) if unicodedata.category(chr(c)) != "Cs"]
    assert coder.encode(texts) == [np.array(library.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]


def test_long_words_contract_alike(coder, library):
    texts = ["z" * 3000, "abcdefgh" * 400]
    assert coder.encode(texts) == [np.array(library.encode_ordinary(t), dtype="<u4").tobytes() for t in texts]


def test_round_trip(coder):
    texts = random_texts(500, 2)
    assert coder.decode(coder.encode(texts)) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        coder.decode([np.array([50256], dtype="<u4").tobytes()])


def test_tables(spark, library):
    rows = [(1, "Hello world, it's me", 1), (2, None, 2), (3, "", 3), (1, "Hello world, it's me", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    encoded = bpe.encode(docs, PATH)
    got = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert got == {1: library.encode_ordinary(rows[0][1]), 2: [], 3: []}
    back = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded, PATH).collect()}
    assert back[1] == rows[0][1].encode() and back[2] == b""
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
    trip = bpe.round_trip(docs, PATH).filter("doc_id = 1")
    assert trip.count() == 2 and trip.select(F.col("decoded_sha256") == F.sha2(F.lit(rows[0][1]).cast("binary"), 256)).first()[0]
