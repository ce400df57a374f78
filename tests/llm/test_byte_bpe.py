import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from corpus import empty, hard

from dealgrove.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.RANKS)


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.ByteBpe.read(PATH)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_pieces_equal_merging_by_rank(coder, reference):
    r = random.Random(5)
    tokens = list(coder.ranks)
    for i in range(4000):
        k = r.randint(1, 10)
        if i % 3 == 0:
            piece = b"".join(r.choices(tokens, k=k))
        elif i % 3 == 1:
            piece = bytes(r.choices(b"aetino sTh", k=3 * k))
        else:
            piece = bytes(r.randrange(256) for _ in range(k))
        assert coder.encode_piece(piece) == reference._core_bpe.encode_single_piece(piece)


def test_a_long_run_takes_linear_steps(coder):
    ids = coder.encode_piece(b"ab" * 50_000)
    assert coder.decode(ids) == b"ab" * 50_000


def test_documents(spark, coder, reference):
    docs, pairs = hard(spark)
    got = byte_bpe.encode_documents(docs, PATH, digest=True).collect()
    want = []
    for i, t in pairs:
        ids = reference.encode_ordinary(t or "")
        told = ",".join(map(str, ids)).encode()
        want.append((i, len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_round_trip(spark):
    docs, pairs = hard(spark)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, PATH), PATH).collect()
    assert sorted((repr(r[0]), bytes(r[1]).decode()) for r in back) == sorted((repr(i), t or "") for i, t in pairs)


def test_empty_table(spark):
    assert byte_bpe.encode_documents(empty(spark), PATH, digest=True).count() == 0
