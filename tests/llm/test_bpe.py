import base64
import hashlib

import numpy as np
import public_tokenizers
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeseek.llm import bpe, registry

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
TRUTH = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CUT = regex.compile(public_tokenizers.PATTERN)


def tokens(texts):
    ids, off = bpe.encode(texts, bpe.ranks(FILE), CUT)
    return [ids[i:j].tolist() for i, j in zip(off[:-1], off[1:], strict=True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_like_tiktoken(texts):
    assert tokens(texts) == [TRUTH.encode_ordinary(t) for t in texts]


def test_long_pieces_like_tiktoken():
    texts = ["a" * 1000, "ab" * 700, "the" * 400, "é" * 300 + "ñ", "x" * 192, "y" * 193, "#" * 500, " " * 800, "1234567890" * 60]
    assert tokens(texts) == [TRUTH.encode_ordinary(t) for t in texts]
    r = bpe.ranks(FILE)
    for t in texts:  # a row of its own and a row of a matrix agree
        p = r.byte[np.frombuffer(t.encode()[:150], np.uint8)]
        assert bpe._merge_row(p.copy(), r).tolist() == bpe._merge_matrix(p[None, :], r)[0].tolist()


def test_random_long_pieces_like_tiktoken():
    g = np.random.default_rng(4)
    letters = ["abcdefghij", "ABCDEFabcdef", "éñü", "#$%&*", "thesandoring"]
    texts = ["".join(g.choice(list(letters[k % 5]), int(g.integers(193, 10_000)))) for k in range(60)]
    assert tokens(texts) == [TRUTH.encode_ordinary(t) for t in texts]


def test_query_like_tiktoken(spark, sf):
    got = {r.doc_id: r for r in registry.op5_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = TRUTH.encode_ordinary(d.text or "")
        g = got[d.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_odd_rows(odd, none, odd_rows):
    got = bpe.encoded(odd, FILE, public_tokenizers.PATTERN, "doc_id", with_ids=True).collect()
    want = sorted((str(r[0]), TRUTH.encode_ordinary(r[1] or "")) for r in odd_rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert bpe.encoded(none, FILE, public_tokenizers.PATTERN, "doc_id").collect() == []
