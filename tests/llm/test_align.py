import hashlib
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeseek.llm import registry, token_align

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
HF, SP = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
HF.encode_special_tokens = True


def tokens(text):
    """(ids, bytes) of each side by the public libraries."""
    letters = token_align._byte_letters()
    a = HF.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens, strict=True)]
    b = [(i, bytes([int(p[3:5], 16)]) if SP.is_byte(i) else p.replace("▁", " ").encode()) for i in SP.encode(text) for p in [SP.id_to_piece(i)]]
    return a, b


def brute(rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, b = tokens(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        links, groups = [], []
        if text and b"".join(x for _, x in a) == raw == b"".join(x for _, x in b):
            ends = lambda side: {sum(len(x) for _, x in side[: k + 1]): k for k in range(len(side))}
            ea, eb = ends(a), ends(b)
            la = lb = 0
            for e in sorted(ea.keys() & eb.keys()):
                links.append((a[ea[e]][0], b[eb[e]][0]))
                groups.append(",".join(str(i) for i, _ in a[la : ea[e] + 1]) + "|" + ",".join(str(i) for i, _ in b[lb : eb[e] + 1]))
                la, lb = ea[e] + 1, eb[e] + 1
        else:
            a, b = [], []
        counts.update(links)
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(((d, na, nb, g, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha) for d, na, nb, g, links, sha in docs), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


MORE = [(20, "<|endoftext|> <s> </s> <unk> <0x41>"), (21, "two  spaces   three\n\nlines\t tab"), (22, "ﬁ ligature ① and full-width ＡＢＣ"), (23, "▁ literal mark"), (24, " leading and trailing "), (25, "naïve Ünïcödé 数据 🙂🙃")]


@pytest.mark.parametrize("hot", [token_align.HOT, 8])
def test_odd_rows(spark, odd, none, odd_rows, hot):
    rows = [r[:2] for r in odd_rows if not (r[1] and len(r[1]) > 20_000)] + MORE
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(token_align.counted(df, A, B, P.PATTERN, hot)) == brute(rows)
    assert len(found(token_align.counted(odd, A, B, P.PATTERN, hot))) == len(odd_rows)
    assert found(token_align.counted(none, A, B, P.PATTERN, hot)) == []


def test_query_like_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 6000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert found(token_align.counted(df, A, B, P.PATTERN)) == brute(short)
    assert registry.op11_alignment(spark, sf).count() == len(rows)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ranks_encode_like_the_file(text):
    side = token_align.byte_level(A, P.PATTERN)
    assert side.fast is not None
    assert side.encode([" " + text])[0].tolist() == HF.encode(" " + text, add_special_tokens=False).ids


def test_where_the_fast_engine_gives_up():
    side = token_align.byte_level(A, P.PATTERN)
    for text in (" " * 300_000 + "x", "a" * 200_000):
        assert side.encode([text])[0].tolist() == HF.encode(text, add_special_tokens=False).ids
