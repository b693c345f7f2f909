import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from lodeseek.llm import block_names


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def found(df, **kw):
    return sorted(map(tuple, block_names.duplicates(df, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_odd_rows(odd, none, odd_rows):
    want = brute([r[:2] for r in odd_rows])
    assert found(odd) == want
    assert found(none) == []


def test_small_blocks_shared_hashes_and_hot_names(spark):
    rows = [(i, "abcabcabc" * (i % 7)) for i in range(40)] + [(100 + i, "the same text  again and\tagain é") for i in range(60)]
    rows += [(200 + i, "x" * i) for i in range(30)] + [(300, "a b"), (301, "a \n b"), (302, " a b"), (None, "a b"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert found(df, block=4) == want
    assert found(df, block=4, hot=4) == want
    # three hash values for all blocks: only their bytes tell them apart
    assert found(df, block=4, hashed=lambda b: F.pmod(F.crc32(b), F.lit(3)), hot=8) == want


def test_plan_is_native(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = block_names.duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
