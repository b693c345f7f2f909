"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed; those that pass a small bitmap of the template grams meet the template
positions in a Spark join. A match at text position p and template position t votes for the diagonal p - t, if its words
are those of the template, not only their hash. A short template, or a base phrase, is a diagonal with a vote of every
gram. In passages a word put in or left out shifts the rest to a neighbouring diagonal, so neighbours within a few words
are merged. The votes of a merged run are then verified against the passage: the longest chain of votes that goes on in
both text and passage counts, each place of the passage once; it must cover SHARE of the passage's grams, all grams of the
words that tell the passage from its like, and leave no more than EDITS words of text between them uncovered.

Defined results: a null text is an empty one, without words or labels; a text of fewer words than a gram has no label;
overlapping places of a phrase all count; of chains of equal length the one that ends first is taken; very long texts
are taken whole, and only their grams that may be in a template leave the scan; repeated rows each get their row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, NOT_ALNUM, gram_hashes, slices, span_hashes, text_buffer, word_spans

K = 2
#: Words by which merged diagonals and spans may lie apart, and the share of a passage's grams that makes a label.
SHIFT, GAP, SHARE = 3, 6, 0.7
#: Words between a chain's ends that are not of the passage, as a share of the passage's words.
EDITS = 0.3
#: Templates of up to so many grams, without told words, must stand whole.
SHORT = 8
BITMAP_BITS = 18

#: Base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Phrases and passages of our own, each with the label it adds.
OWN = (
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("apache license version 2 0", "apache-2.0"),
    ("gnu general public license version 2", "gpl-2.0"),
    ("gnu general public license version 3", "gpl-3.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("bsd license", "bsd"),
    ("spdx license identifier", "spdx"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
)
#: Words of which all grams must be in the chain, where a passage holds them.
TOLD = ("gnu general public license", "gnu lesser general public license", "gnu affero general public license", "mozilla public license")


def _grams(text: str) -> tuple[np.ndarray, list[str]]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = word_spans(data, np.array([0, len(data)]), NOT_ALNUM)
    words = [data[i:j].tobytes().decode() for i, j in zip(s, e, strict=True)]
    return gram_hashes(span_hashes(data, s, e), K), [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]


def _told(grams: list[str]) -> set[int]:
    """Positions of the grams that tell a passage from its like."""
    out: set[int] = set()
    for phrase in TOLD:
        want = _grams(phrase)[1]
        for i in range(len(grams) - len(want) + 1):
            if grams[i : i + len(want)] == want:
                out |= set(range(i, i + len(want)))
    return out


def template_positions(spark: SparkSession, base=BASE, own=OWN) -> DataFrame:
    """A row for each gram of each template: a few hundred, whatever the input."""
    rows = []
    for i, (text, label) in enumerate([*base, *own]):
        hashes, grams = _grams(text)
        told, whole = _told(grams), i < len(base) or len(grams) <= SHORT
        rows += [(int(h.view(np.int64)), i, t, g, label, i < len(base), whole, len(grams), t in told, len(told)) for t, (h, g) in enumerate(zip(hashes, grams, strict=True))]
    return spark.createDataFrame(rows, "hash long, template int, at int, words string, label string, base boolean, whole boolean, grams int, told boolean, n_told int")


def chain(votes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of votes (p, t) that rises in both; of equally long ones the one found first in the text."""
    tails: list[int] = []  # least t that ends a chain of each length
    last: list[int] = []  # and which vote it is
    before: list[int] = []
    votes = sorted(votes, key=lambda v: (v[0], -v[1]))
    for i, (_, t) in enumerate(votes):
        k = bisect_left(tails, t)
        before.append(last[k - 1] if k else -1)
        if k == len(tails):
            tails.append(t)
            last.append(i)
        elif t < tails[k]:
            tails[k], last[k] = t, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(votes[i])
        i = before[i]
    return out[::-1]


def _verified(votes: pd.Series) -> pd.DataFrame:
    """Of each run's votes (p, t, told): the grams of the chain, those of told words, and the words between its ends that are not of it."""
    rows = []
    for run in votes:
        told = {(v["p"], v["t"]) for v in run if v["told"]}
        line = chain([(v["p"], v["t"]) for v in run])
        words = {p + j for p, _ in line for j in range(K)}
        rows.append((len(line), sum(v in told for v in line), line[-1][0] + K - line[0][0] - len(words) if line else 0))
    return pd.DataFrame(rows, columns=["covered", "told", "strange"]).astype("int32")


def _bitmap(hashes: np.ndarray) -> np.ndarray:
    m = np.zeros(1 << BITMAP_BITS, bool)
    m[(hashes >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
    return m


def rolled(docs: DataFrame, hashes: np.ndarray, *keep: str) -> DataFrame:
    """keep (a struct), n_words, and the position, hash and words of every gram that may be in a template."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(hashes))
    given = docs.select(F.struct(*keep).alias("keep"), "text")
    kind = given.schema["keep"].dataType.simpleString()
    one = pa.struct([("at", pa.int64()), ("hash", pa.int64()), ("words", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = shared.value
        for part in slices(batches, "text"):
            data, off = text_buffer(part.column(1))
            data = LOWER[data]
            s, e, first = word_spans(data, off, NOT_ALNUM)
            g = gram_hashes(span_hashes(data, s, e), K)
            at = np.flatnonzero(maybe[(g >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + K <= first[row + 1] if len(at) else np.empty(0, bool)
            at, row = at[inside], row[inside]
            words = [" ".join(data[s[i] : e[i]].tobytes().decode("utf-8", "replace") for i in range(a, a + K)) for a in at.tolist()]
            hits = pa.StructArray.from_arrays([pa.array(at - first[row]), pa.array(g[at].view(np.int64)), pa.array(words, pa.string())], fields=list(one))
            cut = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"keep": part.column(0), "n_words": pa.array(np.diff(first).astype(np.int64)), "hits": pa.ListArray.from_arrays(pa.array(cut), hits)})

    return given.mapInArrow(run, f"keep {kind}, n_words long, hits array<struct<at:long,hash:long,words:string>>")


def scan(docs: DataFrame, *keep: str, base=BASE, own=OWN) -> DataFrame:
    """keep columns, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of docs(text)."""
    spark = docs.sparkSession
    places = template_positions(spark, base, own)
    hashes = np.concatenate([_grams(t)[0] for t, _ in [*base, *own]])
    rows = rolled(docs, hashes, *keep).withColumn("uid", F.monotonically_increasing_id())
    votes = rows.select("uid", "keep", "n_words", F.explode_outer("hits").alias("hit")).select("uid", "keep", "n_words", F.col("hit.at").alias("p"), F.col("hit.hash").alias("hash"), F.col("hit.words").alias("said"))
    # a few hundred template rows, fixed in this module; a gram meets a position only if the words are the same, too
    met = votes.join(F.broadcast(places.withColumnRenamed("at", "t").withColumnRenamed("words", "said")), ["hash", "said"], "left").repartition("uid")
    line = F.col("p") - F.col("t")
    lines = met.groupBy("uid", "keep", "n_words", "template", line.alias("line")).agg(
        F.count("template").alias("votes"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.first("label").alias("label"), F.first("base").alias("base"),
        F.first("whole").alias("whole"), F.first("grams").alias("grams"), F.first("n_told").alias("n_told"),
        # a short template's votes are only counted
        F.collect_list(F.when(~F.col("whole"), F.struct("p", "t", "told"))).alias("at"),
    )
    along = Window.partitionBy("uid", "template").orderBy("lo", "line")
    apart = (F.abs(F.col("line") - F.lag("line").over(along)) > SHIFT) | (F.col("lo") - F.lag("hi").over(along) > GAP)
    # a phrase's place is one diagonal; only passages are merged
    runs = lines.withColumn("new", F.when(F.col("whole") | apart, 1).otherwise(0)).withColumn("run", F.sum("new").over(along))
    spans = runs.groupBy("uid", "keep", "n_words", "template", "run").agg(
        F.sum("votes").alias("votes"), F.min("lo").alias("lo"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("whole").alias("whole"),
        F.first("grams").alias("grams"), F.first("n_told").alias("n_told"), F.flatten(F.collect_list("at")).alias("at"),
    )
    verified = F.pandas_udf(_verified, "struct<covered:int,told:int,strange:int>")
    spans = spans.withColumn("found", verified("at"))
    share = F.when(F.col("whole"), F.col("votes") / F.col("grams")).otherwise(F.col("found.covered") / F.col("grams"))
    full = F.col("whole") & (F.col("votes") == F.col("grams"))
    based = F.col("base") & full
    passage = ~F.col("whole") & (share >= SHARE) & (F.col("found.told") == F.col("n_told")) & (F.col("found.strange") <= EDITS * (F.col("grams") + K - 1))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = spans.groupBy("uid", "keep", "n_words").agg(
        F.count_if(based).alias("n_base"), F.min(F.when(based, F.col("lo"))).alias("first_word"), F.max(F.when(based, F.col("lo"))).alias("last_word"),
        joined(F.when(based, F.col("label"))).alias("base_labels"), joined(F.when(full | passage, F.col("label"))).alias("labels"), F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
    )
    return out.select("keep.*", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
