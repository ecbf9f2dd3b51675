"""License scans by diagonal voting.

Every word k-gram of every text is hashed (rolling, k = GRAM) and joined in Spark with the positions
of the k-grams of a fixed list of templates (broadcast: its size does not depend on the data). A hit
votes for its diagonal, the text position less the template position; votes are summed per text,
template and diagonal, and neighbouring diagonals of a template (insertions and deletions) merge.
Merged runs with enough votes are verified: the longest chain of hits whose text and template positions
both increase, each at most GAP diagonals from the one before, must hold enough of the template's
k-grams. So each of them counts once and in order, however often a text repeats some. Short phrases
need all of theirs on one diagonal, which verifies each of their words.

Words: maximal runs of ASCII letters and digits and of bytes beyond ASCII, A-Z in lower case.
Nulls: a null text is empty: no words, no places, empty labels, score 0. Rows with null or repeated
ids are told apart by their texts; rows that repeat both give equal rows. Of equally long chains the
first counts. A very long text is one row of hits in a task's memory, as its text is. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ALNUM, mix, released, slices, text_words, texts

GRAM = 2
COVER = 0.6  # share of a template's k-grams that a span must hold
GAP = 3  # diagonals that far apart at most merge

# Phrases and labels of the base scan.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Opening or characteristic sentences of common public licenses and notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "public-domain": "this is free and unencumbered software released into the public domain",
}


def grams(value: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(value) - k + 1), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + value[i : i + len(out)]
    return mix(out)


def template_table(spark: SparkSession, phrases: dict[str, str], templates: dict[str, str], k: int = GRAM) -> DataFrame:
    """(gram, name, base, size, at): the templates' k-grams and their positions."""
    rows = []
    for base, source in ((True, ((label, text) for text, label in phrases.items())), (False, templates.items())):
        for name, text in source:
            value, first, last, _ = text_words([text.encode()], ALNUM)
            g = grams(value, k).view(np.int64).tolist()
            assert len(g), f"a phrase needs at least {k} words: {text}"
            rows += [(x, name, base, len(g), i) for i, x in enumerate(g)]
    return spark.createDataFrame(rows, "gram bigint, name string, base boolean, size int, at int")


def text_grams(docs: DataFrame, k: int = GRAM) -> DataFrame:
    """(doc_id, rid, pos, gram) for every k-gram, and a row with pos -1 whose gram is the number of words."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value, first, last, _ = text_words(texts(batch), ALNUM)
            gram = grams(value, k).view(np.int64)
            n = last - first
            rows = np.maximum(n - k + 1, 0) + 1
            text = np.repeat(np.arange(len(n)), rows)
            pos = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows) - 1
            out = np.where(pos < 0, n[text], 0)
            inside = pos >= 0
            out[inside] = gram[(first[text] + pos)[inside]]
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(pos.astype(np.int32)), pa.array(out)], ["doc_id", "rid", "pos", "gram"])

    return docs.select("doc_id", "rid", "text").mapInArrow(run, "doc_id bigint, rid bigint, pos int, gram bigint")


def longest_chain(pos: np.ndarray, at: np.ndarray, size: int) -> tuple[int, int, int]:
    """(hits, first and last position) of the longest chain of hits (pos, at)."""
    order = np.lexsort((-at, pos))  # of one position the later template places first: they can't follow one another
    count, first, last = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)  # the latest best chain that ends at each place
    best = (0, 0, 0)
    places = np.arange(size)
    for p, t in zip(pos[order].tolist(), at[order].tolist(), strict=True):
        fits = (count[:t] > 0) & (last[:t] < p) & (np.abs((p - t) - (last[:t] - places[:t])) <= GAP)
        k = int(np.where(fits, count[:t], 0).argmax()) if t else 0
        n, a = (int(count[k]) + 1, int(first[k])) if t and fits[k] else (1, p)
        # an older chain that this position can hardly follow gives way
        if n >= count[t] or p - last[t] > size:
            count[t], first[t], last[t] = n, a, p
        if n > best[0]:
            best = (n, a, p)
    return best


def _verified(merged: DataFrame) -> DataFrame:
    """merged with `votes`, `first` and `last` of templates' runs from their longest chains."""
    names = [c for c in merged.columns if c != "hits"]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = {c: batch.schema.get_field_index(c) for c in batch.schema.names}
            votes, first, last = (batch.column(where[c]).to_pylist() for c in ("votes", "first", "last"))
            for i, (hits, size) in enumerate(zip(batch.column(where["hits"]).to_pylist(), batch.column(where["size"]).to_pylist(), strict=True)):
                if hits:
                    pos = np.concatenate([np.array(h["pos"], np.int64) for h in hits])
                    at = pos - np.repeat([h["diagonal"] for h in hits], [len(h["pos"]) for h in hits])
                    votes[i], first[i], last[i] = longest_chain(pos, at, size)
            new = {"votes": pa.array(votes, pa.int64()), "first": pa.array(first, pa.int64()), "last": pa.array(last, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(where[c])) for c in names], names)

    return merged.mapInArrow(run, merged.drop("hits").schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, rid, n_words, n_base, first_word, last_word, base_labels, labels, score, spans):
    spans are the verified (name, first word, last word, share of the template)."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Rows that repeat both id and text are numbered by nothing but their place; they count apart below.
    plain = plain.withColumn("rid", F.xxhash64("text"))
    table = F.broadcast(template_table(docs.sparkSession, phrases, templates))
    hits = text_grams(plain).join(table, "gram", "left").where("pos = -1 or name is not null")
    hits = hits.withColumn("name", F.when(F.col("pos") >= 0, F.col("name"))).withColumn("diagonal", F.when(F.col("pos") >= 0, F.col("pos") - F.col("at")))
    votes = hits.groupBy("doc_id", "rid", "name", "base", "size", "diagonal").agg(F.count("*").alias("rows"), F.countDistinct("at").alias("votes"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.collect_list(F.when(~F.col("base"), F.col("pos"))).alias("pos"), F.max(F.when(F.col("pos") < 0, F.col("gram"))).alias("n_words"))
    # a run of diagonals of one template, each at most GAP from the one before
    w = Window.partitionBy("doc_id", "rid", "name", "base").orderBy("diagonal")
    votes = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > GAP).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    merged = votes.groupBy("doc_id", "rid", "name", "base", "size", F.when(F.col("base"), F.col("diagonal")).otherwise(F.col("run")).alias("run")).agg(
        F.max("rows").alias("rows"), F.least(F.sum("votes"), F.first("size").cast("bigint")).alias("votes"), F.min(F.col("diagonal") + F.col("lo")).cast("bigint").alias("first"), F.max(F.col("diagonal") + F.col("hi")).cast("bigint").alias("last"), F.max("n_words").alias("n_words"), F.max("votes").alias("best"),
        F.collect_list(F.when(~F.col("base"), F.struct("diagonal", "pos"))).alias("hits"),
    )
    # runs that can't reach the share any more need no chain
    merged = merged.where("base is null or base or votes >= %f * size" % COVER)
    merged = _verified(merged)
    share = F.col("votes") / F.col("size")
    good = F.when(F.col("base"), F.col("best") == F.col("size")).otherwise(share >= COVER)
    head, base, other = F.col("name").isNull(), good & F.col("base"), good & ~F.col("base")
    out = merged.groupBy("doc_id", "rid").agg(
        F.max(F.when(head, F.col("rows"))).alias("copies"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).cast("bigint").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("name")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(base | other, F.col("name")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(base | other, share)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(base | other, F.struct("name", "first", (F.col("last") + GRAM - 1).alias("last"), share.alias("share"))))).alias("spans"),
    )
    # `copies` rows repeat both id and text
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copy", "copies")
