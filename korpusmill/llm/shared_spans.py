"""Problem 10: long exact spans shared between records.

The paragraphs of the search are all windows of ``least`` characters of a text. Each is
banded by one MinHash of its character shingles; as only windows that agree wholly count,
that band has full recall. Windows whose band collides in two documents are verified by a
128-bit fingerprint of all their characters, and a document's shared characters are the
union of its verified windows. Groups are reduced to their smallest and largest document,
so a passage that stands in a third of all documents costs a row per document, never a
pair. Exact copies are represented by one text. Clusters of documents that share spans
come from connected components over star edges.

Defined results: null and short texts share nothing; repeats within one document do not
count; documents with equal text of at least ``least`` characters share all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.leakage import _chunks, _signed
from korpusmill.llm.windows import blocks, gram_hashes, window_minhash
from korpusmill.session import checkpoint

LEAST = 120
#: Characters of a shingle; a window holds ``least - SHINGLE + 1`` of them.
SHINGLE = 88


def _points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def _bands(least: int, gram: int):
    """(doc_id, band): the MinHash values of a document's windows, runs of equal ones once."""
    schema = pa.schema([("doc_id", pa.int64()), ("band", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = np.array(batch.column(0).to_pylist(), dtype=np.int64), batch.column(1).to_pylist()
            for rows in _chunks(texts, 400_000):
                for values, owner, _, starts in blocks([_points(texts[i]) for i in rows], least):
                    low = window_minhash(values, least, gram)
                    keep = starts[: len(low)]
                    low, who = low[keep], owner[: len(low)][keep]
                    change = np.ones(len(low), dtype=bool)
                    change[1:] = (low[1:] != low[:-1]) | (who[1:] != who[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows[0] + who[change]]), pa.array(_signed(low[change]))], schema=schema)

    return run


def _fingerprints(least: int, gram: int):
    """(doc_id, at, f1, f2): fingerprints of the windows whose band is wanted."""
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = np.array(batch.column(0).to_pylist(), dtype=np.int64), batch.column(1).to_pylist()
            wanted = batch.column(2).to_pylist()
            for rows in _chunks(texts, 400_000):
                for values, owner, place, starts in blocks([_points(texts[i]) for i in rows], least):
                    low = _signed(window_minhash(values, least, gram))
                    n = len(low)
                    keep = starts[:n].copy()
                    edges = np.flatnonzero(np.diff(owner[:n])) + 1
                    for a, b in zip([0, *edges], [*edges, n]):
                        keep[a:b] &= np.isin(low[a:b], np.array(wanted[rows[0] + owner[a]], dtype=np.int64))
                    at = np.flatnonzero(keep)
                    prints = [pa.array(_signed(gram_hashes(values, least, w)[at])) for w in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[rows[0] + owner[at]]), pa.array(place[at].astype(np.int32)), *prints], schema=schema)

    return run


def _in_two(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur in at least two documents, with the smallest of these."""
    seen = rows.groupBy(*key).agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail"))
    return seen.where(F.col("head") < F.col("tail")).select(*key, "head")


def _copies(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, rep, n_copies, n_points) of documents long enough; rep is the smallest doc_id with that text."""
    ids = documents.where(F.col("doc_id").isNotNull() & (F.length("text") >= least)).select(F.col("doc_id").cast("bigint"), F.md5("text").alias("digest"), F.length("text").alias("n_points"))
    groups = ids.groupBy("digest", "n_points").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("n_copies"))
    return ids.join(groups, ["digest", "n_points"]).select("doc_id", "rep", "n_copies", "n_points").distinct()


def _windows(documents: DataFrame, copies: DataFrame, least: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Verified windows of representatives (doc_id, at, head) and the texts they come from."""
    reps = copies.where(F.col("doc_id") == F.col("rep")).select("doc_id")
    texts = documents.select(F.col("doc_id").cast("bigint"), "text").join(reps, "doc_id", "left_semi")
    bands = texts.mapInArrow(_bands(least, gram), "doc_id bigint, band bigint")
    wanted = bands.join(_in_two(bands, "band").select("band"), "band", "left_semi").groupBy("doc_id").agg(F.collect_set("band").alias("wanted"))
    read = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted")
    prints = read.mapInArrow(_fingerprints(least, gram), "doc_id bigint, at int, f1 bigint, f2 bigint")
    return prints.join(_in_two(prints, "f1", "f2"), ["f1", "f2"]).select("doc_id", "at", "head"), texts


def _union_length(starts, least: int):
    """Characters covered by windows of ``least`` characters that start at the sorted positions."""
    folded = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda a, s: F.struct((s + least).alias("end"), (a["total"] + F.least(F.lit(least), s + least - a["end"])).cast("bigint").alias("total")),
    )
    return folded["total"]


def shared_characters(documents: DataFrame, least: int = LEAST, gram: int = SHINGLE) -> DataFrame:
    """(doc_id, shared_chars) of each document that shares a span of at least ``least`` characters."""
    copies = _copies(documents, least)
    windows, _ = _windows(documents, copies, least, gram)
    covered = windows.groupBy(F.col("doc_id").alias("rep")).agg(F.array_sort(F.collect_set("at")).alias("starts")).select("rep", _union_length(F.col("starts"), least).alias("covered"))
    whole = F.when(F.col("n_copies") > 1, F.col("n_points").cast("bigint"))
    return copies.join(covered, "rep", "left").select("doc_id", F.coalesce(whole, F.col("covered")).alias("shared_chars")).where(F.col("shared_chars").isNotNull())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of undirected edges (a, b): smallest node by large-star and small-star rounds.

    The number of rounds grows with the logarithm of the size; lineage is cut in each.
    """
    current = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        fresh = checkpoint(small)
        if fresh.exceptAll(current).isEmpty() and current.exceptAll(fresh).isEmpty():
            members = fresh.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
        current = fresh
    raise ValueError("components did not settle")


def span_clusters(documents: DataFrame, least: int = LEAST, gram: int = SHINGLE) -> DataFrame:
    """(doc_id, cluster): documents linked by shared spans, named by their smallest doc_id."""
    copies = checkpoint(_copies(documents, least))
    windows, _ = _windows(documents, copies, least, gram)
    links = windows.select(F.col("doc_id").alias("a"), F.col("head").alias("b")).distinct()
    doubles = copies.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    return components(links.unionByName(doubles)).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
