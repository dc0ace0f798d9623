"""Problem 9: evaluation texts leaking into training text.

MinHash containment search with size partitioning: documents of any length are
partitioned into windows of 13 words, all of one size (9 shingles of five words), as are
the test items. A window that an item and a document share has containment 1 in a set of
its own size, so its Jaccard similarity is 1 and one MinHash row per window finds it
without a miss, however long the document around it is. Candidates come from the MinHash
values alone: the items' values go into a Bloom filter of bounded size that every worker
holds, a document's windows that pass it are joined to the items' windows by MinHash
value, and a candidate counts if all shingles of the two windows are equal in order, which
is compared on their words. The corpus is read once and only windows that pass are shuffled. A
filter that is too small for very many items only lets more windows through, never fewer.

Defined results: null, empty and short texts (under 13 words) have no windows; copies of
a document are reported each; items that share a sentence are reported each.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpusmill.llm.windows import _slide, blocks, gram_hashes, window_minhash
from korpusmill.session import checkpoint

WINDOW, SHINGLE = 13, 5
_WORDS: dict[str, int] = {}


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return regex.compile(r"[\p{L}\p{N}]+"), regex.compile(r"[\p{Cf}\u034F\uFE00-\uFE0F]+")


def words_of(text: str | None) -> list[str]:
    """Words of a text: invisible characters removed, accents composed, lower case."""
    if not text:
        return []
    run, hidden = _patterns()
    if not text.isascii():
        text = unicodedata.normalize("NFC", hidden.sub("", text))
    return run.findall(text.lower())


def _codes(words: list[str]) -> np.ndarray:
    """64-bit code per word; equal words have equal codes on every machine."""
    import xxhash

    known = _WORDS
    if len(known) > 1_000_000:
        known.clear()
    out = []
    for w in words:
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh64_intdigest(w)
        out.append(code)
    return np.array(out, dtype=np.uint64)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _chunks(texts: list[str | None], limit: int = 2_000_000) -> Iterator[range]:
    """Ranges of rows of bounded text size."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit:
            yield range(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


#: Bits of the filter per MinHash value, and the least and most bits it may have (8 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 16, 26
PROBES = 3


def _probes(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit positions of 64-bit values: fields of the value itself, which is mixed already."""
    mask = np.uint64((1 << bits) - 1)
    return [(values >> np.uint64(shift)) & mask for shift in (0, 19, 38)]


def signature_filter(values: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words) of a Bloom filter over the distinct values of a column; at most 2^26 bits reach the driver, as columns."""
    hashes = values.toDF("h").distinct()
    n = hashes.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * n - 1).bit_length() if n else 0))
    mask = (1 << bits) - 1
    places = F.array(*[F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(mask)) for shift in (0, 19, 38)])
    bit = hashes.select(F.explode(places).alias("p"))
    words = bit.groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 AS INT)))").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    table[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return bits, table


def _hits(values: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), dtype=bool)
    for place in _probes(values, bits):
        out &= (table[(place >> np.uint64(5)).astype(np.int64)] >> (place & np.uint64(31)).astype(np.uint32)) & np.uint32(1) > 0
    return out


def _windows(key: str, shared=None):
    """(key, minhash, win): MinHash and words of windows, of those that pass the shared filter if there is one."""
    schema = pa.schema([(key, pa.int64()), ("minhash", pa.int64()), ("win", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for rows in _chunks(texts):
                words = [words_of(texts[i]) for i in rows]
                for values, owner, place, starts in blocks([_codes(w) for w in words], WINDOW):
                    low = window_minhash(values, WINDOW, SHINGLE)
                    keep = starts[: len(low)]
                    if shared is not None:
                        by_minhash, by_shingle = shared.value
                        known = _hits(gram_hashes(values, SHINGLE), *by_shingle)
                        keep = keep & _hits(low, *by_minhash) & _slide(known, WINDOW - SHINGLE + 1, np.logical_and)
                    at = np.flatnonzero(keep)
                    who, pos = owner[at].tolist(), place[at].tolist()
                    wins = [" ".join(words[i][p : p + WINDOW]) for i, p in zip(who, pos)]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[rows[0] + i] for i in who], pa.int64()), pa.array(_signed(low[at])), pa.array(wins, pa.string())], schema=schema)

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct shingle hashes of the texts of a batch."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for rows in _chunks(texts):
            for values, _, _, starts in blocks([_codes(words_of(texts[i])) for i in rows], WINDOW):
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.unique(gram_hashes(values, SHINGLE))))], ["h"])


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, minhash, win): the query sets, written once because they are used three times."""
    tests = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint"), "text")
    return checkpoint(tests.mapInArrow(_windows("item_id"), "item_id bigint, minhash bigint, win string").distinct())


def leak_windows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, win): every shared window of 13 words of a document and an item, verified. ``items`` are item windows.

    Windows that a document repeats are repeated. A window moves if its MinHash value is an item's and all its shingles are contained in those of the items.
    """
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint"), "text")
    shared = documents.sparkSession.sparkContext.broadcast((signature_filter(items.select("minhash")), signature_filter(items.select(F.col("win").alias("text")).mapInArrow(_shingles, "h bigint"))))
    of_docs = docs.mapInArrow(_windows("doc_id", shared), "doc_id bigint, minhash bigint, win string")
    # candidates by MinHash value, verified by the words; as one equi-join a frequent value makes no pairs that fail.
    # The planner takes the windows to be as small as the texts they come from; merge, never broadcast them
    return of_docs.join(items.hint("merge"), ["minhash", "win"]).select("doc_id", "item_id", "win")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id): distinct pairs."""
    return leak_windows(documents, item_windows(items)).select("doc_id", "item_id").distinct()


def leak_containment(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_windows, containment): share of the item's windows found."""
    tests = item_windows(items)
    shared = leak_windows(documents, tests).distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"))
    sizes = tests.groupBy("item_id").agg(F.count_distinct("win").alias("n_windows"))
    return shared.join(sizes, "item_id").select("doc_id", "item_id", "n_shared", "n_windows", F.round(F.col("n_shared") / F.col("n_windows"), 6).alias("containment"))
