"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over the training text.

Words are those of `words.words`. A window is `n` consecutive words of a benchmark item; an item with fewer words, but
not none, is one window. Every document word inside an occurrence of a window is hit.

The windows travel to the executors as one broadcast. Its size is checked: an index takes at most `part_bytes` of
benchmark text, and a larger benchmark is dealt into as many parts as that needs, each with a scan of its own whose
hits are joined to the documents.

Defined cases: null and empty texts have no words and no hits; items without words have no window; the windows of items
with a null id hit words like any others, but name no item; repeated items and
documents count as often as they are there; an empty benchmark hits nothing; other columns pass through as they are, but for
one with the result's name, which the result replaces.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import clear_of, free_prefix
from .words import mix, slices, utf8, words

WINDOW = 10
PART_BYTES = 64 << 20
HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),  # first and last word of each hit run
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20


class WindowIndex:
    """Windows of some benchmark items: a bit filter on their hashes first, then the words themselves."""

    def __init__(self, items: Iterable[tuple[int, bytes | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for item, text in items:
            found = words(text)
            if not found:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64)
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1):
                owners = self.windows[size].setdefault(ids[i : i + size].tobytes(), [])
                if item not in owners:
                    owners.append(item)
        self.filters: dict[int, np.ndarray] = {}
        for size, table in self.windows.items():
            bits = np.zeros(1 << _FILTER_BITS, bool)
            keys = np.frombuffer(b"".join(table), np.uint64).reshape(-1, size)
            bits[self._slot(keys.T)] = True
            self.filters[size] = bits

    @staticmethod
    def _slot(columns: Iterable[np.ndarray]) -> np.ndarray:
        hashed = None
        for column in columns:
            hashed = column.copy() if hashed is None else hashed * _STEP + column
        return (mix(hashed) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def hits(self, found: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and the items that hit them."""
        hit, items = np.zeros(len(found), bool), set()
        if not self.vocabulary or not found:
            return hit, items
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in found), np.uint64, len(found))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        for size, table in self.windows.items():
            if len(ids) < size:
                continue
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])
            if len(starts):
                starts = starts[self.filters[size][self._slot(ids[starts + i] for i in range(size))]]
            for i in starts.tolist():
                owners = table.get(ids[i : i + size].tobytes())
                if owners:
                    hit[i : i + size] = True
                    items.update(owners)
        return hit, items - {None}


def _runs(hit: np.ndarray) -> list[list[int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return [[int(a), int(b) - 1] for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _parts(benchmark: DataFrame, item: str, text: str, n: int, part_bytes: int) -> list[WindowIndex]:
    """Indexes of the whole benchmark, each of at most `part_bytes` of text (or of one item that is larger)."""
    rows = benchmark.select(F.col(item).cast("long").alias("item"), F.encode(F.col(text), "UTF-8").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // part_bytes) or 1
    indexes = []
    for part in range(count):
        mine = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == part)
        indexes.append(WindowIndex(((r["item"], r["text"] and bytes(r["text"])) for r in mine.toLocalIterator()), n))
    return indexes


def _scan(docs: DataFrame, index: WindowIndex, text: str, result: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, HITS)])
    arrow = pa.struct(
        [
            ("n_words", pa.int64()),
            ("n_hit", pa.int64()),
            ("spans", pa.list_(pa.list_(pa.int64()))),
            ("items", pa.list_(pa.int64())),
        ]
    )
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in slices(batches):
            out = []
            for value in utf8(batch.column(place)):
                found = words(value)
                hit, items = index.hits(found)
                out.append((len(found), int(hit.sum()), _runs(hit) if hit.any() else [], sorted(items)))
            names = arrow.names
            hits = pa.array([dict(zip(names, r, strict=True)) for r in out], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, hits], names=[*batch.schema.names, result])

    return docs.mapInArrow(scan, schema)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    result: str = "leak",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Adds `result`: words, hit words, hit runs (first and last word) and the items hit, of every document."""
    docs = clear_of(docs, result)
    parts = _parts(benchmark, item, item_text, n, part_bytes)
    if len(parts) == 1:
        return _scan(docs, parts[0], text, result)
    # a benchmark beyond one broadcast: hits of each part by text, joined back to the documents
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    texts = docs.select(F.col(text).alias("text"), key.alias("k")).dropDuplicates(["k"])
    found = None
    for index in parts:
        one = _scan(texts, index, "text", "h").where("h.n_hit > 0").select("k", "h.spans", "h.items")
        found = one if found is None else found.unionByName(one)
    found = found.groupBy("k").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    counted = _scan(docs, WindowIndex([], n), text, result)
    name = free_prefix(docs)
    counted = counted.withColumn(f"{name}k", key)
    renamed = found.select(
        F.col("k").alias(f"{name}k"), F.col("spans").alias(f"{name}spans"), F.col("items").alias(f"{name}items")
    )
    marked = counted.join(renamed, f"{name}k", "left")
    merged = F.expr(
        f"aggregate(array_sort({name}spans), cast(array() as array<array<bigint>>), (a, s) -> "
        "CASE WHEN size(a) > 0 AND s[0] <= element_at(a, -1)[1] + 1 "
        "THEN concat(slice(a, 1, size(a) - 1), array(array(element_at(a, -1)[0], greatest(s[1], element_at(a, -1)[1])))) "
        "ELSE concat(a, array(s)) END)"
    )
    spans = F.coalesce(merged, F.array().cast("array<array<bigint>>"))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0] + 1)
    items = F.coalesce(f"{name}items", F.array().cast("array<bigint>"))
    whole = F.struct(F.col(f"{result}.n_words"), n_hit.alias("n_hit"), spans.alias("spans"), items.alias("items"))
    return marked.withColumn(result, whole).select(*docs.columns, result)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", how: str = "spans", **options) -> DataFrame:
    """Documents without the benchmark's passages: `how` = "documents" drops a hit document, "spans" its hit words.

    Cutting goes on until nothing is hit any more, since words on both sides of a cut may form a new window. A document
    of which no word is left goes; documents without a hit stay as they are, empty ones too.
    """
    result = f"{free_prefix(docs)}leak"
    found = find_leaks(docs, benchmark, text=text, result=result, **options)
    if how == "documents":
        return found.where(F.col(f"{result}.n_hit") == 0).drop(result)
    parts = _parts(
        benchmark, options.get("item", "item_id"), options.get("item_text", "text"), options.get("n", WINDOW),
        options.get("part_bytes", PART_BYTES),
    )
    shared = [docs.sparkSession.sparkContext.broadcast(index) for index in parts]
    place = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = [s.value for s in shared]
        for batch in slices(batches):
            texts, keep = utf8(batch.column(place)), []
            hits = batch.column(batch.num_columns - 1).field("n_hit").to_pylist()
            for i, n_hit in enumerate(hits):
                if n_hit:
                    texts[i] = _without(texts[i], indexes)
                keep.append(not n_hit or bool(words(texts[i])))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.binary()).cast(pa.string())
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])
            yield out.filter(pa.array(keep, pa.bool_()))

    return found.mapInArrow(cut, docs.schema)


def _without(text: bytes, indexes: list[WindowIndex]) -> bytes:
    while True:
        found = words(text)
        hit = np.zeros(len(found), bool)
        for index in indexes:
            hit |= index.hits(found)[0]
        if not hit.any():
            return text
        ends = _word_ends(text)
        pieces, at = [], 0
        for first, last in _runs(hit):
            pieces.append(text[at : ends[first][0]])
            at = ends[last][1]
        pieces.append(text[at:])
        text = b" ".join(p.strip(b" ") for p in pieces if p.strip(b" "))


def _word_ends(text: bytes) -> np.ndarray:
    from .words import _WORD_BYTES

    inside = np.frombuffer(text.translate(_WORD_BYTES), np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.astype(np.int8), [0]))))
    return edges.reshape(-1, 2)
