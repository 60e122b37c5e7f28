"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Documents of up to `CHUNK` characters are encoded whole. Longer ones are cut into chunks of `CHUNK` characters plus an
overlap, spread over the cluster, encoded with offsets and spliced: neighbours are joined at a place in the overlap where
both have a boundary between words of the tokenizer's first split. That split runs from left to right, only looks ahead,
and what it finds after a boundary does not depend on what came before; tokens never cross it. A chunk's own last
`MARGIN` characters and its last word are no proof, as the text goes on there. So a common boundary is stable: left of it
the left chunk is right, right of it the right one. A document with a seam that has none is cut anew with an overlap
`WIDEN` times as wide, until one chunk holds it all.

Short documents repeat words, so a task remembers the token counts of the words it has met and asks the library for new
ones only. This needs the same first split outside the library, which is held against the library for every character
it is used on; texts with other characters or with a special token's string go to the library whole.

Defined cases: null is an empty text; empty texts have 0 tokens; rows that repeat an id are counted each on their own;
other columns pass through, but for one with the result's name, which the result replaces; an empty table gives an empty one.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_path
from .columns import clear_of, free_prefix

CHUNK = 1 << 16
OVERLAP = 512
WIDEN = 8
MARGIN = 32
LIMIT = 512
_CACHE_WORDS = 400_000
_BATCH = 512

#: The vocabulary's first split, and the characters that the quick path takes.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = "\t\n\r -~¡-¬®-ɏΑ-ΡΣ-ωА-я‐-‧‰-⁞€"
_OTHER = regex.compile(f"[^{PLAIN}]")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Counter:
    """Token counts of whole texts in one task."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def quick(self, text: str) -> bool:
        return not _OTHER.search(text) and not any(s in text for s in self.special)

    def __call__(self, texts: list[str]) -> list[int]:
        counts: list[int] = [0] * len(texts)
        split: list[tuple[int, list[str]]] = []
        rest: list[int] = []
        for i, text in enumerate(texts):
            if self.quick(text):
                split.append((i, SPLIT.findall(text)))
            else:
                rest.append(i)
        if len(self.known) > _CACHE_WORDS:
            self.known.clear()
        known = self.known
        new = list({w for _, found in split for w in found if w not in known})
        known.update(zip(new, self.whole(new), strict=True))
        for i, found in split:
            counts[i] = sum(map(known.__getitem__, found))
        for i, n in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            counts[i] = n
        return counts


def _strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _counted_whole(docs: DataFrame, text: str, path: str, result: str) -> DataFrame:
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, T.LongType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(path)
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                counts = pa.array(count(_strings(part.column(place))), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, counts], names=[*part.schema.names, result])

    return docs.mapInArrow(scan, schema)


def _chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, number, start, last, piece): pieces of `chunk` characters that reach `overlap` into the next one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), _strings(batch.column(1)), strict=True):
                starts = range(0, max(len(text) - overlap, 1), chunk)
                for number, start in enumerate(starts):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": [key],
                            "number": pa.array([number], pa.int32()),
                            "start": pa.array([start], pa.int64()),
                            "last": [number == len(starts) - 1],
                            "piece": [text[start : start + chunk + overlap]],
                        }
                    )

    pieces = texts.mapInArrow(cut, "key string, number int, start long, last boolean, piece string")
    return pieces.repartition("key", "number")


def _encoded(pieces: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """Per chunk its tokens, and word boundaries in its two overlaps with the tokens before them."""
    seam = "array<struct<at:bigint,tokens:bigint>>"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        kind = pa.list_(pa.struct([("at", pa.int64()), ("tokens", pa.int64())]))
        for batch in batches:
            for row in batch.to_pylist():
                piece, start = row["piece"], row["start"]
                found = tokenizer.encode(piece, add_special_tokens=False)
                ids, offsets = found.word_ids, found.offsets
                places = [
                    (offsets[i][0], i) for i in range(len(ids)) if i == 0 or ids[i] is None or ids[i] != ids[i - 1]
                ]
                safe = len(piece) - MARGIN
                left = [{"at": start + p, "tokens": i} for p, i in places if row["number"] and p <= overlap]
                right = [
                    {"at": start + p, "tokens": i}
                    for p, i in places[:-1]
                    if not row["last"] and chunk <= p < safe
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["key"]]),
                        pa.array([row["number"]], pa.int32()),
                        pa.array([row["last"]]),
                        pa.array([len(found)], pa.int64()),
                        pa.array([left], kind),
                        pa.array([right], kind),
                    ],
                    names=["key", "number", "last", "tokens", "lefts", "rights"],
                )

    return pieces.mapInArrow(
        encode, f"key string, number int, last boolean, tokens long, lefts {seam}, rights {seam}"
    )


def _spliced(encoded: DataFrame) -> DataFrame:
    """(key, n_tokens): null for a text that has a seam without a common boundary."""
    order = Window.partitionBy("key").orderBy("number")
    both = encoded.withColumn("next_lefts", F.lead("lefts").over(order))
    places = F.array_intersect(
        F.transform("rights", lambda x: x["at"]), F.transform("next_lefts", lambda x: x["at"])
    )
    both = both.withColumn("seam", F.when(~F.col("last"), F.array_min(places)))

    def before(side: str):
        return F.expr(f"get(filter({side}, x -> x.at = seam), 0).tokens")

    upto = F.when(F.col("last"), F.col("tokens")).otherwise(before("rights"))
    skipped = F.when(F.col("last"), F.lit(0)).otherwise(before("next_lefts"))
    sums = both.groupBy("key").agg(
        F.sum(upto - skipped).alias("n_tokens"),
        F.max((~F.col("last") & F.col("seam").isNull()).cast("int")).alias("open"),
    )
    return sums.select("key", F.when(F.col("open") == 0, F.col("n_tokens")).alias("n_tokens"))


def _written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def huge_text_counts(texts: DataFrame, path: str, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_tokens) of texts (key, text) with distinct keys, by overlapping chunks."""
    spark, done = texts.sparkSession, None
    while True:
        counts = _written(spark, _spliced(_encoded(_chunks(texts, chunk, overlap), path, chunk, overlap)), "token-counts")
        closed = counts.where("n_tokens is not null")
        done = closed if done is None else done.union(closed)
        open_keys = counts.where("n_tokens is null").select("key")
        if open_keys.isEmpty():
            return done
        texts, overlap = texts.join(open_keys, "key", "left_semi"), overlap * WIDEN


def count_tokens(
    docs: DataFrame,
    path: str,
    *,
    text: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    result: str = "n_tokens",
) -> DataFrame:
    """Adds `result`, the tokens of the whole text under the tokenizer file at `path`, the same on every machine."""
    docs = clear_of(docs, result)
    name = f"{free_prefix(docs)}key"
    long = F.coalesce(F.length(text), F.lit(0)) > chunk
    short = _counted_whole(docs.where(~long), text, path, result)
    huge = docs.where(long).withColumn(name, F.sha2(F.col(text), 256))
    texts = huge.select(F.col(name).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    counts = huge_text_counts(texts, path, chunk=chunk, overlap=overlap)
    counts = counts.select(F.col("key").alias(name), F.col("n_tokens").alias(result))
    return short.unionByName(huge.join(counts, name).select(*docs.columns, result))
