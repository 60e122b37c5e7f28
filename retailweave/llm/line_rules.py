"""Quality rules of whole texts and the frequency of their lines across a host's documents.

The base rules look at one text: words, code points in words, symbols, lines equal to an earlier line, and words inside
three-word windows that the text holds twice or more. A text of under `MIN_WORDS` words, or with more than half of its
words in repeated windows, fails them.

The method looks across documents. Lines are normalised (A-Z to lower case, every digit to 0, white space to single
blanks, trimmed) and hashed; per host and line the distinct documents are counted. A line is above the limit if at least
`MIN_DOCS` documents of the host hold it and these are more than `SHARE` of the host's documents: menus, notices and
other text that comes with the host. Such lines are removed, and a document of whose words less than `RESIDUE` is left
is rejected as depleted. The limit is a share, so a host is judged alike however much of it has been read.

Documents are told apart by their whole text: rows that repeat a text are one document of their host, in counts and in
the host's total, so that copies do not turn their own lines into furniture. Lines without a word are not counted.

One pass over the texts writes a digest per row (figures, line hashes, no text) to the shared folder; counting and
judging work on digests. Lines are counted per task before they are shuffled, the distinct documents of a line by (host,
line, document), so neither a hot host nor a line of every document meets in one task. Of the lines above the limit a
host has at most (lines of its documents) / SHARE / (documents); they are joined by their size as Spark sees it.

A line's hash has 64 bits. A wrong removal needs a line to share its hash with one above the limit on the same host,
which of 10^12 lines against a million such ones is expected 0.05 times.

Defined cases: a null text is empty, has no words and fails the base rules; a null host is a host; null and repeated ids
change nothing, as ids are not used; long texts are worked on whole; a column with the result's name is replaced, all
others pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import written
from .columns import clear_of, free_prefix
from .words import slices, utf8

MIN_WORDS = 50
REPEATED = 0.5
WINDOW = 3
MIN_DOCS = 10
SHARE = 0.01
RESIDUE = 0.5

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))  # bytes of UTF-8 that begin no code point
_EVEN = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_FIGURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_DIGEST = f"{_FIGURES}, document bigint, lines array<struct<line:bigint,words:bigint,places:array<int>>>"


# --- one text -------------------------------------------------------------------------------------------------------


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    keys = ids[: n - WINDOW + 1]
    for i in range(1, WINDOW):
        # keys and words number at most n each, so the pair fits 63 bits
        pairs = keys * n + ids[i : n - WINDOW + 1 + i]
        _, keys, counts = np.unique(pairs, return_inverse=True, return_counts=True)
    often = counts[keys] > 1
    if not often.any():
        return 0
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, np.flatnonzero(often), 1)
    np.add.at(edges, np.flatnonzero(often) + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def digest(text: bytes) -> tuple:
    """Figures of a UTF-8 text, the hash of the whole and its lines: hash, words and places of each distinct one."""
    words = text.split()
    chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    seen: set[bytes] = set()
    lines: dict[int, list] = {}
    dup = 0
    for place, raw in enumerate(text.split(b"\n")):
        tokens = raw.translate(_EVEN).split()
        if not tokens:
            continue
        if raw in seen:
            dup += 1
        else:
            seen.add(raw)
        entry = lines.setdefault(_signed(xxhash.xxh64_intdigest(b" ".join(tokens))), [0, []])
        entry[0] += len(tokens)
        entry[1].append(place)
    found = [{"line": h, "words": n, "places": p} for h, (n, p) in lines.items()]
    return len(words), chars, symbols, dup, repeated_words(words), _signed(xxhash.xxh64_intdigest(text)), found


def _digested(docs: DataFrame, text: str, keep_text: bool, name: str) -> DataFrame:
    """The rows with the struct `name` of figures and lines, without the text unless it is kept."""
    place = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != place]
    struct = T.StructType.fromDDL(_DIGEST)
    schema = T.StructType([*[docs.schema.fields[i] for i in kept], T.StructField(name, struct)])
    kind, fields = to_arrow_type(struct), struct.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [dict(zip(fields, digest(t or b""), strict=True)) for t in utf8(part.column(place))]
            columns = [part.column(i) for i in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(scan, schema)


# --- across documents -----------------------------------------------------------------------------------------------


def _common_lines(digests: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, line) of the lines above the limit; digests are (host, document, lines)."""
    documents = digests.select("host", "document").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("documents"))
    held = digests.select("host", "document", F.explode("lines.line").alias("line")).distinct()
    counts = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("held_by")).where(F.col("held_by") >= min_docs)
    return counts.join(documents, "host").where(F.col("held_by") > F.col("documents") * share).select("host", "line")


def _without(text: str, places) -> str:
    """The text without the lines at these places."""
    gone = set(places)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def _cut(text: Column, places: Column) -> Column:
    @F.pandas_udf("string")
    def cut(texts: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or g is None else _without(t, g) for t, g in zip(texts, gone, strict=True)])

    return cut(text, places)


def judge(
    docs: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    min_words: int = MIN_WORDS,
    min_docs: int = MIN_DOCS,
    share: float = SHARE,
    residue: float = RESIDUE,
    cleaned: bool = False,
    result: str = "rules",
) -> DataFrame:
    """The rows without their text, with the struct `result`: the base figures, `base_failed`, `n_common_lines`,
    `left_words` and `kept`. With `cleaned` the text stays, without the lines above the limit."""
    docs = clear_of(docs, result)
    prefix = free_prefix(docs)
    digest_name, number = f"{prefix}digest", f"{prefix}row"
    scanned = _digested(docs, text, cleaned, digest_name).withColumn(number, F.monotonically_increasing_id())
    rows = written(docs.sparkSession, scanned, "line-rules")

    figures = F.col(digest_name)
    key = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host")
    digests = rows.select(F.col(number).alias("row"), key, figures["document"].alias("document"), figures["lines"].alias("lines"))
    common = written(docs.sparkSession, _common_lines(digests, min_docs, share), "line-rules-common")
    hits = digests.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*").join(common, ["host", "line"])
    totals = [F.sum("words").alias("words"), F.sum(F.size("places")).alias("lines")]
    if cleaned:
        totals.append(F.flatten(F.collect_list("places")).alias("places"))
    removed = hits.groupBy("row").agg(F.struct(*totals).alias(f"{prefix}removed")).withColumnRenamed("row", number)

    gone = F.col(f"{prefix}removed")
    n_words = figures["n_words"]
    left = n_words - F.coalesce(gone["words"], F.lit(0))
    failed = (n_words < min_words) | (figures["n_repeat_words"] > n_words * REPEATED)
    cells = [figures[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    rules = F.struct(
        *cells,
        failed.alias("base_failed"),
        F.coalesce(gone["lines"], F.lit(0)).cast("long").alias("n_common_lines"),
        left.alias("left_words"),
        (~failed & (left >= n_words * residue)).alias("kept"),
    )
    judged = rows.join(removed, number, "left").withColumn(result, rules)
    if cleaned:
        judged = judged.withColumn(text, _cut(F.col(text), gone["places"]))
    return judged.drop(digest_name, number, f"{prefix}removed")
