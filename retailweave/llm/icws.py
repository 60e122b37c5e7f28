"""MinHash near-dedup for weighted sets: improved consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its runs of five words (fewer if it has fewer), weight = occurrences * idf. Improved
consistent weighted sampling draws `BANDS * ROWS` samples (shingle, level) per set; two sets share a sample with the
probability of their weighted Jaccard similarity. Documents that share all samples of a band are candidates, and a
pair is linked if the weighted Jaccard similarity of the whole texts is `SIMILARITY` or more.

idf. The relative document frequency f gives idf = ln(1 / max(f, FLOOR)) / ln(1 / FLOOR), from 1 for anything up to the
floor to 0 (0.05 at least) for a shingle of every document. Frequencies cover every document; copies count once, or a
large group would take the weight from what its members share: documents with the same smallest shingle hash are one
family, counted through its first member. As only shingles above the floor need telling apart, the counts are a
count-min sketch (2 rows of 2^18 cells, mean corrected): 4 MB at any input size, whose error against the floor falls
with the number of documents.

Work. Documents with the same words are one content from the start. Each bucket's members are compared with its leader,
the content that shares the most buckets with others (in a group of edited copies that is the one closest to all, as a
rule their original), and with the next `NEIGHBOURS` ones in a hashed order. Then members of one bucket that these links
leave in different groups are compared with each other. So a group of thousands of copies takes a few comparisons for
each of its members, while no candidate pair of different groups is left out. These pairs never become rows: a bucket's
largest group and its other members are dealt into blocks of `BLOCK_ROWS` contents or `BLOCK_BYTES` of text, each block of
the others meets every block in a task that holds the two, and only links that join groups leave it. The largest group
never meets itself, so rows grow with the others' blocks, of which a bucket below the bounds has one. Before texts are
compared, a pair must agree in `AGREEMENT` of its samples, which a pair at the threshold fails with a probability under 1
in 10,000, and, for leaders and neighbours, then in its bins: elements (shingle, occurrence), kept with the
probability of their idf, are dealt into `BINS` bins by hash, and a bin holds its smallest hash. The share of equal bins
estimates the weighted similarity, for short texts by a near full count; a pair may fall short by `SLACK` standard
errors, which hold both the sampling into bins and the thinning by idf. Of simulated pairs at the threshold (30 to 800
shingles, idf 0.05 to 1 in mixtures of two values, differences in the frequent or in the rare ones) 1 in 1,000 or fewer fail
on average up to a thinning variance of half the weight. Where it is more than `THINNED` of a text's weight (frequent shingles throughout),
bins say too little: the pair goes straight to the exact comparison.

Defined cases: null and empty texts, and those without words, are never near anything and stay; rows with the same id
and words are one document; null ids come last (any number of them: a text is found again by id and hash); an empty table gives an empty one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import work_path
from .columns import free_prefix
from .graph import connected_components
from .words import WordHashes, mix, shingles, slices, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
AGREEMENT = 0.55
BINS, SLACK = 256, 2.5
THINNED = 0.5
NEIGHBOURS, RING = 3, 1000
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 22
FLOOR = 1 / 256
LEAST_WEIGHT = 0.05
SKETCH_ROWS, SKETCH_BITS, SKETCH_BLOCK = 2, 18, 1024
LAST_ID = 2**63 - 1
_CHUNK = 1 << 15
_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _wrapped(a: int, b: np.uint64) -> int:
    return a * int(b) % (1 << 64)


# --- weights -------------------------------------------------------------------------------------------------------


def _cells(keys: np.ndarray) -> list[np.ndarray]:
    """The sketch cell of each shingle, per row of the sketch."""
    width = 1 << SKETCH_BITS
    return [
        row * width + (mix(keys + np.uint64(_wrapped(row + 1, _ONE))) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
        for row in range(SKETCH_ROWS)
    ]


class Idf:
    """idf of shingles from the summed sketch of `families` documents."""

    def __init__(self, sketch: np.ndarray, families: int):
        width = 1 << SKETCH_BITS
        self.sketch, self.families = sketch.reshape(SKETCH_ROWS, width), max(families, 1)
        self.noise = self.sketch.sum(axis=1) / width
        flat = np.maximum(self.sketch - self.noise[:, None], 0) / self.families
        share = np.clip(flat, FLOOR, 1)
        self.weights = np.maximum(np.log(share) / np.log(FLOOR), LEAST_WEIGHT).astype(np.float32).ravel()

    def of(self, keys: np.ndarray) -> np.ndarray:
        # the least count of the rows is the largest weight
        return np.maximum.reduce([self.weights[cells] for cells in _cells(keys)])


def weighted_set(text: bytes | None, hashes: WordHashes, idf: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a text in ascending order, and their weights."""
    keys, counts, shares = _counted_set(words(text), hashes, idf)
    return keys, counts * shares


def _counted_set(found: list[bytes], hashes: WordHashes, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, counts = np.unique(shingles(hashes.of(found), SHINGLE), return_counts=True)
    return keys, counts, idf.of(keys).astype(np.float64)


def bins(keys: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, int]:
    """Smallest 15-bit hash of the kept elements in each bin, -1 for none; and the number of kept elements."""
    if counts.max(initial=1) > 1:
        occurrence = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        keys, shares = np.repeat(keys, counts), np.repeat(shares, counts)
        keys = keys + occurrence.astype(np.uint64) * _ONE
    elements = mix(keys ^ _TWO)
    elements = mix(elements[(elements >> np.uint64(11)).astype(np.float64) * 2.0**-53 < shares])
    out = np.full(BINS, 1 << 15, np.int32)
    places = (elements >> np.uint64(48)).astype(np.int64) % BINS
    np.minimum.at(out, places, ((elements >> np.uint64(32)) & np.uint64(0x7FFF)).astype(np.int32))
    out[out == 1 << 15] = -1
    return out.astype(np.int16), len(elements)


def thinning(counts: np.ndarray, shares: np.ndarray) -> tuple[float, float]:
    """Expected number of kept elements, and its variance."""
    return float((counts * shares).sum()), float((counts * shares * (1 - shares)).sum())


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total > 0 else 0.0


# --- consistent weighted sampling ------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) e^-x, and their logarithms."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(u), np.full_like(u, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < u
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return low.astype(np.float32), np.log(low).astype(np.float32)


def signatures(keys: np.ndarray, weights: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """(sets, samples) 32-bit samples of the sets that begin at `starts` in `keys`; no set is empty."""
    gamma, log_gamma = _gamma_tables()
    low16 = np.uint64(0xFFFF)
    lengths = np.diff(np.append(starts, len(keys)))
    log_weights = np.log(weights).astype(np.float32)
    out = np.empty((len(starts), samples), np.uint32)
    # buffers of all rounds; table places are below 2^16, so they can be read as signed
    h, part = np.empty((2, len(keys)), np.uint64)
    r, log_c, beta, level, log_a = np.empty((5, len(keys)), np.float32)
    for i in range(samples):
        np.bitwise_xor(keys, np.uint64(_wrapped(i + 1, _TWO)), out=h)
        h *= _ONE
        h ^= np.right_shift(h, np.uint64(32), out=part)
        h *= _TWO
        h ^= np.right_shift(h, np.uint64(29), out=part)
        np.bitwise_and(h, low16, out=part)
        gamma.take(part.view(np.int64), out=r, mode="clip")
        np.right_shift(h, np.uint64(16), out=part)
        part &= low16
        log_gamma.take(part.view(np.int64), out=log_c, mode="clip")
        np.copyto(beta, np.right_shift(h, np.uint64(32), out=part), casting="unsafe")
        beta *= np.float32(2.0**-32)
        np.divide(log_weights, r, out=level)
        level += beta
        np.floor(level, out=level)
        # log_c - r * (level - beta + 1)
        np.subtract(level, beta, out=log_a)
        log_a += np.float32(1)
        log_a *= r
        np.subtract(log_c, log_a, out=log_a)
        least = np.minimum.reduceat(log_a, starts)
        places = np.flatnonzero(log_a == np.repeat(least, lengths))
        owner = np.searchsorted(starts, places, side="right") - 1
        first = places[np.concatenate(([True], owner[1:] != owner[:-1]))]
        drawn = mix(keys[first] + level[first].astype(np.int64).astype(np.uint64) * _ONE + np.uint64(i))
        out[:, i] = (drawn >> np.uint64(32)).astype(np.uint32)
    return out


def _signed_batch(
    texts: list[bytes | None], hashes: WordHashes, idf: Idf, samples: int
) -> tuple[list[bytes], list[np.ndarray], list[tuple[np.ndarray, int, float, float]]]:
    """Content, samples and (bins, kept elements, their expectation and variance) of each text that has words, in chunks
    that fit the processor's cache."""
    contents: list[bytes] = []
    out: list[np.ndarray] = []
    binned: list[tuple[np.ndarray, int, float, float]] = []
    sets: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if sets:
            starts = np.cumsum([0, *[len(k) for k, _ in sets[:-1]]])
            both = signatures(np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets]), starts, samples)
            out.extend(both)
            sets.clear()
            held = 0

    for text in texts:
        found = words(text)
        if not found:
            continue
        keys, counts, shares = _counted_set(found, hashes, idf)
        contents.append(_content(found))
        binned.append((*bins(keys, counts, shares), *thinning(counts, shares)))
        sets.append((keys, counts * shares))
        held += len(keys)
        if held >= _CHUNK:
            flush()
    flush()
    return contents, out, binned


def _band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands) bucket keys."""
    parts = signed.astype(np.uint64).reshape(len(signed), bands, rows)
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _TWO
    for i in range(rows):
        keys = mix(keys * _ONE + parts[:, :, i])
    return keys.view(np.int64)


# --- steps -----------------------------------------------------------------------------------------------------------


def _written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _plain(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(text).alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def _content(found: list[bytes]) -> bytes | None:
    return xxhash.xxh3_128_digest(b" ".join(found)) if found else None


def _memberships(rows: DataFrame) -> DataFrame:
    """(doc, content, family, rows, mark, marked): contents by their words; null for texts without any.

    `mark` is the hash of one of the texts with these words, `marked` the rows that have it: (doc, mark) finds a
    member's text again, also where many rows share an id or have none.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            contents, families = [], []
            for text in utf8(batch.column(1)):
                found = words(text)
                contents.append(_content(found))
                families.append(int(shingles(hashes.of(found), SHINGLE).min().view(np.int64)) if found else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(contents, pa.binary()), pa.array(families, pa.int64())],
                names=["doc", "mark", "content", "family"],
            )

    found = rows.mapInArrow(scan, "doc long, mark long, content binary, family long")
    same = found.groupBy("doc", "content", "family", "mark").agg(F.count(F.lit(1)).alias("n"))
    own = F.min(F.struct("mark", "n")).alias("own")
    members = same.groupBy("doc", "content", "family").agg(F.sum("n").alias("rows"), own)
    return members.select("doc", "content", "family", "rows", F.col("own.mark").alias("mark"), F.col("own.n").alias("marked"))


def _sketch(rows: DataFrame, first_members: DataFrame) -> np.ndarray:
    """Document frequencies of all shingles over the families' first members."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells = WordHashes(), np.zeros(SKETCH_ROWS << SKETCH_BITS, np.float32)
        held: dict[int, list[np.ndarray]] = {}  # by the rows that share a document

        def add_up(n: int) -> None:
            places = np.concatenate(held.pop(n))
            cells[:] += np.bincount(places, minlength=len(cells)).astype(np.float32) / np.float32(n)

        for batch in slices(batches):
            wanted, weights = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for text, content, n in zip(utf8(batch.column(0)), wanted, weights, strict=True):
                found = words(text)
                if _content(found) != content:
                    continue  # another text under the same id
                held.setdefault(n, []).extend(_cells(np.unique(shingles(hashes.of(found), SHINGLE))))
                if sum(map(len, held[n])) > _CHUNK * 8:
                    add_up(n)
        for n in list(held):
            add_up(n)
        # per block the filled cells and what they count
        filled = [(i, np.flatnonzero(block).astype(np.int16), block) for i, block in enumerate(cells.reshape(-1, SKETCH_BLOCK))]
        filled = [(i, at.tobytes(), block[at].tobytes()) for i, at, block in filled if len(at)]
        kinds = (pa.int64(), pa.binary(), pa.binary())
        columns = [pa.array([f[c] for f in filled], kind) for c, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "places", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in slices(batches):
            for block, places, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(block, np.zeros(SKETCH_BLOCK))
                own[np.frombuffer(places, np.int16)] += np.frombuffer(cells, np.float32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
            names=["block", "cells"],
        )

    mine = rows.join(first_members, ["doc", "mark"]).select("text", "content", "marked")
    parts = mine.mapInArrow(count, "block long, places binary, cells binary")
    summed = parts.repartition("block").mapInArrow(add, "block long, cells binary").collect()  # 4 MB at any size
    sketch = np.zeros(SKETCH_ROWS << SKETCH_BITS).reshape(-1, SKETCH_BLOCK)
    for row in summed:
        sketch[row["block"]] = np.frombuffer(bytes(row["cells"]), np.float64)
    return np.round(sketch).ravel()


def _signed(rows: DataFrame, idf, bands: int, per_band: int) -> DataFrame:
    """(content, samples, bins, elements, mass, thinned, buckets) of every text that has words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = WordHashes(), idf.value
        for batch in slices(batches):
            contents, drawn, binned = _signed_batch(utf8(batch.column(0)), hashes, weights, bands * per_band)
            if not contents:
                continue
            signed = np.array(drawn)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(contents, pa.binary()),
                    pa.array(list(signed.view(np.int32)), pa.list_(pa.int32())),
                    pa.array([b[0] for b in binned], pa.list_(pa.int16())),
                    pa.array([b[1] for b in binned], pa.int32()),
                    pa.array([b[2] for b in binned], pa.float32()),
                    pa.array([b[3] for b in binned], pa.float32()),
                    pa.array(list(_band_keys(signed, bands, per_band)), pa.list_(pa.int64())),
                ],
                names=["content", "samples", "bins", "elements", "mass", "thinned", "buckets"],
            )

    return rows.select("text").mapInArrow(
        scan,
        "content binary, samples array<int>, bins array<smallint>, elements int, mass float, thinned float, buckets array<bigint>",
    )


def _may_be_near(least: int, similarity: float):
    """Of rows with samples and bins of both sides: the pairs worth comparing."""
    # a sample's hash holds its number, so equal values are equal samples
    same = F.size(F.array_intersect("samples_a", "samples_b"))
    # filled bins count 65536, equal ones 1 more
    both = F.zip_with("bins_a", "bins_b", lambda x, y: F.when((x >= 0) | (y >= 0), 65536 + (x == y).cast("int")).otherwise(0))
    counted = F.aggregate(both, F.lit(0), lambda n, x: n + x)
    # the variance is largest if what the two do not share is thinned as much as it can be
    thinned = F.col("thinned_a") + F.col("thinned_b")
    unshared = F.least(thinned, (F.col("mass_a") + F.col("mass_b")) * ((1 - similarity) / (1 + similarity)))
    variance = (1 - similarity) ** 2 * (thinned - unshared) / 2 + similarity**2 * unshared
    too_thin = (F.col("thinned_a") > THINNED * F.col("mass_a")) | (F.col("thinned_b") > THINNED * F.col("mass_b"))
    all_elements = F.greatest(F.col("elements_a") + F.col("elements_b"), F.lit(1)) / (1 + similarity)

    def near_enough(c):
        filled = F.floor(c / 65536)
        unseen = F.greatest(F.lit(0.0), 1 - filled / all_elements)
        part = F.least(F.lit(1.0), filled / all_elements)
        spread = F.sqrt(similarity * (1 - similarity) * filled * unseen + variance * part * part)
        return c % 65536 + 1 + SLACK * spread >= similarity * filled

    near = F.transform(F.array(counted), near_enough)
    return F.when(same < least, False).when(too_thin, True).otherwise(F.get(near, F.lit(0)))


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(content, text) of the wanted (content, doc, mark), one row each."""

    def own_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted = batch.column(0).to_pylist()
            same = [_content(words(t)) == c for t, c in zip(utf8(batch.column(1)), wanted, strict=True)]
            yield batch.filter(pa.array(same, pa.bool_()))

    texts = rows.join(wanted, ["doc", "mark"]).select("content", "text").mapInArrow(own_text, "content binary, text string")
    return texts.dropDuplicates(["content"])


def _verified(texts: DataFrame, pairs: DataFrame, idf, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts are as similar as asked for."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = WordHashes(), idf.value
        last, held = None, None
        for batch in slices(batches):
            keep = []
            names, left, right = batch.column(0).to_pylist(), utf8(batch.column(2)), utf8(batch.column(3))
            for name, a, b in zip(names, left, right, strict=True):
                if name != last:
                    last, held = name, weighted_set(a, hashes, weights)
                keep.append(weighted_jaccard(held, weighted_set(b, hashes, weights)) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_())
            )

    both = pairs.join(texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary").distinct()


def _meetings(apart: DataFrame) -> DataFrame:
    """(bucket, i, j, own, content, g): the rows of apart, (bucket, content, g, chars), once for each pair of blocks (i, j)
    that their own block is part of. Two members of different groups meet in exactly one of them."""
    groups = apart.groupBy("bucket", "g").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    whole = groups.groupBy("bucket").agg(
        F.max(F.struct("n", "chars", "g")).alias("top"), F.sum("n").alias("n"), F.sum("chars").alias("chars")
    )

    def blocks(n, chars):
        return F.ceil(F.greatest(n / BLOCK_ROWS, chars / BLOCK_BYTES, F.lit(1.0)))

    one = blocks(F.col("n"), F.col("chars")) == 1
    whole = whole.select(
        "bucket",
        F.when(~one, F.col("top.g")).alias("top"),
        F.when(one, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("chars") - F.col("top.chars"))).alias("others"),
        F.when(one, 0).otherwise(blocks(F.col("top.n"), F.col("top.chars"))).alias("tops"),
    )
    in_top = F.col("g").eqNullSafe(F.col("top"))
    turn = F.xxhash64("content")
    own = F.when(in_top, F.col("others") + F.pmod(turn, F.greatest("tops", F.lit(1)))).otherwise(F.pmod(turn, "others"))
    last = F.when(in_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    placed = apart.join(whole, "bucket").withColumns({"own": own.cast("long"), "other": F.explode(F.sequence(F.lit(0), last))})
    return placed.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "content", "g"
    )


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (bucket, i, j) at a time, of rows sorted by these."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


class _Sets:
    """Weighted sets of the texts of one task, worked out when first asked for."""

    def __init__(self, texts: list[bytes], hashes: WordHashes, idf: Idf):
        self.texts, self.hashes, self.idf = texts, hashes, idf
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.held:
            self.held[i] = weighted_set(self.texts[i], self.hashes, self.idf)
        return self.held[i]

    def near(self, a: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of the others, whose weighted Jaccard similarity with `a` is large enough."""
        keys, weights = self[a]
        sets = [self[b] for b in others.tolist()]
        starts = np.cumsum([0, *[len(k) for k, _ in sets[:-1]]])
        every, own = np.concatenate([k for k, _ in sets]), np.concatenate([w for _, w in sets])
        places = np.minimum(np.searchsorted(keys, every), len(keys) - 1)
        shared = np.add.reduceat(np.where(keys[places] == every, np.minimum(weights[places], own), 0), starts)
        total = weights.sum() + np.add.reduceat(own, starts) - shared
        short = shared - similarity * total
        # sums in another order may differ in their last digits
        for i in np.flatnonzero(np.abs(short) <= 1e-9 * total):
            short[i] = 0 if weighted_jaccard(self[a], sets[i]) >= similarity else -1
        return others[short >= 0]


def _joining_links(
    at: tuple[int, int, int], own: np.ndarray, groups: np.ndarray, samples: np.ndarray, bands: int, least: int, similarity: float, sets: _Sets
) -> list[tuple[int, int]]:
    """Links between the groups of the meeting (bucket, i, j), as few as join what any of its pairs joins."""
    bucket, i, j = at
    buckets = _band_keys(samples, bands, samples.shape[1] // bands)
    label, found = groups.copy(), []
    second = np.flatnonzero(own == j)
    for a in np.flatnonzero(own == i).tolist():
        others = second if i < j else np.arange(a + 1, len(own))
        others = others[label[others] != label[a]]
        others = others[(samples[others] == samples[a]).sum(axis=1) >= least]
        if not len(others):
            continue
        # a pair is looked at in the first of its common buckets
        first = (buckets[others] == buckets[a]).argmax(axis=1)
        others = others[buckets[a][first] == bucket]
        if not len(others):
            continue
        for b in sets.near(a, others, similarity).tolist():
            if label[b] != label[a]:
                found.append((a, b))
                label[label == label[b]] = label[a]
    return found


def _crossed(meetings: DataFrame, signed: DataFrame, texts: DataFrame, idf, bands: int, least: int, similarity: float) -> DataFrame:
    """(a, b): links that join the groups of each bucket, found among all its pairs of different groups."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights = WordHashes(), idf.value
        for met in _met(batches):
            met = met.combine_chunks()
            own = met.column("own").to_numpy()
            names, groups = met.column("content").to_pylist(), met.column("g").to_pylist()
            numbers = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            if len(numbers) == 1:
                continue
            labels = np.array([numbers[g] for g in groups])
            drawn = met.column("samples").combine_chunks().flatten().to_numpy().view(np.uint32).reshape(len(own), -1)
            sets = _Sets(utf8(met.column("text")), hashes, weights)
            at = tuple(met.column(c)[0].as_py() for c in ("bucket", "i", "j"))
            links = _joining_links(at, own, labels, drawn, bands, least, similarity, sets)
            if links:
                sides = [pa.array([names[link[s]] for link in links], pa.binary()) for s in (0, 1)]
                yield pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    rows = meetings.join(signed.select("content", "samples"), "content").join(texts, "content")
    rows = rows.select("bucket", "i", "j", "own", "content", "g", "samples", "text").repartition("bucket", "i", "j")
    return rows.sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows_per_band: int = ROWS,
) -> DataFrame:
    """(doc, content, rows, component, kept) of every document: `component` is the group's smallest id.

    `content` (16 bytes) stands for the document's words, `rows` counts its rows. The kept one of a group is its document
    with the smallest id, of several with this id the one with the smallest content.
    """
    spark = docs.sparkSession
    rows = _plain(docs, doc_id, text)
    members = _written(spark, _memberships(rows), "icws-members")
    worded = members.where("content is not null")
    contents = worded.groupBy("content").agg(F.min(F.struct("doc", "mark")).alias("m")).select("content", "m.*")

    first = F.min(F.struct("doc", "content", "mark", "marked")).alias("m")
    first_members = worded.groupBy("family").agg(first).select("m.*")
    families = worded.select("family").distinct().count()
    idf = spark.sparkContext.broadcast(Idf(_sketch(rows, first_members), families))

    signed = _written(spark, _signed(rows, idf, bands, rows_per_band), "icws-signed")
    # from here on only contents that share a bucket with another one
    buckets = signed.select("content", F.explode("buckets").alias("bucket"))
    common = buckets.groupBy("bucket").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).where("lo < hi")
    common = _written(spark, common.select("bucket"), "icws-common")
    shared = _written(spark, buckets.join(common, "bucket").distinct(), "icws-shared")
    sizes = _written(spark, shared.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "icws-sizes")
    slim = signed.drop("buckets").join(shared.select("content").distinct(), "content").dropDuplicates(["content"])
    signed = _written(spark, slim, "icws-slim")
    texts = _written(spark, _texts(rows, signed.select("content").join(contents, "content")), "icws-texts")
    shared = shared.join(sizes, "bucket")
    degrees = shared.groupBy("content").agg(F.struct(F.sum("n").alias("degree"), "content").alias("own"))
    degrees = _written(spark, degrees, "icws-degrees")
    shared = _written(spark, shared.join(degrees, "content"), "icws-ranked")
    leaders = _written(spark, shared.groupBy("bucket").agg(F.max("own").alias("lead")), "icws-leaders")
    crowded = shared.join(leaders, "bucket").withColumn("leader", F.col("lead.content"))

    least = int(np.ceil(AGREEMENT * bands * rows_per_band))
    near = _may_be_near(least, similarity)
    drawn = ("samples", "bins", "elements", "mass", "thinned")
    samples_a, samples_b = (
        signed.select(F.col("content").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in drawn]) for s in ("a", "b")
    )
    starred = crowded.where("content <> leader").select(F.col("leader").alias("a"), F.col("content").alias("b"))
    part = F.pmod(F.xxhash64("content"), F.ceil(F.col("n") / RING))
    ring = Window.partitionBy("bucket", "part").orderBy("turn")
    turned = shared.select("bucket", "content", part.alias("part"), F.xxhash64("content", "bucket").alias("turn"))
    following = F.array_compact(F.array(*[F.lead("content", i).over(ring) for i in range(1, NEIGHBOURS + 1)]))
    next_ones = turned.select(F.col("content").alias("a"), following.alias("b")).select("a", F.explode("b").alias("b"))
    starred = starred.union(next_ones).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    starred = starred.join(samples_b, "b").join(samples_a, "a").where(near)
    starred = _written(spark, starred.select("a", "b"), "icws-starred")
    links = _written(spark, _verified(texts, starred, idf, similarity), "icws-links")

    # within a bucket, whatever is still apart
    group = connected_components(links).select(F.col("node").alias("content"), F.col("component").alias("g"))
    grouped = shared.join(group, "content", "left").select("bucket", "content", F.coalesce("g", "content").alias("g"))
    grouped = _written(spark, grouped, "icws-grouped")
    mixed = grouped.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("bucket")
    lengths = texts.select("content", F.octet_length("text").alias("chars"))
    apart = grouped.join(_written(spark, mixed, "icws-mixed"), "bucket").join(lengths, "content")
    apart = _written(spark, apart, "icws-apart")
    crossed = _crossed(_meetings(apart), signed, texts, idf, bands, least, similarity)
    links = links.union(_written(spark, crossed, "icws-crossed"))

    components = connected_components(links)
    placed = contents.drop("mark").join(components.select(F.col("node").alias("content"), "component"), "content", "left")
    placed = placed.withColumn("component", F.coalesce("component", "content"))
    placed = _written(spark, placed, "icws-placed")
    heads = placed.groupBy("component").agg(F.min(F.struct("doc", "content")).alias("head"))
    heads = _written(spark, heads, "icws-heads")
    named = placed.join(heads, "component").select("content", "head")
    out = members.drop("mark", "marked").join(named, "content", "left")
    alone = F.col("content").isNull()
    return out.select(
        "doc",
        "content",
        "rows",
        F.when(alone, F.col("doc")).otherwise(F.col("head.doc")).alias("component"),
        (alone | (F.col("head.doc") == F.col("doc")) & (F.col("head.content") == F.col("content"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without all but one of each group of near-duplicates; repeated rows of the kept one go as well."""
    name = free_prefix(docs)
    found = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    stay = found.where("kept").select(F.col("doc").alias(f"{name}doc"), F.col("content").alias(f"{name}content"))
    stay = _written(docs.sparkSession, stay, "icws-stay")
    place = docs.columns.index(text)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            contents = pa.array([_content(words(t)) for t in utf8(batch.column(place))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, contents], names=[*batch.schema.names, f"{name}content"])

    schema = T.StructType([*docs.schema.fields, T.StructField(f"{name}content", T.BinaryType())])
    rows = docs.mapInArrow(named, schema).withColumn(f"{name}doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)))
    same = (F.col(f"r.{name}doc") == F.col(f"s.{name}doc")) & F.col(f"r.{name}content").eqNullSafe(F.col(f"s.{name}content"))
    kept = rows.alias("r").join(stay.alias("s"), same).select("r.*")
    turn = F.row_number().over(Window.partitionBy(f"{name}doc", f"{name}content").orderBy(f"{name}doc"))
    kept = kept.withColumn(f"{name}turn", turn).where(F.col(f"{name}content").isNull() | (F.col(f"{name}turn") == 1))
    return kept.select(*docs.columns)
