"""Fill-in-the-middle: texts cut in prefix, middle and suffix at unit boundaries and put together in another order.

A unit is a run of white space with the run of other characters after it, or white space at the end. One fullmatch of
`(unit)*` by the regex library keeps every repetition of its group: `ends(1)` lists where all units end, so its length
is the number of units and two look-ups in it are the cuts; nothing walks over the text. The quantifiers are possessive,
as a unit never gives characters back, so a match is linear in the text and keeps no places to return to.

The cuts and the form come from sha256 of `seed:id` (four groups of eight hex digits), so a row's outcome depends on its
id and text alone: the same on every machine, in any partitioning and when a lost task runs again. There is no shuffle.

`psm` puts the prefix first, `spm` the suffix; the sentinels stand before the parts they name. As a text that holds a
sentinel stays plain, and no sentinel overlaps itself or another, `restored` splits an output in one way only.

Defined cases: a null text is an empty one, and empty texts are plain with 0 units; a null id is hashed as the empty
string; rows that repeat an id and text come out alike; texts are cut whole, whatever their length; a column with the
result's name is replaced, all others pass through; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .columns import clear_of, free_prefix
from .words import slices

UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or not all(marks):
            raise ValueError("three different sentinels are needed")
        for mark in marks:
            for other in marks:
                if mark != other and other in mark or any(mark.endswith(other[:i]) for i in range(1, len(other))):
                    raise ValueError(f"sentinels overlap: {mark} and {other}")

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def unit_ends(text: str) -> list[int]:
    """Where the units of a text end, in code points."""
    return UNITS.fullmatch(text).ends(1)


def _draws(id_column: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits that follow from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _cut(text: str, draws: list[int], marks: Sentinels, rate: int, spm_rate: int) -> tuple:
    ends = unit_ends(text)
    n = len(ends)
    if not text or draws[2] % 100 >= rate or any(mark in text for mark in marks.all()):
        return n, PLAIN, None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    first, second = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if draws[3] % 100 < spm_rate:
        form, output = SPM, marks.suffix + suffix + marks.prefix + prefix + marks.middle + middle
    else:
        form, output = PSM, marks.prefix + prefix + marks.suffix + suffix + marks.middle + middle
    return n, form, first, second - first, output


def fill_in_middle(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    rate: int = 50,
    spm_rate: int = 80,
    sentinels: Sentinels = Sentinels(),
    result: str = "fim",
) -> DataFrame:
    """Adds the struct `result`: units n, form, prefix_chars and middle_chars (null if plain) and the output.

    `rate` of a hundred texts are reordered, `spm_rate` of a hundred of those with the suffix first.
    """
    docs = clear_of(docs, result)
    draws = f"{free_prefix(docs)}draws"
    rows = docs.withColumn(draws, F.array(*_draws(id_column, seed)))
    place = docs.columns.index(text)
    struct = T.StructType.fromDDL(_RESULT)
    schema = T.StructType([*docs.schema.fields, T.StructField(result, struct)])
    kind, fields = to_arrow_type(struct), struct.names

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, drawn = part.column(place).to_pylist(), part.column(part.num_columns - 1).to_pylist()
            found = [_cut(t or "", d, sentinels, rate, spm_rate) for t, d in zip(texts, drawn, strict=True)]
            cells = pa.array([dict(zip(fields, row, strict=True)) for row in found], kind)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], cells], names=[*part.schema.names[:-1], result])

    return rows.mapInArrow(cut, schema)


def restored(output: Column, form: Column, sentinels: Sentinels = Sentinels()) -> Column:
    """The exact text behind an output of this form, by the sentinels alone."""
    after_prefix = F.when(form == PSM, sentinels.suffix).otherwise(sentinels.middle)
    after_suffix = F.when(form == PSM, sentinels.middle).otherwise(sentinels.prefix)
    prefix = F.split_part(F.split_part(output, F.lit(sentinels.prefix), F.lit(2)), after_prefix, F.lit(1))
    suffix = F.split_part(F.split_part(output, F.lit(sentinels.suffix), F.lit(2)), after_suffix, F.lit(1))
    middle = F.split_part(output, F.lit(sentinels.middle), F.lit(2))
    return F.when(form == PLAIN, output).otherwise(F.concat(prefix, middle, suffix))
