"""Line dedup by a log-template tree of fixed depth, in DataFrame operations only.

A line's tokens are its runs of anything but blank, tab and carriage return. Tokens with a digit are variable fields and
read `<*>`; a line with fewer than `min_tokens` other tokens, or no more of them than variable ones (a row of a number
table), says too little and never counts. The tree's first level is the token count, the next ones the first `DEPTH`
tokens. Lines that are the same after masking are one template. In a leaf that holds several, lines are compared by the
tokens after the leading ones, which all of the leaf share anyway, in `CELLS` cells of one or more tokens in a row (fewer
if there are fewer tokens). A cell takes what more than half of the leaf's masked lines have there, else it is a variable
field, as is a cell of nothing but `<*>`. Lines that agree with `CONSTANT` cells and `SIMILARITY` of all cells or more
share the leaf's template.

A template recurs if enough documents have it. Lines equal after masking need `min_docs` documents if they have
`long_tokens` tokens or more, `short_docs` if fewer; a leaf's template with fields that vary proves less and needs
`wide_times` as many. Both are counted, so equal lines count as such whatever else their leaf holds.

A recurring template stays in the first document that has it (smallest id) and is dropped from all others, so each
passage is still there once. A document goes altogether if lines were dropped from it and less than `residue` of its
characters is left.

Texts are read twice: once for the lines' hashes, of fixed size, which all statistics work on, and once, shuffled by
document, to rebuild the texts.

Defined cases: a null id is an id of its own after all others; rows with the same id are one document when counting;
null and empty texts have no lines, lose none and stay; an empty table gives an empty one; other columns pass through,
but for one with the name `line_dedup`, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from .columns import clear_of, free_prefix

DEPTH = 3
CELLS = 16
SIMILARITY = 0.6
CONSTANT = 3
MIN_TOKENS = 3
LONG_TOKENS = 8
MIN_DOCS = 2
SHORT_DOCS = 5
WIDE_TIMES = 2
RESIDUE = 0.2
LAST_ID = 2**63 - 1


def _masked(text: Column) -> Column:
    """The text with blanks evened out line by line and every token that has a digit as `<*>`; lines stay as many.

    The patterns are tried only on texts that need them, and enter a token only at its start.
    """
    even = F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n ?", "\n")
    uneven = text.startswith(" ") | text.endswith(" ")
    for mark in ("\t", "\r", "  ", "\n ", " \n"):
        uneven = uneven | text.contains(mark)
    even = F.when(uneven, F.btrim(even, F.lit(" "))).otherwise(text)
    digits = F.regexp_replace(even, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")
    return F.when(text.rlike("[0-9]"), digits).otherwise(even)


def _key(masked_line: Column) -> Column:
    return F.xxhash64(masked_line)


def _line_index(docs: DataFrame, doc_id: str, text: str, min_tokens: int, depth: int) -> DataFrame:
    """(doc, key, leaf, n, cells) of every line with `min_tokens` tokens or more."""
    lines = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.explode(F.split(_masked(F.col(text)), "\n", -1)).alias("line"),
    )
    # constant tokens of each cell; 42, the hash of none, is a variable cell, which only lines with fields have
    rest, count = f"(size(t) - {depth})", f"least(size(t) - {depth}, {CELLS})"
    cell = f"slice(t, {depth} + c * {rest} div {count} + 1, (c + 1) * {rest} div {count} - c * {rest} div {count})"
    each = f"transform(sequence(0, {count} - 1), c -> %s)"
    cells = (
        f"if({rest} < {CONSTANT}, array(), if(contains(line, '<*>'), "
        f"{each % f"nullif(hash(array_remove({cell}, '<*>')), 42)"}, {each % f'hash({cell})'}))"
    )
    # the one-element array binds the tokens, which are used several times
    parsed = F.expr(
        "transform(array(split(line, ' ', -1)), t -> named_struct('n', size(t), "
        f"'leaf', xxhash64(size(t), slice(t, 1, {depth})), 'cells', {cells}))[0]"
    )
    some = F.length("line") >= 2 * min_tokens - 1
    fields = F.when(
        F.contains("line", F.lit("<*>")), (F.length("line") - F.length(F.replace("line", F.lit("<*>"), F.lit("")))) / 3
    ).otherwise(0)
    # tokens counted by their blanks: a test of the parsed line would make Spark parse it twice
    constant = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1 - fields
    lines = lines.where(some & (constant >= min_tokens) & (constant > fields))
    lines = lines.select("doc", _key(F.col("line")).alias("key"), parsed.alias("p"))
    return lines.select("doc", "key", "p.leaf", "p.n", "p.cells")


def _leaf_templates(index: DataFrame, similarity: float) -> DataFrame:
    """(key, template): masked lines that share their leaf's template with other masked lines."""
    crowded = index.groupBy("leaf").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("leaf")
    distinct = index.where(F.size("cells") >= CONSTANT).join(crowded, "leaf", "left_semi")
    distinct = distinct.select("key", "leaf", "cells").dropDuplicates(["key"])
    cells = distinct.select("leaf", F.posexplode("cells").alias("at", "cell"))
    counted = cells.groupBy("leaf", "at", "cell").agg(F.count(F.lit(1)).alias("c"))
    agreed = counted.groupBy("leaf", "at").agg(F.max(F.struct("c", "cell")).alias("top"), F.sum("c").alias("all"))
    agreed = agreed.withColumn("cell", F.when(F.col("top.c") * 2 > F.col("all"), F.col("top.cell")))
    templates = agreed.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "cell"))).alias("t"))
    templates = templates.select("leaf", F.transform("t", lambda x: x["cell"]).alias("template"))
    same = F.zip_with("cells", "template", lambda a, b: F.when(a == b, 1).otherwise(0))
    agreement = F.aggregate(same, F.lit(0), lambda a, x: a + x)
    matched = distinct.join(templates, "leaf").where(agreement >= F.greatest(F.lit(CONSTANT), F.size("cells") * similarity))
    return matched.select("key", F.col("leaf").alias("template"))


def dropped_lines(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    depth: int = DEPTH,
    similarity: float = SIMILARITY,
    min_tokens: int = MIN_TOKENS,
    long_tokens: int = LONG_TOKENS,
    min_docs: int = MIN_DOCS,
    short_docs: int = SHORT_DOCS,
    wide_times: int = WIDE_TIMES,
) -> DataFrame:
    """(doc, keys): per document the masked lines that recur elsewhere and are not its to keep."""
    spark = docs.sparkSession
    index = _written(spark, _line_index(docs, doc_id, text, min_tokens, depth), "line-index")
    matched = _written(spark, _leaf_templates(index, similarity), "line-templates")
    same = index.select("doc", "key", "n", F.col("key").alias("kind"), F.lit(False).alias("wide"))
    fits = index.join(matched, "key").select("doc", "key", "n", F.col("template").alias("kind"), F.lit(True).alias("wide"))
    kinds = same.unionByName(fits)
    # a template counts a document once, however many of its lines fit
    once = kinds.groupBy("kind", "wide", "doc").agg(F.max("n").alias("n"))
    recurring = once.groupBy("kind", "wide").agg(
        F.min("doc").alias("first"), F.count(F.lit(1)).alias("docs"), F.max("n").alias("n")
    )
    enough = F.when(F.col("n") >= long_tokens, F.lit(min_docs)).otherwise(F.lit(short_docs))
    enough = F.when(F.col("wide"), enough * wide_times).otherwise(enough)
    recurring = _written(spark, recurring.where(F.col("docs") >= enough).select("kind", "wide", "first"), "recurring-lines")
    gone = kinds.join(recurring, ["kind", "wide"]).where("doc <> first")
    return gone.groupBy("doc").agg(F.collect_set("key").alias("keys"))


def drop_recurring_lines(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", residue: float = RESIDUE, **options
) -> DataFrame:
    """Adds `line_dedup` (n_lines, n_dropped, text, kept) to every document."""
    docs = clear_of(docs, "line_dedup")
    name = free_prefix(docs)
    gone = dropped_lines(docs, doc_id=doc_id, text=text, **options)
    gone = gone.select(F.col("doc").alias(f"{name}doc"), F.col("keys").alias(f"{name}keys"))
    rows = docs.withColumn(f"{name}doc", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID))).join(gone, f"{name}doc", "left")
    whole, stay = F.length(text), F.length(f"{name}text")
    both = F.arrays_zip(F.split(F.col(text), "\n", -1).alias("line"), F.split(_masked(F.col(text)), "\n", -1).alias("masked"))
    left = F.filter(both, lambda x: ~F.array_contains(F.col(f"{name}keys"), _key(x["masked"])))
    touched = F.col(f"{name}keys").isNotNull() & F.col(text).isNotNull()
    rows = rows.withColumn(f"{name}left", F.when(touched, F.transform(left, lambda x: x["line"])))
    n_lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", 0).otherwise(whole - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    rows = rows.withColumn(f"{name}lines", n_lines)
    cut = F.when(touched, F.col(f"{name}lines") - F.size(f"{name}left")).otherwise(0)
    cleaned = F.when(touched, F.array_join(f"{name}left", "\n")).otherwise(F.col(text))
    rows = rows.withColumns({f"{name}cut": cut, f"{name}text": cleaned})
    kept = (F.col(f"{name}cut") == 0) | (stay >= whole * residue) & (stay > 0)
    return rows.select(
        *docs.columns,
        F.struct(
            F.col(f"{name}lines").cast("long").alias("n_lines"),
            F.col(f"{name}cut").cast("long").alias("n_dropped"),
            F.col(f"{name}text").alias("text"),
            kept.alias("kept"),
        ).alias("line_dedup"),
    )


def _written(spark, df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: short lineage, and joins that can split hot keys."""
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
