"""URL filter by a path-template tree per host.

A url's path segments become a template: variable segments (numbers, numbered files, long hexadecimal ids, dates, words
mixed with digits) are generalised into wildcards by their form. The tree is then merged level by level: under one
parent, literal branches whose evidence and shape agree with their siblings' become one wildcard branch. Branches agree
if what follows them is spread over the same forms (total variation of at most `SHAPE_GAP` against all siblings) and
their labelled shares of bad urls do not differ by more than `Z` standard errors from that of their siblings; a branch
without labels merges on its shape alone, so what is known of its siblings carries over to it. A template is rejected if
its smoothed share of bad urls, (bad + PRIOR * NEUTRAL) / (labelled + PRIOR), is `REJECT` or more: without evidence a
template has the neutral share, whatever the rest of the table is like.

Labels come from rules (host, path, verdict): a rule fits its host and all subdomains if the path starts with its own,
the longest rule wins. Where a rule fits, its verdict stands; elsewhere the url's template decides.

All counting is done on (host, template) rows, so a host with a third of all urls is combined before any shuffle. Only
the last join, which carries the verdicts back, sees single urls; its other side is unique.

Defined cases: a null url, or one without `://`, has empty host and path, fits no rule and is judged by the template of
the empty host; repeated rows are judged alike; an empty table gives an empty one; other columns pass through, but for one
with the name `judged`, which the result replaces. Segments
beyond `DEPTH` are one wildcard.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from .columns import clear_of, free_prefix

DEPTH = 4
SHAPE_GAP = 0.25
Z = 1.96
PRIOR = 20
NEUTRAL = 0.5
REJECT = 0.9
WILD = "<*>"
REST = "<**>"
END = "<end>"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, upper.lower())
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits; of equal length the first in the alphabet. Null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def _form(segment: Column) -> Column:
    """The segment, or the wildcard of its form."""
    return (
        F.when(segment.rlike("^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), "<date>")
        .when(segment.rlike("^[0-9]+$"), "<n>")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]{1,5}$"), F.concat(F.lit("<n>"), F.regexp_extract(segment, r"\.[A-Za-z0-9]+$", 0)))
        .when(segment.rlike("^[0-9a-fA-F-]{16,}$"), "<id>")
        .when(segment.rlike("[0-9]"), "<mixed>")
        .otherwise(segment)
    )


def template(path: Column, depth: int = DEPTH) -> Column:
    """Array of `depth` generalised segments, filled up with `END`; what lies deeper is one wildcard at the end."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    forms = F.transform(F.slice(segments, 1, depth), _form)
    deep = F.when(F.size(segments) > depth, F.array(F.lit(REST))).otherwise(F.array().cast("array<string>"))
    return F.concat(forms, F.array_repeat(F.lit(END), depth - F.size(forms)), deep)


def _merged(rows: DataFrame, level: int, depth: int, shape_gap: float, z: float) -> DataFrame:
    """Rows (host, t, n, labelled, bad, raw) with the level's agreeing literal branches as wildcards."""
    segment = F.get("t", F.lit(level))
    literal = ~segment.startswith("<")
    after = F.get("t", F.lit(level + 1)) if level + 1 < depth else F.lit(END)
    form = F.when(after.startswith("<"), after).otherwise(F.lit("<word>"))
    rows = rows.withColumns({"parent": F.slice("t", 1, level), "segment": segment, "form": form})

    own = rows.where(literal)
    forms = own.groupBy("host", "parent", "segment", "form").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    branches = forms.groupBy("host", "parent", "segment").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    pools = branches.groupBy("host", "parent").agg(
        F.sum("n").alias("pool_n"),
        F.sum("labelled").alias("pool_labelled"),
        F.sum("bad").alias("pool_bad"),
        F.count(F.lit(1)).alias("siblings"),
    )
    pool_forms = forms.groupBy("host", "parent", "form").agg(F.sum("n").alias("pool_form_n"))
    joined = branches.join(pools, ["host", "parent"])
    spread = (
        joined.select("host", "parent", "segment", "n", "pool_n")
        .join(pool_forms, ["host", "parent"])
        .join(forms.select("host", "parent", "segment", "form", F.col("n").alias("form_n")), ["host", "parent", "segment", "form"], "left")
        .groupBy("host", "parent", "segment")
        .agg(
            F.sum(F.abs(F.coalesce("form_n", F.lit(0)) / F.col("n") - F.col("pool_form_n") / F.col("pool_n"))).alias("gap")
        )
    )
    joined = joined.join(spread, ["host", "parent", "segment"])
    pooled = F.col("pool_bad") / F.col("pool_labelled")
    error = F.sqrt(pooled * (1 - pooled) / F.col("labelled"))
    own_share = F.col("bad") / F.col("labelled")
    same_labels = (F.col("labelled") == 0) | (F.abs(own_share - pooled) <= z * error + 1e-9)
    agree = (F.col("siblings") > 1) & (F.col("gap") / 2 <= shape_gap) & same_labels
    wild = joined.where(agree).select("host", "parent", "segment", F.lit(True).alias("wild"))
    rows = rows.join(wild, ["host", "parent", "segment"], "left")
    renamed = F.concat(F.slice("t", 1, level), F.array(F.lit(WILD)), F.slice("t", level + 2, depth + 1))
    rows = rows.withColumn("t", F.when(F.col("wild"), renamed).otherwise(F.col("t")))
    return rows.select("host", "t", "n", "labelled", "bad", "raw")


def judge_templates(
    urls: DataFrame,
    *,
    depth: int = DEPTH,
    shape_gap: float = SHAPE_GAP,
    z: float = Z,
    prior: float = PRIOR,
    reject: float = REJECT,
) -> DataFrame:
    """(host, raw, template, purity, verdict) from urls (host, path, label): label 1 bad, 0 good, null unknown."""
    spark = urls.sparkSession
    rows = urls.select("host", template(F.col("path"), depth).alias("raw"), "label")
    rows = rows.groupBy("host", "raw").agg(
        F.count(F.lit(1)).alias("n"), F.count("label").alias("labelled"), F.sum(F.coalesce("label", F.lit(0))).alias("bad")
    )
    rows = rows.withColumn("t", F.col("raw"))
    for level in range(depth):
        path = work_path(spark, f"url-level-{level}")
        rows.write.parquet(path)
        rows = _merged(spark.read.schema(rows.schema).parquet(path), level, depth, shape_gap, z)
    path = work_path(spark, "url-templates")
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    merged = rows.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    purity = (F.col("bad") + prior * NEUTRAL) / (F.col("labelled") + prior)
    merged = merged.select("host", "t", purity.alias("purity"))
    judged = rows.select("host", "raw", "t").join(merged, ["host", "t"])
    verdict = F.when(F.col("purity") >= reject, "block").otherwise("allow")
    named = F.concat(F.lit("/"), F.array_join(F.filter("t", lambda s: s != END), "/"))
    return judged.select("host", "raw", named.alias("template"), "purity", verdict.alias("verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, url: str = "url", **options) -> DataFrame:
    """Adds `judged` (host, path, rule, template, purity, verdict) to every url."""
    pages = clear_of(pages, "judged")
    name = free_prefix(pages)
    host, path = host_and_path(F.col(url))
    rule = fitting_rule(F.col(f"{name}u.host"), F.col(f"{name}u.path"), rules)
    seen = pages.withColumn(f"{name}u", F.struct(host.alias("host"), path.alias("path"))).withColumn(f"{name}rule", rule)
    ruled = F.lit(None).cast("string")
    for r in rules:
        ruled = F.when(F.col(f"{name}rule") == r.name, F.lit(r.verdict)).otherwise(ruled)
    seen = seen.withColumn(f"{name}ruled", ruled)
    label = F.when(F.col(f"{name}ruled").isNotNull(), (F.col(f"{name}ruled") == "block").cast("int"))
    templates = judge_templates(seen.select(f"{name}u.host", f"{name}u.path", label.alias("label")), **options)
    spark = pages.sparkSession
    written = work_path(spark, "url-judged")
    templates.write.parquet(written)
    templates = spark.read.schema(templates.schema).parquet(written).select(
        F.struct("host", F.col("raw").alias("t")).alias(f"{name}k"),
        F.struct("template", "purity", "verdict").alias(f"{name}v"),
    )
    depth = options.get("depth", DEPTH)
    seen = seen.withColumn(f"{name}k", F.struct(F.col(f"{name}u.host").alias("host"), template(F.col(f"{name}u.path"), depth).alias("t")))
    out = seen.join(templates, f"{name}k", "left")
    judged = F.struct(
        F.col(f"{name}u.host").alias("host"),
        F.col(f"{name}u.path").alias("path"),
        F.col(f"{name}rule").alias("rule"),
        F.col(f"{name}v.template").alias("template"),
        F.col(f"{name}v.purity").alias("purity"),
        F.coalesce(f"{name}ruled", f"{name}v.verdict").alias("verdict"),
    )
    return out.select(*pages.columns, judged.alias("judged"))
