"""One query per operator, on the whole of its table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_forest, fim, html_blocks, icws, leaks, line_rules, line_templates, merkle, pfair, pii, pu_quality, token_counts, url_templates
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_embedding_forest")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_forest.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > token_counts.LIMIT).alias("over_limit"),
    )


@query("op3_html_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_blocks.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


URL_RULES = (
    url_templates.Rule("net", "/", "block"),
    url_templates.Rule("example.net", "/en/", "allow"),
    url_templates.Rule("example.com", "/de/", "block"),
    url_templates.Rule("org", "/fr/", "allow"),
)


@query("op4_url_templates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select(
        "page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.template", "judged.purity"
    )


LEAKS_SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM benchmark)
), doc_words AS (
    SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)
), windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
    SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows v ON p.n = v.n AND p.words = v.words),
hit AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_benchmark_leaks", LEAKS_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("leak.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "leak.n_words",
        "leak.n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of(F.col("pii.base"), k.name).alias(f"n_{k.name}") for k in pii.KINDS if k.base]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.listed(F.col("pii.base")), 256).alias("base_sha256"),
        pii.listed(F.col("pii.all")).alias("spans"),
    )


@query("op7_icws_near_dup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = icws.near_duplicates(docs)
    doc_id = F.when(F.col("doc") < icws.LAST_ID, F.col("doc"))
    return found.select(
        doc_id.alias("doc_id"), F.col("component").alias("component_id"), "kept", F.hex("content").alias("content"), "rows"
    )


@query("op8_pu_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = pu_quality.train(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    scored = pu_quality.score(docs, model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


MIX_SQL = f"""
WITH RECURSIVE roots AS (SELECT source, sqrt(count(*)::DOUBLE) AS root FROM documents GROUP BY source),
target AS (
    SELECT source, greatest(1, floor(root * {pfair.PERIOD} / (SELECT sum(root) FROM roots) + 0.5))::BIGINT AS w,
           row_number() OVER (ORDER BY source NULLS LAST) AS i
    FROM roots
), whole AS (SELECT sum(w)::BIGINT AS q, list(w ORDER BY i) AS w FROM target),
edf(t, done, chosen) AS (
    SELECT 0::BIGINT, list_transform(w, lambda x: 0::BIGINT), NULL::BIGINT FROM whole
    UNION ALL
    SELECT t + 1, list_transform(list_zip(done, range(1, len(done) + 1)), lambda z: CASE WHEN z[2] = pick THEN z[1] + 1 ELSE z[1] END), pick
    FROM (
        SELECT t, done, w, list_min(list_filter(list_transform(list_zip(done, w, range(1, len(w) + 1)),
            lambda z: CASE WHEN z[1] < z[2] AND z[1] * q // z[2] <= t
                 THEN {{'due': ((z[1] + 1) * q + z[2] - 1) // z[2], 'i': z[3]}} END), lambda z: z IS NOT NULL)).i AS pick
        FROM edf, whole WHERE t < q
    )
), plan AS (SELECT chosen AS i, list(t - 1 ORDER BY t) AS slots FROM edf WHERE chosen IS NOT NULL GROUP BY chosen),
numbered AS (
    SELECT doc_id, source, row_number() OVER (
        PARTITION BY source ORDER BY doc_id IS NULL, md5(doc_id::VARCHAR), doc_id) - 1 AS number FROM documents
), placed AS (
    SELECT doc_id, n.source, number // {pfair.BLOCK_ROWS} AS block, number % {pfair.BLOCK_ROWS} AS place, w, slots,
           (SELECT q FROM whole) AS q
    FROM numbered n JOIN target t ON n.source IS NOT DISTINCT FROM t.source JOIN plan USING (i)
)
SELECT doc_id, source, block::BIGINT AS block, (block * q // w)::BIGINT AS release,
       (((block + 1) * q + w - 1) // w)::BIGINT AS deadline, (block // w * q + slots[block % w + 1])::BIGINT AS slot,
       place::BIGINT AS place
FROM placed
"""


@query("op9_pfair_mix", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.mix_sources(docs, pfair.sqrt_shares(docs))


LINES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(doc_id, {line_templates.LAST_ID}) AS doc, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
    SELECT r, doc, pos, line, trim(regexp_replace(line, '[ \t\r]+', ' ', 'g'), ' ') AS even
    FROM (SELECT r, doc, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM docs)
), masked AS (SELECT *, regexp_replace(even, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM lines),
tokens AS (SELECT *, CASE WHEN m = '' THEN []::VARCHAR[] ELSE string_split(m, ' ') END AS tk FROM masked),
counted AS (SELECT *, len(tk) AS n, array_to_string([len(tk)::VARCHAR] || tk[1:{line_templates.DEPTH}], ' ') AS leaf FROM tokens),
fields AS (SELECT *, len(list_filter(tk, lambda x: x = '<*>')) AS f FROM counted),
index AS (SELECT DISTINCT doc, m, leaf, n, tk[{line_templates.DEPTH} + 1:] AS u FROM fields WHERE n - f >= {line_templates.MIN_TOKENS} AND n - f > f),
kinds AS (SELECT DISTINCT m, leaf, n, u, least(len(u), {line_templates.CELLS}) AS k FROM index),
crowded AS (SELECT leaf FROM kinds GROUP BY leaf HAVING count(*) > 1),
members AS (
    SELECT m, leaf, k, list_transform(range(k), lambda c: nullif(array_to_string(
        list_filter(u[c * len(u) // k + 1:(c + 1) * len(u) // k], lambda x: x <> '<*>'), ' '), '')) AS cells
    FROM kinds JOIN crowded USING (leaf) WHERE k >= {line_templates.CONSTANT}
),
spread AS (SELECT m, leaf, k, unnest(cells) AS cell, unnest(range(1, k + 1)) AS pos FROM members),
tops AS (SELECT leaf, pos, cell, count(*) AS c, sum(count(*)) OVER (PARTITION BY leaf, pos) AS everyone FROM spread GROUP BY leaf, pos, cell),
agreed AS (SELECT leaf, pos, cell FROM tops WHERE c * 2 > everyone AND cell IS NOT NULL),
wide AS (
    SELECT m, s.leaf FROM spread s LEFT JOIN agreed a ON s.leaf = a.leaf AND s.pos = a.pos AND s.cell = a.cell
    GROUP BY m, s.leaf HAVING count(a.cell) >= greatest({line_templates.CONSTANT}, max(k) * {line_templates.SIMILARITY})
), named AS (
    SELECT doc, m, n, 'line ' || m AS kind, false AS wide FROM index
    UNION ALL SELECT doc, i.m, n, 'leaf ' || w.leaf, true FROM index i JOIN wide w ON i.m = w.m
), recurring AS (
    SELECT kind, min(doc) AS first FROM named GROUP BY kind, wide
    HAVING count(DISTINCT doc) >= CASE WHEN wide THEN {line_templates.WIDE_TIMES} ELSE 1 END
        * CASE WHEN max(n) >= {line_templates.LONG_TOKENS} THEN {line_templates.MIN_DOCS} ELSE {line_templates.SHORT_DOCS} END
), gone AS (SELECT DISTINCT doc, m FROM named JOIN recurring USING (kind) WHERE doc <> first),
rebuilt AS (
    SELECT r, count(*) AS n_lines, count(gone.m) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone.m IS NULL), '') AS stay
    FROM counted LEFT JOIN gone ON counted.doc = gone.doc AND counted.m = gone.m GROUP BY r
)
SELECT d.doc_id, CASE WHEN d.text = '' THEN 0 ELSE n_lines END::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped,
       stay AS text,
       n_dropped = 0 OR (length(stay) > 0 AND length(stay) >= length(d.text) * {line_templates.RESIDUE}) AS kept
FROM docs d JOIN rebuilt USING (r)
"""


@query("op10_line_templates", LINES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_templates.drop_recurring_lines(docs)
    return cut.select(
        "doc_id",
        "line_dedup.n_lines",
        "line_dedup.n_dropped",
        F.coalesce("line_dedup.text", F.lit("")).alias("text"),
        "line_dedup.kept",
    )


_HASHED = "('0x' || substr(digest, {at}, 8))::BIGINT"
FIM_SQL = rf"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), drawn AS (
    SELECT *, len(u)::BIGINT AS n, {_HASHED.format(at=1)} AS h1, {_HASHED.format(at=9)} AS h2,
           {_HASHED.format(at=17)} AS h3, {_HASHED.format(at=25)} AS h4 FROM units
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
), parts AS (
    SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op11_fill_in_middle", FIM_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fim.fill_in_middle(docs)
    output, form = F.col("fim.output"), F.col("fim.form")
    return cut.select(
        "doc_id",
        "fim.n",
        "fim.form",
        "fim.prefix_chars",
        "fim.middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(fim.restored(output, form), 256).alias("restored_sha256"),
    )


_TAMPERED = r"""list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y)
    WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"""


def _counted_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _merkle_sql(levels: int = 10) -> str:
    """The trees level by level; a level leaves trees of one node as they are. `levels` bounds the SQL, not the operator."""

    def climb(name: str, first: str, tree: str) -> str:
        ctes = [f"{name}0 AS ({first})"]
        for k in range(levels):
            ctes.append(
                f"""{name}r{k} AS (SELECT {tree}, pos // 8 AS up, list(h ORDER BY pos) AS run, sum(count(*)) OVER (PARTITION BY {tree}) AS total
                FROM {name}{k} GROUP BY {tree}, pos // 8),
                {name}{k + 1} AS (SELECT {tree}, up AS pos, CASE WHEN total > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS h FROM {name}r{k})"""
            )
        return ", ".join(ctes)

    def fold(name: str, rows: str, tree: str, out: str) -> str:
        ctes, last = [], rows
        for k in range(levels):
            at = f"({out}_pos % 8 + 1)"
            ctes.append(
                f"""{out}{k} AS (SELECT p.* EXCLUDE ({out}_pos, proof, f),  {out}_pos // 8 AS {out}_pos,
                proof || CASE WHEN total > 1 THEN array_to_string(run[:{at} - 1], '') || array_to_string(run[{at} + 1:], '') ELSE '' END AS proof,
                CASE WHEN total > 1 THEN sha256(array_to_string(run[:{at} - 1], '') || f || array_to_string(run[{at} + 1:], '')) ELSE f END AS f
                FROM {last} p JOIN {name}r{k} r ON r.{tree} IS NOT DISTINCT FROM p.{tree} AND r.up = {out}_pos // 8)"""
            )
            last = f"{out}{k}"
        return ", ".join(ctes)

    leaf = " || ".join(map(_counted_sql, ("doc_id", "source", "lang", "n_chars")))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH hashed AS (
        SELECT doc_id, lang, sha256({leaf} || {_counted_sql('text')}) AS leaf,
               CASE WHEN xor({_TAMPERED}, 4294967295) % 3 = 0 THEN sha256({leaf} || {_counted_sql(lower)})
                    ELSE sha256({leaf} || {_counted_sql('text')}) END AS claimed
        FROM documents
    ), placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed),
    {climb('g', 'SELECT lang, pos, leaf AS h FROM placed', 'lang')},
    subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, 1 AS top FROM g{levels}),
    {climb('t', 'SELECT top, pos, subroot AS h FROM subroots', 'top')},
    low AS (SELECT doc_id, lang, leaf, pos AS a_pos, '' AS proof, claimed AS f FROM placed),
    {fold('g', 'low', 'lang', 'a')},
    high AS (SELECT a.doc_id, a.lang, a.leaf, s.subroot, s.top, s.pos AS b_pos, a.proof, a.f
             FROM a{levels - 1} a JOIN subroots s ON a.lang IS NOT DISTINCT FROM s.lang),
    {fold('t', 'high', 'top', 'b')}
    SELECT doc_id, leaf, subroot, (SELECT h FROM t{levels}) AS root, sha256(proof) AS proof_sha256, f AS folded_root,
           f = (SELECT h FROM t{levels}) AS verified
    FROM b{levels - 1}
    """


@query("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*columns)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", upper, upper.lower()))
    claimed = [F.coalesce(tampered, F.col("text")) if c == "text" else F.col(c) for c in columns]
    manifest = merkle.build_manifest(docs.withColumn("claimed", merkle.leaf_digest(claimed)), columns, keep=["claimed"])
    proofs = merkle.prove(manifest, "claimed").withColumnRenamed("id", "doc_id")
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


RULES_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS ls FROM docs),
windows AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS times
    FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words))
), repeated AS (
    SELECT r, count(DISTINCT pos) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM windows WHERE times > 1) GROUP BY r
), lines AS (
    SELECT r, source, t, l, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n,
           trim(regexp_replace(regexp_replace(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line
    FROM (SELECT r, source, t, unnest(ls) AS l FROM words)
), worded AS (SELECT * FROM lines WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY r),
hosts AS (SELECT source, count(DISTINCT t) AS documents FROM docs GROUP BY source),
common AS (
    SELECT l.source, line FROM (SELECT source, line, count(DISTINCT t) AS held_by FROM worded GROUP BY source, line) l
    JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
    WHERE held_by >= {line_rules.MIN_DOCS} AND held_by > documents * {line_rules.SHARE}::DOUBLE
), removed AS (
    SELECT r, sum(n) AS words, count(*) AS lines FROM worded l JOIN common c ON l.line = c.line AND l.source IS NOT DISTINCT FROM c.source GROUP BY r
), figures AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
           coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(removed.lines, 0)::BIGINT AS n_common_lines,
           (len(w) - coalesce(removed.words, 0))::BIGINT AS left_words
    FROM words LEFT JOIN dup USING (r) LEFT JOIN repeated USING (r) LEFT JOIN removed USING (r)
), judged AS (SELECT *, n_words < {line_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figures)
SELECT *, NOT base_failed AND left_words >= n_words * {line_rules.RESIDUE}::DOUBLE AS kept FROM judged
"""


@query("op13_line_rules", RULES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "rules.*")
