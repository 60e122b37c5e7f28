"""Queries of the matching side: text keys, search, scores, decisions, page extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import text as T
from ..functions.prices import parse_price
from ..functions.urls import canonical_url
from ..operators import matching as X
from ..operators.hash_search import near_hashes
from ..operators import pages as P
from ..session import spread
from .competitor_sql import URL, with_ci
from .fact_sql import CODE
from .registry import query


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def any_in(text: str, values) -> str:
    return "(" + " OR ".join(f"contains({text}, '{v}')" for v in values) + ")"


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def simplify(x: str) -> str:
    return f"array_to_string(list_filter({words(x)}, lambda w: length(w) > 2)[1:8], ' ')"


# --- text ---------------------------------------------------------------------------------------------


_NORMALISED = """SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(
  strip_accents(nfc_normalize(text)), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)"""


@query("m1_normalise_text", _NORMALISED)
def _(spark, sf):
    docs = T.normalize_columns(fx.table(spark, sf, "documents"), ["text"])
    return docs.select("doc_id", F.md5("text_norm").alias("digest"), F.length("text_norm").cast("bigint").alias("chars"))


@query("m1_normalise_text_exact", _NORMALISED)
def _(spark, sf):
    docs = T.normalize_columns(fx.table(spark, sf, "documents"), ["text"], exact=True)
    return docs.select("doc_id", F.md5("text_norm").alias("digest"), F.length("text_norm").cast("bigint").alias("chars"))


@query(
    "m1_normalise_symbols",
    """SELECT doc_id, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(nfc_normalize(text)),
      '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) || ' mk ii iii viii no 1 2 mm 13 a b fi ae' AS t FROM documents)""",
)
def _(spark, sf):
    marked = F.concat("text", F.lit(" – Mk Ⅱ ⅲ Ⅷ № ① ② ㎜ ⅓ Ａ 𝐁 ﬁ a\u0300e\u0301"))
    docs = T.normalize_columns(fx.table(spark, sf, "documents").withColumn("text", marked), ["text"])
    return docs.select("doc_id", F.md5("text_norm").alias("digest"))


@query("m2_simplify_name", with_ci(f"SELECT id_product, {simplify(norm('product_name'))} AS simple FROM feed"))
def _(spark, sf):
    return fx.feed(spark, sf).select("id_product", T.simplify_name(T.normalize_text("product_name")).alias("simple"))


_QUERY_LISTS = {
    "base": "[r, e, trim(b || ' ' || r), s]",
    "index": "[e, r, trim(b || ' ' || r), s, n]",
    "tokens": "[r, e, n, s, n]",
    "signature": "[n]",
    "stock": "[n]",
}


def _queries_sql(order: str) -> str:
    return f"""queries AS (SELECT id_product, CAST(position - 1 AS INTEGER) AS position, q[position] AS query FROM (
    SELECT id_product, q, unnest(generate_series(1, len(q))) AS position FROM (
      SELECT id_product, list_filter(l, lambda x, i: x <> '' AND list_position(l, x) = i) AS q FROM (
        SELECT id_product, {_QUERY_LISTS[order]} AS l FROM (SELECT id_product, trim(reference) AS r, trim(ean13) AS e,
          trim(manufacturer_name) AS b, trim(product_name) AS n, {simplify(norm('product_name'))} AS s FROM feed)))))"""


for _order in _QUERY_LISTS:
    query(f"m3_queries_{_order}", with_ci("SELECT id_product, position, query FROM queries", _queries_sql(_order)))(
        lambda spark, sf, order=_order: X.expand_queries(fx.match_products(spark, sf), order)
    )


_LISTINGS = f"""listings AS (SELECT CAST(p_partkey % 4 + 1 AS INTEGER) AS competitor_id,
    {URL.format(c='(p_partkey % 4 + 1)', p='p_partkey')} AS url,
    p_name || ' ' || p_brand || ' ' || {CODE} || CASE WHEN p_size % 7 = 0 THEN ' pack' ELSE '' END
      || CASE WHEN p_size % 11 = 0 THEN ' used' ELSE '' END AS title,
    CASE WHEN p_partkey % 2 = 0 THEN {CODE} ELSE '' END AS reference,
    CASE WHEN p_partkey % 3 = 0 THEN lpad(CAST(p_partkey AS VARCHAR),13,'0') ELSE '' END AS ean, p_brand AS brand,
    'Home > ' || p_type || ' > ' || split_part(p_name,' ',2) AS breadcrumb,
    CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (1 + CAST(p_size - 25 AS DECIMAL(4,0)) * CAST(0.01 AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS price
  FROM part),
  lw AS (SELECT *, {norm('title')} AS tn, list_distinct({words(norm("title || ' ' || reference || ' ' || ean"))}) AS found FROM listings),
  lwords AS (SELECT competitor_id, url, tn, unnest(found) AS word FROM lw),
  qw AS (SELECT query, qn, len(ws) AS need, unnest(ws) AS word FROM (SELECT query, {norm('query')} AS qn,
      list_distinct({words(norm('query'))}) AS ws FROM (SELECT DISTINCT query FROM queries))),
  hits AS (SELECT competitor_id, query, url, tn, any_value(qn) AS qn FROM qw JOIN lwords USING (word)
    GROUP BY competitor_id, query, url, tn HAVING count(*) = any_value(need)),
  cands AS (SELECT id_product, competitor_id, url, min(position) AS position, arg_min(query, position) AS matched_query
    FROM queries JOIN hits USING (query) GROUP BY 1, 2, 3)"""
_BY_TEXT = f"""shared AS (SELECT q.id_product, position, query FROM queries q JOIN feed f USING (id_product)
    WHERE query NOT IN (trim(reference), trim(ean13)) AND NOT (trim(reference) <> '' AND query = trim(trim(manufacturer_name) || ' ' || trim(reference)))),
  texts AS (SELECT id_product, min(id_product) OVER (PARTITION BY b, n, q) AS head FROM (
    SELECT f.id_product, any_value({norm('manufacturer_name')}) AS b, any_value({norm('product_name')}) AS n,
      coalesce(string_agg(position || ':' || query, chr(1) ORDER BY position), '') AS q FROM feed f LEFT JOIN shared USING (id_product) GROUP BY 1))"""


@query(
    "m4_candidates",
    with_ci(
        """SELECT id_product, competitor_id, url, min(position) AS position, arg_min(matched_query, position) AS matched_query FROM (
      SELECT c.* FROM cands c SEMI JOIN (SELECT q.id_product, competitor_id, url FROM queries q ANTI JOIN shared s
        ON q.id_product = s.id_product AND q.position = s.position JOIN hits USING (query)) o
        ON c.id_product = o.id_product AND c.competitor_id = o.competitor_id AND c.url = o.url
      UNION ALL SELECT head, competitor_id, url, position, query FROM texts JOIN shared USING (id_product) JOIN hits USING (query)
      WHERE head = id_product) GROUP BY 1, 2, 3""",
        _queries_sql("base"),
        _LISTINGS,
        _BY_TEXT,
    ),
)
def _(spark, sf):
    return X.generate_candidates(fx.match_products(spark, sf), fx.listings(spark, sf))


_PAIRS = f"""cpairs AS (SELECT c.*, f.ean13 AS ean, f.reference, {norm('l.title')} AS t, {norm('matched_query')} AS q,
    {norm('manufacturer_name')} AS b, {norm('product_name')} AS n, {norm('f.reference')} AS r, {norm('l.reference')} AS hr,
    {norm('l.brand')} AS m, l.ean AS c_ean, l.title AS c_title, CAST(l.price AS DOUBLE) AS c_price, f.price_tax_incl AS source_price
  FROM cands c JOIN feed f USING (id_product) JOIN listings l USING (competitor_id, url))"""
_NAME = f"least(30, 6 * len(list_filter({words('n')}, lambda w: length(w) > 2 AND contains(t, w))))"
_IN = "(CASE WHEN {0} <> '' AND contains({1}, {0}) THEN {2} ELSE 0 END)"
_BASE = f"""CAST({_IN.format('ean', 't', 100)} + CASE WHEN reference <> '' AND contains(t, r) THEN 60 ELSE 0 END
  + {_IN.format('b', 't', 30)} + {_NAME} - CASE WHEN {any_in('t', X.PACK_MARKS)} THEN 40 ELSE 0 END
  - CASE WHEN {any_in('t', X.USED_MARKS)} THEN 50 ELSE 0 END + {_IN.format('q', 't', 20)}
  + CASE WHEN contains(t, 'search') THEN 5 ELSE 0 END AS INTEGER)"""


def _best(spark, sf, kind="base", k=None):
    return X.best_candidates(fx.match_products(spark, sf), fx.listings(spark, sf), kind, k)


def _top(score: str, k: int, keep: str = "true") -> str:
    """Brute force: the best k of all pairs that the queries reach."""
    return f"""SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id_product, competitor_id
      ORDER BY score DESC, position, url) AS rn FROM (SELECT *, {score} AS score FROM cpairs) WHERE {keep}) WHERE rn <= {k}"""


@query(
    "m5_base_scores",
    with_ci(
        f"SELECT id_product, competitor_id, url, score FROM ({_top(_BASE, 12)})", _queries_sql("base"), _LISTINGS, _PAIRS
    ),
)
def _(spark, sf):
    return _best(spark, sf, k=12).select("id_product", "competitor_id", "url", "score")


_VE = "(CASE WHEN length({0}) IN (8,12,13,14) AND NOT regexp_full_match({0}, '0+') THEN {0} ELSE '' END)"
_EAN, _CEAN = _VE.format("ean"), _VE.format("c_ean")
_INDEX = f"""greatest(0, least(100, CAST(CASE WHEN {_EAN} <> '' AND {_EAN} = {_CEAN} THEN 100
    WHEN {_EAN} <> '' AND contains(t, {_EAN}) THEN 95 ELSE 0 END
  + CASE WHEN r <> '' AND r = hr THEN 70 WHEN r <> '' AND contains(t, r) THEN 55 ELSE 0 END
  + {_IN.format('b', 't', 25)} + {_IN.format('b', 'm', 15)} + {_NAME} + {_IN.format('q', 't', 20)}
  - CASE WHEN {any_in('t', X.INDEX_ACCESSORIES)} THEN 35 ELSE 0 END
  - CASE WHEN {any_in('t', X.INDEX_USED_MARKS)} THEN 50 ELSE 0 END AS INTEGER)))"""


@query(
    "m6_index_scores",
    with_ci(
        f"SELECT id_product, competitor_id, url, score FROM ({_top(_INDEX, 5, 'score >= 90')})",
        _queries_sql("index"),
        _LISTINGS,
        _PAIRS,
    ),
)
def _(spark, sf):
    return _best(spark, sf, "index").select("id_product", "competitor_id", "url", "score")


def _models(spark, sf):
    return spread(fx.model_names(spark, sf), "id_product")


def _model_pairs(spark, sf):
    return _models(spark, sf).withColumns(
        {
            "matched_query": F.col("name"),
            "supplier_reference": F.lit(""),
            "c_reference": F.lit(""),
            "ean": F.lit(""),
            "c_ean": F.lit(""),
        }
    )


@query("m7_token_scores")
def _(spark, sf):
    return X.score_candidates(_model_pairs(spark, sf), "tokens").select("id_product", "competitor_id", "score")


@query("m8_signature_scores")
def _(spark, sf):
    return X.score_candidates(_model_pairs(spark, sf), "signature").select("id_product", "competitor_id", "score")


# --- tokens and hints ---------------------------------------------------------------------------------

_MODELS = f"""models AS (SELECT p_partkey AS id_product, p_brand || ' ' || p_name || ' ' || s AS name, p_brand AS brand,
    p_name || ' ' || o || ' ' || p_brand AS c_title, CASE WHEN p_size % 8 = 0 THEN '' ELSE p_brand END AS c_brand FROM (
    SELECT *, {sql_list(fx.MODEL_SUFFIXES)}[p_size % 6 + 1] AS s, {sql_list(fx.MODEL_SUFFIXES)}[(p_size + p_partkey % 2) % 6 + 1] AS o FROM part)),
  mn AS (SELECT *, {norm('name')} AS n, {norm('brand')} AS b, {norm('c_title')} AS t, {norm('c_brand')} AS m FROM models)"""


def variant(x: str, kind: str) -> str:
    for source, target in T.VARIANTS[kind]:
        x = f"replace({x}, '{source}', '{target}')"
    return x


def tokens(x: str) -> str:
    hands = f"regexp_replace({x}, '\\b(left\\s+handed|left\\s+hand|gaucher|gauche|lh)\\b', 'lh', 'g')"
    hands = f"regexp_replace({hands}, '\\b(right\\s+handed|right\\s+hand|droitier|droite|rh)\\b', ' ', 'g')"
    kept = f"""list_filter({words(hands)}, lambda w: NOT list_contains({sql_list(T.STOPWORDS)}, w)
      AND (length(w) > 1 OR list_contains({sql_list(T.SINGLE_LETTERS)}, w)))"""
    whole = variant("w", "tokens")
    parts = f"list_transform(regexp_extract_all({whole}, '[0-9]+|[^0-9]+'), lambda p: {variant('p', 'tokens')})"
    return f"flatten(list_transform({kept}, lambda w: list_sort(list_distinct(list_concat([{whole}], {parts})))))"


@query(
    "m9_meaningful_tokens",
    f"WITH {_MODELS} SELECT id_product, array_to_string({tokens('n')}, ' ') AS tokens FROM mn",
)
def _(spark, sf):
    tok = T.meaningful_tokens(T.normalize_text("name"))
    return _models(spark, sf).select("id_product", F.array_join(tok, " ").alias("tokens"))


def signature(x: str, brand: str, kind: str) -> str:
    single = f" AND (length(w) > 1 OR list_contains({sql_list(T.SINGLE_LETTERS)}, w))" if kind == "catalog" else ""
    kept = f"""list_filter({words(x)}, lambda w: NOT list_contains({sql_list(T.STOPWORDS)}, w)
      AND NOT list_contains({words(brand).replace('lambda w: w', 'lambda z: z')}, w){single})"""
    return f"array_to_string(list_transform({kept}, lambda w: {variant('w', kind)}), '')"


@query(
    "m10_model_signatures",
    f"""WITH {_MODELS} SELECT id_product, {signature('n', 'b', 'signature')} AS site_form,
      {signature('n', 'b', 'catalog')} AS catalogue_form FROM mn""",
)
def _(spark, sf):
    rows = T.normalize_columns(_models(spark, sf), ["name", "brand"])
    return rows.select(
        "id_product",
        T.model_signature("name_norm", "brand_norm").alias("site_form"),
        T.model_signature("name_norm", "brand_norm", "catalog").alias("catalogue_form"),
    )


def guitar(x: str) -> str:
    brands = "|".join(T.GUITAR_BRANDS)
    return f"({any_in(x, T.GUITAR_MARKERS)} OR regexp_matches({x}, '\\b({brands})\\b'))"


def year(x: str) -> str:
    run = f"list_filter(regexp_extract_all(replace({x},' ',''), '[0-9]+'), lambda d: length(d) = 2 AND d >= '50')[1]"
    return f"""(CASE WHEN regexp_matches({x}, '\\b(19[0-9][0-9]|20[0-9][0-9])\\b')
      THEN CAST(regexp_extract({x}, '\\b(19[0-9][0-9]|20[0-9][0-9])\\b', 1) AS INTEGER)
      WHEN {run} IS NOT NULL AND {guitar(x)} THEN 1900 + CAST({run} AS INTEGER) END)"""


@query(
    "m11_year_hints",
    f"""WITH {_MODELS} SELECT id_product, coalesce({year('n')}, 0) AS year, coalesce({year('t')}, 0) AS c_year,
      CAST(CASE WHEN {year('n')} <> {year('t')} AND {guitar("(n || ' ' || t)")} THEN
        CASE WHEN contains(b, 'gibson') OR contains(m, 'gibson') THEN -40 ELSE -25 END ELSE 0 END AS INTEGER) AS penalty FROM mn""",
)
def _(spark, sf):
    rows = T.normalize_columns(_models(spark, sf), ["name", "c_title", "brand", "c_brand"])
    return rows.select(
        "id_product",
        F.coalesce(T.year_hint("name_norm"), F.lit(0)).alias("year"),
        F.coalesce(T.year_hint("c_title_norm"), F.lit(0)).alias("c_year"),
        T.year_penalty(*[F.col(f"{c}_norm") for c in ("name", "c_title", "brand", "c_brand")]).alias("penalty"),
    )


def _gap_points(steps, near=()) -> str:
    cases = [f"WHEN g <= {high} THEN {points}" for high, points in near] + [f"WHEN g >= {low} THEN {points}" for low, points in steps]
    return f"(CASE {' '.join(cases)} ELSE 0 END)"


_YEAR_POINTS = f"""(CASE WHEN {year('n')} <> {year('t')} AND {guitar("(n || ' ' || t)")} THEN
    CASE WHEN contains(b, 'gibson') OR contains(m, 'gibson') THEN -40 ELSE -25 END ELSE 0 END)"""
_PRICED = f"""{_MODELS.replace("ELSE p_brand END AS c_brand FROM (", "ELSE p_brand END AS c_brand, p_partkey % 4 + 1 AS competitor_id, CAST(p_partkey % 21 AS DOUBLE) / 20 AS ratio, CAST(p_retailprice AS DECIMAL(12,2)) AS source_price, CAST(CAST(p_retailprice AS DECIMAL(12,2)) * (1 + CAST(p_size - 25 AS DECIMAL(4,0)) * CAST(0.02 AS DECIMAL(4,2))) AS DECIMAL(12,2)) AS c_price FROM (", 1)},
  pn AS (SELECT *, CASE WHEN c_price > 0 AND source_price > 0 THEN abs(CAST(c_price AS DOUBLE) - CAST(source_price AS DOUBLE)) / CAST(source_price AS DOUBLE) END AS g FROM mn)"""
_ACCESSORY = f"len(list_filter({{0}}, lambda w: list_contains({sql_list(X.TITLE_ACCESSORIES)}, w))) > 0"


def _token_ctes(pairs: str) -> str:
    return f"""tk AS (SELECT *, {tokens('n')} AS q, {tokens('t')} AS tt, {tokens('m')} AS mm FROM {pairs}
      WHERE NOT {any_in('t', ('b stock', 'bstock', 'bundle'))}),
    cm AS (SELECT *, list_filter(q, lambda w: list_contains(tt, w)) AS c FROM tk
      WHERE len(mm) = 0 OR len({tokens('b')}) = 0 OR list_has_any(mm, {tokens('b')})),
    st AS (SELECT *, len(list_filter(c, lambda w: NOT list_contains({sql_list(X.GENERIC_TOKENS)}, w) AND length(w) > 3
      AND NOT regexp_full_match(w, '[0-9]+'))) AS strong FROM cm),
    fi AS (SELECT *, len(c) / len(q) * 45.0 + len(c) / len(tt) * 10.0 + ratio * 10.0
      + CASE WHEN strong > 0 THEN least(30, strong * 10) WHEN len(c) > 0 THEN -18 ELSE -25 END
      - CASE WHEN {_ACCESSORY.format('tt')} THEN 35 ELSE 0 END
      + CASE WHEN len(mm) > 0 AND len({words('b')}) > 0 THEN CASE WHEN list_has_any(mm, {words('b')}) THEN 20 ELSE -20 END ELSE 0 END
      + CASE WHEN n <> '' AND contains(t, n) THEN 20 ELSE 0 END AS first FROM st),
    sc AS (SELECT *, CASE WHEN strong = 0 AND ratio < 0.55 THEN least(first, 55.0) WHEN strong > 0 AND ratio < 0.45 THEN first - 10 ELSE first END
      + CASE WHEN list_contains(q, 'lh') AND list_contains(tt, 'lh') THEN 12 WHEN list_contains(q, 'lh') OR list_contains(tt, 'lh') THEN -15 ELSE 0 END
      + {_gap_points(((0.50, -40), (0.35, -30), (0.20, -15)))} + {_YEAR_POINTS} AS s FROM fi),
    sf AS (SELECT *, CASE WHEN len(q) = 0 OR len(tt) = 0 THEN 0 ELSE CAST(greatest(0, least(100, round_even(s, 0))) AS INTEGER) END AS score FROM sc)"""


def _signature_ctes(pairs: str) -> str:
    return f"""sg AS (SELECT *, {signature('n', 'b', 'signature')} AS qs, {signature('t', "(CASE WHEN c_brand <> '' THEN m ELSE b END)", 'signature')} AS ts FROM {pairs}),
    sc AS (SELECT *, CASE WHEN b <> '' AND m <> '' THEN CASE WHEN contains(m, b) OR contains(b, m) THEN 20 ELSE -10 END ELSE 0 END
      + CASE WHEN qs <> '' AND ts <> '' AND qs = ts THEN 55
        WHEN qs <> '' AND ts <> '' THEN CAST(round_even(ratio * 35, 0) AS INTEGER) - CASE WHEN ratio < 0.45 THEN 10 ELSE 0 END
        WHEN qs <> '' OR ts <> '' THEN -8 ELSE 0 END
      + CASE WHEN n <> '' AND contains(t, n) THEN 10 ELSE 0 END + CASE WHEN b <> '' AND contains(t, b) THEN 5 ELSE 0 END
      - CASE WHEN {_ACCESSORY.format(words('t'))} THEN 35 ELSE 0 END
      + {_gap_points(((0.50, -35), (0.35, -25), (0.20, -15)), ((0.05, 10), (0.15, 5)))} + {_YEAR_POINTS} AS s FROM sg),
    sf AS (SELECT *, CAST(greatest(0, least(100, s)) AS INTEGER) AS score FROM sc)"""


_POINT_CTES = {"tokens": _token_ctes, "signature": _signature_ctes}
for _id, _kind in (("m7_token_points", "tokens"), ("m8_signature_points", "signature")):

    @query(
        _id,
        f"WITH {_PRICED}, {_POINT_CTES[_kind]('pn')} SELECT id_product, CAST(competitor_id AS INTEGER) AS competitor_id, score FROM sf",
    )
    def _(spark, sf, kind=_kind):
        ratio = (F.col("id_product") % 21).cast("double") / 20
        return X.score_candidates(_model_pairs(spark, sf), kind, ratio).select("id_product", "competitor_id", "score")


_ALIAS = "map(" + sql_list(T.COLOR_ALIASES) + ", " + sql_list(T.COLOR_ALIASES.values()) + ")"
_COLOR = f"""CASE WHEN len(list_filter({words('n')}, lambda w: list_contains({sql_list(T.COLOR_ALIASES)}, w))) > 0
    THEN {_ALIAS}[list_filter(list_reverse({words('n')}), lambda w: list_contains({sql_list(T.COLOR_ALIASES)}, w))[1]]
    ELSE array_to_string(list_filter({words('n')}, lambda w: list_contains({sql_list(T.COLOR_WORDS)}, w))[-2:], ' ') END"""
_KIND = "CASE " + " ".join(f"WHEN {any_in('n', marks)} THEN '{kind}'" for kind, marks in T.INSTRUMENTS) + " ELSE '' END"


@query(
    "m12_catalog_profiles",
    f"""WITH {_MODELS}, col AS (SELECT *, {_COLOR} AS color FROM mn)
    SELECT id_product, b AS profile_brand, {signature('n', 'b', 'catalog')} AS profile_model,
      coalesce({year('n')}, 0) AS profile_year, color AS profile_color,
      CASE WHEN color = '' THEN '' WHEN contains(color, 'burst') THEN 'sunburst' WHEN contains(color, 'transparent')
        THEN 'transparent' WHEN list_contains({sql_list(T.PLAIN_COLORS)}, color) THEN color ELSE split_part(color, ' ', 1) END AS profile_color_family,
      {_KIND} AS profile_instrument, {guitar("(n || ' ' || n || ' ' || b)")} AS profile_is_guitar FROM col""",
)
def _(spark, sf):
    out = X.catalog_profile(_models(spark, sf))
    cols = ("brand", "model", "year", "color", "color_family", "instrument", "is_guitar")
    return out.select("id_product", *[f"profile_{c}" for c in cols]).fillna(0, ["profile_year"])


@query(
    "m13_brand_match",
    """SELECT vec AS id, a, c, list_has_any(string_split(ta, ' '), string_split(tc, ' ')) OR tc = '' AS by_tokens,
      tc <> '' AND (contains(replace(ta,' ',''), replace(tc,' ','')) OR contains(replace(tc,' ',''), replace(ta,' ',''))) AS by_containment
    FROM (SELECT p_partkey AS vec, p_brand AS a, c, trim(regexp_replace(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'), 'zz', '')) AS ta,
      trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g')) AS tc FROM (SELECT *, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Brand Group'
        WHEN 2 THEN replace(p_brand, '#', '') ELSE p_name END AS c FROM part))""".replace(
        "list_has_any(string_split(ta, ' '), string_split(tc, ' ')) OR tc = ''",
        f"(tc = '' OR list_has_any({tokens('ta')}, {tokens('tc')}))",
    ),
)
def _(spark, sf):
    size = F.col("p_size") % 4
    other = (
        F.when(size == 0, "")
        .when(size == 1, "Brand Group")
        .when(size == 2, F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
        .otherwise(F.col("p_name"))
    )
    rows = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("a"), other.alias("c"))
    return rows.withColumns(
        {"by_tokens": X.brand_overlap("a", "c"), "by_containment": X.brand_contained("a", "c")}
    )


@query(
    "m14_drop_b_stock",
    f"""WITH {_LISTINGS[:_LISTINGS.index('lw AS')].rstrip().rstrip(',')} SELECT url FROM (SELECT url, title || CASE WHEN length(title) % 3 = 0
      THEN ' (B-Stock)' WHEN length(title) % 3 = 1 THEN ' Bundle' ELSE '' END AS t FROM listings)
    WHERE NOT {any_in(norm('t'), ('b stock', 'bstock', 'bundle'))}""",
)
def _(spark, sf):
    extra = F.length("title") % 3
    rows = fx.listings(spark, sf).withColumn(
        "c_title", F.concat("title", F.when(extra == 0, " (B-Stock)").when(extra == 1, " Bundle").otherwise(""))
    )
    return X.drop_b_stock(rows).select("url")


@query(
    "m15_valid_ean",
    """SELECT o_orderkey, CASE WHEN length(d) IN (8,12,13,14) AND NOT regexp_full_match(d, '0+') THEN d ELSE '' END AS ean FROM (
      SELECT o_orderkey, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '0000000000000'
        ELSE 'EAN ' || lpad(CAST(o_orderkey AS VARCHAR), CAST(7 + o_custkey % 9 AS INTEGER), '4') || '-' END AS v FROM orders))""",
)
def _(spark, sf):
    text = F.when(F.col("o_custkey") % 5 == 0, "0000000000000").otherwise(
        F.concat(F.lit("EAN "), F.lpad(F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 9 + 7).cast("int"), F.lit("4")), F.lit("-"))
    )
    return fx.table(spark, sf, "orders").select("o_orderkey", T.valid_ean(text).alias("ean"))


_VERIFY = f"""SELECT id_product, competitor_id, url, evidence, evidence <> '' AS verified FROM (SELECT id_product, competitor_id, url, CASE
    WHEN r <> '' AND pr <> '' AND replace(r,' ','') = replace(pr,' ','') AND ok THEN 'page_reference'
    WHEN {_EAN} <> '' AND {_EAN} = {_CEAN} THEN 'ean'
    WHEN r <> '' AND hr <> '' AND replace(r,' ','') = replace(hr,' ','') AND ok THEN 'reference'
    WHEN {_EAN} <> '' AND contains(pt, {_EAN}) THEN 'title_ean'
    WHEN r <> '' AND contains(pt, r) AND shows THEN 'title_reference'
    WHEN t <> '' AND contains(pt, t) AND (b = '' OR shows) THEN 'title' ELSE '' END AS evidence
  FROM (SELECT *, b = '' OR m = '' OR contains(m, b) OR contains(b, m) AS ok, b <> '' AND (contains(pt, b) OR contains(px, b)) AS shows
    FROM (SELECT *, CASE WHEN len(url) % 3 = 0 THEN r ELSE '' END AS pr, CASE WHEN len(url) % 2 = 0 THEN t ELSE q END AS pt, b AS px FROM ranked)))"""


_RANKED = f"""scored AS (SELECT *, {_BASE} AS score FROM cpairs),
  ranked AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY id_product, competitor_id ORDER BY score DESC, position, url)
    AS INTEGER) AS rank FROM scored) WHERE rank <= 5)"""
_RANK_CTES = (_queries_sql("base"), _LISTINGS, _PAIRS, _RANKED)


@query("m16_verify_listings", with_ci(_VERIFY, *_RANK_CTES))
def _(spark, sf):
    n = F.length("url")
    pairs = _best(spark, sf).withColumns(
        {
            "page_reference": F.when(n % 3 == 0, F.replace(F.col("supplier_reference"), F.lit("-"), F.lit(" "))).otherwise(""),
            "page_title": F.when(n % 2 == 0, F.col("c_title")).otherwise(F.col("matched_query")),
            "page_text": F.col("brand"),
        }
    )
    out = X.verify_listings(pairs)
    return out.select(
        "id_product", "competitor_id", "url", F.coalesce("evidence", F.lit("")).alias("evidence"), "verified"
    )


_SEG = "list_filter(list_transform(string_split({0}, '>'), lambda p: trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g'))), lambda p: p <> '')"


@query(
    "m17_category_affinity",
    f"""SELECT id, CAST(CASE WHEN len(a) > 0 AND len(b) > 0 THEN least(25, CASE WHEN a[-1] = b[-1] THEN 15
        WHEN contains(b[-1], a[-1]) OR contains(a[-1], b[-1]) THEN 10 ELSE 0 END
        + least(12, 4 * len(list_intersect(list_filter(a, lambda p: NOT list_contains(['racine','accueil','home'], p)),
          list_filter(b, lambda p: NOT list_contains(['racine','accueil','home','category','categories'], p)))))) ELSE 0 END AS INTEGER) AS affinity
    FROM (SELECT p_partkey AS id, {_SEG.format("x")} AS a, {_SEG.format("y")} AS b FROM (SELECT p_partkey,
      'Racine > ' || p_type || ' > ' || split_part(p_name,' ',2) AS x, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'Home > ' || p_type || ' > ' || p_name
        WHEN 2 THEN 'Category > ' || lower(p_type) || ' > ' || split_part(p_name,' ',2) ELSE 'Home > Other' END AS y FROM part))""",
)
def _(spark, sf):
    size = F.col("p_size") % 4
    kind, item = F.col("p_type"), fx._word(1)
    crumb = (
        F.when(size == 0, "")
        .when(size == 1, F.concat_ws(" > ", F.lit("Home"), kind, "p_name"))
        .when(size == 2, F.concat_ws(" > ", F.lit("Category"), F.lower(kind), item))
        .otherwise("Home > Other")
    )
    path = F.concat_ws(" > ", F.lit("Racine"), kind, item)
    return fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), X.category_affinity(path, crumb).alias("affinity"))


# --- ranking and decisions ----------------------------------------------------------------------------


def _ranked(spark, sf):
    return _best(spark, sf)


@query("m18_ranked_candidates", with_ci("SELECT id_product, competitor_id, url, score, rank FROM ranked", *_RANK_CTES))
def _(spark, sf):
    return _ranked(spark, sf).select("id_product", "competitor_id", "url", "score", "rank")


#: Brute force over all pairs that the queries reach, with a stated similarity of the texts in place of difflib's.
_SIMILAR = """pn AS (SELECT * EXCLUDE (q), m AS c_brand, CAST(length(c_title) % 21 AS DOUBLE) / 20 AS ratio, CASE WHEN c_price > 0 AND source_price > 0
    THEN abs(c_price - CAST(source_price AS DOUBLE)) / CAST(source_price AS DOUBLE) END AS g FROM cpairs)"""


def _priced_ranking(kind: str) -> tuple[str, ...]:
    return (
        f"""SELECT id_product, competitor_id, url, score, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (
          PARTITION BY id_product, competitor_id ORDER BY score DESC, position, url) AS rn FROM sf) WHERE rn <= {X.TOP[kind]}""",
        _queries_sql(kind),
        _LISTINGS,
        _PAIRS,
        _SIMILAR,
        _POINT_CTES[kind]("pn"),
    )


def _text_ranking(kind: str, score: str, keep: str) -> tuple[str, ...]:
    top = _top(score, X.TOP[kind], keep).replace("EXCLUDE (rn)", "EXCLUDE (rn), CAST(rn AS INTEGER) AS rank")
    return f"SELECT id_product, competitor_id, url, score, rank FROM ({top})", _queries_sql(kind), _LISTINGS, _PAIRS


def _title_ratio():
    return (F.length("c_title") % 21).cast("double") / 20


for _kind in ("tokens", "signature"):

    @query(f"m18_ranked_{_kind}", with_ci(*_priced_ranking(_kind)))
    def _(spark, sf, kind=_kind):
        ranked = X.best_candidates(fx.match_products(spark, sf), fx.listings(spark, sf), kind, ratio=_title_ratio())
        return ranked.select("id_product", "competitor_id", "url", "score", "rank")


_SITE_RANKINGS = {
    "index": _text_ranking("index", _INDEX, "score >= 90"),
    "stock": _text_ranking("stock", _BASE, "true"),
    "tokens": _priced_ranking("tokens"),
    "signature": _priced_ranking("signature"),
}


@query(
    "m18_ranked_by_site",
    " UNION ALL ".join(
        f"SELECT *, '{profile}' AS profile FROM ({with_ci(*_SITE_RANKINGS[profile])}) WHERE competitor_id = {number}"
        for number, _, _, profile in fx.COMPETITORS
    ),
)
def _(spark, sf):
    ranked = X.best_by_site(fx.match_products(spark, sf), fx.listings(spark, sf), fx.competitors(spark), _title_ratio())
    return ranked.select("id_product", "competitor_id", "url", "score", "rank", "profile")


@query(
    "m19_decisions",
    with_ci(
        """SELECT id_product, competitor_id, CASE WHEN score < 30 THEN 'not_found' WHEN score > 90 THEN 'matched' ELSE 'pending' END AS result,
      CASE WHEN score >= 30 THEN url ELSE '' END AS url, CASE WHEN score >= 30 THEN score ELSE -1 END AS score FROM ranked WHERE rank = 1""",
        *_RANK_CTES,
    ),
)
def _(spark, sf):
    out = X.decide_matches(fx.match_products(spark, sf), _ranked(spark, sf), fx.competitors(spark))
    return out.select(
        "id_product", "competitor_id", "result", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("score", F.lit(-1)).alias("score")
    )


_PICK = """sel AS (SELECT p_partkey AS id_product, p_size % 6 - 1 AS best_index, p_size * 3 AS confidence FROM part WHERE p_type <> 'PROMO'),
  pool AS (SELECT *, max(rank) OVER (PARTITION BY id_product, competitor_id) AS pool FROM ranked WHERE rank <= 3),
  picked AS (SELECT p.*, CASE WHEN s.best_index IS NOT NULL THEN greatest(0, least(100, confidence)) ELSE score END AS s2
    FROM pool p LEFT JOIN sel s USING (id_product) WHERE rank = coalesce(greatest(0, least(pool - 1, best_index)) + 1, 1))"""


def _selections(spark, sf):
    return (
        fx.table(spark, sf, "part")
        .where("p_type <> 'PROMO'")
        .select(
            F.col("p_partkey").alias("id_product"),
            F.explode(F.array(*[F.lit(c[0]) for c in fx.COMPETITORS])).alias("competitor_id"),
            (F.col("p_size") % 6 - 1).alias("best_index"),
            (F.col("p_size") * 3).alias("confidence"),
        )
    )


@query(
    "m20_merged_selections",
    with_ci("SELECT id_product, competitor_id, url, CAST(s2 AS INTEGER) AS score, rank FROM picked", *_RANK_CTES, _PICK),
)
def _(spark, sf):
    out = X.merge_selections(_ranked(spark, sf), _selections(spark, sf))
    return out.select("id_product", "competitor_id", "url", "score", "rank")


@query(
    "m19_decisions_with_selections",
    with_ci(
        """SELECT id_product, competitor_id, CASE WHEN s3 < 30 THEN 'not_found' WHEN s3 >= 95 THEN 'matched' ELSE 'pending' END AS result,
      CAST(CASE WHEN s3 >= 30 THEN s3 ELSE -1 END AS INTEGER) AS score FROM (SELECT *, CASE
        WHEN competitor_id = 4 THEN CASE WHEN g >= 0.45 THEN least(s2, 20) WHEN g >= 0.30 THEN least(s2, 60) WHEN g >= 0.20 THEN least(s2, 80) ELSE s2 END
        WHEN competitor_id = 3 THEN CASE WHEN g >= 0.45 THEN least(s2, 20) WHEN g >= 0.30 THEN least(s2, 65) WHEN g >= 0.20 THEN least(s2, 82) ELSE s2 END
        ELSE CASE WHEN g >= 0.40 THEN least(s2, 70) WHEN g >= 0.25 THEN least(s2, 85) ELSE s2 END END AS s3
      FROM (SELECT *, CASE WHEN c_price > 0 AND source_price > 0 THEN abs(c_price - CAST(source_price AS DOUBLE)) / CAST(source_price AS DOUBLE) END AS g FROM picked))""",
        *_RANK_CTES,
        _PICK,
    ),
)
def _(spark, sf):
    out = X.decide_matches(
        fx.match_products(spark, sf), _ranked(spark, sf), fx.competitors(spark), _selections(spark, sf)
    )
    return out.select("id_product", "competitor_id", "result", F.coalesce("score", F.lit(-1)).alias("score"))


@query(
    "m21_error_classes",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'cloudflare' WHEN 'signup' THEN 'search_input_not_found'
      ELSE 'not_found' END AS result FROM events""",
)
def _(spark, sf):
    kind = F.col("event_type")
    message = (
        F.when(kind == "error", "CloudFlare challenge")
        .when(kind == "signup", "The search INPUT was not found on the page")
        .when(kind == "view", F.lit(None))
        .otherwise("timeout")
    )
    rows = fx.table(spark, sf, "events").select("event_id", message.alias("message"))
    return X.classify_errors(rows).select("event_id", "result")


# --- prices and pages ---------------------------------------------------------------------------------


@query(
    "m22_parse_prices",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN CAST(floor(o_totalprice) AS DOUBLE)
      ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) END AS price FROM orders""",
)
def _(spark, sf):
    return fx.price_texts(spark, sf).select("o_orderkey", parse_price("text").alias("price"))


@query(
    "m23_page_prices",
    "SELECT o_orderkey AS page_id, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) AS price FROM orders",
)
def _(spark, sf):
    return P.extract_page_prices(fx.shop_pages(spark, sf)).select("page_id", "price")


_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&amp;', '&', 'g'), '\\s+', ' ', 'g'))"


@query(
    "m24_page_titles",
    f"SELECT page_id, {_TEXT.format(chr(39).join(['regexp_extract(html, ', '(?s)<h1>(.*?)</h1>', ', 1)']))} AS page_title FROM pages",
)
def _(spark, sf):
    return P.extract_titles(fx.table(spark, sf, "pages")).select("page_id", "page_title")


@query(
    "m24_shop_titles",
    """SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 1 THEN 'Item ' WHEN 5 THEN 'Social ' ELSE 'Doc ' END
      || CAST(o_orderkey AS VARCHAR) AS page_title FROM orders""",
)
def _(spark, sf):
    return P.extract_titles(fx.shop_pages(spark, sf)).select("page_id", "page_title")


@query(
    "m25_links",
    f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS position, href, {_TEXT.format('body')} AS text,
      regexp_extract(url, '^([a-z]+://[^/]+)', 1) || href AS target FROM (
      SELECT page_id, url, unnest(generate_series(1, len(h))) AS i, unnest(h) AS href, unnest(b) AS body FROM (SELECT page_id, url,
        regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?s)<a href="([^"]*)">(.*?)</a>', 2) AS b FROM pages))""",
)
def _(spark, sf):
    return P.extract_links(fx.table(spark, sf, "pages")).select("page_id", "position", "href", "text", "target")


@query(
    "m25_breadcrumbs",
    """SELECT o_orderkey AS page_id, CASE WHEN (o_orderkey % 7) % 2 = 0 THEN 'Accueil > Guitares & cie > '
      || CAST(o_orderkey AS VARCHAR) || 'x' ELSE '' END AS breadcrumb FROM orders""",
)
def _(spark, sf):
    rows = P.extract_breadcrumb(fx.shop_pages(spark, sf))
    return rows.select("page_id", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"))


@query(
    "m25_images",
    """SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 2 THEN 'https://img.example.com/a.jpg' WHEN 3 THEN
      'https://c4.example.com/p' || CAST(o_orderkey AS VARCHAR) || '/i/' || CAST(o_orderkey AS VARCHAR) || '.jpg' ELSE '' END
      AS image_url FROM orders""",
)
def _(spark, sf):
    rows = P.extract_image(fx.shop_pages(spark, sf))
    return rows.select("page_id", F.coalesce("image_url", F.lit("")).alias("image_url"))


@query(
    "m26_product_pages",
    "SELECT o_orderkey AS page_id, o_orderkey % 7 IN (3, 5) OR o_orderkey % 7 = 6 AND o_orderkey // 7 % 2 = 1 AS is_product FROM orders",
)
def _(spark, sf):
    return fx.shop_pages(spark, sf).select("page_id", P.is_product_page("url", "html").alias("is_product"))


@query(
    "m27_canonical_urls",
    """SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q = '?' THEN '' ELSE q END AS canonical
    FROM (SELECT page_id, url, rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') AS p,
      regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS q FROM (SELECT page_id, replace(replace(url, 'http', 'HTTP'), 'example', 'Example') AS url FROM pages))""",
)
def _(spark, sf):
    noisy = F.replace(F.replace(F.col("url"), F.lit("http"), F.lit("HTTP")), F.lit("example"), F.lit("Example"))
    return fx.table(spark, sf, "pages").select("page_id", canonical_url(noisy).alias("canonical"))


@query(
    "m28_embedded_listings",
    """SELECT o_orderkey AS page_id, 'https://shop.example.com/a' || CAST(o_orderkey AS VARCHAR) || '.htm' AS url,
      'T [' || CAST(o_orderkey AS VARCHAR) || ']' AS title, 'M' AS manufacturer FROM orders WHERE o_orderkey % 7 = 2
    UNION ALL SELECT o_orderkey, 'https://shop.example.com/b.htm', 'N', '' FROM orders WHERE o_orderkey % 7 = 2""",
)
def _(spark, sf):
    return P.extract_embedded_listings(fx.shop_pages(spark, sf), "https://shop.example.com")


@query(
    "m32_references",
    """SELECT page_id, coalesce(ref, '') AS page_reference, page_ean FROM (SELECT o_orderkey AS page_id, CASE o_orderkey % 7 WHEN 0 THEN 'r ' WHEN 1 THEN 'm ' WHEN 3 THEN 's ' END || CAST(o_orderkey AS VARCHAR) AS ref,
      CASE o_orderkey % 7 WHEN 1 THEN lpad(CAST(o_orderkey AS VARCHAR), 13, '7') WHEN 3 THEN lpad(CAST(o_orderkey AS VARCHAR), 8, '3') ELSE '' END AS page_ean
    FROM orders)""",
)
def _(spark, sf):
    out = P.extract_references(fx.shop_pages(spark, sf))
    return out.select("page_id", "page_reference", "page_ean")


_HASH = """hashes AS (SELECT vec_id AS id, CASE WHEN h >= 9223372036854775808::HUGEINT THEN CAST(h - 18446744073709551616::HUGEINT AS BIGINT) ELSE CAST(h AS BIGINT) END AS hash
  FROM (SELECT vec_id, CAST(list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN CAST(embedding[i] AS DOUBLE) >= mean
    THEN CAST(pow(2, i - 1) AS HUGEINT) ELSE 0::HUGEINT END)) AS HUGEINT) AS h
  FROM (SELECT vec_id, embedding, list_reduce(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda a, b: a + b) / len(embedding) AS mean FROM embeddings)))"""


def _hashes(spark, sf):
    vectors = fx.table(spark, sf, "embeddings")
    return vectors.select(F.col("vec_id").alias("id"), X.average_hash("embedding").alias("hash"))


@query("m29_average_hash", f"WITH {_HASH} SELECT id, hash FROM hashes")
def _(spark, sf):
    return _hashes(spark, sf)


@query(
    "m29_hamming_pairs",
    f"""WITH {_HASH} SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
    FROM hashes a JOIN hashes b ON b.id = a.id + 1""",
)
def _(spark, sf):
    hashes = _hashes(spark, sf)
    pairs = hashes.select(F.col("id").alias("id_a"), (F.col("id") + 1).alias("id_b"))
    return X.hamming_pairs(pairs, hashes, hashes).select("id_a", "id_b", "distance")


def _image_copies(spark, sf):
    """Every image as it is, with a sixteenth of its values turned round, and some once more."""
    vectors = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    turned = F.transform("v", lambda x, i: F.when(i % 16 == F.col("vec_id") % 16, -x).otherwise(x))
    copies = vectors.select(F.col("vec_id"), F.explode(F.array("v", turned, F.when(F.col("vec_id") % 5 == 0, F.col("v")))).alias("v"))
    return copies.where("v is not null").select(F.col("vec_id").alias("id"), X.average_hash("v").alias("hash"))


_COPIES = """embeddings AS (SELECT vec_id, unnest([v, list_transform(v, lambda x, i: CASE WHEN (i - 1) % 16 = vec_id % 16 THEN -x ELSE x END)]
      || CASE WHEN vec_id % 5 = 0 THEN [v] ELSE [] END) AS embedding
    FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM main.embeddings))"""


#: Every hash against every hash.
@query(
    "m29_near_hashes",
    f"""WITH {_COPIES}, {_HASH}, d AS (SELECT hash, count(*) AS n FROM hashes GROUP BY hash)
    SELECT a.hash AS hash_a, b.hash AS hash_b, a.n AS n_a, b.n AS n_b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance
    FROM d a JOIN d b ON a.hash < b.hash OR (a.hash = b.hash AND a.n > 1) WHERE bit_count(xor(a.hash, b.hash)) <= 6""",
)
def _(spark, sf):
    return near_hashes(_image_copies(spark, sf), 6)
