"""Catalogue matching as table jobs: queries, search, scores, ranking, decisions.

Inputs: products (id_product, supplier_reference, ean, brand, name, source_price, category_path) and listings
(competitor_id, url, title, reference, ean, brand, breadcrumb, price).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
import pandas as pd

from ..functions import measures as M
from ..functions import text as T
from ..session import shuffled, written
from ..sources.incremental import top_k_per
from .gram_index import substring_pairs
from .price_bands import best_priced, clamped, price_points, priced_score

# Thresholds, word lists and weights of the scorers.
WORD_BLOCK = 50_000  # our own: listings of one word a task looks through
TOP = {"base": 5, "stock": 5, "index": 5, "tokens": 3, "signature": 3}
INDEX_KEEP = 90
NOT_FOUND_BELOW, MATCHED_ABOVE, SELECTED_MATCH = 30, 90, 95
PRICE_STEPS = {  # kind: (gap from, points), widest first, then (gap up to, points), nearest first
    "tokens": (((0.50, -40), (0.35, -30), (0.20, -15)), ()),
    "signature": (((0.50, -35), (0.35, -25), (0.20, -15)), ((0.05, 10), (0.15, 5))),
}
PRICE_CAPS = {  # profile: (ratio from, score cap), widest first
    "signature": ((0.45, 20), (0.30, 60), (0.20, 80)),
    "tokens": ((0.45, 20), (0.30, 65), (0.20, 82)),
    "default": ((0.40, 70), (0.25, 85)),
}
PACK_MARKS = ("pack", "bundle", "lot")
USED_MARKS = ("occasion", "reconditionne", "b stock", "bstock", "used")
INDEX_ACCESSORIES = (
    "case", "cover", "bundle", "pack", "sleeve", "bag", "stand", "mount", "holder", "adapter", "protector",
    "protection", "decksaver", "flight", "rack", "lid",
)
INDEX_USED_MARKS = ("used", "occasion", "reconditionne", "b stock")
TITLE_ACCESSORIES = (
    "case", "decksaver", "sleeve", "bag", "cover", "foam", "bundle", "pack", "set", "stand", "mount", "holder",
    "protector", "protection", "universal", "flight", "rack", "adapter", "pedalboard",
)
GENERIC_TOKENS = (
    "overdrive", "distortion", "delay", "reverb", "chorus", "phaser", "flanger", "pedal", "guitar", "bass", "drum",
    "microphone", "headphone", "monitor", "speaker", "controller", "keyboard", "mixer", "case", "bag", "bundle",
    "pack", "set", "system", "kit", "stand", "adapter", "cover", "sleeve", "pro", "mini", "max",
)
B_STOCK_MARKS = ("b-stock", "b stock", "bstock", "bundle")
ROOT_SEGMENTS = ("racine", "accueil", "home")
SITE_ROOT_SEGMENTS = (*ROOT_SEGMENTS, "category", "categories")
CLOUDFLARE_MARKS = ("cloudflare", "cloudfare")
NO_SEARCH_MARK = "search input was not found"

PAIR = ["id_product", "competitor_id"]


# --- queries and search -------------------------------------------------------------------------------


def query_list(order: str) -> Column:
    """Queries of a product in the order a kind of site is asked."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    reference, ean, brand, name = (text(c) for c in ("supplier_reference", "ean", "brand", "name"))
    branded = F.trim(F.concat_ws(" ", brand, reference))
    simple = lambda c: T.simplify_name(T.normalize_text(c))
    core = T.core_name(name)
    lists = {
        "base": (reference, ean, branded, simple(name)),
        "index": (ean, reference, branded, simple(name), name),
        "tokens": (reference, ean, core, simple(core), name),
        "stock": (name,),
        "signature": (name,),
    }
    return F.array_distinct(F.filter(F.array(*lists[order]), lambda q: q != ""))


def expand_queries(products: DataFrame, order: str = "base") -> DataFrame:
    return products.select("id_product", F.posexplode(query_list(order)).alias("position", "query"))


def listing_words(listings: DataFrame) -> DataFrame:
    """Listings with the distinct words a site search can find them by."""
    if "__found_by" in listings.columns:
        return listings.select("competitor_id", "url", F.col("__title").alias("title_norm"), F.col("__found_by").alias("found_by"))
    found = T.words(T.normalize_text(F.concat_ws(" ", "title", "reference", "ean")))
    return listings.select("competitor_id", "url", T.normalize_text("title").alias("title_norm"), F.array_distinct(found).alias("found_by"))


def _prepared(products: DataFrame, listings: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Both catalogues as tables with all that is worked out per product and per listing: texts and queries, text keys,
    words. Spread by key, so that the pair work that follows is even whatever files the catalogues come in."""
    spark = products.sparkSession
    mine = _by_text(_with_keys(products, PRODUCT_KEYS), order)
    found = T.words(T.normalize_text(F.concat_ws(" ", "title", "reference", "ean")))
    keys = {"title": "title", "manufacturer": "brand", "hit_reference": "reference"}
    theirs = _with_keys(listings, keys).withColumn("__found_by", F.array_distinct(found))
    return (
        written(spark, mine.repartition("id_product"), "match-products"),
        written(spark, theirs.repartition("competitor_id", "url"), "match-listings"),
    )


def search_listings(
    queries: DataFrame, listings: DataFrame, page: int | None = None, block_rows: int = WORD_BLOCK
) -> DataFrame:
    """Site search: per competitor and distinct query, the listings that hold every word of it; with `page`, as a site
    that shows so many would, the first ones.

    A query is looked up by its rarest word only. The listings of a word that fills more than `block_rows` are cut
    into blocks and its queries repeated per block, so a word of a third of the catalogue neither multiplies pairs
    nor lands in one task. Ranking keeps the best page per query before the shuffle.
    """
    asked = queries.select("query").distinct().withColumn("query_norm", T.normalize_text("query"))
    asked = asked.withColumn("needs", F.array_distinct(T.words("query_norm"))).where(F.size("needs") > 0)
    postings = listing_words(listings).withColumn("word", F.explode("found_by"))
    frequency = postings.groupBy("competitor_id", "word").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / block_rows).cast("int")

    rarest = (
        asked.select("query", F.size("needs").alias("wanted"), F.explode("needs").alias("word"))
        .join(shuffled(frequency), "word")
        .groupBy("competitor_id", "query")
        .agg(F.min(F.struct("n", "word")).alias("key"), F.count("*").alias("known"), F.first("wanted").alias("wanted"))
        .where(F.col("known") == F.col("wanted"))  # a word no listing has: nothing to find
        .select("competitor_id", "query", "key.word", "key.n")
    )
    keyed = rarest.join(shuffled(asked), "query").select(
        "*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")
    ).drop("n")
    crowded = frequency.where(F.col("n") > block_rows).select("competitor_id", "word", blocks.alias("blocks"))
    spread = postings.join(crowded, ["competitor_id", "word"], "left").withColumn(
        "block", F.coalesce(F.pmod(F.xxhash64("url"), F.col("blocks")).cast("int"), F.lit(0))
    )
    hits = keyed.join(shuffled(spread), ["competitor_id", "word", "block"]).where(F.size(F.array_except("needs", "found_by")) == 0)
    if page is None:
        return hits.select("competitor_id", "query", "url")
    order = [
        T.holds_phrase(F.col("title_norm"), F.col("query_norm")).desc(),
        F.length("title_norm"),
        F.col("url"),
    ]
    return top_k_per(hits, ["competitor_id", "query"], order, page).select("competitor_id", "query", "url")


def _first_found(found: DataFrame) -> DataFrame:
    """Once per pair and url, with the first query that found it."""
    return found.groupBy(*PAIR, "url").agg(F.min(F.struct("position", "query")).alias("first")).select(
        *PAIR, "url", F.col("first.position").alias("position"), F.col("first.query").alias("matched_query")
    )


def _by_text(products: DataFrame, order: str) -> DataFrame:
    """Products with their `text_id`, the same for all that read alike but for reference and ean, and their queries
    split into `own` ones, which hold the reference or ean, and `shared` ones."""
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    reference, ean, brand = (clean(c) for c in ("supplier_reference", "ean", "brand"))
    branded = F.when(reference != "", F.trim(F.concat_ws(" ", brand, reference))).otherwise("")
    numbered = F.transform(query_list(order), lambda q, i: F.struct(i.alias("position"), q.alias("query")))
    names = F.array(reference, ean, branded)
    rows = _with_keys(products, PRODUCT_KEYS).withColumns({"__queries": numbered, "__names": names})
    rows = rows.withColumns(
        {
            "own": F.filter("__queries", lambda q: F.array_contains("__names", q["query"])),
            "shared": F.filter("__queries", lambda q: ~F.array_contains("__names", q["query"])),
            # a reference of signs alone is found in every title, so it belongs to the text
            "signs": F.when(F.col("__reference") == "", F.coalesce("supplier_reference", F.lit(""))).otherwise(""),
        }
    )
    text = F.to_json(F.struct("__brand", "__name", "shared", "signs"))
    return rows.withColumn("text_id", F.md5(text)).drop("__queries", "__names")


def _texts(by_text: DataFrame) -> DataFrame:
    """One product per text, without ean and, but for signs, without reference."""
    kept = F.struct("brand", "name", "signs", "shared", "__brand", "__name")
    first = by_text.groupBy("text_id").agg(F.min_by(kept, "id_product").alias("f"))
    return first.select(
        F.col("text_id").alias("id_product"),
        F.col("f.signs").alias("supplier_reference"),
        F.lit("").alias("ean"),
        "f.brand",
        "f.name",
        F.lit(None).cast("double").alias("source_price"),
        "f.shared",
        "f.__brand",
        "f.__name",
        F.lit("").alias("__reference"),
    )


def generate_candidates(products: DataFrame, listings: DataFrame, order: str = "base") -> DataFrame:
    """Listings that a product's queries reach, once per url with the first query that found it.

    What a product's own queries (reference, ean, brand with reference) find is listed for the product. What the
    queries it shares with all products of its text find is listed once per text, for the smallest of them: pairing
    every product with every listing of its name would grow with the square of a name's products. `best_candidates`
    ranks both per product.
    """
    by_text, listings = _prepared(products, listings, order)
    heads = by_text.groupBy("text_id").agg(F.min("id_product").alias("head"))
    text_hits = written(products.sparkSession, _text_hits(_texts(by_text), listings, order), "match-text-hits")
    own = written(products.sparkSession, _own_hits(by_text, listings), "match-own-hits")
    shared = _hits_of_texts(text_hits).join(shuffled(heads), "text_id").withColumnRenamed("head", "id_product")
    rows = _with_shared_hits(own, by_text, text_hits).unionByName(shared.select(*PAIR, "url", "position", "query"))
    return _first_found(rows)


def _text_hits(texts: DataFrame, listings: DataFrame, order: str) -> DataFrame:
    queries = texts.select("id_product", F.explode("shared").alias("q")).select("id_product", "q.position", "q.query")
    return _first_found(queries.join(shuffled(search_listings(queries, listings)), "query"))


def _hits_of_texts(text_hits: DataFrame) -> DataFrame:
    return text_hits.select(
        F.col("id_product").alias("text_id"), "competitor_id", "url", "position", F.col("matched_query").alias("query")
    )


def _own_hits(by_text: DataFrame, listings: DataFrame) -> DataFrame:
    own = by_text.select("id_product", F.explode("own").alias("q")).select("id_product", "q.position", "q.query")
    return own.join(shuffled(search_listings(own, listings)), "query").select(*PAIR, "url", "position", "query")


def _with_shared_hits(own: DataFrame, by_text: DataFrame, text_hits: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Hits of own queries, and for the same listings (or those in `more`) the hits of the product's shared queries."""
    pairs = own.select(*PAIR, "url")
    pairs = (pairs if more is None else pairs.unionByName(more)).distinct()
    pairs = pairs.join(shuffled(by_text.select("id_product", "text_id")), "id_product")
    shared = pairs.join(shuffled(_hits_of_texts(text_hits)), ["text_id", "competitor_id", "url"])
    return own.unionByName(shared.select(*PAIR, "url", "position", "query"))


def _shown_evidence(by_text: DataFrame, listings: DataFrame) -> DataFrame:
    """(id_product, competitor_id, url): titles that show a product's ean or reference anywhere, and equal eans."""
    needles = by_text.select(
        "id_product", F.explode(F.array(F.coalesce("ean", F.lit("")), "__reference")).alias("needle")
    ).where("needle <> ''").distinct()
    titles = listings.select("competitor_id", "url", F.col("__title").alias("text"))
    shown = needles.join(shuffled(substring_pairs(needles, titles, ["competitor_id", "url"])), "needle").select(*PAIR, "url")
    mine = by_text.select("id_product", T.valid_ean("ean").alias("e")).where("e <> ''")
    theirs = listings.select("competitor_id", "url", T.valid_ean("ean").alias("e")).where("e <> ''")
    return shown.union(mine.join(shuffled(theirs), "e").select(*PAIR, "url")).distinct()


def best_candidates(
    products: DataFrame, listings: DataFrame, kind: str = "base", k: int | None = None, ratio: Column | None = None
) -> DataFrame:
    """The best k listings by score per product and competitor, out of all that its queries reach, with the facts
    of both sides, `score` and `rank`.

    Scored once per text. The base and index scores rest on reference and ean besides, the tokens and signature scores
    on the product's price (`price_bands`); the latter compare texts by difflib, or by the `ratio` given.
    """
    k = TOP[kind] if k is None else k
    by_text, listings = _prepared(products, listings, kind)
    products = by_text.drop("text_id", "own", "shared", "signs")
    texts = _texts(by_text)
    text_hits = written(products.sparkSession, _text_hits(texts, listings, kind), "match-text-hits")
    find = _best_by_price if kind in PRICE_STEPS else _best_by_text
    ranked = find(products, listings, by_text, texts, text_hits, kind, k, ratio)
    return plain(attach_facts(ranked, products, listings))


RANKED = [*PAIR, "url", "position", "matched_query", "score"]


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("position"), F.col("url")]


def _best_by_text(products, listings, by_text, texts, text_hits, kind, k, ratio) -> DataFrame:
    """A listing that shows neither reference nor ean scores alike for all products of a text, so the text's best ones
    serve them all. Listings that a product's own queries reach, or that show its reference or ean, are scored for the
    product and replace entries of the text's list. The k best of the list go to every product, the next ones only to
    those that replace some, about as many as they replace: one product with many does not lengthen the list of all.
    """
    spark = products.sparkSession
    of_product = by_text.select("id_product", "text_id")
    own = written(spark, _own_hits(by_text, listings), "match-own-hits")
    special = _with_shared_hits(own, by_text, text_hits, _shown_evidence(by_text, listings))
    special = written(spark, _first_found(special), "match-special")
    replaced = special.groupBy(*PAIR).agg(F.count(F.lit(1)).cast("int").alias("n")).join(shuffled(of_product), "id_product")
    replaced = written(spark, replaced, "match-replaced")
    longest = replaced.agg(F.max("n")).first()[0] or 0
    limits = [2 * k]
    while limits[-1] < longest:
        limits.append(4 * limits[-1])
    more = F.lit(limits[-1])
    for limit in reversed(limits):
        more = F.when(F.col("n") <= limit, limit).otherwise(more)
    replaced = replaced.withColumn("more", more)  # the least limit that covers what the product replaces
    asked = replaced.groupBy("text_id", "competitor_id").agg(F.collect_set("more").alias("asked"))  # a few limits

    scored = score_candidates(attach_facts(special, products, listings), kind).select(*RANKED)
    text_scored = score_candidates(attach_facts(text_hits, texts.drop("shared"), listings), kind).select(*RANKED)
    text_scored = text_scored.withColumnRenamed("id_product", "text_id").join(shuffled(asked), ["text_id", "competitor_id"], "left")
    text_scored = text_scored.withColumn("most", F.coalesce(F.array_max("asked"), F.lit(0)))
    text_scored = written(spark, text_scored, "match-text-scores")
    lists = None
    for limit in [0, *limits]:  # lists of one length share a fixed limit, which ranking applies before the shuffle
        part = top_k_per(text_scored.where(F.col("most") == limit), ["text_id", "competitor_id"], _order(), k + limit)
        lists = part if lists is None else lists.unionByName(part)
    lists = written(spark, lists.drop("most"), "match-lists")
    alike = of_product.join(shuffled(lists.where(F.col("rank") <= k)), "text_id").select(*RANKED)
    rest = lists.where(F.col("rank") > k).withColumn("more", F.explode("asked")).where(F.col("rank") <= k + F.col("more"))
    rest = replaced.join(shuffled(rest), ["text_id", "competitor_id", "more"])
    alike = alike.unionByName(written(spark, rest.select(*RANKED), "match-further"))
    alike = alike.join(shuffled(special.select(*PAIR, "url")), [*PAIR, "url"], "left_anti")
    return top_k_per(scored.unionByName(alike), PAIR, _order(), k)


def _best_by_price(products, listings, by_text, texts, text_hits, kind, k, ratio) -> DataFrame:
    """Texts are compared once per text and listing; `best_priced` finds each price's best. A listing that a product's
    own queries reach too scores the same, only its place among the queries may be earlier."""
    spark = products.sparkSession
    kept = ["position", "matched_query", "similarity", "year_points", "c_price"]
    rows = similar_candidates(attach_facts(text_hits, texts.drop("shared"), listings, kind), kind, ratio)
    rows = rows.select(F.col("id_product").alias("text_id"), "competitor_id", "url", *kept)
    rows = written(spark, rows, "match-similarity")
    priced = by_text.select("id_product", "text_id", F.col("source_price").cast("double").alias("source_price"))
    shared = best_priced(rows, priced, *PRICE_STEPS[kind], k)
    own = written(spark, _own_hits(by_text, listings), "match-own-hits")
    own = _first_found(_with_shared_hits(own, by_text, text_hits))
    own = score_candidates(attach_facts(own, products, listings, kind), kind, ratio)
    both = shared.select(*RANKED).unionByName(own.select(*RANKED))
    first = both.groupBy(*PAIR, "url").agg(F.min(F.struct("position", "matched_query", "score")).alias("f"))
    return top_k_per(first.select(*PAIR, "url", "f.position", "f.matched_query", "f.score"), PAIR, _order(), k)


def best_by_site(products: DataFrame, listings: DataFrame, competitors: DataFrame, ratio: Column | None = None) -> DataFrame:
    """`best_candidates` of every competitor by the queries, score and list length of its `profile`."""
    profile = F.when(F.col("profile").isin(*TOP), F.col("profile")).otherwise("base")
    sites = competitors.select(F.col("id").alias("competitor_id"), profile.alias("profile"))
    out = None
    for kind in TOP:
        known = listings.join(sites.where(F.col("profile") == kind), "competitor_id", "left_semi")
        part = best_candidates(products, known, kind, ratio=ratio).withColumn("profile", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


PRODUCT_KEYS = {"brand": "brand", "name": "name", "reference": "supplier_reference"}
LISTING_KEYS = {"title": "c_title", "manufacturer": "c_brand", "hit_reference": "c_reference"}
QUERY_KEYS = {"query": "matched_query"}


def _with_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Adds the normalised form of the columns as __<key>, unless it is there already."""
    return df.withColumns({f"__{k}": T.normalize_text(c) for k, c in keys.items() if f"__{k}" not in df.columns})


def attach_facts(candidates: DataFrame, products: DataFrame, listings: DataFrame, kind: str | None = None) -> DataFrame:
    """Candidate pairs with the facts of both sides (c_ prefix: competitor). Text is normalised on the two
    catalogues before the joins, once per product and listing instead of once per pair; with the `kind` of a score
    that compares texts, they are also cut into its tokens or signatures there."""
    theirs = listings.select(
        "competitor_id",
        "url",
        F.col("title").alias("c_title"),
        F.col("reference").alias("c_reference"),
        F.col("ean").alias("c_ean"),
        F.col("brand").alias("c_brand"),
        F.col("breadcrumb").alias("c_breadcrumb"),
        F.col("price").alias("c_price"),
        *[c for c in ("__title", "__manufacturer", "__hit_reference") if c in listings.columns],
    )
    mine = _with_keys(products, PRODUCT_KEYS)
    theirs = _with_keys(theirs, LISTING_KEYS)
    if kind in PRICE_STEPS:
        mine, theirs = _product_forms(mine, kind), _listing_forms(theirs, kind)
    return candidates.join(shuffled(mine), "id_product").join(shuffled(theirs), ["competitor_id", "url"])


def plain(df: DataFrame) -> DataFrame:
    """Without the helper columns."""
    return df.drop(*[c for c in df.columns if c.startswith("__")])


# --- scores -------------------------------------------------------------------------------------------


def _normalized(df: DataFrame) -> DataFrame:
    return _with_keys(df, PRODUCT_KEYS | LISTING_KEYS | QUERY_KEYS)


def _points(condition: Column, value: int) -> Column:
    return F.when(condition, value).otherwise(0)


def _name_points() -> Column:
    hits = F.size(F.filter(T.long_words("__name"), lambda w: F.contains(F.col("__title"), w)))
    return F.least(F.lit(30), hits * 6)


def _inside(needle: str, hay: str) -> Column:
    return (F.col(needle) != "") & F.contains(F.col(hay), F.col(needle))


def _base_score() -> Column:
    title = F.col("__title")
    ean, reference = F.coalesce("ean", F.lit("")), F.coalesce("supplier_reference", F.lit(""))
    return (
        _points((ean != "") & F.contains(title, ean), 100)
        + _points((reference != "") & F.contains(title, F.col("__reference")), 60)
        + _points(_inside("__brand", "__title"), 30)
        + _name_points()
        - _points(T.contains_any(title, PACK_MARKS), 40)
        - _points(T.contains_any(title, USED_MARKS), 50)
        + _points(_inside("__query", "__title"), 20)
        + _points(title.contains("search"), 5)
    )


def _index_score() -> Column:
    title = F.col("__title")
    ean, hit_ean = T.valid_ean("ean"), T.valid_ean("c_ean")
    reference = F.col("__reference")
    score = (
        F.when((ean != "") & (ean == hit_ean), 100)
        .when((ean != "") & F.contains(title, ean), 95)
        .otherwise(0)
        + F.when((reference != "") & (reference == F.col("__hit_reference")), 70)
        .when((reference != "") & F.contains(title, reference), 55)
        .otherwise(0)
        + _points(_inside("__brand", "__title"), 25)
        + _points(_inside("__brand", "__manufacturer"), 15)
        + _name_points()
        + _points(_inside("__query", "__title"), 20)
        - _points(T.contains_any(title, INDEX_ACCESSORIES), 35)
        - _points(T.contains_any(title, INDEX_USED_MARKS), 50)
    )
    return clamped(score)


def sequence_ratio(a: Column, b: Column) -> Column:
    """difflib's similarity of two short strings, by Arrow batches, once per distinct pair."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        pairs = list(zip(left, right))
        known = {pair: SequenceMatcher(None, *pair).ratio() for pair in set(pairs)}
        return pd.Series([known[pair] for pair in pairs])

    return ratio(a, b)


def _added(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: value for c, value in columns.items() if c not in df.columns})


def _product_forms(rows: DataFrame, kind: str) -> DataFrame:
    """What a score that compares texts takes from the product alone, unless it is there already."""
    rows = _added(rows, {"__core": T.normalize_text(T.core_name("name"))})
    rows = _added(rows, {"__year": T.year_hint("__core")})
    if kind == "signature":
        return _added(rows, {"__qs": T.model_signature("__core", "__brand")})
    rows = _added(rows, {"__q": T.meaningful_tokens("__core"), "__b": T.meaningful_tokens("__brand"), "__brand_words": T.words("__brand")})
    strong = F.filter("__q", lambda w: ~w.isin(*GENERIC_TOKENS) & (F.length(w) > 3) & ~w.rlike(r"^\d+$"))
    return _added(rows, {"__q_strong": strong, "__left": F.array_contains("__q", "lh")})


def _listing_forms(rows: DataFrame, kind: str) -> DataFrame:
    """What a score that compares texts takes from the listing alone, unless it is there already."""
    rows = _added(rows, {"__c_year": T.year_hint("__title")})
    if kind == "signature":
        branded = F.coalesce("c_brand", F.lit("")) != ""
        accessory = F.exists(T.words("__title"), lambda w: w.isin(*TITLE_ACCESSORIES))
        return _added(
            rows, {"__ts": F.when(branded, T.model_signature("__title", "__manufacturer")), "__accessory": accessory}
        )
    rows = _added(rows, {"__t": T.meaningful_tokens("__title"), "__m": T.meaningful_tokens("__manufacturer")})
    accessory = F.exists("__t", lambda w: w.isin(*TITLE_ACCESSORIES))
    left, unfit = F.array_contains("__t", "lh"), T.contains_any(F.col("__title"), B_STOCK_MARKS)
    return _added(rows, {"__accessory": accessory, "__c_left": left, "__b_stock": unfit})


def _year_points() -> Column:
    years = F.col("__year"), F.col("__c_year")
    return T.year_penalty(F.col("__core"), F.col("__title"), F.col("__brand"), F.col("__manufacturer"), years)


def _similar_tokens(df: DataFrame, ratio: Column | None) -> DataFrame:
    mine, theirs = F.col("__b"), F.col("__m")
    rows = df.where(~F.col("__b_stock"))
    rows = rows.where((F.size(mine) == 0) | (F.size(theirs) == 0) | F.arrays_overlap(mine, theirs))
    shared = lambda c: F.size(F.filter(c, lambda w: F.array_contains(F.col("__t"), w)))
    rows = rows.withColumns(
        {
            "__common": shared("__q"),
            "__strong": shared("__q_strong"),
            "__ratio": sequence_ratio(F.array_join("__q", " "), F.array_join("__t", " ")) if ratio is None else ratio,
        }
    )
    n_common, n_strong = F.col("__common"), F.col("__strong")
    similar = (
        n_common / F.size("__q") * 45.0
        + n_common / F.size("__t") * 10.0
        + F.col("__ratio") * 10.0
        + F.when(n_strong > 0, F.least(F.lit(30), n_strong * 10)).when(n_common > 0, -18).otherwise(-25)
        - _points(F.col("__accessory"), 35)
    )
    compared = (F.size("__m") > 0) & (F.size("__brand_words") > 0)
    branded = F.when(compared, F.when(F.arrays_overlap("__m", "__brand_words"), 20).otherwise(-20)).otherwise(0)
    first = similar + branded + _points(_inside("__core", "__title"), 20)
    capped = (
        F.when((n_strong == 0) & (F.col("__ratio") < 0.55), F.least(first, F.lit(55.0)))
        .when((n_strong > 0) & (F.col("__ratio") < 0.45), first - 10)
        .otherwise(first)
    )
    hands = (
        F.when(F.col("__left") & F.col("__c_left"), 12)
        .when(F.col("__left") | F.col("__c_left"), -15)
        .otherwise(0)
    )
    empty = (F.size("__q") == 0) | (F.size("__t") == 0)  # scores 0, and no price or year adds to it
    return rows.withColumns(
        {
            "similarity": F.when(empty, 0.0).otherwise(capped + hands),
            "year_points": F.when(empty, 0).otherwise(_year_points()),
        }
    )


def _similar_signature(df: DataFrame, ratio: Column | None) -> DataFrame:
    # a listing without a brand is read with the product's
    rows = df.withColumn("__ts", F.coalesce("__ts", T.model_signature("__title", "__brand")))
    rows = rows.withColumn("__ratio", sequence_ratio(F.col("__qs"), F.col("__ts")) if ratio is None else ratio)
    brand, seller_norm = F.col("__brand"), F.col("__manufacturer")
    same_brand = F.contains(seller_norm, brand) | F.contains(brand, seller_norm)
    branded = F.when((brand != "") & (seller_norm != ""), F.when(same_brand, 20).otherwise(-10)).otherwise(0)
    has_q, has_t = F.col("__qs") != "", F.col("__ts") != ""
    model = (
        F.when(has_q & has_t & (F.col("__qs") == F.col("__ts")), 55)
        .when(has_q & has_t, F.rint(F.col("__ratio") * 35).cast("int") - _points(F.col("__ratio") < 0.45, 10))
        .when(has_q | has_t, -8)
        .otherwise(0)
    )
    score = (
        branded
        + model
        + _points(_inside("__core", "__title"), 10)
        + _points(_inside("__brand", "__title"), 5)
        - _points(F.col("__accessory"), 35)
    )
    return rows.withColumns({"similarity": score.cast("double"), "year_points": _year_points()})


def similar_candidates(pairs: DataFrame, kind: str, ratio: Column | None = None) -> DataFrame:
    """What the tokens and signature scores owe to text alone, as `similarity` and `year_points`; prices are not read.
    Texts are compared by difflib, or by the `ratio` given."""
    rows = _listing_forms(_product_forms(_normalized(pairs), kind), kind)
    return plain(_similar_tokens(rows, ratio) if kind == "tokens" else _similar_signature(rows, ratio))


def score_candidates(pairs: DataFrame, kind: str = "base", ratio: Column | None = None) -> DataFrame:
    """Score of every candidate pair (see `attach_facts`). The index form drops scores below its floor."""
    if kind in PRICE_STEPS:
        points = price_points("c_price", "source_price", *PRICE_STEPS[kind])
        score = priced_score(F.col("similarity"), points, F.col("year_points"))
        return similar_candidates(pairs, kind, ratio).withColumn("score", score).drop("similarity", "year_points")
    rows = _normalized(pairs)
    if kind != "index":  # sites that are asked by name alone are scored like the base ones
        rows = rows.withColumn("score", _base_score())
    else:
        rows = rows.withColumn("score", _index_score()).where(F.col("score") >= INDEX_KEEP)
    return plain(rows)


def drop_b_stock(df: DataFrame, title: str = "c_title") -> DataFrame:
    return df.where(~T.contains_any(T.normalize_text(title), B_STOCK_MARKS))


def brand_overlap(source: str, candidate: str) -> Column:
    """Token form: true when either side is unknown."""
    mine = T.meaningful_tokens(T.normalize_text(source))
    theirs = T.meaningful_tokens(T.normalize_text(candidate))
    return (F.size(mine) == 0) | (F.size(theirs) == 0) | F.arrays_overlap(mine, theirs)


def brand_contained(source: str, candidate: str) -> Column:
    """Compact form: false when either side is unknown."""
    mine, theirs = T.compact(T.normalize_text(source)), T.compact(T.normalize_text(candidate))
    return (mine != "") & (theirs != "") & (F.contains(mine, theirs) | F.contains(theirs, mine))


def category_affinity(path: Column | str, breadcrumb: Column | str) -> Column:
    """0..25 from the leaves and the shared segments of two `>` paths."""

    def segments(col: Column | str) -> Column:
        text = F.col(col) if isinstance(col, str) else col
        parts = F.split(F.coalesce(text, F.lit("")), ">")
        return F.filter(F.transform(parts, T.normalize_text), lambda p: p != "")

    mine, theirs = segments(path), segments(breadcrumb)
    leaf_a, leaf_b = F.try_element_at(mine, F.lit(-1)), F.try_element_at(theirs, F.lit(-1))
    leaf = (
        F.when(leaf_a == leaf_b, 15)
        .when(F.contains(leaf_b, leaf_a) | F.contains(leaf_a, leaf_b), 10)
        .otherwise(0)
    )
    core_a = F.filter(mine, lambda p: ~p.isin(*ROOT_SEGMENTS))
    core_b = F.filter(theirs, lambda p: ~p.isin(*SITE_ROOT_SEGMENTS))
    shared = F.least(F.lit(12), F.size(F.array_intersect(core_a, core_b)) * 4)
    known = (F.size(mine) > 0) & (F.size(theirs) > 0)
    return F.when(known, F.least(F.lit(25), leaf + shared)).otherwise(0)


# --- verification, ranking, decision ------------------------------------------------------------------


def verify_listings(pairs: DataFrame) -> DataFrame:
    """Does the listing's page carry the product? Expects page_reference, page_title and page_text beside the
    pair; adds `verified` and the `evidence`: page_reference, ean, reference, title_ean, title_reference or title."""
    page = {"page_ref": "page_reference", "page_title": "page_title", "page_text": "page_text"}
    rows = _with_keys(pairs, PRODUCT_KEYS | LISTING_KEYS | page).withColumns(
        {"__ean": T.valid_ean("ean"), "__hit_ean": T.valid_ean("c_ean")}
    )
    c = F.col
    no_brand = c("__brand") == ""
    brand_ok = (
        no_brand
        | (c("__manufacturer") == "")
        | F.contains("__manufacturer", "__brand")
        | F.contains("__brand", "__manufacturer")
    )
    shows_brand = _inside("__brand", "__page_title") | _inside("__brand", "__page_text")
    evidence = (
        F.when(T.same_reference(c("__reference"), c("__page_ref")) & brand_ok, "page_reference")
        .when((c("__ean") != "") & (c("__ean") == c("__hit_ean")), "ean")
        .when(T.same_reference(c("__reference"), c("__hit_reference")) & brand_ok, "reference")
        .when(_inside("__ean", "__page_title"), "title_ean")
        .when(_inside("__reference", "__page_title") & shows_brand, "title_reference")
        .when(_inside("__title", "__page_title") & (no_brand | shows_brand), "title")
    )
    return plain(rows.withColumn("evidence", evidence).withColumn("verified", F.col("evidence").isNotNull()))


def rank_candidates(scored: DataFrame, k: int = TOP["base"]) -> DataFrame:
    """Best k per product and competitor; earlier queries, then urls, break ties."""
    order = [F.col("score").desc(), F.col("position"), F.col("url")]
    return top_k_per(scored, PAIR, order, k)


def merge_selections(ranked: DataFrame, selections: DataFrame) -> DataFrame:
    """Best candidate per pair. An external verdict (id_product, competitor_id, best_index, confidence) on the top
    three replaces choice and score; index and confidence are clamped."""
    whole_pool = Window.partitionBy(*PAIR)  # at most three rows, and partitioned by the ranking already
    pool = ranked.where("rank <= 3").withColumn("__pool", F.max("rank").over(whole_pool))
    rows = pool.join(shuffled(selections.select(*PAIR, "best_index", "confidence")), PAIR, "left")
    chosen = F.greatest(F.lit(0), F.least(F.col("__pool") - 1, F.col("best_index"))) + 1
    verdict = F.greatest(F.lit(0), F.least(F.lit(100), F.col("confidence")))
    return (
        rows.where(F.col("rank") == F.coalesce(chosen, F.lit(1)))
        .withColumn("selected", F.col("best_index").isNotNull())
        .withColumn("score", F.when(F.col("selected"), verdict).otherwise(F.col("score")))
        .drop("__pool", "best_index", "confidence")
    )


def price_capped(score: Column, ratio: Column, profile: Column) -> Column:
    def caps(name: str) -> Column:
        out = score
        for low, cap in reversed(PRICE_CAPS[name]):
            out = F.when(ratio >= low, F.least(score, F.lit(cap))).otherwise(out)
        return out

    # on the default sites a cap that would not lower the score lets the next, weaker one apply: same minimum
    picked = caps("default")
    for name in ("tokens", "signature"):
        picked = F.when(profile == name, caps(name)).otherwise(picked)
    return F.when(ratio.isNull(), score).otherwise(picked)


def decide_matches(
    products: DataFrame, ranked: DataFrame, competitors: DataFrame, selections: DataFrame | None = None
) -> DataFrame:
    """Outcome per product and competitor that has candidates: not_found below 30, else matched or pending.

    Without external verdicts `matched` needs more than 90; with them the score is first capped by the price gap
    and `matched` needs 95.
    """
    if selections is None:
        best = ranked.where("rank = 1")
        threshold = F.col("score") > MATCHED_ABOVE
    else:
        best = (
            merge_selections(ranked, selections)
            .drop("source_price")
            .join(shuffled(products.select("id_product", "source_price")), "id_product")
            .join(competitors.select(F.col("id").alias("competitor_id"), "profile"), "competitor_id")
        )
        gap = M.price_ratio("c_price", "source_price")
        best = best.withColumn("score", price_capped(F.col("score"), gap, F.col("profile")))
        threshold = F.col("score") >= SELECTED_MATCH
    found = F.col("score") >= NOT_FOUND_BELOW
    result = F.when(~found, "not_found").when(threshold, "matched").otherwise("pending")
    return best.select(
        *PAIR,
        result.alias("result"),
        F.when(found, F.col("url")).alias("url"),
        F.when(found, F.col("c_title")).alias("competitor_title"),
        F.when(found, F.col("score")).alias("score"),
        F.when(found, F.col("matched_query")).alias("matched_query"),
        F.when(found, F.col("c_price")).alias("competitor_price"),
    )


def classify_errors(errors: DataFrame, message: str = "message") -> DataFrame:
    text = F.lower(F.coalesce(F.col(message), F.lit("")))
    result = (
        F.when(T.contains_any(text, CLOUDFLARE_MARKS), "cloudflare")
        .when(text.contains(NO_SEARCH_MARK), "search_input_not_found")
        .otherwise("not_found")
    )
    return errors.withColumn("result", result)


# --- profiles and images ------------------------------------------------------------------------------


def catalog_profile(products: DataFrame, name: str = "name", brand: str = "brand", title: str | None = None) -> DataFrame:
    """Brand, model, year, colour, colour family, instrument and guitar flag of product names."""
    rows = products.withColumns(
        {"__n": T.normalize_text(name), "__b": T.normalize_text(brand), "__t": T.normalize_text(title or name)}
    ).withColumn("profile_color", T.color_hint("__n"))
    return rows.withColumns(
        {
            "profile_brand": F.col("__b"),
            "profile_model": T.model_signature("__n", "__b", variant="catalog"),
            "profile_year": T.year_hint("__n"),
            "profile_color_family": T.color_family("profile_color"),
            "profile_instrument": T.instrument_type("__t"),
            "profile_is_guitar": T.looks_like_guitar(F.concat_ws(" ", "__n", "__t", "__b")),
        }
    ).drop("__n", "__b", "__t")


def average_hash(values: Column | str) -> Column:
    """64-bit hash: bit i is set where value i reaches the mean."""
    array = (F.col(values) if isinstance(values, str) else values).cast("array<double>")
    mean = F.aggregate(array, F.lit(0.0), lambda s, x: s + x) / F.size(array)
    bits = F.transform(array, lambda x, i: F.when(x >= mean, F.expr("1L")).otherwise(F.expr("0L")) * 1)
    indexed = F.transform(bits, lambda b, i: F.call_function("shiftleft", b, i))
    return F.aggregate(indexed, F.expr("0L"), lambda s, b: s.bitwiseOR(b))


def hamming(a: Column | str, b: Column | str) -> Column:
    left, right = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(left.bitwiseXOR(right))


def hamming_pairs(pairs: DataFrame, hashes_a: DataFrame, hashes_b: DataFrame, limit: int = 64) -> DataFrame:
    """Distance of given image pairs (id_a, id_b); hash tables are (id, hash)."""
    a = hashes_a.select(F.col("id").alias("id_a"), F.col("hash").alias("hash_a"))
    b = hashes_b.select(F.col("id").alias("id_b"), F.col("hash").alias("hash_b"))
    rows = pairs.join(a, "id_a").join(b, "id_b").withColumn("distance", hamming("hash_a", "hash_b"))
    return rows.where(F.col("distance") <= limit)
