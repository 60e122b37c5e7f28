"""Extraction jobs over a table of fetched pages (page_id, url, html[, profile]).

There is no HTML library on the executors: rules are regular expressions on the mark-up, evaluated JVM-side. They
cover attributes in any order and quoting style. An element's text ends at its own closing tag, with up to
`NESTED` elements of its name inside each other; beyond that, and where tags do not pair, at the first closing tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.prices import parse_price
from ..functions.urls import absolute_url, url_path

# Where sites show prices, titles, images, references and breadcrumbs.
META_PRICES = (("itemprop", "price"), ("property", "product:price:amount"), ("property", "og:price:amount"))
INDEX_META_PRICES = (("property", "product:price:amount"), ("property", "og:price:amount"), ("itemprop", "price"))
PRICE_RULES = {  # site profile: (element, or "" for any, and classes) tried in order
    "index": (
        ("div", "fwb fs40 fs30-md fs28-sm lh1"),
        ("", "fwb fs40 fs30-md fs28-sm lh1"),
        ("", "col-20 wsnw"),
    ),
    "tokens": (
        ("div", "price fx-text fx-text--no-margin"),
        ("span", "fx-typography-price-primary"),
        ("div", "price"),
        ("", "price fx-text"),
    ),
    "stock": (("", "product-final-price"),),
    "signature": (("span", "price"), ("", "price")),
}
STOCK_INNER_CLASS = "price-decimal"  # inside the element of the rule above
INDEX_PRICE_KEYS = ("price", "salePrice", "price_amount")
TITLE_METAS = (("property", "og:title"), ("name", "title"), ("itemprop", "name"))
IMAGE_METAS = (("property", "og:image"), ("name", "twitter:image"), ("property", "og:image:secure_url"))
BREADCRUMB_CLASSES = ("breadcrumb", "breadcrumbs")
PRODUCT_PATH, LISTING_PATH = r"(?i)/p\d+/", r"(?i)/m\d+-"
CATALOGUE_TITLES = ("catalogue france",)
CATALOGUE_TITLES_WHOLE = ("epiphone",)
NESTED = 4  # our own: depth of elements of one name inside each other
EMBEDDED_MARKER = "tho.bootstrapModule('search.index',"
REFERENCE_LABEL = r"(?i)R[ée]f[ée]rence\s+marque\s*:\s*(?:</[^>]+>\s*<[^>]+>\s*)?([^<\n\r]+)"
SPEC_REFERENCE_LABELS, SPEC_EAN_LABELS = ("sku", "reference", "ref"), ("ean", "gtin")  # accents folded
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&euro;", "€"), ("&amp;", "&"))

PRICE_LD = "array<struct<name:string,mpn:string,sku:string,gtin13:string,gtin:string,ean:string,offers:struct<price:string,priceSpecification:struct<price:string>>>>"
EMBEDDED = (
    "array<struct<articleListsSettings:struct<"
    "articles:array<struct<title:string,model:string,name:string,manufacturer:string,relativeLink:string,url:string>>,"
    "alternativeArticles:array<struct<title:string,model:string,name:string,manufacturer:string,relativeLink:string,url:string>>>>>"
)


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _filled(value: Column) -> Column:
    """Trimmed value, null when blank; names `value` once, so it is worked out once."""
    return F.get(F.filter(F.array(F.trim(value)), lambda v: v != ""), F.lit(0))


def _first_text(*values: Column) -> Column:
    """First value that is not blank, trimmed; later values are only worked out when needed."""
    return F.coalesce(*[_filled(v) for v in values])


def plain_text(fragment: Column | str) -> Column:
    """Mark-up to text: tags become blanks, common entities characters, runs of white space one blank."""
    out = F.regexp_replace(_c(fragment), r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[\s ]+", " "))


def attribute(tag: Column | str, name: str) -> Column:
    return F.regexp_extract(_c(tag), rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def meta_content(html: Column | str, key: str, value: str) -> Column:
    tag = F.regexp_extract(_c(html), rf"""(?is)(<meta\b[^>]*\s{key}\s*=\s*["']{value}["'][^>]*>)""", 1)
    return attribute(tag, "content")


def element_text(html: Column | str, tag: str) -> Column:
    return plain_text(F.regexp_extract(_c(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))


def class_fragment(html: Column | str, classes: str, element: str = "") -> Column:
    """Inner mark-up of the first element (of the given name, if any) that carries every class."""
    wanted = "".join(rf"""(?=[^"']*(?<![\w-]){c}(?![\w-]))""" for c in classes.split())
    # possessive, so neither depth nor length of the element costs stack or a second try
    inner = r"(?:[^<]++|<(?!/?\1\b))*+"
    for _ in range(NESTED):
        inner = rf"(?:[^<]++|<(?!/?\1\b)|<\1\b[^>]*+>{inner}</\1\s*+>)*+"
    opening = rf"""<({element or r"\w+"})\b[^>]*\sclass\s*=\s*["']{wanted}[^"']*["'][^>]*>"""
    return F.regexp_extract(_c(html), rf"(?is){opening}({inner}(?=</\1)|.*?)</\1\s*>", 2)


def ld_entries(html: Column | str) -> Column:
    """Product entries of all JSON-LD blocks, in page order; blocks that do not parse add nothing."""
    blocks = F.regexp_extract_all(
        _c(html), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1)
    )
    parsed = F.transform(blocks, lambda b: F.coalesce(F.from_json(b, PRICE_LD), F.array().cast(PRICE_LD)))
    return F.flatten(parsed)


def _first_of(entries: Column, pick) -> Column:
    values = F.filter(F.transform(entries, pick), lambda v: v.isNotNull())
    return F.get(values, F.lit(0))


def ld_price_texts(entries: Column) -> Column:
    return F.flatten(
        F.transform(entries, lambda e: F.array(e["offers"]["price"], e["offers"]["priceSpecification"]["price"]))
    )


def meta_fragments(html: Column | str, metas: tuple[tuple[str, str], ...] = META_PRICES) -> list[Column]:
    return [meta_content(html, k, v) for k, v in metas]


def euro_fragment(html: Column | str) -> Column:
    return F.regexp_extract(_c(html), r"([0-9][0-9 .,\u00A0]*)\s*€", 1)


def script_fragments(html: Column | str) -> list[Column]:
    """Price keys of scripts on the index sites."""
    return [F.regexp_extract(_c(html), rf'(?i)"{k}"\s*:\s*"?(\d+(?:[.,]\d+)?)', 1) for k in INDEX_PRICE_KEYS]


def is_product_page(url: Column | str, html: Column | str) -> Column:
    """By path, else by title, canonical link and price meta tags."""
    page = _c(html)
    title = F.lower(F.trim(F.regexp_extract(page, r"(?is)<title>(.*?)</title>", 1)))
    tag = F.regexp_extract(page, r"""(?is)(<link\b[^>]*\srel\s*=\s*["']canonical["'][^>]*>)""", 1)
    canonical = url_path(F.trim(attribute(tag, "href")))
    has_price = F.lit(False)
    for key, value in META_PRICES:
        has_price = has_price | page.contains(f'{key}="{value}"')
    return (
        F.when(url_path(url).rlike(PRODUCT_PATH), True)
        .when(T.contains_any(title, CATALOGUE_TITLES) | title.isin(*CATALOGUE_TITLES_WHOLE), False)
        .when(canonical.rlike(PRODUCT_PATH), True)
        .when(canonical.rlike(LISTING_PATH), False)
        .otherwise(has_price)
    )


def extract_page_prices(pages: DataFrame) -> DataFrame:
    """Price of each page by its site profile's rules: first rule that gives one; later rules are not tried.

    index: class, meta, script keys; tokens: class, meta; stock: class, meta, JSON-LD; signature: class, on product
    pages only; other sites: meta, then the first amount in euros.
    """

    def first_price(*fragments: Column) -> Column:
        return F.coalesce(*[parse_price(plain_text(f)) for f in fragments])

    classes = {p: [class_fragment("html", c, e) for e, c in found] for p, found in PRICE_RULES.items()}
    classes["stock"] += [class_fragment(f, STOCK_INNER_CLASS) for f in classes["stock"]]
    meta = meta_fragments("html")
    ld = F.filter(F.transform(ld_price_texts(ld_entries("html")), lambda t: parse_price(plain_text(t))), lambda p: p.isNotNull())
    profile = F.coalesce("profile", F.lit(""))
    price = (
        F.when(
            profile == "index",
            first_price(*classes["index"], *meta_fragments("html", INDEX_META_PRICES), *script_fragments("html")),
        )
        .when(profile == "tokens", first_price(*classes["tokens"], *meta))
        .when(profile == "stock", F.coalesce(first_price(*classes["stock"], *meta), F.get(ld, F.lit(0))))
        .when(profile == "signature", F.when(is_product_page("url", "html"), first_price(*classes["signature"])))
        .otherwise(first_price(*meta, euro_fragment("html")))
    )
    return pages.withColumn("price", price)


def extract_titles(pages: DataFrame) -> DataFrame:
    """Social title, meta title, JSON-LD name, first heading, document title."""
    metas = [meta_content("html", k, v) for k, v in TITLE_METAS]
    rows = pages.withColumn("__ld", ld_entries("html"))
    ld_name = _first_of(F.col("__ld"), lambda e: F.nullif(F.trim(e["name"]), F.lit("")))
    title = _first_text(*[plain_text(m) for m in metas], ld_name, element_text("html", "h1"), element_text("html", "title"))
    return rows.withColumn("page_title", title).drop("__ld")


_ANCHOR = r"""(?is)<a\b[^>]*\shref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""


def extract_links(pages: DataFrame, allowed_domain: str | None = None) -> DataFrame:
    """One row per anchor with target and text; optionally only targets that hold the domain."""
    hrefs = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(2))
    rows = pages.select("page_id", "url", F.posexplode(F.arrays_zip(hrefs.alias("href"), texts.alias("text"))).alias("position", "a"))
    rows = rows.select(
        "page_id",
        "url",
        "position",
        F.col("a.href").alias("href"),
        plain_text("a.text").alias("text"),
        absolute_url("url", "a.href").alias("target"),
    ).where("href <> '' AND text <> ''")
    return rows if allowed_domain is None else rows.where(F.contains("href", F.lit(allowed_domain)))


def extract_breadcrumb(pages: DataFrame) -> DataFrame:
    """`a > b > c` from the first breadcrumb element; one-letter parts are dropped."""
    body = F.coalesce(
        *[
            F.nullif(
                F.regexp_extract(
                    "html",
                    rf"""(?is)<(nav|ol|ul|div)\b[^>]*\s(?:class|aria-label)\s*=\s*["'][^"']*(?<![\w-]){c}(?![\w-])[^"']*["'][^>]*>(.*?)</\1>""",
                    2,
                ),
                F.lit(""),
            )
            for c in BREADCRUMB_CLASSES
        ]
    )
    marked = F.regexp_replace(body, r"(?s)<[^>]*>", " > ")
    for entity, char in ENTITIES:
        marked = F.replace(marked, F.lit(entity), F.lit(char))
    parts = F.transform(F.split(F.regexp_replace(marked, r"\s*(?:>+|»|/|›)\s*", ">"), ">"), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: F.length(p) > 1)
    return pages.withColumn("breadcrumb", F.nullif(F.array_join(kept, " > "), F.lit("")))


def extract_image(pages: DataFrame) -> DataFrame:
    """Main image: social images, image link, marked image, first image."""
    link = F.regexp_extract("html", r"""(?is)(<link\b[^>]*\srel\s*=\s*["']image_src["'][^>]*>)""", 1)
    marked = F.regexp_extract("html", r"""(?is)(<img\b[^>]*\s(?:itemprop\s*=\s*["']image["']|id\s*=\s*["']photoCover["'])[^>]*>)""", 1)
    first = F.regexp_extract("html", r"(?is)(<img\b[^>]*>)", 1)
    found = _first_text(
        *[meta_content("html", k, v) for k, v in IMAGE_METAS],
        attribute(link, "href"),
        attribute(marked, "src"),
        attribute(marked, "data-src"),
        attribute(first, "src"),
        attribute(first, "data-src"),
    )
    resolved = F.when(F.col("__found").isNotNull(), absolute_url("url", "__found"))
    return pages.withColumn("__found", found).withColumn("image_url", resolved).drop("__found")


def extract_references(pages: DataFrame) -> DataFrame:
    """Reference and EAN shown by a page: labelled text, specification list, JSON-LD keys. Normalised."""
    rows = pages.withColumn("__ld", ld_entries("html"))
    specs = F.transform(
        F.regexp_extract_all("html", F.lit(r"""(?is)<li\b[^>]*class\s*=\s*["'][^"']*spec-item[^"']*["'][^>]*>(.*?)</li>"""), F.lit(1)),
        plain_text,
    )

    def spec(labels: tuple[str, ...]) -> Column:
        def value(item: Column) -> Column:
            named = T.normalize_text(item).rlike("^(" + "|".join(labels) + ")")
            rest = F.regexp_replace(F.regexp_replace(item, r"^\S+", ""), r"^[\s:|-]+", "")
            return F.when(named, F.nullif(F.trim(rest), F.lit("")))

        return _first_of(specs, value)

    def ld(*keys: str) -> Column:
        return _first_of(F.col("__ld"), lambda e: F.coalesce(*[F.nullif(F.trim(e[k]), F.lit("")) for k in keys]))

    label = plain_text(F.regexp_extract("html", REFERENCE_LABEL, 1))
    return rows.withColumns(
        {
            "page_reference": T.normalize_text(_first_text(label, ld("mpn", "sku"), spec(SPEC_REFERENCE_LABELS))),
            "page_ean": T.normalize_text(_first_text(ld("gtin13", "gtin", "ean"), spec(SPEC_EAN_LABELS))),
        }
    ).drop("__ld")


def extract_embedded_listings(pages: DataFrame, base_url: str) -> DataFrame:
    """Listings of the JSON array a search page hands to its scripts, once per url. The JSON reader stops at the
    end of the array, so what follows it does not matter."""
    start = F.instr("html", EMBEDDED_MARKER)
    tail = F.substr("html", start + len(EMBEDDED_MARKER))
    payload = F.when(start > 0, F.from_json(F.substr(tail, F.instr(tail, "[")), EMBEDDED))
    lists = F.get(payload, F.lit(0))["articleListsSettings"]
    none = F.array().cast("array<struct<title:string,model:string,name:string,manufacturer:string,relativeLink:string,url:string>>")
    articles = F.concat(F.coalesce(lists["articles"], none), F.coalesce(lists["alternativeArticles"], none))
    rows = pages.select("page_id", F.posexplode(articles).alias("position", "a"))
    link = _first_text(F.col("a.relativeLink"), F.col("a.url"))
    rows = rows.select(
        "page_id",
        "position",
        _first_text(F.col("a.title"), F.col("a.model"), F.col("a.name")).alias("title"),
        F.coalesce(F.trim("a.manufacturer"), F.lit("")).alias("manufacturer"),
        absolute_url(F.lit(base_url.rstrip("/") + "/"), link).alias("url"),
    ).where(F.col("title").isNotNull() & F.col("url").startswith(base_url.rstrip("/") + "/"))
    return rows.groupBy("page_id", "url").agg(F.min_by(F.struct("title", "manufacturer"), "position").alias("v")).select(
        "page_id", "url", "v.title", "v.manufacturer"
    )
