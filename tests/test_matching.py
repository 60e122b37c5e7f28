"""Matching jobs against brute force and plain Python restatements on small fixtures."""

from __future__ import annotations

import difflib
import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retailweave import fixtures as fx
from retailweave.checks import load_registry
from retailweave.functions import text as T
from retailweave.operators import feed as W
from retailweave.operators import matching as X
from retailweave.operators import pages as P
from retailweave.operators import price_bands
from retailweave.operators.gram_index import rows_with_part, substring_pairs, write_index
from retailweave.operators.hash_search import near_hashes
from retailweave.operators.price_bands import best_priced
from test_functions import normal


def test_search_equals_brute_force_with_a_hot_word(spark):
    rng = random.Random(2)
    words = ["guitar"] * 6 + ["red", "blue", "amp", "x1", "x2", "pro"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))) for _ in range(120)]
    listings = spark.createDataFrame(
        [(i % 2 + 1, f"u{i:03d}", t, "", "") for i, t in enumerate(titles)], "competitor_id int, url string, title string, reference string, ean string"
    )
    queries = ["guitar", "red guitar", "Guitar pro", "x1", "zzz", "zzz guitar", "blue amp red", "-"]
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    got = {(r["competitor_id"], r["query"], r["url"]) for r in X.search_listings(asked, listings, page=3, block_rows=9).collect()}
    want = set()
    for c, q in itertools.product((1, 2), queries):
        need = normal(q).split()
        hits = [(f" {normal(q)} " not in f" {t} ", len(t), f"u{i:03d}") for i, t in enumerate(titles) if i % 2 + 1 == c and need and set(need) <= set(t.split())]
        want |= {(c, q, u) for _, _, u in sorted(hits)[:3]}
    assert got == want


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return Counter(re.findall(r"(BroadcastHash|SortMerge|BroadcastNestedLoop)Join", plan))


def test_tables_that_grow_are_not_sent_through_the_driver(spark):
    """Compressed tables of a few MB hold hundreds of MB of rows; only the few crowded words and parts may be sent."""
    products = spark.createDataFrame([(1, "A-1", "", "b", "n", 1.0)], "id_product long, supplier_reference string, ean string, brand string, name string, source_price double")
    listings = spark.createDataFrame(
        [(1, "u", "b n A-1", "", "", "b", "", 1.0)],
        "competitor_id int, url string, title string, reference string, ean string, brand string, breadcrumb string, price double",
    )
    queries = products.select(F.col("name").alias("query"))
    assert joins(X.search_listings(queries, listings))["BroadcastHash"] <= 1
    assert joins(substring_pairs(queries.toDF("needle"), listings, ["competitor_id", "url"], text="title"))["BroadcastHash"] <= 1
    pairs = products.select("id_product", F.lit(1).alias("competitor_id"), F.lit("u").alias("url"))
    assert joins(X.attach_facts(pairs, products, listings))["BroadcastHash"] == 0
    assert joins(X.merge_selections(pairs.withColumns({"rank": F.lit(1), "score": F.lit(9)}), pairs.withColumns({"best_index": F.lit(0), "confidence": F.lit(9)})))["BroadcastHash"] == 0


def variants(token, rules):
    for a, b in rules:
        token = token.replace(a, b)
    return token


def py_tokens(norm, rules):
    norm = re.sub(r"\b(left\s+handed|left\s+hand|gaucher|gauche|lh)\b", "lh", norm)
    norm = re.sub(r"\b(right\s+handed|right\s+hand|droitier|droite|rh)\b", " ", norm)
    out = []
    for w in norm.split():
        if w in T.STOPWORDS or (len(w) == 1 and w not in T.SINGLE_LETTERS):
            continue
        whole = variants(w, rules)
        parts = {variants(p, rules) for p in re.findall(r"\d+|\D+", whole)}
        out += sorted({whole} | parts)
    return out


def py_year(norm):
    full = re.search(r"\b(19\d{2}|20\d{2})\b", norm)
    if full:
        return int(full.group(1))
    short = re.search(r"(?<!\d)([5-9]\d)(?!\d)", norm.replace(" ", ""))
    return 1900 + int(short.group(1)) if short and py_guitar(norm) else None


def py_guitar(norm):
    return any(m in norm for m in T.GUITAR_MARKERS) or bool(re.search(r"\b(" + "|".join(T.GUITAR_BRANDS) + r")\b", norm))


def py_year_points(name, title, brand, maker):
    a, b = py_year(name), py_year(title)
    if a is None or b is None or a == b or not py_guitar(f"{name} {title}"):
        return 0
    return -40 if "gibson" in brand or "gibson" in maker else -25


def py_gap(row):
    return abs(float(row["c_price"]) - float(row["source_price"])) / float(row["source_price"])


def banded(gap, steps):
    return next((points for low, points in steps if gap >= low), 0)


def clamp(x):
    return max(0, min(100, round(x)))


def py_token_score(row):
    rules = T.VARIANTS["tokens"]
    name, title, brand, maker = (normal(row[c]) for c in ("name", "c_title", "brand", "c_brand"))
    q, t, m = (py_tokens(x, rules) for x in (name, title, maker))
    if not q or not t:
        return 0
    common = [w for w in q if w in set(t)]
    strong = [w for w in common if w not in X.GENERIC_TOKENS and len(w) > 3 and not w.isdigit()]
    ratio = difflib.SequenceMatcher(None, " ".join(q), " ".join(t)).ratio()
    score = len(common) / len(q) * 45 + len(common) / len(t) * 10 + ratio * 10
    score += min(30, len(strong) * 10) if strong else -18 if common else -25
    score -= 35 if set(t) & set(X.TITLE_ACCESSORIES) else 0
    if m and brand.split():
        score += 20 if set(m) & set(brand.split()) else -20
    score += 20 if name and name in title else 0
    if not strong and ratio < 0.55:
        score = min(score, 55)
    elif strong and ratio < 0.45:
        score -= 10
    left = ("lh" in q) + ("lh" in t)
    score += (0, -15, 12)[left]
    score += banded(py_gap(row), ((0.50, -40), (0.35, -30), (0.20, -15)))
    return clamp(score + py_year_points(name, title, brand, maker))


def py_signature(norm, brand):
    words = [w for w in norm.split() if w not in brand.split() and w not in T.STOPWORDS]
    return "".join(variants(w, T.VARIANTS["signature"]) for w in words)


def py_signature_score(row):
    name, title, brand, maker = (normal(row[c]) for c in ("name", "c_title", "brand", "c_brand"))
    q, t = py_signature(name, brand), py_signature(title, maker or brand)
    score = 0
    if brand and maker:
        score += 20 if brand in maker or maker in brand else -10
    if q and t:
        ratio = difflib.SequenceMatcher(None, q, t).ratio()
        score += 55 if q == t else round(ratio * 35) - (10 if ratio < 0.45 else 0)
    elif q or t:
        score -= 8
    score += (10 if name and name in title else 0) + (5 if brand and brand in title else 0)
    score -= 35 if set(title.split()) & set(X.TITLE_ACCESSORIES) else 0
    gap = py_gap(row)
    score += 10 if gap <= 0.05 else 5 if gap <= 0.15 else banded(gap, ((0.50, -35), (0.35, -25), (0.20, -15)))
    return clamp(score + py_year_points(name, title, brand, maker))


def _scored(spark, sf, kind):
    pairs = fx.model_names(spark, sf).withColumns({"matched_query": F.col("name"), **{c: F.lit("") for c in ("supplier_reference", "c_reference", "ean", "c_ean")}})
    return X.score_candidates(pairs, kind).collect()


def test_token_scores_equal_restatement(spark, sf):
    rows = _scored(spark, sf, "tokens")
    assert len(rows) > 50 and len({r["score"] for r in rows}) > 10
    assert [r["score"] for r in rows] == [py_token_score(r) for r in rows]


def test_signature_scores_equal_restatement(spark, sf):
    rows = _scored(spark, sf, "signature")
    assert len({r["score"] for r in rows}) > 10
    assert [r["score"] for r in rows] == [py_signature_score(r) for r in rows]


def test_selection_and_price_caps(spark):
    ranked = spark.createDataFrame(
        [(1, 4, "a", 99, 1, 0, "q", "t", 100.0), (1, 4, "b", 80, 2, 0, "q", "t", 100.0), (2, 4, "c", 96, 1, 0, "q", "t", 70.0), (3, 1, "d", 90, 1, 0, "q", "t", 75.0), (4, 1, "e", 29, 1, 0, "q", "t", 100.0)],
        "id_product long, competitor_id int, url string, score int, rank int, position int, matched_query string, c_title string, c_price double",
    )
    products = spark.createDataFrame([(i, 100.0) for i in range(1, 5)], "id_product long, source_price double")
    comp = fx.competitors(spark)
    plain = {r["id_product"]: (r["result"], r["score"]) for r in X.decide_matches(products, ranked, comp).collect()}
    assert plain == {1: ("matched", 99), 2: ("matched", 96), 3: ("pending", 90), 4: ("not_found", None)}
    verdicts = spark.createDataFrame([(1, 4, 7, 120), (2, 4, -3, 97)], "id_product long, competitor_id int, best_index int, confidence int")
    got = {r["id_product"]: (r["result"], r["url"], r["score"]) for r in X.decide_matches(products, ranked, comp, verdicts).collect()}
    assert got == {1: ("matched", "b", 100), 2: ("pending", "c", 60), 3: ("pending", "d", 85), 4: ("not_found", None, None)}


def test_category_paths_handle_cycles_gaps_and_blanks(spark):
    cats = spark.createDataFrame(
        [(1, 0, "Root"), (2, 1, " A "), (3, 2, ""), (4, 3, "Leaf"), (5, 6, "X"), (6, 5, "Y"), (7, 99, "Lost"), (8, 8, "Self"), (9, 0, " ")],
        "id_category long, id_parent long, name string",
    )
    got = {r["id_category"]: r["category_path"] for r in W.category_paths(cats).collect()}
    assert got == {
        1: "Root", 2: "Root > A", 3: "Root > A", 4: "Root > A > Leaf", 5: "Y > X", 6: "X > Y", 7: "Lost", 8: "Self", 9: None,
    }


PAGES = [
    # profile, url, html, price
    ("stock", "u", '<script type="application/ld+json">broken{</script><script type=\'application/ld+json\'>[{"@type":"x"},{"offers":{"priceSpecification":{"price":"1.299,00"}}}]</script>', 1299.0),
    ("stock", "u", '<div class="a product-final-price b"><span>1 234,50 €</span></div>', 1234.5),
    ("tokens", "u", '<div class="price-old">1 €</div><meta content="49.90" itemprop="price"/>', 49.9),
    ("tokens", "u", "<DIV CLASS='price'>12,00&nbsp;€</DIV>", 12.0),
    ("signature", "https://x.com/list", '<span class="price">5 €</span>', None),
    ("signature", "https://x.com/P12/a", '<span class="price">5 €</span>', 5.0),
    ("signature", "https://x.com/a", '<link href="https://x.com/p9/z" rel="canonical"><span class="price">6 €</span>', 6.0),
    ("signature", "https://x.com/a", '<title>Catalogue France</title><meta itemprop="price" content="3"><span class="price">6 €</span>', None),
    ("index", "u", '<script>{"salePrice": "19,90"}</script>', 19.9),
    (None, "u", "<p>à partir de 1.770 € TTC</p>", 1770.0),
    (None, "u", "<p>rien</p>", None),
]


def test_page_prices(spark):
    rows = spark.createDataFrame([(i, u, h, p) for i, (p, u, h, _) in enumerate(PAGES)], "page_id int, url string, html string, profile string")
    got = {r["page_id"]: r["price"] for r in P.extract_page_prices(rows).collect()}
    assert [got[i] for i in range(len(PAGES))] == [p[3] for p in PAGES]


def test_page_texts(spark):
    html = (
        '<html><head><title>Doc</title><meta name="title" content=" "></head><body>'
        '<ol class="nav breadcrumb"><li><a href="/">Accueil</a></li><li>›</li><li>Guitares &amp; Co</li><li>x</li></ol>'
        '<script type="application/ld+json">{"name":" LD name ","mpn":"AB-1","gtin":"4006381333931"}</script>'
        '<h1 class="t">Big <b>head</b></h1><a class="k" href=\'s/p.html\'><img src="i.png"> Go </a><a href="/e"></a></body></html>'
    )
    page = spark.createDataFrame([(1, "https://x.com/a/b", html)], "page_id int, url string, html string")
    assert P.extract_titles(page).first()["page_title"] == "LD name"
    assert P.extract_breadcrumb(page).first()["breadcrumb"] == "Accueil > Guitares & Co"
    links = [(r["text"], r["target"]) for r in P.extract_links(page).orderBy("position").collect()]
    assert links == [("Accueil", "https://x.com/"), ("Go", "https://x.com/a/s/p.html")]
    assert P.extract_image(page).first()["image_url"] == "https://x.com/a/i.png"
    refs = P.extract_references(page).first()
    assert (refs["page_reference"], refs["page_ean"]) == ("ab 1", "4006381333931")


def test_hash_distance(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0, 1.0, 0.0]), (2, [1.0, 0.0, 1.0, 0.0])], "id int, v array<float>")
    hashes = rows.select("id", X.average_hash("v").alias("hash"))
    assert [r["hash"] for r in hashes.orderBy("id").collect()] == [6, 5]
    pairs = spark.createDataFrame([(1, 2)], "id_a int, id_b int")
    assert X.hamming_pairs(pairs, hashes, hashes).first()["distance"] == 2


def test_page_prices_follow_the_site_rules(spark):
    rows = [
        (1, "https://x.com/a", "stock", '<div class="product-final-price"><div>Prix</div><div>12,50 €</div></div>', 12.5),
        (2, "https://x.com/a", "tokens", '<span class="price">9,00 €</span><div class="price">11,00 €</div>', 11.0),
        (3, "https://x.com/a", "tokens", '<div class="price">-</div><span class="fx-typography-price-primary">13 €</span>', 13.0),
        (4, "https://x.com/a", "index", '<meta itemprop="price" content="1"><meta property="og:price:amount" content="2">', 2.0),
        (5, "https://x.com/a", "other", '<meta itemprop="price" content="1"><meta property="og:price:amount" content="2">', 1.0),
        (6, "https://x.com/a", "signature", '<title> Epiphone </title><meta itemprop="price" content="5"><b class="price">5 €</b>', None),
        (7, "https://x.com/p1/a", "signature", '<title>Epiphone</title><b class="price">6 €</b><span class="price">5 €</span>', 5.0),
        (8, "https://x.com/a", "stock", '<div class="product-final-price"><div>7 €</div>', 7.0),
        (9, "https://x.com/a", "stock", '<div class="product-final-price">' + "<div>" * 3 + "x" * 50_000 + "</div>" * 3 + "8 €</div>", 8.0),
    ]
    pages = spark.createDataFrame([r[:4] for r in rows], "page_id long, url string, profile string, html string")
    got = {r["page_id"]: r["price"] for r in P.extract_page_prices(pages).collect()}
    assert got == {r[0]: r[4] for r in rows}


def test_best_candidates_look_at_every_listing(spark):
    """The only listing with the right reference has the longest of 50 titles; brute force over all pairs agrees."""
    products = spark.createDataFrame(
        [(1, "AB-77", "", "Acme", "Solid tone box", 10.0), (2, "", "", "Acme", "Solid tone box", 11.0), (3, "--", "4006381333931", "Acme", "Solid tone box", 12.0)],
        "id_product long, supplier_reference string, ean string, brand string, name string, source_price double",
    )
    rows = [(1, f"u{i:02d}", f"acme solid tone box {'x' * i}", "", "", "Acme", "", 9.0) for i in range(49)]
    rows.append((1, "u99", "acme solid tone box " + "y" * 60 + " zab 77b", "", "", "Acme", "", 9.0))
    rows.append((1, "v1", "something else", "", "4006381333931", "Acme", "", 9.0))
    rows.append((2, "w1", "tone box solid 4006381333931", "AB-77", "", "", "", 9.0))
    listings = spark.createDataFrame(
        rows, "competitor_id int, url string, title string, reference string, ean string, brand string, breadcrumb string, price double"
    )
    got = {}
    for r in X.best_candidates(products, listings, "base", 5).collect():
        got.setdefault((r["id_product"], r["competitor_id"]), []).append((r["rank"], r["url"], r["score"]))
    queries = X.expand_queries(products)
    pairs = queries.join(X.search_listings(queries, listings), "query").groupBy("id_product", "competitor_id", "url").agg(
        F.min(F.struct("position", "query")).alias("f")
    )
    pairs = pairs.select("id_product", "competitor_id", "url", "f.position", F.col("f.query").alias("matched_query"))
    brute = X.rank_candidates(X.score_candidates(X.attach_facts(pairs, products, listings), "base"), 5)
    want = {}
    for r in brute.collect():
        want.setdefault((r["id_product"], r["competitor_id"]), []).append((r["rank"], r["url"], r["score"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(got[1, 1])[0][1] == "u99"


@pytest.mark.parametrize("limit,crowded,block", [(0, 2000, 1000), (3, 2000, 1000), (5, 8, 5), (9, 20, 1000)])
def test_near_hashes_equal_all_pairs(spark, limit, crowded, block):
    """Clusters around a few hashes, one hash many times, and hashes that share most of their bits."""
    rng = random.Random(limit)
    rows = []
    for centre in [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]:
        for _ in range(25):
            flips = sum(1 << b for b in rng.sample(range(64), rng.randrange(12)))
            rows.append(centre ^ flips)
    rows += [rows[3]] * 40 + [rng.getrandbits(12) for _ in range(60)] + [rng.getrandbits(64) for _ in range(50)]
    signed = [h - (1 << 64) if h >> 63 else h for h in rows]
    hashes = spark.createDataFrame([(i, h) for i, h in enumerate([*signed, None])], "id long, hash long")
    counts = Counter(signed)
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    want = {(a, b, counts[a], counts[b], bits(a, b)) for a in counts for b in counts if a < b and bits(a, b) <= limit}
    want |= {(a, a, n, n, 0) for a, n in counts.items() if n > 1}
    got = [tuple(r) for r in near_hashes(hashes, limit, crowded=crowded, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("block_rows", [3, 50_000])
def test_substring_pairs_equal_contains(spark, block_rows):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab 1") for _ in range(rng.randrange(30)))) for i in range(80)] + [(80, None), (3, "abab"), (81, "é1 ab")]
    needles = ["a", "b1", "ab ", "1 ab", "é", "zz", "abab", "a" * 9, "", *{t[:n] for _, t in texts[:30] for n in (5, 9, 17)}]
    table = spark.createDataFrame(texts, "key long, text string")
    wanted = spark.createDataFrame([(n,) for n in [*needles, "ab "]], "needle string")
    got = Counter((r["needle"], r["key"]) for r in substring_pairs(wanted, table, ["key"], block_rows=block_rows).collect())
    assert got == Counter((n, k) for n in set(needles) - {""} for k, t in texts if t and n in t)


@pytest.mark.parametrize("kind", ["tokens", "signature"])
def test_priced_ranking_equals_all_pairs(spark, kind):
    """Many products and listings of one text at all prices: the best k of every pair scored on its own."""
    rng = random.Random(3)
    prices = [round(rng.choice([10, 100, 1000]) * rng.uniform(0.4, 2.2), 2) for _ in range(60)] + [None, 0.0, -3.0, 100.0, 100.0]
    products = [(i, f"t{i % 2}", p) for i, p in enumerate(prices)] + [(900, "t9", 5.0)]
    rows = []
    for i in range(400):
        price = rng.choice([*prices, round(100 * rng.uniform(0.4, 2.2), 2)])
        similarity = float(rng.choice([-20, 0, 12.5, 40, 70.25, 95, 110]))
        rows.append((f"t{i % 2}", i % 3, f"u{i}", rng.randrange(3), f"q{i}", similarity, rng.choice([0, 0, -25]), price))
    texts = spark.createDataFrame(
        rows, "text_id string, competitor_id int, url string, position int, matched_query string, similarity double, year_points int, c_price double"
    )
    mine = spark.createDataFrame(products, "id_product long, text_id string, source_price double")
    steps, k = X.PRICE_STEPS[kind], X.TOP[kind]
    got = {tuple(r) for r in best_priced(texts, mine, *steps, k).collect()}

    def points(c, x):
        if not (c and x and c > 0 and x > 0):
            return 0
        gap = abs(c - x) / x
        return next((p for g, p in steps[1] if gap <= g), None) or next((p for g, p in steps[0] if gap >= g), 0)

    want = set()
    for i, text, x in products:
        for site in range(3):
            scored = [
                (-clamp(s + points(c, x) + y), pos, url, q) for t, m, url, pos, q, s, y, c in rows if t == text and m == site
            ]
            want |= {(i, site, url, pos, q, -score) for score, pos, url, q in sorted(scored)[:k]}
    assert got == want


def test_indexed_search_equals_the_scan(spark, sf, tmp_path):
    feed, index = fx.feed(spark, sf), str(tmp_path / "index")
    W.write_search_index(feed, index)
    for needle in ("ring", "brand#1 ", "d#2", "17", "a", "%", "b_a", "x-occas-1%5", "no such", "0000000000012", "", "\\"):
        scan = W.search_products(feed, needle, 50).collect()
        assert W.search_products(feed, needle, 50, index).collect() == scan


def test_priced_ranking_opens_few_bands(spark, monkeypatch):
    """What is looked at grows with products times bands, also where all candidates score alike: neither with the
    product of a text's products and listings nor with products that share a price."""

    def asked(prices, copies, n):
        rows = [("t", 1, f"u{i:05d}", 0, "q", 50.0, 0, 100 + i * 100 / n) for i in range(n)]
        texts = spark.createDataFrame(
            rows, "text_id string, competitor_id int, url string, position int, matched_query string, similarity double, year_points int, c_price double"
        )
        mine = spark.range(prices * copies).selectExpr("id AS id_product", "'t' AS text_id", f"100 + id % {prices} * 100D / {prices} AS source_price")
        counts = Counter()

        def counted(spark, df, label, write=price_bands.written):
            out = write(spark, df, label)
            counts[label] += out.count()
            return out

        monkeypatch.setattr(price_bands, "written", counted)
        found = price_bands.best_priced(texts, mine, *X.PRICE_STEPS["signature"], 3).count()
        monkeypatch.undo()
        assert found == prices * copies * 3
        return counts["price-asked"]

    first = asked(50, 1, 800)
    assert 0 < first == asked(50, 3, 800)
    assert asked(50, 1, 3200) < 1.5 * first


def test_texts_are_cut_into_tokens_once_per_product_and_listing(spark):
    products = spark.createDataFrame([(1, "A-1", "", "b", "n", 1.0)], "id_product long, supplier_reference string, ean string, brand string, name string, source_price double")
    listings = spark.createDataFrame(
        [(1, "u", "b n A-1", "", "", "b", "", 1.0)],
        "competitor_id int, url string, title string, reference string, ean string, brand string, breadcrumb string, price double",
    )
    pairs = products.select("id_product", F.lit(1).alias("competitor_id"), F.lit("u").alias("url"), F.lit("n").alias("matched_query"))
    for kind, marks in (("tokens", ("gaucher", "19\\d{2}")), ("signature", ("mkiii", "19\\d{2}"))):
        rows = X.similar_candidates(X.attach_facts(pairs, products, listings, kind), kind, F.lit(0.5))
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "gaucher" not in plan.split("Join")[0] and "19\\d{2}" not in plan.split("Join")[0]
        assert all(mark in plan for mark in marks)


def test_one_product_with_many_own_listings_lengthens_no_others_list(spark, monkeypatch):
    """The first product's reference is in most titles; the others of its text need the text's best ones alone."""

    def further(n):
        products = [(i, "A-1" if i == 0 else f"B{i}x", "", "b", "ring", 1.0) for i in range(n)]
        listings = [(1, f"u{i:04d}", f"b ring A-1{i:03d}", "", "", "b", "", 1.0) for i in range(n)]
        mine = spark.createDataFrame(products, "id_product long, supplier_reference string, ean string, brand string, name string, source_price double")
        theirs = spark.createDataFrame(
            listings, "competitor_id int, url string, title string, reference string, ean string, brand string, breadcrumb string, price double"
        )
        counts = Counter()

        def counted(spark, df, label, write=X.written):
            out = write(spark, df, label)
            counts[label] += out.count()
            return out

        monkeypatch.setattr(X, "written", counted)
        found = {(r["id_product"], r["url"], r["rank"]) for r in X.best_candidates(mine, theirs).collect()}
        monkeypatch.undo()
        assert found == {(p, f"u{i:04d}", i + 1) for p in range(n) for i in range(5)}
        return counts["match-further"]

    assert 0 < further(60) <= 55


def test_costly_scores_are_dealt_over_the_cores(spark, sf):
    """A catalogue of a few MB comes in one file and task, whose rows are scored one after the other."""
    runs = load_registry()[0]
    for name in ("m7_token_points", "m7_token_scores", "m8_signature_points", "m9_meaningful_tokens"):
        plan = runs[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert re.search(r"Exchange hashpartitioning\(id_product#\d+L?, ", plan), name


def test_index_stores_a_part_once_per_block(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"name {i % 3}") for i in range(300)] + [(None, "name 1")], "k long, v string")
    write_index(rows, "k", ["v"], str(tmp_path / "i"), block_rows=100)
    stored = spark.read.parquet(str(tmp_path / "i"))
    parts = {t[i : i + n] for t in ("name 0", "name 1", "name 2") for n in (1, 2, 4) for i in range(len(t) - n + 1)}
    assert stored.count() <= 4 * len(parts) and {r["part"] for r in stored.collect()} == parts
    assert sorted(r["key"] for r in rows_with_part(spark, str(tmp_path / "i"), "name").collect()) == list(range(300))
    assert sorted(r["key"] for r in rows_with_part(spark, str(tmp_path / "i"), "e 2").collect()) == []
    assert sorted(r["key"] for r in rows_with_part(spark, str(tmp_path / "i"), "2").collect()) == list(range(2, 300, 3))
