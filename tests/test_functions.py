"""Hand-computed cases of the column functions."""

from __future__ import annotations

import datetime as dt
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from retailweave.functions import calendar as cal
from retailweave.functions import labels as L
from retailweave.functions import measures as M
from retailweave.functions import text as T
from retailweave.functions.prices import coerce_price, parse_price
from retailweave.functions.urls import absolute_url, canonical_url
from retailweave.operators.boards import bucket_key, tone
from retailweave.operators.filters import Filters


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


DAY = dt.date


@pytest.mark.parametrize(
    "day, months, expected",
    [
        (DAY(2001, 3, 31), -1, DAY(2001, 3, 3)),
        (DAY(2000, 2, 29), -12, DAY(1999, 3, 1)),
        (DAY(2000, 3, 31), -6, DAY(1999, 10, 1)),
        (DAY(2001, 8, 1), -3, DAY(2001, 5, 1)),
        (DAY(2001, 1, 15), -1, DAY(2000, 12, 15)),
    ],
)
def test_month_shift_overflows(spark, day, months, expected):
    assert cal.shift_date(day, months) == expected
    assert column(spark, [day], cal.shift_months("v", months), "date") == [expected]


def test_rolling_period():
    (start, end), (prev_start, prev_end) = cal.rolling_period(DAY(2001, 8, 1), 12)
    assert (start, end) == (DAY(2000, 8, 2), DAY(2001, 8, 1))
    assert (prev_start, prev_end) == (DAY(1999, 8, 2), DAY(2000, 8, 1))


def test_periods_merge_into_few_ranges(spark):
    periods = {"a": (DAY(2001, 1, 1), DAY(2001, 1, 10)), "b": (DAY(2001, 1, 11), DAY(2001, 2, 1)), "c": (DAY(2001, 3, 1), DAY(2001, 3, 2))}
    days = [DAY(2000, 12, 31), DAY(2001, 1, 1), DAY(2001, 2, 1), DAY(2001, 2, 2), DAY(2001, 3, 2), DAY(2001, 3, 3)]
    assert column(spark, days, cal.in_any("v", periods), "date") == [False, True, True, False, True, False]


def test_filters_are_sanitised():
    f = Filters.from_raw({"start": "2001-08-05", "end": "2001-07-01", "occasion": "no", "brand_id": "0"}, DAY(2001, 9, 9))
    assert (f.start, f.end, f.occasion, f.brand_id) == (DAY(2001, 7, 1), DAY(2001, 8, 5), None, 0)
    f = Filters.from_raw({"start": "2001-02-31", "brand_id": "", "q": "  "}, DAY(2001, 9, 9))
    assert (f.start, f.end, f.brand_id, f.q) == (DAY(2001, 9, 1), DAY(2001, 9, 9), None, None)


def test_category_and_brand_labels(spark):
    rows = spark.createDataFrame(
        [("R", "F", "S"), ("", None, ""), (None, "F", None)], "rayon_name string, family_name string, subfamily_name string"
    )
    assert [r[0] for r in rows.select(L.category_path()).collect()] == ["R > F > S", "Sans rayon > Sans famille", "Sans rayon > F"]
    rows = spark.createDataFrame([(None, ""), (7, None), (7, "X"), (0, "Y")], "brand_id int, brand_name string")
    assert [r[0] for r in rows.select(L.brand_label()).collect()] == ["Sans marque", "IDFAB 7", "X", "Y"]


def test_second_hand_markers_differ_between_fact_and_feed(spark):
    codes = ["B-1", "XB-1", "depv1", "xdepv1", "x-OCCAS", "A-1", None, " "]
    got = column(spark, codes, L.is_occasion(F.col("v"), F.lit("")))
    assert got == [True, False, True, False, True, False, False, False]
    got = column(spark, codes, L.eligible_reference("v"))
    assert got == [False, False, False, False, False, True, False, False]


def test_exclusion_keeps_null_products(spark):
    rows = spark.createDataFrame([(None, None), (18823, ""), (1, "reprise-9"), (1, "x")], "product_id long, supplier_reference string")
    assert [r[0] for r in rows.select(L.not_excluded()).collect()] == [True, False, False, True]


def test_image_path_and_slug(spark):
    assert column(spark, ["1234", "7"], L.image_path("v")) == ["1/2/3/4", "7"]
    assert column(spark, [" Blue Notes! ", "!!", "A"], L.slug("v")) == ["blue-notes", "competitor", "a"]


def test_delta_guards_and_formats(spark):
    rows = spark.createDataFrame([(10.0, 0.0), (10.0, -5.0), (15.0, 10.0)], "c double, p double")
    assert [r[0] for r in rows.select(M.pct_change("c", "p")).collect()] == [None, None, 50.0]
    assert [r[0] for r in rows.select(M.pct_change("c", "p", "ne0")).collect()] == [None, -300.0, 50.0]
    assert column(spark, [1234.5, -0.4, 1e6], M.fmt_money("v"), "double") == ["1 235 €", "0 €", "1 000 000 €"]
    assert column(spark, [12.34, -0.04, None, 1234.56], M.fmt_pct("v"), "double") == ["+12,3 %", "0,0 %", "--", "+1 234,6 %"]
    assert column(spark, [1.0, -1.0, 0.0, None], M.delta_class("v"), "double") == ["delta-up", "delta-down", "delta-neutral", "delta-neutral"]


def test_bucket_borders(spark):
    deltas = [-1000.0, -30.0, -1.0, 1.0, 30.0, 1000.0, 1000.1, -1000.1, 0.99]
    assert column(spark, deltas, bucket_key("v"), "double") == ["lt-30", "m30-m20", "eq", "p1-p5", "gt-30", "gt-30", None, None, "eq"]
    assert column(spark, [-1.0, 1.0, 1.1, -1.1], tone(F.col("v")), "double") == ["same", "same", "pricier", "cheaper"]


PRICES = {
    "1.770 €": 1770.0,
    "1,770": 1770.0,
    "1.299,00": 1299.0,
    "1,299.00 EUR": 1299.0,
    "12,5": 12.5,
    "1 234 567,89 €": 1234567.89,
    "1.234.567": 1234567.0,
    "1,234,567": 1234567.0,
    "Prix: 49.90 TTC": 49.9,
    "0.500": 500.0,
    "free": None,
    "": None,
    "12.": 12.0,
}


def test_price_text(spark):
    assert column(spark, list(PRICES), parse_price("v")) == list(PRICES.values())
    assert column(spark, ["1 299,00", "12", "0", "12a", None, "1.234,5"], coerce_price("v")) == [1299.0, 12.0, None, None, None, 1234.5]


def test_rendered_prices_read_back(spark):
    rng = random.Random(5)
    cents = [rng.randrange(1, 10**8) for _ in range(300)]
    forms = [lambda e, c: f"{e:,}".replace(",", ".") + f",{c:02d} €", lambda e, c: f"{e:,}.{c:02d}", lambda e, c: f"{e},{c:02d}"]
    texts = [forms[i % 3](v // 100, v % 100) for i, v in enumerate(cents)]
    assert column(spark, texts, parse_price("v")) == [v / 100 for v in cents]


def normal(value):
    value = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode("ascii").lower()
    return re.sub(r"[^a-z0-9]+", " ", value).strip()


def test_normalisation_matches_unicode_decomposition(spark):
    words = ["Crème Brûlée", "Ångström½", "naïve—œuvre", "Ⅷ ﬁn", "ＡＢ１", "été", "ß ø ł", "a b", "²³", "…x", "Ǆ", "", "Mk Ⅱ", "Mk Ⅲ", "№ ⅓", "① ㎜", "𝐀𝟗 🄰", "ﷺ ㏂"]
    assert column(spark, words, T.normalize_exact("v")) == [normal(w) for w in words]
    assert column(spark, words, T.normalize_text("v")) == [normal(w) for w in words]


def test_native_folding_covers_every_character(spark):
    chars = [f"a{chr(c)}b" for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    chars = [c for c in chars if unicodedata.category(c[1]) not in ("Cn", "Co")]
    texts = ["".join(chars[i : i + 50]) for i in range(0, len(chars), 50)]
    assert column(spark, texts, T.normalize_text("v")) == [normal(t) for t in texts]


def test_core_name_ean_and_year(spark):
    assert column(spark, ["A - B-C", "A–B", "plain", "A -  ", None], T.core_name("v")) == ["B-C", "B", "plain", "A -", ""]
    assert column(spark, ["0000000000000", "12345678", "EAN 4006381333931", "123"], T.valid_ean("v")) == ["", "12345678", "4006381333931", ""]
    names = ["les paul 59", "cable 59", "strat 1962", "strat 159", "x 2019"]
    assert column(spark, names, T.year_hint("v")) == [1959, None, 1962, None, 2019]


def test_urls(spark):
    urls = ["HTTPS://Shop.Example.com/A/b/?Q=1#f", "http://x.com", "http://x.com/?", "http://x.com/a//"]
    assert column(spark, urls, canonical_url("v")) == ["https://shop.example.com/A/b?Q=1", "http://x.com/", "http://x.com/", "http://x.com/a"]
    links = ["http://y.com/z", "//c.com/i.jpg", "/r", "s/t.html", "#top", "?p=2", ""]
    got = column(spark, links, absolute_url(F.lit("https://x.com/a/b.html?q=1#f"), "v"))
    assert got == [
        "http://y.com/z", "https://c.com/i.jpg", "https://x.com/r", "https://x.com/a/s/t.html",
        "https://x.com/a/b.html?q=1#top", "https://x.com/a/b.html?p=2", "https://x.com/a/b.html?q=1#f",
    ]
    assert column(spark, ["a.html"], absolute_url(F.lit("https://x.com"), "v")) == ["https://x.com/a.html"]


def test_collated_columns_group_and_match_without_case_and_accents(spark):
    df = spark.createDataFrame([("École", 1), ("ecole", 2), ("WEB", 3)], "channel string, n int")
    loose = T.collated(df, ["channel"])
    assert sorted(r["s"] for r in loose.groupBy("channel").agg(F.sum("n").alias("s")).collect()) == [3, 3]
    assert loose.where(F.col("channel") == "ÉCOLE").count() == 2 and df.where(F.col("channel") == "ÉCOLE").count() == 0


def test_only_runs_beyond_ascii_are_folded(spark):
    long = "plain words of a text " * 200 + "Brûlée\x01№ ½"
    assert column(spark, [long, "é", "éa", "aé", "日本", ""], T.normalize_text("v")) == [normal(long), "e", "ea", "ae", "", ""]
    plan = spark.createDataFrame([("a",)], "v string").select(T.fold_accents("v"))._jdf.queryExecution().analyzed().toString()
    assert "translate(array_join(regexp_extract_all(v" in plan and "translate(v" not in plan
