"""Queries of the competitor domain: work lists, boards, reports and change sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import labels as L
from ..functions import measures as M
from ..operators import boards as B
from ..operators import feed as W
from ..operators import reviews as R
from ..operators.aggregates import as_report
from ..session import work_path
from .competitor_sql import CATEGORIES, IMAGES, INCOMING, REFERENCE, SNAPSHOT, URL, URL_EVENTS, with_ci
from .registry import query

AS_OF = dt.datetime(2001, 6, 15, 12, 0)
BASE_URL = "https://shop.example.com"
TRUSTED, TARGETS = (1, 2), (3, 4)
SELLERS = [(c[0], c[1]) for c in fx.COMPETITORS]


def _day(df, *stamps):
    return df.withColumns({c: F.to_date(c) for c in stamps})


# --- work lists ---------------------------------------------------------------------------------------

_NEW = """SELECT {cols} FROM eligible f WHERE f.id_product > {after}
  AND NOT EXISTS (SELECT 1 FROM finals x WHERE x.id_product = f.id_product AND x.competitor_id = {c})
  AND NOT EXISTS (SELECT 1 FROM tests t WHERE t.id_product = f.id_product AND t.competitor_id = {c})"""


@query(
    "j3_new_products",
    with_ci(_NEW.format(cols=SNAPSHOT, after=10, c=2) + " ORDER BY f.id_product LIMIT 200"),
)
def _(spark, sf):
    return W.new_products(fx.feed(spark, sf), fx.finals(spark, sf), fx.tests(spark, sf), 2, after_id=10, limit=500)


_RETRY = """FROM tests t JOIN eligible f USING (id_product) WHERE t.competitor_id = {c} AND t.result = 'not_found'
  AND t.validation_status <> 'rejected' AND NOT EXISTS (SELECT 1 FROM finals x WHERE x.id_product = t.id_product
  AND x.competitor_id = t.competitor_id)"""


@query(
    "j4_retry_products",
    with_ci(f"""SELECT {SNAPSHOT}, CAST(last_tested_at AS DATE) AS last_tested_at {_RETRY.format(c=3)}
      ORDER BY t.last_tested_at, f.id_product LIMIT 50"""),
)
def _(spark, sf):
    return _day(W.retry_products(fx.feed(spark, sf), fx.finals(spark, sf), fx.tests(spark, sf), 3), "last_tested_at")


@query(
    "j5_pending_work",
    with_ci(f"""SELECT id AS competitor_id,
      EXISTS ({_NEW.format(cols='1', after='-1', c='comp.id')}) AS has_new,
      EXISTS (SELECT 1 {_RETRY.format(c='comp.id')}) AS has_retry,
      EXISTS (SELECT 1 FROM finals x WHERE x.competitor_id = comp.id) AS has_finals FROM comp"""),
)
def _(spark, sf):
    return W.pending_work(fx.feed(spark, sf), fx.finals(spark, sf), fx.tests(spark, sf), fx.competitors(spark))


@query(
    "j6_price_worklist",
    with_ci("""SELECT f.id_product, f.competitor_id, c.name AS competitor_name, c.domain AS competitor_domain, f.url,
      CAST(f.competitor_price AS DOUBLE) AS source_price, CAST(h.last AS DATE) AS last_scraped_at
      FROM finals f JOIN comp c ON c.id = f.competitor_id
      LEFT JOIN (SELECT competitor_id, id_product, url, max(observed_at) AS last FROM history
        GROUP BY ALL) h ON h.competitor_id = f.competitor_id AND h.id_product = f.id_product AND h.url = f.url
      WHERE f.competitor_id = 4 ORDER BY (f.id_product <= 700), (h.last IS NOT NULL), h.last, f.id_product LIMIT 200"""),
)
def _(spark, sf):
    out = W.price_worklist(
        fx.finals(spark, sf), fx.competitors(spark), fx.price_history(spark, sf), 4, after_id=700, limit=200
    )
    return _day(out, "last_scraped_at")


_PENDING = """FROM tests t WHERE t.validation_status = 'pending' {page} AND NOT EXISTS (SELECT 1 FROM finals f
  WHERE f.id_product = t.id_product AND f.competitor_id = t.competitor_id)"""
_LIVE = _PENDING.format(page="AND t.competitor_page_status = 'ok'")


@query(
    "j7_pending_reviews",
    with_ci(f"""SELECT id_product, competitor_id, url, score, CAST(last_tested_at AS DATE) AS last_tested_at {_LIVE}
      ORDER BY score DESC, t.last_tested_at DESC, id_product, competitor_id LIMIT 50 OFFSET 50"""),
)
def _(spark, sf):
    out = R.pending_reviews(fx.tests(spark, sf), fx.finals(spark, sf), page=2)
    return _day(out.select("id_product", "competitor_id", "url", "score", "last_tested_at"), "last_tested_at")


def _snapshots(spark, sf):
    images = fx.images(spark, sf)
    return W.product_snapshots(
        fx.feed(spark, sf),
        fx.products(spark, sf),
        W.category_paths(fx.categories(spark, sf)),
        W.main_images(images, fx.image_shop(images)),
        BASE_URL,
    )


_PATH = "array_to_string(string_split(CAST(id_image AS VARCHAR), ''), '/')"
_SNAP_SQL = f"""SELECT {SNAPSHOT}, category_path, 'https://shop.example.com/img/p/' || {_PATH} || '/' ||
  CAST(id_image AS VARCHAR) || '-large_default.jpg' AS source_image_url FROM feed f
  LEFT JOIN cat_paths ON id_category = f.id_product LEFT JOIN main_image m ON m.id_product = f.id_product
  WHERE f.id_product > 0"""


@query("j8_product_snapshots", with_ci(_SNAP_SQL, CATEGORIES, IMAGES, recursive=True))
def _(spark, sf):
    return _snapshots(spark, sf)


@query(
    "j9_attach_test_snapshot",
    with_ci("""SELECT f.id_product, f.competitor_id, t.competitor_title, t.competitor_brand, t.competitor_breadcrumb,
      CAST(t.competitor_price AS DOUBLE) AS competitor_price, t.score, t.result
      FROM finals f LEFT JOIN tests t USING (id_product, competitor_id)"""),
)
def _(spark, sf):
    rows = fx.finals(spark, sf).select("id_product", "competitor_id")
    return as_report(R.attach_test_snapshot(rows, fx.tests(spark, sf)))


@query(
    "j10_finals_with_title",
    with_ci("""SELECT f.id_product, f.competitor_id, f.url, CAST(f.competitor_price AS DOUBLE) AS competitor_price,
      nullif(trim(t.competitor_title), '') AS competitor_title FROM finals f LEFT JOIN tests t USING (id_product, competitor_id)"""),
)
def _(spark, sf):
    return as_report(R.finals_with_title(fx.finals(spark, sf), fx.tests(spark, sf)))


for _status in ("rejected", "postponed"):

    @query(
        f"j11_{_status}_by_product",
        with_ci(f"""SELECT id_product, CAST(count(*) AS INTEGER) AS n,
          string_agg(name || ':' || CAST(score AS VARCHAR), '|' ORDER BY last_tested_at DESC, competitor_id DESC) AS listing
          FROM tests JOIN comp ON id = competitor_id WHERE validation_status = '{_status}' GROUP BY 1"""),
    )
    def _(spark, sf, status=_status):
        rows = R.reviews_by_product(fx.tests(spark, sf), fx.competitors(spark), status)
        entry = lambda r: F.concat(r["competitor"], F.lit(":"), r["score"].cast("string"))
        return rows.select(
            "id_product",
            F.size("reviews").alias("n"),
            F.array_join(F.transform("reviews", entry), "|").alias("listing"),
        )


_SEARCH_SQL = """hits AS (SELECT * FROM feed WHERE lower(trim(reference)) LIKE '%{q}%' OR ean13 LIKE '%{q}%'
    OR lower(trim(manufacturer_name)) LIKE '%{q}%' OR lower(trim(product_name)) LIKE '%{q}%'
  ORDER BY CASE WHEN lower(product_name) LIKE '%{q}%' THEN 0 ELSE 1 END, id_product DESC LIMIT {n})"""


@query("o7_product_search", with_ci(f"SELECT {SNAPSHOT} FROM hits f", _SEARCH_SQL.format(q="ring", n=50)))
def _(spark, sf):
    return W.search_products(fx.feed(spark, sf), " Ring ", 200)


@query("o7_indexed_search", with_ci(f"SELECT {SNAPSHOT} FROM hits f", _SEARCH_SQL.format(q="d#1", n=20)))
def _(spark, sf):
    feed, index = fx.feed(spark, sf), work_path(spark, "search-index")
    W.write_search_index(feed, index)
    return W.search_products(feed, "D#1", 20, index)


def _review_list(status: str) -> str:
    return f"""coalesce((SELECT string_agg(c.name || ':' || t.url || ':' || CAST(score AS VARCHAR), '|' ORDER BY last_tested_at DESC, competitor_id DESC)
      FROM tests t JOIN comp c ON c.id = t.competitor_id WHERE t.id_product = h.id_product AND validation_status = '{status}'), '')"""


@query(
    "j12_product_dossier",
    with_ci(
        f"""SELECT h.id_product, CAST(price AS DOUBLE) AS reference_price, category_path, 'https://shop.example.com/img/p/' || {_PATH} || '/' ||
      CAST(id_image AS VARCHAR) || '-large_default.jpg' AS source_image_url,
      coalesce((SELECT string_agg(CAST(x.competitor_id AS VARCHAR) || ':' || x.url || ':' || coalesce(t.competitor_title, ''), '|' ORDER BY x.competitor_id, x.url)
        FROM finals x LEFT JOIN tests t USING (id_product, competitor_id) WHERE x.id_product = h.id_product), '') AS finals,
      {_review_list('rejected')} AS rejected, {_review_list('postponed')} AS postponed
      FROM hits h LEFT JOIN ref_price r ON r.id_product = h.id_product LEFT JOIN cat_paths ON id_category = h.id_product
      LEFT JOIN main_image m ON m.id_product = h.id_product""",
        REFERENCE,
        _SEARCH_SQL.format(q="brand#1", n=20),
        CATEGORIES,
        IMAGES,
        recursive=True,
    ),
)
def _(spark, sf):
    out = R.product_dossier(
        W.search_products(fx.feed(spark, sf), "brand#1", 20),
        R.reference_prices(fx.reference_prices(spark, sf)),
        fx.finals(spark, sf),
        fx.tests(spark, sf),
        fx.competitors(spark),
        _snapshots(spark, sf),
    )

    def listed(name, *parts):
        entry = lambda r: F.concat_ws(":", *[F.coalesce(r[p].cast("string"), F.lit("")) for p in parts])
        return F.coalesce(F.array_join(F.transform(name, entry), "|"), F.lit("")).alias(name)

    return out.select(
        "id_product",
        F.col("reference_price").cast("double").alias("reference_price"),
        "category_path",
        "source_image_url",
        listed("finals", "competitor_id", "url", "competitor_title"),
        *[listed(c, "competitor", "url", "score") for c in ("rejected", "postponed")],
    )


_CANDS = f"""cand_events AS (SELECT event_id AS seq, user_id AS id_product, CAST(event_id % 4 + 1 AS INTEGER) AS competitor_id,
    {URL.format(c='(event_id % 4 + 1)', p='user_id')} || CAST(k % 3 AS VARCHAR) AS url, k AS score,
    CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'weird' ELSE 'pending' END AS status,
    event_type FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)),
  bad AS (SELECT DISTINCT competitor_id, url FROM cand_events WHERE event_type = 'error' AND score < 2)"""


def _candidate_events(spark, sf):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    kind = F.col("event_type")
    competitor = (F.col("event_id") % 4 + 1).cast("int")
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id_product"),
        competitor.alias("competitor_id"),
        F.concat(fx._page_url(competitor, F.col("user_id")), (k % 3).cast("string")).alias("url"),
        F.concat(F.lit("t"), k.cast("string")).alias("title"),
        k.alias("score"),
        F.when(kind == "purchase", "valid")
        .when(kind == "error", "rejected")
        .when(kind == "view", "weird")
        .otherwise("pending")
        .alias("status"),
        "event_type",
    )


def _bad_urls(events):
    return events.where("event_type = 'error' AND score < 2").select("competitor_id", "url").distinct()


@query(
    "j13_drop_rejected_urls",
    with_ci(
        """SELECT seq, id_product, competitor_id, url FROM cand_events c WHERE NOT EXISTS
      (SELECT 1 FROM bad b WHERE b.competitor_id = c.competitor_id AND b.url = c.url)""",
        _CANDS,
    ),
)
def _(spark, sf):
    events = _candidate_events(spark, sf)
    return R.drop_rejected(events, _bad_urls(events)).select("seq", "id_product", "competitor_id", "url")


@query(
    "j14_work_batch_envelope",
    with_ci(
        f"""SELECT 2 AS competitor_id, 'new_url' AS mode, 20 AS "limit", count(*) AS items,
        CAST(greatest(5, coalesce(max(id_product), 5)) AS BIGINT) AS after_id, count(*) = 20 AS has_more
        FROM ({_NEW.format(cols='f.id_product', after=5, c=2)} ORDER BY f.id_product LIMIT 20)
      UNION ALL SELECT 3, 'retry_url', 200, count(*), CAST(greatest(5, coalesce(max(id_product), 5)) AS BIGINT), count(*) = 200
        FROM (SELECT f.id_product {_RETRY.format(c=3)} ORDER BY t.last_tested_at, f.id_product LIMIT 200)"""
    ),
)
def _(spark, sf):
    from ..plans.work_batch import work_batch

    tables = dict(feed=fx.feed(spark, sf), finals=fx.finals(spark, sf), tests=fx.tests(spark, sf))
    fresh = work_batch(**tables, competitor_id=2, mode=" Unknown ", after_id=5, limit=20)
    again = work_batch(**tables, competitor_id=3, mode="RETRY_URL", after_id=5, limit=999)
    return fresh.envelope.unionByName(again.envelope)


# --- counts and reports -------------------------------------------------------------------------------


@query(
    "a12_eligible_counts",
    with_ci(f"""SELECT id AS competitor_id, (SELECT count(*) FROM ({_NEW.format(cols='f.id_product', after='-1', c='comp.id')}))
      AS eligible FROM comp"""),
)
def _(spark, sf):
    return W.eligible_counts(fx.feed(spark, sf), fx.finals(spark, sf), fx.tests(spark, sf), fx.competitors(spark))


@query(
    "a13_pending_counts",
    with_ci(f"""SELECT id AS competitor_id, name, coalesce(pending,0) AS pending, coalesce(missing_image,0) AS missing_image
      FROM comp LEFT JOIN (SELECT competitor_id, count(*) AS pending,
        count(*) FILTER (WHERE coalesce(competitor_image_url,'') = '') AS missing_image {_LIVE} GROUP BY 1) p
      ON p.competitor_id = id"""),
)
def _(spark, sf):
    return R.pending_counts(fx.tests(spark, sf), fx.finals(spark, sf), fx.competitors(spark))


@query(
    "a14_status_counts",
    with_ci(f"""SELECT (SELECT count(*) {_LIVE}) AS pending,
      (SELECT count(*) FROM tests WHERE validation_status = 'valid') AS valid,
      (SELECT count(*) FROM tests WHERE validation_status = 'rejected') AS rejected"""),
)
def _(spark, sf):
    return R.status_counts(fx.tests(spark, sf), fx.finals(spark, sf))


@query(
    "a15_reference_prices",
    with_ci(
        "SELECT id_product, CAST(price AS DOUBLE) AS price, date_upd AS updated_at FROM ref_price WHERE id_product > 0",
        REFERENCE,
    ),
)
def _(spark, sf):
    return as_report(R.reference_prices(fx.reference_prices(spark, sf)))


_REPORT = f"""report AS (SELECT id AS competitor_id, name AS competitor,
    (SELECT count(*) FROM ({_NEW.format(cols='f.id_product', after='-1', c='comp.id')})) AS theoretical,
    m.*, (SELECT count(*) {_LIVE} AND t.competitor_id = comp.id) AS pending
  FROM comp, LATERAL (SELECT
    count(*) FILTER (WHERE b = 'matched') AS matched, count(*) FILTER (WHERE b = 'postponed') AS postponed,
    count(*) FILTER (WHERE b = 'rejected') AS rejected, count(*) FILTER (WHERE b = 'not_found') AS not_found,
    count(*) FILTER (WHERE b = 'cloudflare') AS cloudflare,
    count(*) FILTER (WHERE b = 'search_input_not_found') AS search_input_not_found,
    count(*) FILTER (WHERE b = 'error') AS error
    FROM (SELECT CASE WHEN validation_status = 'valid' THEN 'matched' WHEN validation_status IN ('postponed','rejected')
      THEN validation_status ELSE result END AS b FROM tests WHERE validation_status <> 'pending' AND competitor_id = comp.id)) m)"""
_REPORT_COLS = "theoretical, matched, pending, postponed, rejected, not_found, cloudflare, search_input_not_found, error"
_TOTAL = "matched + pending + postponed + rejected + not_found + cloudflare + search_input_not_found + error AS total"


def _report(spark, sf):
    tests, finals, comp = fx.tests(spark, sf), fx.finals(spark, sf), fx.competitors(spark)
    return R.test_report(tests, finals, comp, W.eligible_counts(fx.feed(spark, sf), finals, tests, comp))


@query("a16_test_report", with_ci(f"SELECT competitor_id, competitor, {_REPORT_COLS}, {_TOTAL} FROM report", _REPORT))
def _(spark, sf):
    return _report(spark, sf)


@query(
    "a17_report_totals",
    with_ci(
        "SELECT "
        + ", ".join(f"CAST(sum({c.strip()}) AS BIGINT) AS {c.strip()}" for c in (_REPORT_COLS + ", total").split(","))
        + f" FROM (SELECT {_REPORT_COLS}, {_TOTAL} FROM report)",
        _REPORT,
    ),
)
def _(spark, sf):
    return R.report_totals(_report(spark, sf))


@query(
    "a18_recent_scrapes",
    with_ci("""SELECT name AS competitor, count(*) AS n FROM history JOIN comp ON id = competitor_id
      WHERE observed_at >= TIMESTAMP '2001-06-14 12:00:00' GROUP BY ROLLUP (name)"""),
)
def _(spark, sf):
    return R.recent_scrapes(fx.price_history(spark, sf), fx.competitors(spark), AS_OF)


@query(
    "a19_latest_observation",
    with_ci("""SELECT competitor_id, id_product, url, CAST(max(observed_at) AS DATE) AS last_scraped_at FROM history
      GROUP BY ALL"""),
)
def _(spark, sf):
    return _day(W.last_observed(fx.price_history(spark, sf)), "last_scraped_at")


# --- boards -------------------------------------------------------------------------------------------

_BOARD = """board AS (SELECT *, CASE WHEN delta_percent < -1.0 THEN 'cheaper' WHEN delta_percent > 1.0 THEN 'pricier' ELSE 'same' END AS tone
  FROM (SELECT id_product, name, brand, source_price, avg_price, source_price / avg_price * 100.0 AS price_index,
    (source_price - avg_price) / avg_price * 100.0 AS delta_percent, competitor_count
    FROM (SELECT id_product, coalesce(nullif(trim(product_name),''), 'Product ' || CAST(id_product AS VARCHAR)) AS name,
        nullif(trim(manufacturer_name),'') AS brand, CAST(price_tax_incl AS DOUBLE) AS source_price FROM feed
        WHERE price_tax_incl > 0 AND id_product > 0)
    JOIN (SELECT id_product, CAST(sum(competitor_price) AS DOUBLE) / count(*) AS avg_price, count(*) AS competitor_count
      FROM finals GROUP BY 1) USING (id_product) WHERE avg_price > 0))"""


def _board(spark, sf):
    return B.price_board(fx.finals(spark, sf), fx.competitors(spark), fx.feed(spark, sf))


@query("b1_price_board", with_ci("SELECT * FROM board", _BOARD))
def _(spark, sf):
    return _board(spark, sf)


@query(
    "b1_price_board_top",
    with_ci("SELECT * FROM board ORDER BY abs(delta_percent) DESC, id_product LIMIT 60", _BOARD),
)
def _(spark, sf):
    return B.board_rows(_board(spark, sf))


_TONE = "CASE WHEN price IS NULL THEN 'empty' WHEN d < -1.0 THEN 'cheaper' WHEN d > 1.0 THEN 'pricier' ELSE 'same' END"


@query(
    "b2_price_cells",
    with_ci(
        f"""SELECT id_product, seller, seller_name, price, d AS delta_percent, {_TONE} AS tone, url FROM (
      SELECT *, (source_price - price) / price * 100.0 AS d FROM (
        SELECT b.id_product, source_price, CAST(c.id AS VARCHAR) AS seller, c.name AS seller_name,
          CAST(f.competitor_price AS DOUBLE) AS price, f.url
        FROM board b CROSS JOIN comp c LEFT JOIN finals f ON f.id_product = b.id_product AND f.competitor_id = c.id
        UNION ALL SELECT b.id_product, source_price, 'reference', 'Reference', CAST(r.price AS DOUBLE), NULL
        FROM board b LEFT JOIN ref_price r USING (id_product)))""",
        _BOARD,
        REFERENCE,
    ),
)
def _(spark, sf):
    reference = R.reference_prices(fx.reference_prices(spark, sf))
    return B.price_cells(_board(spark, sf), fx.finals(spark, sf), SELLERS, reference)


@query(
    "b3_board_totals",
    with_ci(
        """SELECT count(*) AS products, count(*) FILTER (WHERE tone = 'cheaper') AS cheaper,
      count(*) FILTER (WHERE tone = 'same') AS same, count(*) FILTER (WHERE tone = 'pricier') AS pricier,
      CAST(sum(CAST(delta_percent AS DECIMAL(24,6))) AS DOUBLE) / count(*) AS avg_delta FROM board""",
        _BOARD,
    ),
)
def _(spark, sf):
    return B.board_totals(_board(spark, sf))


_BUCKETS = "buckets AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE), '{label}', '{tone}')" for k, lo, hi, label, tone in B.BUCKETS
) + ") t(key, \"min\", \"max\", label, tone))"
_IN_BUCKET = 'd.delta_percent >= b."min" AND (d.delta_percent < b."max" OR (b."max" = 1000 AND d.delta_percent <= 1000))'


@query(
    "b4_delta_histogram",
    with_ci(
        f"""SELECT b.key, b.label, b.tone, b."min", b."max", (SELECT count(*) FROM board d WHERE {_IN_BUCKET}) AS count
      FROM buckets b""",
        _BOARD,
        _BUCKETS,
    ),
)
def _(spark, sf):
    return B.delta_histogram(_board(spark, sf))


@query(
    "b5_board_drill_down",
    with_ci(
        f"""SELECT d.id_product, d.delta_percent FROM board d JOIN buckets b ON b.key = 'p5-p10' AND {_IN_BUCKET}
      WHERE EXISTS (SELECT 1 FROM finals f WHERE f.id_product = d.id_product AND f.competitor_id = 2)""",
        _BOARD,
        _BUCKETS,
    ),
)
def _(spark, sf):
    sold = W.of_competitor(fx.finals(spark, sf), 2)
    return B.board_filter(_board(spark, sf), "p5-p10", sold).select("id_product", "delta_percent")


_GAPS = f"""gaps AS (SELECT *, greatest(0.0, coalesce(abs(delta_3),0.0), coalesce(abs(delta_4),0.0)) AS max_gap FROM (
  SELECT id_product, trusted_avg, price_3, price_4, (price_3 - trusted_avg) / trusted_avg * 100.0 AS delta_3,
    (price_4 - trusted_avg) / trusted_avg * 100.0 AS delta_4,
    coalesce(abs((price_3 - trusted_avg) / trusted_avg * 100.0) > 30, false) AS offender_3,
    coalesce(abs((price_4 - trusted_avg) / trusted_avg * 100.0) > 30, false) AS offender_4
  FROM (SELECT id_product, CAST(sum(competitor_price) FILTER (WHERE competitor_id IN (1,2)) AS DOUBLE)
      / count(*) FILTER (WHERE competitor_id IN (1,2)) AS trusted_avg,
    CAST(max(competitor_price) FILTER (WHERE competitor_id = 3) AS DOUBLE) AS price_3,
    CAST(max(competitor_price) FILTER (WHERE competitor_id = 4) AS DOUBLE) AS price_4 FROM finals WHERE id_product > 0 GROUP BY 1
    HAVING count(*) FILTER (WHERE competitor_id IN (1,2)) > 0)) WHERE offender_3 OR offender_4)"""
_GAP_TONE = "CASE WHEN delta_{0} IS NULL THEN 'empty' WHEN delta_{0} > 0 THEN 'pricier' WHEN delta_{0} < 0 THEN 'cheaper' ELSE 'same' END AS tone_{0}"
_GAP_VISIBLE = "CASE WHEN offender_3 AND offender_4 THEN true ELSE offender_4 END"


def _gaps(spark, sf):
    return B.gap_entries(fx.finals(spark, sf), fx.feed(spark, sf), TRUSTED, TARGETS)


@query(
    "b6_trusted_gaps",
    with_ci(
        f"""SELECT g.*, {_GAP_TONE.format(3)}, {_GAP_TONE.format(4)},
      coalesce(nullif(trim(product_name),''), 'Product ' || CAST(g.id_product AS VARCHAR)) AS name,
      CAST(price_tax_incl AS DOUBLE) AS source_price FROM gaps g JOIN feed USING (id_product)
      ORDER BY max_gap DESC, id_product LIMIT 100""",
        _GAPS,
    ),
)
def _(spark, sf):
    return B.trusted_gaps(_gaps(spark, sf), TARGETS)


@query(
    "b6_trusted_gaps_one_target_hidden",
    with_ci(f"SELECT id_product, max_gap FROM gaps WHERE {_GAP_VISIBLE}", _GAPS),
)
def _(spark, sf):
    return B.trusted_gaps(_gaps(spark, sf), TARGETS, {3: False}, limit=None).select("id_product", "max_gap")


@query(
    "b7_gap_totals",
    with_ci(
        f"""SELECT count(*) FILTER (WHERE {_GAP_VISIBLE}) AS products, count(*) FILTER (WHERE offender_3) AS offenders_3,
      count(*) FILTER (WHERE offender_4) AS offenders_4, count(*) FILTER (WHERE offender_3 AND offender_4) AS "both"
      FROM gaps""",
        _GAPS,
    ),
)
def _(spark, sf):
    return B.gap_totals(_gaps(spark, sf), TARGETS, {3: False})


@query(
    "b8_competitor_slug",
    """SELECT c_custkey, CASE WHEN s = '' THEN 'competitor' ELSE s END AS slug FROM (SELECT c_custkey,
      trim(regexp_replace(lower(trim(c_name || ' & ' || c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM customer)""",
)
def _(spark, sf):
    name = F.concat("c_name", F.lit(" & "), "c_mktsegment")
    return fx.table(spark, sf, "customer").select("c_custkey", L.slug(name).alias("slug"))


@query(
    "b9_price_ratio",
    with_ci("""SELECT id_product, competitor_id, CASE WHEN competitor_price > 0 AND price_tax_incl > 0 THEN
      abs(CAST(competitor_price AS DOUBLE) - CAST(price_tax_incl AS DOUBLE)) / CAST(price_tax_incl AS DOUBLE) END AS ratio
      FROM finals JOIN feed USING (id_product)"""),
)
def _(spark, sf):
    rows = fx.finals(spark, sf).join(fx.feed(spark, sf), "id_product")
    return rows.select(
        "id_product", "competitor_id", M.price_ratio("competitor_price", "price_tax_incl").alias("ratio")
    )


# --- test results -------------------------------------------------------------------------------------

_DERIVED = """CASE WHEN result = 'matched' AND score >= 90 THEN 'valid' WHEN trim(url) <> '' THEN 'pending' ELSE 'ignored' END"""
_EV = f"""ev AS (SELECT *, {_DERIVED} AS status, CASE WHEN id_product <= 0 OR result = '' THEN 'invalid'
  WHEN score < 30 THEN 'low' ELSE 'upsert' END AS kind FROM incoming)"""
# the state machine itself, folded over each pair's events in arrival order
_FOLD = """folded AS (SELECT id_product, competitor_id, list_reduce(
    list_prepend({'op': 'upsert', 'status': coalesce(any_value(stored), 'absent'), 'seq': CAST(-1 AS BIGINT)},
      coalesce(list({'op': e.kind, 'status': e.status, 'seq': e.seq} ORDER BY e.seq) FILTER (WHERE e.seq IS NOT NULL), [])),
    lambda a, x: CASE WHEN x.op = 'low' THEN (CASE WHEN a.status = 'pending' THEN {'op': 'low', 'status': 'absent', 'seq': x.seq}
      ELSE a END) ELSE x END) AS s
  FROM (SELECT id_product, competitor_id, kind, status, seq, stored FROM (SELECT * FROM ev WHERE kind <> 'invalid') e
    FULL JOIN (SELECT id_product, competitor_id, validation_status AS stored FROM tests) t USING (id_product, competitor_id)) e
  GROUP BY 1, 2)"""


@query(
    "i1_merge_test_results",
    with_ci(
        """SELECT f.id_product, f.competitor_id, f.s.status AS validation_status, coalesce(e.result, t.result) AS result,
      coalesce(CASE WHEN e.seq IS NOT NULL THEN trim(e.competitor_title) ELSE t.competitor_title END, '') AS competitor_title,
      coalesce(CASE WHEN e.seq IS NOT NULL THEN e.page_status ELSE t.competitor_page_status END) AS competitor_page_status,
      coalesce(CASE WHEN e.seq IS NOT NULL THEN nullif(trim(e.url),'') ELSE t.url END, '') AS url,
      coalesce(CASE WHEN e.seq IS NOT NULL THEN e.score ELSE t.score END, -1) AS score,
      CAST(CASE WHEN e.seq IS NOT NULL THEN e.price ELSE t.competitor_price END AS DOUBLE) AS competitor_price,
      CAST(CASE WHEN e.seq IS NOT NULL THEN e.tested_at ELSE t.last_tested_at END AS DATE) AS last_tested_at
      FROM folded f LEFT JOIN ev e ON e.seq = f.s.seq AND f.s.seq >= 0
      LEFT JOIN tests t ON t.id_product = f.id_product AND t.competitor_id = f.competitor_id WHERE f.s.status <> 'absent'""",
        INCOMING,
        _EV,
        _FOLD,
    ),
)
def _(spark, sf):
    out = R.merge_test_results(fx.tests(spark, sf), fx.incoming_tests(spark, sf))
    return _day(
        as_report(
            out.select(
                "id_product",
                "competitor_id",
                "validation_status",
                "result",
                F.coalesce("competitor_title", F.lit("")).alias("competitor_title"),
                "competitor_page_status",
                F.coalesce("url", F.lit("")).alias("url"),
                F.coalesce("score", F.lit(-1)).alias("score"),
                "competitor_price",
                "last_tested_at",
            )
        ),
        "last_tested_at",
    )


@query(
    "i2_review_derivation",
    with_ci("SELECT seq, status AS validation_status, kind FROM ev", INCOMING, _EV),
)
def _(spark, sf):
    return R.prepare_tests(fx.incoming_tests(spark, sf)).select("seq", "validation_status", "kind")


_PROMO = """promo AS (SELECT * FROM ev WHERE kind = 'upsert' AND result = 'matched' AND score >= 90 AND trim(url) <> ''),
  promo_last AS (SELECT id_product, competitor_id, arg_max(trim(url), seq) AS url,
    arg_max(price, seq) FILTER (WHERE price IS NOT NULL) AS price, min(tested_at) AS first_at, max(tested_at) AS last_at
    FROM promo GROUP BY 1, 2)"""


@query(
    "i3_promoted_finals",
    with_ci(
        """SELECT coalesce(f.id_product, p.id_product) AS id_product, coalesce(f.competitor_id, p.competitor_id) AS competitor_id,
      coalesce(p.url, f.url) AS url, CAST(coalesce(p.price, f.competitor_price) AS DOUBLE) AS competitor_price,
      CAST(coalesce(f.created_at, p.first_at) AS DATE) AS created_at, CAST(coalesce(p.last_at, f.updated_at) AS DATE) AS updated_at
      FROM finals f FULL JOIN promo_last p ON f.id_product = p.id_product AND f.competitor_id = p.competitor_id""",
        INCOMING,
        _EV,
        _PROMO,
    ),
)
def _(spark, sf):
    out, _ = R.promote_finals(fx.finals(spark, sf), fx.incoming_tests(spark, sf))
    cols = ("id_product", "competitor_id", "url", "competitor_price", "created_at", "updated_at")
    return _day(as_report(out.select(*cols)), "created_at", "updated_at")


@query(
    "i3_promotion_history",
    with_ci(
        """SELECT competitor_id, id_product, trim(url) AS url, CAST(price AS DOUBLE) AS price, 'test_result' AS source,
      CAST(tested_at AS DATE) AS day FROM promo WHERE price IS NOT NULL""",
        INCOMING,
        _EV,
        _PROMO,
    ),
)
def _(spark, sf):
    _, observed = R.promote_finals(fx.finals(spark, sf), fx.incoming_tests(spark, sf))
    return as_report(observed).select(
        "competitor_id", "id_product", "url", "price", "source", F.to_date("observed_at").alias("day")
    )


_ACTIONS = """acts AS (SELECT seq, id_product, competitor_id, kind, CASE WHEN kind = 'upsert' THEN
      CASE WHEN before = 'absent' THEN 'inserted' ELSE 'updated' END
    WHEN kind = 'low' AND before = 'pending' THEN 'updated' ELSE 'ignored' END AS action
  FROM (SELECT e.*, (list_reduce(list_prepend({'op': 'upsert', 'status': coalesce(t.validation_status, 'absent'), 'seq': CAST(-1 AS BIGINT)},
      list_filter(g.evs, lambda y: y.seq < e.seq)), lambda a, x: CASE WHEN x.op = 'low' THEN (CASE WHEN a.status = 'pending'
        THEN {'op': 'low', 'status': 'absent', 'seq': x.seq} ELSE a END) ELSE x END)).status AS before
    FROM ev e LEFT JOIN (SELECT id_product, competitor_id, list({'op': kind, 'status': status, 'seq': seq} ORDER BY seq) AS evs
        FROM ev WHERE kind <> 'invalid' GROUP BY 1, 2) g USING (id_product, competitor_id)
      LEFT JOIN tests t USING (id_product, competitor_id) WHERE e.kind <> 'invalid')
  UNION ALL SELECT seq, id_product, competitor_id, kind, 'ignored' FROM ev WHERE kind = 'invalid')"""


@query("i1_test_actions", with_ci("SELECT * FROM acts", INCOMING, _EV, _ACTIONS))
def _(spark, sf):
    return R.test_actions(fx.tests(spark, sf), fx.incoming_tests(spark, sf))


@query("a20_ingest_counters", with_ci("SELECT action, count(*) AS n FROM acts GROUP BY 1", INCOMING, _EV, _ACTIONS))
def _(spark, sf):
    return R.action_counts(R.test_actions(fx.tests(spark, sf), fx.incoming_tests(spark, sf)))


# --- prices and health --------------------------------------------------------------------------------


@query(
    "i4_price_ingest",
    with_ci(
        """SELECT f.id_product, f.competitor_id, coalesce(o.url, f.url) AS url,
      CAST(coalesce(o.price, f.competitor_price) AS DOUBLE) AS competitor_price,
      CASE WHEN o.url IS NOT NULL THEN 0 ELSE f.consecutive_http_failures END AS consecutive_http_failures
      FROM finals f LEFT JOIN (SELECT id_product, competitor_id, arg_max(url, seq) AS url, arg_max(price, seq) AS price
        FROM url_events WHERE price IS NOT NULL AND id_product > 0 GROUP BY 1, 2) o USING (id_product, competitor_id)""",
        URL_EVENTS,
    ),
)
def _(spark, sf):
    out, _ = R.ingest_prices(fx.finals(spark, sf), fx.url_events(spark, sf))
    return as_report(out.select("id_product", "competitor_id", "url", "competitor_price", "consecutive_http_failures"))


_HEALTH = """log AS (SELECT e.*, f.consecutive_http_failures AS stored, f.url AS furl FROM url_events e
    JOIN finals f USING (id_product, competitor_id) WHERE e.id_product > 0),
  health AS (SELECT id_product, competitor_id, list_reduce(
      list_prepend({'run': any_value(stored), 'st': CAST(NULL AS INTEGER), 'obs': false, 'price': CAST(NULL AS DECIMAL(12,2)),
          'fails': CAST(0 AS BIGINT), 'dead': false, 'seen': CAST(0 AS BIGINT), 'err_at': '', 'err': ''},
        list({'run': 0, 'st': http_status, 'obs': price IS NOT NULL, 'price': price, 'fails': CAST(0 AS BIGINT), 'dead': false,
          'seen': CAST(0 AS BIGINT), 'err_at': strftime(event_at, '%Y-%m-%d %H:%M:%S'), 'err': error} ORDER BY seq)),
      lambda a, x: CASE WHEN a.dead THEN a
        WHEN x.obs THEN {'run': 0, 'st': CAST(NULL AS INTEGER), 'obs': true, 'price': x.price, 'fails': a.fails, 'dead': false, 'seen': a.seen + 1, 'err_at': '', 'err': ''}
        WHEN x.st IN (404, 410) THEN {'run': a.run + 1, 'st': x.st, 'obs': false, 'price': a.price, 'fails': a.fails + 1, 'dead': a.run + 1 >= 3, 'seen': a.seen, 'err_at': x.err_at, 'err': x.err}
        ELSE {'run': 0, 'st': x.st, 'obs': false, 'price': a.price, 'fails': a.fails + 1, 'dead': false, 'seen': a.seen, 'err_at': x.err_at, 'err': x.err} END) AS s
    FROM log GROUP BY 1, 2)"""


@query(
    "i5_url_health",
    with_ci(
        """SELECT f.id_product, f.competitor_id, f.url, CAST(coalesce(s.price, f.competitor_price) AS DOUBLE) AS competitor_price,
      CAST(coalesce(s.run, f.consecutive_http_failures) AS INTEGER) AS consecutive_http_failures,
      coalesce(s.st, 0) AS last_http_status, coalesce(s.fails, 0) AS failures, coalesce(s.seen, 0) AS observations,
      coalesce(s.dead, false) AS removed, coalesce(s.err_at, '') AS last_http_error_at, coalesce(s.err, '') AS last_http_error_message
      FROM finals f LEFT JOIN health h USING (id_product, competitor_id)""",
        URL_EVENTS,
        _HEALTH,
    ),
)
def _(spark, sf):
    out = R.url_health(fx.finals(spark, sf), fx.url_events(spark, sf))
    stamp = F.date_format("last_http_error_at", "yyyy-MM-dd HH:mm:ss")
    out = as_report(out.withColumn("last_http_error_at", stamp))
    return out.fillna(0, ["last_http_status"]).fillna("", ["last_http_error_at", "last_http_error_message"])


@query(
    "a20_price_counters",
    with_ci(
        """, known AS (SELECT count(*) AS n FROM url_events e WHERE id_product > 0 AND (price IS NOT NULL OR http_status IS NOT NULL)
        AND EXISTS (SELECT 1 FROM finals f WHERE f.id_product = e.id_product AND f.competitor_id = e.competitor_id)),
      usable AS (SELECT count(*) AS n FROM url_events WHERE id_product > 0 AND (price IS NOT NULL OR http_status IS NOT NULL)),
      done AS (SELECT coalesce(sum(s.seen), 0)::BIGINT AS updated, coalesce(sum(s.fails), 0)::BIGINT AS failures,
        count(*) FILTER (WHERE s.dead) AS removed, count(*) FILTER (WHERE s.dead AND EXISTS (SELECT 1 FROM tests t
          WHERE t.id_product = h.id_product AND t.competitor_id = h.competitor_id)) AS gone FROM health h)
      SELECT 'inserted' AS counter, '' AS reason, 0::BIGINT AS n UNION ALL SELECT 'updated', '', updated FROM done
      UNION ALL SELECT 'failures', '', failures FROM done UNION ALL SELECT 'removed', '', removed FROM done
      UNION ALL SELECT 'gone', '', gone FROM done
      UNION ALL SELECT 'ignored', 'invalid', (SELECT count(*) FROM url_events) - n FROM usable
      UNION ALL SELECT 'ignored', 'no final url', usable.n - known.n FROM usable, known
      UNION ALL SELECT 'ignored', 'url replaced or removed', known.n - updated - failures FROM known, done""",
        URL_EVENTS,
        _HEALTH,
    ),
)
def _(spark, sf):
    finals, events = fx.finals(spark, sf), fx.url_events(spark, sf)
    return R.price_counters(finals, fx.tests(spark, sf), events, R.url_health(finals, events))


@query(
    "i5_pages_marked_gone",
    with_ci(
        """SELECT t.id_product, t.competitor_id, CASE WHEN h.s.dead THEN 'gone' ELSE t.competitor_page_status END AS competitor_page_status
      FROM tests t LEFT JOIN health h USING (id_product, competitor_id)""",
        URL_EVENTS,
        _HEALTH,
    ),
)
def _(spark, sf):
    finals = fx.finals(spark, sf)
    health = R.url_health(finals, fx.url_events(spark, sf))
    _, tests = R.apply_url_health(finals, fx.tests(spark, sf), health)
    return tests.select("id_product", "competitor_id", "competitor_page_status")


# --- decisions ----------------------------------------------------------------------------------------

_DECISIONS = """decisions AS (SELECT event_id AS seq, user_id AS id_product, CAST(event_id % 4 + 1 AS INTEGER) AS competitor_id,
    CASE event_type WHEN 'purchase' THEN 'valid' WHEN 'view' THEN 'postponed' WHEN 'error' THEN 'rejected' ELSE 'unknown' END AS status,
    ts AS decided_at FROM events),
  known AS (SELECT d.*, t.url, t.competitor_price FROM decisions d JOIN tests t USING (id_product, competitor_id)
    WHERE d.status <> 'unknown'),
  verdicts AS (SELECT id_product, competitor_id, arg_max(status, seq) AS new_status,
    arg_max(status, seq) FILTER (WHERE status IN ('valid','rejected')) AS verdict,
    max(seq) FILTER (WHERE status = 'rejected') AS rejected_seq, min(decided_at) FILTER (WHERE status = 'valid') AS v FROM known GROUP BY 1, 2)"""


def _decisions(spark, sf):
    kind = F.col("event_type")
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id_product"),
        (F.col("event_id") % 4 + 1).cast("int").alias("competitor_id"),
        F.when(kind == "purchase", "valid")
        .when(kind == "view", "postponed")
        .when(kind == "error", "rejected")
        .otherwise("unknown")
        .alias("status"),
        F.col("ts").alias("decided_at"),
    )


def _state(spark, sf):
    tests = fx.tests(spark, sf)
    return R.ReviewState(tests, fx.finals(spark, sf), fx.price_history(spark, sf), fx.rejected_urls(tests))


@query(
    "i6_reviewed_tests",
    with_ci(
        """SELECT t.id_product, t.competitor_id, coalesce(v.new_status, t.validation_status) AS validation_status
      FROM tests t LEFT JOIN verdicts v USING (id_product, competitor_id)""",
        _DECISIONS,
    ),
)
def _(spark, sf):
    state = R.apply_reviews(_state(spark, sf), _decisions(spark, sf))
    return state.tests.select("id_product", "competitor_id", "validation_status")


@query(
    "i6_reviewed_finals",
    with_ci(
        """SELECT id_product, competitor_id, url, CAST(competitor_price AS DOUBLE) AS competitor_price FROM finals f
      WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.id_product = f.id_product AND v.competitor_id = f.competitor_id
        AND (v.rejected_seq IS NOT NULL OR v.verdict = 'valid'))
      UNION ALL SELECT id_product, competitor_id, t.url, CAST(coalesce(t.competitor_price,
        CASE WHEN v.rejected_seq IS NULL THEN f.competitor_price END) AS DOUBLE)
      FROM verdicts v JOIN tests t USING (id_product, competitor_id) LEFT JOIN finals f USING (id_product, competitor_id)
      WHERE v.verdict = 'valid'""",
        _DECISIONS,
    ),
)
def _(spark, sf):
    state = R.apply_reviews(_state(spark, sf), _decisions(spark, sf))
    return as_report(state.finals.select("id_product", "competitor_id", "url", "competitor_price"))


@query(
    "i6_reviewed_history",
    with_ci(
        """SELECT competitor_id, id_product, url, source, CAST(price AS DOUBLE) AS price, CAST(observed_at AS DATE) AS observed_at FROM (
        SELECT competitor_id, id_product, url, source, price, observed_at FROM history h WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE
          v.rejected_seq IS NOT NULL AND v.id_product = h.id_product AND v.competitor_id = h.competitor_id AND h.id_product > 0)
        UNION ALL SELECT competitor_id, id_product, k.url, 'review', k.competitor_price, k.decided_at FROM known k JOIN verdicts v
          USING (id_product, competitor_id) WHERE v.verdict = 'valid' AND k.status = 'valid'
          AND (v.rejected_seq IS NULL OR k.seq > v.rejected_seq) AND k.id_product > 0)""",
        _DECISIONS,
    ),
)
def _(spark, sf):
    history = R.apply_reviews(_state(spark, sf), _decisions(spark, sf)).history
    out = history.select("competitor_id", "id_product", "url", "source", F.col("price").cast("double").alias("price"), "observed_at")
    return _day(out, "observed_at")


@query(
    "i6_rejected_urls",
    with_ci(
        """SELECT competitor_id, url FROM tests WHERE validation_status = 'rejected'
      UNION SELECT competitor_id, url FROM known WHERE status = 'rejected'""",
        _DECISIONS,
    ),
)
def _(spark, sf):
    return R.apply_reviews(_state(spark, sf), _decisions(spark, sf)).rejected


def _restored(spark, sf):
    picked = _decisions(spark, sf).where("status = 'valid'")
    state = _state(spark, sf)
    rejected = state.tests.where("validation_status = 'rejected'").select("id_product", "competitor_id")
    return R.restore_rejected(state, picked.join(rejected, ["id_product", "competitor_id"], "left_semi"))


_RESTORED = """restored AS (SELECT DISTINCT id_product, competitor_id FROM decisions d JOIN tests t USING (id_product, competitor_id)
  WHERE d.status = 'valid' AND t.validation_status = 'rejected')"""


@query(
    "i7_restored_tests",
    with_ci(
        """SELECT t.id_product, t.competitor_id, CASE WHEN r.id_product IS NOT NULL THEN 'valid' ELSE validation_status END
      AS validation_status, f.url IS NOT NULL OR r.id_product IS NOT NULL AS has_final
      FROM tests t LEFT JOIN restored r USING (id_product, competitor_id) LEFT JOIN finals f USING (id_product, competitor_id)""",
        _DECISIONS,
        _RESTORED,
    ),
)
def _(spark, sf):
    state = _restored(spark, sf)
    known = state.finals.select("id_product", "competitor_id", F.lit(True).alias("f"))
    return state.tests.join(known, ["id_product", "competitor_id"], "left").select(
        "id_product", "competitor_id", "validation_status", F.coalesce("f", F.lit(False)).alias("has_final")
    )


@query(
    "i7_rejected_urls_after_restore",
    with_ci(
        """SELECT competitor_id, url FROM tests t WHERE validation_status = 'rejected' AND NOT EXISTS (SELECT 1 FROM restored r
      WHERE r.id_product = t.id_product AND r.competitor_id = t.competitor_id)""",
        _DECISIONS,
        _RESTORED,
    ),
)
def _(spark, sf):
    return _restored(spark, sf).rejected


_MANUAL = f"""manual_in AS (SELECT event_id AS seq, user_id AS id_product, CAST(event_id % 4 + 1 AS INTEGER) AS competitor_id,
    CASE event_type WHEN 'view' THEN 'https://www.C' || CAST(event_id % 4 + 1 AS VARCHAR) || '.example.com/m' || CAST(event_id AS VARCHAR)
      WHEN 'click' THEN 'https://c' || CAST(event_id % 4 + 1 AS VARCHAR) || '.example.com/n' ELSE 'https://evilc'
      || CAST(event_id % 4 + 1 AS VARCHAR) || '.example.com/x' END AS url, CASE WHEN event_id % 2 = 0 THEN 'T' || CAST(event_id AS VARCHAR) END AS title,
    CASE WHEN event_id % 3 > 0 THEN CAST(value AS DECIMAL(12,2)) END AS price, event_type IN ('view','click') AS ok, ts FROM events),
  manual_ok AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_product, competitor_id ORDER BY seq DESC) AS rn
    FROM manual_in WHERE ok) WHERE rn = 1)"""


def _manual_entries(spark, sf):
    kind, key = F.col("event_type"), (F.col("event_id") % 4 + 1).cast("int")
    no = key.cast("string")
    return fx.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id_product"),
        key.alias("competitor_id"),
        F.when(kind == "view", F.concat(F.lit("https://www.C"), no, F.lit(".example.com/m"), F.col("event_id").cast("string")))
        .when(kind == "click", F.concat(F.lit("https://c"), no, F.lit(".example.com/n")))
        .otherwise(F.concat(F.lit("https://evilc"), no, F.lit(".example.com/x")))
        .alias("url"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("title"),
        F.when(F.col("event_id") % 3 > 0, F.col("value").cast("decimal(12,2)")).alias("price"),
        F.col("ts").alias("entered_at"),
    )


@query(
    "i8_manual_tests",
    with_ci(
        """SELECT coalesce(t.id_product, m.id_product) AS id_product, coalesce(t.competitor_id, m.competitor_id) AS competitor_id,
      coalesce(m.url, t.url) AS url, CASE WHEN m.seq IS NOT NULL THEN 'matched' ELSE t.result END AS result,
      CASE WHEN m.seq IS NOT NULL THEN 100 ELSE t.score END AS score,
      CASE WHEN m.seq IS NOT NULL THEN 'valid' ELSE t.validation_status END AS validation_status,
      coalesce(m.title, t.competitor_title, '') AS competitor_title,
      CAST(coalesce(m.price, t.competitor_price) AS DOUBLE) AS competitor_price,
      CASE WHEN m.seq IS NOT NULL THEN 'manual' ELSE t.matched_query END AS matched_query
      FROM tests t FULL JOIN manual_ok m ON m.id_product = t.id_product AND m.competitor_id = t.competitor_id""",
        _MANUAL,
    ),
)
def _(spark, sf):
    state, _ = R.add_manual_matches(_state(spark, sf), _manual_entries(spark, sf), fx.competitors(spark))
    rows = state.tests.withColumn("competitor_title", F.coalesce("competitor_title", F.lit("")))
    return as_report(
        rows.select(
            "id_product", "competitor_id", "url", "result", "score", "validation_status", "competitor_title",
            "competitor_price", "matched_query",
        )
    )


@query(
    "i8_refused_entries",
    with_ci("SELECT seq, id_product, competitor_id, url FROM manual_in WHERE NOT ok", _MANUAL),
)
def _(spark, sf):
    _, refused = R.add_manual_matches(_state(spark, sf), _manual_entries(spark, sf), fx.competitors(spark))
    return refused.select("seq", "id_product", "competitor_id", "url")


# --- candidates ---------------------------------------------------------------------------------------

_CAND_STATE = """stored AS (SELECT id_product, competitor_id, url, arg_max(score, seq) AS score,
    CASE WHEN max(score) % 2 = 1 THEN 'rejected' ELSE 'pending' END AS status
    FROM cand_events WHERE event_type = 'signup' GROUP BY 1, 2, 3),
  inc AS (SELECT *, CASE WHEN status IN ('pending','valid','rejected') THEN status ELSE 'pending' END AS st FROM cand_events c
    WHERE event_type <> 'signup' AND id_product > 0
      AND NOT EXISTS (SELECT 1 FROM bad b WHERE b.competitor_id = c.competitor_id AND b.url = c.url)
      AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.status = 'rejected' AND s.id_product = c.id_product
        AND s.competitor_id = c.competitor_id AND s.url = c.url)),
  acc AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE st = 'rejected') OVER (PARTITION BY id_product, competitor_id, url
    ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM inc) WHERE earlier = 0),
  best AS (SELECT id_product, competitor_id, url FROM (SELECT *, row_number() OVER (PARTITION BY id_product, competitor_id
    ORDER BY score DESC, seq DESC) AS rn FROM acc WHERE score > 90 OR status = 'valid') WHERE rn = 1)"""


def _candidates(spark, sf):
    events = _candidate_events(spark, sf)
    key = ["id_product", "competitor_id", "url"]
    stored = events.where("event_type = 'signup'").groupBy(*key).agg(
        F.max_by("title", "seq").alias("title"),
        F.max_by("score", "seq").alias("score"),
        F.when(F.max("score") % 2 == 1, "rejected").otherwise("pending").alias("status"),
    )
    return stored, events.where("event_type <> 'signup'"), _bad_urls(events)


@query(
    "i9_merged_candidates",
    with_ci(
        """SELECT coalesce(s.id_product, a.id_product) AS id_product, coalesce(s.competitor_id, a.competitor_id) AS competitor_id,
      coalesce(s.url, a.url) AS url, coalesce(a.score, s.score) AS score, coalesce(a.st, s.status) AS status FROM stored s
      FULL JOIN (SELECT id_product, competitor_id, url, arg_max(score, seq) AS score, arg_max(st, seq) AS st FROM acc GROUP BY 1, 2, 3) a
      ON a.id_product = s.id_product AND a.competitor_id = s.competitor_id AND a.url = s.url""",
        _CANDS,
        _CAND_STATE,
    ),
)
def _(spark, sf):
    stored, incoming, bad = _candidates(spark, sf)
    merged, _ = R.merge_candidates(stored, fx.finals(spark, sf), incoming, bad)
    return merged.select("id_product", "competitor_id", "url", "score", "status")


@query(
    "i9_candidate_finals",
    with_ci(
        """SELECT coalesce(f.id_product, b.id_product) AS id_product, coalesce(f.competitor_id, b.competitor_id) AS competitor_id,
      coalesce(b.url, f.url) AS url, CAST(f.competitor_price AS DOUBLE) AS competitor_price FROM finals f FULL JOIN best b
      ON f.id_product = b.id_product AND f.competitor_id = b.competitor_id""",
        _CANDS,
        _CAND_STATE,
    ),
)
def _(spark, sf):
    stored, incoming, bad = _candidates(spark, sf)
    _, finals = R.merge_candidates(stored, fx.finals(spark, sf), incoming, bad)
    return as_report(finals.select("id_product", "competitor_id", "url", "competitor_price"))


_CHANGES = """changes AS (SELECT c.* FROM cand_events c JOIN stored s USING (id_product, competitor_id, url)
    WHERE c.event_type <> 'signup' AND c.status IN ('pending','valid','rejected')),
  pair_last AS (SELECT id_product, competitor_id, arg_max(status, seq) AS status, arg_max(url, seq) AS url,
    bool_or(status = 'rejected') AS any_rejected FROM changes WHERE status <> 'pending' GROUP BY 1, 2)"""


@query(
    "i10_candidate_status",
    with_ci(
        """SELECT s.id_product, s.competitor_id, s.url, coalesce(c.status, s.status) AS status FROM stored s
      LEFT JOIN (SELECT id_product, competitor_id, url, arg_max(status, seq) AS status FROM changes GROUP BY 1, 2, 3) c
      USING (id_product, competitor_id, url)""",
        _CANDS,
        _CAND_STATE,
        _CHANGES,
    ),
)
def _(spark, sf):
    stored, incoming, _ = _candidates(spark, sf)
    out, _, _ = R.candidate_status(stored, fx.tests(spark, sf), fx.finals(spark, sf), incoming)
    return out.select("id_product", "competitor_id", "url", "status")


@query(
    "i10_candidate_status_effects",
    with_ci(
        """SELECT 'test' AS kind, t.id_product, t.competitor_id, '' AS url FROM tests t LEFT JOIN pair_last p USING (id_product, competitor_id)
        WHERE NOT coalesce(p.any_rejected, false)
      UNION ALL SELECT 'final', coalesce(f.id_product, p.id_product), coalesce(f.competitor_id, p.competitor_id),
        CASE WHEN p.status = 'valid' THEN p.url ELSE f.url END FROM finals f FULL JOIN pair_last p
        ON f.id_product = p.id_product AND f.competitor_id = p.competitor_id
        WHERE p.status = 'valid' OR (f.url IS NOT NULL AND NOT coalesce(p.any_rejected, false))""",
        _CANDS,
        _CAND_STATE,
        _CHANGES,
    ),
)
def _(spark, sf):
    stored, incoming, _ = _candidates(spark, sf)
    _, tests, finals = R.candidate_status(stored, fx.tests(spark, sf), fx.finals(spark, sf), incoming)
    return tests.select(F.lit("test").alias("kind"), "id_product", "competitor_id", F.lit("").alias("url")).unionByName(
        finals.select(F.lit("final").alias("kind"), "id_product", "competitor_id", "url")
    )


# --- images -------------------------------------------------------------------------------------------

_IMAGE_SQL = f"""img AS (SELECT t.id_product, t.competitor_id, CASE WHEN t.id_product = 0 OR competitor_image_url = ''
      THEN 'missing_images' WHEN v.confidence IS NULL THEN 'error' WHEN v.confidence < 70 THEN 'postponed'
      WHEN v.same_product THEN 'valid' ELSE 'rejected' END AS outcome
  FROM (SELECT * {_PENDING.format(page='')}) t LEFT JOIN (SELECT p_partkey AS id_product, p_size * 2 AS confidence, p_size % 3 > 0 AS same_product
    FROM part WHERE p_type <> 'PROMO') v ON v.id_product = t.id_product)"""


def _image_decisions(spark, sf):
    tests = fx.tests(spark, sf)
    pending = R.pending_queue(tests, fx.finals(spark, sf), live_pages_only=False)
    images = fx.images(spark, sf)
    main = W.main_images(images, fx.image_shop(images))
    snapshots = main.select("id_product", W.image_url(BASE_URL).alias("source_image_url"))
    verdicts = (
        fx.table(spark, sf, "part")
        .where("p_type <> 'PROMO'")
        .select(
            F.col("p_partkey").alias("id_product"),
            F.explode(F.array(*[F.lit(c) for c, _ in SELLERS])).alias("competitor_id"),
            (F.col("p_size") % 3 > 0).alias("same_product"),
            (F.col("p_size") * 2).alias("confidence"),
        )
    )
    return R.image_decisions(pending, snapshots, verdicts)


@query(
    "i11_image_verdicts",
    with_ci(
        """SELECT id_product, competitor_id, outcome, CASE WHEN outcome IN ('valid','rejected') THEN outcome ELSE 'postponed' END
      AS status FROM img""",
        _IMAGE_SQL,
    ),
)
def _(spark, sf):
    return _image_decisions(spark, sf)


@query(
    "i11_image_stats",
    with_ci(
        """SELECT count(*) AS processed, count(*) FILTER (WHERE outcome = 'valid') AS valid,
      count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
      count(*) FILTER (WHERE outcome NOT IN ('valid','rejected')) AS postponed,
      count(*) FILTER (WHERE outcome = 'missing_images') AS missing_images, count(*) FILTER (WHERE outcome = 'error') AS errors
      FROM img""",
        _IMAGE_SQL,
    ),
)
def _(spark, sf):
    return R.image_stats(_image_decisions(spark, sf))


@query(
    "i12_gone_redirects",
    """SELECT competitor_id, id_product, url, final_url, CASE competitor_id
        WHEN 4 THEN url LIKE '%/p%/%' AND url <> final_url AND k % 3 = 1
        WHEN 3 THEN url <> final_url AND k % 3 = 1 AND k % 5 <> 0 ELSE false END AS gone
    FROM (SELECT *, CASE k % 3 WHEN 0 THEN url WHEN 1 THEN replace(substr(url, 1, position('.example.com' IN url) + 11), 'c', 'C')
      || '/catalogue' ELSE 'https://other.example.com/home' END AS final_url
    FROM (SELECT event_id AS id_product, CAST(event_id % 4 + 1 AS INTEGER) AS competitor_id,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CASE event_id % 4 WHEN 2 THEN 'https://c3.example.com/item_' ||
      CAST(event_id AS VARCHAR) || '.HTM' ELSE 'https://c' || CAST(event_id % 4 + 1 AS VARCHAR) || '.example.com/p' ||
      CAST(event_id AS VARCHAR) || '/x' END AS url FROM events))""".replace(
        "replace(substr(url, 1, position('.example.com' IN url) + 11), 'c', 'C')",
        "'https://C' || CAST(competitor_id AS VARCHAR) || '.example.com'",
    ),
)
def _(spark, sf):
    """Redirects to a catalogue page of the same host (case differs), to another host, or none; every fifth page
    is a challenge page."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("int")
    key = F.col("event_id")
    no = (key % 4 + 1).cast("int")
    url = F.when(key % 4 == 2, F.concat(F.lit("https://c3.example.com/item_"), key.cast("string"), F.lit(".HTM"))).otherwise(
        F.concat(F.lit("https://c"), no.cast("string"), F.lit(".example.com/p"), key.cast("string"), F.lit("/x"))
    )
    fetches = fx.table(spark, sf, "events").select(
        key.alias("id_product"), no.alias("competitor_id"), url.alias("url"), k.alias("k")
    )
    target = (
        F.when(F.col("k") % 3 == 0, F.col("url"))
        .when(F.col("k") % 3 == 1, F.concat(F.lit("https://C"), F.col("competitor_id").cast("string"), F.lit(".example.com/catalogue")))
        .otherwise("https://other.example.com/home")
    )
    fetches = fetches.withColumns(
        {"final_url": target, "html": F.when(F.col("k") % 5 == 0, "<title>Just a moment...</title>").otherwise("<p>x</p>")}
    )
    return R.gone_redirects(fetches, fx.competitors(spark))


@query(
    "i13_image_repairs",
    with_ci("""SELECT id_product, competitor_id, competitor_image_url, CASE WHEN p_size % 8 = 0 THEN '' ELSE 'https://img/' ||
        CAST(id_product AS VARCHAR) END AS new_image_url, CASE WHEN p_size % 8 = 0 THEN 'failed' ELSE 'updated' END AS action
      FROM tests JOIN part ON p_partkey = id_product WHERE validation_status = 'pending' AND competitor_page_status = 'ok'
        AND competitor_image_url = '' AND competitor_id IN (3, 4)"""),
)
def _(spark, sf):
    tests = fx.tests(spark, sf)
    found = (
        tests.select("id_product", "competitor_id")
        .join(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id_product"), "p_size"), "id_product")
        .select(
            "id_product",
            "competitor_id",
            F.when(F.col("p_size") % 8 == 0, "")
            .otherwise(F.concat(F.lit("https://img/"), F.col("id_product").cast("string")))
            .alias("image_url"),
        )
    )
    return R.image_repairs(tests, TARGETS, found)


# --- categories and images ----------------------------------------------------------------------------


@query(
    "m30_category_paths",
    with_ci("SELECT id_category, category_path FROM cat_paths", CATEGORIES, recursive=True),
)
def _(spark, sf):
    return W.category_paths(fx.categories(spark, sf))


@query("m31_main_images", with_ci("SELECT id_product, id_image FROM main_image", IMAGES))
def _(spark, sf):
    images = fx.images(spark, sf)
    return W.main_images(images, fx.image_shop(images))
