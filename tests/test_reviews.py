"""Change sets against a plain sequential replay of the same events, with small scan chunks."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from retailweave import fixtures as fx
from retailweave.operators import reviews as R
from retailweave.operators.scan import previous_values, run_length
from retailweave.streaming import flows

PAIR = R.PAIR
T0 = dt.datetime(2001, 1, 1)


def test_scans_equal_a_plain_loop(spark):
    rng = random.Random(3)
    events = [(rng.choice("aab"), i, rng.choice([None, "x", "y"]), rng.random() < 0.6) for i in range(300)]
    df = spark.createDataFrame(events, "k string, seq long, v string, hit boolean")
    out = previous_values(df, ["k"], "seq", {"prev": F.col("v")}, chunk_rows=17)
    out = run_length(out, ["k"], "seq", F.col("hit"), F.lit(2), "run", chunk_rows=17)
    got = {r["seq"]: (r["prev"], r["run"]) for r in out.collect()}
    last, run = {}, {"a": 2, "b": 2}
    for k, i, v, hit in events:
        run[k] = run[k] + 1 if hit else 0
        assert got[i] == (last.get(k), run[k])
        last[k] = v or last.get(k)


def make_tests(spark, rows):
    data = [(p, c, "error", "u", status, 50, T0) for p, c, status in rows]
    return spark.createDataFrame(
        data, "id_product long, competitor_id int, result string, url string, validation_status string, score int, last_tested_at timestamp_ntz"
    )


def test_merge_equals_replay(spark):
    rng = random.Random(11)
    stored = {(p, 1): s for p, s in ((1, "pending"), (2, "valid"), (3, "pending"))}
    events = []
    for i in range(400):
        events.append((i, rng.randrange(0, 5), 1, rng.choice(["matched", "pending", ""]), rng.choice(["u", " "]), rng.choice([None, 10, 29, 30, 89, 90, 95]), T0))
    incoming = spark.createDataFrame(events, "seq long, id_product long, competitor_id int, result string, url string, score int, tested_at timestamp_ntz")
    tests = make_tests(spark, [(p, c, s) for (p, c), s in stored.items()])

    state, actions = dict(stored), {}
    for seq, p, c, result, url, score, _ in events:
        key = (p, c)
        if p <= 0 or result == "":
            actions[seq] = "ignored"
        elif score is not None and score < 30:
            actions[seq] = "updated" if state.get(key) == "pending" else "ignored"
            if state.get(key) == "pending":
                del state[key]
        else:
            actions[seq] = "updated" if key in state else "inserted"
            state[key] = "valid" if result == "matched" and (score or 0) >= 90 else "pending" if url.strip() else "ignored"

    got = {(r["id_product"], r["competitor_id"]): r["validation_status"] for r in R.merge_test_results(tests, incoming).collect()}
    assert got == state
    acted = {r["seq"]: r["action"] for r in R.test_actions(tests, incoming, chunk_rows=23).collect()}
    assert acted == actions


def make_finals(spark, rows):
    data = [(p, 1, u, None, None, run, None, None) for p, u, run in rows]
    return spark.createDataFrame(
        data,
        "id_product long, competitor_id int, url string, competitor_price decimal(12,2), last_http_status int,"
        " consecutive_http_failures int, created_at timestamp_ntz, updated_at timestamp_ntz",
    )


def replay(finals, events, threshold=3):
    state = {p: dict(url=u, run=run, status=None, price=None, fails=0, dead=False) for p, u, run in finals}
    for _, p, url, status, price in events:
        s = state.get(p)
        if s is None or s["dead"]:
            continue
        if price is not None:
            s.update(url=url, run=0, status=None, price=price)
        elif url == s["url"]:
            s["fails"] += 1
            s["status"] = status
            s["run"] = s["run"] + 1 if status in (404, 410) else 0
            s["dead"] = s["run"] >= threshold
    return {p: (s["url"], s["run"], s["status"], s["fails"], s["dead"]) for p, s in state.items()}


def health_events(spark, n, seed):
    rng = random.Random(seed)
    events = []
    for i in range(n):
        price = round(rng.random() * 100, 2) if rng.random() < 0.15 else None
        status = None if price is not None else rng.choice([404, 404, 410, 500])
        events.append((i, rng.choice([1, 1, 1, 2, 3, 9]), rng.choice(["u", "u", "u", "w"]), status, price))
    rows = [(i, p, 1, u, s, pr, T0 + dt.timedelta(seconds=i)) for i, p, u, s, pr in events]
    schema = "seq long, id_product long, competitor_id int, url string, http_status int, price double, event_at timestamp_ntz"
    return events, spark.createDataFrame(rows, schema)


FINALS = [(1, "u", 0), (2, "u", 2), (3, "w", 1), (4, "u", 1)]


def test_url_health_equals_replay(spark):
    for seed in (1, 2, 3):
        events, df = health_events(spark, 60, seed)
        health = R.url_health(make_finals(spark, FINALS), df, chunk_rows=7)
        got = {
            r["id_product"]: (r["url"], r["consecutive_http_failures"], r["last_http_status"], r["failures"], r["removed"])
            for r in health.collect()
        }
        assert got == replay(FINALS, events)


def test_streamed_health_equals_replay(spark, tmp_path):
    events, df = health_events(spark, 80, 7)
    source = str(tmp_path / "in")
    for part in range(4):  # files in arrival order, one micro-batch each
        df.where(F.floor(F.col("seq") / 20) == part).coalesce(1).write.mode("append").parquet(source)
    finals = make_finals(spark, FINALS)
    stream = flows.read_stream(spark, source, df.schema, files_per_trigger=1)
    flows.stream_url_health(stream, finals, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {
        r["id_product"]: (r["url"], r["consecutive_http_failures"], r["last_http_status"], r["failures"], r["removed"])
        for r in flows.health_state(spark, finals, str(tmp_path / "out")).collect()
    }
    assert got == replay(FINALS, events)


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    seen = fx.url_events(spark, sf).where("price IS NOT NULL").withColumnRenamed("event_at", "observed_at")
    source = str(tmp_path / "in")
    seen.repartitionByRange(3, "seq").sortWithinPartitions("seq").write.parquet(source)
    stream = flows.read_stream(spark, source, seen.schema, files_per_trigger=1)
    flows.stream_recent_scrapes(stream, str(tmp_path / "out"), str(tmp_path / "cp"), late="60 days")
    keys = ["window_start", "window_end", "competitor_id"]
    got = flows.latest_version(spark, str(tmp_path / "out"), keys).select(*keys, "n")
    want = flows.scrape_windows(seen.withColumn("observed_at", F.col("observed_at").cast("timestamp"))).select(*keys, "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_domains(spark):
    rows = spark.createDataFrame(
        [("https://www.Shop.com/a", "shop.com"), ("https://shop.com", "Shop.com"), ("https://evilshop.com/", "shop.com"), ("nope", "shop.com")],
        "u string, d string",
    )
    assert [r[0] for r in rows.select(R.on_domain("u", "d")).collect()] == [True, True, False, False]


def test_review_sequences(spark):
    tests = spark.createDataFrame(
        [(1, 1, "u1", 5.0, "pending"), (2, 1, "u2", None, "pending"), (3, 1, "u3", 7.0, "pending")],
        "id_product long, competitor_id int, url string, competitor_price double, validation_status string",
    ).withColumn("competitor_price", F.col("competitor_price").cast("decimal(12,2)"))
    history = spark.createDataFrame([(1, 1, "u1", T0), (1, 3, "u3", T0)], "competitor_id int, id_product long, url string, observed_at timestamp_ntz")
    history = history.select("competitor_id", "id_product", "url", F.lit(1).cast("decimal(12,2)").alias("price"), F.lit("seed").alias("source"), "observed_at")
    state = R.ReviewState(tests, make_finals(spark, [(1, "old", 0), (3, "u3", 0)]), history, spark.createDataFrame([], "competitor_id int, url string"))
    decisions = spark.createDataFrame(
        [(1, 1, 1, "valid", T0), (2, 1, 1, "rejected", T0), (3, 1, 1, "valid", T0), (4, 2, 1, "valid", T0), (5, 3, 1, "rejected", T0), (6, 9, 1, "valid", T0), (7, 3, 1, "postponed", T0)],
        "seq long, id_product long, competitor_id int, status string, decided_at timestamp_ntz",
    )
    out = R.apply_reviews(state, decisions)
    assert {r["id_product"]: r["validation_status"] for r in out.tests.collect()} == {1: "valid", 2: "valid", 3: "postponed"}
    assert {(r["id_product"], r["url"], r["competitor_price"]) for r in out.finals.collect()} == {(1, "u1", 5), (2, "u2", None)}
    assert sorted((r["id_product"], r["source"]) for r in out.history.collect()) == [(1, "review")]
    assert {r["url"] for r in out.rejected.collect()} == {"u1", "u3"}


def test_search_text_may_hold_anything(spark):
    from retailweave.operators import feed as feeds
    from retailweave.operators.filters import Filters, like_pattern, search_predicate

    assert like_pattern("a\\b") == "%a\\\\b%" and like_pattern("5\\%") == "%5\\%%" and like_pattern("a\\") == "%a\\\\%"
    rows = spark.createDataFrame([("a\\b",), ("ab",), ("5%",), ("56",)], "product_name string")
    hit = lambda needle: [r[0] for r in rows.where(search_predicate(needle, ("product_name",))).collect()]
    assert hit("a\\b") == ["a\\b"] and hit("5\\%") == ["5%"] and hit("5%") == ["5%", "56"] and hit("\\") == ["a\\b"]
    for brand, want in (("--5", None), ("-5", -5), ("\u00b2", None), ("9" * 30, None), (" 7 ", 7)):
        assert Filters.from_raw({"brand_id": brand}, dt.date(2001, 8, 1)).brand_id == want
    columns = "id_product long, reference string, ean13 string, manufacturer_name string, product_name string, price_tax_incl double"
    feed = spark.createDataFrame([(7, "a\\b", "", "", "n", 1.0)], columns)
    for needle, want in (("\u00b2", 0), ("a\\b", 1), ("7", 1), ("9" * 40, 0), ("\\", 1)):
        assert feeds.search_products(feed, needle).count() == want


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from retailweave import session

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://x:1", applicationId="a", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError):
        session.shared_root(SimpleNamespace(sparkContext=context, conf=conf))


def test_gone_redirects_mark_the_pages(spark):
    tests = spark.createDataFrame([(1, 4, "ok"), (2, 4, "ok"), (1, 3, "gone")], "id_product long, competitor_id int, competitor_page_status string")
    found = spark.createDataFrame([(1, 4, True), (1, 4, True), (2, 4, False)], "id_product long, competitor_id int, gone boolean")
    got = sorted(map(tuple, R.mark_gone_redirects(tests, found).collect()))
    assert got == [(1, 3, "gone"), (1, 4, "gone"), (2, 4, "ok")]


def test_kept_last_observations_give_the_same_work_list(spark, sf):
    from retailweave.operators import feed as feeds

    history, finals, shops = fx.price_history(spark, sf), fx.finals(spark, sf), fx.competitors(spark)
    early = F.col("observed_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    known = feeds.merge_last_observed(feeds.last_observed(history.where(early)), history.where(~early))
    a = feeds.price_worklist(finals, shops, history, 4, after_id=300, limit=100).collect()
    assert a and a == feeds.price_worklist(finals, shops, history.limit(0), 4, after_id=300, limit=100, known=known).collect()


def test_price_counters_work_health_out_once(spark):
    worked_out = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def removed(n):
        worked_out.add(1)
        return n > 1

    pairs = spark.createDataFrame([(1, 1), (2, 1)], "id_product long, competitor_id int")
    events = spark.createDataFrame([(1, 1, "u", 2.0, None), (3, 1, "u", 2.0, None)], "id_product long, competitor_id int, url string, price double, http_status int")
    health = pairs.withColumns({"observations": F.col("id_product"), "failures": F.lit(0).cast("long")})
    rows = R.price_counters(pairs, pairs, events, health.withColumn("removed", removed("observations"))).collect()
    assert {(r["counter"], r["reason"]): r["n"] for r in rows}[("ignored", "no final url")] == 1
    assert worked_out.value == 2
