"""Test results, reviews and url health as table-level change sets.

Every job takes the current tables and a batch in arrival order (`seq`) and returns new tables and actions.
Final states come from mergeable aggregates (largest `seq` of a kind), so a hot pair is combined before the
shuffle; only the per-event action labels need an ordered scan, which is chunked (see `scan`).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..session import written
from ..sources.incremental import ensure_columns, latest_per_key, upsert
from ..sources.observations import append_observations, decimal_price, delete_observations, valid_observations
from .scan import previous_values, run_length

# Thresholds and text lengths.
SCORE_FLOOR = 30
VALID_SCORE = 90
CANDIDATE_FINAL_SCORE = 90
IMAGE_CONFIDENCE = 70
GONE_STATUSES = (404, 410)
GONE_AFTER = 3
MANUAL_SCORE = 100
MANUAL_QUERY, MANUAL_MESSAGE = "manual", "Ajout manuel depuis la recherche"
LENGTHS = {
    "url": 2048,
    "competitor_title": 255,
    "competitor_brand": 255,
    "competitor_image_url": 2048,
    "competitor_breadcrumb": 1024,
    "matched_query": 255,
    "message": 255,
}
REVIEW_DECISIONS = ("postponed", "valid", "rejected")
CANDIDATE_STATUSES = ("pending", "valid", "rejected")

PAIR = ["id_product", "competitor_id"]


def clipped(name: str, length: int) -> Column:
    """Trimmed text cut to the column length, null when blank."""
    return F.substring(L.nullable_trim(name), 1, length)


def page_status(col: Column | str) -> Column:
    return F.when(F.lower(F.trim(col)) == "gone", "gone").otherwise("ok")


def derive_review(result: Column | str, score: Column | str, url: Column | str) -> Column:
    """Matched with a high score is valid, anything else with a url waits for review."""
    result, score = (F.col(c) if isinstance(c, str) else c for c in (result, score))
    return (
        F.when((result == "matched") & (score >= VALID_SCORE), "valid")
        .when(L.nullable_trim(url).isNotNull(), "pending")
        .otherwise("ignored")
    )


# --- test results -------------------------------------------------------------------------------------


def prepare_tests(incoming: DataFrame) -> DataFrame:
    """Cleans incoming tests and tells their kind: invalid, low (below the score floor) or upsert."""
    wanted = {c: "string" for c in [*LENGTHS, "competitor_page_status", "competitor_price"]}
    rows = ensure_columns(incoming, wanted)
    valid = (F.coalesce("id_product", F.lit(0)) > 0) & (F.coalesce("result", F.lit("")) != "")
    return rows.withColumns(
        {
            "kind": F.when(~valid, "invalid").when(F.col("score") < SCORE_FLOOR, "low").otherwise("upsert"),
            "validation_status": derive_review("result", "score", "url"),
            "competitor_page_status": page_status("competitor_page_status"),
            "competitor_price": decimal_price("competitor_price"),
            **{name: clipped(name, length) for name, length in LENGTHS.items()},
        }
    )


def merge_test_results(tests: DataFrame, incoming: DataFrame) -> DataFrame:
    """Tests after the batch.

    The last upsert of a pair (or else the stored row) stands; it is dropped when it is pending and a low score
    arrived after it.
    """
    events = prepare_tests(incoming).where("kind <> 'invalid'")
    columns = [c for c in tests.columns if c not in PAIR]
    payload = F.struct(*[(F.col("tested_at") if c == "last_tested_at" else F.col(c)).alias(c) for c in columns])
    is_upsert = F.col("kind") == "upsert"
    batch = events.groupBy(*PAIR).agg(
        F.max_by(payload, F.when(is_upsert, F.col("seq"))).alias("new"),
        F.max(F.when(is_upsert, F.col("seq"))).alias("up_seq"),
        F.max(F.when(~is_upsert, F.col("seq"))).alias("low_seq"),
    )
    stored = tests.select(*PAIR, F.struct(*columns).alias("old"))
    merged = stored.join(batch, PAIR, "full_outer").withColumn(
        "row", F.when(F.col("up_seq").isNotNull(), F.col("new")).otherwise(F.col("old"))
    )
    dropped = (F.col("row.validation_status") == "pending") & (
        F.col("low_seq") > F.coalesce("up_seq", F.lit(-1))
    )
    kept = merged.where(F.col("row").isNotNull() & ~F.coalesce(dropped, F.lit(False)))
    return kept.select(*[F.col(c) if c in PAIR else F.col(f"row.{c}").alias(c) for c in tests.columns])


def test_actions(tests: DataFrame, incoming: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Every incoming test with its action: inserted, updated (a pending row removed by a low score counts as
    updated) or ignored."""
    events = prepare_tests(incoming).select(*PAIR, "seq", "kind", "validation_status")
    scan = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    live = events.where("kind <> 'invalid'")
    up = F.when(F.col("kind") == "upsert", F.struct("validation_status", "seq"))
    low = F.when(F.col("kind") == "low", F.col("seq"))
    live = previous_values(live, PAIR, "seq", {"prev_up": up, "prev_low": low}, **scan)
    live = live.join(tests.select(*PAIR, F.col("validation_status").alias("stored")), PAIR, "left")
    status = F.coalesce("prev_up.validation_status", "stored")
    removed = (status == "pending") & (F.col("prev_low") > F.coalesce("prev_up.seq", F.lit(-1)))
    exists = status.isNotNull() & ~F.coalesce(removed, F.lit(False))
    action = (
        F.when(F.col("kind") == "upsert", F.when(exists, "updated").otherwise("inserted"))
        .when(exists & (status == "pending"), "updated")
        .otherwise("ignored")
    )
    invalid = events.where("kind = 'invalid'").select(*PAIR, "seq", "kind", F.lit("ignored").alias("action"))
    return live.select(*PAIR, "seq", "kind", action.alias("action")).unionByName(invalid)


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("action").agg(F.count("*").alias("n"))


def promotions(incoming: DataFrame) -> DataFrame:
    """Incoming tests that settle a final url."""
    return prepare_tests(incoming).where(
        (F.col("kind") == "upsert") & (F.col("result") == "matched") & (F.col("score") >= VALID_SCORE) & F.col("url").isNotNull()
    )


def upsert_finals(finals: DataFrame, settled: DataFrame, at: str = "at") -> DataFrame:
    """Final urls after the settled rows (id_product, competitor_id, url, competitor_price, seq, `at`): last url,
    last known price; the old price stays when no new one is known."""
    priced = F.col("competitor_price").isNotNull()
    batch = settled.groupBy(*PAIR).agg(
        F.max_by("url", "seq").alias("n_url"),
        F.max_by("competitor_price", F.when(priced, F.col("seq"))).alias("n_price"),
        F.min(at).alias("n_first"),
        F.max(at).alias("n_last"),
    )
    values = {
        "url": F.coalesce("n_url", "url"),
        "competitor_price": F.coalesce("n_price", "competitor_price"),
        "consecutive_http_failures": F.coalesce("consecutive_http_failures", F.lit(0)),
        "created_at": F.coalesce("created_at", "n_first"),
        "updated_at": F.coalesce("n_last", "updated_at"),
    }
    merged = finals.join(batch, PAIR, "full_outer")
    return merged.select(*[values.get(c, F.col(c)).alias(c) for c in finals.columns])


def promote_finals(finals: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finals, new price observations)."""
    rows = promotions(incoming).withColumn("at", F.col("tested_at"))
    observed = valid_observations(
        rows.select(
            "competitor_id",
            "id_product",
            "url",
            F.col("competitor_price").alias("price"),
            F.lit("test_result").alias("source"),
            F.col("at").alias("observed_at"),
        )
    )
    return upsert_finals(finals, rows), observed


# --- prices and url health ----------------------------------------------------------------------------


def ingest_prices(finals: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Price observations of known final urls: last one sets url and price and clears the failure state.
    Returns (finals, accepted observations)."""
    accepted = valid_observations(observations).join(finals.select(*PAIR), PAIR, "left_semi")
    batch = accepted.groupBy(*PAIR).agg(
        F.max_by(F.struct(F.trim("url").alias("url"), "price"), "seq").alias("n"), F.max("event_at").alias("n_at")
    )
    hit = F.col("n").isNotNull()
    values = {
        "url": F.coalesce("n.url", "url"),
        "competitor_price": F.coalesce("n.price", "competitor_price"),
        "consecutive_http_failures": F.when(hit, 0).otherwise(F.col("consecutive_http_failures")),
        "last_http_status": F.when(~hit, F.col("last_http_status")),
        "last_http_error_at": F.when(~hit, F.col("last_http_error_at")),
        "last_http_error_message": F.when(~hit, F.col("last_http_error_message")),
        "updated_at": F.coalesce("n_at", "updated_at"),
    }
    merged = finals.join(batch, PAIR, "left")
    out = merged.select(*[values.get(c, F.col(c)).alias(c) for c in finals.columns])
    history = accepted.select(
        "competitor_id",
        "id_product",
        F.trim("url").alias("url"),
        "price",
        F.lit("final_price").alias("source"),
        F.col("event_at").alias("observed_at"),
    )
    return out, history


def usable_event() -> Column:
    """An event that names a product and a url, and has a price or a status."""
    named = (F.col("id_product") > 0) & (F.trim(F.coalesce("url", F.lit(""))) != "")
    return F.coalesce(named, F.lit(False)) & (F.col("price").isNotNull() | F.col("http_status").isNotNull())


def price_counters(finals: DataFrame, tests: DataFrame, events: DataFrame, health: DataFrame) -> DataFrame:
    """(counter, reason, n) of a price and failure log, given its `url_health`.

    Counters are inserted (never: prices only touch known urls), updated, failures, removed, gone and ignored, this one
    with its reasons: invalid events, no final url, or a url that was replaced or removed before.
    """
    spark = finals.sparkSession
    read = events.agg(F.count(F.lit(1)).alias("all"), F.count_if(usable_event()).alias("usable")).first()
    health = written(spark, health.select(*PAIR, "observations", "failures", "removed"), "url-health")  # a row per final url
    known = events.where(usable_event()).join(health.select(*PAIR), PAIR, "left_semi").count()
    done = health.agg(
        F.sum("observations").alias("updated"), F.sum("failures").alias("failures"), F.count_if("removed").alias("removed")
    ).first()
    gone = health.where("removed").join(tests.select(*PAIR), PAIR, "left_semi").count()
    updated, failures = done["updated"] or 0, done["failures"] or 0
    rows = [
        ("inserted", "", 0),
        ("updated", "", updated),
        ("failures", "", failures),
        ("removed", "", done["removed"]),
        ("gone", "", gone),
        ("ignored", "invalid", read["all"] - read["usable"]),
        ("ignored", "no final url", read["usable"] - known),
        ("ignored", "url replaced or removed", known - updated - failures),
    ]
    return spark.createDataFrame(rows, "counter string, reason string, n bigint")


def url_health(
    finals: DataFrame, events: DataFrame, threshold: int = GONE_AFTER, chunk_rows: int | None = None
) -> DataFrame:
    """Final urls after a log of price observations and fetch failures.

    A failure counts only against the current url (the last observed one, else the stored one). Status 404 or 410
    adds one, any other failure and every observation starts again at 0. The run that reaches `threshold` removes
    the final url, and later events of the pair find nothing. Time and message (`event_at`, `error`) of the last
    failure stay until an observation clears them.
    """
    events = ensure_columns(events, {"event_at": "timestamp", "error": "string"})
    at_type = events.schema["event_at"].dataType.simpleString()
    finals = ensure_columns(finals, {"last_http_error_at": at_type, "last_http_error_message": "string"})
    scan = {} if chunk_rows is None else {"chunk_rows": chunk_rows}
    stored = finals.select(
        *PAIR,
        F.col("url").alias("stored_url"),
        F.col("competitor_price").alias("stored_price"),
        F.col("consecutive_http_failures").alias("stored_run"),
        F.col("last_http_status").alias("stored_status"),
        F.col("last_http_error_at").cast(at_type).alias("stored_error_at"),
        F.col("last_http_error_message").alias("stored_error"),
    )
    log = events.where(usable_event()).join(stored, PAIR)
    observed = F.col("price").isNotNull()
    log = previous_values(log, PAIR, "seq", {"seen_url": F.when(observed, F.trim("url"))}, **scan)
    log = log.where(observed | (F.trim("url") == F.coalesce("seen_url", "stored_url")))

    gone = F.coalesce(~observed & F.col("http_status").isin(*GONE_STATUSES), F.lit(False))
    log = run_length(log, PAIR, "seq", gone, F.col("stored_run"), "run", **scan)

    end = log.where(F.col("run") >= threshold).groupBy(*PAIR).agg(F.min("seq").alias("end_seq"))
    log = log.join(end, PAIR, "left").where(F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    last = log.groupBy(*PAIR).agg(
        F.max_by(
            F.struct(
                "run",
                "http_status",
                F.when(~observed, F.col("event_at")).alias("error_at"),
                F.when(~observed, clipped("error", LENGTHS["message"])).alias("error"),
            ),
            "seq",
        ).alias("last"),
        F.max_by(F.struct(F.trim("url").alias("url"), "price"), F.when(observed, F.col("seq"))).alias("obs"),
        F.count_if(~observed).alias("failures"),
        F.count_if(observed).alias("observations"),
        F.max(F.col("end_seq").isNotNull()).alias("removed"),
    )
    return stored.join(last, PAIR, "left").select(
        *PAIR,
        F.coalesce("obs.url", "stored_url").alias("url"),
        F.coalesce("obs.price", "stored_price").alias("competitor_price"),
        F.coalesce("last.run", "stored_run").alias("consecutive_http_failures"),
        F.when(F.col("last").isNotNull(), F.col("last.http_status")).otherwise(F.col("stored_status")).alias("last_http_status"),
        F.when(F.col("last").isNotNull(), F.col("last.error_at")).otherwise(F.col("stored_error_at")).alias("last_http_error_at"),
        F.when(F.col("last").isNotNull(), F.col("last.error")).otherwise(F.col("stored_error")).alias("last_http_error_message"),
        F.coalesce("observations", F.lit(0)).alias("observations"),
        F.coalesce("failures", F.lit(0)).alias("failures"),
        F.coalesce("removed", F.lit(False)).alias("removed"),
    )


HEALTH_COLUMNS = (
    "url", "competitor_price", "consecutive_http_failures", "last_http_status", "last_http_error_at", "last_http_error_message",
)


def apply_url_health(finals: DataFrame, tests: DataFrame, health: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(finals without the removed ones, tests with their pages marked gone)."""
    keep = health.where("NOT removed").select(
        *PAIR,
        *[F.col(c).alias(f"n_{c}") for c in HEALTH_COLUMNS],
    )
    new_finals = finals.join(keep, PAIR).select(
        *[F.col(f"n_{c}").alias(c) if f"n_{c}" in keep.columns else F.col(c) for c in finals.columns]
    )
    dead = health.where("removed").select(*PAIR, F.lit("gone").alias("n_status"))
    status = F.coalesce("n_status", "competitor_page_status").alias("competitor_page_status")
    new_tests = tests.join(dead, PAIR, "left").select(
        *[status if c == "competitor_page_status" else F.col(c) for c in tests.columns]
    )
    return new_finals, new_tests


# --- human decisions ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ReviewState:
    tests: DataFrame
    finals: DataFrame
    history: DataFrame
    rejected: DataFrame


def apply_reviews(state: ReviewState, decisions: DataFrame) -> ReviewState:
    """Decisions (id_product, competitor_id, status, seq, decided_at) on known tests, in arrival order.

    valid: final url and a `review` observation; rejected: no final, no history of the url, url remembered as
    rejected; postponed: status only.
    """
    known = decisions.where(F.col("status").isin(*REVIEW_DECISIONS)).join(
        state.tests.select(*PAIR, "url", "competitor_price"), PAIR
    )
    is_valid, is_rejected = F.col("status") == "valid", F.col("status") == "rejected"
    summary = known.groupBy(*PAIR).agg(
        F.max_by("status", "seq").alias("new_status"),
        F.max_by("status", F.when(is_valid | is_rejected, F.col("seq"))).alias("verdict"),
        F.max(F.when(is_rejected, F.col("seq"))).alias("rejected_seq"),
    )
    tests = state.tests.join(summary.select(*PAIR, "new_status"), PAIR, "left").select(
        *[
            F.coalesce("new_status", "validation_status").alias(c) if c == "validation_status" else F.col(c)
            for c in state.tests.columns
        ]
    )

    settled = (
        known.where(is_valid)
        .join(summary.where("verdict = 'valid'").select(*PAIR, "rejected_seq"), PAIR)
        .where("rejected_seq IS NULL OR seq > rejected_seq")
        .withColumns({"at": F.col("decided_at"), "url": F.coalesce("url", F.lit(""))})
    )
    wiped = summary.where("rejected_seq IS NOT NULL").select(*PAIR)
    finals = upsert_finals(state.finals.join(wiped, PAIR, "left_anti"), settled)

    urls = known.where(is_rejected).select("competitor_id", "id_product", "url").distinct()
    history = delete_observations(state.history, urls)
    review_rows = settled.select(
        "competitor_id",
        "id_product",
        "url",
        F.col("competitor_price").alias("price"),
        F.lit("review").alias("source"),
        F.col("at").alias("observed_at"),
    )
    return ReviewState(
        tests, finals, append_observations(history, review_rows), remember_rejected(state.rejected, urls)
    )


def remember_rejected(rejected: DataFrame, urls: DataFrame) -> DataFrame:
    """Insert-ignore on (competitor, url)."""
    new = urls.select("competitor_id", L.nullable_trim("url").alias("url")).where(F.col("url").isNotNull())
    return rejected.select("competitor_id", "url").unionByName(new).distinct()


def restore_rejected(state: ReviewState, picked: DataFrame) -> ReviewState:
    """Picked pairs (with seq, decided_at) become valid again: final url back, url no longer rejected."""
    rows = picked.join(state.tests.select(*PAIR, "url", "competitor_price"), PAIR).withColumns(
        {"at": F.col("decided_at"), "url": F.coalesce("url", F.lit(""))}
    )
    hit = rows.select(*PAIR).distinct().withColumn("hit", F.lit(True))
    tests = state.tests.join(hit, PAIR, "left").select(
        *[
            F.when(F.col("hit"), "valid").otherwise(F.col(c)).alias(c) if c == "validation_status" else F.col(c)
            for c in state.tests.columns
        ]
    )
    review_rows = rows.select(
        "competitor_id",
        "id_product",
        "url",
        F.col("competitor_price").alias("price"),
        F.lit("review").alias("source"),
        F.col("at").alias("observed_at"),
    )
    urls = rows.select("competitor_id", F.trim("url").alias("url"))
    return ReviewState(
        tests,
        upsert_finals(state.finals, rows),
        append_observations(state.history, review_rows),
        state.rejected.join(urls, ["competitor_id", "url"], "left_anti"),
    )


def on_domain(url: Column | str, domain: Column | str) -> Column:
    """The url's host is the domain or one of its sub-domains."""
    host = F.lower(F.try_parse_url(F.col(url) if isinstance(url, str) else url, F.lit("HOST")))
    base = F.lower(F.col(domain) if isinstance(domain, str) else domain)
    return F.coalesce((host == base) | F.endswith(host, F.concat(F.lit("."), base)), F.lit(False))


def add_manual_matches(
    state: ReviewState, entries: DataFrame, competitors: DataFrame
) -> tuple[ReviewState, DataFrame]:
    """Hand-entered urls (id_product, competitor_id, url, title, price, seq, entered_at); the last per pair wins.
    Returns the new state and the entries refused because the url is not on the competitor's domain."""
    checked = entries.join(competitors.select(F.col("id").alias("competitor_id"), "domain"), "competitor_id").withColumn(
        "ok", on_domain("url", "domain")
    )
    rows = latest_per_key(checked.where("ok"), PAIR, [F.col("seq").desc()])
    stored = state.tests.select(
        *PAIR, F.col("competitor_title").alias("o_title"), F.col("competitor_price").alias("o_price")
    )
    rows = rows.join(stored, PAIR, "left").select(
        *PAIR,
        F.lit("matched").alias("result"),
        "url",
        F.coalesce(L.nullable_trim("title"), "o_title").alias("competitor_title"),
        F.lit("ok").alias("competitor_page_status"),
        F.lit(MANUAL_SCORE).alias("score"),
        F.coalesce(decimal_price("price"), "o_price").alias("competitor_price"),
        F.lit("valid").alias("validation_status"),
        F.lit(MANUAL_QUERY).alias("matched_query"),
        F.lit(MANUAL_MESSAGE).alias("message"),
        F.col("entered_at").alias("last_tested_at"),
    )
    untouched = ["competitor_brand", "competitor_image_url", "competitor_breadcrumb"]
    tests = upsert(state.tests, rows, PAIR, keep_from_target=[c for c in untouched if c in state.tests.columns])
    final_rows = rows.select(
        *PAIR,
        "url",
        "competitor_price",
        F.lit(None).cast("int").alias("last_http_status"),
        F.lit(0).alias("consecutive_http_failures"),
        F.col("last_tested_at").alias("created_at"),
        F.col("last_tested_at").alias("updated_at"),
    )
    finals = upsert(state.finals, final_rows, PAIR, keep_from_target=["created_at"])
    observed = rows.select(
        "competitor_id",
        "id_product",
        "url",
        F.col("competitor_price").alias("price"),
        F.lit("manual").alias("source"),
        F.col("last_tested_at").alias("observed_at"),
    )
    new_state = ReviewState(tests, finals, append_observations(state.history, observed), state.rejected)
    return new_state, checked.where("NOT ok").drop("ok", "domain")


# --- candidates ---------------------------------------------------------------------------------------


def drop_rejected(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    return candidates.join(rejected.select("competitor_id", "url"), ["competitor_id", "url"], "left_anti")


CANDIDATE = ["id_product", "competitor_id", "url"]


def accepted_candidates(candidates: DataFrame, incoming: DataFrame, rejected: DataFrame) -> DataFrame:
    """Incoming candidates that take effect: usable, url not rejected, and the candidate itself not rejected,
    neither before the batch nor earlier in it."""
    rows = incoming.withColumn("url", F.trim("url")).where((F.col("id_product") > 0) & (F.col("url") != ""))
    rows = drop_rejected(rows, rejected).withColumns(
        {
            "raw_status": F.col("status"),
            "status": F.when(F.col("status").isin(*CANDIDATE_STATUSES), F.col("status")).otherwise("pending"),
        }
    )
    rows = rows.join(candidates.where("status = 'rejected'").select(*CANDIDATE), CANDIDATE, "left_anti")
    turned = rows.where("status = 'rejected'").groupBy(*CANDIDATE).agg(F.min("seq").alias("rejected_seq"))
    return rows.join(turned, CANDIDATE, "left").where("rejected_seq IS NULL OR seq <= rejected_seq").drop("rejected_seq")


def merge_candidates(
    candidates: DataFrame, finals: DataFrame, incoming: DataFrame, rejected: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(candidates, finals): last accepted values per candidate; per product the best candidate that is above the
    score or valid becomes the final url (highest score, latest on ties)."""
    rows = accepted_candidates(candidates, incoming, rejected)
    values = [c for c in candidates.columns if c not in CANDIDATE]
    latest = (
        rows.groupBy(*CANDIDATE)
        .agg(F.max_by(F.struct(*values), "seq").alias("v"))
        .select(*[F.col(c) if c in CANDIDATE else F.col(f"v.{c}").alias(c) for c in candidates.columns])
    )
    merged = upsert(candidates, latest, CANDIDATE)
    best = (
        rows.where((F.col("score") > CANDIDATE_FINAL_SCORE) | (F.col("raw_status") == "valid"))
        .groupBy(*PAIR)
        .agg(F.max_by("url", F.struct("score", "seq")).alias("url"))
    )
    return merged, set_final_urls(finals, best)


def set_final_urls(finals: DataFrame, urls: DataFrame) -> DataFrame:
    """Sets the url of known finals and adds unknown ones without a price."""
    joined = finals.join(urls.select(*PAIR, F.col("url").alias("n_url")), PAIR, "full_outer")
    values = {
        "url": F.coalesce("n_url", "url"),
        "consecutive_http_failures": F.coalesce("consecutive_http_failures", F.lit(0)),
    }
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in finals.columns])


def candidate_status(
    candidates: DataFrame, tests: DataFrame, finals: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, tests, finals) after status changes (id_product, competitor_id, url, status, seq).

    The last change of a pair decides what happens to its test and final: rejected removes both, valid sets the
    final url. A rejection earlier in the batch has removed the test as well.
    """
    valid = changes.where(F.col("status").isin(*CANDIDATE_STATUSES)).join(
        candidates.select(*CANDIDATE), CANDIDATE, "left_semi"
    )
    latest = valid.groupBy(*CANDIDATE).agg(F.max_by("status", "seq").alias("n_status"))
    new_candidates = candidates.join(latest, CANDIDATE, "left").select(
        *[F.coalesce("n_status", "status").alias(c) if c == "status" else F.col(c) for c in candidates.columns]
    )
    effective = valid.where("status <> 'pending'")
    verdict = effective.groupBy(*PAIR).agg(
        F.max_by(F.struct("status", "url"), "seq").alias("last"),
        F.max(F.col("status") == "rejected").alias("any_rejected"),
    )
    rejected = verdict.where("any_rejected").select(*PAIR)
    urls = verdict.where("last.status = 'valid'").select(*PAIR, "last.url")
    return (
        new_candidates,
        tests.join(rejected, PAIR, "left_anti"),
        set_final_urls(finals.join(rejected, PAIR, "left_anti"), urls),
    )


# --- images -------------------------------------------------------------------------------------------


def image_decisions(pending: DataFrame, snapshots: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Review status of pending tests from image verdicts (id_product, competitor_id, same_product, confidence).

    No usable image on either side, no verdict or low confidence: postponed.
    """
    usable = lambda c: L.nullable_trim(c).isNotNull()
    rows = pending.join(snapshots.select("id_product", "source_image_url"), "id_product", "left").join(
        verdicts.select(*PAIR, "same_product", "confidence"), PAIR, "left"
    )
    missing = ~usable("source_image_url") | ~usable("competitor_image_url")
    outcome = (
        F.when(missing, "missing_images")
        .when(F.col("confidence").isNull(), "error")
        .when(F.col("confidence") < IMAGE_CONFIDENCE, "postponed")
        .when(F.col("same_product"), "valid")
        .otherwise("rejected")
    )
    status = F.when(F.col("outcome").isin("valid", "rejected"), F.col("outcome")).otherwise("postponed")
    return rows.withColumn("outcome", outcome).withColumn("status", status).select(*PAIR, "outcome", "status")


def image_stats(decisions: DataFrame) -> DataFrame:
    return decisions.agg(
        F.count("*").alias("processed"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("valid", "rejected", "postponed")],
        F.count_if(F.col("outcome") == "missing_images").alias("missing_images"),
        F.count_if(F.col("outcome") == "error").alias("errors"),
    )


# What a product path looks like, per site profile.
PRODUCT_PATHS = {"signature": r"/p\d+/", "tokens": r"(?i)\.htm[l]?$"}
CHALLENGE_MARK = "just a moment"


def gone_redirects(fetches: DataFrame, competitors: DataFrame) -> DataFrame:
    """Fetches (competitor_id, id_product, url, final_url, html) that were redirected, on the same host, from a
    product path to something that is not one. Challenge pages prove nothing on the `tokens` sites."""
    rows = fetches.join(competitors.select(F.col("id").alias("competitor_id"), "profile"), "competitor_id")
    url, final = F.trim("url"), F.trim("final_url")
    part = lambda u, p: F.coalesce(F.try_parse_url(u, F.lit(p)), F.lit(""))
    host_a, host_b = F.lower(part(url, "HOST")), F.lower(part(final, "HOST"))
    moved = (url != "") & (final != "") & (url != final)
    same_host = (host_a == "") | (host_b == "") | (host_a == host_b)
    lost = F.lit(False)
    for profile, pattern in PRODUCT_PATHS.items():
        here = part(url, "PATH").rlike(pattern) & ~part(final, "PATH").rlike(pattern)
        if profile == "tokens":
            here = here & ~F.lower(F.coalesce("html", F.lit(""))).contains(CHALLENGE_MARK)
        lost = lost | ((F.col("profile") == profile) & here)
    gone = F.coalesce(moved & same_host & lost, F.lit(False))
    return rows.select("competitor_id", "id_product", "url", "final_url", gone.alias("gone"))


def mark_gone_redirects(tests: DataFrame, redirects: DataFrame) -> DataFrame:
    """Tests with the page status of redirected product pages set to gone (see `gone_redirects`)."""
    dead = redirects.where("gone").select(*PAIR).distinct().withColumn("__gone", F.lit("gone"))
    status = F.coalesce("__gone", "competitor_page_status").alias("competitor_page_status")
    rows = tests.join(dead, PAIR, "left")
    return rows.select(*[status if c == "competitor_page_status" else F.col(c) for c in tests.columns])


def image_repair_set(tests: DataFrame, competitor_ids: Sequence[int]) -> DataFrame:
    """Pending tests with a live page and no image, newest first."""
    return tests.where(
        (F.col("validation_status") == "pending")
        & (F.col("competitor_page_status") == "ok")
        & L.blank_to_null("competitor_image_url").isNull()
        & F.col("competitor_id").isin(*competitor_ids)
    )


def image_repairs(tests: DataFrame, competitor_ids: Sequence[int], found: DataFrame) -> DataFrame:
    """Repair set with the image found on the page (id_product, competitor_id, image_url): updated, skipped or failed."""
    rows = image_repair_set(tests, competitor_ids).join(found.select(*PAIR, "image_url"), PAIR, "left")
    new = L.nullable_trim("image_url")
    return rows.select(
        *PAIR,
        "competitor_image_url",
        F.col("image_url").alias("new_image_url"),
        F.when(new.isNull(), "failed")
        .when(new == F.coalesce("competitor_image_url", F.lit("")), "skipped")
        .otherwise("updated")
        .alias("action"),
    )


# --- queues, lists and reports ------------------------------------------------------------------------


def without_final(tests: DataFrame, finals: DataFrame) -> DataFrame:
    return tests.join(finals.select(*PAIR), PAIR, "left_anti")


def pending_queue(tests: DataFrame, finals: DataFrame, live_pages_only: bool = True) -> DataFrame:
    rows = tests.where("validation_status = 'pending'")
    if live_pages_only:
        rows = rows.where("competitor_page_status = 'ok'")
    return without_final(rows, finals)


def pending_reviews(tests: DataFrame, finals: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    ordered = pending_queue(tests, finals).orderBy(
        F.col("score").desc(), F.col("last_tested_at").desc(), "id_product", "competitor_id"
    )
    return ordered.offset(max(0, page - 1) * size).limit(size)


def attach_test_snapshot(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """Test facts beside rows of the same product and competitor."""
    facts = tests.select(
        *PAIR, "competitor_title", "competitor_brand", "competitor_breadcrumb", "competitor_price", "score", "result"
    )
    return rows.join(facts, PAIR, "left")


def finals_with_title(finals: DataFrame, tests: DataFrame) -> DataFrame:
    titles = (
        tests.where(L.nullable_trim("competitor_title").isNotNull())
        .groupBy(*PAIR)
        .agg(F.max_by(F.trim("competitor_title"), "last_tested_at").alias("competitor_title"))
    )
    return finals.select(*PAIR, "url", "competitor_price").join(titles, PAIR, "left")


def reviews_by_product(tests: DataFrame, competitors: DataFrame, status: str) -> DataFrame:
    """Newest-first list of a product's tests with one status. A product has one test per competitor, so the list
    is no longer than the competitor table."""
    rows = tests.where(F.col("validation_status") == status).join(
        competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor")), "competitor_id", "left"
    )
    entry = F.struct("last_tested_at", "competitor_id", "competitor", "url", "competitor_title", "competitor_price", "score")
    return rows.groupBy("id_product").agg(F.sort_array(F.collect_list(entry), asc=False).alias("reviews"))


def pending_counts(tests: DataFrame, finals: DataFrame, competitors: DataFrame) -> DataFrame:
    """Pending reviews and pending reviews without an image, per competitor, zeros included."""
    counts = (
        pending_queue(tests, finals)
        .groupBy("competitor_id")
        .agg(
            F.count("*").alias("pending"),
            F.count_if(L.blank_to_null("competitor_image_url").isNull()).alias("missing_image"),
        )
    )
    return competitors.select(F.col("id").alias("competitor_id"), "name").join(counts, "competitor_id", "left").fillna(
        0, ["pending", "missing_image"]
    )


def status_counts(tests: DataFrame, finals: DataFrame) -> DataFrame:
    """Open reviews (pending, live page, no final), valid and rejected tests."""
    known = finals.select(*PAIR, F.lit(True).alias("has_final"))
    waiting = tests.where("validation_status = 'pending' AND competitor_page_status = 'ok'").join(known, PAIR, "left_anti")
    by_status = tests.where(F.col("validation_status").isin("valid", "rejected"))
    rows = waiting.select(F.lit("pending").alias("status")).unionByName(
        by_status.select(F.col("validation_status").alias("status"))
    )
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "valid", "rejected")])


def reference_prices(prices: DataFrame) -> DataFrame:
    """Newest usable price of the external reference seller per product."""
    usable = prices.where((F.col("price_ttc") > 0) & (F.col("id_product") > 0))
    return usable.groupBy("id_product").agg(
        F.max_by("price_ttc", "date_upd").alias("price"), F.max("date_upd").alias("updated_at")
    )


REPORT_COLUMNS = (
    "theoretical",
    "total",
    "matched",
    "pending",
    "postponed",
    "rejected",
    "not_found",
    "cloudflare",
    "search_input_not_found",
    "error",
)


def test_report(tests: DataFrame, finals: DataFrame, competitors: DataFrame, eligible: DataFrame) -> DataFrame:
    """Outcome counts per competitor. A human decision outranks the result; only open reviews count as pending."""
    decided = tests.where("validation_status <> 'pending'")
    bucket = (
        F.when(F.col("validation_status") == "valid", "matched")
        .when(F.col("validation_status").isin("postponed", "rejected"), F.col("validation_status"))
        .when(F.col("result") != "pending", F.col("result"))
    )
    by_outcome = decided.groupBy("competitor_id").agg(
        *[F.count_if(bucket == c).alias(c) for c in REPORT_COLUMNS[2:] if c != "pending"]
    )
    waiting = pending_queue(tests, finals).groupBy("competitor_id").agg(F.count("*").alias("pending"))
    rows = (
        competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor"))
        .join(by_outcome, "competitor_id", "left")
        .join(waiting, "competitor_id", "left")
        .join(eligible.select("competitor_id", F.col("eligible").alias("theoretical")), "competitor_id", "left")
        .fillna(0)
    )
    total = sum((F.col(c) for c in REPORT_COLUMNS[2:]), F.lit(0))
    return rows.withColumn("total", total).select("competitor_id", "competitor", *REPORT_COLUMNS)


def report_totals(report: DataFrame) -> DataFrame:
    return report.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in REPORT_COLUMNS])


def recent_scrapes(history: DataFrame, competitors: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    """Observations of the last hours by competitor, with the overall count as the null-competitor row."""
    since = F.lit((as_of - dt.timedelta(hours=hours)).isoformat(sep=" ")).cast("timestamp_ntz")
    counts = history.where(F.col("observed_at") >= since).groupBy("competitor_id").agg(F.count("*").alias("n"))
    names = competitors.select(F.col("id").alias("competitor_id"), F.col("name").alias("competitor"))
    return counts.join(names, "competitor_id").rollup("competitor").agg(F.sum("n").alias("n"))


def product_dossier(
    hits: DataFrame,
    reference: DataFrame,
    finals: DataFrame,
    tests: DataFrame,
    competitors: DataFrame,
    snapshots: DataFrame | None = None,
) -> DataFrame:
    """Search hits with reference price and their lists of finals, rejected and postponed tests; with `snapshots`
    (see `product_snapshots`) also their category path and image."""
    ids = hits.select("id_product")
    final_rows = finals_with_title(
        finals.join(ids, "id_product", "left_semi"), tests.join(ids, "id_product", "left_semi")
    )
    entry = F.struct("competitor_id", "url", "competitor_price", "competitor_title")
    lists = final_rows.groupBy("id_product").agg(F.sort_array(F.collect_list(entry)).alias("finals"))
    out = hits.join(reference.select("id_product", F.col("price").alias("reference_price")), "id_product", "left")
    out = out.join(lists, "id_product", "left")
    for status in ("rejected", "postponed"):
        found = reviews_by_product(tests.join(ids, "id_product", "left_semi"), competitors, status)
        out = out.join(found.withColumnRenamed("reviews", status), "id_product", "left")
    if snapshots is not None:
        out = out.join(snapshots.select("id_product", "category_path", "source_image_url"), "id_product", "left")
    return out
