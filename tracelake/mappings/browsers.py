"""Browser histories."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import values as V

from .joins import absent, carried, children, lookup

#: Bits of a page transition, and states of a download.
QUALIFIERS = {0x00800000: "blocked", 0x01000000: "forward_back", 0x02000000: "from_address_bar", 0x04000000: "home_page", 0x08000000: "from_api", 0x10000000: "chain_start", 0x20000000: "chain_end", 0x40000000: "client_redirect", 0x80000000: "server_redirect"}
DOWNLOADS = {0: "in_progress", 1: "complete", 2: "cancelled", 3: "interrupted", 4: "interrupted"}


def qualifiers(transition: Column) -> Column:
    return F.concat_ws(",", *[F.when(transition.cast("bigint").bitwiseAND(F.lit(bit).cast("bigint")) != 0, name) for bit, name in QUALIFIERS.items()])


def chromium_visits(t: Mapping[str, DataFrame]) -> DataFrame:
    """Visits with their URL, and URLs that no visit names (by an anti join); where visits' URLs are unknown, these may have visits."""
    visits = lookup(t["visits"].withColumnRenamed("url", "url_id"), "url_id", t["urls"], "id", {"url": "url", "title": "title"}, "url_state", cell="url")
    seen = visits.select(F.lit("visit").alias("kind"), F.col("id").alias("rowid"), V.webkit_us(F.col("visit_time")).alias("ts"), "url", "title", "url_state", V.transition_core(F.col("transition")).alias("core"), qualifiers(F.col("transition")).alias("qualifiers"), *carried(visits))
    idle = absent(t["urls"], "id", t["visits"], "url", "visits")
    return seen.unionByName(idle.select(F.lit("url").alias("kind"), F.col("id").alias("rowid"), V.webkit_us(F.col("last_visit_time")).alias("ts"), "url", "title", F.lit("found").alias("url_state"), *carried(idle)), allowMissingColumns=True)


def chromium_downloads(t: Mapping[str, DataFrame]) -> DataFrame:
    """Downloads with the first and the last URL of their chain and its length; of hops with the same index, the URLs' order decides."""
    hop = F.struct("chain_index", "url")
    out = children(t["downloads"], "id", t["downloads_url_chains"], "id", "downloads_url_chains", {"first_url": F.min_by("url", hop), "last_url": F.max_by("url", hop), "hops": F.count("*")}, ("chain_index", "url"), ("hops",))
    return out.select(F.col("id").alias("rowid"), V.webkit_us(F.col("start_time")).alias("ts"), V.named(F.col("state"), DOWNLOADS).alias("state"), F.col("state").alias("raw_state"), "target_path", "first_url", "last_url", "hops", *carried(out))


def safari_history(t: Mapping[str, DataFrame]) -> DataFrame:
    """Visits with their item, items without a visit, and tombstones as deleted ranges."""
    us = lambda c: V.plausible((F.col(c) * 1_000_000).cast("bigint") + V.COCOA * 1_000_000)
    visits = lookup(t["history_visits"].select("id", "history_item", "visit_time", "title", *carried(t["history_visits"])), "history_item", t["history_items"], "id", {"url": "url"}, "item_state")
    out = visits.select(F.lit("visit").alias("kind"), F.col("id").alias("rowid"), us("visit_time").alias("ts"), F.lit(None).cast("bigint").alias("end_ts"), "url", "title", "item_state", F.lit(False).alias("deleted"), *carried(visits))
    idle = absent(t["history_items"], "id", t["history_visits"], "history_item", "history_visits")
    out = out.unionByName(idle.select(F.lit("item").alias("kind"), F.col("id").alias("rowid"), "url", F.lit("found").alias("item_state"), F.lit(False).alias("deleted"), *carried(idle)), allowMissingColumns=True)
    if "history_tombstones" in t:  # absent in older schemas
        out = out.unionByName(t["history_tombstones"].select(F.lit("tombstone").alias("kind"), F.col("id").alias("rowid"), us("start_time").alias("ts"), us("end_time").alias("end_ts"), "url", F.lit(True).alias("deleted"), *carried(t["history_tombstones"])), allowMissingColumns=True)
    return out


def chromium_searches(t: Mapping[str, DataFrame]) -> DataFrame:
    """Search terms with the page that they led to; its last visit is their time."""
    out = lookup(t["keyword_search_terms"], "url_id", t["urls"], "id", {"url": "url", "_last": "last_visit_time"}, "url_state")
    return out.select(F.col("keyword_id").alias("rowid"), V.webkit_us(F.col("_last")).alias("ts"), "term", "url", "url_state", *carried(out))


#: How a download was judged, why it was interrupted, and the browsers of app packages.
DANGERS = (
    "not_dangerous", "dangerous_file", "dangerous_url", "dangerous_content", "maybe_dangerous_content", "uncommon_content", "user_validated", "dangerous_host", "potentially_unwanted", "allowlisted_by_policy",
    "async_scanning", "blocked_password_protected", "blocked_too_large", "sensitive_content_warning", "sensitive_content_block", "deep_scanned_safe", "deep_scanned_opened_dangerous", "prompt_for_scanning",
    "blocked_unsupported_filetype", "dangerous_account_compromise", "deep_scanned_failed", "prompt_for_local_password_scanning", "async_local_password_scanning", "blocked_scan_failed", "forced_save_to_gdrive", "forced_save_to_onedrive",
)
INTERRUPTS = {
    0: "none", 1: "file_failed", 2: "file_access_denied", 3: "file_no_space", 5: "file_name_too_long", 6: "file_too_large", 7: "file_virus_infected", 10: "file_transient_error", 11: "file_blocked",
    12: "file_security_check_failed", 13: "file_too_short", 14: "file_hash_mismatch", 15: "file_same_as_source", 20: "network_failed", 21: "network_timeout", 22: "network_disconnected", 23: "network_server_down",
    24: "network_invalid_request", 30: "server_failed", 31: "server_no_range", 33: "server_bad_content", 34: "server_unauthorized", 35: "server_cert_problem", 36: "server_forbidden", 37: "server_unreachable",
    38: "server_content_length_mismatch", 39: "server_cross_origin_redirect", 40: "user_canceled", 41: "user_shutdown", 50: "crash", 51: "local_download_blocked",
}
PACKAGES = {"com.android.chrome": "chrome", "com.chrome.beta": "chrome", "com.chrome.dev": "chrome", "com.chrome.canary": "chrome", "org.chromium.chrome": "chromium", "com.brave.browser": "brave", "com.brave.browser_beta": "brave", "com.brave.browser_nightly": "brave"}


def danger_name(v: Column) -> Column:
    return V.named(v, dict(enumerate(DANGERS)))


def interrupt_name(v: Column) -> Column:
    return V.named(v, INTERRUPTS)


def label(path: Column) -> Column:
    """struct(browser, profile, package) of a history's path: /package/app_chrome/profile/History, or app_webview."""
    part = lambda n: F.regexp_extract(path, r"(?:^|.*/)([^/]*)/(app_chrome|app_webview)(?:/([^/]*)/History$)?", n)
    package = part(1)
    browser = F.lit("unknown-chromium")
    for name, known in PACKAGES.items():
        browser = F.when(package == name, known).otherwise(browser)
    kind = part(2)
    return F.struct(F.when(kind == "app_webview", "webview").when(kind == "app_chrome", browser).otherwise("unknown-chromium").alias("browser"), part(3).alias("profile"), package.alias("package"))
