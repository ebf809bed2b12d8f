"""Failure taxonomy: URLs, HTTP codes and error messages to reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook import fixed


def url_domain(url: Column) -> Column:
    """Host name without a leading 'www.'; NULL for unusable URLs."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def http_reason(status: Column) -> Column:
    return (
        F.when(status.isin(401, 403, 429), "fetch_blocked")
        .when(status.isin(404, 410), "fetch_not_found")
        .when(status >= 500, "fetch_server_error")
        .when(status.isNotNull(), "fetch_network_error")
    )


def download_reason(error_class: Column, status: Column) -> Column:
    """Reason for a failed download from its error class and HTTP code."""
    name = F.lower(error_class)
    return (
        F.when(name.contains("timeout"), "fetch_timeout")
        .when(name.contains("httpstatus"), http_reason(status))
        .otherwise("fetch_network_error")
    )


def extraction_reason(error_class: Column, message: Column) -> Column:
    """Reason for a failed extraction; the rules are ordered, first match wins."""
    name = F.lower(F.coalesce(error_class, F.lit("")))
    msg = F.lower(F.coalesce(message, F.lit("")))
    truncated = (
        name.contains("incompleteoutput")
        | msg.contains("output is incomplete")
        | msg.contains("max_tokens length limit")
        | (msg.contains("incomplete") & msg.contains("max_tokens"))
    )
    limited = msg.rlike("429|resource_exhausted|rate limit") | name.contains("ratelimit")
    daily = msg.rlike("quota|per day|daily")
    slow = name.contains("timeout") | msg.rlike("timeout|deadline")
    blocked = msg.rlike("safety|blocked|recitation|prohibited")
    too_long = msg.rlike("context length|context window|too long|input is too large") | (
        msg.contains("input") & msg.contains("token") & msg.rlike("exceed|max|limit")
    )
    return (
        F.when(truncated, "llm_max_tokens")
        .when(name.contains("validation"), "validation_error")
        .when(limited & daily, "llm_quota")
        .when(limited, "llm_rate_limit")
        .when(msg.contains("quota"), "llm_quota")
        .when(slow, "llm_timeout")
        .when(blocked, "llm_safety_block")
        .when(too_long, "content_too_long")
        .when(msg.contains("validation"), "validation_error")
        .otherwise("llm_unknown")
    )


def is_transient(reason: Column) -> Column:
    return F.coalesce(reason.isin(fixed.TRANSIENT_REASONS), F.lit(False))


def is_filter_reason(reason: Column) -> Column:
    return F.coalesce(reason.isin(fixed.FILTER_REASONS), F.lit(False))
