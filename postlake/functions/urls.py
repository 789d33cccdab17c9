"""URL rules as column expressions.

Built on regular expressions rather than a strict URI parser: collected links
hold blanks, pipes and quotes that a strict parser rejects.  Covered: scheme,
user info, host, default ports, fragment, query, trailing slashes, case.  Not
covered: international host names, dot segments and percent re-encoding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.text import as_col, empty_to_null, first_filled, token, ws_trim

_HTTP = r"(?i)^https?://[^/?#\s]"
_HOST = r"(?i)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PORT = r"(?i)^(?:(http://[^/]*?):80|(https://[^/]*?):443)(/|$)"
_TRACKING = r"(?i)&(?:" + "|".join(K.TRACKING_PARAMS) + r")(?:=[^&]*)?(?=&|$)"


def is_http_url(c) -> Column:
    return F.rlike(ws_trim(c), F.lit(_HTTP))


def is_url(c) -> Column:
    """A scheme followed by something, with a host where the scheme needs one."""
    t = ws_trim(c)
    return F.rlike(t, F.lit(_HTTP)) | (
        F.rlike(t, F.lit(r"(?i)^[a-z][a-z0-9+.\-]*:\S")) & ~F.rlike(t, F.lit(r"(?i)^(https?|wss?|ftp):"))
    )


def url_host(c) -> Column:
    return F.lower(F.regexp_extract(as_col(c), _HOST, 1))


def url_scheme(c) -> Column:
    return F.lower(F.regexp_extract(as_col(c), r"(?i)^\s*([a-z][a-z0-9+.\-]*):", 1))


def url_origin(c) -> Column:
    return F.concat(
        url_scheme(c), F.lit("://"),
        F.lower(F.regexp_extract(as_col(c), r"(?i)^\s*[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)),
    )


def url_path(c) -> Column:
    return F.regexp_extract(as_col(c), r"^[^/?#]*//[^/?#]*([^?#]*)", 1)


def url_query(c) -> Column:
    return F.regexp_extract(as_col(c), r"^[^?#]*\?([^#]*)", 1)


def query_value(c, key: str) -> Column:
    """Decoded value of one query key, null when missing."""
    raw = F.regexp_extract(F.concat(F.lit("&"), url_query(c)), rf"&{key}=([^&]*)", 1)
    return F.try_url_decode(empty_to_null(raw))


def canonical_url(c) -> Column:
    """One spelling per posting URL: no tracking, no fragment, lower case."""
    raw = as_col(c)
    no_frag = F.regexp_extract(ws_trim(raw), r"(?s)^([^#]*)", 1)
    base = F.regexp_replace(F.regexp_extract(no_frag, r"(?s)^([^?]*)", 1), _PORT, "$1$2$3")
    base = F.regexp_replace(base, "/+$", "")
    base = F.when(F.rlike(base, F.lit("^[^:]+://[^/]*$")), F.concat(base, F.lit("/"))).otherwise(base)

    query = F.concat(F.lit("&"), F.regexp_extract(no_frag, r"(?s)^[^?]*\?(.*)$", 1))
    kept = F.regexp_replace(query, _TRACKING, "")
    tidy = F.regexp_replace(F.regexp_replace(kept, "&{2,}", "&"), "^&|&$", "")
    suffix = (
        F.when(~F.contains(no_frag, F.lit("?")), F.lit(""))
        .when(kept == query, F.concat(F.lit("?"), F.regexp_replace(query, "^&", "")))
        .when(tidy == "", F.lit(""))
        .otherwise(F.concat(F.lit("?"), tidy))
    )
    return F.when(is_http_url(raw), F.lower(F.concat(base, suffix))).otherwise(F.lower(ws_trim(raw)))


def domain_of(c) -> Column:
    """Host of a URL, or the given host, without a leading ``www.``."""
    raw = as_col(c)
    host = url_host(raw)
    return (
        F.when(~F.startswith(raw, F.lit("http")), F.regexp_replace(raw, r"^www\.", ""))
        .when(host != "", F.regexp_replace(host, r"^www\.", ""))
        .otherwise(raw)
    )


def source_url(c) -> Column:
    """Scheme, host and path only; used by the source fingerprint."""
    raw = token(c)
    path = F.regexp_replace(url_path(raw), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    return F.when(is_http_url(raw), F.concat(url_scheme(raw), F.lit("://"), url_host(raw), path)).otherwise(raw)


def source_slug(c) -> Column:
    return F.regexp_replace(token(c), "[^a-z0-9]+", "-")


def job_id(platform_job_id, url) -> Column:
    """Platform id, else a known query key, else the last path segment."""
    from_query = first_filled(*[query_value(url, k) for k in K.JOB_ID_PARAMS])
    segment = F.regexp_extract(url_path(url), "([^/]+)/*$", 1)
    return F.coalesce(
        empty_to_null(token(platform_job_id)),
        F.when(is_http_url(url), token(F.coalesce(from_query, segment))),
        F.lit(""),
    )


def source_fingerprint(source, url, platform_job_id) -> Column:
    return F.concat_ws("::", source_slug(source), source_url(url), job_id(platform_job_id, url))


def numeric_job_id(c) -> Column:
    """Numeric id from a URN, a view URL or a bare number."""
    raw = as_col(c)
    return first_filled(
        F.regexp_extract(raw, r":(\d{10,})$", 1),
        F.regexp_extract(raw, r"/jobs/view/(\d+)", 1),
        F.regexp_extract(F.trim(raw), r"^(\d{8,})$", 1),
    )


def start_offset(url) -> Column:
    """Paging offset of a search URL; 0 when missing or not a number."""
    return F.coalesce(query_value(url, "start").try_cast("bigint"), F.lit(0).cast("bigint"))


def tracker_url(url, asset_type=None, strict: bool = False) -> Column:
    """Tracker hosts always; heavy assets too when ``strict``."""
    hit = F.rlike(as_col(url), F.lit("|".join(t.replace(".", r"\.") for t in K.TRACKER_FRAGMENTS)))
    if strict and asset_type is not None:
        hit = hit | as_col(asset_type).isin(K.HEAVY_ASSET_TYPES)
    return F.coalesce(hit, F.lit(False))
