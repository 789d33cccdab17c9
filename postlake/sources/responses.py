"""Landed model responses to listings.

The model call itself happened elsewhere; a response row holds ``api_format``,
``provider``, ``page_url``, ``source_label`` and the raw JSON ``body``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.documents import parse_json
from postlake.functions.hashing import hash16
from postlake.functions.text import empty_to_null, first_filled, ws_trim
from postlake.functions.urls import is_http_url, url_origin

API_FORMATS = ("openai", "anthropic", "gemini", "ollama")


def _get(path: str, kind: str = "string", root: str = "doc") -> Column:
    return F.try_variant_get(root, path, kind)


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def _text_or_json(path: str) -> Column:
    """Text as it is, an object as its JSON; anything else counts as missing."""
    v = F.try_variant_get("doc", path, "variant")
    return F.when(
        F.schema_of_variant(v).isin("STRING"), F.try_variant_get("doc", path, "string")
    ).when(_is_object(v), F.to_json(v))


def _content_text(path: str) -> Column:
    """Message content: a string, or the joined text of its parts."""
    parts = F.try_variant_get("doc", path, "array<variant>")
    joined = F.array_join(
        F.transform(parts, lambda p: F.coalesce(
            F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")),
            F.try_variant_get(p, "$.text", "string"), F.lit(""),
        )), "",
    )
    v = F.try_variant_get("doc", path, "variant")
    return (
        F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get("doc", path, "string"))
        .when(parts.isNotNull(), ws_trim(joined))
    )


def _first_part(array_path: str, test, take) -> Column:
    parts = F.try_variant_get("doc", array_path, "array<variant>")
    return take(F.get(F.filter(parts, test), F.lit(0)))


def response_payload(responses: DataFrame) -> DataFrame:
    """Add ``payload``: the tool call of the response, else its text."""
    anthropic = F.coalesce(
        _first_part(
            "$.content",
            lambda p: F.try_variant_get(p, "$.type", "string") == "tool_use",
            lambda p: F.when(
                _is_object(F.try_variant_get(p, "$.input", "variant")),
                F.to_json(F.try_variant_get(p, "$.input", "variant")),
            ),
        ),
        _first_part(
            "$.content",
            lambda p: F.try_variant_get(p, "$.type", "string") == "text",
            lambda p: F.try_variant_get(p, "$.text", "string"),
        ),
    )
    gemini_args = lambda p: F.try_variant_get(p, "$.functionCall.args", "variant")
    gemini = F.coalesce(
        _first_part(
            "$.candidates[0].content.parts",
            lambda p: _is_object(F.try_variant_get(p, "$.functionCall", "variant")),
            lambda p: F.when(_is_object(gemini_args(p)), F.to_json(gemini_args(p))).otherwise(
                F.try_variant_get(p, "$.functionCall.args", "string")
            ),
        ),
        _first_part(
            "$.candidates[0].content.parts",
            lambda p: F.schema_of_variant(F.try_variant_get(p, "$.text", "variant")) == "STRING",
            lambda p: F.try_variant_get(p, "$.text", "string"),
        ),
    )
    ollama = F.coalesce(
        _text_or_json("$.message.tool_calls[0].function.arguments"), _content_text("$.message.content")
    )
    chat = F.coalesce(
        _text_or_json("$.choices[0].message.tool_calls[0].function.arguments"),
        _content_text("$.choices[0].message.content"),
    )
    payload = (
        F.when(F.col("api_format") == "ollama", ollama)
        .when(F.col("api_format") == "anthropic", anthropic)
        .when(F.col("api_format") == "gemini", gemini)
        .otherwise(chat)
    )
    return (
        responses.withColumn("doc", parse_json("body"))
        .withColumn("payload", F.coalesce(payload, F.lit("")))
        .drop("doc")
    )


def salvage_records(df: DataFrame) -> DataFrame:
    """One row per extracted record found in ``payload``.

    Tries the whole text, else the widest bracketed part, else the widest
    braced part.  An object is unwrapped through ``jobs``, else through its
    first list in written order, else it is the record itself.
    """
    text = ws_trim(F.col("payload"))
    in_brackets = empty_to_null(F.regexp_extract(text, r"(?s)\[.*\]", 0))
    in_braces = empty_to_null(F.regexp_extract(text, r"(?s)\{.*\}", 0))
    chosen = (
        F.when(parse_json(text).isNotNull(), text)
        .when(in_brackets.isNotNull(), in_brackets)
        .otherwise(in_braces)
    )
    # A parsed object keeps its keys sorted, so their written order is read
    # from the text while the values come from the parsed form.
    written_keys = F.map_keys(F.from_json(F.col("chosen"), "map<string,string>"))
    values = F.try_variant_get("doc", "$", "map<string,variant>")
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    lists = F.filter(
        F.transform(written_keys, lambda k: as_list(F.element_at(values, k))), lambda a: a.isNotNull()
    )
    items = F.coalesce(
        _get("$", "array<variant>"),
        F.when(_is_object(F.col("doc")), F.coalesce(
            _get("$.jobs", "array<variant>"), F.get(lists, F.lit(0)), F.array("doc")
        )),
    )
    kept = [c for c in df.columns if c != "payload"]
    fields = [
        ("title", "title"), ("company", "company"), ("location", "location"), ("experience", "experience"),
        ("job_type", "jobType"), ("apply_link", "applyLink"), ("fresher_reason", "fresherReason"),
        ("experience_normalized", "experienceNormalized"), ("raw_description", "rawDescription"),
    ]
    return (
        df.withColumn("chosen", chosen)
        .withColumn("doc", parse_json("chosen"))
        # Unparsed text explodes to nothing; a filter here would be pushed down
        # and repeat the whole parse.
        .select(*kept, F.posexplode(items).alias("item_no", "item"))
        .select(
            *kept, "item_no",
            *[F.try_variant_get("item", f"$.{path}", "string").alias(name) for name, path in fields],
            F.try_variant_get("item", "$.isFresher", "boolean").alias("is_fresher"),
        )
    )


def _source_name(label: Column) -> Column:
    first = lambda c, part: F.regexp_replace(c, rf"^(.*?){part}", "$1")  # noqa: E731 - first hit only
    return F.lower(first(first(label, "_HUB"), "_DETAIL"))


def sanitize_records(df: DataFrame) -> DataFrame:
    """Trim, default and make the apply link absolute."""
    link = F.coalesce(F.col("apply_link"), F.lit(""))
    slash = F.when(F.startswith(link, F.lit("/")), F.lit("")).otherwise(F.lit("/"))
    absolute = (
        F.when((link == "") | F.startswith(link, F.lit("http")), link)
        .when(is_http_url("page_url"), F.concat(url_origin("page_url"), slash, link))
        .otherwise(link)
    )
    trimmed = {c: F.coalesce(ws_trim(c), F.lit("")) for c in ("title", "company", "location", "experience")}
    return df.withColumns({
        **trimmed,
        "job_type": F.coalesce(ws_trim("job_type"), F.lit("Full Time")),
        "apply_link": absolute,
        "source": _source_name(F.col("source_label")),
        "is_fresher": F.coalesce("is_fresher", F.lit(False)),
        "fresher_reason": F.coalesce("fresher_reason", F.lit("")),
        "experience_normalized": F.coalesce("experience_normalized", F.lit("Unknown")),
    })


def fresher_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_fresher") | F.col("experience_normalized").isin(K.FRESHER_BANDS))


def normalize_records(df: DataFrame) -> DataFrame:
    """Stable 16-hex id, default location, absolute apply link by source."""
    site = F.lower(F.col("source_label"))
    site = F.regexp_replace(F.regexp_replace(site, "^(.*?)_hub", "$1"), "^(.*?)_detail", "$1")
    link = F.coalesce(F.col("apply_link"), F.lit(""))
    absolute = F.when(F.startswith(link, F.lit("http")), link).otherwise(
        F.concat(F.lit("https://"), site, F.lit(".com"), link)
    )
    return (
        df.withColumn("apply_link", absolute)
        .withColumn("id", hash16(F.concat_ws("|", "title", "company", "apply_link")))
        .withColumn("location", first_filled(ws_trim("location"), F.lit("India")))
    )


def to_listing(df: DataFrame, *keep: str) -> DataFrame:
    """Project extracted records to raw listings, with ``keep`` in front."""
    url = first_filled(F.col("apply_link"), F.col("page_url"))
    return df.select(
        *keep, "title", "company",
        F.coalesce("raw_description", F.concat("title", F.lit(" at "), "company")).alias("description"),
        url.alias("url"), "source", empty_to_null("location").alias("location"), url.alias("apply_url"),
        empty_to_null("job_type").alias("job_type"), empty_to_null("experience").alias("experience"),
        F.lit("headless").alias("source_tier"),
    )


def token_usage(responses: DataFrame) -> DataFrame:
    """Tokens per response from any of the three usage shapes; 0 when absent."""
    def n(path: str) -> Column:
        return F.coalesce(
            F.when(
                F.schema_of_variant(F.try_variant_get("doc", path, "variant")).isin("BIGINT", "DOUBLE", "DECIMAL")
                | F.rlike(F.schema_of_variant(F.try_variant_get("doc", path, "variant")), F.lit("^DECIMAL")),
                _get(path, "double"),
            ), F.lit(0.0),
        )

    in_out = n("$.usage.input_tokens") + n("$.usage.output_tokens")
    tokens = (
        F.when(n("$.usage.total_tokens") > 0, n("$.usage.total_tokens"))
        .when((n("$.usage.input_tokens") > 0) | (n("$.usage.output_tokens") > 0), in_out)
        .otherwise(n("$.usageMetadata.totalTokenCount"))
    )
    return (
        responses.withColumn("doc", parse_json("body"))
        .withColumn("tokens", F.greatest(tokens, F.lit(0.0)).cast("bigint"))
        .drop("doc")
    )


