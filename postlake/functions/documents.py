"""Reading JSON and feed items that are not quite well-formed."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from postlake import constants as K
from postlake.functions.text import as_col

_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def parse_json(c) -> Column:
    """A JSON text as a variant, null when it does not parse; of a repeated key the last value counts.

    The session decides on repeated keys, so the setting is made here: a submitter's session need not have it.
    """
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_REPEATED_KEYS, "false") != "true":
        spark.conf.set(_REPEATED_KEYS, "true")
    return F.try_parse_json(c)


def repair_item(c, tags: list[str]) -> Column:
    """A feed item as strict XML: only ``tags`` stay markup, every other tag becomes text, as do stray ampersands.

    Text between CDATA marks is kept as it is; outside, named entities of HTML become characters.
    """
    parts = F.split(as_col(c), r"<!\[CDATA\[|\]\]>")
    known = "|".join(t.replace(":", "[:]") for t in tags)

    def escaped(s: Column) -> Column:
        return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def mended(s: Column) -> Column:
        for name, char in K.HTML_ENTITIES.items():
            s = F.replace(s, F.lit(f"&{name};"), F.lit(char))
        s = F.regexp_replace(s, r"&(?!(?:amp|lt|gt|quot|apos|#\d{1,7}|#x[0-9a-fA-F]{1,6});)", "&amp;")
        return F.regexp_replace(s, rf"<(?!/?(?:{known})(?:\s[^<>]*)?/?>)", "&lt;")

    pieces = F.transform(parts, lambda s, i: F.when(i % 2 == 1, escaped(s)).otherwise(mended(s)))
    return F.array_join(pieces, "")
