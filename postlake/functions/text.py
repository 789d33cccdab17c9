"""Text rules as column expressions (all stay inside code generation)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import constants as K

# Java's \s is ASCII only; feeds and pages also carry the Unicode blanks.  The
# category class matches several times faster than listing them would.
WS = r"[\s\p{Z}\x{FEFF}]"
_BLANKS = "".join(map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F,
                            0x3000, 0xFEFF]))


# What base text replaces: a run of other characters that is not one space after a word.
NOT_WORDS = r"\W+(?<!\w )"


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def empty_to_null(c) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def first_filled(*cols) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[empty_to_null(c) for c in cols])


def ws_trim(c) -> Column:
    return F.btrim(as_col(c), F.lit(_BLANKS))


def collapse(c) -> Column:
    return F.regexp_replace(as_col(c), f"{WS}+", " ")


def token(c) -> Column:
    """Trimmed, lower-cased, blank-collapsed; null becomes empty."""
    return F.coalesce(collapse(F.lower(ws_trim(c))), F.lit(""))


def base_text(c) -> Column:
    """Lower-case ASCII words separated by single spaces.

    Everything outside ``[a-z0-9_]`` (punctuation as well as blanks) ends up
    as one space, so one pass replaces the usual three.  A single space after
    a word is right already: replacing it by itself would cost a step a word.
    """
    return F.trim(F.regexp_replace(F.lower(as_col(c)), NOT_WORDS, " "))


def _overlap(a: list[str], b: list[str]) -> bool:
    """True when a text can hold both phrases so that they share a word."""
    return any(
        all(b[i - shift] == a[i] for i in range(max(0, shift), min(len(a), shift + len(b))))
        for shift in range(1 - len(b), len(a))
    )


def _passes(phrases: list[str]) -> list[str]:
    """Patterns that blank out phrases one after the other, longest first, where order counts, and else in one pass.

    Phrases act as patterns (a dot is any character). What a pass removes becomes a blank between two others, so it completes no
    phrase of words; it spoils another phrase only if they share a word. Neighbours in order that share none go together,
    behind a test of the first letter. A phrase with a mark that base text does not hold is never found.
    """
    groups: list[list[str] | str] = []
    for phrase in sorted(phrases, key=len, reverse=True):
        words = phrase.strip("()")
        if "-" in words:
            continue
        if not re.fullmatch(r"[a-z0-9_]+(?: [a-z0-9_]+)*", words):
            groups.append(phrase)
            continue
        last = groups[-1] if groups and isinstance(groups[-1], list) else None
        if last is not None and (words in last or not any(_overlap(words.split(), other.split()) for other in last)):
            last.extend([words] if words not in last else [])
        else:
            groups.append([words])
    return [
        rf"\b{g}\b" if isinstance(g, str) else rf"\b(?=[{''.join(sorted({w[0] for w in g}))}])(?:{'|'.join(g)})\b" for g in groups
    ]


def _any_phrase(phrases: list[str]) -> str:
    """A pattern that base text between two blanks holds wherever a phrase is found, and hardly elsewhere.

    There a word's edge is a blank, which is tested faster than ``\\b``. Of a phrase with a dot or a blank at its end
    the word before that mark is enough; a phrase with a mark that base text does not hold is never found.
    """
    words = {p.strip("()") for p in phrases if "-" not in p}
    starts = sorted({f"{w} " if re.fullmatch(r"[a-z0-9_]+(?: [a-z0-9_]+)*", w) else re.match("[a-z0-9_]*", w)[0] for w in words})
    return f" (?=[{''.join(sorted({s[0] for s in starts}))}])(?:{'|'.join(starts)})"


def _strip_phrases(base: Column, phrases: list[str]) -> Column:
    """Blank out whole-word phrases of base text, longest first.

    A single alternation serves as a cheap test whether any pass can change the text at all; a text that meets it in vain stays
    as it is.
    """
    stripped = reduce(lambda acc, p: F.regexp_replace(acc, p, " "), _passes(phrases), base)
    tidy = F.trim(F.regexp_replace(stripped, " {2,}", " "))
    return F.when(F.rlike(F.concat(F.lit(" "), base, F.lit(" ")), F.lit(_any_phrase(phrases))), tidy).otherwise(base)


def strip_title_noise(base) -> Column:
    return _strip_phrases(as_col(base), K.TITLE_NOISE)


def strip_company_noise(base) -> Column:
    return _strip_phrases(as_col(base), K.COMPANY_NOISE)


def normalize_title(c) -> Column:
    return strip_title_noise(base_text(c))


def normalize_company(c) -> Column:
    return strip_company_noise(base_text(c))


def normalize_location(c, city_only: bool = False) -> Column:
    """Base text with city aliases applied to the whole string.

    ``city_only`` first cuts at the comma, so "Bengaluru, Karnataka" becomes
    "bangalore"; by default punctuation is already gone by then and it stays
    "bengaluru karnataka".
    """
    raw = as_col(c)
    if city_only:
        raw = F.regexp_extract(raw, "^([^,]*)", 1)
    s = base_text(raw)
    out = s
    for variant, name in K.CITY_ALIASES.items():
        out = F.when(s == variant, F.lit(name)).otherwise(out)
    return out


def head(c, chars: int | None) -> Column:
    """The first ``chars`` characters, or the whole text."""
    return as_col(c) if chars is None else F.substring(as_col(c), 1, chars)


def normalize_description(c, chars: int | None = None) -> Column:
    """Base text of a description; ``chars=DESCRIPTION_HASH_CHARS`` compares openings only."""
    return head(base_text(F.coalesce(as_col(c), F.lit(""))), chars)


def strip_tags(c) -> Column:
    """Text without tags. A ``<`` that no ``>`` follows takes the rest of the text with it unchanged, so one pass is enough."""
    return F.trim(collapse(F.regexp_replace(as_col(c), r"<[^>]*>|(<[^>]*)\z", " $1")))


# Marks the end of a text while it is split; no character has this code.
_END = "￿"


def _cut_from(tag: str):
    """A part that a closing tag ended, without its element; a closing tag that ends nothing is put back."""
    return lambda part: (
        F.when(F.endswith(part, F.lit(_END)), part)
        .when(F.rlike(part, F.lit(f"(?i)<{tag}")), F.regexp_replace(part, f"(?is)<{tag}.*", ""))
        .otherwise(F.concat(part, F.lit(f"</{tag}>")))
    )


def drop_elements(html, tags: list[str]) -> Column:
    """Remove each block from its opening tag to the first closing tag after it.

    The text is split at the closing tags, and each part but the last loses what follows its first opening tag: no part
    is looked at twice, however many tags stay open.
    """
    out = F.concat(as_col(html), F.lit(_END))
    for tag in tags:
        out = F.array_join(F.transform(F.split(out, f"(?i)</{tag}>"), _cut_from(tag)), "")
    return F.rtrim(out, F.lit(_END))


def drop_boilerplate(html) -> Column:
    """Remove script, style, navigation and media blocks from page HTML."""
    return F.regexp_replace(drop_elements(html, K.BOILERPLATE_BLOCKS), r"(?i)<img[^<>]*>", "")


def content_cap(provider) -> Column:
    p = as_col(provider)
    return (
        F.when(p.isin(K.LOW_CAP_PROVIDERS), F.lit(K.LOW_CAP))
        .when(p.isin(K.HIGH_CAP_PROVIDERS), F.lit(K.HIGH_CAP))
        .otherwise(F.lit(K.DEFAULT_CAP))
    )


def page_text(html) -> Column:
    """Readable page text: boilerplate out, tags out, blanks collapsed."""
    return strip_tags(drop_boilerplate(html))


def visible_body(html) -> Column:
    """Text of everything a page shows, header, navigation and footer included."""
    return strip_tags(drop_elements(html, K.UNSEEN_BLOCKS))


def page_title(html) -> Column:
    """Text of the title element: of the part before the first closing tag, what follows its first opening tag."""
    parts = F.split(as_col(html), "(?i)</title>", 2)
    before = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit(""))
    return ws_trim(F.regexp_extract(before, r"(?is)<title[^<>]*>(.*)\z", 1))


def title_company(c) -> Column:
    """Company part of "Role at Company | Site"; the input when absent."""
    found = ws_trim(F.regexp_extract(as_col(c), r"(?i)at\s+(.+?)(?:\||$)", 1))
    return F.coalesce(empty_to_null(found), as_col(c))


def capitalize_words(slug) -> Column:
    """"acme-big-co" -> "Acme Big Co", leaving the tail of each word alone."""
    words = F.transform(
        F.split(as_col(slug), "-"),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)),
    )
    return F.array_join(words, " ")


def contains_any(c, phrases: list[str]) -> Column:
    """True when any phrase occurs in the text; tests stop at the first hit."""
    if not phrases:
        return F.lit(False)
    col = as_col(c)
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in phrases])


def literal_pattern(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)
