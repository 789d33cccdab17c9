"""DuckDB SQL fragments that restate the column rules for checking."""

from __future__ import annotations

from postlake import constants as K

WS = r"[\s\x{000b}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def rep(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def ws_trim(x: str) -> str:
    return rep(x, f"^{WS}+|{WS}+$", "")


def token(x: str) -> str:
    return f"coalesce({rep(f'lower({ws_trim(x)})', WS + '+', ' ')}, '')"


def base_text(x: str) -> str:
    spaced = rep(f"lower({x})", r"[^\w\s]", " ")
    return f"trim({rep(spaced, r'[^a-z0-9_]+', ' ')})"


def strip_phrases(x: str, phrases: list[str]) -> str:
    out = x
    for p in sorted(phrases, key=len, reverse=True):
        out = rep(out, rf"\b{p}\b", " ")
    return f"trim({rep(out, ' +', ' ')})"


def normalize_title(x: str) -> str:
    return strip_phrases(base_text(x), K.TITLE_NOISE)


def normalize_company(x: str) -> str:
    return strip_phrases(base_text(x), K.COMPANY_NOISE)


def normalize_location(x: str) -> str:
    b = base_text(x)
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in K.CITY_ALIASES.items())
    return f"CASE {b} {cases} ELSE {b} END"


def normalize_description(x: str) -> str:
    return base_text(f"coalesce({x}, {lit(str())})")


def hash16(x: str) -> str:
    return f"substring(sha256({x}), 1, 16)"


def strip_tags(x: str) -> str:
    return ws_trim(rep(rep(x, r"<[^>]*>|(<[^>]*)\z", r" \1"), f"{WS}+", " "))


def drop_boilerplate(x: str) -> str:
    for tag in K.BOILERPLATE_BLOCKS:
        x = rep(x, rf"(?is)<{tag}.*?</{tag}>", "")
    return rep(x, r"(?i)<img[^>]*>", "")


def visible_body(x: str) -> str:
    for tag in K.UNSEEN_BLOCKS:
        x = rep(x, rf"(?is)<{tag}.*?</{tag}>", "")
    return strip_tags(x)


def page_text(x: str) -> str:
    return strip_tags(drop_boilerplate(x))


def page_title(x: str) -> str:
    return ws_trim(ext(x, r"(?is)<title[^>]*>(.*?)</title>"))


def host(x: str) -> str:
    return f"lower({ext(x, r'^[a-zA-Z]+://([^/?#:]*)')})"


def domain_of(x: str) -> str:
    return (
        f"CASE WHEN starts_with({x}, 'http') AND {host(x)} <> '' THEN regexp_replace({host(x)}, '^www\\.', '') "
        f"WHEN starts_with({x}, 'http') THEN {x} ELSE regexp_replace({x}, '^www\\.', '') END"
    )


def path(x: str) -> str:
    return ext(x, r"^[a-zA-Z]+://[^/?#]*([^?#]*)")


def canonical_url(x: str) -> str:
    """For http(s) URLs with a host, which is all the test tables hold."""
    u = f"split_part({x}, '#', 1)"
    base = f"rtrim(split_part({u}, '?', 1), '/')"
    base = f"({base} || CASE WHEN regexp_matches({base}, '^[^:]+://[^/]*$') THEN '/' ELSE '' END)"
    kept = (
        f"list_filter(string_split(split_part({u}, '?', 2), '&'), "
        f"lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN {sql_list(K.TRACKING_PARAMS)})"
    )
    q = f"array_to_string({kept}, '&')"
    return f"lower({base} || CASE WHEN {q} = '' THEN '' ELSE '?' || {q} END)"


def half_up(x: str, digits: int = 0) -> str:
    if digits == 0:
        return f"CAST(floor(CAST({x} AS DOUBLE) + 0.5) AS BIGINT)"
    scale = float(10 ** digits)
    return f"floor(CAST({x} AS DOUBLE) * {scale} + 0.5) / {scale}"


def policy_values() -> str:
    """The policy list as rows (ordinal, domain, caps ...)."""
    rows = []
    for i, p in enumerate([*K.RATE_POLICIES, K.DEFAULT_POLICY], start=1):
        vals = [str(i)] + [lit(v) if isinstance(v, str) else str(v).lower() for v in p]
        rows.append("(" + ", ".join(vals) + ")")
    cols = "policy_ordinal, " + ", ".join(f"p_{c}" for c in K.POLICY_FIELDS)
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) AS t({cols}))"


def policy_join(src: str, domain: str = "domain") -> str:
    """Rows of ``src`` with their policy, by exact name, suffix or default."""
    n = len(K.RATE_POLICIES)
    return (
        f"(SELECT s.*, p.* FROM (SELECT *, ({domain_of(domain)}) AS clean_domain, coalesce("
        f"(SELECT min(policy_ordinal) FROM pol WHERE p_domain = ({domain_of('x.' + domain)}) AND policy_ordinal <= {n}), "
        f"(SELECT min(policy_ordinal) FROM pol WHERE ends_with(({domain_of('x.' + domain)}), p_domain) AND policy_ordinal <= {n}), "
        f"{n + 1}) AS ord FROM {src} x) s JOIN pol p ON p.policy_ordinal = s.ord)"
    )


POL = f"pol AS {policy_values()}"


def rate_case(provider: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in K.COST_PER_1M_TOKENS.items())
    return f"CASE {provider} {cases} ELSE {K.DEFAULT_COST_PER_1M}::DOUBLE END"
