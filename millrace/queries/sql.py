"""Pieces of DuckDB SQL that say the same as the engine's expressions."""

from __future__ import annotations

from millrace.functions import text, urls
from millrace.operators import extract, ranking

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(quoted(x) for x in values) + ")"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def cut(x: str, limit: int) -> str:
    return f"CASE WHEN length({x}) <= {limit} THEN {x} ELSE trim(regexp_replace(substr({x}, 1, {limit}), ' [^ ]*$', '')) END"


def tidy(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '' AND NOT regexp_matches(l, {quoted(text.JUNK_LINE)}))"
    return collapsed(f"array_to_string({lines}, ' ')")


def decoded(x: str) -> str:
    for name, char in extract.REFERENCES.items():
        x = f"replace({x}, {quoted(name)}, {quoted(char)})"
    return x


def body_lines(x: str) -> str:
    out = f"regexp_replace({x}, '(?s)<!--.*?(-->|\\z)', '', 'g')"
    for tag in ["head", *extract.FURNITURE]:
        out = f"regexp_replace({out}, '(?is)<{tag}(\\s[^>]*)?>.*?(</{tag}\\s*>|\\z)', chr(10), 'g')"
    return decoded(f"regexp_replace(regexp_replace({out}, '<[^<>]*>', chr(10), 'g'), '<[/!a-zA-Z][^<>]*\\z', '')")


def floor_text(x: str) -> str:
    return tidy(body_lines(x))


def container_text(x: str) -> str:
    return tidy(body_lines(f"regexp_extract({x}, '(?is)<(?:article|main)(?:\\s[^>]*)?>(.*?)(?:</article\\s*>|</main\\s*>|\\z)', 1)"))


def page_title(x: str) -> str:
    return f"trim(regexp_extract({x}, {quoted(text.TITLE)}, 1))"


def title_key(x: str) -> str:
    return f"array_to_string(list_slice(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda w: length(w) > 2), 1, 8), ' ')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def authority(x: str) -> str:
    return f"lower(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def search_domain(x: str) -> str:
    return f"regexp_replace({authority(x)}, '^www\\.', '')"


def health_domain(x: str) -> str:
    return f"regexp_replace(split_part({authority(x)}, ':', 1), '^www\\.', '')"


def canonical_url(x: str) -> str:
    host = authority(x)
    for p in ("www", "m", "amp"):
        host = f"regexp_replace({host}, '^{p}\\.', '')"
    junk = "^(" + "|".join(urls.TRACKING) + ")"
    kept = f"array_to_string(list_transform(list_filter(string_split(regexp_extract({x}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '{junk}')), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    path = f"regexp_replace(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+$', '')"
    scheme = f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
    whole = f"(CASE WHEN {scheme} = '' THEN 'https' ELSE {scheme} END) || '://' || {host} || (CASE WHEN {path} = '' THEN '/' ELSE {path} END) || (CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END)"
    return f"(CASE WHEN {authority(x)} = '' THEN {x} ELSE {whole} END)"


def junk_domain(x: str) -> str:
    return f"{search_domain(x)} IN {in_list(ranking.JUNK_DOMAINS)}"
