"""Pieces of SQL that several checks share."""

from pagemill.functions import urls


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


TRACKING = quoted(urls.TRACKING)
SCHEME = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)', 1))"
HOST = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)', 2))"
PATH = "coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), ''), '/')"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
SEGMENTS = f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')"
KEPT = (
    f"list_filter(string_split({QUERY}, '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({TRACKING})"
    " and not starts_with(lower(split_part(p, '=', 1)), 'utm_'))"
)
SORTED = f"list_transform(list_sort(list_transform({KEPT}, lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'p': p}})), lambda s: s.p)"
TRIMMED = f"case when {PATH} = '/' then '/' else regexp_replace({PATH}, '/+$', '') end"
CANONICAL = f"{SCHEME} || '://' || {HOST} || {TRIMMED} || case when len({KEPT}) > 0 then '?' || array_to_string({SORTED}, '&') else '' end"
DEPTH = f"len({SEGMENTS})"


def last_labels(name: str, n: str) -> str:
    return f"array_to_string(list_slice(string_split({name}, '.'), greatest(len(string_split({name}, '.')) - ({n}) + 1, 1), len(string_split({name}, '.'))), '.')"


REGISTRABLE = last_labels(HOST, f"case when {last_labels(HOST, '2')} in ({quoted(urls.TWO_LABEL_SUFFIXES)}) then 3 else 2 end")
