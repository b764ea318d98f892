"""Paths and links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import constants as C

UNGROUPED = "_ungrouped"
UNGROUPED_LABEL = "未分组"


def series_id(path: Column) -> Column:
    """Name of the parent folder; files without one go to a common group."""
    parent = F.trim(F.regexp_extract(path, r"([^/\\]+)[/\\]+[^/\\]+$", 1))
    return F.coalesce(F.nullif(parent, F.lit("")), F.lit(UNGROUPED))


def series_label(series: Column) -> Column:
    return F.when(series == UNGROUPED, F.lit(UNGROUPED_LABEL)).otherwise(series)


def _bare(text: Column) -> Column:
    return F.btrim(F.btrim(F.trim(F.coalesce(text, F.lit(""))), F.lit('"')), F.lit("'"))


def looks_like_link(text: Column, host_pattern: str = C.RE_KNOWN_HOST) -> Column:
    t = _bare(text)
    drive = t.rlike(r"^[A-Za-z]:[\\/]") | t.startswith("\\\\")
    return (t != "") & ~drive & (t.rlike("(?i)^https?://") | t.rlike(host_pattern))


def with_scheme(text: Column) -> Column:
    t = _bare(text)
    return F.when(t.rlike("(?i)^https?://"), t).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(t, "^/+", ""))
    )


def canonical_link(link: Column) -> Column:
    """Lower-case scheme and host, no closing '/', no fragment; the query stays."""
    pattern = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    path = F.regexp_replace(F.regexp_extract(link, pattern, 3), "/+$", "")
    query = F.regexp_extract(link, pattern, 4)
    return F.concat(
        F.lower(F.regexp_extract(link, pattern, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(link, pattern, 2)),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "?", "").otherwise(query),
    )


def link_id(text: Column) -> Column:
    return F.substring(F.sha1(canonical_link(with_scheme(text)).cast("binary")), 1, 16)


def file_id(path: Column, size: Column, modified_s: Column) -> Column:
    raw = F.concat_ws("|", path, size.cast("string"), modified_s.cast("string"))
    return F.substring(F.md5(raw.cast("binary")), 1, 16)


def is_document(path: Column, suffixes: tuple[str, ...]) -> Column:
    tail = "|".join(s.lstrip(".") for s in suffixes)
    return path.rlike(rf"(?i)[^/\\]\.(?:{tail})$")
