"""URL helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def canonical_url(col: Column | str) -> Column:
    """Lower-case scheme and host, no trailing slash, no fragment; the query stays."""
    url = _c(col)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_extract(rest, r"^([^?#]*)", 1)
    search = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.concat(scheme, F.lit("://"), host, F.when(trimmed == "", "/").otherwise(trimmed), F.when(search != "?", search).otherwise(""))


def same_url(a: Column | str, b: Column | str) -> Column:
    return F.coalesce((_c(a) != "") & (_c(b) != "") & (canonical_url(a) == canonical_url(b)), F.lit(False))


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """href seen from a page: absolute, protocol-relative, root-relative, fragment, query or relative path.

    Both inputs go through a one-element transform, so each is worked out once however often the rules name it.
    """

    def resolve(pair: Column) -> Column:
        page, link = pair["page"], F.trim(pair["link"])
        origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
        no_fragment = F.regexp_replace(page, "#.*$", "")
        no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
        folder = F.regexp_replace(no_query, r"(?<=[^/:])/[^/]*$", "")
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link.startswith("#"), F.concat(no_fragment, link))
            .when(link.startswith("?"), F.concat(no_query, link))
            .when(link == "", page)
            .otherwise(F.concat(folder, F.lit("/"), link))
        )

    pair = F.struct(_c(base).alias("page"), _c(href).alias("link"))
    return F.get(F.transform(F.array(pair), resolve), F.lit(0))


def url_path(col: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(_c(col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
