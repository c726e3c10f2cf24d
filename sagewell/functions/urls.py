"""URL expressions on columns (host case, blanks and bars are kept apart from ``parse_url``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sagewell.functions.text import let

ABSOLUTE = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#\s]+)([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ABSOLUTE, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ABSOLUTE, 2))


def path(url: Column) -> Column:
    """Path without query, fragment or parameters; repeated and final slashes reduced."""
    raw = F.regexp_replace(F.rtrim(F.regexp_extract(url, ABSOLUTE, 3)), ";[^/]*$", "")
    flat = F.regexp_replace(F.when(raw == "", "/").otherwise(raw), "/{2,}", "/")
    return F.when(flat == "/", flat).otherwise(F.regexp_replace(flat, "/$", ""))


def canonical_url(url: Column) -> Column:
    """Canonical form, or null when the URL has no scheme or host."""
    full = F.concat(scheme(url), F.lit("://"), host(url), path(url))
    return F.when(url.rlike(ABSOLUTE), full)


def root_url(url: Column) -> Column:
    absolute = F.concat(scheme(url), F.lit("://"), host(url))
    return F.when(url.rlike(ABSOLUTE), absolute).otherwise(F.regexp_replace(F.trim(url), "/+$", ""))


def site_key(url: Column) -> Column:
    """Slug of the host: ``https://m.example.org/x`` gives ``m-example-org``."""
    source = F.when(url.rlike(ABSOLUTE), host(url)).otherwise(F.lower(root_url(url)))
    slug = F.regexp_replace(F.regexp_replace(source, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "default").otherwise(slug)


def without_dots(path: Column) -> Column:
    """Path without ``.`` and ``..`` segments; one that ends in such a segment ends with a slash."""

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment == ".", kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    # The empty segment before the first slash is left out, so that ``..`` cannot remove the root.
    segments = F.split(F.regexp_replace(F.regexp_replace(path, r"(/\.\.?)$", "$1/"), "^/", ""), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolve(link: Column, base: Column) -> Column:
    """Absolute form of a link found on page ``base``.

    The link may be absolute, relative to the scheme, root or folder, or only a query or fragment of the page.
    """
    origin = F.concat(scheme(base), F.lit("://"), host(base))
    page = F.regexp_extract(base, ABSOLUTE, 3)
    folder = F.regexp_replace(page, "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    local = F.regexp_extract(link, "^[^?#]*", 0)
    rest = F.regexp_extract(link, "[?#].*$", 0)
    absolute = F.when(local == "", page).when(local.startswith("/"), local).otherwise(F.concat(folder, local))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.\\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme(base), F.lit(":"), link))
        .otherwise(F.concat(origin, let(absolute, without_dots), rest))
    )
