"""URL expressions: path nodes, hosts, dates in paths, resolving hrefs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The special characters whose distinct count describes a URL,
# in the order in which they are written into a mined character class.
URL_SPECIALS = ["?", "&", "=", ".", "_", "+"]

# Date layouts found in URL paths, tried in this order.
URL_DATE_LAYOUTS = [
    (r"/(\d{4}-\d{1,2}-\d{1,2})/", "yyyy-M-d"),
    (r"/(\d{4}-\d{1,2}/\d{1,2})/", "yyyy-M/d"),
    (r"/(\d{4}/\d{1,2}-\d{1,2})/", "yyyy/M-d"),
    (r"/(\d{4}/\d{1,2}/\d{1,2})/", "yyyy/M/d"),
    (r"/(\d{6}/\d{1,2})/", "yyyyMM/d"),
    (r"/(\d{4}/\d{4})/", "yyyy/MMdd"),
    (r"/(\d{6}-\d{2})/", "yyyyMM-dd"),
    (r"/\d{6}/t(\d{8})_", "yyyyMMdd"),
    (r"/(\d{8})/", "yyyyMMdd"),
    (r"/(\d{6})/", "yyyyMM"),
]

HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
ROOT_PATTERN = r"^(https?://[^/?#]+)"
PATH_PATTERN = r"^[^:]+://[^/?#]+([^?#]*)"


def url_nodes(url: Column) -> Column:
    """Non-empty path pieces after the host; query and fragment stay in the last piece."""
    pieces = F.split(url, "/")
    return F.filter(F.slice(pieces, 4, F.size(pieces)), lambda piece: piece != "")


def short_url(url: Column) -> Column:
    return F.array_join(url_nodes(url), "/")


def special_kinds(short: Column) -> Column:
    """How many of the six special characters occur at least once."""
    return reduce(
        lambda total, mark: total + F.contains(short, F.lit(mark)).cast("int"),
        URL_SPECIALS,
        F.lit(0),
    )


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST_PATTERN, 1))


def site_root(url: Column) -> Column:
    return F.regexp_extract(url, ROOT_PATTERN, 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, PATH_PATTERN, 1)


def url_date(url: Column) -> Column:
    """Date written in the path; the first layout that matches and parses wins."""
    return F.coalesce(
        *[
            F.try_to_date(F.regexp_extract(url, pattern, 1), layout)
            for pattern, layout in URL_DATE_LAYOUTS
        ]
    )


def host_under(host: Column, domain: Column) -> Column:
    """True when the host is the domain itself or one of its subdomains."""
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def _squash_dots(path: Column) -> Column:
    """Resolve '.' and '..' path segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(part == ".", done)
        .otherwise(F.concat(done, F.array(part))),
    )
    # A trailing dot segment names a directory, so its slash stays.
    directory = path.rlike(r"/\.\.?$")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(directory & (F.size(kept) > 0), "/").otherwise(""))


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute URL of an href found on the page at `base`."""
    href = F.btrim(href)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_extract(base, r"^([^#]*)", 1)
    no_query = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(url_path(base), r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    joined = F.when(F.startswith(href, F.lit("/")), href).otherwise(F.concat(folder, href))
    joined_path = F.regexp_extract(joined, r"^([^?#]*)", 1)
    joined_tail = F.regexp_extract(joined, r"^[^?#]*(.*)$", 1)
    joined_path = F.when(joined_path.rlike(r"/\.\.?(/|$)"), _squash_dots(joined_path)).otherwise(joined_path)
    return (
        F.when(href == "", no_fragment)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^/]+)//", 1), href))
        .when(F.startswith(href, F.lit("?")), F.concat(no_query, href))
        .when(F.startswith(href, F.lit("#")), F.concat(no_fragment, href))
        .otherwise(F.concat(origin, joined_path, joined_tail))
    )
