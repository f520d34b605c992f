"""Column functions on names, paths and addresses of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def package_of(name) -> Column:
    """What stands before the last dot, or ''."""
    return F.regexp_extract(_c(name), r"^(.*)\.[^.]*$", 1)


def simple_name(name) -> Column:
    """What stands after the last dot or dollar sign."""
    return F.regexp_extract(_c(name), r"([^.$]*)$", 1)


def segments(name) -> Column:
    return F.split(_c(name), r"\.")


def dotted(parts) -> Column:
    return F.array_join(_c(parts), ".")


def strip_package(name, package) -> Column:
    """Segments (array) left of ``name`` after the segments of ``package``; null if they are no
    prefix; a null package strips nothing."""
    n, p = _c(name), _c(package)
    rest = F.slice(n, F.size(p) + 1, F.greatest(F.size(n) - F.size(p), F.lit(0)))
    fits = (F.size(n) >= F.size(p)) & (F.slice(n, F.lit(1), F.size(p)) == p)
    return F.when(p.isNull(), n).when(fits, rest)


def same_package(a, b) -> Column:
    """Two unnamed packages are the same; an unnamed and a named one are not."""
    return _c(a).eqNullSafe(_c(b))


def uri_to_path(uri) -> Column:
    """Path of a ``file:`` address, percent signs decoded; null for other schemes."""
    u = _c(uri)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    path = F.regexp_extract(u, r"^[^:]*:(?://[^/]*)?([^?#]*)", 1)
    return F.when(scheme == "file", F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def path_to_uri(kind, path) -> Column:
    """``file://`` and the path of a source file; null for other kinds and paths that would need
    percent signs."""
    p = _c(path)
    return F.when((_c(kind) == "SOURCE_FILE") & p.rlike(r"^/[A-Za-z0-9/._~$&'()*+,;=:@!-]*$"), F.concat(F.lit("file://"), p))


def is_java_source(kind, path) -> Column:
    """A source file whose extension is exactly ``java``; a bare ``.java`` has none."""
    return (_c(kind) == "SOURCE_FILE") & _c(path).rlike(r"[^/]\.java$")
