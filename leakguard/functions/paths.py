"""URL routing and file-size columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakguard.schemas import RATIO_UNIT

# The first slash is taken for good, so that "/en" has no second one.
_ROUTE_RE = r"^/?+([^/]*)(/(?s:.*))$"

_LONGEST = (1 << 63) - 1

SIZE = "SIZE"
EMPTY = "EMPTY"
MISSING = "MISSING"
NO_ROUTE = "NO_ROUTE"
IS_DIR = "IS_DIR"
ERROR = "ERROR"


def has_route_shape(url: Column) -> Column:
    """True when a second path separator follows the tag."""
    return F.coalesce(url.rlike(_ROUTE_RE), F.lit(False))


def url_tag(url: Column) -> Column:
    return F.when(has_route_shape(url), F.regexp_extract(url, _ROUTE_RE, 1))


def url_rest(url: Column) -> Column:
    return F.when(has_route_shape(url), F.regexp_extract(url, _ROUTE_RE, 2))


def trim_root(root: Column) -> Column:
    """Drop exactly one trailing slash."""
    return F.regexp_replace(root, "/$", "")


def size_outcome(path: Column, found: Column, is_dir: Column, size: Column) -> Column:
    """Why a request can or cannot be tracked.

    ``path`` NULL means no route; a listed file whose size is unknown is an
    error; a file of size zero has no meaningful ratio.
    """
    return (
        F.when(path.isNull(), NO_ROUTE)
        .when(found.isNull(), MISSING)
        .when(is_dir, IS_DIR)
        .when(size.isNull() | (size < 0), ERROR)
        .when(size == 0, EMPTY)
        .otherwise(SIZE)
    )


def ratio_cost(sent: Column, size: Column) -> Column:
    """Share of the file that was sent, in 1/100,000 of the file.

    Widened to decimal; a share beyond a long is held at the largest long.
    """
    scaled = sent.cast("decimal(19,0)") * F.lit(RATIO_UNIT).cast("decimal(6,0)")
    whole = size.cast("decimal(19,0)")
    fits = scaled < whole * F.lit(_LONGEST).cast("decimal(19,0)")
    return F.when(fits, F.call_function("div", F.when(fits, scaled), whole)).when(scaled.isNotNull() & whole.isNotNull(), F.lit(_LONGEST))
