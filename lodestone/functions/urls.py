"""URL functions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: file endings that are no pages, wherever they stand in a URL.
NO_PAGE = r"\.(pdf|jpg|png|gif|css|js)"


def authority(url: Column) -> Column:
    """Host with port, as written; null for what is no URL."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit(""))


def same_site(url: Column, base: Column) -> Column:
    """Whether ``url`` is a page of ``base``'s site: same authority, no file
    ending of other media anywhere, no fragment.  Null counts as no."""
    ok = (authority(url) == authority(base)) & ~F.lower(url).rlike(NO_PAGE) & ~F.contains(url, F.lit("#"))
    return F.coalesce(ok, F.lit(False))


def _join(base: str | None, href: str | None) -> str | None:
    try:
        return None if base is None or href is None else urljoin(base, href)
    except ValueError:
        return None


@F.pandas_udf(StringType())
def resolve(base: pd.Series, href: pd.Series) -> pd.Series:
    """``href`` against ``base``, by the rules of relative references."""
    return pd.Series([_join(b, h) for b, h in zip(base, href)])


def file_stem(base: Column) -> Column:
    """Default file name stem of a site: its authority with underscores."""
    return F.replace(authority(base), F.lit("."), F.lit("_"))
