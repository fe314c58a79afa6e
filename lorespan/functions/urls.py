"""URL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespan.fixed_values import SKIP_EXTENSIONS, SKIP_WORDS


def trim_slashes(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def canonical(url: Column) -> Column:
    """Drop the fragment, then trailing slashes."""
    return trim_slashes(F.substring_index(url, "#", 1))


def site_of(url: Column) -> Column:
    """Lower-case authority (port and user kept) without one leading ``www.``."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.lower(authority), r"^www\.", "")


def on_site(url: Column, domain: Column | str) -> Column:
    wanted = F.lit(domain) if isinstance(domain, str) else domain
    return site_of(url) == wanted


def skipped(url: Column) -> Column:
    """Files and account pages that are never fetched.

    Plain searches instead of one pattern: this runs on every link.
    """
    low = F.lower(url)
    ending = F.concat(F.lit("."), F.substring_index(low, ".", -1))
    is_file = F.contains(low, F.lit(".")) & ending.isin(*SKIP_EXTENSIONS)
    for word in SKIP_WORDS:
        is_file = is_file | F.contains(low, F.lit(word))
    return is_file
