"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: phrases of page furniture that cleaning deletes, anywhere.
FURNITURE = "(?i)(Skip to main content|Table of contents|Navigation|Menu)"


def words(text: Column) -> Column:
    """Words between runs of Unicode white space, without empties."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """White space collapsed and trimmed, then page furniture deleted; what is
    left is not trimmed again.  Null becomes empty."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(one, FURNITURE, "")


def preview(text: Column, n: int = 100) -> Column:
    """The first ``n`` characters and always an ellipsis."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def or_default(x: Column, default: str) -> Column:
    """``default`` for null and for the empty string."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def file_size(size: Column) -> Column:
    """Bytes in words, two decimals at most; null from a terabyte on."""
    def part(power: int, unit: str) -> Column:
        value = F.format_string("%.2f", F.bround(size.cast("decimal(30,6)") / F.lit(1024**power), 2).cast("double"))
        return F.concat(F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", ""), F.lit(" " + unit))

    return (
        F.when(size == 0, F.lit("0 Bytes")).when(size < 1024, F.concat(size.cast("string"), F.lit(" Bytes")))
        .when(size < 1024**2, part(1, "KB")).when(size < 1024**3, part(2, "MB")).when(size < 1024**4, part(3, "GB"))
    )


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def clock(ts: Column, seconds: bool = True) -> Column:
    return F.date_format(ts, "HH:mm:ss" if seconds else "HH:mm")


def iso_instant(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def pretty_json(**values: Column) -> Column:
    """An object of strings as JSON of several lines, two blanks deep."""
    def plain(c: Column) -> Column:
        one = F.to_json(F.array(c.cast("string")))
        return F.substring(one, F.lit(2), F.length(one) - 2)

    rows = [F.concat(F.lit(f'  "{n}": '), plain(c)) for n, c in values.items()]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *rows), F.lit("\n}"))


def rule_line(n: int = 80) -> Column:
    return F.repeat(F.lit("-"), F.lit(n))


def suffix(name: Column) -> Column:
    """The last extension with its dot; empty for none or a leading dot only."""
    return F.regexp_extract(name, r"[^/](\.[^./]+)$", 1)
