"""Pure Column expressions over text (no UDFs; all stay in codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.splitlines() boundaries: \r\n, \n, \r, \v, \f, \x1c-\x1e, \x85,  ,  .
LINE_BREAK_RE = "\\r\\n|[\\n\\r\\u000b\\u000c\\u001c\\u001d\\u001e\\u0085\\u2028\\u2029]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_lines(s) -> Column:
    """Split like Python's ``str.splitlines()`` (no trailing empty line).

    '' gives an empty array, as in Python.
    """
    s = _c(s)
    parts = F.split(s, LINE_BREAK_RE, -1)
    n = F.size(parts)
    last_empty = F.try_element_at(parts, F.lit(-1)) == F.lit("")
    return (F.when(s.isNull(), F.lit(None))
            .when(s == "", F.array().cast("array<string>"))
            .when(last_empty, F.slice(parts, 1, n - 1))
            .otherwise(parts))


def token_estimate(s) -> Column:
    """0 for empty text, else max(1, chars div 4)."""
    n = F.length(F.coalesce(_c(s), F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def cap(s, n: int) -> Column:
    """First n characters (code points), as Python slicing does."""
    return F.substring(_c(s), 1, n)


# Characters Python's str.isspace() accepts (str.strip() default set).
PY_SPACE_CLASS = "[\\t\\n\\u000b\\f\\r\\u001c-\\u001f \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def py_strip(s) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace."""
    return F.regexp_replace(_c(s), f"^{PY_SPACE_CLASS}+|{PY_SPACE_CLASS}+$", "")


def pr_description(body, max_chars: int | None = 1000) -> Column:
    """Null -> '', stripped, capped (whole with None)."""
    text = py_strip(F.coalesce(_c(body), F.lit("")))
    return text if max_chars is None else cap(text, max_chars)


def percent_text(x) -> Column:
    """``f"{x:.0%}"`` — zero decimals, round half to even."""
    return F.concat(F.bround(_c(x) * 100, 0).cast("long").cast("string"), F.lit("%"))


def iso_to_date(s) -> Column:
    """ISO text -> timestamp -> date; unparseable text gives NULL."""
    return F.to_date(F.try_to_timestamp(_c(s)))


def ts_to_iso(ts) -> Column:
    """Timestamp -> ISO-8601 text with microseconds (UTC session zone)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def now_iso() -> Column:
    """The current UTC time as ISO text with offset."""
    return F.concat(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def empty_to(s, label: str) -> Column:
    """X09: '' (or NULL) -> label."""
    s = _c(s)
    return F.when(F.coalesce(s, F.lit("")) == "", F.lit(label)).otherwise(s)


def preview(s, n: int = 80) -> Column:
    """First n chars, with an ellipsis when longer."""
    s = _c(s)
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def title_case(s) -> Column:
    """Title case of a single word (severity names)."""
    return F.initcap(_c(s))


def short_sha(s, n: int = 12) -> Column:
    return F.substring(_c(s), 1, n)
