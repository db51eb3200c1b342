"""Dimension lookups (J09) as Column expressions.

Small constant dictionaries become CASE expressions (codegen, no join and no
broadcast); every lookup has an explicit default.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens import schemas as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(key, mapping: dict, default) -> Column:
    """CASE key WHEN k1 THEN v1 ... ELSE default END."""
    key = _c(key)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(key == F.lit(k), F.lit(v)) if expr is None
                else expr.when(key == F.lit(k), F.lit(v)))
    default = default if isinstance(default, Column) else F.lit(default)
    return default if expr is None else expr.otherwise(default)


def normalise_severity(s) -> Column:
    """CRITICAL->critical, WARNING->high, SUGGESTION->low, else lower-case."""
    s = _c(s)
    return lookup(F.upper(s), S.STORED_TO_SEVERITY, F.lower(s))


def severity_rank(s) -> Column:
    """Position in the worst-first order (1 = critical); NULL if unknown."""
    return lookup(s, {v: i + 1 for i, v in enumerate(S.SEVERITY_ORDER)}, F.lit(None).cast("int"))


def stored_severity_from_rank(rank) -> Column:
    """Worst finding severity -> stored label (critical->CRITICAL,
    high->WARNING, anything else or none -> SUGGESTION)."""
    return lookup(rank, {1: "CRITICAL", 2: "WARNING"}, "SUGGESTION")


def severity_icon(s) -> Column:
    return lookup(s, S.SEVERITY_ICONS, "•")


def language_of(filename) -> Column:
    """X01: '.' + text after the last dot of the whole path -> language."""
    f = _c(filename)
    ext = F.when(F.instr(f, ".") > 0, F.concat(F.lit("."), F.substring_index(f, ".", -1))).otherwise(F.lit(""))
    return lookup(ext, S.EXTENSION_LANGUAGE, "unknown")


def prompt_status(accepted) -> Column:
    """X11: acceptance label in the prompt context."""
    return lookup(accepted, S.PROMPT_STATUS, "unrated")


def history_status(accepted) -> Column:
    """X11: acceptance label in the history table."""
    return lookup(accepted, S.HISTORY_STATUS, "— Unrated")


def verdict_emoji(v) -> Column:
    return lookup(v, S.VERDICT_EMOJI, S.VERDICT_EMOJI_DEFAULT)


def verdict_display(v) -> Column:
    """X29: '<emoji> NEEDS CHANGES'."""
    v = _c(v)
    return F.concat_ws(" ", verdict_emoji(v), F.upper(F.replace(v, F.lit("_"), F.lit(" "))))


def verdict_slack_emoji(v) -> Column:
    """Rich-notification emoji, looked up on the bare verdict words."""
    return lookup(F.upper(F.replace(_c(v), F.lit("_"), F.lit(" "))), S.VERDICT_SLACK_EMOJI,
                  S.VERDICT_SLACK_EMOJI_DEFAULT)
