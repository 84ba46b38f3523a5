"""Column functions for the code rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

# All loops over text are possessive: Java's engine runs them without a stack
# frame per character, and a failed match is not tried again in pieces.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'

# An identifier, an optional '+', '=', then one complete double-quoted literal.
LITERAL_ASSIGNMENT = r"([A-Za-z_][A-Za-z0-9_]*+)\s*+\+?=\s*+" + _QUOTED


def classify_identifier(name: Column) -> Column:
    """Sensitive data type suggested by an identifier (first rule wins)."""
    n = F.lower(name)
    expr = None
    for needles, dtype in R.IDENTIFIER_RULES:
        cond = None
        for kind, needle in needles:
            c = (n == F.lit(needle)) if kind == "equals" else (F.instr(n, needle) > 0)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(dtype)) if expr is None else expr.when(cond, F.lit(dtype))
    return expr.otherwise(F.lit(None).cast("string"))


def is_logging_call(receiver: Column, method: Column) -> Column:
    return method.startswith(R.LOG_METHOD_PREFIX) | (
        method.isin(*R.CONSOLE_METHODS) & (receiver == F.lit(R.CONSOLE_RECEIVER))
    )


def is_http_call(method: Column) -> Column:
    return method.isin(*R.HTTP_METHODS)


def is_csharp(file_name: Column, language: Column) -> Column:
    """Code rules run on C# sources: by language hint, else by '.cs' suffix."""
    lang = F.lower(F.trim(F.coalesce(language, F.lit(""))))
    return F.when(lang != "", lang.isin(*R.CSHARP_LANGUAGES)).otherwise(
        F.lower(file_name).endswith(".cs")
    )
