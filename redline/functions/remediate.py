"""Column functions of the deterministic fixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def mask(value: Column, style: Column | str = R.MASK_STYLE_DEFAULT) -> Column:
    """Blank/NULL kept; ``full`` -> ``***``; ``partial``: an '@' after the
    first character keeps the domain (``j***@gmail.com``), otherwise the
    first character plus ``***``."""
    st = F.lit(style) if isinstance(style, str) else style
    at = F.instr(value, "@")
    first = F.substring(value, 1, 1)
    partial = F.when(at > 1, F.concat(first, F.lit(R.MASK_STARS), F.substring(value, at, F.length(value)))).otherwise(
        F.concat(first, F.lit(R.MASK_STARS))
    )
    full = F.lower(F.coalesce(st, F.lit(R.MASK_STYLE_DEFAULT))) == "full"
    return F.when(value.isNull() | (value == ""), value).when(full, F.lit(R.MASK_STARS)).otherwise(partial)


def anonymize(value: Column, salt: Column | str | None = None) -> Column:
    """``anon_`` + first 12 hex of SHA-256(salt + value); blank/NULL kept.
    Equal values give equal tokens, so joins on the column survive."""
    s = F.lit(salt) if isinstance(salt, str) else (salt if salt is not None else F.lit(""))
    token = F.concat(
        F.lit(R.ANON_PREFIX),
        F.substring(F.sha2(F.concat(F.coalesce(s, F.lit("")), value), 256), 1, R.ANON_HEX_CHARS),
    )
    return F.when(value.isNull() | (value == ""), value).otherwise(token)


def redaction_note(reason: Column, label: str, prefix: str = R.REDACT_COMMENT_PREFIX) -> Column:
    """``// [REDACTED by <label>: reason]`` (no reason -> no suffix)."""
    r = F.trim(F.coalesce(reason, F.lit("")))
    return F.when(r == "", F.lit(f"{prefix} [REDACTED by {label}]")).otherwise(
        F.concat(F.lit(f"{prefix} [REDACTED by {label}: "), r, F.lit("]"))
    )


def redact_lines(content: Column, notes: Column) -> Column:
    """Replace the lines named in ``notes`` (``map<int,string>`` of 1-based
    line -> note) with indentation + note; other lines and LF/CRLF endings
    are kept."""
    parts = F.split(content, "\n", -1)

    def one(line: Column, i: Column) -> Column:
        note = notes[i + 1]
        crlf = line.endswith("\r")
        body = F.when(crlf, F.substring(line, 1, F.length(line) - 1)).otherwise(line)
        indent = F.regexp_extract(body, r"^(\s*)", 1)
        return F.when(note.isNull(), line).otherwise(
            F.concat(indent, note, F.when(crlf, F.lit("\r")).otherwise(F.lit("")))
        )

    return F.array_join(F.transform(parts, one), "\n")


def line_count(content: Column) -> Column:
    return F.size(F.split(content, "\n", -1))


def parse_fix_args(json_text: Column) -> Column:
    """Fix arguments from JSON text: an object only (anything else, or bad
    JSON, gives an empty map); non-string values keep their JSON text; keys
    are lower-cased for case-insensitive lookup."""
    parsed = F.from_json(json_text, "map<string,string>")
    is_obj = F.ltrim(F.coalesce(json_text, F.lit(""))).startswith("{")
    m = F.when(is_obj, parsed)
    return lower_keys(F.coalesce(m, F.create_map().cast("map<string,string>")))


def lower_keys(m: Column) -> Column:
    """Map with lower-cased keys; of keys equal ignoring case the last one
    wins."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))

    def last(e: Column, i: Column) -> Column:
        # no later entry (position > i) carries the same key
        later = F.filter(entries, lambda x, j: j > i)
        return ~F.exists(later, lambda x: x["k"] == e["k"])

    kept = F.filter(entries, last)
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"].alias("key"), e["v"].alias("value"))))
