"""Column functions of the reasoning step: defaults, location parsing and
normalisation of a model's JSON answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R




def default_severity(data_type: Column) -> Column:
    t = F.upper(F.coalesce(data_type, F.lit("")))
    return (
        F.when(t.isin(*R.CRITICAL_TYPES), F.lit("CRITICAL"))
        .when(t.isin(*R.HIGH_TYPES), F.lit("HIGH"))
        .otherwise(F.lit(R.DEFAULT_SEVERITY))
    )


def location_file(location: Column) -> Column:
    """Part before the first ':' (the whole location when there is none)."""
    return F.split(F.coalesce(location, F.lit("")), ":", -1)[0]


def path_extension(file_name: Column) -> Column:
    """Lower-cased extension of the last path segment ('' when none)."""
    base = F.regexp_extract(file_name, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(base, r"(\.[^.]+)$", 1))


def is_code_finding(detected_by: Column, location: Column) -> Column:
    return (F.upper(F.coalesce(detected_by, F.lit(""))) == R.DETECTED_BY_CODE) | path_extension(
        location_file(location)
    ).isin(*R.CODE_EXTENSIONS)


def default_fix_tool(data_type: Column, detected_by: Column, location: Column) -> Column:
    t = F.upper(F.coalesce(data_type, F.lit("")))
    return (
        F.when(is_code_finding(detected_by, location), F.lit("REDACT_CODE_LINE"))
        .when(t.isin(*R.CRITICAL_TYPES), F.lit("DROP_COLUMN"))
        .when(t.isin(*R.HIGH_TYPES), F.lit("MASK_COLUMN"))
        .otherwise(F.lit("ANONYMIZE_COLUMN"))
    )


def location_line(location: Column) -> Column:
    """Last positive integer among the ':'-separated parts, else NULL."""
    parts = F.reverse(F.split(F.coalesce(location, F.lit("")), ":", -1))
    nums = F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("int")), lambda n: n > 0)
    return F.try_element_at(nums, F.lit(1))


def location_column(location: Column, mode: str = "applier") -> Column:
    """Column named after ``column=`` (case-insensitive marker).

    ``mode='reasoner'`` stops at the first ':', ',' or space (so a name with
    a space is cut); ``mode='applier'`` takes the trimmed rest.
    """
    loc = F.coalesce(location, F.lit(""))
    idx = F.instr(F.lower(loc), "column=")
    rest = F.substring(loc, idx + 7, F.length(loc))
    if mode == "reasoner":
        val = F.regexp_extract(rest, r"^([^:, ]*)", 1)
    else:
        val = F.trim(rest)
    return F.when(idx > 0, val)


def location_file_name(location: Column) -> Column:
    """File part as the fix applier reads it: before the first ':' when it
    is not the first character, trimmed; NULL when blank."""
    loc = F.coalesce(location, F.lit(""))
    idx = F.instr(loc, ":")
    name = F.trim(F.when(idx > 1, F.substring(loc, 1, idx - 1)).otherwise(loc))
    return F.when(name != "", name)


def default_fix_args(data_type: Column, location: Column, fix_tool: Column) -> Column:
    """``map<string,string>`` of the default arguments of a fix tool."""
    redact = F.map_filter(
        F.create_map(
            F.lit("reason"), F.concat(F.lit("Contains "), F.coalesce(data_type, F.lit(""))),
            F.lit("line"), location_line(location).cast("string"),
        ),
        lambda k, v: v.isNotNull(),
    )
    column = F.coalesce(location_column(location, "reasoner"), F.lower(F.coalesce(data_type, F.lit("value"))))
    mask = F.create_map(F.lit("column"), column, F.lit("style"), F.lit(R.MASK_STYLE_DEFAULT))
    other = F.create_map(F.lit("column"), column)
    return (
        F.when(fix_tool == "REDACT_CODE_LINE", redact)
        .when(fix_tool == "MASK_COLUMN", mask)
        .otherwise(other)
    )


def fix_args_text(args: Column) -> Column:
    """``k: "v"`` pairs joined by ', ' (map order)."""
    return F.array_join(
        F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit(': "'), e["value"], F.lit('"'))),
        ", ",
    )


REASONING_TYPE = (
    "struct<is_violation:boolean,severity:string,fix_tool:string,"
    "fix_args:map<string,string>,policy_clause_id:string,explanation:string>"
)


def deterministic_reasoning(
    data_type: Column,
    location: Column,
    detected_by: Column,
    clause_id: Column,
    clause_title: Column,
    prior_clause_id: Column | None = None,
) -> Column:
    """Offline reasoning result (always a violation)."""
    cid = F.coalesce(clause_id, prior_clause_id if prior_clause_id is not None else F.lit(None).cast("string"), F.lit(R.UNKNOWN_CLAUSE))
    tool = default_fix_tool(data_type, detected_by, location)
    title = F.when(F.length(F.coalesce(clause_title, F.lit(""))) > 0, F.concat(F.lit(" ("), clause_title, F.lit(")"))).otherwise(
        F.lit("")
    )
    explanation = F.concat(
        F.coalesce(data_type, F.lit("")), F.lit(" detected at "), F.coalesce(location, F.lit("")),
        F.lit("; this implicates "), cid, title, F.lit("."),
    )
    return F.struct(
        F.lit(True).alias("is_violation"),
        default_severity(data_type).alias("severity"),
        tool.alias("fix_tool"),
        default_fix_args(data_type, location, tool).alias("fix_args"),
        cid.alias("policy_clause_id"),
        explanation.alias("explanation"),
    )


def _kind(v: Column, path: str) -> Column:
    """JSON kind of a field of a VARIANT (NULL when absent)."""
    sub = F.try_variant_get(v, path, "variant")
    return F.when(sub.isNotNull(), F.schema_of_variant(sub))


def extract_json_object(raw: Column) -> Column:
    """Text from the first '{' to the last '}', NULL when there is none."""
    start = F.instr(raw, "{")
    end = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    ok = (F.coalesce(F.trim(raw), F.lit("")) != "") & (start > 0) & (F.instr(raw, "}") > 0) & (end > start)
    return F.when(ok, F.substring(raw, start, end - start + 1))


def normalize_model_response(
    raw: Column,
    data_type: Column,
    location: Column,
    detected_by: Column,
    fallback_clause_id: Column,
) -> Column:
    """Validated reasoning struct from a model's raw answer, NULL when the
    answer holds no parseable JSON object.

    ``is_violation`` defaults to true and accepts the text "true"; severity
    and tool must be one of the allowed values (else the defaults); only
    string-kind fields count; ``fix_args`` must be an object (else default
    arguments).  Strings that a lenient parser would accept as a valid
    prefix followed by other text are accepted too (documented leniency).
    """
    text = extract_json_object(raw)
    v = F.try_parse_json(text)
    is_obj = F.schema_of_variant(v).startswith("OBJECT")

    def s(path: str) -> Column:
        return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))

    iv_kind = _kind(v, "$.is_violation")
    iv_text = F.lower(F.trim(F.coalesce(F.try_variant_get(v, "$.is_violation", "string"), F.lit(""))))
    is_violation = (
        F.when(iv_kind.isNull(), F.lit(True))
        .when(iv_kind == "BOOLEAN", F.coalesce(F.try_variant_get(v, "$.is_violation", "boolean"), F.lit(False)))
        .when(iv_kind == "STRING", iv_text == "true")
        .otherwise(F.lit(False))
    )
    sev = F.upper(s("$.severity"))
    severity = F.when(sev.isin(*R.SEVERITIES), sev).otherwise(default_severity(data_type))
    tl = F.upper(s("$.fix_tool"))
    tool = F.when(tl.isin(*R.FIX_TOOLS), tl).otherwise(default_fix_tool(data_type, detected_by, location))
    cid_raw = s("$.policy_clause_id")
    cid = F.when(F.coalesce(F.trim(cid_raw), F.lit("")) != "", cid_raw).otherwise(
        F.coalesce(fallback_clause_id, F.lit(R.UNKNOWN_CLAUSE))
    )
    ex_raw = s("$.explanation")
    explanation = F.when(F.coalesce(F.trim(ex_raw), F.lit("")) != "", ex_raw).otherwise(
        F.concat(F.coalesce(data_type, F.lit("")), F.lit(" detected; review against "), cid, F.lit("."))
    )
    args_obj = F.when(
        F.coalesce(_kind(v, "$.fix_args"), F.lit("")).startswith("OBJECT"),
        F.try_variant_get(v, "$.fix_args", "map<string,string>"),
    )
    args = F.coalesce(args_obj, default_fix_args(data_type, location, tool))
    result = F.struct(
        is_violation.alias("is_violation"),
        severity.alias("severity"),
        tool.alias("fix_tool"),
        args.alias("fix_args"),
        cid.alias("policy_clause_id"),
        explanation.alias("explanation"),
    )
    return F.when(v.isNotNull() & F.coalesce(is_obj, F.lit(False)), result)


def reasoning_as_json(reasoning: Column) -> Column:
    """A reasoning struct rendered as a model would answer it (JSON text)."""
    return F.to_json(reasoning)
