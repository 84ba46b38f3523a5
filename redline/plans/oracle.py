"""DuckDB SQL equivalents of the catalog queries (the correctness oracle).

The SQL restates each query independently in DuckDB's dialect over the
pre-registered views; only the fixed values (patterns, keyword lists, policy
clause data, stand-in rules) are shared with the Spark code.
"""

from __future__ import annotations

import glob
import json
import os

from ..functions import rules as R
from ..functions.policy import TOKEN_SPLIT
from ..sources.policies import BUILTIN_POLICY_DIR
from . import catalog as C

# Column lists of the driver tables (their fixed schemas).
TABLE_COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


def s(x: str | None) -> str:
    if x is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + x.replace("'", "''") + "'"


# Written for DuckDB's engine on its own, not shared with the Spark code.
LITERAL_ASSIGNMENT = r'([A-Za-z_][A-Za-z0-9_]*)[ \t\r\f\v]*[+]?=[ \t\r\f\v]*"(?:\\.|[^\\"])*"'

WS = "[" + R.WHITESPACE_CHARS + "]"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, {s('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def nonblank(x: str) -> str:
    return f"coalesce(regexp_replace({x}, {s(WS + '+')}, '', 'g') <> '', false)"


def fid(scan: str, file: str, line: str, col: str, det: str, rule: str, match: str) -> str:
    return (
        f"sha256(concat_ws('|', {scan}, {file}, CAST({line} AS VARCHAR), {col}, {det}, "
        f"CAST({rule} AS VARCHAR), CAST({match} AS VARCHAR)))"
    )


def luhn(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    dig = f"CAST(substr(reverse({d}), i + 1, 1) AS INTEGER)"
    return (
        f"(length({d}) BETWEEN {R.LUHN_MIN_DIGITS} AND {R.LUHN_MAX_DIGITS} AND list_sum(list_transform(range(length({d})), "
        f"lambda i: CASE WHEN i % 2 = 0 THEN {dig} WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 ELSE {dig} * 2 END)) % 10 = 0)"
    )


def tokens(x: str) -> str:
    return (
        f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({x}, '')), {s(TOKEN_SPLIT)}), "
        f"lambda t: length(t) >= {R.TOKEN_MIN_LENGTH}))"
    )


# ------------------------------------------------------------------ building blocks


def src_docs(name: str = "src", prefix: str = "documents/", suffix: str = "") -> str:
    return (
        f"{name} AS (SELECT CAST(source AS VARCHAR) AS scan_id, {s(prefix)} || CAST(doc_id AS VARCHAR) || {s(suffix)} "
        f"AS file_name, text AS content FROM documents)"
    )


def src_pages(name: str = "srcp", scan: str = "pages") -> str:
    return (
        f"{name} AS (SELECT {s(scan)} AS scan_id, 'pages/' || CAST(page_id AS VARCHAR) AS file_name, html AS content "
        f"FROM pages)"
    )


def lines(name: str, src: str, prefilter: str | None = None, keep_empty: bool = False) -> str:
    pf_src = f" AND regexp_matches(content, {s(prefilter)})" if prefilter else ""
    pf_line = f" AND regexp_matches(line, {s(prefilter)})" if prefilter else ""
    cond = "TRUE" if keep_empty else "length(line) > 0"
    return (
        f"{name}_r AS (SELECT scan_id, file_name, string_split(content, chr(10)) AS parts FROM {src} "
        f"WHERE content IS NOT NULL{pf_src}), "
        f"{name}_u AS (SELECT scan_id, file_name, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line_no FROM {name}_r), "
        f"{name}_t AS (SELECT scan_id, file_name, CAST(line_no AS BIGINT) AS line_no, regexp_replace(raw, '\\r+$', '') AS line "
        f"FROM {name}_u), "
        f"{name} AS (SELECT * FROM {name}_t WHERE {cond}{pf_line})"
    )


def matches(name: str, ln: str, rules: list[tuple[int, str, str, str | None]]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT scan_id, file_name, line_no, line, {o} AS rule_ord, {s(t)} AS data_type, "
        f"regexp_extract_all(line, {s(p)}) AS ms FROM {ln}"
        for (o, t, p, _v) in rules
    )
    checks = " AND ".join(f"(rule_ord <> {o} OR {luhn('match')})" for (o, _t, _p, v) in rules if v == "luhn") or "TRUE"
    return (
        f"{name}_a AS ({parts}), "
        f"{name}_b AS (SELECT scan_id, file_name, line_no, line, rule_ord, data_type, unnest(ms) AS match, "
        f"CAST(generate_subscripts(ms, 1) AS BIGINT) AS match_ord FROM {name}_a), "
        f"{name} AS (SELECT * FROM {name}_b WHERE {checks})"
    )


def text_findings(name: str, m: str) -> str:
    return (
        f"{name} AS (SELECT {fid('scan_id', 'file_name', 'line_no', 'NULL', chr(39) + 'REGEX' + chr(39), 'rule_ord', 'match_ord')} "
        f"AS finding_id, scan_id, file_name, line_no, rule_ord, data_type, match_ord, match, "
        f"file_name || ':' || CAST(line_no AS VARCHAR) AS location, {trim_ws('line')} AS snippet, 'REGEX' AS detected_by, "
        f"'MEDIUM' AS severity, 'PENDING_REVIEW' AS status, CAST(NULL AS VARCHAR) AS column_name FROM {m})"
    )


def doc_findings_ctes(prefix: str = "documents/", suffix: str = "", tf: str = "tf") -> list[str]:
    return [
        src_docs("src", prefix, suffix),
        lines("ln", "src", R.LINE_PREFILTER),
        matches("mt", "ln", R.TEXT_RULES),
        text_findings(tf, "mt"),
    ]


def cells_for(table: str, keys: list[str]) -> str:
    cols = TABLE_COLUMNS[table]
    structs = ", ".join(
        f"{{'col_pos': {i}, 'column_name': {s(c)}, 'value': CAST({c} AS VARCHAR)}}" for i, c in enumerate(cols)
    )
    k2 = keys[1] if len(keys) > 1 else "NULL"
    return (
        f"SELECT {s(table)} AS dataset, {keys[0]} AS k1, {k2} AS k2, unnest([{structs}]) AS c FROM {table}"
    )


def samples_ctes(tables: list[str]) -> list[str]:
    keyed = {t: ([k] if isinstance(k, str) else list(k)) for t, k in C.COLUMN_TABLES}
    union = " UNION ALL ".join(
        f"SELECT dataset, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2, c.col_pos AS col_pos, "
        f"c.column_name AS column_name, c.value AS value FROM ({cells_for(t, keyed[t])})"
        for t in tables
    )
    return [
        f"cells AS ({union})",
        f"samp AS (SELECT dataset, col_pos, column_name, value, row_number() OVER (PARTITION BY dataset, col_pos "
        f"ORDER BY k1, k2) AS sample_ord FROM cells WHERE {nonblank('value')} QUALIFY sample_ord <= "
        f"{R.SAMPLE_VALUES_PER_COLUMN})",
        "pc AS (SELECT dataset, col_pos, column_name, string_agg(value, chr(10) ORDER BY sample_ord) AS blob, "
        "max(CASE WHEN sample_ord = 1 THEN value END) AS first_sample FROM samp GROUP BY dataset, col_pos, column_name)",
    ]


def name_type(col: str) -> str:
    n = f"regexp_replace(lower({col}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')"
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains({n}, {s(k)})" for k in needles) + f" THEN {s(t)}"
        for needles, t in R.COLUMN_NAME_RULES
    )
    return f"CASE {whens} END"


def entity_count_cols(blob: str) -> str:
    return ", ".join(f"len(regexp_extract_all({blob}, {s(p)})) AS e{o}" for o, _c, p in R.ENTITY_PATTERNS)


def value_type_expr() -> str:
    g = "greatest(" + ", ".join(f"e{o}" for o, _c, _p in R.ENTITY_PATTERNS) + ")"
    whens = " ".join(
        f"WHEN e{o} = {g} THEN {s(R.ENTITY_CATEGORY_MAP.get(c, c.upper()))}" for o, c, _p in R.ENTITY_PATTERNS
    )
    return f"CASE WHEN {g} = 0 THEN NULL {whens} END"


def column_findings_ctes(tables: list[str], scan: str = "tables", name: str = "cf") -> list[str]:
    return samples_ctes(tables) + [
        f"pcx AS (SELECT *, {entity_count_cols('blob')}, {name_type('column_name')} AS name_type FROM pc)",
        f"pcy AS (SELECT *, {value_type_expr()} AS value_type FROM pcx)",
        f"{name} AS (SELECT {fid(s(scan), 'dataset', 'NULL', 'column_name', 'detected_by', 'NULL', 'col_pos + 1')} AS finding_id, "
        f"{s(scan)} AS scan_id, dataset AS file_name, column_name, coalesce(value_type, name_type) AS data_type, "
        f"dataset || ':column=' || column_name AS location, substr(first_sample, 1, {R.COLUMN_SNIPPET_MAX}) AS snippet, "
        f"detected_by, CAST(NULL AS BIGINT) AS line_no, CAST(NULL AS BIGINT) AS rule_ord, CAST(col_pos + 1 AS BIGINT) AS match_ord "
        f"FROM (SELECT *, CASE WHEN value_type IS NOT NULL THEN {s(R.DETECTED_BY_VALUES)} ELSE {s(R.DETECTED_BY_NAME)} "
        f"END AS detected_by FROM pcy) WHERE {nonblank('column_name')} AND (name_type IS NOT NULL OR value_type IS NOT NULL))",
    ]


# ------------------------------------------------------------------ policy


def _clause_rows() -> list[tuple[str, int, str, str, str, list[str]]]:
    rows = []
    for path in sorted(glob.glob(os.path.join(BUILTIN_POLICY_DIR, "*.json"))):
        name = os.path.splitext(os.path.basename(path))[0].upper()
        try:
            entries = json.load(open(path, encoding="utf-8"))
        except Exception:
            continue
        if not isinstance(entries, list):
            continue
        for pos, e in enumerate(entries, start=1):
            if not isinstance(e, dict):
                continue
            low = {str(k).lower(): v for k, v in e.items()}
            cid, text = low.get("id"), low.get("clausetext")
            if not isinstance(cid, str) or not cid.strip() or not isinstance(text, str) or not text.strip():
                continue
            title = low.get("title") if low.get("title") is not None else cid
            ex = low.get("exampleviolations") or []
            rows.append((name, pos, cid, title, text, [str(x) for x in ex]))
    return rows


def clauses_cte(name: str = "cl") -> str:
    vals = ", ".join(
        f"({s(p)}, {o}, {s(c)}, {s(t)}, {s(x)}, [{', '.join(s(v) for v in ex)}]::VARCHAR[])"
        for p, o, c, t, x, ex in _clause_rows()
    )
    return (
        f"{name}_v AS (SELECT * FROM (VALUES {vals}) AS v(policy_name, clause_ord, clause_id, title, clause_text, examples)), "
        f"{name} AS (SELECT *, {tokens('search_text')} AS tokens FROM (SELECT *, title || '. ' || clause_text || ' ' || "
        f"array_to_string(examples, ' ') AS search_text FROM {name}_v))"
    )


def resolve_policy(x: str) -> str:
    up = f"upper(coalesce({x}, ''))"
    whens = " ".join(f"WHEN contains({up}, {s(n)}) THEN {s(p)}" for n, p in R.POLICY_NAME_HINTS)
    return f"CASE {whens} END"


def scans_cte(name: str = "sc") -> str:
    cyc = "[" + ", ".join(s(p) for p in C.SCAN_POLICY_CYCLE) + "]"
    n = "coalesce(TRY_CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER), 0)"
    return (
        f"{name} AS (SELECT CAST(source AS VARCHAR) AS scan_id, {cyc}[({n} % {len(C.SCAN_POLICY_CYCLE)}) + 1] AS policy_id, "
        f"'DONE' AS status, count(*) AS n_files FROM documents GROUP BY source)"
    )


def query_expr(prefix: str = "") -> str:
    p = prefix
    return (
        f"coalesce({p}data_type, '') || ' personal data found at ' || coalesce({p}location, '') || '. Detected by ' || "
        f"coalesce({p}detected_by, '') || '. Snippet: ' || coalesce({p}snippet, '')"
    )


def best_clause_ctes(f: str, policy_expr: str | None, name: str = "bc") -> list[str]:
    pol = policy_expr if policy_expr else "CAST(NULL AS VARCHAR)"
    return [
        f"{name}_q AS (SELECT finding_id, {tokens(query_expr())} AS qt, {pol} AS pol FROM {f})",
        f"{name}_s AS (SELECT q.finding_id, len(q.qt) AS n_tokens, cl.policy_name, cl.clause_ord, cl.clause_id, cl.title, "
        f"cl.clause_text, len(list_intersect(q.qt, cl.tokens)) AS hits FROM {name}_q q JOIN cl ON "
        f"(q.pol IS NULL OR lower(cl.policy_name) = lower(q.pol)))",
        f"{name} AS (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY hits DESC, "
        f"policy_name, clause_ord) = 1)",
    ]


# ------------------------------------------------------------------ reasoning


def ext_of(file_expr: str) -> str:
    return f"lower(regexp_extract(regexp_extract({file_expr}, '([^/\\\\]*)$', 1), '(\\.[^.]+)$', 1))"


def loc_file(loc: str) -> str:
    return f"string_split(coalesce({loc}, ''), ':')[1]"


def severity_expr(t: str) -> str:
    u = f"upper(coalesce({t}, ''))"
    crit = ", ".join(s(x) for x in R.CRITICAL_TYPES)
    high = ", ".join(s(x) for x in R.HIGH_TYPES)
    return f"CASE WHEN {u} IN ({crit}) THEN 'CRITICAL' WHEN {u} IN ({high}) THEN 'HIGH' ELSE 'MEDIUM' END"


def is_code(det: str, loc: str) -> str:
    exts = ", ".join(s(x) for x in R.CODE_EXTENSIONS)
    return f"(upper(coalesce({det}, '')) = 'ROSLYN' OR {ext_of(loc_file(loc))} IN ({exts}))"


def fix_tool_expr(t: str, det: str, loc: str) -> str:
    u = f"upper(coalesce({t}, ''))"
    crit = ", ".join(s(x) for x in R.CRITICAL_TYPES)
    high = ", ".join(s(x) for x in R.HIGH_TYPES)
    return (
        f"CASE WHEN {is_code(det, loc)} THEN 'REDACT_CODE_LINE' WHEN {u} IN ({crit}) THEN 'DROP_COLUMN' "
        f"WHEN {u} IN ({high}) THEN 'MASK_COLUMN' ELSE 'ANONYMIZE_COLUMN' END"
    )


def loc_line(loc: str) -> str:
    return (
        f"list_filter(list_reverse(list_transform(string_split(coalesce({loc}, ''), ':'), "
        f"lambda p: TRY_CAST(trim(p) AS INTEGER))), lambda n: n > 0)[1]"
    )


def loc_column(loc: str, mode: str) -> str:
    lc = f"coalesce({loc}, '')"
    idx = f"instr(lower({lc}), 'column=')"
    rest = f"substr({lc}, {idx} + 7)"
    val = f"regexp_extract({rest}, '^([^:, ]*)', 1)" if mode == "reasoner" else f"trim({rest})"
    return f"CASE WHEN {idx} > 0 THEN {val} END"


def loc_file_name(loc: str) -> str:
    lc = f"coalesce({loc}, '')"
    idx = f"instr({lc}, ':')"
    name = f"trim(CASE WHEN {idx} > 1 THEN substr({lc}, 1, {idx} - 1) ELSE {lc} END)"
    return f"CASE WHEN {name} <> '' THEN {name} END"


def fix_args_text(t: str, loc: str, tool: str) -> str:
    line = loc_line(loc)
    col = f"coalesce({loc_column(loc, 'reasoner')}, lower(coalesce({t}, 'value')))"
    return (
        f"CASE WHEN {tool} = 'REDACT_CODE_LINE' THEN 'reason: \"Contains ' || coalesce({t}, '') || '\"' || "
        f"CASE WHEN {line} IS NOT NULL THEN ', line: \"' || CAST({line} AS VARCHAR) || '\"' ELSE '' END "
        f"WHEN {tool} = 'MASK_COLUMN' THEN 'column: \"' || {col} || '\", style: \"partial\"' "
        f"ELSE 'column: \"' || {col} || '\"' END"
    )


def enriched_ctes(f: str, policy_expr: str | None, name: str = "ef") -> list[str]:
    """Deterministic enrichment of findings CTE ``f`` (needs ``cl``)."""
    tool = fix_tool_expr("f.data_type", "f.detected_by", "f.location")
    cid = f"coalesce(b.clause_id, '{R.UNKNOWN_CLAUSE}')"
    return best_clause_ctes(f, policy_expr) + [
        f"{name} AS (SELECT f.*, {severity_expr('f.data_type')} AS e_severity, {cid} AS policy_clause_id, "
        f"b.clause_text AS policy_clause_text, coalesce(f.data_type, '') || ' detected at ' || coalesce(f.location, '') || "
        f"'; this implicates ' || {cid} || CASE WHEN length(coalesce(b.title, '')) > 0 THEN ' (' || b.title || ')' ELSE '' END "
        f"|| '.' AS explanation, {tool} AS fix_tool, {fix_args_text('f.data_type', 'f.location', tool)} AS fix_args "
        f"FROM {f} f LEFT JOIN bc b ON f.finding_id = b.finding_id)",
    ]


def doc_enriched_ctes() -> list[str]:
    return doc_findings_ctes() + [
        scans_cte(),
        clauses_cte(),
        "tfp AS (SELECT tf.*, sc.policy_id AS scan_policy_id FROM tf LEFT JOIN sc ON tf.scan_id = sc.scan_id)",
    ] + enriched_ctes("tfp", resolve_policy("scan_policy_id"))


def reviewed_ctes() -> list[str]:
    return doc_enriched_ctes() + [
        "dec AS (SELECT finding_id, CASE WHEN e_severity = 'CRITICAL' OR data_type = 'EMAIL' THEN 'APPROVE' "
        "WHEN data_type = 'IP' THEN 'REJECT' END AS action FROM ef)",
        "rv AS (SELECT ef.*, CASE WHEN d.action = 'REJECT' THEN 'REJECTED' WHEN d.action = 'APPROVE' THEN 'APPROVED' "
        "ELSE 'PENDING_REVIEW' END AS r_status, CASE WHEN d.action = 'APPROVE' THEN "
        f"{s(C.REVIEWER)} END AS approved_by FROM ef LEFT JOIN dec d ON ef.finding_id = d.finding_id)",
    ]


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ", ".join(ctes) + " " + body


# ------------------------------------------------------------------ remediation


def mask_sql(v: str, style: str = "'partial'") -> str:
    return (
        f"CASE WHEN {v} IS NULL OR {v} = '' THEN {v} WHEN lower(coalesce({style}, 'partial')) = 'full' THEN '***' "
        f"WHEN instr({v}, '@') > 1 THEN substr({v}, 1, 1) || '***' || substr({v}, instr({v}, '@')) "
        f"ELSE substr({v}, 1, 1) || '***' END"
    )


def anon_sql(v: str, salt: str = "''") -> str:
    return f"CASE WHEN {v} IS NULL OR {v} = '' THEN {v} ELSE 'anon_' || substr(sha256({salt} || {v}), 1, 12) END"


def customer_plan_ctes(tool_override: str | None = None) -> list[str]:
    tool = s(tool_override) if tool_override else fix_tool_expr("data_type", "detected_by", "location")
    return column_findings_ctes(["customer"], scan="customer", name="ccf") + [
        clauses_cte(),
        f"cplan AS (SELECT finding_id, {tool} AS tool, file_name AS target_file, column_name AS resolved_column, "
        f"CAST(NULL AS BIGINT) AS target_line, TRUE AS applied, 'Applied ' || {tool} || ' to column ''' || column_name || "
        f"''' in ' || file_name || '.' AS detail FROM ccf)",
    ]


def code_plan_ctes() -> list[str]:
    return doc_findings_ctes("code/", ".py", tf="ctf") + [
        "rplan AS (SELECT finding_id, 'REDACT_CODE_LINE' AS tool, file_name AS target_file, CAST(NULL AS VARCHAR) AS "
        "resolved_column, line_no AS target_line, TRUE AS applied, 'Redacted line ' || CAST(line_no AS VARCHAR) || ' of ' || "
        "file_name || '.' AS detail, 'Contains ' || data_type AS reason FROM ctf)",
    ]


# ------------------------------------------------------------------ queries


def _q() -> dict[str, str]:
    q: dict[str, str] = {}
    tf_cols = (
        "finding_id, scan_id, file_name, line_no, data_type, CAST(rule_ord AS BIGINT) AS rule_ord, match_ord, location, "
        "snippet, detected_by, severity, status"
    )
    q["scan_text_findings"] = with_(doc_findings_ctes(), f"SELECT {tf_cols} FROM tf")
    for key, t in (("scan_rule_email", "EMAIL"), ("scan_rule_phone", "PHONE"), ("scan_rule_ip", "IP")):
        q[key] = with_(doc_findings_ctes(), f"SELECT file_name, line_no, match_ord, match FROM tf WHERE data_type = {s(t)}")
    card = [r for r in R.TEXT_RULES if r[1] == "CREDIT_CARD"]
    card = [(o, t, p, None) for o, t, p, _v in card]
    q["scan_rule_credit_card_luhn"] = with_(
        [src_docs(), lines("ln", "src", r"\d"), matches("mt", "ln", card)],
        f"SELECT file_name, line_no, match_ord, match, {luhn('match')} AS luhn_valid FROM mt",
    )
    custom = [(r.ordinal, r.data_type, r.pattern, None) for r in C.CUSTOM_RULES]
    q["scan_custom_rules"] = with_(
        [src_docs("src0"), src_pages("srcp"), "src AS (SELECT * FROM src0 UNION ALL SELECT * FROM srcp)", lines("ln", "src"),
         matches("mt", "ln", custom)],
        "SELECT file_name, line_no, CAST(rule_ord AS BIGINT) AS rule_ord, data_type, match_ord, match FROM mt",
    )
    q["scan_pages"] = with_(
        [src_pages("src"), lines("ln", "src", R.LINE_PREFILTER), matches("mt", "ln", R.TEXT_RULES), text_findings("tf", "mt")],
        "SELECT finding_id, file_name, line_no, data_type, CAST(rule_ord AS BIGINT) AS rule_ord, match_ord, snippet FROM tf",
    )
    for key, tbl, idc, col in (("scan_conversations", "conversations", "conv_id", "text"), ("scan_benchmark", "benchmark", "item_id", "text")):
        if tbl == "conversations":
            name = "'conversations/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)"
        else:
            name = "'benchmark/' || CAST(item_id AS VARCHAR)"
        q[key] = with_(
            [f"src AS (SELECT {s(tbl)} AS scan_id, {name} AS file_name, {col} AS content FROM {tbl})",
             lines("ln", "src", R.LINE_PREFILTER), matches("mt", "ln", R.TEXT_RULES), text_findings("tf", "mt")],
            "SELECT finding_id, file_name, line_no, data_type FROM tf",
        )
    q["normalize_response"] = with_(
        doc_findings_ctes() + [clauses_cte()] + enriched_ctes("tf", None),
        "SELECT finding_id, e_severity AS severity, policy_clause_id, fix_tool, fix_args FROM ef",
    )
    q["stream_scan"] = with_(doc_findings_ctes(), "SELECT finding_id, scan_id, data_type, location FROM tf")
    q["running_score"] = with_(
        doc_findings_ctes() + [
            f"rs AS (SELECT scan_id, {severity_expr('data_type')} AS sev FROM tf)",
            "ag AS (SELECT scan_id, CAST(count(*) FILTER (WHERE sev = 'CRITICAL') AS BIGINT) AS critical, "
            "CAST(count(*) FILTER (WHERE sev = 'HIGH') AS BIGINT) AS high, CAST(count(*) AS BIGINT) AS total FROM rs GROUP BY scan_id)",
        ],
        f"SELECT scan_id, critical, high, total, CAST(greatest(0, 100 - critical * {R.COMPLIANCE_CRITICAL_PENALTY} - "
        f"high * {R.COMPLIANCE_HIGH_PENALTY}) AS INTEGER) AS compliance_score FROM ag",
    )
    q["findings_by_label"] = with_(
        doc_findings_ctes() + [
            "pd AS (SELECT CAST(regexp_extract(file_name, '(\\d+)$', 1) AS BIGINT) AS doc_id, count(*) AS n FROM tf GROUP BY 1)"
        ],
        "SELECT CAST(l.doc_id AS BIGINT) AS doc_id, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic, "
        "CAST(coalesce(pd.n, 0) AS BIGINT) AS n_findings FROM labels l LEFT JOIN pd ON l.doc_id = pd.doc_id",
    )
    q["split_lines"] = with_([src_docs(), lines("ln", "src")], "SELECT file_name, line_no, line FROM ln")
    exts = "[" + ", ".join(s(e) for e in C.STANDIN_EXTENSIONS) + "]"
    fn_cte = f"fn AS (SELECT 'docs/' || CAST(doc_id AS VARCHAR) || {exts}[(doc_id % {len(C.STANDIN_EXTENSIONS)}) + 1] AS file_name FROM documents)"
    lang_whens = " ".join(f"WHEN {ext_of('file_name')} = {s(e)} THEN {s(l)}" for e, l in R.LANGUAGE_BY_EXTENSION)
    q["guess_language"] = with_([fn_cte], f"SELECT file_name, CASE {lang_whens} END AS language FROM fn")
    q["source_type"] = with_(
        [fn_cte],
        "SELECT file_name, CASE WHEN suffix(string_split(lower(file_name), ':')[1], '.csv') OR "
        "suffix(string_split(lower(file_name), ':')[1], '.json') THEN 'dataset' ELSE 'code' END AS source_type FROM fn",
    )
    all_tables = [t for t, _ in C.COLUMN_TABLES]
    q["column_samples"] = with_(
        samples_ctes(C.SAMPLE_TABLES),
        "SELECT dataset, CAST(col_pos AS BIGINT) AS col_pos, column_name, CAST(sample_ord AS BIGINT) AS sample_ord, value FROM samp",
    )
    q["column_name_types"] = with_(samples_ctes(all_tables), f"SELECT dataset, column_name, {name_type('column_name')} AS name_type FROM pc")
    ent_union = " UNION ALL ".join(
        f"SELECT dataset, column_name, {s(c)} AS category, CAST(len(regexp_extract_all(blob, {s(p)})) AS BIGINT) AS cnt FROM pc"
        for _o, c, p in R.ENTITY_PATTERNS
    )
    q["column_value_entities"] = with_(samples_ctes(all_tables), f"SELECT * FROM ({ent_union}) WHERE cnt > 0")
    q["dominant_category"] = with_(
        samples_ctes(all_tables) + [f"pcx AS (SELECT *, {entity_count_cols('blob')} FROM pc)"],
        f"SELECT dataset, column_name, {value_type_expr()} AS value_type FROM pcx",
    )
    q["scan_columns"] = with_(
        column_findings_ctes(all_tables), "SELECT finding_id, scan_id, data_type, location, column_name, snippet, detected_by FROM cf"
    )
    ident_whens = " ".join(
        "WHEN " + " OR ".join(
            (f"lower(identifier) = {s(n)}" if kind == "equals" else f"contains(lower(identifier), {s(n)})") for kind, n in needles
        ) + f" THEN {s(t)}"
        for needles, t in R.IDENTIFIER_RULES
    )
    la_ctes = [
        src_docs(),
        lines("ln", "src", '=\\s*@?"'),
        f"la_a AS (SELECT scan_id, file_name, line_no, line, regexp_extract_all(line, {s(LITERAL_ASSIGNMENT)}, 1) AS ids FROM ln)",
        "la_b AS (SELECT scan_id, file_name, line_no, line, unnest(ids) AS identifier, CAST(generate_subscripts(ids, 1) AS BIGINT) "
        "AS match_ord FROM la_a)",
        f"la AS (SELECT *, CASE {ident_whens} END AS data_type FROM la_b)",
    ]
    q["classify_identifier"] = with_(la_ctes, "SELECT file_name, line_no, match_ord, identifier, data_type FROM la")
    q["literal_assignment"] = with_(
        la_ctes,
        f"SELECT {fid('scan_id', 'file_name', 'line_no', 'NULL', chr(39) + 'ROSLYN' + chr(39), '103', 'match_ord')} AS finding_id, "
        f"file_name, line_no, data_type, {trim_ws('line')} AS snippet, 'ROSLYN' AS detected_by FROM la WHERE data_type IS NOT NULL",
    )
    q["route_detectors"] = with_(
        doc_findings_ctes() + column_findings_ctes(["customer"], scan="customer", name="ccf"),
        "SELECT finding_id, scan_id, file_name, data_type, detected_by, location FROM tf UNION ALL "
        "SELECT finding_id, scan_id, file_name, data_type, detected_by, location FROM ccf",
    )
    q["tokenize"] = with_(doc_findings_ctes(), f"SELECT finding_id, unnest({tokens(query_expr())}) AS token FROM tf")
    q["keyword_top1"] = with_(
        doc_findings_ctes() + [clauses_cte()] + best_clause_ctes("tf", None),
        "SELECT finding_id, clause_id, policy_name, CAST(hits AS BIGINT) AS hits, CAST(n_tokens AS BIGINT) AS n_tokens FROM bc",
    )
    cos = (
        "CASE WHEN len(e.embedding) = 0 OR ma = 0 OR mb = 0 THEN 0.0 ELSE dot / (sqrt(ma) * sqrt(mb)) END"
    )
    q["cosine_top1"] = with_(
        [
            "ex AS (SELECT label, arg_min(embedding, vec_id) AS ev FROM embeddings GROUP BY label)",
            "pr AS (SELECT e.vec_id, x.label, e.embedding, "
            "list_sum(list_transform(range(1, least(len(e.embedding), len(x.ev)) + 1), lambda i: CAST(e.embedding[i] * x.ev[i] AS DOUBLE))) AS dot, "
            "list_sum(list_transform(range(1, least(len(e.embedding), len(x.ev)) + 1), lambda i: CAST(e.embedding[i] * e.embedding[i] AS DOUBLE))) AS ma, "
            "list_sum(list_transform(range(1, least(len(e.embedding), len(x.ev)) + 1), lambda i: CAST(x.ev[i] * x.ev[i] AS DOUBLE))) AS mb "
            "FROM embeddings e, ex x)",
            f"sc AS (SELECT e.vec_id, e.label, {cos} AS score FROM pr e)",
        ],
        "SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS VARCHAR) AS best_label FROM sc "
        "QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1",
    )
    q["resolve_policy"] = with_([scans_cte()], f"SELECT scan_id, policy_id, {resolve_policy('policy_id')} AS policy_name FROM sc")
    q["validate_policy"] = with_(
        [scans_cte(), clauses_cte()],
        "SELECT scan_id, policy_id FROM sc WHERE upper(coalesce(policy_id, '')) <> 'ALL' AND lower(policy_id) NOT IN "
        "(SELECT lower(policy_name) FROM cl)",
    )
    af = doc_findings_ctes() + column_findings_ctes(["customer", "orders"]) + [
        "af AS (SELECT finding_id, data_type, location, detected_by FROM tf UNION ALL "
        "SELECT finding_id, data_type, location, detected_by FROM cf)"
    ]
    q["severity"] = with_(af, f"SELECT finding_id, data_type, {severity_expr('data_type')} AS severity FROM af")
    tool = fix_tool_expr("data_type", "detected_by", "location")
    q["fix_tool"] = with_(af, f"SELECT finding_id, {tool} AS fix_tool FROM af")
    q["fix_args"] = with_(af, f"SELECT finding_id, {fix_args_text('data_type', 'location', tool)} AS fix_args FROM af")
    q["parse_location"] = with_(
        af,
        f"SELECT finding_id, location, {loc_file_name('location')} AS file, CAST({loc_line('location')} AS BIGINT) AS line, "
        f"{loc_column('location', 'applier')} AS column_applier, {loc_column('location', 'reasoner')} AS column_reasoner FROM af",
    )
    q["enrich"] = with_(
        doc_enriched_ctes(),
        "SELECT finding_id, scan_id, e_severity AS severity, policy_clause_id, policy_clause_text, explanation, fix_tool, "
        "fix_args, 'PENDING_REVIEW' AS status FROM ef",
    )
    # remediation
    q["mask_partial"] = (
        f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {mask_sql('c_name')} AS c_name, {mask_sql('c_mktsegment')} AS c_mktsegment FROM customer"
    )
    q["mask_full"] = f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {mask_sql('c_name', chr(39) + 'full' + chr(39))} AS c_name FROM customer"
    q["anonymize"] = (
        f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {anon_sql('c_name')} AS c_name, "
        f"{anon_sql('c_name', chr(39) + 's1' + chr(39))} AS c_name_salted FROM customer"
    )
    # the oracle joins on the raw keys: the pseudonymised join must give the same pairs
    q["anonymize_join"] = (
        f"SELECT CAST(o.o_orderkey AS BIGINT) AS o_orderkey, {anon_sql('CAST(o.o_custkey AS VARCHAR)')} AS anon_custkey, "
        f"c.c_mktsegment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
    )
    cust_str = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in TABLE_COLUMNS["customer"] if c != "c_name")
    q["drop_column"] = with_(customer_plan_ctes("DROP_COLUMN"), f"SELECT {cust_str} FROM customer")
    q["apply_fixes"] = (
        "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, "
        + anon_sql("CAST(c_name AS VARCHAR)")
        + " AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal, "
        "CAST(c_mktsegment AS VARCHAR) AS c_mktsegment FROM customer"
    )
    label = "redline"
    q["redact_lines"] = with_(
        code_plan_ctes() + [
            "notes AS (SELECT target_file, target_line, arg_max(reason, finding_id) AS reason FROM rplan GROUP BY ALL)",
            "csrc AS (SELECT 'code/' || CAST(doc_id AS VARCHAR) || '.py' AS file_name, text AS content FROM documents)",
            "cl_r AS (SELECT file_name, string_split(content, chr(10)) AS parts FROM csrc)",
            "cl_u AS (SELECT file_name, unnest(parts) AS raw, generate_subscripts(parts, 1) AS idx FROM cl_r)",
            "cl_n AS (SELECT u.file_name, u.idx, CASE WHEN n.reason IS NULL THEN u.raw ELSE "
            "regexp_extract(CASE WHEN suffix(u.raw, chr(13)) THEN substr(u.raw, 1, length(u.raw) - 1) ELSE u.raw END, '^(\\s*)', 1) "
            f"|| '{R.REDACT_COMMENT_PREFIX} [REDACTED by {label}: ' || trim(n.reason) || ']' || CASE WHEN suffix(u.raw, chr(13)) THEN chr(13) ELSE '' END END AS nl "
            "FROM cl_u u LEFT JOIN notes n ON u.file_name = n.target_file AND u.idx = n.target_line)",
        ],
        "SELECT file_name, string_agg(nl, chr(10) ORDER BY idx) AS content FROM cl_n GROUP BY file_name",
    )
    q["fix_outcomes"] = with_(
        code_plan_ctes() + customer_plan_ctes(),
        "SELECT finding_id, tool, target_file, resolved_column, target_line, applied, detail FROM rplan UNION ALL "
        "SELECT finding_id, tool, target_file, resolved_column, target_line, applied, detail FROM cplan",
    )
    q["approve"] = with_(reviewed_ctes(), "SELECT finding_id, r_status AS status, approved_by FROM rv")
    q["reject"] = with_(
        doc_enriched_ctes(),
        "SELECT finding_id, CASE WHEN e_severity = 'MEDIUM' THEN 'REJECTED' ELSE 'PENDING_REVIEW' END AS status FROM ef",
    )
    q["approve_all_high"] = with_(
        doc_enriched_ctes(),
        "SELECT finding_id, e_severity AS severity, CASE WHEN e_severity IN ('CRITICAL', 'HIGH') THEN 'APPROVED' ELSE "
        f"'PENDING_REVIEW' END AS status, CASE WHEN e_severity IN ('CRITICAL', 'HIGH') THEN {s(C.REVIEWER)} END AS approved_by FROM ef",
    )
    # reports
    comp = f"CAST(greatest(0, 100 - critical * {R.COMPLIANCE_CRITICAL_PENALTY} - high * {R.COMPLIANCE_HIGH_PENALTY}) AS INTEGER)"
    q["compliance_score"] = with_(
        doc_enriched_ctes() + [
            "cnt AS (SELECT scan_id, CAST(count(*) FILTER (WHERE e_severity = 'CRITICAL') AS BIGINT) AS critical, "
            "CAST(count(*) FILTER (WHERE e_severity = 'HIGH') AS BIGINT) AS high FROM ef GROUP BY scan_id)",
            "j AS (SELECT sc.scan_id, coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high FROM sc LEFT JOIN cnt c "
            "ON sc.scan_id = c.scan_id)",
        ],
        f"SELECT scan_id, critical, high, {comp} AS compliance_score FROM j",
    )
    w = " ".join(f"WHEN {s(k)} THEN {v}" for k, v in R.RESIDUAL_WEIGHTS.items())
    pen = f"CAST(sum(CASE WHEN r_status = 'APPROVED' THEN 0 ELSE CASE e_severity {w} ELSE 0 END END) AS BIGINT)"
    q["residual_score"] = with_(
        reviewed_ctes() + [f"p AS (SELECT scan_id, {pen} AS penalty FROM rv GROUP BY scan_id)"],
        "SELECT scan_id, penalty, CAST(greatest(0, least(100, 100 - penalty)) AS INTEGER) AS residual_score FROM p",
    )

    def band(x: str) -> str:
        whens = " ".join(f"WHEN {x} >= {b} THEN {s(l)}" for b, l in R.RISK_BANDS)
        return f"CASE {whens} ELSE {s(R.RISK_BAND_ELSE)} END"

    q["risk_band"] = with_(
        reviewed_ctes() + [
            f"p AS (SELECT scan_id, {pen} AS penalty, count(*) FILTER (WHERE e_severity = 'CRITICAL') AS critical, "
            "count(*) FILTER (WHERE e_severity = 'HIGH') AS high FROM rv GROUP BY scan_id)",
            f"x AS (SELECT scan_id, {comp} AS compliance_score, CAST(greatest(0, least(100, 100 - penalty)) AS INTEGER) AS residual_score FROM p)",
        ],
        f"SELECT scan_id, compliance_score, {band('compliance_score')} AS compliance_band, residual_score, "
        f"{band('residual_score')} AS residual_band FROM x",
    )
    sev_cols = ", ".join(
        f"CAST(count(*) FILTER (WHERE e_severity = {s(x)}) AS BIGINT) AS {x.lower()}" for x in R.SEVERITIES
    )
    q["severity_counts"] = with_(
        doc_enriched_ctes(), f"SELECT scan_id, {sev_cols}, CAST(count(*) AS BIGINT) AS total FROM ef GROUP BY scan_id"
    )
    summ = (
        "CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE e_severity = 'CRITICAL') AS BIGINT) AS critical, "
        "CAST(count(*) FILTER (WHERE e_severity = 'HIGH') AS BIGINT) AS high, "
        "CAST(count(*) FILTER (WHERE r_status = 'APPROVED') AS BIGINT) AS approved, "
        "CAST(count(*) FILTER (WHERE r_status = 'REJECTED') AS BIGINT) AS rejected, "
        "CAST(count(*) FILTER (WHERE r_status = 'PENDING_REVIEW') AS BIGINT) AS pending"
    )
    q["status_summary"] = with_(reviewed_ctes(), f"SELECT scan_id, {summ} FROM rv GROUP BY scan_id")
    q["audit_report"] = with_(
        reviewed_ctes() + [
            f"sm AS (SELECT scan_id, {summ} FROM rv GROUP BY scan_id)",
            "hd AS (SELECT sc.scan_id, sc.policy_id, coalesce(sm.total, 0) AS total, coalesce(sm.critical, 0) AS critical, "
            "coalesce(sm.high, 0) AS high, coalesce(sm.approved, 0) AS approved, coalesce(sm.rejected, 0) AS rejected, "
            "coalesce(sm.pending, 0) AS pending FROM sc LEFT JOIN sm ON sc.scan_id = sm.scan_id)",
        ],
        f"SELECT hd.*, CAST({comp.replace('critical', 'hd.critical').replace('high', 'hd.high')} AS BIGINT) AS compliance_score, "
        "rv.finding_id, rv.data_type, rv.e_severity AS severity, rv.location, rv.policy_clause_id, rv.r_status AS finding_status, "
        "rv.fix_tool, rv.approved_by FROM hd LEFT JOIN rv ON hd.scan_id = rv.scan_id",
    )
    pol_of = (
        "CASE WHEN upper(string_split(coalesce(policy_clause_id, ''), '-')[1]) IN ("
        + ", ".join(s(x) for x in R.CLAUSE_PREFIX_HIPAA)
        + ") THEN 'HIPAA' WHEN upper(string_split(coalesce(policy_clause_id, ''), '-')[1]) IN ("
        + ", ".join(s(x) for x in R.CLAUSE_PREFIX_SECRETS)
        + ") THEN 'Secrets' ELSE 'GDPR' END"
    )
    q["policy_of"] = with_(doc_enriched_ctes(), f"SELECT finding_id, policy_clause_id, {pol_of} AS policy FROM ef")
    q["available_policies"] = with_(doc_enriched_ctes(), f"SELECT DISTINCT scan_id, {pol_of} AS policy FROM ef")
    q["filter_findings"] = with_(
        doc_enriched_ctes(),
        f"SELECT finding_id, e_severity AS severity, policy_clause_id FROM ef WHERE e_severity = 'HIGH' AND {pol_of} IN ('GDPR')",
    )
    q["files_with_findings"] = with_(
        doc_findings_ctes(), "SELECT file_name, scan_id FROM src WHERE file_name IN (SELECT file_name FROM tf)"
    )
    q["annotate_lines"] = with_(
        doc_enriched_ctes() + [
            "al_r AS (SELECT file_name, string_split(content, chr(10)) AS parts FROM src)",
            "al_u AS (SELECT file_name, unnest(parts) AS text, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no FROM al_r)",
            "pl AS (SELECT file_name, line_no, finding_id, data_type, e_severity AS severity FROM ef QUALIFY row_number() OVER "
            "(PARTITION BY file_name, line_no ORDER BY rule_ord DESC, match_ord DESC, finding_id DESC) = 1)",
        ],
        "SELECT u.file_name, u.line_no, sha256(u.text) AS text_sha256, pl.finding_id, pl.data_type, pl.severity "
        "FROM al_u u LEFT JOIN pl ON u.file_name = pl.file_name AND u.line_no = pl.line_no",
    )
    cols_vals = ", ".join(f"('customer', {i}, {s(c)})" for i, c in enumerate(TABLE_COLUMNS["customer"]))
    q["annotate_columns"] = with_(
        column_findings_ctes(["customer"]) + [
            f"cc AS (SELECT * FROM (VALUES {cols_vals}) AS v(file_name, col_pos, column_name))",
            "pcf AS (SELECT file_name, column_name, finding_id, data_type FROM cf QUALIFY row_number() OVER "
            "(PARTITION BY file_name, column_name ORDER BY finding_id DESC) = 1)",
        ],
        "SELECT cc.file_name, CAST(cc.col_pos AS BIGINT) AS col_pos, cc.column_name, p.finding_id, p.data_type FROM cc "
        "LEFT JOIN pcf p ON cc.file_name = p.file_name AND trim(cc.column_name) = p.column_name",
    )
    q["scan_detail"] = with_(
        doc_enriched_ctes() + [
            "cnt AS (SELECT scan_id, count(*) FILTER (WHERE e_severity = 'CRITICAL') AS critical, "
            "count(*) FILTER (WHERE e_severity = 'HIGH') AS high FROM ef GROUP BY scan_id)",
            "pf AS (SELECT scan_id, file_name, count(*) AS n FROM ef GROUP BY scan_id, file_name)",
        ],
        "SELECT sc.scan_id, sc.policy_id, sc.status, CAST(greatest(0, 100 - coalesce(c.critical, 0) * "
        f"{R.COMPLIANCE_CRITICAL_PENALTY} - coalesce(c.high, 0) * {R.COMPLIANCE_HIGH_PENALTY}) AS BIGINT) AS compliance_score, "
        "s.file_name, sha256(s.content) AS content_sha256, CAST(coalesce(pf.n, 0) AS BIGINT) AS n_findings "
        "FROM sc LEFT JOIN cnt c ON sc.scan_id = c.scan_id LEFT JOIN src s ON sc.scan_id = s.scan_id "
        "LEFT JOIN pf ON s.scan_id = pf.scan_id AND s.file_name = pf.file_name",
    )
    t = "upper(coalesce(data_type, ''))"
    adv = " ".join(
        "WHEN " + " OR ".join(f"contains({t}, {s(n)})" for n in needles) + f" THEN {s(text)}"
        for needles, text in R.PERMANENT_FIX_BY_TYPE
    ) + " " + " ".join(
        "WHEN upper(coalesce(fix_tool, '')) IN (" + ", ".join(s(x) for x in tools) + f") THEN {s(text)}"
        for tools, text in R.PERMANENT_FIX_BY_TOOL
    )
    q["permanent_fix"] = with_(
        doc_enriched_ctes(), f"SELECT finding_id, CASE {adv} ELSE {s(R.PERMANENT_FIX_DEFAULT)} END AS advice FROM ef"
    )
    q["flagship"] = with_(
        doc_enriched_ctes() + [
            "cnt AS (SELECT scan_id, count(*) AS total, count(*) FILTER (WHERE e_severity = 'CRITICAL') AS critical, "
            "count(*) FILTER (WHERE e_severity = 'HIGH') AS high, count(*) FILTER (WHERE e_severity = 'MEDIUM') AS medium "
            "FROM ef GROUP BY scan_id)",
        ],
        "SELECT sc.scan_id, CAST(coalesce(c.total, 0) AS BIGINT) AS total, CAST(coalesce(c.critical, 0) AS BIGINT) AS critical, "
        "CAST(coalesce(c.high, 0) AS BIGINT) AS high, CAST(coalesce(c.medium, 0) AS BIGINT) AS medium, "
        f"CAST(greatest(0, 100 - coalesce(c.critical, 0) * {R.COMPLIANCE_CRITICAL_PENALTY} - coalesce(c.high, 0) * "
        f"{R.COMPLIANCE_HIGH_PENALTY}) AS BIGINT) AS compliance_score FROM sc LEFT JOIN cnt c ON sc.scan_id = c.scan_id",
    )
    return q


def oracle_sql() -> dict[str, str]:
    return _q()
