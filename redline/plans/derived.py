"""Queries whose input the tables lack: rows in the schema an operator
expects, derived from whole tables by a fixed rule, and the DuckDB SQL of each.

The rules only give input; every step a query names runs through the
library, and the SQL states the result on its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.policy import clause_search_text, content_hash, decode_embedding, encode_embedding
from ..functions.reason import fix_args_text
from ..functions.remediate import parse_fix_args
from ..functions.report import finding_status_view, scan_status_view
from ..operators import detect_code, detect_text, enrich, remediate
from ..operators.keyword_index import retrieve_keywords
from ..operators.vector_index import nearest_vectors
from ..operators.retrieve import clause_index, refresh_clause_index
from ..session import checkpoint_path
from ..sources.files import as_sources
from ..sources.splits import numbered_lines
from ..sources.tables import read_csv_table, read_json_table, write_csv_table, write_json_table
from . import catalog as C
from .scan import route_detectors

SECRET_TYPES = ["SSN", "MAC", "API_KEY", "TOKEN", "PRIVATE_KEY"]


def scan_rules_derived(spark: SparkSession, d: str) -> DataFrame:
    """The rules that hit nothing in the tables: every document with one more
    line, a value of the rule's shape made of the MD5 of its text."""
    h = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    digits = F.translate(h, "abcdef", "012345")
    pairs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(h, 2 * i + 1, F.lit(2))), ":")
    values = F.array(
        F.concat_ws("-", F.substring(digits, 1, 3), F.substring(digits, 4, 2), F.substring(digits, 6, 4)),
        pairs,
        F.concat(F.lit("AKIA"), F.upper(F.substring(h, 1, 16))),
        F.concat(F.lit("eyJ"), F.concat_ws(".", F.substring(h, 1, 10), F.substring(h, 11, 10), F.substring(h, 21, 10))),
        F.lit("-----BEGIN RSA PRIVATE KEY-----"),
    )
    docs = C.table(spark, d, "documents")
    docs = docs.withColumn("text", F.concat_ws("\n", "text", F.concat(F.lit("v "), values[F.pmod("doc_id", F.lit(5)).cast("int")])))
    found = detect_text.scan_text(as_sources(docs, "doc_id", "text", "derived/", scan_col="source"), keep_match=True)
    return found.where(F.col("data_type").isin(SECRET_TYPES)).select("file_name", F.col("line_no").cast("bigint").alias("line_no"), "data_type", "match")


def code_calls(spark: SparkSession, d: str) -> DataFrame:
    """Logging and HTTP calls: every document as comment lines of a C# file
    that ends with one call."""
    calls = F.array(
        F.lit('logger.LogInformation("x", user.Email);'), F.lit("client.PostAsync(url, ((patient.Ssn)));"),
        F.lit('logger.LogInformation("user.Email");'), F.lit("logger.LogInformation(/* user.Email */ 1);"),
        F.lit("logger.LogInformation(')', user.Email);"), F.lit("client.PostAsJsonAsync<Person>(url, user.Email);"),
        F.lit('logger.LogInformation($"mail {(user.Ok ? user.Email : "x")}");'), F.lit('logger?.LogInformation("x", user.Email);'),
        F.lit("logger.LogInformation(patient.Address.Email);"),
    )
    docs = C.table(spark, d, "documents").withColumn("call", calls[F.pmod("doc_id", F.lit(9)).cast("int")])
    comment = F.concat(F.lit("// "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n// ")))
    src = as_sources(docs.withColumn("text", F.concat_ws("\n", comment, "call")), "doc_id", "text", "calls/", ".cs", scan_col="source")
    found = detect_code.sensitive_calls(src)
    return found.select("file_name", F.col("line_no").cast("bigint").alias("line_no"), "data_type", F.col("rule_ord").cast("bigint").alias("rule_ord"))


def two_scans_columns(spark: SparkSession, d: str) -> DataFrame:
    """Two scans whose files have the same names: customers and suppliers as
    CSV texts of up to a thousand rows, their columns in another order."""

    def files(table: str, key: str, header: str, row: F.Column, scan: str) -> DataFrame:
        rows = C.table(spark, d, table).select(F.floor(F.col(key) / 1000).cast("bigint").alias("part"), F.col(key).alias("key"), row.alias("row"))
        text = F.concat_ws("\r\n", F.lit(header), F.transform(F.sort_array(F.collect_list(F.struct("key", "row"))), lambda x: x["row"]))
        files = rows.groupBy("part").agg(text.alias("content"))
        name = F.concat(F.lit("part-"), F.col("part"), F.lit(".csv"))
        return files.select(F.concat(F.lit(scan), name).alias("source_id"), name.alias("file_name"), "content", F.lit("csv").alias("language"), F.lit(scan).alias("scan_id"))

    mail = F.concat(F.col("c_custkey"), F.lit(',"m'), F.col("c_custkey"), F.lit('@x.example"'))
    src = files("customer", "c_custkey", "k,v", mail, "A").unionByName(
        files("supplier", "s_suppkey", "v,k", F.concat(F.lit('"x,\n'), F.col("s_suppkey"), F.lit('",'), F.col("s_suppkey")), "B")
    )
    found = route_detectors(src).where(F.col("column_name").isNotNull())
    return found.select("scan_id", "location", "data_type", "snippet", "detected_by")


def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV and read back."""
    path = checkpoint_path(spark, f"csv-{uuid.uuid4().hex}")
    rows = C.table(spark, d, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit(', "q"\n')).alias("c_name"), "c_mktsegment")
    write_csv_table(rows, path)
    return read_csv_table(spark, path)


def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON Lines and read back."""
    path = checkpoint_path(spark, f"json-{uuid.uuid4().hex}")
    write_json_table(C.table(spark, d, "events").select("event_id", "event_type", "props"), path)
    return read_json_table(spark, path, lines=True, ordered=False)


def fix_chain(spark: SparkSession, d: str) -> DataFrame:
    """Fixes of several kinds on two columns of the customers, approved in
    turns, applied in that order."""
    c = C.table(spark, d, "customer")
    ops = [("c_name", "ANONYMIZE_COLUMN", {}), ("c_mktsegment", "MASK_COLUMN", {}), ("c_name", "ANONYMIZE_COLUMN", {"salt": "z"}), ("c_mktsegment", "ANONYMIZE_COLUMN", {}), ("c_name", "ANONYMIZE_COLUMN", {"salt": "z"})]
    approved = spark.createDataFrame(
        [(f"f{i}", "s", "NAME", f"customer:column={col}", tool, args, i) for i, (col, tool, args) in enumerate(ops)],
        "finding_id string, scan_id string, data_type string, location string, fix_tool string, fix_args map<string,string>, at int",
    ).withColumn("approved_at", F.timestamp_seconds("at"))
    files = spark.createDataFrame([("s", "customer", c.columns)], "scan_id string, file_name string, columns array<string>")
    out = remediate.apply_column_fixes(c, "customer", remediate.fix_plan(approved, files), scan_id="s")
    return out.select("c_custkey", "c_name", "c_mktsegment")


def first_approval(spark: SparkSession, d: str) -> DataFrame:
    """Two approvals of every finding; IP findings are rejected after them."""
    f = C.doc_findings(spark, d)
    step = lambda t, action, by: f.select("finding_id", F.lit(action).alias("action"), F.lit(by).alias("approved_by"), F.timestamp_seconds(F.lit(t)).alias("decided_at"), "data_type")
    decided = step(2, "APPROVE", "bob").unionByName(step(1, "APPROVE", "alice")).unionByName(step(3, "REJECT", "eve").where("data_type = 'IP'"))
    return remediate.approve(f, decided.drop("data_type")).select("finding_id", "status", "approved_by")


def reason_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A reasoner whose first answer is no JSON and whose second one is good."""
    second = lambda df: enrich.offline_reasoner(df).withColumnRenamed("raw_1", "raw_2").withColumn("raw_1", F.lit("no answer {"))
    f = enrich.enrich(C.doc_findings(spark, d), C.clause_idx(spark), reasoner=second)
    return f.select("finding_id", "severity", "policy_clause_id", "fix_tool", fix_args_text(F.col("fix_args")).alias("fix_args"))


def fix_args_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Fix arguments as JSON text: keys in any case, numbers, and no object."""
    docs = C.table(spark, d, "documents")
    text = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("[1, 2]")).otherwise(F.format_string('{"Column": "c%d", "n": %d}', "doc_id", "n_chars"))
    args = parse_fix_args(text)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), args["column"].alias("arg_column"), args["n"].alias("arg_n"))


def status_views(spark: SparkSession, d: str) -> DataFrame:
    """Stored states of scans and findings as the views show them."""
    k = F.pmod("doc_id", F.lit(5)).cast("int")
    scan = F.array(*[F.lit(x) for x in ("DONE", "error", "SCANNING", "PENDING", None)])[k]
    finding = F.array(*[F.lit(x) for x in ("APPROVED", "rejected", "PENDING_REVIEW", "other", None)])[k]
    docs = C.table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), scan_status_view(scan).alias("scan"), finding_status_view(finding).alias("finding"))


def stored_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes and vectors of the documents, stored and read back."""
    h = content_hash(F.coalesce("text", F.lit("")))
    vec = F.array(F.col("n_chars").cast("float"), F.lit(0.5).cast("float"))
    stored = encode_embedding(h, vec)
    return C.table(spark, d, "documents").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), h.alias("content_hash"),
        decode_embedding(stored, h)[0].cast("bigint").alias("first"), decode_embedding(stored, F.lit("00000000")).isNull().alias("other_hash"),
    )


def clause_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The clause index refreshed: every document as a clause, of which a
    quarter is stored with its right hash and a quarter with another."""
    docs = C.table(spark, d, "documents")
    clauses = docs.select(
        F.col("source").alias("policy_name"), F.lit(1).alias("clause_ord"), F.col("doc_id").cast("string").alias("clause_id"), F.col("lang").alias("title"),
        F.coalesce("text", F.lit("")).alias("clause_text"), F.array().cast("array<string>").alias("example_violations"), F.pmod("doc_id", F.lit(4)).alias("k"),
    )
    vec = F.array(F.lit(0.5).cast("float"))
    right = encode_embedding(content_hash(clause_search_text(F.col("title"), F.col("clause_text"), F.col("example_violations"))), vec)
    stored = F.when(F.col("k") == 0, right).otherwise(encode_embedding(F.lit("00000000"), vec))
    old = clauses.where(F.col("k").isin(0, 2)).select("policy_name", "clause_id", "title", "clause_text", stored.alias("stored_embedding"))
    index, _ = refresh_clause_index(old, clauses.drop("k"))
    return index.select("policy_name", "clause_id", "action")


def _in_small_splits(spark: SparkSession, size: int, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives with splits of ``size`` bytes, written and read back."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    held = {k: spark.conf.get(k) for k in names}
    path = checkpoint_path(spark, f"splits-{uuid.uuid4().hex}")
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        out = make()
        out.write.parquet(path)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(path)


def _one_text(rows: DataFrame, order: str, text: F.Column, path: str) -> None:
    """The rows' texts as the lines of one text, in parts: each task writes a
    range of ``order``."""
    rows.select(order, text.alias("value")).orderBy(order).select("value").write.text(path)


def csv_splits(spark: SparkSession, d: str) -> DataFrame:
    """Customers as two CSV texts read by splits of 8 KB: cells with commas, doubled
    quotes and line breaks.  The text of the BUILDING segment has a stray quote."""
    path = checkpoint_path(spark, f"csv-splits-{uuid.uuid4().hex}")
    c = C.table(spark, d, "customer")
    building = F.col("c_mktsegment") == "BUILDING"
    head = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("c_custkey,note,c_mktsegment").alias("value"))
    for part, stray, name in ((c.where(~building), "", "good"), (c.where(building), '5" pipe', "bad")):
        line = F.concat(F.col("c_custkey"), F.lit(',"'), F.col("c_name"), F.lit(', ""q""\n\n,end",' + stray), F.col("c_mktsegment"))
        _one_text(head.unionByName(part.select("c_custkey", line.alias("value"))), "c_custkey", F.col("value"), f"{path}/{name}")
    return _in_small_splits(spark, 8192, lambda: read_csv_table(spark, path, ordered=False, parts=True))


def json_splits(spark: SparkSession, d: str) -> DataFrame:
    """Events as one JSON array, read by splits of 8 KB."""
    path = checkpoint_path(spark, f"json-splits-{uuid.uuid4().hex}")
    e = C.table(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", "event_type", "props", F.array(F.lit("],{"), F.lit('"')).alias("odd"))).alias("value"))
    low = e.agg(F.min("event_id").alias("low"))
    text = F.concat(F.when(F.col("event_id") == F.col("low"), "[").otherwise(","), F.col("value"))
    end = spark.range(1).select(F.lit((1 << 63) - 1).alias("event_id"), F.lit("]").alias("value"))
    _one_text(e.join(F.broadcast(low)).select("event_id", text.alias("value")).unionByName(end), "event_id", F.col("value"), path)
    return _in_small_splits(spark, 8192, lambda: read_json_table(spark, path, ordered=False, parts=True))


def split_source(spark: SparkSession, d: str) -> DataFrame:
    """All documents as one text, scanned by splits of 64 KB: findings with their
    line in the text."""
    path = checkpoint_path(spark, f"split-source-{uuid.uuid4().hex}")
    docs = C.table(spark, d, "documents")
    _one_text(docs, "doc_id", F.coalesce("text", F.lit("")), path)
    lines = lambda: numbered_lines(spark, path, parts=True).withColumn("scan_id", F.lit("s"))
    found = _in_small_splits(spark, 65536, lambda: detect_text.scan_lines(lines(), keep_match=True))
    return found.select(F.col("line_no").cast("bigint").alias("line_no"), "data_type", F.col("match_ord").cast("bigint").alias("match_ord"), "match")


def scan_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the files of a scan a source.  A plug-in detector raises on
    every source whose number ends in 3; of those that end in 7 one file more
    was announced than comes."""
    from ..sources.policies import load_policy_clauses
    from ..streaming import lifecycle
    from ..streaming.scan import start_scan_stream

    run = checkpoint_path(spark, f"lifecycle-{uuid.uuid4().hex}")
    src = as_sources(C.table(spark, d, "documents"), "doc_id", "text", "documents/", scan_col="source")
    src.write.parquet(f"{run}/landing")
    end = F.right("scan_id", F.lit(1))
    now = F.current_timestamp()
    asked = src.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).select(
        "scan_id", F.lit("request").alias("kind"), (F.col("n") + F.when(end == "7", 1).otherwise(0)).alias("n_files"), F.lit(None).cast("string").alias("message"), now.alias("at")
    )
    lifecycle.write_events(asked, run)

    def poison(sources: DataFrame) -> DataFrame:
        broken = F.raise_error(F.concat(F.lit("PoisonError: cannot read "), F.col("scan_id"))).cast("boolean")
        return detect_text.scan_text(sources.where(F.when(end == "3", broken).otherwise(False)))

    stream = spark.readStream.schema(src.schema).parquet(f"{run}/landing")
    start_scan_stream(stream, load_policy_clauses(spark), run, detectors={"poison": poison}).awaitTermination()
    late = spark.range(1).select(
        F.lit(None).cast("string").alias("scan_id"), F.lit("clock").alias("kind"), F.lit(None).cast("long").alias("n_files"),
        F.lit(None).cast("string").alias("message"), (now + F.expr("INTERVAL 2 HOURS")).alias("at"),
    )
    lifecycle.write_events(late, run)
    lifecycle.start_lifecycle(spark, run).awaitTermination()
    return lifecycle.states(spark, run)


def _document_clauses(spark: SparkSession, d: str) -> DataFrame:
    return C.table(spark, d, "documents").select(
        F.col("source").alias("policy_name"), F.lit(1).alias("clause_ord"), F.format_string("%08d", "doc_id").alias("clause_id"), F.col("lang").alias("title"),
        F.coalesce("text", F.lit("")).alias("clause_text"), F.array().cast("array<string>").alias("example_violations"),
    )


def keyword_index_top1(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a clause, every benchmark text as a query, over all
    policies and over one."""
    b = C.table(spark, d, "benchmark").withColumn("query", F.concat(F.col("text"), F.lit(" zzzunknown")))
    asked = b.select(F.concat(F.lit("all-"), F.col("item_id")).alias("finding_id"), "query", F.lit(None).cast("string").alias("policy"))
    asked = asked.unionByName(b.select(F.concat(F.lit("one-"), F.col("item_id")).alias("finding_id"), "query", F.lit("SRC3").alias("policy")))
    found = retrieve_keywords(asked, clause_index(_document_clauses(spark, d)), policy=F.col("policy"))
    return found.select("finding_id", F.col("match.clause_id").alias("clause_id"), F.col("match.policy_name").alias("policy_name"), F.col("match.score").alias("score"))


def vector_index_top1(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings whose id 20 divides against all others."""
    e = C.table(spark, d, "embeddings")
    found = nearest_vectors(e.where("vec_id % 20 = 0"), e.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id")
    return found.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("match.near_id").cast("bigint").alias("near_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_rules_derived, code_calls, two_scans_columns, csv_round_trip, json_round_trip, fix_chain, first_approval, reason_fallback,
        fix_args_parsed, status_views, stored_embeddings, clause_refresh, scan_lifecycle, csv_splits, json_splits, split_source, keyword_index_top1,
        vector_index_top1,
    )
}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    base = oracle.oracle_sql()
    anon = lambda v, salt="": f"('anon_' || substr(sha256('{salt}' || {v}), 1, {R.ANON_HEX_CHARS}))"
    lines = "length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 2"
    return {
        "scan_rules_derived": f"""
            WITH a AS (SELECT doc_id, doc_id % 5 AS k, md5(coalesce(text, '')) AS h, CASE WHEN text IS NULL THEN 1 ELSE {lines} END AS line_no FROM documents),
            b AS (SELECT *, translate(h, 'abcdef', '012345') AS g FROM a)
            SELECT 'derived/' || doc_id AS file_name, CAST(line_no AS BIGINT) AS line_no,
              ['SSN', 'MAC', 'API_KEY', 'TOKEN', 'PRIVATE_KEY'][k + 1] AS data_type,
              CASE k WHEN 0 THEN g[1:3] || '-' || g[4:5] || '-' || g[6:9]
                     WHEN 1 THEN h[1:2] || ':' || h[3:4] || ':' || h[5:6] || ':' || h[7:8] || ':' || h[9:10] || ':' || h[11:12]
                     WHEN 2 THEN 'AKIA' || upper(h[1:16])
                     WHEN 3 THEN 'eyJ' || h[1:10] || '.' || h[11:20] || '.' || h[21:30]
                     ELSE '-----BEGIN RSA PRIVATE KEY-----' END AS match
            FROM b""",
        "code_calls": f"""
            SELECT 'calls/' || doc_id || '.cs' AS file_name, CAST({lines} AS BIGINT) AS line_no,
              CASE doc_id % 9 WHEN 1 THEN 'SSN' ELSE 'EMAIL' END AS data_type, CAST(CASE WHEN doc_id % 9 IN (1, 5) THEN 102 ELSE 101 END AS BIGINT) AS rule_ord
            FROM documents WHERE doc_id % 9 IN (0, 1, 4, 5, 6, 8)""",
        "two_scans_columns": """
            SELECT 'A' AS scan_id, 'part-' || (c_custkey // 1000) || '.csv:column=v' AS location, 'EMAIL' AS data_type,
              'm' || min(c_custkey) || '@x.example' AS snippet, 'AZURE' AS detected_by
            FROM customer GROUP BY c_custkey // 1000""",
        "csv_round_trip": "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', \"q\"' || chr(10) AS c_name, c_mktsegment FROM customer",
        "json_round_trip": "SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(event_type, '') AS event_type, coalesce(CAST(props AS VARCHAR), '') AS props FROM events",
        "fix_chain": f"""
            SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, {anon(anon(anon('c_name'), 'z'), 'z')} AS c_name,
              {anon("(c_mktsegment[1:1] || '***')")} AS c_mktsegment FROM customer""",
        "first_approval": oracle.with_(
            oracle.doc_findings_ctes(),
            "SELECT finding_id, CASE WHEN data_type = 'IP' THEN 'REJECTED' ELSE 'APPROVED' END AS status, 'alice' AS approved_by FROM tf",
        ),
        "reason_fallback": base["normalize_response"],
        "fix_args_parsed": """
            SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'c' || doc_id END AS arg_column,
              CASE WHEN doc_id % 3 <> 0 THEN CAST(n_chars AS VARCHAR) END AS arg_n FROM documents""",
        "status_views": """
            SELECT CAST(doc_id AS BIGINT) AS doc_id, ['done', 'done', 'running', 'pending', 'pending'][doc_id % 5 + 1] AS scan,
              ['approved', 'rejected', 'pending', 'pending', 'pending'][doc_id % 5 + 1] AS finding FROM documents""",
        "stored_embeddings": """
            SELECT CAST(doc_id AS BIGINT) AS doc_id, upper(sha256(coalesce(text, ''))[1:8]) AS content_hash,
              CAST(CAST(n_chars AS FLOAT) AS BIGINT) AS first, true AS other_hash FROM documents""",
        "keyword_index_top1": f"""
            WITH c AS (SELECT source AS policy_name, printf('%08d', doc_id) AS clause_id, {oracle.tokens("coalesce(lang, '') || '. ' || coalesce(text, '') || ' '")} AS ct FROM documents),
            b AS (SELECT item_id, {oracle.tokens("text || ' zzzunknown'")} AS qt FROM benchmark),
            q AS (SELECT 'all-' || item_id AS finding_id, qt, NULL AS policy FROM b UNION ALL SELECT 'one-' || item_id, qt, 'src3' FROM b),
            s AS (SELECT finding_id, clause_id, policy_name, len(list_intersect(qt, ct)) / len(qt) AS score FROM q JOIN c ON policy IS NULL OR lower(policy_name) = policy)
            SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY score DESC, policy_name, clause_id) = 1""",
        "vector_index_top1": """
            WITH p AS (SELECT q.vec_id, c.vec_id AS near_id, list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] * c.embedding[i] AS DOUBLE)))
                / (sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x * x AS DOUBLE)))) * sqrt(list_sum(list_transform(c.embedding, lambda x: CAST(x * x AS DOUBLE))))) AS score
              FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id % 20 <> 0)
            SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(near_id AS BIGINT) AS near_id FROM p QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, near_id) = 1""",
        "csv_splits": """
            SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || ', "q"' || chr(10) || chr(10) || ',end' AS note, c_mktsegment
            FROM customer WHERE c_mktsegment <> 'BUILDING'""",
        "json_splits": """
            SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(event_type, '') AS event_type, coalesce(CAST(props AS VARCHAR), '') AS props,
              '["],{","\\\""]' AS odd FROM events""",
        "split_source": oracle.with_(
            [*oracle.doc_findings_ctes(),
             "len AS (SELECT doc_id, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 1 AS n FROM documents)",
             "off AS (SELECT 'documents/' || doc_id AS file_name, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM len)"],
            "SELECT CAST(before + line_no AS BIGINT) AS line_no, data_type, CAST(match_ord AS BIGINT) AS match_ord, match FROM tf JOIN off USING (file_name)",
        ),
        "scan_lifecycle": """
            SELECT source AS scan_id, CASE WHEN right(source, 1) IN ('3', '7') THEN 'ERROR' ELSE 'DONE' END AS status,
              CASE right(source, 1) WHEN '3' THEN 'PoisonError: cannot read ' || source WHEN '7' THEN 'no progress for 3600 s in SCANNING' END AS error_message
            FROM documents GROUP BY source""",
        "clause_refresh": """
            SELECT source AS policy_name, CAST(doc_id AS VARCHAR) AS clause_id,
              CASE WHEN doc_id % 4 = 0 THEN 'reused' ELSE 'unembedded' END AS action FROM documents""",
    }
