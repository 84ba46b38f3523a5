from pyspark.sql import functions as F

from redline.operators import detect_code, detect_columns
from redline.plans.scan import csv_cells, json_cells, route_detectors


def _col_findings(spark, sources):
    cells = csv_cells(sources.withColumn("scan_id", F.lit("s")))
    f = detect_columns.scan_columns(cells.drop("scan_id"), scan_id="s")
    return {r.column_name: (r.data_type, r.detected_by, r.snippet) for r in f.collect()}


def test_mock_customers_columns(spark, mock_sources):
    got = _col_findings(spark, mock_sources.where("file_name = 'customers.csv'"))
    assert got == {
        "email": ("EMAIL", "AZURE", "olga@shop.test"),
        "ssn": ("SSN", "AZURE", "321-54-9876"),
    }


def test_mock_patients_columns(spark, mock_sources):
    got = _col_findings(spark, mock_sources.where("file_name = 'patients.csv'"))
    assert {k: v[:2] for k, v in got.items()} == {
        "diagnosis": ("DIAGNOSIS", "KEYWORD"),
    }


def test_name_rule_traps(spark):
    from redline.functions.columns import classify_column_name

    names = ["hotel", "classname", "account_name", "c_name", "EmailAddress", "room", "Date-Of-Birth"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(classify_column_name(F.col("n"))).collect()]
    assert got == ["PHONE", "SSN", "BANK_ACCOUNT", "NAME", "EMAIL", None, "DOB"]


def test_samples_bridge_lines(spark):
    # integer samples joined by LF read as a phone number (kept on purpose)
    df = spark.createDataFrame([(i, v) for i, v in enumerate([899, 769, 330, 780, 1028, 5])], "k long, v long")
    f = detect_columns.scan_table(df, "t", "k").collect()
    assert [(r.column_name, r.data_type, r.detected_by) for r in f] == [("v", "PHONE", "AZURE")]


def test_blank_values_and_names_skipped(spark):
    df = spark.createDataFrame([(1, " ", "x"), (2, "\t", "y")], "k long, email string, `  ` string")
    f = detect_columns.scan_table(df, "t", "k", k=5).collect()
    assert f == []


def test_json_cells_first_seen_order(spark):
    content = '[{"b": 1, "a": "x"}, 5, {"c": null, "a": "y@z.io"}]'
    src = spark.createDataFrame([("s", "d.json", content)], "scan_id string, file_name string, content string")
    cells = json_cells(src).orderBy("row_key", "col_pos").collect()
    assert [(r.row_key, r.col_pos, r.column_name, r.value) for r in cells] == [
        (0, 0, "b", "1"), (0, 1, "a", "x"), (2, 1, "a", "y@z.io"), (2, 2, "c", ""),
    ]


def test_code_rules_on_mock_files(spark, mock_sources):
    code = mock_sources.where("language = 'csharp'")
    rows = detect_code.scan_code(code, scan_id="s").collect()
    got = sorted((r.location, r.data_type, r.rule_ord) for r in rows)
    assert got == [("auth.cs:8", "EMAIL", detect_code.RULE_LOGGING), ("config.cs:5", "API_KEY", detect_code.RULE_LITERAL)]
    assert all(r.detected_by == "ROSLYN" for r in rows)


def test_code_rule_cases(spark):
    text = "\n".join([
        'Log(user.Email);',                         # 1 no receiver: not flagged
        'x.Login(user.Email);',                     # 2 Login starts with Log: flagged
        'logger.LogInformation("email is {0}");',  # 3 only text in a string: not flagged
        'var password = "x";',                      # 4 flagged
        'this.password = "x";',                     # 5 flagged
        'password = Get();',                        # 6 not flagged
        'Console.WriteLine(customer.Phone);',       # 7 flagged
        'http.PostAsync(url, user.Ssn);',           # 8 flagged (http)
        'if (token == "abc") {}',                   # 9 comparison: not flagged
    ])
    src = spark.createDataFrame([("1", "a.cs", text, "csharp")], "source_id string, file_name string, content string, language string")
    rows = detect_code.scan_code(src).collect()
    got = sorted((r.line_no, r.data_type) for r in rows)
    assert got == [(2, "EMAIL"), (4, "PASSWORD"), (5, "PASSWORD"), (7, "PHONE"), (8, "SSN")]


def test_route_detectors_mock(spark, mock_sources):
    rows = route_detectors(mock_sources, scan_id="scan1").collect()
    by = {}
    for r in rows:
        by.setdefault((r.file_name, r.detected_by), []).append(r.data_type)
    # a CSV gets both its line findings and its column findings
    assert sorted(by[("customers.csv", "REGEX")]).count("EMAIL") == 3
    assert sorted(by[("customers.csv", "AZURE")]) == ["EMAIL", "SSN"]
    assert ("customers.csv", "KEYWORD") not in by
    assert by[("patients.csv", "KEYWORD")] == ["DIAGNOSIS"]
    assert by[("auth.cs", "ROSLYN")] == ["EMAIL"]
    assert by[("config.cs", "ROSLYN")] == ["API_KEY"]
    assert ("config.cs", "REGEX") not in by  # the regex API_KEY rule does not hit this value


def test_multi_line_calls(spark):
    text = "\n".join([
        "class A {",                                   # 1
        "  void F(User user) {",                       # 2
        "    _logger.LogWarning(",                     # 3  call starts here
        "        \"reset for {0}\",",                  # 4
        "        user.Email);",                        # 5
        "    client",                                  # 6
        "      .PostAsync(url,",                       # 7  starts at the '.' line
        "        payload.Ssn);",                       # 8
        "    x.Log(\"password\");",                    # 9  only a string: no finding
        "  }",
        "}",
    ])
    src = spark.createDataFrame([("1", "a.cs", text, "csharp")], "source_id string, file_name string, content string, language string")
    rows = sorted((r.line_no, r.data_type, r.snippet) for r in detect_code.sensitive_calls(src).collect())
    assert rows == [(3, "EMAIL", "_logger.LogWarning("), (6, "SSN", "client")]


def test_calls_inside_arguments(spark):
    text = "\n".join([
        "users.ForEach(u => logger.LogInformation(u.Email));",            # 1 lambda
        "Task.Run(() => client.PostAsync(url, user.Ssn));",               # 2
        'app.MapGet("/x", ctx => {',                                      # 3 handler
        "    logger.LogError(user.Phone);",                               # 4
        "});",
        "logger.LogInformation(client.GetAsync(user.Ssn), user.Email);",  # 6 two findings
        "x.F(logger.LogError(1), y.G(y.H(Console.Write(z.Token))));",     # 7 the innermost
        "logger.LogError(user.Email;",                                    # 8 never closed
        "users.ForEach(u => {",
        "  logger.LogError(user.Email); });",                             # 10 same head as 8
    ])
    src = spark.createDataFrame([("1", "a.cs", text, "csharp")], "source_id string, file_name string, content string, language string")
    rows = sorted((r.line_no, r.data_type, r.rule_ord) for r in detect_code.sensitive_calls(src).collect())
    log, http = detect_code.RULE_LOGGING, detect_code.RULE_HTTP
    assert rows == [(1, "EMAIL", log), (2, "SSN", http), (4, "PHONE", log), (6, "SSN", log), (6, "SSN", http), (7, "TOKEN", log), (10, "EMAIL", log)]


def test_interpolated_string_holes(spark):
    text = "\n".join([
        'logger.LogInformation($"Reset for {user.Email} at {DateTime.Now}");',   # 1 EMAIL via hole
        'logger.LogInformation($"email sent to {count} users");',                # 2 text only: none
        'Console.WriteLine($"Card: {order.CreditCard:N0}", "token");',           # 3 CREDIT_CARD
    ])
    src = spark.createDataFrame([("1", "a.cs", text, "csharp")], "source_id string, file_name string, content string, language string")
    rows = sorted((r.line_no, r.data_type) for r in detect_code.sensitive_calls(src).collect())
    assert rows == [(1, "EMAIL"), (3, "CREDIT_CARD")]


def test_repeated_header_gives_distinct_ids(spark):
    content = "email,email\na@b.io,c@d.io\n"
    src = spark.createDataFrame([("s", "dup.csv", content)], "scan_id string, file_name string, content string")
    f = detect_columns.scan_columns(csv_cells(src).drop("scan_id"), scan_id="s").collect()
    assert len(f) == 2 and len({r.finding_id for r in f}) == 2


def test_sampling_paths_agree(spark):
    from samples import SF_SMALL

    for name, key in [("customer", "c_custkey"), ("lineitem", ["l_orderkey", "l_linenumber"]), ("events", "event_id")]:
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        a = detect_columns.sample_table_values(df, name, key)
        b = detect_columns.sample_column_values(detect_columns.table_cells(df, name, key))
        rows = lambda x: sorted(tuple(r) for r in x.select("col_pos", "column_name", "sample_ord", "value").collect())
        assert rows(a) == rows(b), name
        c = detect_columns.table_column_samples(df, name, key)
        per_col = {r.col_pos: list(r.samples) for r in c.collect()}
        for col_pos, _n, _o, _v in rows(a):
            assert per_col[col_pos] == [v for p, _n2, _o2, v in rows(a) if p == col_pos]
