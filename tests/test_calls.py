"""Member calls of C# texts: forms, order of names, time."""

import time

import pytest

from redline.functions.calls import member_calls
from redline.operators import detect_code


def flagged(text):
    """(line, method, data type) of the calls with a sensitive name."""
    return [(line, method, found) for line, _, method, found in member_calls(text) if found]


@pytest.mark.parametrize(
    "text, want",
    [
        ("logger.Log(')', user.Email)", [(1, "Log", "EMAIL")]),
        ("client.PostAsJsonAsync<Person>(url, user.Email)", [(1, "PostAsJsonAsync", "EMAIL")]),
        ("l.Log<Dictionary<string, int[]>>(user.Email)", [(1, "Log", "EMAIL")]),
        ('l.Log($"mail {(user.Ok ? user.Email : "x")}")', [(1, "Log", "EMAIL")]),
        ('l.Log($"a {x:password} {{token}} {y.Phone,5:N0}")', [(1, "Log", "PHONE")]),
        ('l.Log($"a {f($"b {u.Ssn}")}")', [(1, "Log", "SSN")]),
        ('l.Log($@"a ""token"" {\nu.Ssn}")', [(1, "Log", "SSN")]),
        ('l.Log("""raw " u.Email""", $$"""{token} {{u.Ssn}}""")', [(1, "Log", "SSN")]),
        ('l.Log(@"a "" u.Email \\", 1); l.Log(u.Token)', [(1, "Log", "TOKEN")]),
        ('logger?.Log("x", user.Email)', []),
        ("a?.b.Log(user.Email)", [(1, "Log", "EMAIL")]),
        ("l.Log(patient.Address.Email)", [(1, "Log", "EMAIL")]),
        ("l.Log(a.Ssn(x.Phone).Email)", [(1, "Log", "EMAIL"), (1, "Ssn", "PHONE")]),
        ("l.Log(a.B(x.Phone).C(y.Email))", [(1, "Log", "PHONE"), (1, "B", "PHONE"), (1, "C", "EMAIL")]),
        ("l.Log(a[u.Phone], u.Email)", [(1, "Log", "PHONE")]),
        ("l.Log(new Mail(u.Phone) { Token = 1 })", [(1, "Log", "PHONE")]),
        ("l.Log(email => 1)", []),
        ("l.Log(x < y, u.Email > 3)", [(1, "Log", "EMAIL")]),
        ("l.Log(u.Email;\nl.Log(u.Ssn);", [(2, "Log", "SSN")]),
        ("#region it's l.Log(u.Email)\n// l.Log(u.Email)\n/* l.Log(u.Email)\n*/ l.Log(u.Ssn);", [(4, "Log", "SSN")]),
        ('l.Log("unclosed u.Email\n); l.Log(u.Ssn)', [(2, "Log", "SSN")]),
        ("for (var i = 0; i < 3; i++) { l.Log(u.Email); }", [(1, "Log", "EMAIL")]),
        ("client\n  .With(1)\n  .PostAsync(u.Ssn)", [(1, "PostAsync", "SSN")]),
        ("l.Log(" + "(" * 3000 + "u.Email" + ")" * 3000 + ")", [(1, "Log", "EMAIL")]),
        ("", []),
        (")]}>\"'{([.?.;", []),
    ],
)
def test_forms(text, want):
    assert flagged(text) == want


def test_only_a_single_name_is_a_receiver():
    assert [(r, m) for _, r, m, _ in member_calls("Console.Write(a); x.Console.Write(a); f(1).Write(a); Console?.Write(a)")] == [
        ("Console", "Write"), (None, "Write"), (None, "Write"),
    ]


def test_time_grows_with_the_length():
    body = '  void M() { logger.LogInformation("x {0}", user.Email); client.PostAsync(url, f.g(h.i(1))); }\n'
    spent = []
    for n in (4_000, 32_000):
        text = "class A {\n" + body * n + "}"
        begin = time.process_time()
        assert sum(found == "EMAIL" for *_, found in member_calls(text)) == n
        spent.append(time.process_time() - begin)
    assert len(text) > 3_000_000 and spent[1] < 24 * max(spent[0], 0.05)
    for odd in ("a.b(" * 50_000, '$"{' * 50_000, "a.b<" * 50_000, "/*" * 50_000, "x.y(;" * 50_000, "({" * 50_000 + ")" * 50_000):
        member_calls(odd)


def test_large_source_in_spark(spark):
    n = 8_000
    text = "\n".join(f"    logger.LogInformation({i}, user.Email);" for i in range(n)) + "\nx.LogX(1);"
    src = spark.createDataFrame([("1", "a.cs", text, "csharp")], "source_id string, file_name string, content string, language string")
    rows = detect_code.sensitive_calls(src).collect()
    assert sorted(r.line_no for r in rows) == list(range(1, n + 1)) and len({r.finding_id for r in rows}) == n
    assert rows[0].snippet.startswith("logger.LogInformation(")
