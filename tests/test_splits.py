"""Files read by splits give what a parser of the whole file gives."""

import csv
import io
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from redline.plans import derived, scan
from redline.sources import splits
from redline.sources.files import read_sources
from redline.sources.tables import read_csv_table, read_json_table

CONF = {"spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}


@pytest.fixture(params=["150", "134217728"])
def split_bytes(spark, request):
    conf = CONF | {"spark.sql.files.maxPartitionBytes": request.param}
    held = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield int(request.param)
    for k, v in held.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w", newline="") as f:
        f.write(text)


CELLS = ["", "a", "x,y", "li\nne", 'q"q', '"', "\n", "é ü", '\n\n""\n,']


def test_csv_by_splits(spark, scratch, split_bytes):
    rng = random.Random(4)
    rows = [[rng.choice(CELLS) * rng.choice((1, 1, 1, 30)) for _ in range(rng.choice((3, 3, 2, 4)))] for _ in range(100)]
    rows = [r if any(r) else ["a", "b"] for r in rows]
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows([["h", "k", "h"], *rows])
    write(scratch, "a b+c%.csv", out.getvalue())
    write(scratch, "z.csv", "h,k\n1,2\n\n3,4")
    for name, text in (("s1.csv", 'h\n5" pipe\n1'), ("s2.csv", 'h\n"ab"c\n'), ("s3.csv", 'h,k\n1,"never\nclosed,2\n'), ("s4.csv", 'h\n1, "x"\n')):
        write(scratch, name, text)
    write(scratch, "empty.csv", "")
    found = splits.csv_records(spark, scratch)
    got = found.select("file_name", "row_key", splits.csv_cells_of(F.col("text")).alias("cells")).orderBy("row_key").collect()
    assert [r.cells for r in got if r.file_name == "a b+c%.csv"] == [["h", "k", "h"], *rows]
    assert {r.file_name for r in found.where("bad").collect()} == {"s1.csv", "s2.csv", "s3.csv", "s4.csv"}
    # cells by splits are those of the whole texts, in the same order
    cells = splits.csv_cells(spark, scratch).collect()
    whole = scan.csv_cells(read_sources(spark, scratch).withColumn("scan_id", F.lit("scan"))).collect()
    key = lambda rows: [(r.dataset, r.col_pos, r.column_name, r.value) for r in sorted(rows, key=lambda r: (r.dataset, r.row_key, r.col_pos))]
    assert key(cells) == key(whole) and {r.dataset for r in cells} == {"a b+c%.csv", "z.csv"}
    table = read_csv_table(spark, os.path.join(scratch, "a b+c%.csv"))
    assert table.columns == ["h", "k", "h_2", "column_4"]
    assert [tuple(r) for r in table.collect()] == [tuple([c or None for c in r] + [None] * (4 - len(r))) for r in rows]
    assert read_csv_table(spark, os.path.join(scratch, "s1.csv")).columns == []


def test_json_by_splits(spark, scratch, split_bytes):
    rng = random.Random(6)
    some = [1, "a,b]", 'q"\\', None, {"k": [1, {"z": "]},["}], "m": '\\",'}, [[], {}], {"a": 1.5, "b": "x" * 200}, {"é": " ,"}, {}]
    elements = [rng.choice(some) for _ in range(120)]
    write(scratch, "a.json", " " + json.dumps(elements, indent=1) + "\n")
    write(scratch, "b.json", json.dumps(elements, ensure_ascii=False, separators=(",", ":")))
    for name, text in (("empty", "[]"), ("blank", ""), ("object", '{"a":[1,2]}'), ("open", "[1,2"), ("after", '[{"a":1}] x'), ("two", "[1],[2]"), ("hole", "[1,,2]"), ("word", "[1,x]"), ("number", "7"), ("text", '"[1,2]"')):
        write(scratch, f"{name}.json", text)
    rows = splits.json_elements(spark, scratch).orderBy("row_key").collect()
    for name in ("a.json", "b.json"):
        assert [json.loads(r.text) for r in rows if r.file_name == name] == elements
    good = {r.file_name for r in rows} - {r.file_name for r in rows if r.bad}
    assert good == {"a.json", "b.json"}
    objects = splits.json_objects(spark, os.path.join(scratch, "b.json")).orderBy("rec").collect()
    assert [set(r.object) for r in objects] == [set(e) for e in elements if isinstance(e, dict)]
    table = read_json_table(spark, os.path.join(scratch, "a.json"))
    first = list(dict.fromkeys(k for e in elements if isinstance(e, dict) for k in e))
    assert table.columns == first and table.count() == sum(isinstance(e, dict) for e in elements)
    with pytest.raises(ValueError, match="key names"):
        read_json_table(spark, os.path.join(scratch, "a.json"), max_keys=2)


def test_scan_of_files_by_splits(spark, scratch, split_bytes):
    write(scratch, "notes.txt", "\n".join(f"line {i} mail a{i}@b.io" if i % 7 == 0 else "\r" * (i % 3) for i in range(400)))
    write(os.path.join(scratch, "sub"), "c.csv", "k,email\r\n" + "".join(f'"{i}\n",p{i}@q.io\r\n' for i in range(60)))
    write(scratch, "d.json", json.dumps([{"n": i, "phone": f"+1 555-010-{i:04}"} for i in range(50)]))
    write(scratch, "Bad.CSV", 'email\n5" pipe\na@b.io\n')
    write(scratch, "e.cs", "class A {\n  void F() { log.LogError(user.Email); }\n}\n")
    src = read_sources(spark, scratch).withColumn("scan_id", F.lit("scan"))
    key = lambda df: sorted((r.finding_id, r.location, r.data_type, r.snippet) for r in df.collect())
    got = key(scan.scan_files(spark, scratch))
    assert got == key(scan.route_detectors(src))
    assert {"sub/c.csv:column=email", "d.json:column=phone", "e.cs:2", "notes.txt:8", "Bad.CSV:3"} <= {x[1] for x in got}


def test_in_scan_csv_rejects_what_is_no_csv(spark):
    rows = [("1", "a.csv", 'item,email\n5" pipe,ann@shop.test\nx,b@c.io\n', "csv", "s"), ("2", "b.csv", 'item,email\n"5"" pipe",ann@shop.test', "csv", "s")]
    src = spark.createDataFrame(rows, "source_id string, file_name string, content string, language string, scan_id string")
    found = scan.route_detectors(src).where("column_name is not null").collect()
    assert [(r.location, r.data_type) for r in found] == [("b.csv:column=email", "EMAIL")]


def write_parts(folder, text, rng, n):
    """``text`` in files that end with a line break, as Spark's writers leave them."""
    lines = [x + "\n" for x in text.removesuffix("\n").split("\n")]
    cuts = sorted(rng.sample(range(1, len(lines)), n))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
        write(folder, f"part-{k:05}-x.txt", "".join(lines[a:b]))


def test_a_text_in_parts(spark, scratch, split_bytes):
    rng = random.Random(8)
    values = [rng.choice(["a", "],[{", 'q"\\', "x" * 300, ""]) for _ in range(90)]
    objects = [json.dumps({"k": v, "i": [i]}) for i, v in enumerate(values)]
    write_parts(f"{scratch}/json", "[" + "".join(o + rng.choice([",\n", "\n,"]) for o in objects[:-1]) + objects[-1] + "\n]\n", rng, 7)
    table = read_json_table(spark, f"{scratch}/json", parts=True)
    assert [(r.k, r.i) for r in table.collect()] == [(v, f"[{i}]") for i, v in enumerate(values)]
    assert read_json_table(spark, f"{scratch}/json").columns == []  # each part alone is no JSON
    cells = [[str(i), rng.choice(CELLS)] for i in range(90)]
    for name, rows in (("good", cells), ("bad", [*cells, ["z", "?"]])):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["n", "c"], *rows])
        write_parts(f"{scratch}/csv/{name}", out.getvalue().replace("z,?", 'z,5" pipe'), rng, 7)
    table = read_csv_table(spark, f"{scratch}/csv", parts=True)
    assert [list(r) for r in table.collect()] == [[i, c or None] for i, c in cells]
    lines = [rng.choice(["mail a@b.io", "", "\r"]) + str(i % 3) * (i % 2) for i in range(200)]
    write_parts(f"{scratch}/text", "\n".join(lines) + "\n", rng, 7)
    got = splits.numbered_lines(spark, f"{scratch}/text", parts=True).collect()
    assert sorted((r.line_no, r.line) for r in got) == [(i, x.rstrip("\r")) for i, x in enumerate(lines, 1) if x.rstrip("\r")]
    assert {r.file_name for r in got} == {""}


def test_small_splits_share_tasks(spark, scratch):
    write(scratch, "a.txt", "0123456\n" * 40_000)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", *CONF)}
    try:
        for k, v in (CONF | {"spark.sql.files.maxPartitionBytes": "512b"}).items():
            spark.conf.set(k, v)
        raw = splits.pieces(spark, scratch, "\n")
        assert raw.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert raw.select("block").distinct().count() == 625
        lines = splits.numbered_lines(spark, scratch).agg(F.count("*"), F.max("line_no"), F.countDistinct("line_no")).first()
        assert tuple(lines) == (40_000, 40_000, 40_000)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_task_writes_a_whole_text(spark, scratch):
    rows = spark.range(20_000, numPartitions=4).withColumn("id", 20_000 - F.col("id"))
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        derived._one_text(rows, "id", F.col("id").cast("string"), f"{scratch}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    sizes = [os.path.getsize(f"{scratch}/t/{f}") for f in os.listdir(f"{scratch}/t") if f.startswith("part-")]
    assert len(sizes) > 4 and max(sizes) < sum(sizes) / 3
    got = splits.numbered_lines(spark, f"{scratch}/t", parts=True).where("line != line_no").count()
    assert got == 0
