"""Files of any size read by splits: no task holds a file.

A file is read as pieces between separators (lines; for JSON the texts between
commas), each with the offset of its split and its number there.  What a piece
means depends on all before it (how many lines, whether a quote is open, how
deep the brackets are), so each split gives its totals, the totals of a file's
splits are summed up in order (a row a split), and a piece's state is its
split's start state plus the running sum inside the split.

* ``numbered_lines``: totals are line counts.
* ``csv_records``: a line maps the state "inside quotes" to another one; such a
  map sets, keeps or turns it, so a run of maps is the value that was last set,
  turned as often as lines after it turn.  Lines move only in splits in which
  some quote stays open.
* ``json_elements``: quotes turn the state, brackets outside of strings add to
  the depth; the array is cut at the commas of depth 1.

A record or element that crosses splits is put together by its first piece.
Totals and pieces belong to one plan, so both see the same splits.

With ``parts`` the files of a folder, in the order of their names, are one text
(as Spark's writers write it): a text of any size that no task has to write.
Each part ends with a line break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import gathered, qualified_path, stored

# A field: in quotes (doubled inside), opened at its start only, or without any.
_INNER = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'(?:"{_INNER}"|[^",\n]*+)'
CSV_RECORD = rf"\A{_FIELD}(?:,{_FIELD})*+\z"
# The quote that a line leaves open, from outside of quotes and from inside.
_LOOSE = rf'(?:(?:"{_INNER}"[^,]*+|[^",][^,]*+)?+,)*+"{_INNER}$'
_OPENS = rf"\A{_LOOSE}"
_STAYS = rf'\A{_INNER}(?:$|"[^,]*+,{_LOOSE})'


def pieces(spark: SparkSession, path: str, separator: str, pattern: str | None = None, parts: bool = False) -> DataFrame:
    """``file_name`` (relative to ``path``), ``block`` (offset of the split), ``id``
    (ascending in a split), ``value`` and ``head``: whether its file starts with
    the split.  The separator itself is left out.  ``pattern``: of the files'
    names.  ``parts``: a folder is one text, ``file_name`` the folder's name and
    ``block`` an offset in the whole text."""
    reader = spark.read.option("lineSep", separator).option("recursiveFileLookup", "true")
    read = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    root = qualified_path(spark, path).rstrip("/") + "/"
    full = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    base = F.regexp_replace(F.lit(root), "^file:/+", "file:/")
    relative = F.when(full.startswith(base), F.substring(full, F.length(base) + 1, F.length(full))).otherwise(F.regexp_extract(full, r"([^/]*)$", 1))
    raw = read.select(
        F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
        F.make_valid_utf8(F.col("value")).alias("value"),
        (F.col("_metadata.file_block_start") == 0).alias("head"),
        *([F.col("_metadata.file_path").alias("path_")] if parts else []),
    )
    raw = gathered(raw)
    if not parts:
        return raw
    # where each part starts in its text: a row a part, of which no content is read
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listed = (listed.option("pathGlobFilter", pattern) if pattern else listed).load(path)
    listed = listed.select(F.col("_metadata.file_path").alias("part_"), F.col("_metadata.file_size").alias("size"))
    folder = F.regexp_extract("part_", r"\A(.*/)", 1)
    before = F.coalesce(F.sum("size").over(Window.partitionBy(folder).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(listed.select("part_", before.alias("before")))
    return raw.join(starts, F.col("path_") == F.col("part_")).select(
        F.regexp_replace("file_name", r"/?[^/]*\z", "").alias("file_name"), (F.col("block") + F.col("before")).alias("block"), "id", "value", "head"
    )


_FILE = ["file_name"]
_SPLIT = ["file_name", "block"]


def _earlier(order: str, *by: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _upto(order: str, *by: str):
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _with(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Pieces with the columns of their split (left to AQE: a row a split)."""
    s = splits.withColumnRenamed("file_name", "file_").withColumnRenamed("block", "block_")
    return rows.join(s, (F.col("file_name") == F.col("file_")) & (F.col("block") == F.col("block_"))).drop("file_", "block_")


def numbered_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """The non-empty lines of every file under ``path``: ``file_name, line_no,
    line`` as ``functions.text.split_lines`` gives them of a whole file."""
    raw = pieces(spark, path, "\n", parts=parts)
    totals = raw.groupBy(*_SPLIT).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(_earlier("block", *_FILE)), F.lit(0))
    lines = _with(raw, totals.withColumn("offset", offset).drop("n"))
    line = F.rtrim("value", F.lit("\r"))
    number = (F.col("offset") + F.col("id") - F.col("first_id") + 1).cast("int")
    return lines.select("file_name", number.alias("line_no"), line.alias("line")).where(F.length("line") > 0)


def _assembled(rows: DataFrame, separator: str, *flags: str, continues: Column | None = None) -> DataFrame:
    """Pieces (``file_name, block, row_key, value, starts``) put together: each
    that starts with those up to the next that does.  ``flags`` are maximised.
    ``continues``: pieces that no separator stands before."""
    bare = F.col("starts") if continues is None else F.col("starts") | continues
    rows = rows.withColumn("value", F.concat(F.when(bare, "").otherwise(separator), "value"))
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    marked = rows.withColumn("start_key", F.when(F.col("starts"), F.col("row_key")))
    marked = marked.withColumn("own", last("start_key", _upto("row_key", *_SPLIT)))
    marked = marked.withColumn("whole", F.col("starts") & F.lead("starts", 1, False).over(Window.partitionBy(*_SPLIT).orderBy("row_key")))
    ends = rows.groupBy(*_SPLIT).agg(F.max(F.when(F.col("starts"), F.col("row_key"))).alias("last_start"))
    carried = ends.select(*_SPLIT, last("last_start", _earlier("block", *_FILE)).alias("carried"))
    single = marked.where("whole").select("file_name", "row_key", F.col("value").alias("text"), *flags)
    parts = _with(marked.where("NOT whole").drop("starts"), carried).withColumn("key", F.coalesce("own", "carried"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_key", "value"))), lambda x: x["value"]), "")
    joined = parts.groupBy("file_name", F.col("key").alias("row_key")).agg(text.alias("text"), *[F.max(f).alias(f) for f in flags])
    return single.unionByName(joined)


def csv_records(spark: SparkSession, path: str, pattern: str | None = None, parts: bool = False) -> DataFrame:
    """The records of every CSV file under ``path``: ``file_name``, ``row_key``
    (ascending in a file), ``text`` and ``bad``: whether a quote stands elsewhere
    than around a field, or is never closed.  Blank lines are left out."""
    raw = pieces(spark, path, "\n", pattern, parts).drop("head")
    quoted = F.col("value").contains('"')
    line = F.rtrim("value", F.lit("\r"))
    raw = raw.withColumn("opens", quoted & line.rlike(_OPENS)).withColumn("stays", ~quoted | line.rlike(_STAYS))
    raw = raw.withColumn("sets", F.when(F.col("opens") == F.col("stays"), F.col("opens"))).withColumn("turns", (F.col("opens") & ~F.col("stays")).cast("int"))
    raw = stored(raw, "csv-lines")  # the text is read and matched once

    # the map of a split: its lines' maps in order (those that keep the state left out)
    steps = F.sort_array(F.collect_list(F.when(~(~F.col("opens") & F.col("stays")), F.struct("id", "opens", "stays"))))
    through = F.aggregate(
        steps, F.struct(F.lit(False).alias("opens"), F.lit(True).alias("stays")),
        lambda m, x: F.struct(F.when(m["opens"], x["stays"]).otherwise(x["opens"]).alias("opens"), F.when(m["stays"], x["stays"]).otherwise(x["opens"]).alias("stays")),
    )
    splits = raw.groupBy(*_SPLIT).agg(F.min("id").alias("first_id"), F.max("opens").alias("some_open"), through.alias("m")).select(
        *_SPLIT, "first_id", "some_open",
        F.when(F.col("m.opens") == F.col("m.stays"), F.col("m.opens")).alias("sets"), (F.col("m.opens") & ~F.col("m.stays")).cast("int").alias("turns"),
    )
    splits = _states(splits, "block", F.lit(False), *_FILE).select(*_SPLIT, "first_id", "some_open", F.col("before").alias("starts_inside"))

    rows = _with(raw, splits).withColumn("row_key", F.col("block") + F.col("id") - F.col("first_id"))
    mixed = F.col("starts_inside") | F.col("some_open")
    plain = rows.where(~mixed).select("file_name", "row_key", F.col("value").alias("text"))
    inside = _states(rows.where(mixed), "row_key", F.col("starts_inside"), *_SPLIT)
    found = plain.unionByName(_assembled(inside.withColumn("starts", ~F.col("before")), "\n").select("file_name", "row_key", "text"))
    found = found.withColumn("text", F.rtrim("text", F.lit("\r"))).where(F.trim("text") != "")
    return found.withColumn("bad", ~F.col("text").rlike(CSV_RECORD))


def _states(rows: DataFrame, order: str, start: Column, *by: str) -> DataFrame:
    """``before``: the state before each row, from ``start`` on; a row sets it
    (``sets``), or turns it (``turns`` = 1), or keeps it."""
    rows = rows.withColumn("turned", F.sum("turns").over(_upto(order, *by)))
    w = _earlier(order, *by)
    since = F.coalesce(F.last(F.when(F.col("sets").isNotNull(), F.col("turned")), ignorenulls=True).over(w), F.lit(0))
    value = F.coalesce(F.last("sets", ignorenulls=True).over(w), start)
    turns = F.coalesce(F.last("turned").over(w), F.lit(0)) - since
    return rows.withColumn("before", value != (turns % 2 == 1))


def csv_text_records(content: Column) -> Column:
    """The records of a CSV text, blank lines left out; none if the text is no
    CSV: a quote that stands elsewhere than around a field, or is never closed."""
    record = rf"{_FIELD}(?:,{_FIELD})*+\r?(?:\n|\z)"
    found = F.transform(F.regexp_extract_all(content, F.lit(record), F.lit(0)), lambda x: F.rtrim(x, F.lit("\r\n")))
    good = F.filter(found, lambda x: F.trim(x) != "")
    return F.when(content.rlike(rf"\A(?:{record})*+\z"), good).otherwise(F.array().cast("array<string>"))


def csv_cells_of(text: Column, blank: Column | None = None) -> Column:
    """The cells of a record: quotes around a field taken off, doubled ones once.
    ``blank`` replaces an empty field without quotes."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(rf",({_FIELD})"), F.lit(1))
    plain = (lambda x: x) if blank is None else (lambda x: F.when(x == "", blank).otherwise(x))
    return F.transform(fields, lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(plain(x)))


def _sound(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of files without a bad one, and (``file_``, ``first_key``, ``first_text``)
    of these files."""
    files = rows.groupBy(F.col("file_name").alias("file_")).agg(
        F.min("row_key").alias("first_key"), F.min_by("text", "row_key").alias("first_text"), F.max("bad").alias("bad")
    )
    files = files.where("NOT bad").drop("bad")
    return rows.join(files, F.col("file_name") == F.col("file_")).drop("file_", "bad"), files


def csv_cells(spark: SparkSession, path: str, scan_id: str = "scan", pattern: str | None = None) -> DataFrame:
    """Cells of the CSV files under ``path``, as ``plans.scan.csv_cells`` gives
    them of whole texts (the row key is another one, in the same order)."""
    rows, _ = _sound(csv_records(spark, path, pattern))
    rows = rows.where("row_key > first_key").select(
        F.lit(scan_id).alias("scan_id"), F.col("file_name").alias("dataset"), "row_key", csv_cells_of(F.col("first_text")).alias("header"), F.posexplode(csv_cells_of(F.col("text"))).alias("col_pos", "value")
    )
    return rows.select(
        "scan_id", "dataset", "row_key", F.col("col_pos").cast("int"),
        F.coalesce(F.try_element_at("header", F.col("col_pos") + 1), F.lit("")).alias("column_name"), "value",
    )


def json_objects(spark: SparkSession, path: str, scan_id: str = "scan", pattern: str | None = None, parts: bool = False) -> DataFrame:
    """The objects in the arrays of the JSON files under ``path``, as
    ``plans.scan.json_objects`` gives them of whole texts."""
    rows, _ = _sound(json_elements(spark, path, pattern, parts))
    objects = rows.where(F.col("text").startswith("{"))
    return objects.select(F.lit(scan_id).alias("scan_id"), "file_name", F.col("row_key").alias("rec"), F.from_json("text", "map<string,string>").alias("object"))


def _brackets(text: Column) -> Column:
    """Opening brackets less closing ones."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def json_elements(spark: SparkSession, path: str, pattern: str | None = None, parts: bool = False) -> DataFrame:
    """The elements of the top-level array of every JSON file under ``path``:
    ``file_name``, ``row_key`` (ascending in a file), ``text`` and ``bad``: whether
    the element is no JSON, or the root no array, or the text not ended."""
    raw = pieces(spark, path, ",", pattern, parts)
    unquoted = F.split(F.regexp_replace("value", r"\\[\s\S]", ""), '"', -1)
    side = lambda odd: F.array_join(F.filter(unquoted, lambda p, i: i % 2 == odd), "")
    raw = raw.withColumn("quotes", F.size(unquoted) - 1).withColumn("plain", _brackets(side(0))).withColumn("other", _brackets(side(1)))
    raw = stored(raw, "json-pieces")  # the text is read and counted once
    w = _earlier("id", *_SPLIT)
    turned = F.coalesce(F.sum("quotes").over(w), F.lit(0)) % 2 == 1
    raw = raw.withColumn("turned", turned)
    # the depth that a piece adds if its split begins outside, and inside of a string
    raw = raw.withColumn("if_out", F.when(F.col("turned"), F.col("other")).otherwise(F.col("plain")))
    raw = raw.withColumn("if_in", F.when(F.col("turned"), F.col("plain")).otherwise(F.col("other")))
    totals = raw.groupBy(*_SPLIT).agg(F.min("id").alias("first_id"), F.sum("quotes").alias("quotes"), F.sum("if_out").alias("if_out"), F.sum("if_in").alias("if_in"))
    e = _earlier("block", *_FILE)
    totals = totals.withColumn("inside", F.coalesce(F.sum("quotes").over(e), F.lit(0)) % 2 == 1)
    added = F.when(F.col("inside"), F.col("if_in")).otherwise(F.col("if_out"))
    totals = totals.withColumn("depth0", F.coalesce(F.sum(added).over(e), F.lit(0))).withColumn("first_block", F.min("block").over(Window.partitionBy(*_FILE)))
    rows = _with(raw, totals.select(*_SPLIT, "first_id", "inside", "depth0", "first_block"))
    rows = rows.withColumn("row_key", F.col("block") + F.col("id") - F.col("first_id"))
    delta = F.when(F.col("inside"), F.col("if_in")).otherwise(F.col("if_out"))
    rows = rows.withColumn("after", F.col("depth0") + F.sum(delta).over(_upto("id", *_SPLIT)))
    in_string = F.col("inside") != F.col("turned")
    first = (F.col("block") == F.col("first_block")) & (F.col("id") == F.col("first_id"))
    # a later part goes on with the last piece of the part before it
    goes_on = F.col("head") & (F.col("id") == F.col("first_id")) & ~F.col("first")
    rows = rows.withColumn("first", first).withColumn("goes_on", goes_on)
    rows = rows.withColumn("starts", F.col("first") | (~F.col("goes_on") & ~in_string & (F.col("after") - delta == 1)))
    open_after = (in_string != (F.col("quotes") % 2 == 1)) | (F.col("after") != 0)
    rows = rows.withColumn("ends", ~open_after)
    found = _assembled(rows, ",", "first", "ends", continues=F.col("goes_on"))
    begins = F.when(F.col("first"), F.regexp_replace("text", r"\A\ufeff?\s*\[", "")).otherwise(F.col("text"))
    rooted = ~F.col("first") | F.col("text").rlike(r"\A\ufeff?\s*\[")
    text = F.when(F.col("ends"), F.regexp_replace(begins, r"\]\s*\z", "")).otherwise(begins)
    closed = ~F.col("ends") | F.col("text").rlike(r"\]\s*\z")
    found = found.select("file_name", "row_key", F.btrim(text, F.lit(" \t\r\n")).alias("text"), (~rooted | ~closed).alias("unrooted"), "first", "ends")
    # every file has exactly one end, that of its last element
    none = F.col("first") & F.col("ends") & F.col("text").rlike(r"\A\s*\z")
    bad = F.col("unrooted") | (~none & F.expr("try_parse_json(text)").isNull())
    keys = found.groupBy("file_name").agg(F.max("row_key").alias("last_key"), F.max(F.when(F.col("ends"), F.col("row_key"))).alias("end_key"))
    keys = keys.select(F.col("file_name").alias("file_"), (~F.col("last_key").eqNullSafe(F.col("end_key"))).alias("unended"))
    out = found.withColumn("bad", bad).withColumn("none", none).join(keys, F.col("file_name") == F.col("file_"))
    return out.where("NOT (none AND NOT bad)").select("file_name", "row_key", "text", (F.col("bad") | F.col("unended")).alias("bad"))
