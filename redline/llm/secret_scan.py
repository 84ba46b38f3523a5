"""Secret scans with false-positive removal (DataFrame functions and MLlib).

Candidates are runs of at least ``MIN_CHARS`` characters from
``[A-Za-z0-9_+/=-]`` that hold a digit, keys of known forms (API keys, whole
tokens of parts joined by dots, private key blocks), quoted values assigned to a
name of a credential and passwords in links.  A random forest tells secrets from
other codes by a candidate's length, its character classes and their
transitions, the share of it that dictionary words cover (words of enough
documents of the corpus, counted over all of them), the path it is in and the
words around it.  The forest is trained on labelled findings.

Where no labelled findings are given, rules label the clear ones: assigned to
a name of a credential, in quotes: secret; a payment card number (Luhn), a
run of digits, a lower-case phrase with few digits, a path or an address: not.
The forest then decides on all candidates, the unclear ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, text_of

MIN_CHARS = 12
CHARS = r"A-Za-z0-9_+/=\-"
CONTEXT = 64
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 6, 8
THRESHOLD = 0.5
MIN_DOCS = 20  # documents that hold a dictionary word
MASK = "[SECRET]"
_CREDENTIAL = r"(?i)(token|secret|passw(or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth(?!or(?!i[sz]))|bearer)"
_NAMED = r"[A-Za-z0-9_]{0,24}[\"']?\s{0,4}(:|=|:=|=>)\s{0,4}"
_ASSIGNED = _CREDENTIAL + _NAMED + r"[\"'`]?$"
# Known forms, as the text rules have them; what follows a key without a gap goes with it.
_BLOCK = r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,2}PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----)?+"
_KEY = (
    r"\b(?:eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,4}+"
    rf"|(?:AKIA[0-9A-Z]{{16}}|(?:sk|pk)-[A-Za-z0-9]{{20,}}+|ghp_[A-Za-z0-9]{{36}})\b[{CHARS}]*+)"
)
_QUOTED = "|".join(rf"(?<={q})(?<={_CREDENTIAL}{_NAMED}{q})(?-i)(?:[^{q}\\\n]|\\.)++(?={q})" for q in "\"'`")
_LINK = r"(?<=:)(?<=://[^\s:@/\"'`]{0,64}:)[^\s@/\"'`]++(?=@)"
_APART = rf"(?!-----BEGIN |{_KEY})"  # a run ends where a known form begins
_RUN = rf"(?<![{CHARS}])(?=(?:{_APART}[A-Za-z_+/=\-])*+{_APART}[0-9])(?:{_APART}[{CHARS}]){{{MIN_CHARS},}}+"
CANDIDATE = f"{_BLOCK}|{_QUOTED}|{_LINK}|{_KEY}|{_RUN}"
_PLACEHOLDER = r"(?i)(example|sample|dummy|changeme|placeholder|test)"
_WORD = r"[a-z]{4,}"


def find_candidates(docs: DataFrame, text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: ``doc_id, text_hash, start`` (code points),
    ``code``, and 64 characters before and after it."""
    text = text_of(text_col)
    path = F.coalesce(F.col(path_col), F.lit("")) if path_col and path_col in docs.columns else F.lit("")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), text.alias("text")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.select(
        "doc_id", "path", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row_id"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("codes"),
        F.split("text", CANDIDATE, -1).alias("gaps"),
    )
    n = F.size("codes")
    parts = F.arrays_zip(
        F.col("codes").alias("code"),
        F.transform(F.slice("gaps", F.lit(1), n), lambda g: F.char_length(g)).alias("gap"),
        F.transform(F.slice("gaps", F.lit(1), n), lambda g: F.right(g, F.lit(CONTEXT))).alias("before"),
        F.transform(F.slice("gaps", F.lit(2), n), lambda g: F.left(g, F.lit(CONTEXT))).alias("after"),
    )
    found = rows.select("doc_id", "path", "text_hash", "row_id", F.posexplode(parts).alias("nth", "x"))
    # places: the sum of gaps and codes before; a row's candidates, slim
    order = Window.partitionBy("row_id").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum(F.col("x.gap") + F.char_length("x.code")).over(order)
    return found.select(
        "doc_id", "path", "text_hash", (upto - F.char_length("x.code")).alias("start"), F.col("x.code").alias("code"), F.col("x.before").alias("before"), F.col("x.after").alias("after")
    )


def dictionary(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """The words of four letters or more that ``min_docs`` documents hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text_of(text_col)), F.lit(_WORD), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_docs).select("word")


def coverage(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """``code, covered``: the share of each distinct code's characters that lie
    in letter runs that are dictionary words."""
    codes = candidates.select("code").distinct()
    runs = codes.select("code", F.explode(F.regexp_extract_all(F.lower("code"), F.lit(_WORD), F.lit(0))).alias("word"))
    hit = runs.join(words, "word").groupBy("code").agg(F.sum(F.char_length("word")).alias("chars"))
    return codes.join(hit, "code", "left").select("code", (F.coalesce("chars", F.lit(0)) / F.char_length("code")).alias("covered"))


FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "hex", "distinct", "transitions", "vowel_transitions", "covered",
    "path_test", "path_depth", "assigned", "credential", "quoted", "placeholder", "words_before", "words_after", "known",
]


def _share(code: Column, pattern: str) -> Column:
    return F.regexp_count(code, F.lit(pattern)) / F.char_length(code)


def known_form() -> Column:
    """Whether a candidate is a key of a known form or a password in a link."""
    link = F.col("before").rlike(r"://[^\s:@/\"'`]{0,64}:$") & F.col("after").startswith("@")
    return F.col("code").rlike(rf"^(?:{_BLOCK}|{_KEY})$") | link


def add_features(candidates: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with the columns ``FEATURES``."""
    code, before, after = F.col("code"), F.col("before"), F.col("after")
    as_number = lambda c: c.cast("double")
    classes = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[_+/=\-])(?=[A-Za-z0-9])"
    vowels = r"(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])"
    value = {
        "length": as_number(F.char_length(code)),
        "digits": _share(code, "[0-9]"),
        "upper": _share(code, "[A-Z]"),
        "lower": _share(code, "[a-z]"),
        "symbols": _share(code, r"[_+/=\-]"),
        "hex": _share(code, "[0-9a-fA-F]"),
        "distinct": F.size(F.array_distinct(F.split(code, ""))) / F.char_length(code),
        "transitions": _share(code, classes),
        "vowel_transitions": _share(code, vowels),
        "path_test": as_number(F.col("path").rlike(r"(?i)(test|example|sample|mock|fixture|docs?/)")),
        "path_depth": as_number(F.size(F.split("path", "/"))),
        "assigned": as_number(before.rlike(r"(:|=|:=|=>)\s{0,4}[\"'`]?$")),
        "credential": as_number(before.rlike(_CREDENTIAL)),
        "quoted": as_number(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "placeholder": as_number(F.concat_ws(" ", before, code, after).rlike(_PLACEHOLDER)),
        "words_before": as_number(F.regexp_count(before, F.lit(r"\p{L}+"))),
        "words_after": as_number(F.regexp_count(after, F.lit(r"\p{L}+"))),
        "known": as_number(known_form()),
    }
    return candidates.join(coverage(candidates, words), "code").withColumns(value)


def rule_labels(candidates: DataFrame) -> DataFrame:
    """Column ``label``: 1 and 0 for clear findings, null for the others."""
    code = F.col("code")
    digits = code.rlike(r"^[0-9]+$")
    phrase = (_share(code, "[a-z]") > 0.8) & (_share(code, "[0-9]") < 0.1)
    plain = code.rlike(r"^[A-Za-z][a-z]*+(?:[ _-][A-Za-z]?[a-z]*+)*+$")  # words: unclear
    placed = F.col("before").rlike(r"(://|[./@])[^\s\"']{0,64}$")
    return candidates.withColumn(
        "label",
        F.when(known_form(), 1.0)
        .when(F.col("before").rlike(_ASSIGNED) & ~plain & ~F.col("before").rlike(_PLACEHOLDER) & ~code.rlike(r"^(.)\1*$"), 1.0)
        .when(F.col("before").rlike(_ASSIGNED) & plain, None)
        .when(digits | F.expr("luhn_check(code)") | phrase | placed, 0.0),
    )


def fit_forest(labelled: DataFrame, train_rows: int = TRAIN_ROWS):
    """A random forest on the labelled findings, equal ones once, at most
    ``train_rows`` of each class (those of the smallest hashes), or None if a
    class is missing.  Both classes weigh the same in all, so rare secrets count."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    label = F.col("label").cast("double")
    known = labelled.where(F.col("label").isNotNull()).select(*FEATURES, label.alias("label"), F.xxhash64("path", "code", "before", "after").alias("h"))
    hashes = shared_table(known.select("label", "h").distinct(), "finding-hashes")
    chosen = [hashes.where(F.col("label") == x).orderBy("h").limit(train_rows) for x in (0.0, 1.0)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))
    sample = shared_table(known.join(chosen, ["label", "h"], "left_semi").dropDuplicates(["label", "h"]).drop("h"), "findings")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    weight = F.when(F.col("label") == 1, sum(sizes.values()) / (2 * sizes[1.0])).otherwise(sum(sizes.values()) / (2 * sizes[0.0]))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.withColumn("weight", weight))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(rows.select("features", "label", "weight"))


def forest_scores(forest, found: DataFrame) -> DataFrame:
    """``found`` with ``score``, the forest's probability of a secret."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
    return forest.transform(rows).withColumn("score", vector_to_array("probability")[1])


def scan_secrets(
    docs: DataFrame,
    labelled: DataFrame | None = None,
    words: DataFrame | None = None,
    path_col: str | None = "source",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per candidate: ``doc_id, text_hash, start, length, code, score,
    is_secret``; ``score`` is the forest's probability that it is a secret.

    ``labelled``: findings with ``path, code, before, after, label`` (1 a
    secret, 0 a false positive; null rows are left out).  ``words``: the
    dictionary.  Null texts hold no candidate; repeated rows give theirs again;
    an empty table gives no rows.  If the labelled findings lack a class, each
    candidate gets its rule's label, 0.5 where no rule applies.  Without
    ``labelled``, known forms and passwords in links always have score 1.
    """
    words = dictionary(docs) if words is None else words
    found = shared_table(rule_labels(add_features(shared_table(find_candidates(docs, path_col=path_col), "candidates"), words)), "findings")
    forest = fit_forest(found if labelled is None else add_features(labelled, words))
    if forest is None:
        scored = found.withColumn("score", F.coalesce("label", F.lit(0.5)))
    else:
        scored = forest_scores(forest, found)
        if labelled is None:
            scored = scored.withColumn("score", F.when(F.col("known") == 1, 1.0).otherwise(F.col("score")))
    return scored.select(
        "doc_id", "text_hash", "start", F.char_length("code").alias("length"), "code", "score", (F.col("score") > threshold).alias("is_secret")
    )


def mask_secrets(docs: DataFrame, findings: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask`` and
    ``n_chars`` (if there) counted anew; all columns stay."""
    secrets = findings.where("is_secret").groupBy("doc_id", "text_hash").agg(F.collect_set("code").alias("secrets"))
    secrets = secrets.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_hash").alias("k3"), "secrets")
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(id_, F.lit(0).cast("long")).alias("k1"), id_.isNull().alias("k2"), F.xxhash64(text_of()).alias("k3"))
    found = keyed.join(secrets, ["k1", "k2", "k3"], "left")
    text = F.col("row.text")
    codes = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda c: F.when(F.array_contains("secrets", c), F.lit(mask)).otherwise(c))
    masked = F.array_join(F.flatten(F.zip_with(F.split(text, CANDIDATE, -1), codes, lambda g, c: F.array(g, F.coalesce(c, F.lit(""))))), "")
    found = found.withColumn("new", F.when(F.col("secrets").isNull(), text).otherwise(masked))
    new = {"text": F.col("new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("secrets").isNull(), F.col("row.n_chars")).otherwise(F.char_length("new").cast(docs.schema["n_chars"].dataType))
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
