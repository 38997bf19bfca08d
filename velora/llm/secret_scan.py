"""Secret scans with a false-positive filter (operator 3). DataFrame, SQL and Spark ML functions only.

Candidates are every run of 16 or more key characters with a letter or digit, and every
value of ``VALUE_LENGTH`` or more characters of any kind that is assigned to, or stands
behind, a credential's name. A random forest tells secrets from other candidates by length, mix of and changes
between character classes, how much of its letters dictionary words cover, path
marks of the word it stands in, and the words around it. It is trained from
labelled findings. Of the letter runs in findings, those count as dictionary words
that occur in at least ``TERM_SHARE`` of all different texts (``MIN_COUNT`` at least).

``weak_labels`` labels findings where a table of labelled ones is missing:
values of the fixed key formats below, or values assigned to a credential's
name. The forest is fitted on at most ``PER_LABEL`` findings of each label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velora.llm.common import bounded_sample, row_key, stored

MIN_LENGTH = 16
CANDIDATE = f"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}"
VALUE_LENGTH = 6
DICTIONARY_WORDS = 50_000
MIN_COUNT = 5
TERM_SHARE = 1e-5
PER_LABEL = 2000
TREES = 20
DEPTH = 6
SEED = 7
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
#: Fixed formats and names.
KNOWN_FORMATS = "^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[0-9A-Za-z]{36}$|^xox[abpr]-[0-9A-Za-z-]{10,}$|^sk-[0-9A-Za-z_-]{20,}$"
CREDENTIAL = "(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
#: A credential's name to its end ("api_key", "db-password2", but not "author"), and what may stand between it and its value.
#: The part behind ``_`` or ``-`` has up to ``NAME_TAIL`` characters: without a bound, one long word is read anew from every name in it.
NAME_TAIL = 64
NAME = CREDENTIAL + f"(?:orization|s|[_-]?key)?(?:[_-][A-Za-z0-9_-]{{0,{NAME_TAIL}}}|[0-9]+)?(?![A-Za-z])"
_QUOTE = "[\"'`]"
_ASSIGN = f"{_QUOTE}?\\]?(?:[:=]=?>?){_QUOTE}?"
ASSIGNED_IN_WORD = f"(?s){NAME}{_ASSIGN}(.{{{VALUE_LENGTH},}})$"
NAME_BEFORE = f"{NAME}{_QUOTE}?\\]?(?:[:=]=?>?)?{_QUOTE}?$"
BETWEEN = "(?i)^(?:[:=]+>?|is|was)$"
BENIGN = "(?i)(?:commit|sha[0-9]*|md5|hash|checksum|digest|uuid|guid|version|rev(?:ision)?|card|phone|isbn|order|invoice)"
FEATURES = [
    "length", "digits", "uppers", "lowers", "symbols", "distinct", "letter_digit", "case_change", "repeats", "hexadecimal",
    "coverage", "slashes", "url", "extension", "mail", "credential_near", "benign_near", "assigned", "quoted", "before_length",
    "previous_length", "next_length",
]


def findings(docs: DataFrame) -> DataFrame:
    """Candidates of every document: doc_id, place (word), nth (in the word), value, word, before, previous words, next word.

    Null texts have none; repeated rows give repeated findings.
    """
    words = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), _SPACE).alias("w"))
    w = F.col("w")

    def word(i: Column) -> Column:
        return F.coalesce(F.get(w, i), F.lit(""))

    def named(i: Column) -> Column:
        """Whether a credential's name stands before word i."""
        behind = word(i - 1).rlike(NAME_BEFORE) | (word(i - 1).rlike(BETWEEN) & word(i - 2).rlike(NAME_BEFORE))
        return (F.length(word(i)) >= VALUE_LENGTH) & behind

    at = F.filter(
        F.sequence(F.lit(0), F.size(w) - 1),
        lambda i: ((F.length(word(i)) >= MIN_LENGTH) & word(i).rlike(CANDIDATE)) | word(i).rlike(ASSIGNED_IN_WORD) | named(i),
    )
    near = F.transform(
        at,
        lambda i: F.struct(
            i.alias("place"),
            word(i).alias("word"),
            word(i - 1).alias("previous"),
            word(i - 2).alias("second"),
            word(i + 1).alias("next"),
            named(i).alias("named"),
        ),
    )
    found = words.select("doc_id", F.explode(near).alias("n")).select("doc_id", "n.*")
    inside = F.regexp_extract("word", ASSIGNED_IN_WORD, 1)
    value = F.when(inside != "", inside).when(F.col("named"), F.col("word")).otherwise("")
    value = F.rtrim(F.ltrim(value, F.lit("\"'`")), F.lit("\"'`,;."))
    runs = F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))
    own = F.when((F.length(value) >= VALUE_LENGTH) & ~F.array_contains(runs, value), F.array(value)).otherwise(F.array().cast("array<string>"))
    # runs keep their numbers in the word; an assigned value that is no run of its own comes after them
    found = found.select("*", F.size(runs).alias("runs"), F.posexplode(F.concat(runs, own)).alias("nth", "value")).drop("named")
    found = found.filter((F.col("nth") >= F.col("runs")) | F.col("value").rlike("[A-Za-z0-9]")).drop("runs")
    return found.withColumn("before", F.expr("substring_index(word, value, 1)"))


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """The most frequent lower-case words of 3 letters or more over all documents; at most ``words`` rows (ties by word)."""
    each = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("term"))
    counts = each.filter(F.length("term") >= 3).groupBy("term").count().filter(F.col("count") >= min_count)
    return counts.orderBy(F.desc("count"), "term").limit(words).select("term")


def letter_runs(value: Column) -> Column:
    return F.regexp_extract_all(F.lower(value), F.lit("[a-z]{3,}"), F.lit(0))


def finding_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The letter runs of ``found`` that are words: those of enough different texts of ``docs``, however many words there are."""
    runs = found.select(F.explode(letter_runs(F.col("value"))).alias("term")).distinct()
    texts = docs.filter("text is not null")
    least = texts.agg(F.greatest(F.lit(MIN_COUNT), F.ceil(F.countDistinct(F.xxhash64("text")) * F.lit(TERM_SHARE))).alias("n")).first()["n"]
    terms = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    each = texts.select(F.xxhash64("text").alias("h"), F.explode(terms).alias("term")).filter(F.length("term") >= 3)
    each = each.join(runs, "term").groupBy("term", "h").agg(F.lit(1).alias("one"))
    return each.groupBy("term").count().filter(F.col("count") >= least).select("term")


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def with_features(found: DataFrame, terms: DataFrame) -> DataFrame:
    """Adds ``FEATURES``. ``found`` has a row number ``uid``; ``terms``: the dictionary words."""
    parts = found.select("uid", F.explode(letter_runs(F.col("value"))).alias("term"))
    covered = parts.join(terms, "term").groupBy("uid").agg(F.sum(F.length("term")).alias("covered"))
    around = F.concat_ws(" ", "second", "previous", "before")
    letters = F.regexp_count("value", F.lit("[A-Za-z]"))
    out = found.join(covered, "uid", "left")
    values = {
        "length": F.length("value"),
        "digits": _share("[0-9]"),
        "uppers": _share("[A-Z]"),
        "lowers": _share("[a-z]"),
        "symbols": _share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "letter_digit": _share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "case_change": _share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "repeats": _share("(.)(?=\\1)"),
        "hexadecimal": F.col("value").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "coverage": F.when(letters > 0, F.coalesce("covered", F.lit(0)) / letters).otherwise(0.0),
        "slashes": F.regexp_count("word", F.lit("/")),
        "url": F.col("word").rlike("(?i)[a-z]://|^www\\."),
        "extension": F.col("word").rlike("\\.[a-z]{2,5}[\"'),;]*$"),
        "mail": F.col("word").contains("@"),
        "credential_near": around.rlike(CREDENTIAL),
        "benign_near": around.rlike(BENIGN),
        "assigned": F.col("before").rlike("[=:][\"']?$") | ((F.col("before").rlike("^[\"']?$")) & F.col("previous").rlike("[=:]$")),
        "quoted": F.col("before").rlike("[\"'`]$|&quot;$"),
        "before_length": F.length("before"),
        "previous_length": F.length("previous"),
        "next_length": F.length("next"),
    }
    return out.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()}).drop("covered")


def weak_labels(features: DataFrame) -> Column:
    """1.0 for values of a known key format or assigned to a credential's name, else 0.0."""
    known = F.col("value").rlike(KNOWN_FORMATS)
    return (known | ((F.col("assigned") == 1) & (F.col("credential_near") == 1))).cast("double")


@dataclass(frozen=True)
class SecretModel:
    """``forest`` is None where the findings are all of one label; ``share`` is then that label."""

    forest: RandomForestClassificationModel | None
    share: float

    def score(self, features: DataFrame) -> DataFrame:
        if self.forest is None:
            return features.withColumn("score", F.lit(self.share))
        seen = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(features)
        return self.forest.transform(seen).withColumn("score", vector_to_array("probability")[1]).select(*features.columns, "score")


def train(labelled: DataFrame, per_label: int = PER_LABEL) -> SecretModel:
    """Fits on findings with features and ``label`` (1.0 secret, 0.0 not); rows without a label are left out.

    Copies of a finding (value, word and neighbours) count once per label.
    """
    keyed = labelled.filter("label is not null").withColumn("__k", row_key("value", "word", "previous", "next"))
    keyed = keyed.groupBy("__k", "label").agg(F.min(F.struct(*FEATURES)).alias("f")).select("f.*", "label", "__k")
    few = bounded_sample(keyed, "label", "__k", per_label).orderBy("__k", *FEATURES).coalesce(1)
    few = stored(few.select(*FEATURES, "label"), "secret-sample")
    kinds = [r[0] for r in few.select("label").distinct().collect()]
    if len(kinds) < 2:
        return SecretModel(None, float(kinds[0]) if kinds else 0.0)
    rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(few)
    forest = RandomForestClassifier(
        featuresCol="__features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt"
    ).fit(rows)
    return SecretModel(forest, 0.0)


def prepared(docs: DataFrame) -> DataFrame:
    """All findings of ``docs`` with features, stored."""
    found = stored(findings(docs).withColumn("uid", F.monotonically_increasing_id()), "secret-findings")
    return stored(with_features(found, stored(finding_terms(docs, found), "secret-terms")), "secret-features")


def secret_report(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, place, nth, length, masked, value_sha256, score, is_secret.

    ``labelled``: findings with features and ``label``; by default those of ``docs`` under ``weak_labels``.
    The value itself is not returned: only its first quarter, at most four characters, and its digest.
    """
    seen = prepared(docs.select("doc_id", "text"))
    model = train(labelled if labelled is not None else seen.withColumn("label", weak_labels(seen)))
    return model.score(seen).select(
        "doc_id",
        "place",
        "nth",
        F.col("length").cast("int").alias("length"),
        F.concat(F.expr("left(value, least(4, length(value) div 4))"), F.lit("...")).alias("masked"),
        F.sha2("value", 256).alias("value_sha256"),
        "score",
        (F.col("score") >= 0.5).alias("is_secret"),
    )
