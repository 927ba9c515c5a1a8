"""Secret scan whose findings a random forest checks, with DataFrame functions only (pyspark.ml runs in the JVM).

Runs of key characters are candidates. A forest trained on labelled findings tells secrets from look-alikes by length, character
transitions, how much of the run dictionary words cover, the path, and the words beside it.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleyspark.llm.base import query, settle, table

#: The shape of a candidate, words beside a secret, words beside other identifiers, telling path parts, known key prefixes.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
NAMING = "password|passwd|pwd|secret|token|apikey|api_key|api-key|access_key|auth|credential|bearer|private_key"
OTHER_IDS = "commit|sha1|sha256|md5|checksum|hash|digest|uuid|guid|etag|revision|integrity|version"
TELLING_PATHS = "test|spec|example|sample|mock|fixture|vendor|node_modules|lock|doc"
KEY_PREFIX = "^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[baprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
FEATURES = ["f_length", "f_digits", "f_upper", "f_lower", "f_signs", "f_turns", "f_runs", "f_distinct", "f_hex", "f_prefix", "f_dictionary",
            "f_named", "f_other_id", "f_assigned", "f_quoted", "f_path_depth", "f_path_telling"]
BESIDE = 48


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """doc_id, path, nth (place among the candidates of the text), value, before, after: one row for each candidate of each text."""
    text = F.col("text").cast("string")
    values, gaps = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    rows = docs.select("doc_id", path.cast("string").alias("path"), values.alias("values"), gaps.alias("gaps")).filter(F.size("values") > 0)
    rows = rows.select("doc_id", "path", "gaps", F.posexplode("values").alias("nth", "value"))
    return rows.select("doc_id", "path", "nth", "value", F.right(F.get("gaps", F.col("nth")), F.lit(BESIDE)).alias("before"), F.left(F.get("gaps", F.col("nth") + 1), F.lit(BESIDE)).alias("after"))


def dictionary(docs: DataFrame, most: int = 400, shortest: int = 3) -> list[str]:
    """The ``most`` lower-case words that occur in most texts, of all texts."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.col("text").cast("string")), r"[^a-z]+"), lambda w: F.length(w).between(shortest, 12)))
    return [r.word for r in docs.select(F.explode(words).alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word").head(most)]


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """Candidates with the features. Null path and missing neighbours count as empty."""
    v, size = F.col("value"), F.length("value")
    left = lambda pattern: size - F.length(F.regexp_replace(v, pattern, ""))
    beside = F.lower(F.coalesce("before", F.lit("")))
    path = F.lower(F.coalesce("path", F.lit("")))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.translate(v, "0123456789", "1" * 10), "[A-Z]", "A"), "[a-z]", "a"), "[^A1a]", "-")
    runs = F.regexp_replace(kinds, r"(.)\1+", "$1")
    covered = F.regexp_replace(F.lower(v), "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)", "")
    chars = F.array_distinct(F.filter(F.split(v, ""), lambda c: c != ""))
    named = {
        "f_length": size, "f_digits": left("[0-9]") / size, "f_upper": left("[A-Z]") / size, "f_lower": left("[a-z]") / size, "f_signs": left("[^A-Za-z0-9]") / size,
        "f_turns": (F.length(runs) - 1) / size, "f_runs": size / F.length(runs), "f_distinct": F.size(chars) / F.least(size, F.lit(36)),
        "f_hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"), "f_prefix": v.rlike(KEY_PREFIX).cast("int"), "f_dictionary": 1 - F.length(covered) / size,
        "f_named": beside.rlike(rf"(?:{NAMING})\W{{0,12}}\w{{0,12}}\W{{0,6}}$").cast("int"), "f_other_id": beside.rlike(rf"(?:{OTHER_IDS})\W{{0,12}}$").cast("int"),
        "f_assigned": beside.rlike(r"[:=]\s*[\"'`]?$").cast("int"), "f_quoted": (beside.rlike("[\"'`]$") & F.coalesce("after", F.lit("")).rlike("^[\"'`]")).cast("int"),
        "f_path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))), "f_path_telling": path.rlike(TELLING_PATHS).cast("int"),
    }
    return found.withColumns({n: c.cast("double") for n, c in named.items()})


def train(labelled: DataFrame, words: list[str], most: int = 20_000, trees: int = 24, depth: int = 7) -> RandomForestClassificationModel | None:
    """A forest from labelled findings (columns of ``candidates`` and ``label`` 0 or 1); None where one of the labels is missing.

    At most ``most`` of each label are used, the same ones each time, in one order, so that the forest is the same on every cluster. Classes weigh
    alike.
    """
    sound = labelled.filter("label in (0, 1) and value is not null")
    both = [sound.filter(F.col("label") == k).orderBy(F.xxhash64("value", "before"), "value", "before").limit(most) for k in (0, 1)]
    held = settle(described(both[0].union(both[1]), words).coalesce(1))
    sizes = {r.label: r["count"] for r in held.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return None
    weight = F.when(F.col("label") == 1, max(sizes.values()) / sizes[1]).otherwise(max(sizes.values()) / sizes[0])
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(held.withColumn("weight", weight).withColumn("label", F.col("label").cast("double")))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, weightCol="weight", featureSubsetStrategy="sqrt").fit(rows.select("features", "label", "weight").coalesce(1))


def judged(found: DataFrame, words: list[str], model: RandomForestClassificationModel | None) -> DataFrame:
    """Candidates with ``probability`` of being a secret; 1 without a model, so that no finding is lost."""
    if model is None:
        return found.withColumn("probability", F.lit(1.0))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(found, words))
    return model.transform(rows).select(*found.columns, vector_to_array("probability")[1].alias("probability"))


def known_findings(found: DataFrame) -> DataFrame:
    """Findings whose label is certain without the forest: keys of a known prefix and mixed runs in a named assignment are secrets, runs of
    one letter case with no digit, and identifiers named as such, are not. All others have no label and are left out."""
    beside = F.lower(F.coalesce("before", F.lit("")))
    value = F.col("value")
    secret = value.rlike(KEY_PREFIX) | (value.rlike("[0-9]") & value.rlike("[A-Za-z]") & beside.rlike(rf"(?:{NAMING})\s*[:=]\s*[\"'`]?$"))
    other = value.rlike("^[A-Za-z]?[a-z]+$|^[A-Z]+$|^[-_=+/]+$|^[0-9]+$") | beside.rlike(rf"(?:{OTHER_IDS})\W{{0,12}}$")
    return found.withColumn("label", F.when(secret & ~other, 1).when(other & ~secret, 0)).filter("label is not null")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str | None = None, level: float = 0.5) -> DataFrame:
    """doc_id, path, nth, value, before, after, probability: the candidates of ``docs(doc_id, text)`` that the forest holds for secrets.

    ``labelled``: findings with a label; without them, those of the corpus whose label is certain. Null and empty texts, and tables without
    a candidate, give no row. Repeated rows give their findings repeatedly. A null doc_id stays null. Other columns are not read.
    """
    column = F.col(path) if path else F.lit(None)
    found = settle(candidates(docs, column))
    words = dictionary(docs)
    model = train(known_findings(found) if labelled is None else labelled, words)
    return judged(found, words, model).filter(F.col("probability") >= level)


@query("op1_secret_forest")
def op1_secret_forest(spark, folder) -> DataFrame:
    """Secrets of all documents; their source is the path."""
    return scan_secrets(table(spark, folder, "documents").select("doc_id", "text", "source"), path="source")
