"""Secret findings with a random forest that removes false positives (operator 10). Native expressions only.

A word can have several candidates: every value assigned to a secret's name and every published key format, of any length, and
the word and its parts between separators, freed of an assignment and of marks, of at least 16 characters with a digit,
a capital behind a small letter or twelve capitals in a row. A candidate's features are its length, transitions between character classes, coverage by words that
are frequent in the documents, shape as a path, and its neighbouring words. A random forest learns from labelled findings which candidates are secrets.

Where no reviewed findings exist, :func:`seed_labels` labels the few kinds that are certain: published key formats and
hexadecimal values behind a secret's name are secrets; addresses, plain numbers and dictionary words without such a name are none. All between, such as other
values of a secret's name, bare codes and paths, has no label. The forest doesn't see whether a format matched, and learns from four documents in five,
so that it can be held against the labels of the fifth (:func:`agreement`).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyspark.llm.common import id_crc, words
from storyspark.session import stage

LEAST = 16
#: Names to which secrets are assigned, and published formats of keys.
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key")
FORMATS = (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[0-9A-Za-z]{36}", r"sk_live_[0-9A-Za-z]{16,}", r"xox[abp]-[0-9A-Za-z-]{10,}", r"AIza[0-9A-Za-z_-]{35}")
_NAMED = "(?i)(" + "|".join(NAMES) + r")[\"']?$"
_ASSIGN = r"^[\w.\-\"']*[=:]+"
_FORMAT = "(?:" + "|".join(FORMATS) + ")"
#: Where another assignment begins within a word.
_NEXT = r"[&;,|?{}]+(?=[\"'\[\\]*[\w.\-]++\\?[\"']?[=:])"
#: A secret's name and the value up to the end of the part, or to the closing quote.
_NAMED_VALUE = "(?i)(?:" + "|".join(NAMES) + r")\\?[\"']?[=:]+>?(\S++)"
_MARKS = r"^[^0-9A-Za-z+/_-]+|[^0-9A-Za-z=+/_-]+$"
#: Row features, in the order of the forest's inputs.
FEATURES = (
    "length",
    "digit_share",
    "upper_share",
    "mark_share",
    "transitions",
    "hex_share",
    "distinct_share",
    "dictionary_share",
    "slashes",
    "dots",
    "looks_like_path",
    "named_before",
    "assigned",
    "quoted",
    "word_before_length",
    "word_after_length",
)


def dictionary(texts: DataFrame, least: int = 20) -> DataFrame:
    """``part``: the words of 3 to 20 letters that occur at least ``least`` times in ``texts (text)``, small."""
    found = texts.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")).alias("part"))
    return found.filter(F.length("part").between(3, 20)).groupBy("part").agg(F.count("*").alias("times")).filter(F.col("times") >= least).select("part")


def _covered(found: DataFrame, known: DataFrame) -> DataFrame:
    """``candidate, covered``: how many characters of each candidate belong to parts, cut at marks, digits and changes of case, that the dictionary has."""
    parts = F.transform(F.regexp_extract_all("candidate", F.lit(r"\p{Lu}?\p{Ll}{2,}|\p{Lu}{3,}"), 0), F.lower)
    spread = found.select("candidate").distinct().select("candidate", F.explode(parts).alias("part"))
    return spread.join(known, "part").groupBy("candidate").agg(F.sum(F.length("part")).alias("covered"))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, position, candidate``, the columns of :data:`FEATURES`, ``given`` and ``known_prefix``, one row per candidate of every whole text.

    ``known`` is a :func:`dictionary`. ``position`` counts words from 0. Null and empty texts have no candidates; repeated rows have theirs each, also where their
    ids are equal or null. Of ``docs`` only ``doc_id`` and ``text`` are used. A long text is one list of words, in proportion to its length.
    """
    listed = docs.select("doc_id", words(F.col("text")).alias("words"))
    spread = listed.select("doc_id", "words", F.posexplode("words").alias("position", "word"))
    spread = spread.select(
        "doc_id",
        "position",
        "word",
        F.coalesce(F.get("words", F.col("position") - 1), F.lit("")).alias("before"),
        F.coalesce(F.get("words", F.col("position") - 2), F.lit("")).alias("two_before"),
        F.coalesce(F.get("words", F.col("position") + 1), F.lit("")).alias("after"),
    )
    lone = F.col("before").isin("=", ":", ":=", "=>")
    named_word = (F.col("before").rlike("[=:]$") & F.regexp_replace("before", r"[=:]+$", "").rlike(_NAMED)) | (lone & F.col("two_before").rlike(_NAMED)) | (F.col("before").startswith("-") & F.col("before").rlike(_NAMED))
    named_word = named_word & ~F.col("word").isin("=", ":", ":=", "=>")
    least = lambda c: (F.length(c) >= LEAST) & c.rlike(r"[0-9]|[a-z][A-Z]|[A-Z]{12}")
    spread = spread.withColumn("named_word", named_word).filter(F.col("named_word") | least(F.col("word")) | F.col("word").rlike(_NAMED_VALUE) | F.col("word").rlike(_FORMAT))
    trimmed = lambda c: F.regexp_replace(F.regexp_replace(c, _ASSIGN, ""), _MARKS, "")
    # A quoted value is what stands between the quotes, another loses the marks that end a sentence or a list.
    value = lambda c: F.when(c.rlike("^\\\\?[\"']"), F.regexp_extract(c, "^\\\\?[\"']([^\"'\\\\]*)", 1)).otherwise(F.regexp_replace(c, r"^[(\[{<`]+|[\"'\\`,;.:)}\]>]+$", ""))
    parts = F.split("word", _NEXT)
    named = F.flatten(F.transform(parts, lambda p: F.transform(F.regexp_extract_all(p, F.lit(_NAMED_VALUE), 1), value)))
    named = F.filter(F.concat(named, F.when(F.col("named_word"), F.array(value(F.col("word")))).otherwise(F.array().cast("array<string>"))), lambda c: c != "")
    formats = F.regexp_extract_all("word", F.lit(_FORMAT), 0)
    pieces = F.flatten(F.transform(parts, lambda p: F.concat(F.array(p), F.split(p, r"[,;|&?\"'<>(){}\[\]`]+"))))
    others = F.filter(F.transform(F.concat(F.array("word"), pieces), trimmed), least)
    spans = spread.withColumn("named", F.array_distinct(named)).withColumn("others", F.concat(formats, others))
    spans = spans.withColumn("others", F.array_except("others", "named"))
    given = lambda k, v: F.transform(k, lambda c: F.struct(c.alias("candidate"), F.lit(v).alias("given")))
    pairs = F.concat(given("named", True), given("others", False))
    found = spans.select("doc_id", "position", "word", "before", "two_before", "after", F.inline(pairs))
    # A staged table: filters on costly expressions would otherwise be made again for every feature.
    found = stage(found, "secret-candidates")
    found = found.join(_covered(found, known), "candidate", "left")
    c = F.col("candidate")
    length = F.length(c)
    share = lambda kind: F.regexp_count(c, F.lit(kind)) / length
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z]", "-"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    runs = F.regexp_count(classes, F.lit("a+|B+|0+|-+"))
    prefix = F.when(trimmed(F.col("word")) == c, F.regexp_extract("word", _ASSIGN, 0)).otherwise("")
    behind = lambda *marks: F.greatest(*(F.contains("word", F.concat(F.lit(m), c)) for m in marks))
    features = {
        "length": F.least(length, F.lit(200)),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "mark_share": share("[^0-9A-Za-z]"),
        "transitions": (runs - 1) / length,
        "hex_share": share("[0-9a-fA-F]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / length,
        "dictionary_share": F.coalesce("covered", F.lit(0)) / length,
        "slashes": F.regexp_count(c, F.lit("/")),
        "dots": F.regexp_count(c, F.lit("[.]")),
        "looks_like_path": c.rlike(r"^(?:https?:|www\.|[./~\\])|[/\\].*[/\\]|@").cast("int"),
        "named_before": (
            F.col("given") | F.regexp_replace(prefix, r"[=:]+$", "").rlike(_NAMED) | F.col("before").rlike(_NAMED) | F.regexp_replace("before", r"[=:]+$", "").rlike(_NAMED) | (lone & F.col("two_before").rlike(_NAMED))
        ).cast("int"),
        "assigned": (F.col("given") | (prefix != "") | lone | F.col("before").rlike("[=:]$") | behind("=", ":", '="', ':"', "='", ":'")).cast("int"),
        "quoted": (F.regexp_replace("word", _ASSIGN, "").rlike("^[\"']") | behind('"', "'")).cast("int"),
        "word_before_length": F.least(F.length("before"), F.lit(40)),
        "word_after_length": F.least(F.length("after"), F.lit(40)),
    }
    known_prefix = c.rlike("^" + _FORMAT + "$").alias("known_prefix")
    measured = found.select("doc_id", "position", "candidate", "given", known_prefix, *(F.coalesce(features[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES))
    return stage(measured, "secret-features")


def seed_labels(found: DataFrame) -> DataFrame:
    """The candidates of certain kinds with ``label``: 1 secret, 0 none."""
    c = F.col("candidate")
    named = F.col("named_before") == 1
    code = c.rlike("^[0-9a-fA-F]{16,}$") & c.rlike("[0-9]") & c.rlike("[a-fA-F]")
    none = c.rlike(r"^(?:https?:|www\.)|@") | c.rlike("^[0-9.,:/-]+$") | (F.col("dictionary_share") >= 0.8)
    return found.withColumn("label", F.when(F.col("known_prefix") | (named & code), 1).when(~named & none, 0)).filter("label is not null")


def learns(doc_id: Column) -> Column:
    """Whether seed labels of a document are learned from; those of one in five are held out."""
    return id_crc(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 != 0


def agreement(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``label, held_out, n, agrees`` per kind of seed label, none included: how many candidates, and for how many the forest says the same."""
    labelled = seed_labels(found).select("doc_id", "position", "candidate", "label").distinct()
    scored = (found.withColumn("score", F.lit(0.5)) if model is None else model.transform(found).withColumn("score", vector_to_array("probability")[1])).join(
        labelled, ["doc_id", "position", "candidate"], "left"
    )
    return scored.groupBy("label", (~learns(F.col("doc_id"))).alias("held_out")).agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 0.5).cast("int") == F.col("label")).alias("agrees"))


def train(labelled: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 5) -> PipelineModel | None:
    """A random forest from at most ``max_rows`` labelled findings, by hash; None without findings of both labels.

    Half of the bound goes to each label, so that a rare one isn't crowded out.
    """
    ordered = [labelled.filter(F.col("label") == v).orderBy(F.xxhash64("candidate"), "doc_id", "position").limit(max_rows // 2) for v in (0, 1)]
    sample = stage(ordered[0].unionByName(ordered[1]).select("label", *FEATURES).coalesce(1), "secret-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label", featureSubsetStrategy="sqrt")
    return PipelineModel([assembler, forest.fit(assembler.transform(sample))])


def judge(found: DataFrame, model: PipelineModel | None) -> DataFrame:
    """``doc_id, position, length, candidate_sha256, score, is_secret`` of every candidate; secrets are not repeated in clear.

    Without a model every candidate keeps the score 0.5 and counts as a finding, as no false positive is known.
    """
    if model is None:
        scored = found.withColumn("score", F.lit(0.5))
    else:
        scored = model.transform(found).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select(
        "doc_id", "position", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "score", (F.col("score") >= 0.5).cast("int").alias("is_secret")
    )


def find_secrets(docs: DataFrame, dictionary_texts: DataFrame | None = None, labelled: DataFrame | None = None, max_rows: int = 20_000) -> DataFrame:
    """Candidates of ``docs (doc_id, text)`` judged by a forest.

    Dictionary words are counted over ``dictionary_texts (text)``, by default all of ``docs``. ``labelled`` has reviewed findings, ``(doc_id, position, label)``, with ``candidate_sha256`` where a word has several; without it the seed labels are used. An empty table
    gives no rows.
    """
    found = candidates(docs, dictionary(docs if dictionary_texts is None else dictionary_texts))
    if labelled is None:
        known = seed_labels(found).filter(learns(F.col("doc_id")))
    else:
        keys = ["doc_id", "position", *(k for k in ("candidate_sha256",) if k in labelled.columns)]
        reviewed = labelled.select(*keys, "label").filter("label is not null").groupBy(*keys).agg(F.max("label").alias("label"))
        known = found.withColumn("candidate_sha256", F.sha2("candidate", 256)).join(reviewed, keys)
    return judge(found, train(known, max_rows))
