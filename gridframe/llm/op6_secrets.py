"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything is DataFrame expressions and the JVM's forest; no Python runs on the
executors.  A candidate is any run of at least 16 key characters with a digit,
however many a white-space separated word holds.  Its features: length, shares of
character kinds, transitions between kinds, share of distinct characters, how much of
it dictionary words cover, signs of a path or address in the whole word, and the
words around it; those of the word are found once for all its candidates.  The
forest is trained from labelled findings; by default from ``labelled``, a table
that expressions generate alike everywhere.

Defined results: a null or empty text has no candidates, as has one without long
runs; repeated rows give repeated findings; runs do not overlap, and equal ones of
a word are as many candidates; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 16
RUN = r"(?=[A-Za-z+/_=.-]*[0-9])[A-Za-z0-9+/_=.-]{16,}"
WORDS = "example test sample dummy your secret token key user name file path lib usr home http https www com org index page version release build node module package data value config id commit hash sum the this that and for with from not".split()
TRUST = "token|secret|password|passwd|pwd|key|apikey|api_key|access|auth|bearer|credential"
DOUBT = "commit|sha|sha1|sha256|md5|checksum|hash|digest|uuid|guid|card|phone|version|isbn|order|build|revision|file|path|url"
FEATURES = ("length", "digits", "upper", "lower", "hexes", "signs", "turns", "case_turns", "vowel_turns", "distinct", "covered", "path", "address", "dashes", "longest", "trust", "doubt", "assigned", "quoted")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _filled(found: DataFrame, new: dict[str, Column]) -> DataFrame:
    return found.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in new.items()})


def around(found: DataFrame) -> DataFrame:
    """Those of FEATURES that a word's candidates have in common, from ``word``, ``before2`` and ``before1``."""
    w = F.col("word")
    near = F.lower(F.concat_ws(" ", "before2", "before1", F.regexp_replace(w, RUN, " ")))
    new = {
        "path": F.when(w.rlike(r"^\.{0,2}/|[A-Za-z0-9_-]+/[A-Za-z0-9_.-]+/|\.[a-z]{2,4}$"), 1.0).otherwise(0.0), "address": F.when(F.lower(w).rlike("https?:|www[.]|@"), 1.0).otherwise(0.0),
        "trust": F.when(near.rlike(rf"(^|[^a-z])({TRUST})([^a-z]|$)"), 1.0).otherwise(0.0), "doubt": F.when(near.rlike(rf"(^|[^a-z])({DOUBT})([^a-z]|$)"), 1.0).otherwise(0.0),
        "assigned": F.when(F.concat_ws(" ", "before1", w).rlike("[=:]"), 1.0).otherwise(0.0), "quoted": F.when(w.rlike("[\"'`]"), 1.0).otherwise(0.0),
    }
    return _filled(found, new)


def inside(found: DataFrame) -> DataFrame:
    """Those of FEATURES that ``candidate`` alone gives."""
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    low = F.lower(c)
    new = {
        "length": F.length(c).cast("double"), "digits": _count(c, "[0-9]") / n, "upper": _count(c, "[A-Z]") / n, "lower": _count(c, "[a-z]") / n, "hexes": _count(c, "[0-9a-fA-F]") / n, "signs": _count(c, "[^0-9A-Za-z]") / n,
        "turns": _count(c, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])") / n, "case_turns": _count(c, "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / n, "vowel_turns": _count(low, "(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])") / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)), "covered": (n - F.length(F.regexp_replace(low, "|".join(sorted(WORDS, key=len, reverse=True)), ""))) / n,
        "dashes": _count(c, "-"), "longest": F.array_max(F.transform(F.regexp_extract_all(F.concat(c, F.lit(" a")), F.lit("([A-Za-z]+)")), F.length)).cast("double"),
    }
    return _filled(found, new)


def features(found: DataFrame) -> DataFrame:
    """FEATURES of rows with ``candidate``, ``word``, ``before2`` and ``before1``."""
    return inside(around(found))


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, start, candidate) and what :func:`around` gives; start counts code points from 0."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(RUN))
    rows = rows.withColumn("words", F.split("text", r"\s"))
    # word and runs of each place; a word's start is the sum of what stands before it, one sign between words
    runs = F.transform("words", lambda w: F.when(F.length(w) >= LEAST, F.regexp_extract_all(w, F.lit(RUN), F.lit(0))))
    found = rows.select("doc_id", "words", F.posexplode(runs).alias("i", "runs")).where("size(runs) > 0")
    word = lambda k: F.get("words", F.col("i") + k)
    before = F.when(F.col("i") == 0, 0).otherwise(F.length(F.array_join(F.slice("words", 1, F.col("i")), " ")) + 1)
    # a run's start is the end of the run before and what stands between them; there is one piece more than runs
    steps = F.zip_with(F.slice(F.split(word(0), RUN, -1), F.lit(1), F.size("runs")), "runs", lambda gap, run: F.struct(F.length(gap).alias("gap"), F.length(run).alias("n")))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(steps, none, lambda x, s: F.struct((x["end"] + s["gap"] + s["n"]).alias("end"), F.array_append(x["starts"], x["end"] + s["gap"]).alias("starts")))["starts"]
    words = around(found.select("doc_id", before.alias("before"), F.arrays_zip(starts.alias("start"), F.col("runs").alias("run")).alias("at"), word(0).alias("word"), word(-2).alias("before2"), word(-1).alias("before1")))
    each = words.drop("word", "before2", "before1").withColumn("at", F.explode("at"))
    return each.select("doc_id", (F.col("before") + F.col("at.start")).cast("long").alias("start"), F.col("at.run").alias("candidate"), *(c for c in FEATURES if c in each.columns))


def labelled(spark: SparkSession, n: int = 2400) -> DataFrame:
    """Generated findings with ``label`` 1 for secrets: keys of several forms, and look-alikes with their usual surroundings."""
    rows = spark.range(0, n, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256).alias("y"))
    b64 = F.regexp_replace(F.base64(F.unhex("x")), "[^A-Za-z0-9+/]", "")
    digits = F.translate("x", "abcdef", "012345")
    name = F.translate(F.substring("y", 1, 14), "0123456789", "aeioulnrst")
    pick = lambda *options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64("y"), F.lit(len(options))) + 1).cast("int"))
    part = lambda col, a, k: F.substring(col, a, k)
    uuid = F.concat_ws("-", part("x", 1, 8), part("x", 9, 4), part("x", 13, 4), part("x", 17, 4), part("x", 21, 12))
    forms: list[tuple[Column, Column, Column, int]] = [
        (part("x", 1, 40), pick("token", "secret", "key", "api_key"), pick("=", ":", "is"), 1), (part("x", 1, 32), pick("password", "apikey", "auth", "secret"), pick("=", ":"), 1), (F.concat(F.lit("AKIA"), F.upper(part(b64, 1, 16)), F.lit("7")), pick("access", "the", "of", "und", "de"), pick("key", "="), 1),
        (part(b64, 1, 40), pick("secret", "key", "bearer", "la"), pick("=", ":", "that"), 1), (F.concat(F.lit("ghp_"), part(b64, 1, 35), F.lit("3")), pick("the", "token", "on"), pick("=", "in", "und"), 1), (F.concat(F.lit("sk_live_"), part("x", 1, 24)), pick("the", "stripe", "con"), pick("key", "="), 1), (part("x", 1, 40), pick("the", "of", "que"), pick("token", "in", "the"), 1),
        (part("x", 1, 40), pick("commit", "at", "revision"), pick("commit", "sha1", "sha"), 0), (F.col("x"), pick("file", "of", "checksum"), pick("sha256", "digest", "hash"), 0), (part("x", 1, 32), pick("the", "uuid", "sum"), pick("md5", "checksum", "hash"), 0), (uuid, pick("id", "the", "with"), pick("uuid", "guid", "id", "of"), 0), (part(digits, 1, 16), pick("the", "la", "ein", "card"), pick("number", "to", "und", "of"), 0),
        (F.concat(F.lit("/usr/lib/"), name, F.lit("/v2/index.js")), pick("the", "file"), pick("in", "path", "at"), 0), (F.concat(F.lit("https/www.example.com/"), name, part(digits, 1, 3)), pick("see", "the"), pick("at", "url"), 0), (F.concat(name, part("y", 3, 4), name, F.lit("2")), pick("the", "de", "for"), pick("of", "la", "and"), 0), (F.concat(F.lit("example-test-token-"), part(digits, 1, 3)), pick("your", "the"), pick("token", "key", "="), 0), (F.concat(F.repeat(part(digits, 1, 1), 20)), pick("the", "key"), pick("=", "of"), 0), (F.concat(F.lit("2024-01-0"), part(digits, 1, 1), F.lit("T00.00.00.0000")), pick("on", "at"), pick("date", "since"), 0),
    ]
    at = F.pmod("id", F.lit(len(forms)))

    def chosen(k: int, default: Column) -> Column:
        out = default
        for j, form in enumerate(forms):
            out = F.when(at == j, form[k] if isinstance(form[k], Column) else F.lit(form[k])).otherwise(out)
        return out

    quote = F.when(F.pmod(F.xxhash64("x"), F.lit(3)) == 0, F.lit("")).otherwise(F.lit('"'))
    return rows.select(chosen(0, F.lit("")).alias("candidate"), chosen(1, F.lit("")).alias("before2"), chosen(2, F.lit("")).alias("before1"), F.lit("the").alias("after1"), chosen(3, F.lit(0)).cast("double").alias("label"), "x").withColumn("word", F.when(F.col("label") == 1, F.concat(quote, "candidate", quote)).otherwise(F.col("candidate"))).drop("x")


def forest(findings: DataFrame, trees: int = 24, depth: int = 7):
    """The fitted forest, over a vector column ``x`` of FEATURES."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(findings)).select("x", "label")
    return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, maxBins=32, seed=7).fit(x)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, candidate, score, is_secret) of every candidate; those that the forest rejects have ``is_secret`` false."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    model = forest(labelled(docs.sparkSession) if findings is None else findings)
    found = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(inside(candidates(docs, doc_id, text)))
    score = vector_to_array("probability")[1]
    return model.transform(found).select("doc_id", "start", "candidate", score.alias("score"), (score >= 0.5).alias("is_secret"))
