"""Quality classifier by co-training of two views.

One view is the content (which words a text holds), the other what is known about the page
without reading it: language, source, length, lines, shares of character kinds and of distinct
words.  Each view has a logistic regression.  In each round both are fitted, and where one is
confident about a document without a label, the other gets that as a label in the next round.
At the end each view is calibrated by Platt scaling on labelled documents that neither has seen,
a logistic regression of the two calibrated scores combines them, and all documents are scored.

A document is accepted if its quality is 1 and it isn't toxic.  Of labelled documents the fit takes
a bounded sample, those with the smallest hashes of their ids: at most ``LABELLED``; their ids are
broadcast.  Everything else covers all documents: each round scores all that have no label, and the
next regressions are fitted on all of those that are confident.

Defined cases: without both kinds of labels there is nothing to learn, all scores are NULL and
every document is kept; a label row with a NULL is no label, and of several for a document the worst
counts; a NULL text is empty; NULL language or source is a kind of its own; repeated rows are
scored as often as they occur; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitcal.session import stage

LABELLED = 20_000
VOCABULARY = 20_000
MIN_DOCUMENTS = 4  # of the sample that hold a word of the vocabulary
ROUNDS = 2
CONFIDENT = 0.98
ACCEPT = 0.5
HASHED = 256
MARKS = "!\"#$%&'()*+-/<=>?@[]^_`{|}~"
DIGITS = "0123456789"
NUMBERS = ("log_chars", "log_words", "log_lines", "word_length", "marks", "digits", "capitals", "distinct", "line_words")


def views(docs: DataFrame) -> DataFrame:
    """Add the words of the content view and the columns of the page view; drops the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spaced = F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))
    n = F.greatest(F.length("raw"), F.lit(1))

    def share(column: Column) -> Column:
        return (column / n).cast("double")

    def kind(name: str) -> Column:
        value = F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")
        return F.coalesce(value, F.lit("none"))

    numbers = {
        "log_chars": F.log1p(F.length("raw").cast("double")),
        "log_words": F.log1p(F.size("all_words").cast("double")),
        "log_lines": F.log1p(F.length("raw") - F.length(F.translate("raw", "\n", "")).cast("double")),
        "word_length": (F.length("raw") / F.greatest(F.size("all_words"), F.lit(1))).cast("double"),
        "marks": share(n - F.length(F.translate("raw", MARKS, ""))),
        "digits": share(n - F.length(F.translate("raw", DIGITS, ""))),
        "capitals": share(F.length("raw") - F.length(F.regexp_replace("raw", r"\p{Lu}", ""))),
        "distinct": (F.size("words") / F.greatest(F.size("all_words"), F.lit(1))).cast("double"),
        "line_words": F.log1p((F.size("all_words") / (F.length("raw") - F.length(F.translate("raw", "\n", "")) + 1)).cast("double")),
    }
    return (
        docs.withColumn("raw", text)
        .withColumn("all_words", F.split(F.trim(spaced), " "))
        .withColumn("words", F.array_distinct("all_words"))
        .withColumns({**numbers, "page_lang": kind("lang"), "page_source": kind("source")})
        .drop("raw", "all_words", "text")
    )


@dataclass
class CoTrained:
    """Fitted views and their calibration: p = logistic(bias + sum(weight * calibrated logit))."""

    vocabulary: CountVectorizerModel
    hasher: FeatureHasher
    content: LogisticRegressionModel
    page: LogisticRegressionModel
    platt: dict[str, tuple[float, float]]
    combined: tuple[float, float, float]


def needed(docs: DataFrame) -> DataFrame:
    """The columns that are read; others may have any names."""
    return docs.select(*[c for c in ("doc_id", "text", "lang", "source") if c in docs.columns])


def labels_of(labels: DataFrame) -> DataFrame:
    """(doc_id, accept) with accept 1.0 for quality 1 and not toxic."""
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("double")
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(good).alias("accept")).filter("accept is not null")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents to fit on, with ``accept`` and ``part`` (0 is for calibration)."""
    known = labels_of(labels)
    order = F.xxhash64("doc_id")
    ids = docs.select("doc_id").distinct()
    chosen = stage(known.join(ids, "doc_id").orderBy(order, "doc_id").limit(LABELLED).select("doc_id", "accept"))
    # at most LABELLED rows
    picked = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return picked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5)))


def with_known(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``labelled``: NULL for the rows of documents without label, those without id among them."""
    return rows.join(labels_of(labels).select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")


def logistic(features: str, label: str, strength: float) -> LogisticRegression:
    return LogisticRegression(
        featuresCol=features, labelCol=label, regParam=strength, maxIter=60, probabilityCol="p_" + features,
        rawPredictionCol="raw_" + features, predictionCol="said_" + features,
    )


def logit(features: str) -> Column:
    return vector_to_array("raw_" + features)[1]


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """Co-train; None without both kinds of labels to learn and to calibrate from."""
    got = trained(docs, labels)
    return got and got[0]


def trained(docs: DataFrame, labels: DataFrame, row_id: Column | None = None) -> tuple[CoTrained, DataFrame] | None:
    """The fitted views, and both views' features of every row under its ``row_id`` (the document's id if not given).

    The features are made and staged once: the rounds learn from those without label, and all are scored.
    """
    every = docs.select(*needed(docs).columns, (F.col("doc_id") if row_id is None else row_id).alias("row_id"))
    docs = needed(docs)
    rows = stage(views(sample(docs, labels)))
    kinds = rows.agg(
        *[F.count_distinct(F.when(c, F.col("accept"))).alias(a) for a, c in (("fit", F.col("part") > 0), ("calibrate", F.col("part") == 0))]
    ).first()
    if min(kinds) < 2:
        return None
    train = F.col("part") > 0
    vocabulary = CountVectorizer(
        inputCol="words", outputCol="content", binary=True, vocabSize=VOCABULARY, minDF=float(MIN_DOCUMENTS)
    ).fit(rows.filter(train))
    hasher = FeatureHasher(inputCols=[*NUMBERS, "page_lang", "page_source"], outputCol="page", numFeatures=HASHED)

    def features(of: DataFrame, *more: str) -> DataFrame:
        return hasher.transform(vocabulary.transform(of)).select("content", "page", *more)

    rows = stage(features(rows, "accept", "part"))
    # joined when the texts are features: these are what the exchange holds
    every = stage(with_known(features(views(every), "doc_id", "row_id"), labels).drop("doc_id"))
    unlabelled = every.filter("labelled is null")
    own = rows.filter(train)
    models: dict[str, LogisticRegressionModel] = {}
    for _ in range(ROUNDS + 1):
        taught = {}
        for view, other in (("content", "page"), ("page", "content")):
            taught[view] = own.select(view, "accept")
            if models:
                # what the other view is sure of
                p = vector_to_array(f"p_{other}")[1]
                sure = F.when(p >= CONFIDENT, 1.0).when(p <= 1 - CONFIDENT, 0.0)
                said = models[other].transform(unlabelled).select(view, sure.alias("accept")).filter("accept is not null")
                taught[view] = taught[view].unionByName(said)
        models = {
            view: logistic(view, "accept", strength).fit(taught[view])
            for view, strength in (("content", 0.002), ("page", 0.001))
        }
    held_out = rows.filter(F.col("part") == 0)
    for model in models.values():
        held_out = model.transform(held_out)
    held_out = stage(held_out.select("accept", logit("content").alias("content"), logit("page").alias("page")))
    platt = {}
    for view in ("content", "page"):
        got = logistic("v", "accept", 1e-4).fit(VectorAssembler(inputCols=[view], outputCol="v").transform(held_out))
        platt[view] = (got.intercept, float(got.coefficients[0]))
    calibrated = held_out.withColumns({v: a + b * F.col(v) for v, (a, b) in platt.items()})
    got = logistic("v", "accept", 1e-4).fit(
        VectorAssembler(inputCols=["content", "page"], outputCol="v").transform(calibrated)
    )
    return CoTrained(
        vocabulary, hasher, models["content"], models["page"], platt, (got.intercept, *map(float, got.coefficients))
    ), every


def score(docs: DataFrame, fitted: CoTrained | None) -> DataFrame:
    """(doc_id, content_score, page_score, score, kept) of every row; scores are probabilities."""
    if fitted is None:
        return undecided(docs.select("doc_id"))
    rows = fitted.hasher.transform(fitted.vocabulary.transform(views(needed(docs))))
    return judged(rows.select("doc_id", "content", "page"), fitted)


def undecided(ids: DataFrame) -> DataFrame:
    """The rows of :func:`score` without a fit: no scores, and all kept."""
    nothing = F.lit(None).cast("double")
    return ids.select(
        "doc_id", *[nothing.alias(c) for c in ("content_score", "page_score", "score")], F.lit(True).alias("kept")
    )


def judged(rows: DataFrame, fitted: CoTrained) -> DataFrame:
    """The rows of :func:`score` from ids and features."""
    rows = fitted.page.transform(fitted.content.transform(rows))
    logits = {v: a + b * logit(v) for v, (a, b) in fitted.platt.items()}
    bias, content, page = fitted.combined

    def chance(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    return rows.select(
        "doc_id",
        chance(logits["content"]).alias("content_score"),
        chance(logits["page"]).alias("page_score"),
        chance(bias + content * logits["content"] + page * logits["page"]).alias("score"),
    ).withColumn("kept", F.col("score") >= ACCEPT)


def classify(docs: DataFrame, labels: DataFrame, row_id: Column | None = None) -> DataFrame:
    """Fit on ``labels`` (doc_id, quality, toxic) and all documents without one, and score all of ``docs``.

    With ``row_id`` that stands in place of the document's id in the result.
    """
    got = trained(docs, labels, row_id)
    if got is None:
        return undecided(docs.select((F.col("doc_id") if row_id is None else row_id).alias("doc_id")))
    fitted, every = got
    return judged(every.select(F.col("row_id").alias("doc_id"), "content", "page"), fitted)
