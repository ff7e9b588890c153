"""Quality and toxicity of documents, both graded by cumulative-link regression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlrisk.llm import ordinal

#: The most labelled rows a model is fitted on; the sample and what it fits in are bounded by this.
FIT_ROWS = 12_000
#: A document is kept if it is at least of the second grade with this chance.
KEEP_FROM = 0.5
#: A document counts as toxic from this chance on.
TOXIC_FROM = 0.5


def quality_grade() -> Column:
    """0: low quality; 1: good but toxic; 2: good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, 2 - F.coalesce("toxic", F.lit(0)))


def severity_grade() -> Column:
    """The graded rating of severity: the labels know two grades, the regression takes any number of them."""
    return F.col("toxic")


def labelled(docs: DataFrame, labels: DataFrame, grade: Column, limit: int = FIT_ROWS) -> DataFrame:
    """(text, grade) of a bounded sample of the labelled documents.

    Rows without an id or a grade take no part.  The sample is small by its
    parameter, so it is sent to the documents and they are not shuffled.
    """
    rows = labels.select("doc_id", grade.alias("grade")).where("doc_id IS NOT NULL AND grade IS NOT NULL")
    return docs.select("doc_id", "text").join(F.broadcast(ordinal.sample(rows, limit, "doc_id")), "doc_id").select("text", "grade")


def quality_model(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> ordinal.Model:
    """Ordinal regression of quality on how texts are written."""
    return ordinal.fit(labelled(docs, labels, quality_grade(), limit), ordinal.ShapeFeatures, unlabelled=2)


def toxicity_model(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> ordinal.Model:
    """Ordinal regression of severity on the words of texts."""
    return ordinal.fit(labelled(docs, labels, severity_grade(), limit), ordinal.WordFeatures)


def quality(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, keep_from: float = KEEP_FROM) -> DataFrame:
    """(doc_id, expected_grade, p_second, kept) of every document, null and empty texts included.

    Without labels all documents are kept.
    """
    scored = ordinal.score(docs, quality_model(docs, labels, limit), ordinal.ShapeFeatures)
    second = F.element_at("tails", 1)
    return scored.select("doc_id", F.col("expected").alias("expected_grade"), second.alias("p_second"),
                         (second >= keep_from).alias("kept"))


def only_good(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None, limit: int = FIT_ROWS,
              keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that are kept, with all their columns; the model learns from ``all_docs`` if given."""
    model = quality_model(docs if all_docs is None else all_docs, labels, limit)
    return ordinal.keep(docs, model, ordinal.ShapeFeatures, 0, keep_from)


def toxicity(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, toxic_from: float = TOXIC_FROM) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, toxic) of every document, null and empty texts included.

    Without labels no document is toxic.
    """
    scored = ordinal.score(docs, toxicity_model(docs, labels, limit), ordinal.WordFeatures)
    any_ = F.element_at("tails", 1)
    return scored.select("doc_id", F.col("expected").alias("expected_severity"), any_.alias("p_toxic"),
                         (any_ >= toxic_from).alias("toxic"))
