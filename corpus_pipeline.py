"""documents -> training sequences: STAGES, each over all that the one before it kept.

Each function takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. Extra columns of docs come through
every such stage as they are, also those named like a column that an operator adds. Empty tables stay empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard, mixing, packing, quality, toxicity
from larkspur.llm.queries import tokenizer
from larkspur.llm.store import Scratch, discard, table

#: Packing depends on how rows are dealt to tasks, which SQL can't express.
ORACLE_SQL = None


def _through(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs, where columns that the operators do not need are out of their way."""
    aside = {c: f"aside_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    out = stage(docs.withColumnsRenamed(aside))
    return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model takes for toxic go; it learns from the labels of the documents table. A null text is scored as an empty one, a
    null id does not matter; a very long text is scored as a whole; rows that repeat a text share its fate."""
    machine = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return _through(docs, lambda d: toxicity.apply(d, machine).filter("predicted = 0"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model takes for good stay; nulls, long texts and repeated rows as in drop_toxic."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.lit(True))
    return _through(docs, lambda d: quality.apply(d, model).filter("predicted = 1"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that five-word shingles of whole texts link at a Jaccard similarity of 0.8, directly or through others, one stays: that with the smallest id
    (null ids come last), then the smallest hash of the text; of rows that repeat this id and text, any one. Rows without words (null, empty,
    blank) all stay. Rows that share an id but not their text are judged each for itself."""
    return _through(docs, lambda d: jaccard.one_of_each(d, 5, 80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source in the quota of its weight, documents as often as the mix takes them (see mixing.mix: a null source is one of its own; rows that
    repeat an id and text are taken together)."""
    return _through(docs, mixing.mix)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document in a sequence, without its ids; a null or empty text is the end id alone."""
    return packing.pack(docs.select("doc_id", "text"), tokenizer()).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's result is written to the shared folder and read by the next; once that has written its own, it goes."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with Scratch() as scratch:
            docs = scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
