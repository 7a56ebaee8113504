"""From raw documents to packed training sequences, one operator a stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import mixing, ngram_join, packing, quality, secret_scan
from meshwright.llm.columns import Columns
from meshwright.llm.queries import table, tokenizer_path
from meshwright.plans.recovery import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts score the sample's mean label; null ids and repeated rows are scored as they come; an empty table
    gives no rows. All columns come back, whatever their names.
    """
    given = Columns(docs)
    used = {given.at(c): c for c in ("doc_id", "text")}
    scored = quality.classify(given.rows.withColumnsRenamed(used), table(spark, sf_dir, "labels")).filter("predicted = 1")
    return given.named(scored.withColumnsRenamed({c: at for at, c in used.items()}))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id stays.

    Of rows that repeat an id one stays, of those without an id one of each text; texts without words have no copies.
    An empty table gives no rows; all columns come back, whatever their names.
    """
    return ngram_join.first_of_each(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret's span is replaced by a mark; null texts stay null, all other columns as they are."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's target weight asks for; a null source is one, null texts have no words."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null text is an empty one. Only the columns of the result come back."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first_copies),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Classifier, trie join and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
