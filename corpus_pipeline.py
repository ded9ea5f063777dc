"""A training-corpus pipeline: toxicity, line dedup, near copies, mix, packing.

Every stage takes all rows that its predecessor kept. ``run`` writes the rows
between stages to the shared folder, so a lost executor costs no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import line_dedup, mixing, ngram_join, packing, toxicity
from fieldweave.llm.common import WORD, Scratch, apart, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain, fitted on the labelled ones among them, does not reject.

    A null text has no words and is judged by the intercepts, so it stays, as
    does all where no label is toxic; rows that repeat an id are judged each on
    its text. No documents, no rows. Columns may have any names.
    """
    chain, _, _ = toxicity.train(apart(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, chain)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that match earlier ones; those of which no word is left go.

    A null text stays; ``n_chars`` follows the text where lines went. Columns
    may have any names.
    """
    found, removed = line_dedup.deduplicated(docs)
    loses, text = F.size(removed) > 0, F.col("text")
    emptied = loses & ~F.coalesce(text, F.lit("")).rlike(WORD)
    kept = found.where(~emptied)
    own = [F.col(c) for c in kept.columns if c != removed]
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        own[i] = F.when(loses, F.char_length(text)).otherwise(own[i]).cast(docs.schema[i].dataType).alias(kept.columns[i])
    return kept.select(*own).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that of the smallest id; null ids, and texts without words, stay.

    Rows are told apart by id and text: of rows that share an id only those go
    that are linked to another one that stays. Rows that repeat both are one
    document. No documents, no rows. Columns may have any names.
    """
    plain = apart(docs, "doc_id", "text")
    links = Scratch(spark, "groups").write(ngram_join.linked(plain), "links")
    goes = links.where("NOT first").select("doc_id", "look").distinct()
    kept = plain.withColumn("look", ngram_join.look()).join(goes, ["doc_id", "look"], "left_anti")
    named = links.where("doc_id IS NOT NULL").select("doc_id", "look")
    if named.count() > named.distinct().count():
        kept = kept.where("doc_id IS NULL").unionByName(kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "look"]))
    return kept.select(*plain.columns).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them.

    A null text takes no words, null sources are a source, null ids draw one
    number; rows that repeat an id, a source and a size are taken alike. No
    documents, no rows. Columns may have any names.
    """
    return mixing.mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences.

    A null text is one piece of the end token; rows that repeat an id, as
    copies do, are packed each on its own; long texts are cut into pieces. No
    documents, no rows. Other columns are ignored.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier chain and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole documents table; a stage's rows are dropped when the next one's are written."""
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{i}-{name}")
        if last:
            scratch.drop(last)
        scratch.release()
        last = f"{i}-{name}"
    return docs
