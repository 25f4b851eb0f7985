"""A training-corpus pipeline: toxicity, near duplicates, personal data, mix, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm import mixing, near_copies, pii, sp_sampling, toxicity
from ruleloom.llm.common import materialize, read_table
from ruleloom.llm.queries import pseudonym_key

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the others stay as they are.

    A null text counts as empty and is scored like one; long texts are read
    whole.  Equal texts go or stay together, repeated rows stay repeated.  An
    empty table stays empty; columns besides those of documents go.
    """
    labels = read_table(spark, sf_dir, "labels")
    limits = toxicity.Limits()
    # the model is fitted on the corpus that the stage is given
    model = toxicity.fit_model(*toxicity.labelled_sample(docs, labels, limits), limits)
    return toxicity.score_texts(docs.select(*COLUMNS), model).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the least id.

    Documents are linked at a five-word shingle similarity of 0.8 or more, by
    their texts alone: SimHash with deletion variants finds those within four
    bits, MinHash keys the pairs beyond them, and the exact similarity decides
    on both.  Rows that repeat an id, or lack one, are documents like any other.  Ties, among rows of the least id, go to the least hash of the
    row; of rows that are equal in every column one stays.  Null and empty
    texts are copies of each other.  Long texts are compared whole.  An empty
    table stays empty; columns besides those of documents go.
    """
    rows = docs.select(*COLUMNS)
    # a name for every row: its id, if it has one, and a hash of all of it
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*COLUMNS).alias("hash"))
    found = near_copies.near_copies(rows.select(name.alias("name"), "text"), key="name").where("name = component_id")
    keep = materialize(found.groupBy("name").count().select(F.col("name.doc_id").alias("kept_id"), F.col("name.hash").alias("kept_hash"), "count"), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64(*COLUMNS) == F.col("kept_hash"))
    kept = rows.join(keep.where("count = 1"), same, "left_semi")
    if keep.where("count > 1").isEmpty():
        return kept
    return kept.unionByName(rows.join(keep.where("count > 1"), same, "left_semi").dropDuplicates())


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become pseudonyms; lengths are counted anew.

    A null text stays null, with a null length; an empty one stays empty.  Long
    texts are read whole, equal values get equal pseudonyms, repeated rows stay
    repeated.  An empty table stays empty; columns besides those of documents go.
    """
    d = docs.select(*COLUMNS).withColumn("text", pii.pseudonymized(F.col("text"), pseudonym_key(spark))["text"])
    return d.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Decided for every row on its own, so ids may repeat or lack.  A null source
    is a source; a null or empty text has no words and comes as often as its
    source's whole copies, or once more.  Rows that repeat id and text share
    their fate, as do rows of equal rank.  Long texts are counted whole.  An
    empty table stays empty; columns besides those of documents go.
    """
    return mixing.mixed_rows(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document of the mix.

    Null and empty texts have no pieces.  Long texts are segmented whole.
    Copies of a document, which share its id, repeat its segmentation.  An empty
    table gives an empty result; other columns are ignored.
    """
    return sp_sampling.sampled_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("private_data", mask_private),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: The fitted model and the sampled pieces can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
