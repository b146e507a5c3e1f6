"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate group stays,
documents with benchmark text go, and what is left is packed into training sequences.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns the columns of
``documents``; the last returns the packed pieces. ``run`` writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtable.llm import decontamination, lines, packing, simhash, toxicity
from loomtable.llm.queries import id_crc, table, tokenizer_path
from loomtable.llm.shared import materialize

#: Differing bits that the search of a tree allows. Two texts of 0.8 differ in about ten and hardly ever in so many.
REACH = 20
#: Similarity (Jaccard index) of five-word shingles that links two documents.
ALIKE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Labels, where there are any, are only learnt from."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "text", "doc_id", "toxic", id_crc(F.col("k")) % 4 != 2)
    return toxicity.score_texts(docs, "text", model).filter(F.col("out.score") < 0.3).select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on over a tenth of a source's different pages, and on five or more, go from its texts; the documents all
    stay."""
    changed = lines.drop_boilerplate(docs, "source", "text")
    columns = [F.col("kept_text").alias(c) if c == "text" else
               F.length("kept_text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
               for c in docs.columns]
    return changed.select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (0.8 of five-word shingles, by count) stays: the one of least id."""
    return simhash.one_of_each(docs, "text", "doc_id", 3, reach=REACH, alike=ALIKE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten successive words of a benchmark item, or a whole shorter item, go."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"), "text", "item_id", "text", 10)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 4096 tokens."""
    return packing.pack(docs, "text", ["doc_id"], tokenizer_path()).select(
        "row.doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Token ids and the stages' models can't be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
