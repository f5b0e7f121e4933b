"""The corpus pipeline: toxic documents go, then those in no language, then near-duplicates; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellate.llm import language_id, packing, simhash, toxicity
from tessellate.llm.queries import tokenizer_file
from tessellate.llm.storage import appended, fresh, stored, table

TOXIC, SURE = 0.5, 0.5


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of TOXIC or more go.

    Null and empty texts have the lowest score and stay. Equal texts have equal scores, so repeated rows stay or go together; a null id
    only keeps a row from the training sample. Columns of any name come back; an empty table gives an empty table.
    """
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"), F.lit(True))
    held = spark.sparkContext.broadcast(model)

    def compute(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([held.value.probability(held.value.evidence(t)[0]) for t in texts], pa.float64())]

    score = fresh(docs, "_toxicity")
    return appended(docs, "text", {score: "double"}, compute).filter(F.col(score) < TOXIC).drop(score)


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose best language has less than SURE of the probability, go.

    Null and empty texts have no letter and go. Of equally likely languages the first name counts, which is below SURE or even with it.
    Repeated rows stay or go together; a null ``lang`` only keeps a row from training. Columns of any name come back; an empty table gives an empty table.
    """
    held = spark.sparkContext.broadcast(language_id.trained(docs))

    def compute(texts: list[str | None]) -> list[pa.Array]:
        found = held.value.predict(texts)
        return [pa.array([name != language_id.UNDETERMINED and score >= SURE for name, score in found], pa.bool_())]

    speaks = fresh(docs, "_speaks")
    return appended(docs, "text", {speaks: "boolean"}, compute).filter(F.col(speaks)).drop(speaks)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles of a similarity of 0.8 or more the one with the smallest id stays.

    Texts without a word, null and empty ones, are one group; shorter texts than five words are one shingle. Repeated rows are one
    group: one of them stays, and of equal ids one row. A null id comes after all others. Columns of any name come back; an empty table gives an empty table.
    """
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row a piece.

    A null or empty text is the separator alone; repeated rows and null ids are packed as often as they stand; only doc_id and text are read,
    whatever else docs has. Pieces of equal length are told apart by id, start and content, so which sequence a piece gets does not hang on the order of rows. An empty table gives no piece.
    """
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"), separator=2, capacity=4096)


STAGES = [
    ("toxicity", not_toxic),
    ("language", in_a_language),
    ("near_duplicates", one_of_near_duplicates),
    ("packing", packed),
]
#: The stages learn models and read tokenizer files, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents of sf_dir, each on the whole result of the one before, which is written in between. What each does with odd rows it says itself."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
