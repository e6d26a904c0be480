"""From raw documents to packed sequences, one stage after another.

Each stage is a function of (spark, docs, sf_dir), works on all that the stage
before it kept, and is written as Parquet and read again for the next one. All
but the last return the columns of ``documents``; other columns of the input are
carried along. Null or empty texts are clean, have no duplicates and no personal
data, and are packed as a document of the end id alone. An empty table passes
through empty. Repeated rows count as copies: one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm import ngramjoin, packing, pii, toxicity, wumanber
from regspark.llm.queries import ship
from regspark.session import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not predict to be toxic.

    It learns from the labelled documents whose crc32(doc_id) mod 3 is not 1.
    """
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.train(docs, labels, usable=F.crc32(F.col("id").cast("string")) % 3 != 1)
    return toxicity.score(docs, machine, carry=True).where(F.col("predicted") == 0).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id."""
    ship(spark)
    return ngramjoin.one_of_each(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows."""
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return wumanber.scan(docs, benchmark, carry=True).where(~F.col("contaminated")).select("row.*")


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind.

    ``n_chars`` follows the masked text; a null text stays null.
    """
    spans = f"_spans_{uuid.uuid4().hex}"  # no column of the input has this name
    text = F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), pii.merged(F.col(spans))))
    found = pii.find(docs, into=spans).withColumn("text", text)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long"))
                                 .otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs whole texts into sequences; every token of every document is kept."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal),
    ("packing", pack),
]

#: No stage before the packing is plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to ``documents``, each on the table the last one wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = fresh_path(spark, f"corpus-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
