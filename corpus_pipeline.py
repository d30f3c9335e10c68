"""The training-data pipeline: from documents to sharded, mixed, clean text.

Each stage is (spark, docs, sf_dir) -> DataFrame; its rows are written as Parquet and read again for the next. All but
the last return the columns of documents.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattsift.llm.decontaminate import find_contamination
from wattsift.llm.mixing import mix, taken
from wattsift.llm.ngram_join import near_duplicates
from wattsift.llm.q_mixing import domain_of, weights_of
from wattsift.llm.quality import classify
from wattsift.llm.registry import table
from wattsift.llm.reshard import reshard
from wattsift.session import written

#: The mix takes as many tokens as there are, up to two epochs of a source.
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (1, 1), 2, 7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return classify(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the least id; rows that repeat id and text once.

    A row is known by its id and text together: texts that share an id, or have none, are kept or dropped each for
    itself. Among rows of the least id the least by hash of the text stays; rows without an id come last. Texts without
    words link with nothing and stay.
    """
    row = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"), F.isnull("text").alias("no_text"))
    known = docs.withColumn("kept_row", row)
    others = near_duplicates(known, id="kept_row").where("kept_row <> component_id").select("kept_row").distinct()
    # the join leaves rows where the second step wants them: texts are shuffled once
    return known.join(others, "kept_row", "left_anti").dropDuplicates(["kept_row"]).select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no test item occurs."""
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where("NOT contaminated").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return taken(mix(docs, domain_of(), weights_of(), MIX_SHARE, MIX_EPOCHS, MIX_SEED)).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return reshard(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: SQL cannot express the classifier, the hashes of the mix aside; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
