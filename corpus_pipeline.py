"""From raw documents to training shards: five stages, each over all rows that the stage before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and columns of any other name pass through.  A
stage's result is written before the next one reads it, so a lost executor costs
no more than a stage.

All stages give no rows for an empty table and take whole texts of any length,
in steps of some megabytes.  What each makes of nulls, ties and repeated rows
stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, minhash, mixing, sharding
from lodestone.llm import toxicity as toxic
from lodestone.llm.tables import Owned, materialize, read
from lodestone.session import ship

#: SQL can't express the trained classifier, MinHash or the FM-index.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier finds toxic (score 0.5 or more) go.

    Null or empty texts are scored by the bias alone and stay; a null id is scored like any other; repeated rows all
    stay or all go; without any toxic label all stay.
    """
    ship(spark)
    return toxic.drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without words, null ones among them, are no copies of each other and stay, once for each id and text; rows
    without an id all stay; rows equal in id and text become one; an id with several texts keeps those that are no
    copies.
    """
    ship(spark)
    return minhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut from the texts; a document that is nothing else goes.

    Null and empty texts stay as they are; items without words cut nothing; repeated rows are cut alike.
    """
    ship(spark)
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated up to their temperature weights; each document stays once at least.

    A null source is a source of its own; a null or empty text counts one token; rows with equal ids are ordered by
    their texts, and repeated rows count each.
    """
    ship(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard whose mixture of sources is that of all rows.

    A null source is a stratum of its own; a null text has size 1; rows with equal ids are ordered by checksum and
    size.  Columns of the stage's own names (size, shard and so on) are renamed with a leading underscore.
    """
    ship(spark)
    return sharding.interleave(docs, keep=[c for c in docs.columns if c != "doc_id"])


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over the documents of sf_dir; what a stage writes besides its result goes when that is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Owned() as own:
            made = materialize(stage(spark, docs, sf_dir), name)
            own.keep(made)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
