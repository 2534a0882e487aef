"""From raw documents to packed training sequences, in five stages.

Each stage takes all documents that the one before kept; what it decides takes effect in what it
returns. Stages hand on the columns of documents; the last returns placed pieces.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if str(Path(__file__).resolve().parent) not in sys.path:
    sys.path.insert(0, str(Path(__file__).resolve().parent))

from alphaframe.llm.common import stored
from alphaframe.llm.exact_dedup import exact_dedup
from alphaframe.llm.language_id import recognised
from alphaframe.llm.ngram_join import near_duplicates
from alphaframe.llm.queries import packed
from alphaframe.llm.secret_scan import masked, scan_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keyed(docs: DataFrame) -> DataFrame:
    """All rows with a key of their own, ``row``: by doc_id, those without one last, then by the place in the stored input.

    Read as they are, files give each row the same place each time; any other input is stored first.
    """
    if docs._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not docs.inputFiles():
        docs = stored(docs)
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    return docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", place.alias("place")).alias("row"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that come first in their group; ``groups`` has row and first, both keys.

    The keys to drop are stored first, so that their size decides how the join runs before any text moves.
    """
    later = stored(groups.where("row <> first").select("row"))
    return docs.join(later, "row", "left_anti").select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop rows in no language the model knows: no letter, or no class that fits at all.

    A null or empty text goes. Each row is judged by itself: rows without id and rows that repeat one alike.
    """
    return recognised(docs).select(*COLUMNS)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: the one with the smallest id, of several with that id the first in place.

    A row without id is a row like others but comes behind those with one; of texts that only such rows have, one stays. Null and empty texts are one group.
    """
    docs = keyed(docs)
    return one_of_each(docs, exact_dedup(docs, id_col="row").select(F.col("doc_id").alias("row"), F.col("keep_id").alias("first")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near-duplicates, chosen as in ``copies``.

    Null and empty texts have no shingles, link with nothing and all stay.
    """
    docs = keyed(docs)
    return one_of_each(docs, near_duplicates(docs, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("first")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret found, and give the new length.

    All rows stay, whatever their id; a null text stays null. A secret in a row that repeats is masked in each.
    """
    return masked(docs).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place all token pieces in sequences.

    A null text is empty and takes one end token; rows that repeat an id or have none are placed each by itself.
    """
    return packed(docs)


STAGES = [
    ("language_id", languages), ("exact_dedup", copies), ("ngram_jaccard_join", near_copies),
    ("secret_scan", secrets), ("best_fit_packing", sequences),
]
#: Kernels, automata and tokenizers have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
