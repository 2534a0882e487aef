"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A normalised text is cut into chunks whose ends depend on the text near them. Each chunk content
moves once: equal contents collapse on the map side and get one identifier, a 64-bit hash that is
checked against the content; contents that share a hash get a variant number as well. A document is
then a short list of identifiers, and equal lists are equal texts. Long documents never move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import only, stored

SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def chunk_pattern(least: int, most: int) -> str:
    """A chunk ends after the first sentence mark or common word end past ``least`` characters."""
    return rf"(?s).{{{least},{most}}}?(?:[.!?:;] |[aeiou][nrs] |\z)|.{{1,{most}}}"


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    least: int = 512, most: int = 4096, hash_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation. Null and empty texts form one
    group; a text of white space only is one space and forms another. Rows that repeat an id are
    counted one by one and each gives a row; all rows with the smallest id are kept. A null id is
    never kept and never the ``keep_id`` unless its whole group has none. An empty table gives an
    empty result; further columns are ignored, whatever their names. ``hash_bits`` shortens the
    identifiers for tests of the variant numbers.
    """
    mask = F.lit((1 << hash_bits) - 1 if hash_bits < 64 else -1).cast("long")
    text = only(docs, doc_id=id_col, text=text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    cut = text.withColumn("chunks", F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)))

    def identifier(c: Column) -> Column:
        return F.xxhash64(c).bitwiseAND(mask)

    cut = cut.withColumn("text_sha256", F.sha2("norm", 256))
    recipes = stored(cut.select("doc_id", "text_sha256", F.transform("chunks", identifier).alias("recipe")))
    pieces = cut.select("doc_id", "text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn(
        "h", identifier(F.col("chunk")))
    # The content itself is a grouping key, so one row here is one verified content.
    contents = pieces.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    clashes = stored(contents.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1").select("h"))
    # The rest is empty unless two contents share a hash; the planner then drops the joins.
    clashing = stored(pieces.join(clashes, "h"))
    variants = clashing.select("h", "chunk").distinct().withColumn(
        "variant", F.row_number().over(Window.partitionBy("h").orderBy("chunk")))
    fixes = (
        clashing.join(variants, ["h", "chunk"]).groupBy(F.col("doc_id").alias("of_doc"), F.col("text_sha256").alias("of_text"))
        .agg(F.sort_array(F.collect_set(F.struct("pos", "variant"))).alias("fix"))
    )
    named = recipes.join(
        fixes, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_sha256") == F.col("of_text")), "left",
    ).select("doc_id", "text_sha256", "recipe",
             F.coalesce("fix", F.array().cast("array<struct<pos:int,variant:int>>")).alias("fix"))
    groups = named.groupBy("recipe", "fix").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Stored, so that the join deals both sides itself and can split a group of very many copies.
    shared = stored(groups.where("group_size > 1"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return (
        named.join(shared, ["recipe", "fix"], "left")
        .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), "text_sha256")
    )
