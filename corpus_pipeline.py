"""The corpus pipeline: five stages, each one of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that the next stage gets as its documents. All but the last
return the columns of ``documents``, and each works on all that its predecessor
kept. ``run`` applies them to ``documents``, with a written table between stages.
Every stage takes null ids, null, empty and very long texts, repeated rows, empty
tables and extra columns; what becomes of them is said at each stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import decontaminate, minimax_shards, mixture, simhash_pivot, weak_quality
from auditspark.llm.common import cut, free_name, table
from auditspark.llm.queries import MIX_SEED, MIX_WEIGHTS, domain_of

MIX_SHARE = 0.9   # of the tokens that are left, for the mixture
N_SHARDS = 16


SALTS = 16        # tasks over which the rows of one repeated id are joined


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key that no two rows share, and its name: the id; a row without
    one, and all but one of the rows of an id, have a number above all ids. Such numbers
    must not change, so they are written."""
    key = free_name(docs, "key")
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("doc_id is null or n > 1").isEmpty():
        return docs.withColumn(key, F.col("doc_id").cast("long")), key
    row, first, salt = (free_name(docs, n) for n in ("row", "first", "salt"))
    rows = cut(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    again = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(text.alias("h"), F.col(row).alias("r"))).alias("m"))
    again = again.where("n > 1").select("doc_id", F.col("m.r").alias(first), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")).alias(salt))
    rows = rows.withColumn(salt, F.pmod(F.col(row), F.lit(SALTS))).join(again, ["doc_id", salt], "left")
    own = F.col("doc_id").isNotNull() & (F.col(first).isNull() | (F.col(first) == F.col(row)))
    number = F.when(own, F.col("doc_id").cast("long")).otherwise(F.lit(1 << 62) + F.col(row))
    return cut(rows.select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(key)), "keyed"), key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null and empty texts stay
    unless the scorer rejects a text without words."""
    model = weak_quality.fit(docs, table(spark, sf_dir, "labels"))
    names = [free_name(docs, n) for n in ("p_junk", "p_toxic", "kept")]
    return weak_quality.score(docs, model, names=names).where(F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the row whose key names the component, that is one of
    the smallest id. Rows are judged one by one, whether ids repeat or not; a row without
    an id, and all but one of an id's rows, yield to the others. Null and empty texts
    form one group."""
    rows, key = keyed(docs)
    groups = simhash_pivot.near_duplicates(rows, id_col=key, shingle=3, max_bits=2)
    named = groups.where("id = component").select(F.col("id").alias(key))
    return rows.join(named, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of any test item's windows, row by row."""
    rows, key = keyed(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=key)
    bad = found.where("n_hit > 0").select(F.col("id").alias(key)).distinct()
    return rows.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture chooses in one epoch, whole: the one in
    which a leaf's token prefix ends stays as it is. Texts without words go."""
    rows, key = keyed(docs)
    chosen = mixture.mix(rows, domain_of(F.col("source")), MIX_SHARE, MIX_WEIGHTS, 1, MIX_SEED, id_col=key)
    ids = chosen.select(F.col("id").alias(key)).distinct()
    return rows.join(ids, key, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document."""
    out = minimax_shards.shards(docs, N_SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_free),
          ("mixing sources", mixed), ("sharding", sharded)]

#: the classifier's trained weights and XXH64 have no SQL form; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
