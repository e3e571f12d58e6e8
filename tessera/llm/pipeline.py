"""The corpus pipeline: five operators over ``documents``, each on all that the last one kept.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the
last returns the mix: doc_id, size, source_size, target and taken. Every stage's result is
written as Parquet and read again, so a lost executor costs at most the work of one stage.

A stage that drops documents leaves the texts where they are: toxicity filters in the pass
that scores, and the others join the scan with the few rows they decided to drop. Where
those are too many to be broadcast (they are counted first), Spark shuffles instead.

Rows whose ids repeat are told apart where they have to be: of equal rows exactly one
stays after exact deduplication. In all stages a null text counts as empty, an empty table
stays empty, and columns that documents don't have are not handed on.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import broadcast_if_small, durable, fold_of, shared_folder, table, whole_text
from tessera.llm.decontamination import contaminated
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.mixing import mix
from tessera.llm.toxicity import score, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC_FROM = 0.7
MIX_WEIGHTS, MIX_REPEATS = [5, 2, 1], 3


def _key() -> Column:
    """Tells documents apart where ids repeat."""
    return F.struct(F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(whole_text()).alias("text_hash")).alias("_key")


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in docs.columns if c in COLUMNS]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.7, by a model of the labels outside the held-out fold.

    Equal texts are kept or dropped together; a score of 0.7 itself drops. Null and empty texts
    have the score of the bias. Without labels every score is 0.5, and all stay.
    """
    labels = table(spark, sf_dir, "labels")
    model = train(docs, labels, learn=fold_of("doc_id", 3) != 1)
    return score(docs, model, keep=_columns(docs)).where(F.col("score") < TOXIC_FROM).drop("score")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id; of equal rows too, one."""
    decided = durable(exact_dedup(docs).groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")))
    dropped = decided.where("not kept or rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept")
    digest = F.sha2(whole_text().cast("binary"), 256)
    known = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_sha"))
    marked = docs.select(*_columns(docs)).withColumn("_digest", digest).join(broadcast_if_small(dropped, dropped.count()), known, "left")
    single = marked.where("_sha is null").select(*_columns(docs))
    repeated = marked.where("kept").dropDuplicates(["doc_id", "_digest"]).select(*_columns(docs))
    return single.unionByName(repeated)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least id; of equal rows too, one.

    A null id is the least; of one id with several texts the text with the least hash stays.
    Null, empty and wordless texts are in no class and all stay.
    """
    classes = durable(jaccard_join(docs).select("class_row", F.struct(F.col("doc_id").cast("bigint").alias("id"), "text_hash").alias("_key")))
    stays = classes.groupBy("class_row").agg(F.min("_key").alias("_stays"))
    dropped = durable(classes.join(stays, "class_row").where("_key <> _stays").select("_key"))
    kept = _without(docs, dropped)
    again = durable(classes.groupBy("class_row", "_key").count().where("count > 1").select("_key"))
    if again.isEmpty():
        return kept
    equal = docs.select(*_columns(docs), _key()).join(again.join(dropped, "_key", "left_anti").distinct(), "_key", "left_semi")
    return _without(kept, again).unionByName(equal.dropDuplicates(["_key"]).drop("_key"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Rows of one id are looked at each by its own text. Null and empty texts overlap nothing and
    stay; with an empty benchmark all stay.
    """
    keyed = docs.select(_key(), "text")
    return _without(docs, durable(contaminated(keyed, table(spark, sf_dir, "benchmark"), id_col="_key").select("_key").distinct()))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose (id, hash of text) is not among those dropped."""
    small = broadcast_if_small(dropped.withColumnRenamed("_key", "_dropped"), dropped.count())
    return docs.select(*_columns(docs), _key()).join(small, F.col("_key") == F.col("_dropped"), "left_anti").drop("_key")


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each remaining document is taken so that sources meet their target weights.

    All documents are returned, those that are taken 0 times too: null and empty texts among
    them, whose size is 0. A null source is one of its own. Rows with equal ids are drawn each.
    """
    return mix(docs, MIX_WEIGHTS, MIX_REPEATS).select("doc_id", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_to_weights),
]

#: Neither the classifier nor the similarity classes can be said in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark wrote it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    A stage's result is deleted when the next one has been written; the last one stays, as it is returned.
    """
    folder, docs = f"{shared_folder(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs
