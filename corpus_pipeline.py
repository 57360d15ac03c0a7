"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it
as Parquet in the shared folder and the next stage reads that. All but the last
return the columns of the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstone.llm import decontam, langid, minhash, mixing, sstable
from loomstone.llm.queries import ready
from loomstone.staging import fresh_path, if_small, remove

LEAST_SHARE = 0.4
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The texts, what operators read, and all other columns in one struct, so that no name can clash."""
    ready(docs.sparkSession)
    others = [docs[c] for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("row"), "text", "doc_id", "lang", "source")


def _unpacked(packed: DataFrame, columns: list[str]) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts whose main language holds too small a share of their letters.

    Null and empty texts have no letter and go; a long text is judged as a whole;
    repeated rows fare alike; without rows nothing is learned and nothing returned;
    columns keep their names whatever they are.
    """
    packed = _packed(docs)
    found = langid.identify(packed.select("row", "text"), langid.learn(packed))
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_SHARE)
    return _unpacked(found.where(known), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component: that of the smallest id (null last), then of the smallest hash of its text.

    Texts without words (null, empty, white space) are in no component and stay.
    Of rows that repeat id and text, the first in the order of their other columns
    stays. Different texts under one id are judged apart. An empty table stays empty.
    """
    first = minhash.representatives(_packed(docs).select("doc_id", "text"))
    keys = ["want_id", "want_key", "want_key_b"]
    wanted = if_small(first).select(F.col("doc_id").alias(keys[0]), F.col("text_key").alias(keys[1]), F.col("key_b").alias(keys[2]), "rows")
    packed = _packed(docs).select("row", "text", "doc_id", F.xxhash64("text").alias("text_key"), F.xxhash64(F.lit(1), "text").alias("key_b"))
    wordless = F.col("text").isNull() | ~F.col("text").rlike(mixing.WORD)
    same = (packed["text_key"] == F.col(keys[1])) & (packed["key_b"] == F.col(keys[2])) & packed["doc_id"].eqNullSafe(F.col(keys[0]))
    chosen = packed.where(~wordless).join(wanted, same)
    single = chosen.where("rows = 1").select("row", "text").unionByName(packed.where(wordless).select("row", "text"))
    if first.df.where("rows > 1").limit(1).count():
        again = chosen.where("rows > 1").groupBy(*keys).agg(F.min_by(F.struct("row", "text"), F.to_json("row")).alias("least"))
        single = single.unionByName(again.select("least.row", "least.text"))
    return _unpacked(single, docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a window of a benchmark item, however long the document is.

    Null and empty texts hold none and stay; repeated rows fare alike; without
    items all rows stay, without rows none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _unpacked(decontam.judge(_packed(docs), benchmark).where("n_hit = 0"), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as its source's rate asks.

    A null text has no words and counts for nothing, a null source is a source of
    its own, repeated rows are taken alike, and a source without words is left out.
    """
    mixed = mixing.mix(_packed(docs))
    return _unpacked(mixing.emit_copies(mixed, ["row", "text"]), docs.columns)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token shards and return what they hold for each document.

    A null or empty text has the end id only; rows that repeat an id each have an
    entry; without rows there are no shards.
    """
    return sstable.token_rows(_packed(docs).select("doc_id", "text"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_shards", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's table goes when the next one is written."""
    docs, last = ready(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
