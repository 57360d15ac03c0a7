"""The difference-cover suffix sort as a distributed algorithm, and removal of repeated strings by it.

Positions of one long string are rows. The suffixes at positions 1 and 2 modulo 3
are the sample: their triples are sorted by range over all tasks and named by their
rank; where names repeat, the string of names is sorted by recursion. The other
suffixes are sorted together with each half of the sample by (symbol, rank behind
it) and (symbol, symbol, rank behind both), and running counts over key ranges put
all suffixes into one order. Neighbours are compared on the first ``length`` bytes
by two 64-bit hashes, and each class of equal windows keeps its earliest.

Every byte becomes a row that moves through several sorts on each level, so this
moves some hundred times the input; ``suffix_dedup`` gives the same result from
candidates found first. Figures are in the README.

Defined results are those of ``suffix_dedup``: null and empty texts have no bytes,
texts shorter than ``length`` stay, an empty table gives no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstone.llm.difference_cover import suffix_order
from loomstone.llm.minhash import BASE, _powers, _scramble
from loomstone.llm.suffix_dedup import BYTE_VALUE, LENGTH
from loomstone.staging import Staged

ONE_TASK = 1 << 16


def _placed(rows: DataFrame, keys: list[str], counts: dict[str, Column], name: str) -> Staged:
    """Rows sorted by range over all tasks, with running counts (exclusive) of some conditions, over all rows before."""
    spark = rows.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = Staged(ranged.withColumns({c: F.coalesce(F.sum(what.cast("long")).over(before), F.lit(0)) for c, what in counts.items()}), f"{name}-local")
    sums = local.df.groupBy("part").agg(*[F.sum(what.cast("long")).alias(c) for c, what in counts.items()]).orderBy("part").collect()
    starts, at = [], [0] * len(counts)
    for r in sums:
        starts.append((r["part"], *at))
        at = [a + r[c] for a, c in zip(at, counts, strict=True)]
    table = spark.createDataFrame(starts or [(0, *at)], ", ".join(["part int", *(f"start_{c} long" for c in counts)]))
    joined = local.df.join(F.broadcast(table), "part")
    found = Staged(joined.withColumns({c: F.col(c) + F.col(f"start_{c}") for c in counts}).drop(*(f"start_{c}" for c in counts)), name)
    local.drop()
    return found


def _named(triples: DataFrame) -> tuple[Staged, int]:
    """(i, name) by dense rank of the triples, and the number of names."""
    spark, keys = triples.sparkSession, ["a", "b", "c"]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = triples.repartitionByRange(n, *keys).withColumn("part", F.spark_partition_id())
    local = Staged(ranged.withColumn("name", F.dense_rank().over(Window.partitionBy("part").orderBy(*keys)).cast("long")), "names-local")
    starts, at = [], 0
    for r in local.df.groupBy("part").agg(F.max("name").alias("most")).orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["most"]
    table = spark.createDataFrame(starts or [(0, 0)], "part int, start long")
    found = Staged(local.df.join(F.broadcast(table), "part").select("i", (F.col("name") + F.col("start") - 1).alias("name")), "names")
    local.drop()
    return found, at


def _small(text: DataFrame) -> DataFrame:
    """Ranks of a short string, in one task."""

    def run(pdf):
        order = suffix_order(pdf.sort_values("i")["c"].to_numpy())
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return pdf.sort_values("i")[["i"]].assign(rank=rank)

    return text.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(run, "i long, rank long")


def suffix_ranks(text: DataFrame, n: int, one_task: int = ONE_TASK) -> Staged:
    """(i, rank) of every suffix of the string (i, c) of n symbols, numbers of 1 and more."""
    if n <= max(one_task, 3):
        return Staged(_small(text.select(F.col("i").cast("long").alias("i"), F.col("c").cast("long").alias("c"))), "short-ranks")
    ahead = lambda k, name: text.select((F.col("i") - k).alias("i"), F.col("c").alias(name))
    joined = text.join(ahead(1, "c1"), "i", "left").join(ahead(2, "c2"), "i", "left")
    triples = Staged(joined.select("i", "c", F.coalesce("c1", F.lit(0)).alias("c1"), F.coalesce("c2", F.lit(0)).alias("c2")), "triples")
    sample = triples.df.where("i % 3 <> 0").select("i", F.col("c").alias("a"), F.col("c1").alias("b"), F.col("c2").alias("c"))
    names, different = _named(sample)
    ones, twos = (n + 1) // 3, n // 3
    if different == ones + twos:
        ranks = names.df.select("i", F.col("name").alias("rank"))
        below = None
    else:
        place = F.when(F.col("i") % 3 == 1, F.floor(F.col("i") / 3)).otherwise(F.floor(F.col("i") / 3) + ones + 1)
        string = names.df.select(place.alias("i"), (F.col("name") + 2).alias("c"))
        between = text.sparkSession.createDataFrame([(ones, 1)], "i long, c long")
        below = suffix_ranks(Staged(string.unionByName(between), "names-string").df, ones + 1 + twos, one_task)
        own = F.when(F.col("i") < ones, F.col("i") * 3 + 1).otherwise((F.col("i") - ones - 1) * 3 + 2)
        ranks = below.df.where(F.col("i") != ones).select(own.alias("i"), (F.col("rank") - 1).alias("rank"))
    behind = lambda k, name: ranks.select((F.col("i") - k).alias("i"), F.col("rank").alias(name))
    every = triples.df.join(ranks, "i", "left").join(behind(1, "r1"), "i", "left").join(behind(2, "r2"), "i", "left")
    every = Staged(every.select("i", "c", "c1", "rank", F.coalesce("r1", F.lit(-1)).alias("r1"), F.coalesce("r2", F.lit(-1)).alias("r2"), (F.col("i") % 3).alias("kind")), "ranked")
    rest = F.col("kind") == 0
    first = _placed(every.df.where("kind <> 2"), ["c", "r1"], {"before": rest, "sampled": ~rest}, "first-merge")
    second = _placed(every.df.where("kind <> 1"), ["c", "c1", "r2"], {"before": rest, "sampled": ~rest}, "second-merge")
    whole = first.df.where(rest).select("i", "before", "sampled").join(second.df.where(rest).select("i", F.col("sampled").alias("more")), "i")
    merged = whole.select("i", (F.col("before") + F.col("sampled") + F.col("more")).alias("rank"))
    for half, kind in ((first, 1), (second, 2)):
        merged = merged.unionByName(half.df.where(F.col("kind") == kind).select("i", (F.col("rank") + F.col("before")).alias("rank")))
    found = Staged(merged, "suffix-ranks")
    for table in (triples, names, every, first, second, *([below] if below else [])):
        table.drop()
    return found


def _symbols(length: int):
    """Rows of every byte of a text, its hashes over ``length`` bytes, and one symbol behind the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, text in zip(batch.column("start").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                data = np.frombuffer(text, np.uint8)
                n = len(data)
                hashes = []
                for salt in (0, 1):
                    up, down = _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n)
                    value = _scramble(BYTE_VALUE[data] + np.uint64(salt)) * up
                    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
                    ends = np.minimum(np.arange(n) + length, n)
                    hashes.append(((running[ends] - running[:-1]) * down).view(np.int64))
                whole = np.arange(n) + length <= n
                columns = [pa.array(start + np.arange(n + 1)), pa.array(np.concatenate((data.astype(np.int64) + 2, [1])))]
                columns += [pa.array(np.concatenate((h, [0])), mask=np.concatenate((~whole, [True]))) for h in hashes]
                yield pa.RecordBatch.from_arrays(columns, names=["i", "c", "h", "g"])

    return run


def repeated_windows(docs: DataFrame, length: int = LENGTH, one_task: int = ONE_TASK) -> DataFrame:
    """(i) of every window of ``length`` bytes that is also found earlier; ``docs`` has (start, text), the first place of each text in the whole string."""
    text = Staged(docs.where(F.octet_length("text") > 0).mapInArrow(_symbols(length), "i long, c long, h long, g long"), "symbols")
    n = text.df.count()
    ranks = suffix_ranks(text.df.select("i", "c"), n, one_task)
    ordered = ranks.df.join(text.df.where("h IS NOT NULL").select("i", "h", "g"), "i")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    local = Staged(ordered.repartitionByRange(parts, "rank").withColumn("part", F.spark_partition_id()), "ordered")
    by_rank = Window.partitionBy("part").orderBy("rank")
    ends = local.df.groupBy("part").agg(F.max_by(F.struct("h", "g"), "rank").alias("last")).orderBy("part").collect()
    lasts = [(b["part"], a["last"]["h"], a["last"]["g"]) for a, b in zip(ends, ends[1:], strict=False)]
    above = spark.createDataFrame(lasts, "part int, h_above long, g_above long")
    first = F.coalesce(F.lag("h").over(by_rank), F.col("h_above")), F.coalesce(F.lag("g").over(by_rank), F.col("g_above"))
    new = ~(F.col("h").eqNullSafe(first[0]) & F.col("g").eqNullSafe(first[1]))
    marked = local.df.join(F.broadcast(above), "part", "left").withColumn("new", new.cast("long"))
    numbered = _placed(marked.select("i", "rank", "new"), ["rank"], {"before": F.col("new") == 1}, "classes")
    classes = numbered.df.withColumn("class", F.col("before") + F.col("new"))
    least = classes.groupBy("class").agg(F.min("i").alias("least"), F.count("*").alias("n")).where("n > 1")
    return classes.join(least, "class").where("i > least").select("i")
