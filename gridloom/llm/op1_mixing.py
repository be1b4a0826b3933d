"""Mixing sources to target weights by Sainte-Lague apportionment. DataFrame operations only.

Targets are words: every source asks for its weight's share of the budget, stops at twice its size,
and the excess is shared again by weight. Blocks of BLOCK words are then seats: sources, within
them groups of shards, within those shards, each get whole seats by the highest quotients
claim / (2 seats + 1). A shard lays its documents end to end in seeded order, cut into blocks, and
takes as many blocks as its quota says, by a seeded permutation of their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, read_documents, stashed

#: Words of a block, words of a shard, shards of a group.
BLOCK, SHARD, GROUP = 8, 1 << 18, 1024
SEED = "mix-1"
WEIGHTS = (3, 1, 2)
BUDGET, MOST = 1.5, 2
#: A prime that turns block numbers into a seeded order: it has no common factor with their count.
STRIDE = 1_610_612_741
WORD = r"[^\x20\x09-\x0D]+"


def _hash31(*parts: Column) -> Column:
    """31 bits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long") % (1 << 31)


def targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size) to the same and weight, target. One row a source; the only windows over all sources are here."""
    by_name = Window.orderBy("src")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    everything = Window.partitionBy()
    ranked = ranked.withColumn("cap", MOST * F.col("source_size").cast("double")).withColumn("budget", BUDGET * F.sum("source_size").over(everything).cast("double"))
    # those that reach their cap at the lowest level of words a weight come first
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("n", F.row_number().over(order)).withColumn("level", level)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("n", "level"))
    last = leveled.withColumn("level", F.min(fits).over(everything)["level"])
    return last.select("src", "source_size", "weight", "budget", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


def apportion(parties: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Seats of each party: adds `quota` to rows with claim, cap (most seats) and seats (of the whole parent).

    Seats that a party gets under any divisor near the right one are given at once; only the few between
    (three a party at most) are ranked by their quotients, ties by `order`.
    """
    whole = Window.partitionBy(*parent)
    p = parties.withColumn("_sum", F.sum("claim").over(whole)).withColumn("_k", F.count("*").over(whole))
    share = lambda n: F.when(F.col("_sum") > 0, F.col("claim") * n / F.col("_sum")).otherwise(0.0)
    p = p.withColumn("_lo", F.least("cap", F.greatest(F.lit(0).cast("long"), F.ceil(share(F.col("seats") - F.col("_k")) - 0.5))))
    p = p.withColumn("_hi", F.greatest("_lo", F.least("cap", F.floor(share(F.col("seats") + F.col("_k")) + 0.5))))
    p = p.withColumn("_free", F.col("seats") - F.sum("_lo").over(whole))
    open_seats = p.where("_hi > _lo").select(*parent, order, "claim", "_free", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_s"))
    by_quotient = Window.partitionBy(*parent).orderBy(F.desc(F.col("claim") / (2 * F.col("_s") + 1)), order)
    won = open_seats.withColumn("_r", F.row_number().over(by_quotient)).where("_r <= _free").groupBy(*parent, order).agg(F.count("*").alias("_won"))
    return p.join(won, [*parent, order], "left").withColumn("quota", F.col("_lo") + F.coalesce("_won", F.lit(0))).drop("_sum", "_k", "_lo", "_hi", "_free", "_won", "claim", "cap", "seats")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """One row per row: doc_id, size, source_size, target, taken, and the columns in `keep`, by which rows of one id and size are ordered.

    Sources by code point, null last (a source of its own), weigh 3, 1, 2, repeating. A null or empty text has
    size 0 and gives nothing. Documents of one id keep their own rows; other columns are not read. An empty
    table gives an empty result. Equal input gives equal output whatever the partitions.
    """
    # a null source sorts after all names
    src = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    keep = keep or []
    sized = stashed(docs.select(*keep, F.col(id_col).alias("doc_id"), src.alias("src"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = targets(sized.groupBy("src").agg(F.sum("size").alias("source_size")))
    blocks = lambda words: F.ceil(words / BLOCK)
    seats = sources.select("src", "source_size", "target", F.col("target").alias("claim"), (MOST * blocks(F.col("source_size"))).alias("cap"), F.floor(F.col("budget") / BLOCK + 0.5).alias("seats"), F.lit(0).alias("all"))
    quotas = stashed(apportion(seats, ["all"], "src").withColumnRenamed("quota", "source_quota"))

    per_source = bounded(quotas.select("src", "source_size", "target", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD)).alias("shards")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = sized.join(per_source, "src").withColumn("shard", _hash31(F.lit("shard"), name) % F.col("shards")).withColumn("group", F.floor(F.col("shard") / GROUP))

    shards = dealt.groupBy("src", "group", "shard").agg(F.sum("size").alias("words"))
    groups = shards.groupBy("src", "group").agg(F.sum("words").alias("claim"), F.sum(MOST * blocks(F.col("words"))).alias("cap"))
    groups = apportion(groups.join(quotas.select("src", F.col("source_quota").alias("seats")), "src"), ["src"], "group").withColumnRenamed("quota", "seats")
    claims = shards.withColumn("claim", F.col("words")).withColumn("cap", MOST * blocks(F.col("words"))).join(groups, ["src", "group"])
    quota = apportion(claims, ["src", "group"], "shard").select("src", "group", "shard", "words", "quota")

    line = Window.partitionBy("src", "group", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(SEED), name)), "doc_id", "size", *keep)
    laid = dealt.withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    full = laid.join(quota, ["src", "group", "shard"]).withColumn("blocks", F.greatest(F.lit(1), blocks(F.col("words"))))
    full = full.withColumn("turns", F.floor(F.col("quota") / F.col("blocks"))).withColumn("more", F.col("quota") % F.col("blocks"))
    full = full.withColumn("shift", _hash31(F.lit("blocks"), "src", F.col("shard").cast("string")))
    end = F.col("start") + F.col("size")
    chosen = lambda b: F.pmod(b * STRIDE + F.col("shift"), F.col("blocks")) < F.col("more")
    overlap = lambda b: F.least(end, (b + 1) * BLOCK) - F.greatest(F.col("start"), b * BLOCK)
    numbers = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK))
    part = F.aggregate(numbers, F.lit(0).cast("long"), lambda n, b: n + F.when(chosen(b), overlap(b)).otherwise(F.lit(0).cast("long")))
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("turns") * F.col("size") + F.when(F.col("more") > 0, part).otherwise(F.lit(0).cast("long")))
    return full.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *keep)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_documents(spark, sf_dir))
