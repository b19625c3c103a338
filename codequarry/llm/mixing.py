"""Mixing sources to target weights by Sainte-Laguë apportionment.

The mix is dealt out in equal blocks of ``BLOCK`` words.  Blocks go to sources
and then, within a source, to shards by highest quotient weight / (2 * seats +
1), which gives integer quotas.  In a shard the documents stand in a seeded
order and their words form a ring cut into blocks; the quota is filled by whole
passes over the shard and, for the rest, by consecutive blocks from a seeded
one on.  Shards hold about ``SHARD`` words and are dealt to in bins of about
``BIN`` (source, bin, shard), so a source of any size is spread over many tasks
and none is gathered anywhere.  Only the sources themselves, one row each, are
ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from codequarry.scratch import Scratch

BLOCK = 32
SHARD = 1_000_000
#: Shards of a source that are dealt to at once.
BIN = 1000
MOST = 3
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def _number(*parts: Column) -> Column:
    """60 bits of the md5 of the parts, as a seeded draw that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def apportion(df: DataFrame, by: list[str], key: str, weight: str, seats: str, out: str = "quota") -> DataFrame:
    """Deal ``seats`` (equal in all rows of a ``by`` group) by highest quotient.

    Adds bigint ``out``.  The rows start with their weight rounded to seats;
    what is then missing or too much (at most half a seat a row) goes by
    quotients.  The divisor at which the seats come out lies between the sum of
    the weights over seats + rows / 2 and over seats - rows / 2, so a row of
    share s moves by less than s * rows / 2 + 1 seats: so many quotients are
    listed, at most 3.5 a row on average, and none that can win is left out.
    Ties go to the lesser ``key``, null last.  Weights are non-negative; a group
    whose weights are all 0 gets none.
    """
    group = W.partitionBy(*by)
    base = df.withColumn("__place", F.row_number().over(group.orderBy(F.col(key).asc_nulls_last()))).withColumn("__sum", F.sum(weight).over(group)).withColumn("__exact", F.expr(f"case when __sum > 0 then {weight} * {seats} / __sum else 0D end"))
    base = base.withColumn("__first", F.floor(F.col("__exact") + 0.5)).withColumn("__gap", F.when(F.col("__sum") > 0, F.col(seats) - F.sum("__first").over(group)).otherwise(F.lit(0)))
    base = base.withColumn("__rows", F.count("*").over(group))
    chance = F.expr(f"cast(ceil(case when __sum > 0 then {weight} / __sum else 0D end * __rows / 2) as bigint) + 2")
    tries = base.where("__gap <> 0").withColumn("__j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.abs("__gap"), chance))))
    quotient = F.expr(f"case when __gap > 0 then -({weight}) / (2 * (__first + __j) - 1) when __first >= __j then ({weight}) / (2 * (__first - __j) + 1) end")
    ranked = tries.withColumn("__q", quotient).where("__q is not null").withColumn("__rank", F.row_number().over(group.orderBy("__q", F.col("__place") * F.signum("__gap"), "__j")))
    names = {c: f"__k{n}" for n, c in enumerate((*by, key))}
    won = ranked.where("__rank <= abs(__gap)").groupBy(*[F.col(c).alias(n) for c, n in names.items()]).agg(F.sum(F.signum("__gap")).cast("bigint").alias("__won"))
    same = F.lit(True)
    for c, n in names.items():
        same = same & F.col(c).eqNullSafe(F.col(n))
    return base.join(won, same, "left").select(*df.columns, (F.col("__first") + F.coalesce("__won", F.lit(0))).cast("bigint").alias(out))


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to rows (source, size: bigint), one for each source.

    Weights 1, 2, 3, 1, ... in code point order, null last, share the sum of all
    sizes; no target is above ``MOST`` times its source's size, and the excess
    goes to the others by weight: target = min(cap, level * weight), where the
    level follows from the sources in order of cap / weight.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("weight", (F.row_number().over(order) - 1) % 3 + 1).withColumn("cap", F.col("size") * MOST)
    whole = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = whole.rowsBetween(W.unboundedPreceding, -1), whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    tried = weighed.withColumn("level", left / open_weight)
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"]
    return tried.withColumn("level", level).select("source", "size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame, seed: int = SEED, label: str = "mixing") -> DataFrame:
    """Words taken from every document by the mix.

    Needs ``doc_id``, ``text`` and ``source``; other columns are not read.
    Result: doc_id, source, size (words of the text; null: 0), source_size,
    target (its source's), taken (words, repeats counted; at most three times
    the size).  A null source is a source of its own, last in order.  Repeated
    rows count each.  Empty input, empty result.  The same input and seed give
    the same mix, however the input is partitioned.
    """
    scratch = Scratch(docs.sparkSession, label)
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), _number(F.lit(str(seed)), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("spot"))
    sized = scratch.save(sized, "sizes")
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("size")))
    whole = sources.withColumn("all", F.sum("target").over(W.partitionBy())).withColumn("seats", F.round(F.col("all") / BLOCK).cast("bigint")).withColumn("one", F.lit(1))
    quotas = scratch.save(apportion(whole, ["one"], "source", "target", "seats").select("source", F.col("size").alias("source_size"), "target", "quota", F.greatest(F.ceil(F.col("size") / SHARD), F.lit(1)).alias("shards")), "quotas")

    dealt = sized.join(quotas.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("shard", F.pmod("spot", "shards"))
    bins = F.ceil(F.col("shards") / BIN)
    shards = scratch.save(dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("seats"), F.first(F.pmod("shard", bins)).alias("bin")), "shards")
    parts = apportion(shards.groupBy("source", "bin").agg(F.sum("words").alias("words"), F.first("seats").alias("seats")), ["source"], "bin", "words", "seats")
    parts = parts.select(F.col("source").alias("s"), F.col("bin").alias("b"), F.col("quota").alias("seats"))
    shards = shards.drop("seats").join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b"))).drop("s", "b")
    plan = apportion(shards, ["source", "bin"], "shard", "words", "seats")
    plan = plan.select(F.col("source").alias("s"), F.col("shard").alias("h"), "words", F.least(F.col("quota") * BLOCK, F.col("words") * MOST).alias("take"))
    plan = scratch.save(plan.withColumn("__draw", _number(F.lit(str(seed)), F.col("s"), F.col("h").cast("string"))).withColumn("start", F.expr(f"case when words > 0 then __draw % ceil(words / {BLOCK}) * {BLOCK} else 0 end")).drop("__draw"), "plan")

    run = W.partitionBy("source", "shard").orderBy("spot", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("to", F.sum("size").over(run)).withColumn("at", F.col("to") - F.col("size"))
    placed = placed.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("h")))
    rest = "take % greatest(words, 1)"
    lap = lambda a, b: f"greatest(0, least(`to`, {b}) - greatest(`at`, {a}))"
    taken = F.expr(f"size * (take div greatest(words, 1)) + {lap('start', f'start + {rest}')} + {lap('start - words', f'start - words + {rest}')}")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))
