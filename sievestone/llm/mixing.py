"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target divided by its size is the number of copies that each of its documents should have. The whole part is given
to all. The fractions are rounded by the pivotal method: two documents with fractions p and q trade mass, measured in words,
until one of them is integral; a hashed coin decides which way, so that each keeps its expected copies and the words of
the two stay the same. Documents are paired in small buckets; each bucket leaves one fraction at most, and these meet in the next
level's buckets, up to one per source. The source's words so miss the target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import saved

#: The mix has so many times the words of all rows; a source is repeated at most so often; weights repeat in order of sources.
SHARE, MOST = 1.5, 2.0
WEIGHTS = (5, 2, 1)
#: Mean number of documents or residuals in a bucket.
FAN_IN = 32
EPS = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: (source, size), a row for each document. A row for each source with its size and target in words.

    The excess over a source's limit goes to the others by weight until none is above, which is to fill all sources at rates
    by weight until each is full or the total is reached: sources are passed in order of the level at which they are full.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = each.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * most).withColumn("full", F.col("cap") / F.col("w"))
    order = Window.orderBy("full", "k")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    passed = filled.withColumn("level", level).withColumn("open", F.when(F.col("full") > F.col("level"), F.col("level")))
    found = passed.withColumn("final", F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return found.select("source", "source_size", F.coalesce(F.least("cap", F.col("final") * F.col("w")), "cap").alias("target"))


def _let(value: Column, body) -> Column:
    """body of value, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _trade(x: Column, y: Column, seed: str) -> Column:
    """The two units after one trade, as (done, left): done's p is 0 or 1. Both are fractional, so sizes are above 0."""
    r = y["size"] / x["size"]
    up, down = F.least(1 - x["p"], y["p"] * r), F.least(x["p"], (1 - y["p"]) * r)
    coin = F.pmod(F.xxhash64(F.lit(seed), x["key"], y["key"]), F.lit(1 << 40)) / F.lit(float(1 << 40))

    def settle(t: Column) -> Column:
        a = _clean(x["p"] + t["step"])
        b = _clean(y["p"] - t["step"] / r)
        new_x = F.struct(x["key"].alias("key"), x["size"].alias("size"), a.alias("p"))
        new_y = F.struct(y["key"].alias("key"), y["size"].alias("size"), b.alias("p"))
        integral = (a == 0) | (a == 1)
        return F.struct(F.when(integral, new_x).otherwise(new_y).alias("done"), F.when(integral, new_y).otherwise(new_x).alias("left"))

    return _let(F.struct(F.when(coin * (up + down) < down, up).otherwise(-down).alias("step")), settle)


def _clean(p: Column) -> Column:
    return F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)


UNIT = "struct<key:struct<doc_id:bigint,copy:int>,size:bigint,p:double>"


def _round_buckets(units: DataFrame, seed: str) -> DataFrame:
    """units: (source, bucket, u). Each bucket's units after all trades, of which one may be still fractional: (source, bucket, u)."""
    lists = units.groupBy("source", "bucket").agg(F.sort_array(F.collect_list("u")).alias("us"))
    start = F.struct(F.expr(f"CAST(array() AS array<{UNIT}>)").alias("done"), F.expr(f"CAST(NULL AS {UNIT})").alias("left"))

    def step(acc: Column, x: Column) -> Column:
        fresh = acc["left"].isNull() | (acc["left"]["p"] == 0) | (acc["left"]["p"] == 1)
        alone = F.struct(F.when(acc["left"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["left"]))).alias("done"), x.alias("left"))
        both = _let(_trade(acc["left"], x, seed), lambda t: F.struct(F.concat(acc["done"], F.array(t["done"])).alias("done"), t["left"].alias("left")))
        return F.when(fresh, alone).otherwise(both)

    return lists.select("source", "bucket", F.explode(F.aggregate("us", start, step, lambda a: F.concat(a["done"], F.array(a["left"])))).alias("u"))


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: float = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, copy, size, source_size, target, copies, taken) for each row of docs.

    size is the number of words (null text: 0), target its source's, copies 0 to `most`, taken = copies * size. A null source is
    a source. copy numbers rows with equal id, source and size from 1; which of them has which number is left open. Rows without
    words have the whole part of the copies. The coins are hashes of ids and of `seed`: reruns agree. No rows give no rows.

    Buckets are by hash and of bounded mean size whatever the source's size, so a source with a third of all rows has as
    many more buckets. Texts are never shuffled.
    """
    spark = docs.sparkSession
    counted = saved(word_counts(docs, id_col, text_col, source_col), "counted")
    same = Window.partitionBy("doc_id", "source", "size").orderBy(F.lit(1))
    rows = counted.withColumn("copy", F.row_number().over(same))
    targets = source_targets(counted, weights, share, most)
    numbers = counted.groupBy("source").agg(F.count("*").alias("n")).withColumn("buckets", F.ceil(F.col("n") / FAN_IN))
    info = saved(targets.join(numbers, targets["source"].eqNullSafe(numbers["source"])).select(targets["source"], "source_size", "target", "buckets"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    part = info.select(F.col("source").alias("s"), "source_size", "target", "buckets", rate.alias("rate"))
    level = saved(
        rows.join(part, rows["source"].eqNullSafe(part["s"]))
        .withColumn("whole", F.floor(F.col("rate") + EPS))
        .withColumn("p", F.when(F.col("size") > 0, _clean(F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))).otherwise(0.0))
        .withColumn("key", F.struct("doc_id", "copy"))
        .select("source", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "copy"), F.col("buckets")).alias("bucket"), F.struct("key", "size", "p").alias("u")),
        "units",
    )
    most_buckets = info.agg(F.max("buckets")).first()[0] or 1
    open_ = (F.col("u.p") > 0) & (F.col("u.p") < 1)
    # Rows without words, and those of whole rates, have nothing to trade.
    settled, level, depth = level.where(~open_).select("source", "u"), level.where(open_), 0
    while True:
        after = saved(_round_buckets(level, f"{seed}-{depth}"), "rounded")
        last = most_buckets <= 1
        if last:  # one residual per source: its own coin
            coin = F.pmod(F.xxhash64(F.lit(seed), F.col("u.key")), F.lit(1 << 40)) / F.lit(float(1 << 40))
            after = after.withColumn("u", F.when(open_, F.struct("u.key", "u.size", F.when(coin < F.col("u.p"), 1.0).otherwise(0.0).alias("p"))).otherwise(F.col("u")))
            done = after
        else:
            done = after.where(~open_)
        settled = settled.unionByName(done.select("source", "u"))
        if last:
            break
        level = after.where(open_).select("source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), "u")
        most_buckets, depth = -(-most_buckets // FAN_IN), depth + 1
    copies = (F.floor(F.col("rate") + EPS) + F.col("u.p")).cast("long")
    return settled.join(part, settled["source"].eqNullSafe(part["s"])).select(
        F.col("u.key.doc_id").alias("doc_id"), "source", F.col("u.key.copy").alias("copy"), F.col("u.size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("u.size")).alias("taken")
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns as they are, whatever their names, with each row as often as the mix has copies of it; no rows give none."""
    id_col, text_col, source_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source")))
    decided = saved(mix(docs, **options).select("doc_id", "source", "size", "copy", "copies"), "decided")
    size = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.struct(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size")).alias("key"))
    decided = decided.select(F.struct("doc_id", "source", "size").alias("key"), "copy", "copies")
    if (decided.agg(F.max("copy")).first()[0] or 1) > 1:
        keyed = keyed.withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1))))
    else:
        keyed = keyed.withColumn("copy", F.lit(1))
    few = decided.limit((1 << 19) + 1).count() <= 1 << 19
    taken = keyed.join(F.broadcast(decided) if few else decided, ["key", "copy"])
    return taken.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select("row.*")
