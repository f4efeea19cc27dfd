"""Mixing sources to target weights: fixed-length blocks of words, drawn for output shards by index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import WORD, running_totals, stored, with_defaults


def _permuted(df: DataFrame, x: str, n: str, out: str, *seed: Column | str, rounds: int = 4) -> DataFrame:
    """Add ``out``, the image of ``x`` in 0..n-1 under a pseudorandom permutation of that range given by ``seed``.

    A Feistel network on a grid just over n, walked until it falls inside the range. The grid has fewer than sqrt(n)+1
    points beyond n, so the walk ends. Its first step is plain columns, a round each, which Spark compiles; the rare rest loops.
    """
    n_ = F.col(n)
    df = df.withColumn("_a", F.ceil(F.sqrt(n_.cast("double"))).cast("long"))
    df = df.withColumn("_b", F.ceil(n_ / F.col("_a")).cast("long"))
    seed = [F.col(s) if isinstance(s, str) else s for s in seed]

    def halves(at: Column) -> tuple[Column, Column]:
        return at % F.col("_a"), F.floor(at / F.col("_a")).cast("long")

    def turned(own: Column, other: Column, size: str) -> Column:
        """One half after a round; all rounds hash alike."""
        return (own + F.pmod(F.xxhash64(F.lit(0), other, *seed), F.col(size))) % F.col(size)

    def step(at: Column) -> Column:
        bind = lambda f, v: F.element_at(F.transform(F.array(v), f), 1)  # noqa: E731  evaluates v once
        left, right = halves(at)
        pair = F.struct(left.alias("l"), right.alias("r"))
        for i in range(rounds):
            if i % 2 == 0:
                f = lambda p: F.struct(turned(p["l"], p["r"], "_a").alias("l"), p["r"].alias("r"))
            else:
                f = lambda p: F.struct(p["l"].alias("l"), turned(p["r"], p["l"], "_b").alias("r"))
            pair = bind(f, pair)
        return bind(lambda p: p["l"] + p["r"] * F.col("_a"), pair)

    left, right = halves(F.col(x))
    df = df.withColumns({"_l": left, "_r": right})
    for i in range(rounds):
        own, other, size = ("_l", "_r", "_a") if i % 2 == 0 else ("_r", "_l", "_b")
        df = df.withColumn(own, turned(F.col(own), F.col(other), size))
    df = df.withColumn(out, F.col("_l") + F.col("_r") * F.col("_a")).drop("_l", "_r")
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(202)), F.col(out), lambda at, _: F.when(at < n_, at).otherwise(step(at)))
    return df.withColumn(out, F.when(F.col(out) < n_, F.col(out)).otherwise(walk)).drop("_a", "_b")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``: shares of ``total_share`` of all sizes by weight.

    Sources in code point order, null last, take the weights in turn. A target stops at ``most`` times its source's
    size; the excess is shared again by weight among the others until none is above. That is water filling: target =
    min(most * size, level * weight), with the level found from the sources ordered by size / weight. The windows run
    over one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    df = sizes.withColumn("_w", F.element_at(kinds, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    by = Window.orderBy((F.col("source_size") / F.col("_w")), F.col("source").isNull(), F.col("source"))
    before, all_rows = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    df = (
        df.withColumn("_all", F.sum("source_size").over(all_rows) * total_share)
        .withColumn("_full", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
        # From the first source on whose cap is above the level, nobody is capped.
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("source_size") * most)
        .withColumn("_level", F.min(F.when(F.col("_open"), F.struct(F.col("source_size") / F.col("_w"), F.col("_level").alias("v")))).over(all_rows)["v"])
    )
    return df.withColumn(
        "target", F.least(F.col("source_size") * most, F.coalesce(F.col("_level") * F.col("_w"), F.col("source_size") * most))
    ).drop("_w", "_all", "_full", "_rest", "_level", "_open")


def mix(
    docs: DataFrame, block: int = 128, slots_per_shard: int = 4096, rows_per_bucket: int = 2_000, seed: int = 7,
    weights: tuple[float, ...] = (5, 2, 1), total_share: float = 1.5, row: str | None = None, slots_per_task: int = 250_000,
) -> tuple[DataFrame, DataFrame]:
    """``(rows, slots)``: the documents' places in their sources' blocks, and the mix itself.

    ``rows``: ``row, doc_id, source, size, source_size, target, n_blocks, at`` with ``at`` the words of the source before
    this document. ``slots``: ``shard, slot, source, block, pass``: the block of ``block`` words that fills a slot, and how often
    its source was gone through before.

    The words of a source form a queue cut into blocks. The mix has as many slots as the targets need, dealt to shards of
    ``slots_per_shard``. Counts per shard are multinomial draws on condition that they add up to the targets, to within half a
    block: each slot draws a different one of the mix's numbers by a pseudorandom permutation, and each source owns a stretch of
    them. Their variance is that of free draws times the share of slots that lie outside the shard; free draws alone
    would miss the targets and could take a block a third time.
    The r-th slot of a source takes the block to which a pseudorandom permutation of that source's
    block numbers, another one for each pass, sends r. Blocks are joined by number. A block is used at most twice as targets stop at twice the size.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated rows
    each keep their own place. Other columns are ignored. Only totals per source are gathered, in SQL. Everything
    hangs on hashes of contents and of ``seed``; reruns agree. The word counts are written once. ``row`` names a column that numbers
    the rows, if there is one.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    docs = with_defaults(docs, doc_id="long", source="string", text="string", **({row: "long"} if row else {}))
    counted = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("_mark"), number.alias("row"))
    # Copies of a row share a number; among them any order gives the same result.
    counted = stored(counted, "sizes")
    shared = targets(counted.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_share)
    shared = shared.withColumn("n_blocks", F.ceil(F.col("source_size") / block).cast("long"))
    shared = shared.withColumn("n_slots", F.when(F.col("source_size") > 0, F.round(F.col("n_blocks") * F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source")).rowsBetween(Window.unboundedPreceding, -1)
    shared = shared.withColumn("first", F.coalesce(F.sum("n_slots").over(order), F.lit(0)))
    shared = shared.withColumn("all_slots", F.sum("n_slots").over(Window.partitionBy(F.lit(1))))
    shared = stored(shared, "targets")

    most = counted.groupBy("source").count().agg(F.max("count")).first()[0] or 1
    rows = running_totals(counted, ["source"], ["doc_id", "_mark"], "row", "size", "at", max(1, -(-most // rows_per_bucket)))
    rows = rows.join(shared, rows["source"].eqNullSafe(shared["source"])).select(
        rows["row"], rows["doc_id"], rows["source"], "size", "source_size", "target", "n_blocks", "at"
    )

    n = int(shared.agg(F.max("all_slots")).first()[0] or 0)
    spark = docs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // slots_per_task))
    slots = spark.range(0, n, 1, tasks).withColumn("n", F.lit(n).cast("long"))
    slots = _permuted(slots, "id", "n", "draw", F.lit(seed))
    # The draw falls into one source's stretch of the grid; stretches are cut at steps to make this an equality join.
    width = max(1, n // 256)
    steps = shared.where("n_slots > 0").withColumn(
        "step", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n_slots") - 1) / width)))
    )
    slots = slots.withColumn("step", F.floor(F.col("draw") / width)).join(steps, "step").where("draw >= first and draw < first + n_slots")
    slots = slots.withColumn("rank", F.col("draw") - F.col("first")).withColumn("pass", F.floor(F.col("rank") / F.col("n_blocks")))
    slots = slots.withColumn("place", F.col("rank") % F.col("n_blocks"))
    slots = _permuted(slots, "place", "n_blocks", "block", F.lit(seed), "source", "pass")
    return rows, slots.select(F.floor(F.col("id") / slots_per_shard).alias("shard"), F.col("id").alias("slot"), "source", "block", "pass")


def place(rows: DataFrame, slots: DataFrame, block: int = 128) -> DataFrame:
    """Joins blocks by number: ``row, block, lo, hi, uses``, the words lo..hi of a document lying in a used block.

    ``source`` and ``block`` together spread a hot source over all tasks. Uses are counted before the join, so no slot repeats
    a document's row.
    """
    uses = slots.groupBy("source", "block").agg(F.count("*").alias("uses"))
    cut = rows.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block)))
    )
    cut = cut.select(
        "row", "source", "block", F.greatest(F.col("block") * block - F.col("at"), F.lit(0)).alias("lo"),
        F.least((F.col("block") + 1) * block - F.col("at"), F.col("size")).alias("hi"),
    )
    on = cut["source"].eqNullSafe(uses["source"]) & (cut["block"] == uses["block"])
    return cut.join(uses, on).select("row", cut["block"], "lo", "hi", "uses")


def taken(rows: DataFrame, slots: DataFrame, block: int = 128) -> DataFrame:
    """``rows`` plus ``taken``, the words the mix takes of each document, repeats counted."""
    sums = place(rows, slots, block).groupBy("row").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("taken"))
    return rows.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    rows, slots = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(rows, slots).select("doc_id", "size", "source_size", "target", "taken", "source")
