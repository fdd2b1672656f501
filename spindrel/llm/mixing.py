"""Mixing sources to target weights (native: DataFrame operations only).

Sainte-Lague apportionment in three levels.  Sources compete for equal-token blocks with
their target sizes as votes; then groups of the shards of a source compete for its blocks, and
the shards of a group for the group's, with their sizes as votes.  A shard is a bounded slice of a
source in a seeded order, and takes a run of consecutive blocks (cyclic, from a seeded
position) as often as its quota says, so what every document contributes is plain interval
arithmetic: no row per block exists.  A source has as many groups as a group has shards, so no
window holds more than the documents of a shard, the root of the number of a source's shards,
or one row for each source.

Highest quotients exactly, without a row per seat: with V votes, S seats and n parties,
the divisor V/(S - n/2) hands out at most S seats and V/(S + n/2) at least S.  Every party
surely holds the seats of the first and never more than those of the second, and only
the at most 2n quotients between the two are ranked.

Defined results: a null or empty text has size 0 and takes 0; a null source is the last
source; a null id is an id like others, as the order goes by id and text; repeated rows count
as documents of their own; ties between quotients go to the earlier source, group or shard; a
very long text is a document like others, alone in its shard if it is larger than one; no rows
give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrel.llm.common import WORD, materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK = 4
SHARD_WORDS = 1 << 18
SEED = 7


def _digest(id_col: str, text_col: str, seed: int) -> Column:
    """Of id and text: rows that share an id, or have none, do not all fall into one shard."""
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text))


def _number(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source of ``sizes`` (src, nil, size): source_size, weight and capped target.

    Sharing the excess again by weight until no source is above its cap fills all
    sources to one common level per weight.  Sources are capped in the order of cap per
    weight, so the level follows from running sums over the sorted sources.
    """
    by = sizes.groupBy("nil", "src").agg(F.sum("size").alias("source_size"))
    order = W.orderBy("nil", "src")
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filled = W.orderBy(F.col("cap") / F.col("weight"), "nil", "src")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    by = by.withColumn("level", left / open_weight).withColumn("place", F.row_number().over(filled))
    # the first source in filling order whose cap is above the level ends the capping
    ends = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("place", "level"))
    free = F.min(ends).over(everything)["level"]
    return by.withColumn("target", F.least(F.col("cap"), F.coalesce(free * F.col("weight"), F.col("cap")))).select(
        "nil", "src", "source_size", "weight", "target"
    )


def apportion(parties: DataFrame, votes: str, seats: Column, within: list[str], order: list[str], name: str) -> DataFrame:
    """Add the integer quota ``name``: ``seats`` dealt by highest quotients votes/(2k-1)."""
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    total, n = F.sum(votes).over(group), F.count(F.lit(1)).over(group)
    p = parties.withColumn("_s", seats.cast("double")).withColumn("_v", total).withColumn("_n", n)
    seated = lambda s: F.when((F.col("_v") > 0) & (s > 0), F.floor(F.col(votes) * s / F.col("_v") + 0.5)).otherwise(0)
    p = p.withColumn("_low", seated(F.col("_s") - F.col("_n") / 2).cast("long"))
    p = p.withColumn("_high", F.greatest("_low", seated(F.col("_s") + F.col("_n") / 2).cast("long")))
    p = p.withColumn("_left", F.col("_s").cast("long") - F.sum("_low").over(group))
    keys = [*within, *order]
    open_seats = (
        p.where("_high > _low")
        .select(*keys, "_left", F.col(votes).alias("_w"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
        .withColumn("_at", F.row_number().over(group.orderBy(F.desc(F.col("_w") / (2 * F.col("_k") - 1)), *order, "_k")))
        .where("_at <= _left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_more"))
    )
    return p.join(open_seats, keys, "left").withColumn(name, F.col("_low") + F.coalesce("_more", F.lit(0))).drop(
        "_s", "_v", "_n", "_low", "_high", "_left", "_more"
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    return _mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def _mixed(
    docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=SHARE, most=MOST,
    block=BLOCK, shard_words=SHARD_WORDS, seed=SEED,
) -> DataFrame:
    """What ``mix`` returns, with nil, src and digest of the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes, _ = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).isNull().alias("nil"),
            F.coalesce(F.col(source_col), F.lit("")).alias("src"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
            _digest(id_col, text_col, seed).alias("digest"),
        )
    )
    goal, _ = materialize(
        apportion(
            targets(sizes, weights, share, most), "target",
            F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block), [], ["nil", "src"], "blocks",
        )
        .withColumn("shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_words).cast("long"))
        .withColumn("groups", F.ceil(F.sqrt("shards")).cast("long"))
    )
    laid = sizes.join(goal, ["nil", "src"]).withColumn("shard", _number(F.col("digest"), 1, 8) % F.col("shards"))
    laid = laid.withColumn("grp", F.col("shard") % F.col("groups"))
    shards, _ = materialize(laid.groupBy("nil", "src", "grp", "shard").agg(F.sum("size").alias("words"), F.first("blocks").alias("source_blocks")))
    groups = shards.groupBy("nil", "src", "grp").agg(F.sum("words").alias("votes"), F.first("source_blocks").alias("source_blocks"))
    held = apportion(groups, "votes", F.col("source_blocks"), ["nil", "src"], ["grp"], "group_blocks").select("nil", "src", "grp", "group_blocks")
    quota = apportion(shards.join(held, ["nil", "src", "grp"]), "words", F.col("group_blocks"), ["nil", "src", "grp"], ["shard"], "quota")
    # whole turns of the shard, then a seeded run of consecutive blocks
    whole = F.ceil(F.col("words") / block).cast("long")
    start = _number(F.md5(F.concat(F.lit(f"{seed}#"), F.col("src"), F.lit("#"), F.col("shard").cast("string"))), 1, 8)
    quota = (
        quota.withColumn("_whole", F.greatest(whole, F.lit(1)))
        .withColumn("quota", F.least(F.col("quota"), F.lit(int(most)) * F.col("_whole")))
        .withColumn("turns", F.floor(F.col("quota") / F.col("_whole")))
        .withColumn("_from", start % F.col("_whole"))
        .withColumn("_to", F.col("_from") + F.col("quota") % F.col("_whole"))
        .select(
            "nil", "src", "shard", "turns", "words",
            (F.col("_from") * block).alias("lo"),
            F.least(F.col("_to") * block, F.col("words")).alias("hi"),
            F.greatest(F.lit(0), (F.col("_to") - F.col("_whole")) * block).alias("wrapped"),
        )
    )
    run = W.partitionBy("nil", "src", "shard").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = laid.withColumn("_end", F.sum("size").over(run)).join(quota, ["nil", "src", "shard"])
    begin = F.col("_end") - F.col("size")
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("_end"), hi) - F.greatest(begin, lo))
    taken = F.col("turns") * F.col("size") + overlap(F.col("lo"), F.col("hi")) + overlap(F.lit(0), F.col("wrapped"))
    return placed.select("nil", "src", "digest", "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.cast("long").alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row as often as the mix takes its words, to the nearest whole.

    In a shard only the documents at the two ends of its run are taken in part, so a
    source misses its target by a document a shard at most.  Rows of one id, text and source
    share what is taken of them, the first by their other columns one copy more.
    """
    own = ["nil", "src", "digest"]
    rounded = F.round(F.sum("taken") / F.greatest(F.max("size"), F.lit(1))).cast("long")
    share = materialize(_mixed(docs).groupBy(*own).agg(F.count(F.lit(1)).alias("n"), rounded.alias("copies")).where("copies > 0"))[0]
    rows = docs.select(
        F.col("source").isNull().alias("nil"), F.coalesce(F.col("source"), F.lit("")).alias("src"), _digest("doc_id", "text", SEED).alias("digest"), F.struct("*").alias("_row")
    )
    uneven = F.col("copies") % F.col("n") != 0
    even = rows.join(share.where(~uneven), own).select("_row", (F.col("copies") / F.col("n")).cast("int").alias("times"))
    at = F.row_number().over(W.partitionBy(*own).orderBy(F.xxhash64("_row")))
    odd = rows.join(share.where(uneven), own).withColumn("_at", at)
    times = F.floor(F.col("copies") / F.col("n")) + (F.col("_at") <= F.col("copies") % F.col("n")).cast("int")
    repeated = even.union(odd.select("_row", times.cast("int").alias("times"))).where("times > 0")
    return repeated.select("_row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")


def _oracle() -> str:
    """DuckDB text of ``op5_mixing``: the same apportionment by windows."""

    def apportioned(name: str, parties: str, votes: str, seats: str, within: str, order: str) -> str:
        group = f"PARTITION BY {within}" if within else ""
        bound = lambda sign: f"CASE WHEN total > 0 AND s {sign} n / 2.0::DOUBLE > 0 THEN floor({votes} * (s {sign} n / 2.0::DOUBLE) / total + 0.5)::BIGINT ELSE 0 END"
        keys = ", ".join(x for x in (within, order) if x)
        return f"""
{name}0 AS (SELECT *, {seats}::DOUBLE AS s, sum({votes}) OVER ({group})::DOUBLE AS total, count(*) OVER ({group}) AS n FROM {parties}),
{name}1 AS (SELECT *, {bound("-")} AS low, {bound("+")} AS most FROM {name}0),
{name}2 AS (SELECT *, s::BIGINT - sum(low) OVER ({group}) AS seats_left, greatest(low, most) AS high FROM {name}1),
{name}3 AS (SELECT {keys}, {votes} AS v, seats_left, unnest(range(low + 1, high + 1)) AS k FROM {name}2 WHERE high > low),
{name}4 AS (SELECT *, row_number() OVER ({group} ORDER BY v / (2 * k - 1)::DOUBLE DESC, {order}, k) AS seat FROM {name}3),
{name}5 AS (SELECT {keys}, count(*) AS more FROM {name}4 WHERE seat <= seats_left GROUP BY {keys}),
{name} AS (SELECT {name}2.*, low + coalesce(more, 0) AS quota FROM {name}2 LEFT JOIN {name}5 USING ({keys}))"""

    weights = ", ".join(f"{w}.0" for w in WEIGHTS)
    return rf"""
WITH sizes AS (
  SELECT doc_id, source IS NULL AS nil, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
by0 AS (SELECT nil, src, sum(size)::BIGINT AS source_size FROM sizes GROUP BY 1, 2),
by1 AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY nil, src)) - 1) % {len(WEIGHTS)} + 1]::DOUBLE AS weight, source_size * {MOST}.0::DOUBLE AS cap FROM by0),
by2 AS (SELECT *, row_number() OVER f AS place,
  ((sum(source_size) OVER ()) * {SHARE}::DOUBLE - coalesce(sum(cap) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM by1 WINDOW f AS (ORDER BY cap / weight, nil, src)),
by3 AS (SELECT *, (SELECT arg_min(level, place) FROM by2 WHERE cap > level * weight) AS free FROM by2),
goal0 AS (SELECT nil, src, source_size, least(cap, coalesce(free * weight, cap)) AS target FROM by3),
goal1 AS (SELECT *, round((sum(target) OVER ()) / {BLOCK}) AS seats FROM goal0),
{apportioned("goal2", "goal1", "target", "seats", "", "nil, src")},
goal AS (SELECT nil, src, source_size, target, quota AS blocks, ceil(greatest(source_size, 1) / {SHARD_WORDS}.0)::BIGINT AS shards FROM goal2),
laid0 AS (SELECT *, ('0x' || substr(digest, 1, 8))::BIGINT % shards AS shard FROM sizes JOIN goal USING (nil, src)),
laid AS (SELECT *, shard % ceil(sqrt(shards))::BIGINT AS grp FROM laid0),
shards00 AS (SELECT nil, src, grp, shard, sum(size)::BIGINT AS words, min(blocks) AS source_blocks FROM laid GROUP BY 1, 2, 3, 4),
groups0 AS (SELECT nil, src, grp, sum(words)::BIGINT AS votes, min(source_blocks) AS source_blocks FROM shards00 GROUP BY 1, 2, 3),
{apportioned("groups1", "groups0", "votes", "source_blocks", "nil, src", "grp")},
shards0 AS (SELECT shards00.*, groups1.quota AS group_blocks FROM shards00 JOIN groups1 USING (nil, src, grp)),
{apportioned("shards1", "shards0", "words", "group_blocks", "nil, src, grp", "shard")},
run0 AS (SELECT nil, src, shard, words, greatest(ceil(words / {BLOCK}.0)::BIGINT, 1) AS whole, quota FROM shards1),
run1 AS (SELECT *, least(quota, {MOST} * whole) AS q, ('0x' || substr(md5('{SEED}#' || src || '#' || shard::VARCHAR), 1, 8))::BIGINT % whole AS first FROM run0),
run AS (SELECT nil, src, shard, q // whole AS turns, first * {BLOCK} AS lo, least((first + q % whole) * {BLOCK}, words) AS hi, greatest(0, (first + q % whole - whole) * {BLOCK}) AS wrapped FROM run1),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY nil, src, shard ORDER BY digest, size ROWS UNBOUNDED PRECEDING))::BIGINT AS finish FROM laid)
SELECT doc_id, size, source_size, target,
  (turns * size + greatest(0, least(finish, hi) - greatest(finish - size, lo)) + greatest(0, least(finish, wrapped) - greatest(finish - size, 0)))::BIGINT AS taken
FROM placed JOIN run USING (nil, src, shard)
"""


ORACLE = _oracle()
