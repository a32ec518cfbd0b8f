"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: every source may take its weight's share of all words, but at most ``repeat`` times its own words; what
   it cannot take is shared out again by weight. That is one water level over the sources.
2. Quotas: blocks of ``block`` words go to the sources with the highest quotients target / (2 k + 1). A level that
   surely lies above the last winning quotient gives most seats at once; only the seats between it and a level
   surely below, two per source at most, are ranked.
3. A source is cut into shards by a hash; its blocks go to the shards in the same way, by words.
4. Within a shard the documents lie end to end in seeded order and are cut into blocks. All blocks are taken
   quota // blocks times, and a seeded even pick of them once more. A document takes the words of its blocks, which
   has a closed form, so no row per block is ever made.

Only per-source and per-shard rows meet in windows; documents are ordered within their shard alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.text import prepare, words_of
from tickloom.session import checkpoint

WEIGHTS = (5, 2, 1)  # by code point of the source, repeating
REPEAT = 3
BLOCK = 32
SHARD_ROWS = 2_000
SEED = 17
SLACK = 1e-9  # widens the levels against rounding; the ranked seats decide


def _place(*parts: Column) -> Column:
    """A seeded 32-bit place, from md5, which other engines have as well."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeat: int = REPEAT) -> DataFrame:
    """``sized(source, size)`` -> one row per source: ``source, pos, n_rows, source_size, weight, target``."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    placed = sums.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))
    picked = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    rows = placed.withColumn("weight", picked).withColumn("most", (F.col("source_size") * repeat).cast("double"))
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    rows = rows.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), zero))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)),
    )
    # the first source that the water does not fill sets the level for all
    level = F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "pos"))).over(every)
    rows = rows.withColumn("target", F.least("most", F.coalesce(level, zero) * F.col("weight")))
    return rows.select("source", "pos", "n_rows", "source_size", "weight", "target")


def apportion(parties: DataFrame, seats: Column, size: str, within: list[str], order: list[str]) -> DataFrame:
    """Add ``quota``: ``seats`` of each group ``within`` go to the highest ``size`` / (2 k + 1), ties by ``order``."""
    group = Window.partitionBy(*within)
    # levels are quotients over 2: with D above the last winner every party has round(size / D) seats for sure
    total, n = F.sum(size).over(group), F.count("*").over(group)
    spare = F.col("seats") - n / 2
    high = F.when(spare > 0, total / F.when(spare > 0, spare) * (1 + SLACK))
    low = total / (F.col("seats") + n / 2) * (1 - SLACK)
    share = lambda d: F.floor(F.col(size) / F.when(d > 0, d) + 0.5).cast("long")
    rows = parties.withColumn("seats", seats.cast("long"))
    rows = rows.withColumn("sure", F.coalesce(share(high), F.lit(0).cast("long"))).withColumn("upto", F.coalesce(share(low), F.lit(0).cast("long")))
    rows = rows.withColumn("open", F.col("seats") - F.sum("sure").over(group))
    spots = rows.where("upto > sure").select(
        *dict.fromkeys(within + order), "open", F.explode(F.sequence("sure", F.col("upto") - 1)).alias("k"), F.col(size).alias("by")
    )
    best = Window.partitionBy(*within).orderBy((F.col("by") / (2 * F.col("k") + 1)).desc(), *order, "k")
    won = spots.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.col("open"))
    won = won.groupBy(*dict.fromkeys(within + order)).agg(F.count("*").alias("won"))
    joined = rows.join(won, list(dict.fromkeys(within + order)), "left")
    return joined.withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0).cast("long"))).drop("sure", "upto", "open", "won", "seats")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    repeat: int = REPEAT,
    block: int = BLOCK,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row of ``docs(doc_id, text, source)``.

    A null text has size 0; a null source is a source of its own, the last one; repeated rows are documents of
    their own; ties in the seeded order fall to the smaller size, so reruns agree. If no document has a word,
    every target and take is 0. An empty table gives no rows.
    """
    sized = prepare(docs).select("doc_id", "source", words_of(F.col("text")).alias("size"))
    sized = checkpoint(sized)  # narrow: words are counted once
    targets = source_targets(sized, weights, repeat)
    blocks = F.floor(F.sum("source_size").over(Window.partitionBy("all")) / block)
    sources = apportion(targets.withColumn("all", F.lit(1)), blocks, "target", ["all"], ["pos"])
    sources = sources.withColumn("shards", F.ceil(F.col("n_rows") / shard_rows).cast("long"))
    sources = checkpoint(sources.select(F.col("source").alias("name"), "pos", "source_size", "target", "quota", "shards"))

    named = sized.join(sources, sized["source"].eqNullSafe(sources["name"]))
    named = named.select("doc_id", "size", "source_size", "target", "pos", "quota", _place(F.col("doc_id")).alias("place"), F.col("shards"))
    named = named.withColumn("shard", F.pmod(F.floor(F.col("place") / 7), F.col("shards")))
    shards = named.groupBy("pos", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("source_quota"))
    shards = apportion(shards, F.col("source_quota"), "shard_size", ["pos"], ["shard"])
    shards = shards.withColumn("n_blocks", F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1)).cast("long"))
    shards = shards.select("pos", "shard", "n_blocks", F.least(F.col("quota"), F.col("n_blocks") * repeat).alias("shard_quota"))

    lined = named.join(shards, ["pos", "shard"])
    along = Window.partitionBy("pos", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    lined = lined.withColumn("end", F.sum("size").over(along)).withColumn("start", F.col("end") - F.col("size"))
    extra = F.pmod(F.col("shard_quota"), F.col("n_blocks"))
    offset = F.pmod(_place(F.col("pos"), F.col("shard")), F.col("n_blocks"))

    def words_before(at: Column) -> Column:
        """Words before ``at`` in blocks that are picked once more: whole blocks, then the part of the next one."""
        full, rest = F.floor(at / block), F.pmod(at, F.lit(block))
        picked = lambda k: F.floor((k * extra + offset) / F.col("n_blocks"))
        return picked(full) * block + (picked(full + 1) - picked(full)) * rest

    times = F.floor(F.col("shard_quota") / F.col("n_blocks"))
    taken = times * F.col("size") + words_before(F.col("end")) - words_before(F.col("start"))
    return lined.select(
        "doc_id", "size", "source_size", "target", F.coalesce(F.when(F.col("size") > 0, taken), F.lit(0)).cast("long").alias("taken")
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM sums),
weighed AS (
  SELECT *, CAST(CASE pos % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight,
    CAST(source_size * 3 AS DOUBLE) AS most FROM placed),
levels AS (
  SELECT *, most / weight AS ratio,
    ((SELECT sum(source_size) FROM sums) - coalesce(sum(most) OVER w, 0)) /
    ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, struct_pack(ratio := ratio, pos := pos)) AS level FROM levels WHERE ratio >= level),
targets AS (SELECT l.* EXCLUDE (level), least(most, coalesce((SELECT level FROM water), 0) * weight) AS target FROM levels l),
seats AS (SELECT CAST(floor(sum(source_size) / 32) AS BIGINT) AS n FROM sums),
spots AS (
  SELECT pos, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, pos, k) AS rank
  FROM targets, LATERAL (SELECT unnest(range(0, CAST(floor(target / 32) AS BIGINT) + (SELECT count(*) FROM sums) + 2)) AS k) WHERE target > 0),
quotas AS (SELECT pos, count(*) AS quota FROM spots, seats WHERE rank <= n GROUP BY pos),
named AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.pos, coalesce(q.quota, 0) AS quota,
    CAST(ceil(t.n_rows / 2000) AS BIGINT) AS shards,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS place
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN quotas q ON q.pos = t.pos),
sharded AS (SELECT *, (place // 7) % shards AS shard FROM named),
shards AS (
  SELECT pos, shard, CAST(sum(size) AS BIGINT) AS shard_size, min(quota) AS source_quota,
    CAST(ceil(sum(size) / 32) AS BIGINT) AS n_blocks FROM sharded GROUP BY pos, shard),
shard_spots AS (
  SELECT pos, shard, source_quota, k,
    row_number() OVER (PARTITION BY pos ORDER BY CAST(shard_size AS DOUBLE) / (2 * k + 1) DESC, shard, k) AS rank
  FROM shards, LATERAL (SELECT unnest(range(0, source_quota)) AS k) WHERE shard_size > 0),
shard_quotas AS (
  SELECT s.pos, s.shard, s.n_blocks, least(count(*) FILTER (rank <= p.source_quota), s.n_blocks * 3) AS quota,
    CAST('0x' || substr(md5('17:' || s.pos || ':' || s.shard), 1, 8) AS BIGINT) AS seed
  FROM shards s LEFT JOIN shard_spots p USING (pos, shard) GROUP BY s.pos, s.shard, s.n_blocks),
lined AS (
  SELECT n.*, q.n_blocks, q.quota // greatest(q.n_blocks, 1) AS times, q.quota % greatest(q.n_blocks, 1) AS extra,
    q.seed % greatest(q.n_blocks, 1) AS off,
    CAST(sum(size) OVER (PARTITION BY n.pos, n.shard ORDER BY place, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM sharded n JOIN shard_quotas q USING (pos, shard)),
counted AS (
  SELECT *, (SELECT sum((least(stop, 32 * (b + 1)) - greatest(stop - size, 32 * b)) *
      (times + ((b + 1) * extra + off) // n_blocks - (b * extra + off) // n_blocks))
    FROM (SELECT unnest(range((stop - size) // 32, (stop - 1) // 32 + 1)) AS b)) AS took FROM lined)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN took ELSE 0 END AS BIGINT) AS taken FROM counted
"""
