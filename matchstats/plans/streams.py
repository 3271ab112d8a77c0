"""The stream operators over whole tables: a table is written as files, streamed once through, and the sink read back.

A query stops once all files are read (availableNow), so its rows can be compared with SQL over the same table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.plans.analysis import _UPD
from matchstats.plans.core import elo_sql, query
from matchstats.plans.views import r6, view, with_views
from matchstats.sources.folders import shared_folder
from matchstats.streaming import feeds

#: Micro-batches that a table comes in, the fewest files of each, and rows of a file: a task reads a file, so that what it
#: holds does not grow with the table.
BATCHES, FILES, FILE_ROWS = 3, 2, 100_000


def streamed(table: DataFrame, name: str, order: str | None = None) -> DataFrame:
    """The table as a stream of BATCHES micro-batches, in the order of a column of dates or times if one is given (whose
    thirds are found by approximate quantiles)."""
    path = shared_folder(table.sparkSession, name)
    if order:
        at = F.unix_micros(F.col(order).cast("timestamp"))
        cuts = table.agg(F.percentile_approx(at, [k / BATCHES for k in range(1, BATCHES)], 1000)).first()[0] or []
        number = sum((F.coalesce((at > F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    else:
        number = F.pmod(F.xxhash64(*table.columns), F.lit(BATCHES))
    files = max(FILES, math.ceil(table.count() / BATCHES / FILE_ROWS))
    marked = table.withColumn("_batch", number)
    for k in range(BATCHES):
        marked.where(F.col("_batch") == k).drop("_batch").repartition(files).write.parquet(f"{path}/{k}")
    return table.sparkSession.readStream.schema(table.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).parquet(path)


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What the stream brings until all its files are read."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(elo_sql(f"SELECT pool_id, game_id, game_date, team_id, {r6('elo_before')}, {r6('elo_after')} FROM history"))
def stream_elo(spark, sf_dir):
    return drained(feeds.stream_elo(streamed(view(spark, sf_dir, "games"), "stream-games", "game_date")), "stream-elo")


@query(with_views("SELECT coalesce(u.game_id, g.game_id) AS game_id, coalesce(u.home_score, g.home_score) AS home_score, coalesce(u.away_score, g.away_score) AS away_score FROM games g FULL JOIN (SELECT * FROM upd WHERE home_score IS NOT NULL) u ON g.game_id = u.game_id", "games", more=f"upd AS ({_UPD})"))
def stream_upsert_games(spark, sf_dir):
    """The games by year; the updates come in micro-batches that each touch many years."""
    year = F.year("game_date").alias("season")
    g = view(spark, sf_dir, "games").select("*", year)
    path = shared_folder(spark, "stream-upserted")
    g.write.partitionBy("season").parquet(path)
    g.createOrReplaceTempView("games")
    updates = spark.sql(_UPD.replace(" FROM games", ", season FROM games"))
    feeds.stream_upsert_games(streamed(updates, "stream-updates"), path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).select("game_id", "home_score", "away_score")


@query(with_views("SELECT cache, key, max(cached_at) AS cached_at, max(cached_at) + INTERVAL 24 HOUR AS expires_at FROM cache GROUP BY cache, key", "cache"))
def stream_ttl_cache(spark, sf_dir):
    """What is in force after the last micro-batch with puts of a key."""
    puts = view(spark, sf_dir, "cache").select("cache", "key", F.col("cached_at").cast("timestamp").alias("cached_at"))
    kept = drained(feeds.stream_ttl_cache(streamed(puts, "stream-puts", "cached_at"), 24), "stream-cache")
    return kept.groupBy("cache", "key").agg(*[F.max(c).cast("timestamp_ntz").alias(c) for c in ("cached_at", "expires_at")])


@query(with_views("SELECT account, e AS as_of, count(*) AS posts_24h, greatest(0, 17 - count(*)) AS remaining, " + r6("(epoch(e) - floor(epoch(min(posted_at))))/3600", "oldest_hours")
    + " FROM (SELECT account, posted_at, unnest([date_trunc('hour', posted_at) + i*INTERVAL 1 HOUR FOR i IN range(1, 25)]) AS e FROM posts) WHERE e <= (SELECT max(posted_at) FROM posts) - INTERVAL 48 HOUR GROUP BY account, e", "posts"))
def quota_stream(spark, sf_dir):
    """The windows that the watermark has closed."""
    posts = view(spark, sf_dir, "posts").withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    return drained(feeds.quota_stream(streamed(posts, "stream-posts", "posted_at")), "stream-quota").withColumn("as_of", F.col("as_of").cast("timestamp_ntz"))


@query(with_views("SELECT p.account, p.posted_at AS as_of, count(*) AS posts_24h, greatest(0, 17 - count(*)) AS remaining, " + r6("(floor(epoch(p.posted_at)) - floor(epoch(min(q.posted_at))))/3600", "oldest_hours")
    + " FROM (SELECT DISTINCT account, posted_at FROM posts WHERE account IS NOT NULL) p JOIN posts q ON p.account = q.account AND q.posted_at <= p.posted_at AND q.posted_at >= p.posted_at - INTERVAL 24 HOUR GROUP BY p.account, p.posted_at", "posts"))
def quota_changes(spark, sf_dir):
    """The quota at every post; the rows of posts that grow old are in pytest."""
    posts = view(spark, sf_dir, "posts").withColumn("posted_at", F.col("posted_at").cast("timestamp"))
    rows = drained(feeds.quota_changes(streamed(posts, "stream-posts", "posted_at")), "stream-changes").where("at_post")
    return rows.select("account", F.col("as_of").cast("timestamp_ntz").alias("as_of"), "posts_24h", "remaining", "oldest_hours")


@query(with_views("SELECT p.game_id, g.home_score FROM predictions p JOIN games g ON g.game_id = p.game_id AND CAST(g.game_date AS TIMESTAMP) + INTERVAL 1 DAY BETWEEN p.prediction_date AND p.prediction_date + INTERVAL 30 DAY", "predictions"))
def stream_settle(spark, sf_dir):
    """The settled predictions; pending ones come out as the watermark passes."""
    p = view(spark, sf_dir, "predictions").select("game_id", F.col("prediction_date").alias("predicted_at"))
    r = view(spark, sf_dir, "games").select(F.col("game_id").alias("result_id"), (F.col("game_date").cast("timestamp") + F.expr("INTERVAL 1 DAY")).alias("result_ts"), "home_score")
    both = feeds.stream_settle(streamed(p, "stream-predictions", "predicted_at"), streamed(r, "stream-results", "result_ts"))
    return drained(both, "stream-settled").where("result_id is not null").select("game_id", "home_score")
