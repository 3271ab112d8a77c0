"""Result feeds, quotas, ratings, caches and settlement as streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from matchstats.operators.elo import HISTORY, START, delta
from matchstats.operators.upserts import upsert_games

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Microseconds of a day.
_DAY = 86_400_000_000
#: Groups of accounts that keep their posts together, and of cache keys that keep their puts together.
BUCKETS = 1024


def quota_stream(posts: DataFrame, late: str = "48 hours", limit: int = 17) -> DataFrame:
    """Posts of each account in sliding windows of 24 hours every hour, how many remain, and the hours since the oldest of
    them; later posts are dropped.  A post is in 24 windows, so the state is large and lies in the RocksDB store, which is set for the
    session, not in the executors' memory."""
    posts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    n = posts.withWatermark("posted_at", late).groupBy("account", F.window("posted_at", "24 hours", "1 hour")).agg(F.count("*").alias("posts_24h"), F.min("posted_at").alias("oldest"))
    age = (F.unix_timestamp("window.end") - F.unix_timestamp("oldest")) / 3600
    return n.select("account", F.col("window.end").alias("as_of"), "posts_24h", F.greatest(F.lit(0), limit - F.col("posts_24h")).alias("remaining"), age.alias("oldest_hours"))


class _Quota(StatefulProcessor):
    """The posts of a bucket of accounts, those of the 24 hours before the watermark and those after it, as two lists sorted by
    account and microsecond, with one timer for the next post to become older than 24 hours."""

    def __init__(self, limit: int, kind: str):
        self.limit, self.kind = limit, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.posts = handle, handle.getValueState("posts", f"accounts array<{self.kind}>, at array<long>")

    def close(self) -> None:
        pass

    def stored(self) -> pd.DataFrame:
        accounts, at = self.posts.get() if self.posts.exists() else ((), ())
        return pd.DataFrame({"account": pd.Series(list(accounts), dtype=object), "at": np.array(at, np.int64)})

    def store(self, posts: pd.DataFrame) -> None:
        """Keeps the posts and sets the timer for the oldest of them."""
        if len(posts):
            self.posts.update((posts["account"].tolist(), posts["at"].tolist()))
            self.handle.registerTimer((int(posts["at"].min()) + _DAY) // 1000 + 1)
        else:
            self.posts.clear()

    def rows(self, asked: pd.DataFrame, posts: pd.DataFrame, posted: bool) -> pd.DataFrame:
        """The quota of accounts at some times (account, at), of which `posts` has all earlier posts of a day."""
        code, _ = pd.factorize(pd.concat([posts["account"], asked["account"]]))
        at, own, t, asks = posts["at"].to_numpy(np.int64), code[: len(posts)], asked["at"].to_numpy(np.int64), code[len(posts) :]
        # Posts by account and time, as one number each.
        times = np.unique(np.concatenate([at, t, t - _DAY]))
        place = lambda account, x: account * len(times) + np.searchsorted(times, x)
        key = place(own, at)
        order = np.argsort(key, kind="stable")
        first, end = np.searchsorted(key[order], place(asks, t - _DAY)), np.searchsorted(key[order], place(asks, t), side="right")
        n = end - first
        oldest = np.append(at[order], 0)[first]
        hours = np.where(n > 0, (t // 1_000_000 - oldest // 1_000_000) / 3600, np.nan)
        hours = pd.Series(hours, dtype="float64")
        stamps = pd.Series(t.astype("datetime64[us]"))
        return pd.DataFrame({"account": asked["account"].to_numpy(), "as_of": stamps, "at_post": posted, "posts_24h": n, "remaining": np.maximum(0, self.limit - n), "oldest_hours": hours})

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat([pd.DataFrame({"account": f["account"].astype(object), "at": f["posted_at"].astype("datetime64[us]").astype("int64")}) for f in frames])
        posts = pd.concat([self.stored(), new], ignore_index=True)
        self.store(posts)
        yield self.rows(new.drop_duplicates().reset_index(drop=True), posts, True)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """One row for each account and millisecond in which posts have become older than 24 hours, up to the watermark."""
        now, posts = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self.stored()
        due = (posts["at"] + _DAY) // 1000 + 1
        aged = posts.assign(at=due * 1000)[due <= now].drop_duplicates().reset_index(drop=True)
        if not len(aged):  # a timer set before an earlier post came
            return
        self.store(posts[due > now])
        yield self.rows(aged, posts, False)


def quota_changes(posts: DataFrame, late: str = "48 hours", limit: int = 17) -> DataFrame:
    """The rolling quota of each account wherever it changes: at each moment with posts (at_post), and once a post has become
    more than 24 hours old: account, as_of, at_post, posts_24h, remaining, oldest_hours.

    A post counts for 24 hours, the last moment included.  Accounts are dealt to BUCKETS groups, whose posts a task counts all at
    once, with one timer a group, so that a micro-batch makes some calls for each group, not for each post.  The state is the posts of
    24 hours before the watermark; a post that comes after later ones doesn't change their rows.  It needs the RocksDB store, which is set for the session.
    """
    posts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kind = dict(posts.dtypes)["account"]
    schema = f"account {kind}, as_of timestamp, at_post boolean, posts_24h long, remaining long, oldest_hours double"
    rows = posts.select("account", "posted_at", F.pmod(F.xxhash64("account"), F.lit(BUCKETS)).alias("bucket")).where("account is not null and posted_at is not null").withWatermark("posted_at", late)
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Quota(limit, kind), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def stream_upsert_games(updates: DataFrame, path: str, partition: str = "season") -> DataStreamWriter:
    """Applies each micro-batch of results to the games stored as Parquet at path, partitioned by a column that updates have
    too, and writes anew only the partitions that the batch touches.

    A batch that is run again gives the same table.  Batches are logged beside it, at {path}-batches (number, updates).  An
    update names the partition of its game; games don't change theirs.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch.persist()
        touched = [r[0] for r in batch.select(partition).distinct().collect()]  # a value for each partition
        own = F.col(partition).isin([x for x in touched if x is not None])
        own = own | F.col(partition).isNull() if None in touched else own
        stored = batch.sparkSession.read.parquet(path).where(own)
        upsert_games(stored, batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        log = batch.agg(F.lit(number).cast("long").alias("number"), F.count("*").alias("updates"))
        log.write.mode("overwrite").parquet(f"{path}-batches/batch={number}")
        batch.unpersist()

    return updates.writeStream.foreachBatch(apply)


class _Ratings(StatefulProcessor):
    """A pool's ratings by team, its last game, and the ids of its games by date, each an entry of its own in the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ratings = handle.getMapState("ratings", "team_id long", "elo double")
        self.ids = handle.getMapState("ids", "game_date string", "game_ids array<long>")
        self.last = handle.getValueState("last", "game_date string, game_id long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        date, game = self.last.get() if self.last.exists() else (None, None)
        ratings: dict[int, float] = {}  # of the teams of this micro-batch
        ids: dict[str, set[int]] = {}  # of its dates

        def rating(team: int) -> float:
            if team not in ratings:
                ratings[team] = self.ratings.getValue((team,))[0] if self.ratings.containsKey((team,)) else START
            return ratings[team]

        def seen(day: str) -> set[int]:
            if day not in ids:
                ids[day] = set(self.ids.getValue((day,))[0]) if self.ids.containsKey((day,)) else set()
            return ids[day]

        batch = pd.concat(list(frames)).drop_duplicates("game_id").sort_values(["game_date", "game_id"], kind="stable")
        rows = []
        for g in batch.itertuples(index=False):
            day = str(g.game_date)
            if g.game_id in seen(day):
                continue
            seen(day).add(int(g.game_id))
            late = date is not None and (day, g.game_id) <= (date, game)
            h, a = (None, None) if late else (rating(g.home_team_id), rating(g.away_team_id))
            d = None if late else delta(h, a, g.home_score - g.away_score)
            for team, before, gain in ((g.home_team_id, h, d), (g.away_team_id, a, None if late else -d)):
                rows.append((g.pool_id, g.game_id, g.game_date, team, before, None if late else before + gain))
                if not late:
                    ratings[team] = before + gain
            if not late:
                date, game = day, int(g.game_id)
        for team, elo in ratings.items():
            self.ratings.updateValue((int(team),), (float(elo),))
        for day, own in ids.items():
            self.ids.updateValue((day,), (sorted(own),))
        if date is not None:
            self.last.update((date, game))
        yield pd.DataFrame(rows, columns=["pool_id", "game_id", "game_date", "team_id", "elo_before", "elo_after"])


def stream_elo(games: DataFrame) -> DataFrame:
    """Rating history of a stream of played games.

    The state is a map of ratings by team and one of game ids by date for each pool; a micro-batch reads and writes only the
    entries of its own teams and dates.  Games of a micro-batch are played in (date, id) order; a replayed game is left out.  A
    new game that is not after the pool's last one can't be rated any more: its two rows come out without ratings, to be
    counted or rated again in batch.  Such state needs the RocksDB store, which is set for the session.
    """
    games.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    played = games.where("home_score is not null and away_score is not null").select("pool_id", "game_id", "game_date", "home_team_id", "away_team_id", "home_score", "away_score")
    return played.groupBy("pool_id").transformWithStateInPandas(statefulProcessor=_Ratings(), outputStructType=HISTORY, outputMode="Append", timeMode="None")


class _Cache(StatefulProcessor):
    """The latest puts of a bucket of keys, as lists, with one timer for the next of them to expire.  Either each read is answered,
    or each key's put in force is shown after a micro-batch with puts of it."""

    _KEYS = ["cache", "key"]

    def __init__(self, hours: float, reads: bool):
        self.life, self.reads = int(hours * 3_600_000_000), reads

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.puts = handle.getValueState("puts", "caches array<string>, keys array<string>, payloads array<string>, at array<long>")

    def close(self) -> None:
        pass

    def stored(self, watermark: int) -> pd.DataFrame:
        """The puts that have not expired by the watermark, in milliseconds."""
        caches, keys, payloads, at = self.puts.get() if self.puts.exists() else ((), (), (), ())
        text = {n: pd.Series(list(x), dtype=object) for n, x in (("cache", caches), ("key", keys), ("payload", payloads))}
        puts = pd.DataFrame({**text, "us": np.array(at, np.int64)})
        return puts[puts["us"] + self.life > watermark * 1000]

    def store(self, puts: pd.DataFrame) -> None:
        """Keeps the puts and sets the timer for the oldest of them."""
        if len(puts):
            self.puts.update((puts["cache"].tolist(), puts["key"].tolist(), puts["payload"].tolist(), puts["us"].tolist()))
            self.handle.registerTimer(-(-(int(puts["us"].min()) + self.life) // 1000))
        else:
            self.puts.clear()

    def newest(self, rows: pd.DataFrame) -> pd.DataFrame:
        """The latest put of each key; of puts of one time the later batch's, then that of the last payload."""
        return rows.sort_values(["us", "batch", "payload"], kind="stable").drop_duplicates(self._KEYS, keep="last")

    def handleInputRows(self, key: tuple, frames: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = self.stored(timerValues.getCurrentWatermarkInMs()).assign(batch=0)
        new = (f[["cache", "key", "payload"]].astype(object).assign(us=f["at"].astype("datetime64[us]").astype("int64"), batch=1) for f in frames)
        if self.reads:
            rows = pd.concat(list(new), ignore_index=True)
            is_read = rows["payload"].isna()
            puts = self.newest(pd.concat([before, rows[~is_read]], ignore_index=True))
            yield self.answers(pd.concat([before, rows], ignore_index=True))
        else:  # a key with many puts needs one row, not all of them
            touched = before.iloc[:0]
            for rows in new:
                touched = self.newest(pd.concat([touched, rows], ignore_index=True))
            puts = self.newest(pd.concat([before, touched], ignore_index=True))
            shown = puts.merge(touched[self._KEYS], on=self._KEYS)
            stamp = lambda us: us.to_numpy(np.int64).astype("datetime64[us]")
            yield pd.DataFrame({**{c: shown[c] for c in (*self._KEYS, "payload")}, "cached_at": stamp(shown["us"]), "expires_at": stamp(shown["us"] + self.life)})
        self.store(puts)

    def answers(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Of each read (a row without a payload) what the latest put before it holds, puts that came before a later stored one
        left out."""
        group = rows.groupby(self._KEYS, dropna=False, sort=False).ngroup()
        known = rows["us"].where(rows["batch"] == 0).groupby(group).transform("max")
        read = rows["payload"].isna()
        rows = rows.assign(group=group, read=read)[read | ~(rows["us"] < known)]
        rows = rows.sort_values(["group", "us", "read", "batch", "payload"], kind="stable")
        put = pd.Series(np.where(rows["read"], np.nan, np.arange(len(rows))), index=rows.index).groupby(rows["group"]).ffill()
        has = put.notna().to_numpy() & rows["read"].to_numpy()
        at, own, payloads = rows["us"].to_numpy(), put.fillna(0).to_numpy(np.int64), rows["payload"].to_numpy(object)
        has &= at < at[own] + self.life
        found = np.where(has, payloads[own], None)
        stamps = pd.Series(at.astype("datetime64[us]"), index=rows.index)
        return pd.DataFrame({**{c: rows[c] for c in self._KEYS}, "at": stamps, "payload": found})[rows["read"]]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.store(self.stored(max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())))
        return iter(())


def _cache(events: DataFrame, hours: float, late: str, reads: bool, schema: str) -> DataFrame:
    """Keys are dealt to BUCKETS groups, whose puts a task goes through all at once, so that a micro-batch makes a call for each group,
    not for each key.  Keys travel as text.  It needs the RocksDB store, which is set for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    kinds = {c: k for c, k in events.dtypes if c in ("cache", "key")}
    rows = events.where("at is not null").select(F.pmod(F.xxhash64("cache", "key"), F.lit(BUCKETS)).alias("bucket"), *[F.col(c).cast("string").alias(c) for c in kinds], "at", "payload").withWatermark("at", late)
    out = rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Cache(hours, reads), outputStructType=f"cache string, key string, {schema}", outputMode="Append", timeMode="EventTime")
    return out.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})


def stream_ttl_cache(puts: DataFrame, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """(cache, key, payload, cached_at, expires_at) of each key's put in force after each micro-batch with puts of it.

    puts: cache, key, cached_at and, if any, payload.  A put replaces the one before it; older puts that come later do
    not.  The state of a key goes once the watermark passes its expiry.
    """
    payload = F.coalesce(F.col("payload").cast("string"), F.lit("")) if "payload" in puts.columns else F.lit("")
    events = puts.select("cache", "key", F.col("cached_at").alias("at"), payload.alias("payload"))
    return _cache(events, hours, late, False, "payload string, cached_at timestamp, expires_at timestamp")


def stream_cache_reads(events: DataFrame, hours: float = 24, late: str = "1 hour") -> DataFrame:
    """(cache, key, at, payload) for each read: what the key's latest put holds, null if there is none or it has expired
    (from the moment of its expiry on).  events: cache, key, at and payload, which is null in a read."""
    rows = events.withColumn("payload", F.col("payload").cast("string"))
    return _cache(rows, hours, late, True, "at timestamp, payload string")


def stream_settle(pred: DataFrame, results: DataFrame, days: int = 30) -> DataFrame:
    """Predictions (game_id, predicted_at) with results (result_id, result_ts, scores) that come within the days after;
    once the watermark has passed, an unmatched prediction comes out pending (null scores)."""
    p = pred.withWatermark("predicted_at", "1 day")
    r = results.withWatermark("result_ts", "1 day")
    on = (F.col("game_id") == F.col("result_id")) & (F.col("result_ts") >= F.col("predicted_at")) & (F.col("result_ts") <= F.col("predicted_at") + F.expr(f"INTERVAL {days} DAYS"))
    return p.join(r, on, "leftOuter")
