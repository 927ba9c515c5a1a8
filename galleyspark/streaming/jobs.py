"""Structured Streaming jobs. Each agrees with its batch fold on the same log, whatever the micro-batch boundaries."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from galleyspark.session import ensure_checkpoint_dir


def run_available(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over everything that is there and return its result as a table.

    Batches are written to files in the shared checkpoint folder, a repeated batch over its own earlier attempt. With ``keys``
    only the row of the last batch counts for each key.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{base}/out/batch=-1")  # a stream without rows has a result too
    # Timeouts on the wall clock ask for one empty batch after another; this run ends with its data. State lies on disk.
    flags = {"spark.sql.streaming.noDataMicroBatches.enabled": "false",
             "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k) for k in flags}
    for k, v in flags.items():
        spark.conf.set(k, v)
    try:
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")
    if not keys:
        return out.drop("batch")
    rest = [c for c in out.columns if c not in keys and c != "batch"]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v")).select(*keys, "v.*")


class _Processor(StatefulProcessor):
    """Nothing to close."""

    def close(self) -> None:
        pass


STATUS_BUCKETS = 1024  # keys of the latest statuses are dealt over so many; a running stream keeps its number


class _LatestStatus(_Processor):
    """The latest row of each (source, url) of a bucket, gone when none came for ``keep_days``."""

    def __init__(self, keep_days: float, kinds: tuple[str, str]):
        self.ttl = max(1, int(keep_days * 86_400_000))
        self.key = "source {}, url {}".format(*kinds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", self.key, "run_at long, rowid long, source_type string, status string, reason string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best: dict[tuple, tuple] = {}  # of this bucket and trigger
        for r in rows:
            at, new = (r.source, r.url), (r.run_at, r.rowid, r.source_type, r.status, r.reason)
            if at not in best or _later(*new[:2]) > _later(*best[at][:2]):
                best[at] = new
        for at, new in best.items():
            old = self.latest.getValue(at)
            if old and _later(*old[:2]) >= _later(*new[:2]):
                new = tuple(old)
            self.latest.updateValue(at, new)
            yield Row(source=at[0], url=at[1], run_at=new[0], rowid=new[1], source_type=new[2], status=new[3], reason=new[4])


def _later(run_at, rowid) -> tuple:
    """Order of fetches: by time, then by row; a fetch without a time comes first."""
    return (False, rowid) if run_at is None else (True, run_at, rowid)


def latest_status_stream(fetch: DataFrame, keep_days: float = 3) -> DataFrame:
    """Latest status per (source, url), in update mode. fetch: a stream of rowid, run_at, source, url, source_type, status, reason.

    One row per key is state; a key that is silent for ``keep_days`` is forgotten. Keys are handed over in buckets, as each call of the processor
    costs far more than a key; their state is read and written key by key. Rows, not frames, for the same reason.
    """
    kinds = tuple(dict(fetch.dtypes)[c] for c in ("source", "url"))
    out = "source {}, url {}, run_at long, rowid long, source_type string, status string, reason string".format(*kinds)
    # Times are microseconds inside: rows and state would give them with and without a zone.
    dealt = fetch.withColumn("run_at", F.unix_micros("run_at")).withColumn("bucket", F.pmod(F.xxhash64("source", "url"), F.lit(STATUS_BUCKETS)))
    latest = dealt.groupBy("bucket").transformWithState(_LatestStatus(keep_days, kinds), out, "Update", "ProcessingTime")
    return latest.withColumn("run_at", F.timestamp_micros("run_at"))


def first_seen_articles_stream(urls: DataFrame) -> DataFrame:
    """First sighting of each link. urls: a stream of url, at."""
    return urls.groupBy("url").agg(F.min("at").alias("first_seen_at"))


def observation_stream(log: DataFrame) -> DataFrame:
    """Last observation per item, in update mode. log: a stream of item_id, seq, podcast, status, stars, observed_at."""
    return log.groupBy("item_id").agg(F.max_by(F.struct("podcast", "status", "stars", "observed_at"), "seq").alias("o")).select("item_id", "o.*")


KEEP, USER_CHARS, REPLY_CHARS, IDLE_MS = 4, 500, 2000, 168 * 3600 * 1000


class _Window(_Processor):
    """The last exchanges of a session, and the turn that may be answered next. Idle sessions are forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "turn long, user string, reply string", IDLE_MS)
        self.last = handle.getValueState("last", "role string, text string", IDLE_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [(t, u, a) for t, u, a in self.kept.get()] if self.kept.exists() else []
        prev = tuple(self.last.get()) if self.last.exists() else None
        told = ((int(t), r, x) for frame in rows for t, r, x in zip(frame["turn"], frame["role"], frame["text"], strict=True))
        # Of a turn no more is held than a window may show of it.
        turns = sorted((t, r, " ".join(x.split())[:USER_CHARS] if r == "user" else x.strip()[:REPLY_CHARS]) for t, r, x in told)
        for turn, role, text in turns:
            if prev is not None and role == "assistant" and prev[0] == "user" and prev[1] and text:
                kept.append((turn, prev[1], text))
            prev = (role, text)
        kept = kept[-KEEP:]
        if kept:
            self.kept.put(kept)
        self.last.update(prev)
        if kept:
            yield pd.DataFrame({"session": [key[0]], "exchanges": [len(kept)], "first_turn": [kept[0][0]], "last_turn": [kept[-1][0]], "chars": [sum(len(u) + len(a) for _, u, a in kept)]})


def conversation_window(turns: DataFrame) -> DataFrame:
    """Sizes of each session's window as turns arrive. turns: a stream of session, turn, role, text. A session's state is a list of four exchanges."""
    out = "session long, exchanges int, first_turn long, last_turn long, chars int"
    return turns.groupBy("session").transformWithStateInPandas(_Window(), out, "Update", "ProcessingTime")


MINUTE, DAY = 60_000_000, 86_400_000_000


class _Backlog(_Processor):
    """Attempts and next check of one item; a final item stays final. A timer reports when the next check is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "created long, attempts long, final boolean, next long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = tuple(self.state.get()) if self.state.exists() else None
        if s:
            self.handle.deleteTimer(s[3] // 1000)
        failures = sorted((int(at), int(seq), bool(counted)) for frame in rows for at, seq, counted in zip(frame["at"], frame["seq"], frame["counted"], strict=True))
        for at, _, counted in failures:
            created, attempts, final = s[:3] if s else (at, 0, False)
            late = at - created >= 3 * DAY and attempts >= 2
            final = bool(final or (s and counted and (late or attempts >= 71)))
            s = (created, attempts + int(counted), final, at + (360 if s and attempts >= 48 else 30) * MINUTE)
        self.state.update(s)
        if not s[2]:
            self.handle.registerTimer(s[3] // 1000)
        yield self._row(key, s, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, tuple(self.state.get()), True)

    def _row(self, key, s, due: bool) -> pd.DataFrame:
        return pd.DataFrame({"item_id": [key[0]], "created": [s[0]], "attempts": [s[1]], "final": [s[2]], "next": [s[3]], "due": [due]})


def backlog_stream(failures: DataFrame) -> DataFrame:
    """failures: a stream of item_id, seq, at (microseconds), counted. Returns an item's state after each trigger that brings failures, and once more,
    with ``due``, when its next check has come."""
    out = "item_id long, created long, attempts long, final boolean, next long, due boolean"
    return failures.groupBy("item_id").transformWithStateInPandas(_Backlog(), out, "Update", "ProcessingTime")


class _FirstSeen(_Processor):
    """Ledger of one feed: a map of item keys to (first seen, seeded). Each row is the document of one scan."""

    def __init__(self, lookback_hours: int, burst_limit: int):
        self.lookback, self.burst_limit = pd.Timedelta(hours=lookback_hours), burst_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ledger = handle.getMapState("ledger", "key string", "first timestamp, seeded boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed: dict = {}
        for scan in pd.concat(list(rows)).sort_values("scan_no").itertuples(index=False):  # the scans of one trigger
            changed |= self._scan(scan)
        if changed:
            first, seeded = zip(*changed.values(), strict=True)
            yield pd.DataFrame({"feed": [key[0]] * len(changed), "key": list(changed), "first_seen_at": pd.to_datetime(list(first)), "seeded": list(seeded)})

    def _scan(self, scan) -> dict:
        initial, late, entries = not self.ledger.exists(), [], {}

        def known(k):
            if k not in entries and self.ledger.containsKey((k,)):
                entries[k] = tuple(self.ledger.getValue((k,)))
            return entries.get(k)

        cutoff = (scan.scan_at - self.lookback).value // 1000
        for keys, published in zip(scan.item_keys, scan.published, strict=True):
            own = list(dict.fromkeys(keys.split("\u0001"))) if keys else []
            had = [e for e in map(known, own) if e]
            if own and not had and not initial and published < cutoff:
                late.append(own)
            entries.update((k, (min((first for first, _ in had), default=scan.scan_at), initial or any(seeded for _, seeded in had))) for k in own)
        if len(late) > self.burst_limit:
            entries.update((k, (entries[k][0], True)) for own in late for k in own)
        for k, (first, seeded) in entries.items():
            self.ledger.updateValue((k,), (pd.Timestamp(first).to_pydatetime(), bool(seeded)))
        return {k: (pd.Timestamp(first), bool(seeded)) for k, (first, seeded) in entries.items()}


def first_seen_stream(scans: DataFrame, lookback_hours: int, burst_limit: int = 3) -> DataFrame:
    """Changed ledger entries (feed, key, first_seen_at, seeded) as the documents of scans arrive, as ``operators.state.first_seen`` folds them.

    scans: a stream of feed, scan_no, scan_at, items (array of ordinal, keys, published_at in document order). The scans of a feed arrive in order;
    those of one trigger are sorted. State is a map on disk: a scan reads the entries of its own items only.
    """
    out = f"feed {dict(scans.dtypes)['feed']}, key string, first_seen_at timestamp, seeded boolean"
    undated = F.lit(2**62)
    flat = scans.select("feed", "scan_no", "scan_at", F.transform("items", lambda i: F.array_join(F.filter(i["keys"], lambda k: k != ""), "\u0001")).alias("item_keys"),
                        F.transform("items", lambda i: F.coalesce(F.unix_micros(i["published_at"]), undated)).alias("published"))
    return flat.groupBy("feed").transformWithStateInPandas(_FirstSeen(lookback_hours, burst_limit), out, "Update", "None")
