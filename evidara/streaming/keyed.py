"""State kept by key across batches: hash chains that grow and a cache of web results that forgets.

State is versioned with the query's checkpoint, so a batch that runs again after a failure starts from the state it
started from before and gives the same rows; a file sink then keeps one copy of them.  Both need the RocksDB state store
(``use_rocksdb``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from evidara.operators.chain import GENESIS

#: Statuses of a finished web search; failures are asked again.  Fixed values.
CACHEABLE = ("SUCCESS", "NO_RESULTS")
TTL_SECONDS, MOST_ENTRIES = 3600.0, 128


def use_rocksdb(spark: SparkSession) -> None:
    """State of several variables needs this store; to be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def whole(frames: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    held = list(frames)
    return pd.concat(held, ignore_index=True) if held else pd.DataFrame(columns=columns)


class ChainHead(StatefulProcessor):
    """Links a chain's new rows in seq order to its stored head."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq long, row_hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = whole(rows, ["chain", "seq", "content"])
        new = new.assign(content=new["content"].fillna("")).sort_values(["seq", "content"], kind="stable")
        last, previous = self.head.get() if self.head.exists() else (None, GENESIS)
        out = []
        for seq, content in zip(new["seq"].tolist(), new["content"].tolist(), strict=True):
            if last is not None and seq <= last:
                out.append((key[0], seq, content, None, None, "LATE"))
                continue
            linked = hashlib.sha256((previous + content).encode()).hexdigest()
            out.append((key[0], seq, content, previous, linked, "LINKED"))
            last, previous = seq, linked
        if last is not None:
            self.head.update((last, previous))
        yield pd.DataFrame(out, columns=["chain", "seq", "content", "previous_hash", "row_hash", "status"])


def chained(stream: DataFrame, seq: str = "seq", content: str = "content", chain: str | None = None) -> DataFrame:
    """chain, seq, content, previous_hash, row_hash, status of a stream of events: many chains side by side.

    A chain's rows of a batch are put in order by seq, each in time in proportion to its bytes.  A row at or before the head's
    seq, as a repeated one is, can't be linked any more: it comes out as LATE without hashes and changes nothing.  NULL content is
    linked as an empty one; rows without seq are left out; without ``chain`` there is one chain, named ''.
    """
    name = F.coalesce(F.col(chain).cast("string"), F.lit("")) if chain else F.lit("")
    lean = stream.select(name.alias("chain"), F.col(seq).cast("long").alias("seq"), F.col(content).cast("string").alias("content")).filter("seq is not null")
    return lean.groupBy("chain").transformWithStateInPandas(ChainHead(), "chain string, seq long, content string, previous_hash string, row_hash string, status string", "Append", "None")


class ResultCache(StatefulProcessor):
    """A shard's results by key: at most ``most``, the one not used for longest goes first, none older than ``ttl_ms``."""

    COLUMNS = ("key", "at", "outcome", "status", "payload")

    def __init__(self, ttl_ms: int, most: int):
        self.ttl_ms, self.most = ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "status string, payload string, stored_at long, used_at long")

    def _old(self, entry: tuple, now: int) -> bool:
        return self.ttl_ms > 0 and now - entry[2] > self.ttl_ms

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = whole(rows, ["shard", "key", "at", "kind", "status", "payload"]).sort_values(["at", "kind", "key"], ascending=[True, False, True], kind="stable")
        held = {k[0]: tuple(v) for k, v in self.entries.iterator()}  # at most ``most``
        before, out = dict(held), []
        for name, at, kind, status, payload in zip(*(new[c].tolist() for c in ("key", "at_ms", "kind", "status", "payload")), strict=True):
            if name in held and self._old(held[name], at):
                out.append((name, at, "EXPIRED", *held.pop(name)[:2]))
            if kind == "RESULT":
                keep = status in CACHEABLE and self.most > 0
                if keep:
                    held[name] = (status, payload, at, at)
                out.append((name, at, "STORED" if keep else "NOT_STORED", status, payload))
                while len(held) > self.most:
                    gone = min(held, key=lambda k: (held[k][3], k))
                    out.append((gone, at, "EVICTED", *held.pop(gone)[:2]))
            elif name in held:
                held[name] = (*held[name][:3], max(at, held[name][3]))
                out.append((name, at, "HIT", *held[name][:2]))
            else:
                out.append((name, at, "MISS", None, None))
        for name in before.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if before.get(name) != entry:
                self.entries.updateValue((name,), entry)
            if self.ttl_ms > 0 and (name not in before or before[name][2] != entry[2]):
                self.handle.registerTimer(entry[2] + self.ttl_ms + 1)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for name, entry in [(k[0], tuple(v)) for k, v in self.entries.iterator()]:
            if self._old(entry, now):
                self.entries.removeKey((name,))
                out.append((name, now, "EXPIRED", entry[0], entry[1]))
        yield self._frame(out)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(self.COLUMNS))
        return out.assign(at=pd.to_datetime(out["at"].astype("int64"), unit="ms", utc=True))


def cached_results(events: DataFrame, lateness: str, ttl_seconds: float = TTL_SECONDS, most: int = MOST_ENTRIES, shards: int = 1) -> DataFrame:
    """key, at, outcome, status, payload of a stream of cache events: key, at, kind (REQUEST or RESULT), status, payload.

    A request is a HIT with what is stored or a MISS; a result is STORED if its status is of a finished search, which
    replaces what was there, else NOT_STORED, which leaves it; an entry goes as EXPIRED after ``ttl_seconds`` (0: never) or
    as EVICTED when a shard has more than ``most`` / ``shards``.  Events of a batch are taken in the order of time,
    results before requests of the same moment; those later than the watermark are dropped by Spark.
    """
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    lean = events.withWatermark("at", lateness).filter("key is not null and at is not null")
    lean = lean.select(shard.alias("shard"), "key", "at", F.unix_millis("at").alias("at_ms"), "kind", "status", "payload")
    cache = ResultCache(int(ttl_seconds * 1000), -(-most // shards) if most > 0 else 0)
    return lean.groupBy("shard").transformWithStateInPandas(cache, "key string, at timestamp, outcome string, status string, payload string", "Append", "EventTime")
