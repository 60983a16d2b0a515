"""Event logs as streams: the log arrives as files, state lives in Spark's state store."""

from __future__ import annotations

import gc
import json
import uuid
import zlib
from collections.abc import Iterator, MutableMapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sightline.operators.replay import CHUNK, ITEMS, STORES, RunGraph, frames
from sightline.sources.tables import shared_folder


def read_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_table(stream: DataFrame, mode: str, keys: list[str] | None = None, rocksdb: bool = False) -> DataFrame:
    """Runs a stream over what is there and returns its result as a table in the shared folder.

    Appended rows stay batch by batch; in complete mode the last batch replaces the table; in update mode the last row of each key counts.
    ``rocksdb`` keeps the state in RocksDB, which map states need; the session's own setting comes back afterwards.
    """
    spark, provider = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    if rocksdb:
        spark.conf.set(provider, ROCKSDB)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table/batch={0 if mode == 'complete' else number}")

    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        if rocksdb:
            spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    rows = spark.read.parquet(f"{folder}/table")
    if mode == "update":
        nth = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("batch")))
        rows = rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")
    return rows.drop("batch")


def dedup(stream: DataFrame) -> DataFrame:
    """Each event_id once. Without a watermark the state keeps all ids, as repeats may come at any time."""
    return stream.dropDuplicates(["event_id"])


def dedup_within(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event_id once among events that come within ``delay`` (by occurred_at) of each other, with a state that holds no more than that time. A repeat that comes
    later counts as new, and an event behind the watermark is dropped; ``dedup`` is exact and its state grows with the log."""
    return stream.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def event_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("run_id", "kind").agg(F.count("*").alias("n_events"))


def review_status(stream: DataFrame) -> DataFrame:
    """Running latest outcome of each assertion."""
    return stream.groupBy("assertion_id").agg(F.max_by("outcome", F.struct("decided_at", "review_id")).alias("status"), F.count("*").alias("n_reviews"))


GROUP = 64  # entries that are kept together


class _Kept(MutableMapping):
    """A map state as a mapping. Entries are kept in groups, by a hash of their key, and a group is one value of the state, since a call to the state costs far more than an
    entry: a batch reads the groups that its events touch, and writes those that changed. With the entries the number of groups doubles, so that a group keeps its size."""

    def __init__(self, state):
        self.state, self.groups, self.put = state, {}, set()
        found = state.getValue((-1,))  # its size is an entry of the state
        self.bits, self.size = json.loads(found[0]) if found is not None else (0, 0)

    def _group(self, key: str) -> tuple[int, dict]:
        number = zlib.crc32(key.encode("utf-8", "surrogatepass")) & ((1 << self.bits) - 1) if self.bits else 0
        group = self.groups.get(number)
        return number, self._loaded(number) if group is None else group

    def _loaded(self, number: int) -> dict:
        if number not in self.groups:
            found = self.state.getValue((number,))
            self.groups[number] = {} if found is None else json.loads(found[0])
        return self.groups[number]

    def get(self, key, default=None):
        return self._group(key)[1].get(key, default)

    def __getitem__(self, key):
        return self._group(key)[1][key]

    def __setitem__(self, key, value):
        number, group = self._group(key)
        self.size += key not in group
        group[key] = value
        self.put.add(number)

    def __delitem__(self, key):
        number, group = self._group(key)
        del group[key]
        self.size -= 1
        self.put.add(number)

    def __iter__(self):
        return (key for number in range(1 << self.bits) for key in list(self._loaded(number)))

    def __len__(self):
        return self.size

    def _grow(self) -> None:
        entries = [entry for number in range(1 << self.bits) for entry in self._loaded(number).items()]
        while self.size > GROUP << self.bits:
            self.bits += 1
        self.groups, self.put = {number: {} for number in range(1 << self.bits)}, set(range(1 << self.bits))
        for key, value in entries:
            self._group(key)[1][key] = value

    def flush(self) -> None:
        if not self.put:
            return
        if self.size > GROUP << self.bits:
            self._grow()
        for number in sorted(self.put):
            if self.groups[number]:
                self.state.updateValue((number,), (json.dumps(self.groups[number]),))
            else:
                self.state.removeKey((number,))
        self.state.updateValue((-1,), (json.dumps([self.bits, self.size]),))


class _Replay(StatefulProcessor):
    """The graph of one run in map states, whose entries are nodes, edges, names and index entries. Events that come before their turn wait in a map state by spans of sequences."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {name: handle.getMapState(name, "number long", "value string") for name in STORES}
        self.waiting = handle.getMapState("waiting", "span long", "events string")
        self.counts = handle.getValueState("counts", "last long, made long, shown long")

    def _waiting(self, span: int) -> dict[int, list]:
        found = self.waiting.getValue((span,))
        return {} if found is None else {event[0]: event for event in json.loads(found[0])}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, made, shown = self.counts.get() or (0, 0, 0)
        kept: dict[str, _Kept] = {}
        graph = RunGraph(lambda name: kept.setdefault(name, _Kept(self.maps[name])), made, shown)
        new: dict[int, list | tuple] = {}
        for batch in rows:
            for event in zip(*(batch[c].tolist() for c in ("sequence", "case_id", "event_id", "kind", "payload")), strict=True):
                if event[0] > last:
                    new.setdefault(event[0], event)
        span, held = None, {}
        while True:
            if span != (last + 1) // GROUP:
                span = (last + 1) // GROUP
                if held := self._waiting(span):
                    self.waiting.removeKey((span,))
            late = new.pop(last + 1, None)
            event = held.pop(last + 1, late)  # the first one to come counts
            if event is None:
                break
            last, case, event_id, kind, payload = event
            graph.apply(case, last, event_id, kind, json.loads(payload or "{}"))
            if len(graph.animations) >= CHUNK:
                gc.freeze()  # the graph has no cycles, and the collector would walk it again and again as it grows
                yield from frames(graph.shown_rows(str(key[0])))
        new.update(held)
        early: dict[int, list] = {}
        for sequence in sorted(new):
            early.setdefault(sequence // GROUP, []).append(sequence)
        for number, sequences in early.items():
            events = {sequence: new.pop(sequence) for sequence in sequences} | self._waiting(number)
            self.waiting.updateValue((number,), (json.dumps(list(events.values())),))
        yield from frames(graph.rows(str(key[0])))
        for entries in kept.values():
            entries.flush()
        self.counts.update((last, graph.made, graph.shown))
        gc.unfreeze()

    def close(self) -> None:
        pass


def replay(stream: DataFrame) -> DataFrame:
    """ITEMS of each run as they change, with the graph kept as state (needs the RocksDB state store, as ``run_to_table(..., rocksdb=True)`` sets it).

    Events (columns as for ``operators.replay``) that come before their turn wait until the sequence has no hole, so any order of arrival, and any repeats, give the graph
    and the animations of the batch replay. A batch reads and writes the groups of entries that its events touch, whatever the run holds. The last row of an id counts.
    """
    return stream.groupBy("run_id").transformWithStateInPandas(_Replay(), ITEMS, "Update", "None")
