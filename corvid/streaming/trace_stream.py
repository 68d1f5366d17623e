"""Structured Streaming over append-only trace logs.

The file source treats files as immutable, so a log is a folder of pieces that
only grows (one piece per program run, time slice or size). Pieces are read by
the record separator, so a large piece is cut into splits for many tasks.
Records carry no event time, hence no watermark.

T13 works in two stages, each a streaming query of its own. The first reads
records and writes *fragments*: within a split, the records before the first
marker, then one row per marker. The second carries one small summary a split
through ``transformWithState``, keyed by log: what a split adds to the state of
a log is associative (``merge_states``), so the state before every split is a
scan over summaries in path order, whatever order they arrive in. The runs are
fragments summed by (log, run), their run numbers shifted by the scan. No group
holds a log's records, only a row per split.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvid.functions.trace_text import BLANKS, ENTRY, RECORD_END, RUN_MARKER, parse_trace, record_name
from corvid.sources.trace_files import log_of, write_logs  # noqa: F401  (writer kept importable from here)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trace_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming records ``(log, file_path, block_start, value)`` of a log folder."""
    r = spark.readStream.option("lineSep", RECORD_END).option("recursiveFileLookup", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    fp = F.col("_metadata.file_path")
    return r.text(path).where(F.btrim("value", F.lit(BLANKS)) != "").select(
        log_of(fp).alias("log"), fp.alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), "value")


def stream_call_counts(records: DataFrame) -> DataFrame:
    """Running record count per function name (complete/update mode)."""
    p = records.select(parse_trace(F.col("value")).alias("p")).where("p.ok")
    return p.groupBy(F.col("p.name").alias("name")).agg(F.count(F.lit(1)).alias("calls"))


# ---------------------------------------------------------------- T13, first stage
#: ``part`` 0 is before the first marker, part k begins at the k-th; row 0 of a
#: split, always there, also says how many markers the split has and its last part.
FRAGMENTS = ("log string, file_path string, block_start bigint, part bigint, records bigint, has_main boolean, "
             "markers bigint, last_records bigint, last_main boolean")


def _fragments_of(markers, mains):
    """(records, has_main) of parts 0, 1, ... of a split from two flags a record."""
    import numpy as np
    part = np.cumsum(markers)
    n = int(part[-1]) + 1 if len(part) else 1
    return np.bincount(part, minlength=n), np.bincount(part[mains], minlength=n) > 0


def _cut(batches: Iterable) -> Iterator:
    import numpy as np
    import pyarrow as pa

    open_key, flags = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if open_key is None:
            return
        records, main = _fragments_of(np.concatenate([f[0] for f in flags]), np.concatenate([f[1] for f in flags]))
        n = len(records)
        first = [True] + [False] * (n - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([open_key[0]] * n, pa.string()), pa.array([open_key[1]] * n, pa.string()),
             pa.array([open_key[2]] * n, pa.int64()), pa.array(np.arange(n)), pa.array(records), pa.array(main),
             pa.array([n - 1 if f else None for f in first], pa.int64()),
             pa.array([int(records[-1]) if f else None for f in first], pa.int64()),
             pa.array([bool(main[-1]) if f else None for f in first], pa.bool_())],
            names=["log", "file_path", "block_start", "part", "records", "has_main", "markers", "last_records", "last_main"])

    for batch in batches:
        keys = list(zip(*[batch.column(i).to_pylist() for i in range(3)]))
        marker, main = (batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (3, 4))
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != open_key:
                yield from close()
                open_key, flags = keys[at], []
            flags.append((marker[at:to], main[at:to]))
            at = to
    yield from close()


def run_fragments(records: DataFrame, marker: str = RUN_MARKER, entry: str = ENTRY) -> DataFrame:
    """The fragments of every split, made where the split is read (a split's
    records are consecutive in its task). Two flags a record reach Python,
    never its text. Works on a stream or a table of records."""
    name = F.coalesce(record_name(F.col("value")), F.lit(""))
    slim = records.select("log", "file_path", "block_start", (name == marker).alias("is_marker"), (name == entry).alias("is_main"))
    return slim.mapInArrow(_cut, FRAGMENTS)


# ---------------------------------------------------------------- T13, second stage
#: The state of a log: (markers so far, records and main flag of the open run).
Split = tuple[int, int, bool, int, bool]


def merge_states(a: Split, b: Split) -> Split:
    """What two consecutive stretches of a log add together.

    A stretch is (markers, records and main flag before the first marker, records
    and main flag from the last marker on); without a marker both are the whole.
    Associative: a scan may join stretches in any grouping.
    """
    (ma, ha, pa, ta, qa), (mb, hb, pb, tb, qb) = a, b
    if not ma and not mb:
        return 0, ha + hb, pa or pb, ha + hb, pa or pb
    if not ma:
        return mb, ha + hb, pa or pb, tb, qb
    if not mb:
        return ma, ha, pa, ta + hb, qa or pb
    return ma + mb, ha, pa, tb, qb


EMPTY: Split = (0, 0, False, 0, False)

SCAN_OUT = ("log string, file_path string, block_start bigint, run_before bigint, run long, records long, has_main boolean")


class SplitScan(StatefulProcessor):
    """Per log: summaries of all splits seen, a row each. New ones are put in
    path order and the scan is done anew from the first of them on, so a piece
    that arrives late moves the runs behind it and no others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.splits = handle.getMapState(
            "splits", "file_path string, block_start bigint",
            "markers bigint, head bigint, head_main boolean, tail bigint, tail_main boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd
        first = None
        for chunk in rows:
            for r in chunk.itertuples(index=False):
                at = (r.file_path, int(r.block_start))
                self.splits.updateValue(at, (int(r.markers), int(r.records), bool(r.has_main), int(r.last_records), bool(r.last_main)))
                first = at if first is None else min(first, at)
        out, state = [], EMPTY
        for at, value in sorted((tuple(k), tuple(v)) for k, v in self.splits.iterator()):
            before, state = state, merge_states(state, value)
            if first is not None and at >= first:
                out.append((key[0], *at, before[0], state[0], state[3], state[4]))
        yield pd.DataFrame(out, columns=["log", "file_path", "block_start", "run_before", "run", "records", "has_main"])

    def close(self) -> None:
        pass


def stream_run_state(fragments: DataFrame) -> DataFrame:
    """For every split of a batch and those behind it, the runs begun
    before it, and the open run at its end with its records so far and whether
    ``main`` was seen (update mode; the last row of a split counts).

    ``fragments`` is a stream of ``run_fragments``; only its row 0 of each split
    enters the state. Needs the RocksDB state store (``run_available_now``).
    """
    summaries = fragments.where("part = 0").select("log", "file_path", "block_start", "markers", "records", "has_main",
                                                   "last_records", "last_main")
    return summaries.groupBy("log").transformWithStateInPandas(SplitScan(), SCAN_OUT, "Update", "None")


def latest_scan(emitted: DataFrame) -> DataFrame:
    """The last emitted row of each split (``batch_id`` is the sink's)."""
    names = ["run_before", "run", "records", "has_main"]
    return emitted.groupBy("log", "file_path", "block_start").agg(
        F.max_by(F.struct(*names), "batch_id").alias("s")).select("log", "file_path", "block_start", "s.*")


def run_table(fragments: DataFrame, scan: DataFrame) -> DataFrame:
    """``(log, run, records, has_main, closed)``: every run of every log. Run 0
    is what came before the first marker; the last run of a log is open."""
    split = ["log", "file_path", "block_start"]
    rows = fragments.join(scan.select(*split, "run_before"), split).select(
        "log", (F.col("run_before") + F.col("part")).alias("run"), "records", "has_main")
    runs = rows.groupBy("log", "run").agg(F.sum("records").alias("records"), F.bool_or("has_main").alias("has_main"))
    last = scan.groupBy("log").agg(F.max("run").alias("last"))
    return runs.where("records > 0").join(last, "log").withColumn("closed", F.col("run") < F.col("last")).drop("last")


def follow_runs(spark: SparkSession, logs: str, base: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """T13 end to end, up to what is there now: both stages with checkpoints
    under ``base``, and the table of runs. Called again, it goes on with the
    pieces that have come since."""
    fragments = run_fragments(trace_stream(spark, logs, max_files_per_trigger))
    run_available_now(fragments, f"{base}/fragments-checkpoint", "append", "parquet", path=f"{base}/fragments")
    stream = spark.readStream.schema(FRAGMENTS).parquet(f"{base}/fragments")
    run_available_now(stream_run_state(stream), f"{base}/scan-checkpoint", "update", "foreach_parquet", path=f"{base}/scan")
    return run_table(spark.read.schema(FRAGMENTS).parquet(f"{base}/fragments"), latest_scan(spark.read.parquet(f"{base}/scan")))


def run_available_now(df: DataFrame, checkpoint: str, mode: str, sink: str, table: str | None = None,
                      path: str | None = None):
    """Run a streaming frame over everything available, then stop.

    ``sink``: ``memory`` (small test results; ``table`` is the query name),
    ``foreach_parquet`` (each micro-batch written under ``path`` as its batch
    id, once even if it is repeated; works with update mode and keeps results
    off the driver), or a file format name for append mode. State is kept in
    RocksDB.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    try:
        w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        if sink == "memory":
            q = w.format("memory").queryName(table).start()
        elif sink == "foreach_parquet":
            def write_batch(batch, batch_id):
                batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            q = w.foreachBatch(write_batch).start()
        else:
            q = w.format(sink).option("path", path).start()
        q.awaitTermination()
    finally:
        conf.set(name, before) if before else conf.unset(name)
    return q
