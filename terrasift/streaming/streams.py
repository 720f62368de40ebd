"""Structured Streaming forms of the mission event operators.

Per-key logic that depends on order (track edges, life cycles, timers) keeps its state in the state
store through ``transformWithState``; a micro-batch hands over one key's new rows, which its trigger
options bound. Sums and first-wins rules use the built-in streaming aggregation and deduplication.
Each operator has a batch twin in ``operators.state`` or ``operators.tracks``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import movement, timefn
from ..functions import grid as G
from ..functions.geo import floor_long
from ..operators import coverage as C
from ..session import shared_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with changelog in the checkpoint, as stateful operators with timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(stream: DataFrame, purpose: str, mode: str = "append") -> DataFrame:
    """Process everything available, then read the output table; state and output live in shared storage."""
    spark = stream.sparkSession
    out, ckpt = shared_dir(spark, purpose), shared_dir(spark, purpose + "-ckpt")
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_complete(stream: DataFrame, purpose: str) -> DataFrame:
    """Like :func:`run_available` for an aggregation whose groups are still open: changed groups are
    written per micro-batch in update mode and the newest version of each group is read."""
    spark = stream.sparkSession
    out, ckpt = shared_dir(spark, purpose), shared_dir(spark, purpose + "-ckpt")
    keys = [c for c in stream.columns if c != "intensity"]

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy(*keys).agg(F.max_by("intensity", "batch").alias("intensity"))


# ---------------------------------------------------------------- keyed folds
class _Fold(StatefulProcessor):
    """Fold a key's rows, in the order of one column, over a small state row."""

    def __init__(self, state_schema: str, order: str, start: tuple, step: Callable, columns: list[str]):
        self.state_schema, self.order, self.start, self.step, self.columns = state_schema, order, start, step, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", self.state_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        state = tuple(self.state.get()) if self.state.exists() else self.start
        out = []
        for row in new.itertuples(index=False):
            state, emitted = self.step(key, state, row)
            out.extend(emitted)
        self.state.update(state)
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _fold(stream: DataFrame, keys: list[str], order: str, state: str, start: tuple, step: Callable, out: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    names = [c.strip().split(" ")[0] for c in out.split(",")]
    return stream.groupBy(*keys).transformWithStateInPandas(_Fold(state, order, start, step, names), outputStructType=out, outputMode="Append", timeMode="None")


def live_edges(fixes: DataFrame) -> DataFrame:
    """Edges of live tracks with their admission status; the previous fix of a track is its state.

    Columns in: track_id, seq, t_s, x_m, y_m (planar metres).
    """

    def step(key, s, r):
        here = (int(r.seq), float(r.t_s), float(r.x_m), float(r.y_m))
        if s[0] < 0:
            return here, []
        if r.seq <= s[0]:
            return s, []  # an already processed or late fix never rewrites an edge
        dt, length = here[1] - s[1], ((here[2] - s[2]) ** 2 + (here[3] - s[3]) ** 2) ** 0.5
        v = length / dt if dt else None
        status = "gap" if dt > 120 else "excluded" if v is None or v < 0.08 or v > 3 or length > 250 else "admitted"
        return here, [(int(key[0]), here[0], here[1], dt, length, s[2], s[3], here[2], here[3], status)]

    out = "track_id bigint, seq bigint, t_s double, dt double, length double, prev_x_m double, prev_y_m double, x_m double, y_m double, status string"
    return _fold(fixes, ["track_id"], "seq", "seq bigint, t double, x double, y double", (-1, 0.0, 0.0, 0.0), step, out)


def mission_status(changes: DataFrame) -> DataFrame:
    """Accepted status changes per mission; nothing is accepted after a hand-over, and no-ops are dropped."""

    def step(key, s, r):
        if s[0] == "HANDED_OVER" or r.status == s[0]:
            return s, []
        return (r.status,), [(int(key[0]), int(r.seq), r.status)]

    return _fold(changes, ["mission_id"], "seq", "status string", ("ACTIVE",), step, "mission_id bigint, seq bigint, status string")


class _Lifecycle(StatefulProcessor):
    """Upload, apply, reject and version events of a mission; a track is settled exactly once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "n bigint")
        self.tracks = handle.getMapState("tracks", "track bigint", "status string")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        version = (self.version.get() or (0,))[0]
        stored: dict = {}  # status of the tracks in these rows, each read from the state once
        status: dict = {}
        out = []
        for seq, track, kind, expected in zip(*(new[c].tolist() for c in ("seq", "track_id", "kind", "expected_version")), strict=True):
            if kind == "VERSION":
                version += 1
                continue
            if track not in stored:
                row = self.tracks.getValue((track,))
                stored[track] = status[track] = None if row is None else row[0]
            if kind == "UPLOAD":
                if status[track] is None:
                    status[track] = "UPLOADED"
                continue
            if status[track] is None:
                outcome = "UNKNOWN_TRACK"
            elif status[track] != "UPLOADED":
                outcome = "ALREADY_PROCESSED"
            elif kind == "APPLY" and expected != version:
                outcome = "VERSION_CONFLICT"
            else:
                outcome = status[track] = "APPLIED" if kind == "APPLY" else "REJECTED"
            out.append((int(key[0]), track, seq, outcome))
        for track, now in status.items():
            if now != stored[track]:
                self.tracks.updateValue((track,), (now,))
        self.version.update((version,))
        yield pd.DataFrame(out, columns=["mission_id", "track_id", "seq", "outcome"])

    def close(self) -> None:
        pass


def track_lifecycle(log: DataFrame) -> DataFrame:
    use_rocksdb(log.sparkSession)
    return log.groupBy("mission_id").transformWithStateInPandas(
        _Lifecycle(), outputStructType="mission_id bigint, track_id bigint, seq bigint, outcome string", outputMode="Append", timeMode="None")


def idempotent(requests: DataFrame, ttl_s: int = 120) -> DataFrame:
    """First request of a key creates, equal input replays, other input conflicts."""

    def step(key, s, r):
        if s[0] < 0:
            s = (int(r.seq), r.input_hash, int(r.t_s))
            outcome = "CREATED"
        else:
            outcome = "REPLAYED" if r.input_hash == s[1] else "CONFLICT"
        return s, [(int(key[0]), int(key[1]), int(r.seq), outcome, bool(r.t_s > s[2] + ttl_s))]

    return _fold(requests, ["mission_id", "request_key"], "seq", "seq bigint, input_hash string, t_s bigint", (-1, "", 0), step,
                 "mission_id bigint, request_key bigint, seq bigint, outcome string, expired boolean")


class _Overdue(StatefulProcessor):
    """One timer per member at last check-in plus interval; it fires without new events.

    A later check-in leaves the timer where it is: when it fires too early, it is set again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint, interval_ms bigint, active boolean, timer_ms bigint")

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows))
        last, interval, active, timer = self.last.get() or (0, 0, True, None)
        ms = new["ts"].astype("int64") // {"ns": 1_000_000, "us": 1000, "ms": 1}[new["ts"].dt.unit]
        newest = int(ms.to_numpy().argsort(kind="stable")[-1])
        last = max(last, int(ms.iloc[newest]))
        interval, active = int(new["interval_s"].iloc[newest]) * 1000, bool(active and not new["revoked"].any())
        due = last + interval + 1
        if active and (timer is None or due < timer):  # a shorter interval may bring it forward
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.last.update((last, interval, active, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, interval, active, _ = self.last.get()
        due = last + interval + 1
        if not active or due <= timerValues.getCurrentWatermarkInMs():
            self.last.update((last, interval, active, None))
            rows = [(int(key[0]), last, last + interval)] if active else []
            yield pd.DataFrame(rows, columns=["member_id", "last_ms", "due_ms"])
        else:
            self.handle.registerTimer(due)
            self.last.update((last, interval, active, due))

    def close(self) -> None:
        pass


def overdue(checkins: DataFrame, delay: str = "1 minute") -> DataFrame:
    """A row per volunteer whose check-in became overdue as event time moved on.

    Columns in: member_id, ts TIMESTAMP, interval_s, revoked.
    """
    use_rocksdb(checkins.sparkSession)
    return checkins.withWatermark("ts", delay).groupBy("member_id").transformWithStateInPandas(
        _Overdue(), outputStructType="member_id bigint, last_ms bigint, due_ms bigint", outputMode="Append", timeMode="EventTime")


# ---------------------------------------------------------------- built-in streaming operators
def dedupe_tracks(uploads: DataFrame, delay: str | None = None, ts: str = "ts") -> DataFrame:
    """First upload per (mission, geometry). With a delay the keys are forgotten once the watermark passes."""
    keys = ["mission_id", "geometry_sha"]
    return uploads.dropDuplicates(keys) if delay is None else uploads.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def refresh_tick(missions: DataFrame, now: Column) -> DataFrame:
    age = now - F.col("base_s")
    return missions.withColumn("elapsed_s", timefn.refresh_elapsed(age)).withColumn("expired", timefn.refresh_expired(age))


def _kernel(sigma: Column) -> Column:
    """Array of struct<k, w>: a normalised kernel cut at three sigma."""
    r = F.floor(3 * sigma + 0.5).cast("int")
    raw = F.transform(F.sequence(-r, r), lambda k: F.struct(k.alias("k"), F.exp(-0.5 * F.pow(k / sigma, 2)).alias("w")))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x["w"])
    return F.transform(raw, lambda x: F.struct(x["k"].alias("k"), (x["w"] / total).alias("w")))


def stream_evidence(edges: DataFrame, delay: str = "6 hours", horizon: int = G.MAX_FORECAST_S, width: float = 15.0) -> DataFrame:
    """Evidence per mission, 60 s bin and cell from admitted edges.

    ``base`` is the mission's start; a bin is stamped at its end and a fix on a border belongs to the bin
    that ends there, so the bin is computed and not a built-in window. Tracks are uploaded after the walk, in
    any order, so the watermark waits for the whole horizon by default. Everything before the sum is linear
    and row-wise, which leaves one streaming aggregation. Columns in: mission_id, base TIMESTAMP, ts
    TIMESTAMP, prev_row, prev_col, row, col, length, status, team_size, spacing_m.
    """
    age = (F.unix_micros("ts") - F.unix_micros("base")) / 1e6
    e = edges.where("status = 'admitted'").withColumn("bin_end_s", (F.ceil(age / G.BIN_SECONDS) * G.BIN_SECONDS).cast("bigint"))
    e = e.where((age >= 0) & (F.col("bin_end_s") <= horizon)).withColumn("bin_end", F.timestamp_micros(F.unix_micros("base") + F.col("bin_end_s") * 1_000_000))
    e = e.withColumn("b", movement.team_band("team_size", "spacing_m")).where("b is not null").withColumn("ker", _kernel(movement.band_sigma("b.width")))
    e = e.withWatermark("bin_end", delay)
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / 5.0)).cast("int")
    e = e.withColumn("steps", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    a = (F.col("i") + 0.5) / F.col("steps")
    e = e.withColumn("rr", F.col("prev_row") + a * (F.col("row") - F.col("prev_row")) - 0.5).withColumn("cc", F.col("prev_col") + a * (F.col("col") - F.col("prev_col")) - 0.5)
    unit = F.col("length") / F.col("steps") / G.CELL**2 * F.col("b.mult") * width
    corners = []
    for dr in (0, 1):
        for dc in (0, 1):
            r, c = floor_long("rr") + dr, floor_long("cc") + dc
            corners.append(F.struct(r.alias("r"), c.alias("c"), ((1 - F.abs(F.col("rr") - r)) * (1 - F.abs(F.col("cc") - c)) * unit).alias("v")))
    e = e.select("mission_id", "bin_end", "bin_end_s", "ker", F.explode(F.array(*corners)).alias("q"))
    e = e.where(F.col("q.r").between(0, G.N - 1) & F.col("q.c").between(0, G.N - 1))
    e = e.withColumn("kr", F.explode("ker")).withColumn("kc", F.explode("ker"))
    e = e.select("mission_id", "bin_end", "bin_end_s", (F.col("q.r") + F.col("kr.k")).alias("row"), (F.col("q.c") + F.col("kc.k")).alias("col"), (F.col("q.v") * F.col("kr.w") * F.col("kc.w")).alias("v"))
    e = e.where(F.col("row").between(0, G.N - 1) & F.col("col").between(0, G.N - 1))
    return e.groupBy("mission_id", "bin_end", "bin_end_s", "row", "col").agg(F.sum("v").alias("intensity"))


def screen_late(fixes: DataFrame, good: str, quarantine: str, checkpoint: str, base: str = "base_s", horizon: int = G.MAX_FORECAST_S):
    """Start a query that sorts fixes into two folders: usable ones, and those of tracks with a fix before the base time.

    Each micro-batch owns a folder named by its id, so a repeated batch replaces its own output only. A
    track may be dealt over any batches: :func:`screened` refuses it whole, whichever batch held the early
    fix. Fixes beyond the horizon are ignored unless their track is refused.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        age = F.col("t_s") - F.col(base)
        early = batch.where(age < 0).select("track_id").distinct().withColumn("early", F.lit(True))
        tag = batch.join(early, "track_id", "left").withColumn("early", F.coalesce("early", F.lit(False)))
        within = F.ceil(age / G.BIN_SECONDS) * G.BIN_SECONDS <= horizon
        tag.where(~F.col("early")).drop("early").withColumn("within", within).write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        tag.where("early").drop("early").write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")

    return fixes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def screened(spark: SparkSession, good: str, quarantine: str) -> tuple[DataFrame, DataFrame]:
    """(usable fixes, refused fixes with a reason) of all batches so far: a track with one early fix is refused whole."""
    kept, held = spark.read.parquet(good), spark.read.parquet(quarantine)
    refused = held.select("track_id").distinct()
    back = kept.join(refused, "track_id", "left_semi").drop("within")
    used = kept.join(refused, "track_id", "left_anti").where("within").drop("within")
    return used, held.unionByName(back).withColumn("reason", F.lit("BEFORE_BASE_TIME"))


def running_coverage(edges: DataFrame, out: str, checkpoint: str):
    """Start a query that adds each micro-batch's spread effort to a table of parts.

    Effort adds up, so a batch writes its own sums under its id and :func:`coverage_total` sums the
    parts; nothing is read back or rewritten, and a repeated batch replaces only its own part.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        C.team_coverage(batch, ["mission_id"]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coverage_total(spark: SparkSession, out: str, upto_batch: int | None = None) -> DataFrame:
    parts = spark.read.parquet(out)
    if upto_batch is not None:
        parts = parts.where(F.col("batch") <= upto_batch)
    return parts.groupBy("mission_id", "row", "col").agg(F.sum("effort").alias("effort"))
