"""Mission state as append-only tables: versions, plans, members, requests and their batch folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import grid as G
from ..functions import timefn
from . import coverage as C
from .ordered import ordered_scan, with_previous


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Names of the rules a row breaks; a rule that is NULL counts as broken."""
    return df.withColumn("violations", F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in rules.items()])))


MISSION_RULES = {
    "lon": "lon between 126.02 and 127.08", "lat": "lat between 33.0 and 33.67", "hours": "hours between 0.25 and 8", "sigma": "sigma between 5 and 500",
    "facility_strength": "facility_strength between 0 and 1", "night_factor": "night_factor between 0.3 and 1", "row_share": "row_share between 0 and 0.5",
    "team_size": "team_size between 1 and 12", "spacing_m": "spacing_m between 3 and 60", "minutes": "minutes between 5 and 120",
}


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The newest row per key, by an aggregate that combines before its shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def supersede(plans: DataFrame) -> DataFrame:
    """Only the last approved plan of a mission stays approved."""
    last = plans.where("status = 'APPROVED'").groupBy("mission_id").agg(F.max("plan_seq").alias("__last"))
    j = plans.join(last, "mission_id", "left")
    return j.withColumn("status", F.when((F.col("status") == "APPROVED") & (F.col("plan_seq") < F.col("__last")), "SUPERSEDED").otherwise(F.col("status"))).drop("__last")


def chain_ok(versions: DataFrame, block: int | None = None) -> DataFrame:
    """Per mission: whether every version names the hash before it, and how many do not."""
    p = with_previous(versions, ["mission_id"], "number", ["hash"], block)
    good = F.col("parent_hash") == F.coalesce("prev_hash", F.lit("genesis"))
    return p.groupBy("mission_id").agg(F.count(F.lit(1)).alias("versions"), F.count_if(~good).alias("broken"), F.bool_and(good).alias("ok"))


def listed_plans(plans: DataFrame, n: int = 20) -> DataFrame:
    """Every approved plan and the newest ``n`` of each mission, approved first.

    The newest are found by a rank limit that Spark applies before the shuffle.
    """
    w = W.partitionBy("mission_id").orderBy(F.desc("plan_seq"))
    newest = plans.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    both = newest.where("status <> 'APPROVED'").unionByName(plans.where("status = 'APPROVED'"))
    return both.withColumn("section", F.when(F.col("status") == "APPROVED", 0).otherwise(1))


def newest(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order])


def member_tracks(members: DataFrame, tracks: DataFrame, statuses: Sequence[str] = ("UPLOADED", "APPLIED", "REJECTED")) -> DataFrame:
    """Track counts by status for each member, matched on the submitter named in the track summary."""
    t = tracks.withColumn("member_id", F.get_json_object("summary", "$.submitted_by"))
    n = t.groupBy("member_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses])
    return members.join(n, "member_id", "left").fillna(0, [s.lower() for s in statuses])


def assignments(members: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone card of each member's assignment; UNKNOWN when the zone has no card."""
    z = zones.select("mission_id", "zone_id", "label", "access")
    j = members.where(F.col("zone_id").isNotNull()).join(z, ["mission_id", "zone_id"], "left")
    return j.withColumn("access", F.coalesce("access", F.lit("UNKNOWN")))


def progress(tracks: DataFrame, members: DataFrame) -> DataFrame:
    t = tracks.groupBy("mission_id").agg(F.count_if(F.col("status") == "APPLIED").alias("applied"), F.count_if(F.col("status") == "UPLOADED").alias("waiting"))
    m = members.groupBy("mission_id").agg(
        F.count_if((F.col("role") == "volunteer") & F.col("revoked_at").isNull()).alias("volunteers"), F.count_if((F.col("role") == "family") & F.col("revoked_at").isNull()).alias("family"))
    return t.join(m, "mission_id", "full").fillna(0)


def union_dedupe(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Union of parts, one row per id; of equal ids the part listed first wins."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    rest = [c for c in parts[0].columns if c != key]
    return both.groupBy(key).agg(F.min_by(F.struct(*rest), "__part").alias("__r")).select(key, "__r.*")


def verify(actual: DataFrame, manifest: DataFrame, name: str = "path") -> DataFrame:
    """MISSING, EXTRA or CHANGED members of a manifest; empty when everything matches."""
    j = actual.select(name, F.col("sha256").alias("a")).join(manifest.select(name, F.col("sha256").alias("m")), name, "full")
    problem = F.when(F.col("a").isNull(), "MISSING").when(F.col("m").isNull(), "EXTRA").when(F.col("a") != F.col("m"), "CHANGED")
    return j.select(name, problem.alias("problem")).where(F.col("problem").isNotNull())


def identical(files: DataFrame, order: str, sha: str = "sha256") -> DataFrame:
    """Contents that occur more than once, with the first occurrence, which is kept."""
    return files.groupBy(sha).agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


# ---------------------------------------------------------------- batch folds of the event streams
def bin_end(t: Column, base: Column, step: int = G.BIN_SECONDS) -> Column:
    """Seconds after the base of the end of the bin a fix belongs to; a fix on a border belongs to the bin ending there."""
    return (F.ceil((t - base) / step) * step).cast("bigint")


def evidence_bins(edges: DataFrame, base: Column, horizon: int = G.MAX_FORECAST_S, width: float = 15.0) -> DataFrame:
    """Coverage of each 60 s bin of the later fix, summed over team geometries; edges before the base and bins beyond the horizon are left out."""
    e = edges.where(F.col("t_s") >= base).withColumn("bin_end_s", bin_end(F.col("t_s"), base)).where(F.col("bin_end_s") <= horizon)
    c = C.team_coverage(e, ["mission_id", "bin_end_s"])
    return c.select("mission_id", "bin_end_s", "row", "col", (F.col("effort") * width).alias("intensity")).where("intensity > 0")


def screen_late(fixes: DataFrame, base: Column, key: str = "track_id", horizon: int = G.MAX_FORECAST_S) -> DataFrame:
    """A track with a fix before the base is refused as a whole; fixes beyond the horizon are ignored."""
    early = F.coalesce(F.bool_or(F.col("t_s") < base), F.lit(False))
    n_late = F.count_if(bin_end(F.col("t_s"), base) > horizon)
    return fixes.groupBy(key).agg(F.count(F.lit(1)).alias("points"), early.alias("refused"), n_late.alias("beyond_horizon"))


def dedupe_tracks_batch(uploads: DataFrame) -> DataFrame:
    """The first upload of each (mission, geometry); later ones are counted as duplicates."""
    return uploads.groupBy("mission_id", "geometry_sha").agg(F.min("upload_seq").alias("kept"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def track_lifecycle_batch(log: DataFrame, block: int | None = None) -> DataFrame:
    """Outcome of every apply or reject attempt.

    The log has UPLOAD, APPLY, REJECT and VERSION rows per mission. An attempt is settled by the
    uploads and valid attempts of its track before it; an apply also needs the map version it expects.
    """
    v = ordered_scan(log, ["mission_id"], "seq", sums={"version_at": (F.col("kind") == "VERSION").cast("bigint")}, block=block)
    acts = v.where("kind <> 'VERSION'")
    up = acts.groupBy("mission_id", "track_id").agg(F.min(F.when(F.col("kind") == "UPLOAD", F.col("seq"))).alias("up"))
    a = acts.where("kind <> 'UPLOAD'").join(up, ["mission_id", "track_id"])
    known = F.coalesce(F.col("up") < F.col("seq"), F.lit(False))
    valid = known & ((F.col("kind") == "REJECT") | (F.col("expected_version") == F.col("version_at")))
    a = a.withColumn("__known", known).withColumn("__valid", valid)
    first = a.where("__valid").groupBy("mission_id", "track_id").agg(F.min("seq").alias("__first"))
    a = a.join(first, ["mission_id", "track_id"], "left")
    outcome = (
        F.when(~F.col("__known"), "UNKNOWN_TRACK").when(F.col("__first") < F.col("seq"), "ALREADY_PROCESSED").when(~F.col("__valid"), "VERSION_CONFLICT")
        .when(F.col("kind") == "APPLY", "APPLIED").otherwise("REJECTED"))
    return a.select("mission_id", "track_id", "seq", outcome.alias("outcome"))


def mission_status_batch(changes: DataFrame) -> DataFrame:
    """Final status per mission; nothing after the first hand-over counts."""
    end = F.min(F.when(F.col("status") == "HANDED_OVER", F.col("seq")))
    g = changes.groupBy("mission_id").agg(end.alias("handed_over_at"), F.max_by("status", "seq").alias("__last"), F.max("seq").alias("__seq"))
    over = F.col("handed_over_at").isNotNull()
    return g.select(
        "mission_id", F.when(over, "HANDED_OVER").otherwise(F.col("__last")).alias("status"), F.coalesce("handed_over_at", "__seq").alias("updated_at"), "handed_over_at")


def hand_over(tracks: DataFrame, status: DataFrame) -> DataFrame:
    """Tracks after hand-over: waiting ones are rejected, raw content is replaced by its hash."""
    j = tracks.join(status.select("mission_id", F.col("handed_over_at").isNotNull().alias("__over")), "mission_id", "left").withColumn("__over", F.coalesce("__over", F.lit(False)))
    return j.select(
        *[c for c in tracks.columns if c not in ("status", "raw")],
        F.when(F.col("__over") & (F.col("status") == "UPLOADED"), "REJECTED").otherwise(F.col("status")).alias("status"),
        F.when(F.col("__over"), F.sha2("raw", 256)).alias("purged_sha"), F.when(~F.col("__over"), F.col("raw")).alias("raw"))


def overdue_batch(members: DataFrame, checkins: DataFrame, now: Column) -> DataFrame:
    """Members with their last check-in and whether it is overdue at ``now``."""
    last = checkins.groupBy("member_id").agg(F.max("t_s").alias("last_s"))
    j = members.join(last, "member_id", "left")
    late = (F.col("role") == "volunteer") & F.col("revoked_at").isNull() & (F.col("last_s").isNull() | (now - F.col("last_s") > F.col("interval_s")))
    return j.withColumn("overdue", F.coalesce(late, F.lit(False)))


def refresh_tick(missions: DataFrame, now: Column) -> DataFrame:
    age = now - F.col("base_s")
    return missions.withColumn("elapsed_s", timefn.refresh_elapsed(age)).withColumn("expired", timefn.refresh_expired(age))


def idempotent_batch(requests: DataFrame, ttl_s: int = 120) -> DataFrame:
    """First request per key creates; the same input replays, another input conflicts; results expire."""
    first = requests.groupBy("mission_id", "request_key").agg(F.min_by(F.struct("seq", "input_hash", "t_s"), "seq").alias("f"))
    j = requests.join(first, ["mission_id", "request_key"])
    outcome = F.when(F.col("seq") == F.col("f.seq"), "CREATED").when(F.col("input_hash") == F.col("f.input_hash"), "REPLAYED").otherwise("CONFLICT")
    return j.select("mission_id", "request_key", "seq", outcome.alias("outcome"), (F.col("t_s") > F.col("f.t_s") + ttl_s).alias("expired"))


def running_coverage_batch(additions: DataFrame, block: int | None = None) -> DataFrame:
    """Accumulated effort per cell at every version that touches it."""
    return ordered_scan(additions, ["mission_id", "row", "col"], "version", sums={"total": F.col("effort")}, block=block)
