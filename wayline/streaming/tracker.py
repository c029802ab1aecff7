"""Online matching: keyed state per device with thinning, late-sample errors, publication rules and expiry."""

from __future__ import annotations

import json
import time as clock
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wayline.functions import geodesic as g
from wayline.functions.hmm import Memory
from wayline.functions.network import Network
from wayline.operators.matcher import Matcher, Parameters

UPDATES = "id string, kind string, time_ms long, lon double, lat double, edge long, frac double, prob double, route_length double, candidates string"


@dataclass(frozen=True)
class TrackerSettings:
    """ttl_s: idle seconds (processing time) until a device is forgotten, None: never. k, t: bounds of the state. sensitive_m: moves below it on one edge are not published."""

    ttl_s: float | None = 60.0
    least_m: float = 0.0
    least_ms: int = 1000
    sensitive_m: float = 0.0
    k: int = 0
    t: int = -1


class Tracker:
    """The update of one device; no Spark in it, so that batch and stream share it."""

    def __init__(self, net: Network, params: Parameters, settings: TrackerSettings):
        self.matcher, self.params, self.settings = Matcher(net, params), params, settings

    def update(self, memory: Memory, published: dict | None, sample: dict) -> tuple[str, dict | None]:
        """Apply a sample; (outcome, record to publish or None). Outcomes: late, thinned, lost (no candidates), quiet, update."""
        last = memory.vectors[-1][0] if memory.vectors else None
        if last is not None and sample["time_ms"] < last["time_ms"]:
            return "late", None
        if not self.matcher.accept(last, sample, self.settings.least_m, self.settings.least_ms):
            return "thinned", None
        cands = self.matcher.net.near(sample["lon"], sample["lat"], self.params.radius)
        vector = self.matcher.step(memory.last(), last, sample, cands)
        if not vector:
            return "lost", None
        memory.update(vector, sample)
        s = memory.estimate()
        record = {
            "time_ms": sample["time_ms"], "lon": s.what[2], "lat": s.what[3], "edge": s.what[0], "frac": s.what[1], "prob": s.filtprob, "route_length": s.via[0] if s.via else None,
            "candidates": json.dumps([{"edge": c.what[0], "frac": c.what[1], "prob": c.filtprob} for c in memory.last()]),
        }
        if published and self.settings.sensitive_m > 0 and published["edge"] == record["edge"] and float(g.distance(published["lon"], published["lat"], record["lon"], record["lat"])) < self.settings.sensitive_m:
            return "quiet", None
        return "update", record


def track(samples: DataFrame, net: Network, params: Parameters = Parameters(), settings: TrackerSettings = TrackerSettings()) -> DataFrame:
    """A stream of updates (UPDATES) from a stream of samples (id, time_ms, lon, lat, azimuth), in append mode.

    kind: update; late (older than the state: not applied); delete, when a device was idle for ``ttl_s``. Samples of one device in one micro-batch are
    applied in order of time. The state is the k-bounded memory as text. Rows with null id, time or position are dropped.
    """
    shared = samples.sparkSession.sparkContext.broadcast(net)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cols = [c.split()[0] for c in UPDATES.split(", ")]
        if state.hasTimedOut:
            at = json.loads(state.get[0])["at"]
            state.remove()
            yield pd.DataFrame([(key[0], "delete", at, None, None, None, None, None, None, None)], columns=cols)
            return
        kept = json.loads(state.get[0]) if state.exists else None
        memory = Memory.from_json(kept["memory"]) if kept else Memory(settings.k, settings.t)
        published = kept["published"] if kept else None
        tracker, out = Tracker(shared.value, params, settings), []
        pdf = pd.concat(list(batches)).sort_values("time_ms", kind="stable")
        for r in pdf.itertuples(index=False):
            a = None if r.azimuth is None or pd.isna(r.azimuth) else float(r.azimuth)
            outcome, record = tracker.update(memory, published, {"time_ms": int(r.time_ms), "lon": float(r.lon), "lat": float(r.lat), "azimuth": a})
            if outcome == "late":
                out.append((key[0], "late", int(r.time_ms), *[None] * 7))
            elif record:
                published = record
                out.append((key[0], "update", *(record[c] for c in cols[2:])))
        at = memory.time() if memory.vectors else int(clock.time() * 1000)
        state.update((json.dumps({"memory": memory.to_json(), "published": published, "at": at}),))
        if settings.ttl_s is not None:
            state.setTimeoutDuration(max(1, int(settings.ttl_s * 1000)))
        yield pd.DataFrame(out, columns=cols)

    timeout = GroupStateTimeout.NoTimeout if settings.ttl_s is None else GroupStateTimeout.ProcessingTimeTimeout
    clean = samples.where("id is not null and time_ms is not null and lon is not null and lat is not null").select("id", "time_ms", "lon", "lat", "azimuth")
    return clean.groupBy("id").applyInPandasWithState(run, UPDATES, "state string", "append", timeout)


def publish_to(updates: DataFrame, table: dict[str, dict]):
    """A ``foreachBatch`` function for a last-value table kept by the caller: newer updates replace, older ones are dropped, deletes remove."""

    def each(df: DataFrame, _: int) -> None:
        for r in df.where("kind <> 'late'").orderBy("time_ms").toLocalIterator():
            have = table.get(r["id"])
            if r["kind"] == "delete":
                table.pop(r["id"], None)
            elif have is None or have["time_ms"] <= r["time_ms"]:
                table[r["id"]] = r.asDict()

    return updates.writeStream.foreachBatch(each)


def latest_state(samples: DataFrame, ttl_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """Batch twin of the state: the newest sample of each id; with ``ttl_ms`` only ids that are not expired at ``now_ms``."""
    from wayline.sources.samples import last_values

    x = last_values(samples)
    return x if ttl_ms is None else x.where(x["time_ms"] >= now_ms - ttl_ms)


def late_flags(samples: DataFrame, order: str) -> DataFrame:
    """Adds late: whether a sample is older than one of its id that arrived before it (in ``order``)."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return samples.withColumn("late", F.coalesce(F.col("time_ms") < F.max("time_ms").over(w), F.lit(False)))


def visible_candidates(updates: DataFrame, least: float = 0.01) -> DataFrame:
    """Candidates of updates worth showing: (id, time_ms, edge, frac, prob, opacity) with a probability above ``least``; opacity log10(9 p + 1)."""
    from pyspark.sql import functions as F

    c = F.from_json("candidates", "array<struct<edge: long, frac: double, prob: double>>")
    x = updates.select("id", "time_ms", F.explode(c).alias("c")).select("id", "time_ms", "c.*")
    return x.where(F.col("prob") > least).withColumn("opacity", F.log10(9 * F.col("prob") + 1))
