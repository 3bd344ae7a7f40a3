"""Usage metering; each function takes a batch or a stream of events alike, unless it says otherwise."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.stats import order_statistic


@dataclass(frozen=True)
class Policy:
    """A limit of ``requests`` in ``seconds`` for paths with one of the prefixes; members have ``factor`` times as many."""

    name: str
    prefixes: tuple[str, ...]
    requests: int
    seconds: int = 60
    factor: float = 1.0


def sliding_requests(events: DataFrame, client: str = "user_id", ts: str = "ts", length: str = "60 seconds", step: str = "6 seconds", late: str = "60 seconds") -> DataFrame:
    """``client, window_start, n``: requests of each client in a sliding window."""
    counted = events.withWatermark(ts, late).groupBy(client, F.window(ts, length, step).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(client, F.col("w.start").alias("window_start"), "n")


def client_name(user: Column, authorization: Column, cookie: Column, forwarded: Column, host: Column) -> Column:
    """Who asks: the user; else a fingerprint of the bearer token, or of the session's cookie; else the first address."""
    print_of = lambda token: F.substring(F.sha2(token.cast("binary"), 256), 1, 24)
    token = F.when(F.lower(authorization).startswith("bearer "), F.nullif(F.trim(F.substring(authorization, 8, 1 << 20)), F.lit("")))
    address = F.coalesce(F.trim(F.split_part(F.nullif(forwarded, F.lit("")), F.lit(","), F.lit(1))), host, F.lit("unknown"))
    return F.coalesce(
        F.concat(F.lit("user:"), user.cast("string")),
        F.concat(F.lit("bearer:"), print_of(token)),
        F.concat(F.lit("session:"), print_of(F.nullif(cookie, F.lit("")))),
        F.concat(F.lit("ip:"), address),
    )


def _with_policy(requests: DataFrame, policies: list[Policy], default: Policy) -> DataFrame:
    """Adds ``policy, allowed, seconds``: the policy with the longest prefix of the path."""
    level = lambda p: F.struct(F.lit(p.name).alias("policy"), F.floor(p.requests * F.when(F.col("member"), float(p.factor)).otherwise(1.0)).cast("long").alias("allowed"), F.lit(p.seconds).cast("long").alias("seconds"))
    case = F.when(F.lit(False), level(default))
    for prefix, p in sorted(((x, p) for p in policies for x in p.prefixes), key=lambda item: -len(item[0])):
        case = case.when(F.startswith("path", F.lit(prefix)), level(p))
    return requests.withColumn("__p", case.otherwise(level(default))).select(*requests.columns, "__p.*")


DECISIONS = "client string, policy string, request_id long, n long, allowed long, throttled boolean"


def _decide_one(held: deque, at: int, seconds: int, allowed: int) -> tuple[int, bool]:
    """How many granted requests count at a time, and whether one more is refused; ``held`` has their times."""
    while held and held[0] <= at - seconds * 1_000_000:
        held.popleft()
    n = len(held)
    if n < allowed:
        held.append(at)
    return n, n >= allowed


def _decide(rows: pd.DataFrame, held: deque) -> pd.DataFrame:
    """Decisions of one client and policy in order of time."""
    rows = rows.sort_values(["at", "request_id"])
    made = [_decide_one(held, *x) for x in zip(rows["at"], rows["seconds"], rows["allowed"], strict=True)]
    return rows[["client", "policy", "request_id"]].assign(n=[n for n, _ in made], allowed=rows["allowed"], throttled=[no for _, no in made])


def limit_requests(requests: DataFrame, policies: list[Policy], default: Policy, ts: str = "ts") -> DataFrame:
    """``client, policy, request_id, n, allowed, throttled`` for a batch of ``request_id, client, path, member`` and a time.

    A request is refused if the client has ``allowed`` granted ones under the same
    policy in the last seconds; refused ones do not count later.  So decisions of a
    client depend on each other, and are made in order of time: rows are dealt by
    client and policy, sorted there, and read once as they come.  A task holds the
    times of the granted requests that still count, at most as many as are allowed,
    however long the history of a client is and even if it has no pause.  Null
    clients are one client.
    """
    rows = _with_policy(requests, policies, default).withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = rows.select("client", "policy", F.col("request_id").cast("long").alias("request_id"), "at", "seconds", "allowed")
    dealt = rows.repartition("client", "policy").sortWithinPartitions("client", "policy", "at", "request_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, deque()
        for batch in batches:
            clients, names, _, times, lengths, most = (c.to_pylist() for c in batch.columns)
            counts, refused = [], []
            for client, name, at, seconds, allowed in zip(clients, names, times, lengths, most, strict=True):
                if (client, name) != last:
                    last, held = (client, name), deque()
                n, no = _decide_one(held, at, seconds, allowed)
                counts.append(n)
                refused.append(no)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(counts, pa.int64()), batch.column(5), pa.array(refused, pa.bool_())], ["client", "policy", "request_id", "n", "allowed", "throttled"])

    return dealt.mapInArrow(run, DECISIONS)


def limit_stream(requests: DataFrame, policies: list[Policy], default: Policy, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """:func:`limit_requests` of a stream, in the order of its batches; requests later than ``late`` are dropped.

    The state of a client and policy is the times of the granted requests that
    still count; it goes when the watermark has passed the window.
    """
    rows = _with_policy(requests, policies, default).withWatermark(ts, late).withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        held = deque(state.get[0] if state.exists else [])
        yield _decide(rows, held)
        state.update((list(held),))
        state.setTimeoutTimestamp(int((rows["at"] // 1000 + rows["seconds"] * 1000).max()) + 1)

    keyed = rows.select("client", "policy", "request_id", ts, "at", "seconds", "allowed").groupBy("client", "policy")
    return keyed.applyInPandasWithState(step, DECISIONS, "granted array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def recent_requests(requests: DataFrame, seconds: int, client: str = "user_id", ts: str = "ts") -> DataFrame:
    """``request_id, n``: how many requests the client made in the last ``seconds``, this one included (a batch).

    Rows are kept by client and stretch of ``seconds``, each also in the next one, so
    no task holds more of a client's history than two windows.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    own = F.expr(f"at div {seconds * 1_000_000}")
    rows = requests.select(F.col(client).alias("client"), "request_id", at.alias("at")).withColumn("own", own)
    twice = rows.withColumn("stretch", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    window = Window.partitionBy("client", "stretch").orderBy("at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return twice.withColumn("n", F.count("*").over(window)).where("own = stretch").select("request_id", "n")


def longest_prefix(paths: DataFrame, policies: DataFrame) -> DataFrame:
    """``path, prefix, limit``: the longest prefix among the policies of each path that has one.

    A path meets the policies by equality, once for each length that a prefix has, so
    there may be any number of either.  Of two policies with one prefix the smaller
    limit counts.
    """
    once = policies.where("prefix is not null").groupBy("prefix").agg(F.min("limit").alias("limit"))
    lengths = [r.n for r in once.select(F.char_length("prefix").alias("n")).distinct().collect()]  # few: no path is longer
    cut = F.array_distinct(F.transform(F.lit(lengths or [0]), lambda n: F.substring("path", F.lit(1), n.cast("int"))))
    met = paths.where("path is not null").select("path", F.explode(cut).alias("prefix")).join(once, "prefix")
    return met.groupBy("path").agg(F.max_by(F.struct("prefix", "limit"), F.char_length("prefix")).alias("p")).select("path", "p.*")


def throttle(counts: DataFrame, requests: DataFrame, policies: DataFrame, default: int, factor: int = 2) -> DataFrame:
    """Adds ``policy``, ``allowed`` and ``throttled`` to requests with their count ``n``.

    The policy of the longest prefix of the path counts; members have ``factor`` times as many.
    """
    one = requests.join(longest_prefix(requests.select("path").distinct(), policies), "path", "left")
    allowed = F.coalesce("limit", F.lit(default)) * F.when(F.col("member"), factor).otherwise(1)
    return one.join(counts, "request_id").select("request_id", F.coalesce("prefix", F.lit("default")).alias("policy"), allowed.cast("long").alias("allowed"), (F.col("n") >= allowed).alias("throttled"))


def daily_calls(events: DataFrame, limit: int, user: str = "user_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    counted = events.withWatermark(ts, late).groupBy(user, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("calls"))
    return counted.select(user, F.to_date("w.start").alias("day"), "calls", (F.col("calls") > limit).alias("over_limit"))


def request_metrics(events: DataFrame, kind: str = "event_type", value: str = "value", ts: str = "ts", length: str = "1 day", late: str = "1 day") -> DataFrame:
    """``kind, day, n, mean, p95, most``; the percentile (nearest rank) is exact for a batch.

    Of a stream it is an estimate: exact up to 10,000 values of a kind and day, and
    within 0.01 % of the rank beyond.  For a batch values are counted first, so that
    a kind of any size is summed up in ranges (see ``stats.order_statistic``).
    """
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    sums = [F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most")]
    shown = lambda df: df.select(kind, "day", "n", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "most")])
    window = F.window(ts, length).alias("w")
    if events.isStreaming:
        counted = timed.groupBy(kind, window).agg(*sums, F.percentile_approx(value, 0.95, 10_000).alias("p95"))
        return shown(counted.withColumn("day", F.to_date("w.start")))
    rows = timed.select(kind, window, value).select(kind, F.col("w.start").alias("start"), value)
    p95 = order_statistic(rows, [kind, "start"], value, F.ceil(0.95 * F.col("n")) - 1).withColumnRenamed("value", "p95")
    met = rows.groupBy(kind, "start").agg(*sums).join(p95.withColumnRenamed("start", "__start").withColumnRenamed(kind, "__kind"), F.col(kind).eqNullSafe(F.col("__kind")) & (F.col("start") == F.col("__start")), "left")
    return shown(met.withColumn("day", F.to_date("start")))


def latest_state(events: DataFrame, task: str = "user_id", ts: str = "ts", state: str = "event_type", tie: str = "event_id") -> DataFrame:
    """The last state of each task."""
    return events.groupBy(task).agg(F.max_by(state, F.struct(ts, tie)).alias("state"), F.max(ts).alias("since"))
