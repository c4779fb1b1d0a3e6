"""Rate limits per client as relations, the same limits as a stream, and positions in queues.

A client's window begins at its first request, and the next one at the first request that comes a window's length later or
more, whatever became of the requests between. So windows follow from times alone: every request links to the first one a
window later, and the requests that the client's first one leads to begin windows. Pointer doubling finds them in as many
joins as the logarithm of their number. Times are cut into stretches of a window's length; what a request needs of its
client lies in its own stretch or a neighbour's, or is carried over from earlier ones, which are summed up first. A client
with a third of all requests is therefore spread over its stretches.

A request that ends later than the next one begins holds a place. Requests that no earlier one can reach into begin a
busy period; within one, who gets a place depends on who got one before, which a fold over the period's requests decides.
Periods meet only in how many requests a window has let in already. That number is computed for all periods at once
from the last round's verdicts, and periods for which it changed are folded again until none does. Later verdicts never
bear on earlier ones, so this ends. A period is one task's; a client that is never idle for as long as it is seen is one
period.

Defined results. Requests of one time go by event_id. A null client is a client of its own; requests without a time are not
judged and give no row. A request without an end, or one before its begin, ends at once, and one that ends when another
begins makes room for it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.operators.stage import forget, free_names, staged

#: Requests in progress and in a window; the window; seconds after which a client with too many in progress may
#: come back.
CONCURRENT, PER_WINDOW, WINDOW_MS, BUSY_S = 3, 60, 600_000, 10
_DECISION = "event_id long, user_id long, admitted boolean, reason string, retry_s long"


def _before(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _stretches(requests: DataFrame, window_ms: int) -> DataFrame:
    return requests.withColumn("stretch", F.floor(F.col("at") / window_ms))


def window_starts(requests: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """client, began: the times at which windows of the requests (client, at) begin."""
    times = staged(_stretches(requests.select("client", "at").distinct(), window_ms), "limit-times")
    firsts = times.groupBy("client", "stretch").agg(F.min("at").alias("at"))
    following = firsts.select("client", "stretch", F.lead("at").over(Window.partitionBy("client").orderBy("stretch")).alias("after"))
    # within the next stretch: the first time that is late enough; asking rows stand before answers of the same time
    asks = times.select("client", (F.col("stretch") + 1).alias("stretch"), (F.col("at") + window_ms).alias("at"), F.col("at").alias("asked"))
    both = asks.unionByName(times.withColumn("asked", F.lit(None).cast("long")))
    ahead = Window.partitionBy("client", "stretch").orderBy("at", F.desc_nulls_last("asked")).rowsBetween(0, Window.unboundedFollowing)
    inside = both.withColumn("next", F.first(F.when(F.col("asked").isNull(), F.col("at")), ignorenulls=True).over(ahead)).filter("asked is not null")
    # else the first time of a later stretch: carried from the next stretch that has any, or from the one after it
    later = following.withColumnRenamed("stretch", "of")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    own = later.select(F.col("client").alias("c"), (F.col("of") + 1).alias("s"), F.col("after").alias("beyond"))
    nxt = later.select(F.col("client").alias("c2"), F.col("of").alias("s2"), F.col("after").alias("past"))
    linked = inside.join(own, same("client", "c") & (F.col("stretch") == F.col("s")), "left").join(nxt, same("client", "c2") & (F.col("stretch") == F.col("s2")), "left")
    # the stretch asked has times: what comes after it; it has none: what comes after the own one
    jump = linked.select("client", F.col("asked").alias("at"), F.coalesce("next", F.when(F.col("s2").isNotNull(), F.col("past")).otherwise(F.col("beyond"))).alias("to")).filter("to is not null")
    jumps, reached = staged(jump, "limit-jumps"), staged(times.groupBy("client").agg(F.min("at").alias("at")), "limit-starts")
    while not jumps.isEmpty():
        hop = jumps.select(F.col("client").alias("c"), F.col("at").alias("a"), F.col("to"))
        more = reached.join(hop, same("client", "c") & (F.col("at") == F.col("a"))).select("client", F.col("to").alias("at"))
        twice = jumps.select("client", "at", F.col("to").alias("via")).join(hop, same("client", "c") & (F.col("via") == F.col("a"))).select("client", "at", "to")
        before = jumps, reached
        reached, jumps = staged(reached.unionByName(more).distinct(), "limit-starts"), staged(twice, "limit-jumps")
        forget(*before)
    forget(times, jumps)
    return reached.withColumnRenamed("at", "began")


def in_windows(requests: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """requests (client, at, ...) with began, the begin of their window, which lies in their stretch or the one before."""
    starts = _stretches(window_starts(requests, window_ms).withColumnRenamed("began", "at"), window_ms)
    near = starts.select(F.col("client").alias("c"), F.col("at").alias("began"), F.explode(F.array("stretch", F.col("stretch") + 1)).alias("s"))
    held = _stretches(requests, window_ms)
    match = F.col("client").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s")) & (F.col("began") <= F.col("at")) & (F.col("at") < F.col("began") + window_ms)
    return held.join(near, match).drop("c", "s")


def busy_periods(requests: DataFrame) -> DataFrame:
    """requests (client, stretch, at, event_id, until, ...) with period, the number of their busy period in their client."""
    order = Window.partitionBy("client", "stretch").orderBy("at", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)

    def carried(df: DataFrame, what: Column, name: str) -> DataFrame:
        sums = df.groupBy("client", "stretch").agg(what.alias("whole"))
        prior = (F.max if name == "reach" else F.sum)("whole").over(_before(["client"], "stretch"))
        sums = sums.select(F.col("client").alias("c"), F.col("stretch").alias("s"), prior.alias(name))
        return df.join(sums, F.col("client").eqNullSafe(F.col("c")) & (F.col("stretch") == F.col("s"))).drop("c", "s")

    reach = carried(requests, F.max("until"), "reach")
    last = F.greatest(F.col("reach"), F.max("until").over(so_far))  # greatest passes over nulls
    opened = staged(reach.withColumn("opens", (last.isNull() | (F.col("at") >= last)).cast("long")).drop("reach"), "limit-opens")
    numbered = carried(opened, F.sum("opens"), "periods")
    return numbered.withColumn("period", F.coalesce("periods", F.lit(0)) + F.sum("opens").over(order)).drop("periods", "opens")


def _folded(events: Column, let_in: Column, concurrent: int, per_window: int) -> Column:
    """event_id and reason (null: admitted) of a busy period's requests in order. let_in: what its first window has admitted."""
    none = F.expr("cast(array() as array<bigint>)")
    zero = F.struct(none.alias("places"), F.get(events, 0)["began"].alias("began"), let_in.cast("long").alias("n"), F.expr("cast(array() as array<struct<event_id:bigint,reason:string>>)").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        held = F.filter(acc["places"], lambda until: until > e["at"])
        n = F.when(acc["began"] == e["began"], acc["n"]).otherwise(F.lit(0))
        reason = F.when(F.size(held) >= concurrent, "CONCURRENT").when(n >= per_window, "RATE")
        judged = F.transform(F.array(F.struct(held.alias("held"), n.alias("n"), reason.alias("reason"))), lambda x: F.struct(
            F.when(x["reason"].isNull(), F.concat(x["held"], F.array(e["until"]))).otherwise(x["held"]).alias("places"), e["began"].alias("began"),
            (x["n"] + x["reason"].isNull().cast("long")).alias("n"), F.concat(acc["out"], F.array(F.struct(e["event_id"].alias("event_id"), x["reason"].alias("reason")))).alias("out"),
        ))
        return F.get(judged, 0)

    return F.aggregate(events, zero, step, lambda acc: acc["out"])


def _decisions(judged: DataFrame, window_ms: int) -> DataFrame:
    wait = F.greatest(F.lit(1), F.ceil((F.col("began") + window_ms - F.col("at")) / 1000))
    retry = F.when(F.col("reason") == "RATE", wait).when(F.col("reason") == "CONCURRENT", F.lit(BUSY_S)).cast("long")
    return judged.select("event_id", F.col("client").alias("user_id"), F.col("reason").isNull().alias("admitted"), "reason", retry.alias("retry_s"))


def rate_limited(events: DataFrame, per_window: int = PER_WINDOW, window_ms: int = WINDOW_MS, concurrent: int = CONCURRENT) -> DataFrame:
    """event_id, user_id, admitted, reason, retry_s for events (event_id, user_id, ts_ms, and end_ms if requests take time)."""
    end = F.greatest(F.coalesce("end_ms", "ts_ms"), F.col("ts_ms")) if "end_ms" in events.columns else F.col("ts_ms")
    requests = events.select("event_id", F.col("user_id").alias("client"), F.col("ts_ms").alias("at"), end.alias("until")).filter("at is not null")
    placed = in_windows(requests, window_ms)
    if "end_ms" not in events.columns:  # nobody holds a place: the first of each window are admitted
        nth = F.row_number().over(Window.partitionBy("client", "began").orderBy("at", "event_id"))
        return _decisions(placed.withColumn("reason", F.when(nth > per_window, "RATE")), window_ms)
    periods = busy_periods(placed)
    rows = F.array_sort(F.collect_list(F.struct("at", "event_id", "until", "began")))
    folds = staged(periods.groupBy("client", "period").agg(rows.alias("events")).withColumn("began", F.get("events", 0)["began"]), "limit-periods")
    judged = None
    while True:
        if judged is None:
            due = folds.withColumn("let_in", F.lit(0).cast("long"))
        else:
            # a period that spans windows counts in each; only its first one has periods before it
            counted = judged.select("client", "period", F.explode("verdicts").alias("v")).groupBy("client", "v.began", "period").agg(F.count_if(F.col("v.reason").isNull()).alias("n"))
            sums = counted.withColumn("let_in", F.least(F.coalesce(F.sum("n").over(_before(["client", "began"], "period")), F.lit(0)), F.lit(per_window)))
            known = sums.select(F.col("client").alias("c"), F.col("began").alias("b"), F.col("period").alias("p"), "let_in")
            due = folds.join(known, F.col("client").eqNullSafe(F.col("c")) & (F.col("began") == F.col("b")) & (F.col("period") == F.col("p"))).drop("c", "b", "p")
            if _same_counts(judged, due):
                break
        out = F.zip_with("events", _folded(F.col("events"), F.col("let_in"), concurrent, per_window), lambda e, v: F.struct(e["event_id"].alias("event_id"), e["at"].alias("at"), e["began"].alias("began"), v["reason"].alias("reason")))
        before, judged = judged, staged(due.select("client", "period", "let_in", out.alias("verdicts")), "limit-verdicts")
        if before is not None:
            forget(before)
    forget(folds)
    return _decisions(judged.select("client", F.explode("verdicts").alias("v")).select("client", "v.*"), window_ms)


def _same_counts(judged: DataFrame, due: DataFrame) -> bool:
    """Whether every period was folded with the count that its verdicts lead to."""
    was = judged.select(F.col("client").alias("c"), F.col("period").alias("p"), F.col("let_in").alias("was"))
    return due.join(was, F.col("client").eqNullSafe(F.col("c")) & (F.col("period") == F.col("p"))).filter("was <> let_in").isEmpty()


class WindowLimits:
    """A client's stream of requests, each ending at once: its state is the begin of its window and how many that let in.
    A timer drops the state when the window is over and no request can come late any more."""

    def __init__(self, per_window: int, window_ms: int):
        self.per_window, self.window_ms = per_window, window_ms

    def judged(self, at: np.ndarray, began: int | None, n: int) -> tuple[list[str | None], list[int | None], int, int]:
        """Reasons and waits for times in order, then the window's begin and count. A window's requests are taken at once."""
        reasons, waits, k = [], [], 0
        while k < len(at):
            if began is None or at[k] - began >= self.window_ms:
                began, n = int(at[k]), 0
            stop = int(np.searchsorted(at, began + self.window_ms, "left"))
            free = min(max(self.per_window - n, 0), stop - k)
            late = at[k + free : stop]
            reasons += [None] * free + ["RATE"] * len(late)
            waits += [None] * free + [max(1, -int((t - began - self.window_ms) // 1000)) for t in late.tolist()]
            n, k = n + free, stop
        return reasons, waits, began, n


def rate_limited_stream(events: DataFrame, per_window: int = PER_WINDOW, window_ms: int = WINDOW_MS) -> DataFrame:
    """The same as a stream, for requests that end at once. Requests of a micro-batch are taken in time order; one may come
    later than others by a window at most, else it is dropped as late. State goes by a timer of event time. A micro-batch's
    times and ids of one client are held, sixteen bytes a request."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rule = WindowLimits(per_window, window_ms)

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(b["ts_ms"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64)) for b in batches]
        at, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ids, at))
        began, n = state.get if state.exists else (None, 0)
        reasons, waits, began, n = rule.judged(at[order], began, n)
        state.update((began, n))
        state.setTimeoutTimestamp(max(began + window_ms, state.getCurrentWatermarkMs() + 1))
        for k in range(0, len(order), 10_000):
            part = slice(k, k + 10_000)
            yield pd.DataFrame({"event_id": ids[order][part], "user_id": key[0], "admitted": [r is None for r in reasons[part]], "reason": reasons[part], "retry_s": pd.array(waits[part], "Int64")})

    # a watermark begins at 0 and holds what is not after it to be late
    timed = events.withColumn("_at", F.timestamp_millis(F.col("ts_ms") + 1)).withWatermark("_at", f"{window_ms} milliseconds")
    return timed.groupBy("user_id").applyInPandasWithState(judge, _DECISION, "began long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def positions(waiting: DataFrame, queue: str, at: str, ties: str, seconds: int = 60) -> DataFrame:
    """waiting with its position, from 1, in its queue by time and ties. Events are counted by queue and stretch of time; an
    event's position is its rank in its stretch and the count of those before, so a long queue is ranked in many tasks."""
    stretch, queue_of, of, before, n, rank = free_names(waiting.columns, "stretch", "queue", "of", "before", "n", "rank")
    cut = waiting.withColumn(stretch, F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds))
    counts = cut.groupBy(queue, stretch).agg(F.count(F.lit(1)).alias(n))
    starts = counts.select(F.col(queue).alias(queue_of), F.col(stretch).alias(of), F.coalesce(F.sum(n).over(_before([queue], stretch)), F.lit(0)).alias(before))
    ranked = cut.withColumn(rank, F.row_number().over(Window.partitionBy(queue, stretch).orderBy(at, ties)))
    joined = ranked.join(starts, F.col(queue).eqNullSafe(F.col(queue_of)) & F.col(stretch).eqNullSafe(F.col(of)))
    return joined.select(*waiting.columns, (F.col(before) + F.col(rank)).alias("position"))
