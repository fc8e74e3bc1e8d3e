"""Query logs as streams: debounced terms, latest-wins responses, search in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.index import Index
from quillspark.operators.search import search
from quillspark.sources.stored import stored

GAP_MS = 300


#: Microseconds of a piece of time, by which the requests of one user are spread.
PIECE = 60_000_000
_NEVER = 1 << 62  # microseconds


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def debounce(events: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Batch: user_id, ts, event_id, term of events after which the user is quiet for over gap_ms.

    Of events at one time the largest event_id counts. A newer event at exactly gap_ms supersedes, as in a session window. Events without a time are none.

    Time is cut into pieces of the gap's length. Only the last event of a user's piece can stay, and only the first of the next piece can supersede it, so
    pieces are added up before they are shuffled, and the events of one busy user (or of none) are spread by time.
    """
    gap = int(gap_ms * 1000)
    pieces = events.filter("ts is not null").withColumn("_piece", F.floor(_micros("ts") / max(gap, 1)))
    ends = pieces.groupBy("user_id", "_piece").agg(F.max(F.struct("ts", "event_id", "term")).alias("last"), F.min("ts").alias("first"))
    both = ends.select("user_id", F.explode(F.array(F.struct("_piece", "last", F.lit(None).cast(ends.schema["first"].dataType).alias("next")), F.struct((F.col("_piece") - 1).alias("_piece"), F.lit(None).cast(ends.schema["last"].dataType).alias("last"), F.col("first").alias("next")))).alias("e"))
    met = both.groupBy("user_id", "e._piece").agg(F.max("e.last").alias("last"), F.min("e.next").alias("next")).filter("last is not null")
    quiet = F.col("next").isNull() | (_micros("next") - _micros("last.ts") > gap)
    return met.filter(quiet).select("user_id", "last.ts", "last.event_id", "last.term")


def debounce_stream(events: DataFrame, gap_ms: int = GAP_MS, lateness: str = "10 seconds") -> DataFrame:
    """The same over a stream, in append mode: a session's last event, once the watermark has passed its end."""
    last = F.max_by(F.struct("ts", "event_id", "term"), F.struct("ts", "event_id"))
    sessions = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", f"{gap_ms} milliseconds")).agg(last.alias("last"))
    return sessions.select("user_id", "last.ts", "last.event_id", "last.term")


def latest_wins(requests: DataFrame) -> DataFrame:
    """Batch: requests (user_id, request_id, issued_at, completed_at) that finished before the user issued a newer one.

    Newer is later in the order of issued_at and request_id. A request that was never completed (null) is never kept, but supersedes.

    A user's requests are put in order minute by minute, and each minute is told when the next one with a request begins, so a busy user's requests are spread by time.
    """
    pieces = requests.withColumn("_piece", F.coalesce(F.floor(_micros("issued_at") / PIECE), F.lit(-_NEVER)))  # without a time: before all others
    starts = pieces.groupBy("user_id", "_piece").agg(F.min("issued_at").alias("issued_at"))
    told = starts.withColumn("_piece", F.lag("_piece").over(Window.partitionBy("user_id").orderBy("_piece"))).filter("_piece is not null")
    rows = pieces.withColumn("_own", F.lit(True)).unionByName(told.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    newer = F.lead("issued_at").over(Window.partitionBy("user_id", "_piece").orderBy("issued_at", "request_id"))
    return rows.withColumn("_newer", newer).filter(F.col("_own") & F.col("completed_at").isNotNull() & (F.col("_newer").isNull() | (F.col("_newer") > F.col("completed_at")))).select(*requests.columns)


def decide(held: list[list], passed: int) -> tuple[list[list], list[list]]:
    """(requests that are kept for certain, requests still needed). held: [issued, request, completed, decided], in microseconds; passed: the watermark.

    A request is superseded as soon as a newer one that was issued by its completion is known, and kept once the watermark has passed its completion
    without one. It is needed until it is decided, and until the watermark has passed its issue, as an older request that comes
    later may be superseded by it.
    """
    held = sorted(held)
    kept, least = [], _NEVER  # least: the earliest issue of a newer request
    for r in reversed(held):
        if not r[3] and (least <= r[2] or r[2] <= passed):
            r[3] = True
            if least > r[2]:
                kept.append(r)
        least = r[0]
    return kept[::-1], [r for r in held if not r[3] or r[0] > passed]


def latest_wins_stream(requests: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """The same over a stream, whatever the order and the micro-batches in which rows come, as long as they come before the watermark; later ones are dropped.

    A user's state is the requests not decided yet, and those an older request could still be superseded by; a timer in event time
    wakes it when the watermark passes the next of them. A request that is never completed is let go with the watermark.
    """
    schema = "user_id long, request_id long, issued_at timestamp, completed_at timestamp"
    columns = [c.split(" ")[0] for c in schema.split(", ")]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(r) for r in zip(*state.get)] if state.exists else []
        micros = lambda s: s.astype("datetime64[us]").astype("int64")
        if not state.hasTimedOut:
            for pdf in batches:
                never = pdf["completed_at"].isna()
                done = micros(pdf["completed_at"].fillna(pdf["issued_at"]))
                held += [[int(i), int(r), int(c), bool(n)] for i, r, c, n in zip(micros(pdf["issued_at"]), pdf["request_id"], done, never)]  # one that is never completed is decided
        passed = state.getCurrentWatermarkMs() * 1000
        kept, needed = decide(held, passed)
        if needed:
            state.update(tuple(map(list, zip(*needed))))
            due = min(r[0] if r[3] else r[2] for r in needed)
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame([(key[0], r, pd.Timestamp(i, unit="us"), pd.Timestamp(c, unit="us")) for i, r, c, _ in kept], columns=columns)

    return requests.withWatermark("issued_at", lateness).groupBy("user_id").applyInPandasWithState(step, schema, "issued array<long>, request array<long>, completed array<long>, decided array<boolean>", "append", GroupStateTimeout.EventTimeTimeout)


def search_stream(terms: DataFrame, find: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that searches each micro-batch of terms (event_id, term) and hands the hits to sink. Its checkpoint folder has to be shared."""

    def run(batch: DataFrame, number: int) -> None:
        queries = batch.select(F.col("event_id").alias("query_id"), "term")
        sink(find(queries), number)

    return terms.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced_search_stream(events: DataFrame, index: Callable[[], Index], sink: Callable[[DataFrame, int], None], checkpoint: str, *, gap_ms: int = GAP_MS, lateness: str = "10 seconds", **trigger):
    """Starts a query that debounces events (event_id, user_id, ts, term) and searches what is left, one micro-batch after the other.

    index() is asked once a micro-batch, so a batch is searched in one version of the index and a rebuilt one is taken up by the next. The
    sink gets the ranked hits (query_id: the event) and the batch's number; a batch that is repeated after a failure has the same number.
    """

    def run(batch: DataFrame, number: int) -> None:
        queries = stored(batch.select(F.col("event_id").alias("query_id"), "term"))  # the stream's state is advanced once
        if not queries.isEmpty():
            sink(search(queries, index())["hits"], number)

    return debounce_stream(events, gap_ms, lateness).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
