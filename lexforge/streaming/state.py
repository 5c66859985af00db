"""Stateful operators of Structured Streaming, each with state of a few numbers a key."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_lengths(steps: DataFrame, reset: int = 1, pad: int = 0) -> DataFrame:
    """(stream, step, past_length) for a stream of (stream, step, ids): the tokens since the last reset before each step."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length = state.get[0] if state.exists else 0
        rows = []
        for pdf in frames:
            for step, ids in sorted(zip(pdf.step, pdf.ids, strict=True), key=lambda x: x[0]):
                rows.append((key[0], step, length))
                ids = list(ids)
                last = max((i for i, x in enumerate(ids) if x == reset), default=None)
                own = sum(x != pad for x in (ids if last is None else ids[last:]))
                length = own if last is not None else length + own
        state.update((length,))
        yield pd.DataFrame(rows, columns=["stream", "step", "past_length"])

    return steps.groupBy("stream").applyInPandasWithState(run, "stream long, step long, past_length long", "length long", "append", GroupStateTimeout.NoTimeout)


def affinities(pairs: DataFrame, rate: float = 0.1) -> DataFrame:
    """(a, b, affinity, updates) for a stream of (a, b, place, score): an exponential mean in the order of place."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (0.0, 0)
        for pdf in frames:
            for score in pdf.sort_values("place").score:
                value, n = (1 - rate) * value + rate * score, n + 1
        state.update((value, n))
        yield pd.DataFrame([(*key, value, n)], columns=["a", "b", "affinity", "updates"])

    return pairs.groupBy("a", "b").applyInPandasWithState(run, "a string, b string, affinity double, updates long", "value double, n long", "update", GroupStateTimeout.NoTimeout)


def candidate_scores(scores: DataFrame) -> DataFrame:
    """(word, best, enabled) for a stream of (word, place, score): a candidate is disabled after three falls in a row."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, falls = state.get if state.exists else (float("-inf"), 0)
        for pdf in frames:
            for score in pdf.sort_values("place").score:
                falls = falls + 1 if score < last else 0 if falls < 3 else falls
                last = score
        state.update((last, falls))
        yield pd.DataFrame([(key[0], last, falls < 3)], columns=["word", "best", "enabled"])

    return scores.groupBy("word").applyInPandasWithState(run, "word string, best double, enabled boolean", "score double, falls long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by window and type, closed by a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def write_to(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame], None], mode: str = "append"):
    """Runs what is there through write, batch by batch, and stops; a batch that is run again replaces nothing else if write is
    an upsert or a whole version."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: write(df)).start()


def routed(df: DataFrame, routes: dict[str, str], rest: str = "rest") -> DataFrame:
    """df with route: the name of the first condition that a row meets."""
    route = F.lit(rest)
    for name, condition in reversed(routes.items()):
        route = F.when(F.expr(condition), name).otherwise(route)
    return df.withColumn("route", route)
