"""Risk that fades when an address goes quiet."""

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.functions.risk import BASELINE_SCORE, risk_class

OUTPUT = "src_ip string, score double, timestamp timestamp, decayed boolean"
STATE = "src_ip array<string>, score array<double>, last_ms array<long>"
ROWS = 50_000  # rows of one frame given out


def faded(score: float) -> float:
    return max(BASELINE_SCORE, score * 0.5)


def network(address) -> F.Column:
    """The first three parts of a dotted address, so that at most a few hundred share one; else the address itself."""
    return F.when(address.rlike(r"^\d+\.\d+\.\d+\.\d{1,3}$"), F.substring_index(address, ".", 3)).otherwise(address)


def idle_decay(idle_seconds: int = 600):
    """State function: pass scores on, and halve the last one each time the address stays idle that long.

    Addresses of one network share a call and its state, as a call costs far more than its rows. Rows of a trigger are taken
    in order of time, and gaps between them fade as gaps between triggers do, so the result does not depend on how rows are
    dealt to triggers; timers only serve the time after the last row. A row without a time, or older than the newest one of its
    address, passes on and changes nothing.
    """
    step = idle_seconds * 1000

    def rows_frame(rows):
        return pd.DataFrame({
            "src_ip": [r[0] for r in rows], "score": [r[1] for r in rows],
            "timestamp": np.array([r[2] for r in rows], "datetime64[ms]").astype("datetime64[ns]"),
            "decayed": [r[3] for r in rows],
        })

    def idle(address, score, last, until):
        """Rows of the halvings up to a time, and the score and time they end with."""
        rows = []
        while score is not None and score > BASELINE_SCORE and last + step <= until:
            score, last = faded(score), last + step
            rows.append((address, score, last, True))
        return rows, score, last

    def update(key, batches, state: GroupState):
        known = {a: (s, t) for a, s, t in zip(*state.get)} if state.exists else {}
        mark, rows, heard = state.getCurrentWatermarkMs(), [], set()
        if not state.hasTimedOut:
            # an address and two numbers per row of the trigger
            given = pd.concat([batch[["src_ip", "timestamp", "score"]] for batch in batches]).sort_values(["timestamp", "score"])
            times, timed = given["timestamp"].to_numpy("datetime64[us]").astype("int64") // 1000, given["timestamp"].notna()
            for address, at, value, has_time in zip(given["src_ip"].tolist(), times.tolist(), given["score"].tolist(), timed.tolist()):
                if not has_time:
                    rows.append((address, value, None, False))
                    continue
                score, last = known.get(address, (None, -1))
                if at >= last:
                    faded_rows, _, _ = idle(address, score, last, at)
                    rows += faded_rows
                    known[address] = (value, at)
                rows.append((address, value, at, False))
                heard.add(address)
        left = {}
        for address, (score, last) in known.items():
            if address not in heard:
                faded_rows, score, last = idle(address, score, last, mark)
                rows += faded_rows
            if score > BASELINE_SCORE:
                left[address] = (score, last)
        for first in range(0, len(rows), ROWS):
            yield rows_frame(rows[first:first + ROWS])
        if left:
            state.update((list(left), [s for s, _ in left.values()], [t for _, t in left.values()]))
            state.setTimeoutTimestamp(max(min(t for _, t in left.values()) + step, mark + 1))
        elif state.exists:
            state.remove()

    return update


def fading_risk(risk: DataFrame, idle_seconds: int = 600, delay: str = "1 minute") -> DataFrame:
    """Risk rows plus the halved scores of idle addresses, driven by event time."""
    timed = risk.select("src_ip", F.col("score").cast("double").alias("score"),
                        F.col("timestamp").cast("timestamp").alias("timestamp")).withWatermark("timestamp", delay)
    updated = timed.withColumn("network", network(F.col("src_ip"))).groupBy("network").applyInPandasWithState(
        idle_decay(idle_seconds), OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return updated.withColumn("risk_class", risk_class(F.col("score")))


def save_mark(spark: SparkSession, path: str, mark: datetime) -> None:
    """Append a progress mark; the largest one counts, so a repeated run cannot move it back."""
    spark.createDataFrame([(mark,)], "mark timestamp").write.mode("append").parquet(path)


def load_mark(spark: SparkSession, path: str):
    from palisade.session import path_exists

    return spark.read.parquet(path).agg(F.max("mark")).first()[0] if path_exists(spark, path) else None
