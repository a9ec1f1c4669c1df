"""Life events as a stream (an extension: Spark offers it, nothing asks for it): one state for each class."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.learn import ExponentialHistogram


def score_means(events: DataFrame, most: int = 5) -> DataFrame:
    """class, n, mean after each batch, from a stream of (class, score); the state is an exponential histogram of logarithmic size."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = ExponentialHistogram([tuple(b) for b in json.loads(state.get[0])] if state.exists else [], most)
        for rows in batches:
            held.extend(rows["score"])
        state.update((json.dumps(held.buckets),))
        yield pd.DataFrame({"class": [key[0]], "n": [held.count], "mean": [held.mean]})

    return events.groupBy("class").applyInPandasWithState(step, "class string, n long, mean double", "buckets string", "update", GroupStateTimeout.NoTimeout)


def distinct_findings(findings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Findings of a stream, each cluster and place once within the time that events may be late."""
    return findings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["cluster_key", "file", "line"])
