"""Labels for names as they arrive, each chosen with the labels used so far: keyed state that lives on between micro-batches and restarts. OPS-05."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: names, labels used so far (oldest first) -> label of each name, or none
Ask = Callable[[list[str], list[str]], dict[str, str | None]]

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class RunningVocabulary(StatefulProcessor):
    """Names of a group are numbered as they come, those of one micro-batch by their order column; every `batch` numbers make a request.

    A request gets the labels that numbers before its first one were given, so a request that two micro-batches share is asked in two calls with the same
    vocabulary. State of a group: the count of names, each label with the number that used it first, each name with its label. A name that comes again
    keeps its label and takes no number.
    """

    def __init__(self, ask: Ask, batch: int):
        self.ask, self.batch = ask, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long")
        self.labels = handle.getMapState("labels", "label string", "first long")
        self.names = handle.getMapState("names", "name string", "label string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["turn", "name"])
        n = self.count.get()[0] if self.count.exists() else 0
        used = sorted((first[0], label[0]) for label, first in self.labels.iterator())
        known = {label for _, label in used}
        out, new = [], []
        for name in pdf["name"]:
            if self.names.containsKey((name,)):
                out.append((name, self.names.getValue((name,))[0]))
            elif name not in (have := {x for _, x in new}):
                new.append((n + len(have), name))
        at = 0
        while at < len(new):
            request = new[at][0] // self.batch
            part = [x for x in new[at:] if x[0] // self.batch == request]
            answers = self.ask([name for _, name in part], [label for first, label in used if first < request * self.batch])
            for number, name in part:
                label = answers.get(name)
                self.names.updateValue((name,), (label,))
                out.append((name, label))
                if label and label not in known:
                    known.add(label)
                    used.append((number, label))
                    self.labels.updateValue((label,), (number,))
            at += len(part)
        self.count.update((n + len(new),))
        yield pd.DataFrame({"group": key[0], "name": [x for x, _ in out], "label": [x for _, x in out]})

    def close(self) -> None:
        pass


def label_stream(stream: DataFrame, ask: Ask, batch: int = 80) -> DataFrame:
    """group, name, label of the names of a stream (group string, turn long, name string), each name once a micro-batch. Null groups and names are left out."""
    stream.sparkSession.conf.set(PROVIDER, _ROCKS)
    rows = stream.select("group", "turn", "name").where("group is not null and name is not null")
    return rows.groupBy("group").transformWithStateInPandas(RunningVocabulary(ask, batch), "group string, name string, label string", "Append", "None")


def start(stream: DataFrame, ask: Ask, path: str, checkpoint: str, batch: int = 80) -> StreamingQuery:
    """Labels written as Parquet until the stream has no more files; a later start with the same checkpoint goes on where this one stopped."""
    labels = label_stream(stream, ask, batch)
    return labels.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def name_files(spark: SparkSession, path: str, files_at_once: int = 1) -> DataFrame:
    """Names as they land in Parquet files."""
    return spark.readStream.schema("group string, turn long, name string").option("maxFilesPerTrigger", files_at_once).parquet(path)
