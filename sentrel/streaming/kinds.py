"""Extension (the batch operators have no streaming counterpart elsewhere): the kind of every report version as it arrives.

A report's highest version is kept as state, so a version is told apart in its own batch, without the
versions before it. Whatever the batches, the kinds are those that ``quality.classified`` gives for
all rows in order of arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

#: Setting that a session needs for state of this kind.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
KINDS = "report_id string, version long, page string, index long, kind string"


class Kinds(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        """first without state; duplicate of the highest version so far (a missing one is lowest); else followup."""
        known = self.best.exists()
        best = self.best.get()[0] if known else None
        found = pd.concat(list(rows)).sort_values(["page", "index"])
        kinds = []
        for version in found["version"]:
            version = None if pd.isna(version) else int(version)
            kinds.append("first" if not known else "duplicate" if version == best else "followup")
            if not known or (version is not None and (best is None or version > best)):
                best = version
            known = True
        self.best.update((best,))
        yield pd.DataFrame({"report_id": key[0], "version": found["version"].astype("Int64"), "page": found["page"], "index": found["index"], "kind": kinds})

    def close(self) -> None:
        pass


def told(versions: DataFrame) -> DataFrame:
    """report_id, version, page, index, kind of a stream of report_id, version, page, index; later pages arrive later."""
    spark = versions.sparkSession
    if spark.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        raise ValueError(f"set {PROVIDER[0]} to {PROVIDER[1]}")
    rows = versions.select("report_id", "version", "page", "index")
    return rows.groupBy("report_id").transformWithStateInPandas(statefulProcessor=Kinds(), outputStructType=KINDS, outputMode="Append", timeMode="None")
