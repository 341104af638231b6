"""Releases of streams: the mechanism is a pure function of key, subject and code, so a replayed batch gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from spindrift.functions.exact import Key
from spindrift.operators.mechanism import HopMechanism


def release_stream(stream: DataFrame, mechanism: HopMechanism, code_col: str, subject_col: str, key: Key, out: str, checkpoint: str, out_col: str = "place_dp", on_error: str = "null", **trigger) -> StreamingQuery:
    """Writes each micro-batch without its true codes to out/batch=N; a batch that is repeated replaces its own folder."""

    def each(batch: DataFrame, number: int) -> None:
        mechanism.perturb_frame(batch, code_col, subject_col, key, out_col, on_error).drop(code_col).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
