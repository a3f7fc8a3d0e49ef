"""Labels for scenes as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ballast.config import GroundConfig
from ballast.plans.ground import segment_ground


def label_stream(points: DataFrame, tracks: DataFrame, path: str, checkpoint: str, config: GroundConfig = GroundConfig()) -> StreamingQuery:
    """Labels every scene of a stream of ``points`` and writes scene_id, point_id, label to ``path``, one folder a batch.

    Scenes are labelled as a whole, so a scene's points must come in one batch,
    as they do from one file.  A batch that is run again overwrites its folder.
    """

    def label(batch: DataFrame, number: int) -> None:
        segment_ground(batch, tracks, config).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
