"""Streams: incremental labeling, and the confidence of patterns as their examples arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.labeling import LabelConfig
from quillspark.operators.ordered import averaged, composed_maps, moving_maps
from quillspark.plans.corpus import Store, label_corpus


def label_stream(docs: DataFrame, config: LabelConfig, where: Store, checkpoint: str, **trigger) -> StreamingQuery:
    """Label documents as they arrive; each micro-batch sees the store as of the batches before it.

    A batch replayed after a failure overwrites its own rows, so every document is stored once. The stream's
    batches form a run named after its checkpoint: a stream never writes over what another writer stored.
    """
    run = "stream-" + hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(rows: DataFrame, batch_id: int) -> None:
        label_corpus(rows, config, where, batch=batch_id, run=run)

    writer = docs.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(**trigger) if trigger else writer).start()


@dataclass(frozen=True)
class PatternState:
    """Usage and confidence of patterns, kept as one affine map per pattern and batch under ``path``.

    A batch writes only the maps of the patterns it met: it reads no state, and a pattern that holds a third of a
    batch is one row of it. Maps compose, so the state is what ``read`` composes in the order of batches; ``compact``
    stores that once for all batches so far, and later reads begin there. Every batch is a folder of its own that
    a replay after a failure overwrites, so every example counts once.
    """

    path: str
    keep: float = 0.8

    def add(self, examples: DataFrame, batch: int, order: Sequence[str], key: str = "pattern_id") -> None:
        """Store the maps of one batch of ``(key, confidence_score)`` rows, taken in ``order`` (its last column is unique).

        Examples count at the place of their batch, also those whose order is before that of an earlier batch. A
        null score adds to the usage and weighs nothing; as the first of its pattern it leaves the confidence null.
        """
        maps = moving_maps(examples, [key], order, "confidence_score", self.keep)
        maps.select(F.col(key).alias("pattern_id"), "rows", "weighted", "first").write.mode("overwrite").parquet(f"{self.path}/batches/batch={batch}")

    def _stored(self, spark: SparkSession, part: str) -> dict[int, str]:
        """Complete folders of ``part`` by batch number; a folder without its success mark was cut off by a failure."""
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if not files.exists(root):
            return {}
        folders = [status.getPath() for status in files.listStatus(root)]
        done = [p for p in folders if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return {int(p.getName().split("=")[1]): p.toString() for p in done}

    def _maps(self, spark: SparkSession) -> tuple[DataFrame | None, int]:
        """Maps with ``at`` (-1 for those composed before), and the last batch among them; None without any."""
        bases, batches = self._stored(spark, "composed"), self._stored(spark, "batches")
        upto = max(bases, default=-1)
        parts = [spark.read.parquet(bases[upto]).withColumn("at", F.lit(-1).cast("long"))] if bases else []
        fresh = [path for number, path in batches.items() if number > upto]
        if fresh:
            rows = spark.read.option("basePath", f"{self.path}/batches").parquet(*fresh)
            parts.append(rows.withColumn("at", F.col("batch").cast("long")).drop("batch"))
        if not parts:
            return None, -1
        maps = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return maps, max([upto, *batches])

    def compact(self, spark: SparkSession) -> None:
        """Compose all maps so far into one per pattern. Batches stay where they are, so readers are never disturbed."""
        maps, last = self._maps(spark)
        if maps is not None:
            composed_maps(maps, ["pattern_id"], "at", self.keep).write.mode("overwrite").parquet(f"{self.path}/composed/upto={last}")

    def read(self, spark: SparkSession) -> DataFrame:
        """``(pattern_id, confidence_score, usage_count)`` after all batches so far; pattern ids are text before the first."""
        maps, _ = self._maps(spark)
        if maps is None:
            return spark.createDataFrame([], "pattern_id string, confidence_score double, usage_count bigint")
        return averaged(composed_maps(maps, ["pattern_id"], "at", self.keep), ["pattern_id"], self.keep, "confidence_score")


def confidence_stream(
    examples: DataFrame, state: PatternState, checkpoint: str, order: Sequence[str], key: str = "pattern_id", compact_every: int = 100,
    **trigger,
) -> StreamingQuery:
    """Keep ``state`` up to date with a stream of examples; every ``compact_every`` batches its maps are composed."""

    def write(rows: DataFrame, batch_id: int) -> None:
        state.add(rows, batch_id, order, key)
        if compact_every and batch_id % compact_every == compact_every - 1:
            state.compact(rows.sparkSession)

    writer = examples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(**trigger) if trigger else writer).start()
