"""Streaming arrivals: each micro-batch is blocked against and attached to the clusters.

State is two Parquet tables in a shared folder to which every batch appends its
own rows: old records never move, so nothing is written again. A batch is done
once its clusters are written whole; a batch that runs again after a failure
overwrites its own rows and reads only those of earlier batches, and a restarted
driver finds the batches that are done in the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators import blocking, linkage, scoring
from kinforge.session import listed, materialize


def candidates_between(new: DataFrame, old: DataFrame, passes: list[list[str]]) -> DataFrame:
    """(a, b): pairs of a new record and any other that share a match key."""
    out = None
    both = old.unionByName(new)
    for keys in passes:
        names = [f"k{i}" for i in range(len(keys))]
        cols = [blocking.key_column(k).alias(n) for k, n in zip(keys, names, strict=True)]
        left = new.select(F.col("record_id").alias("a"), *cols).dropna()
        right = both.select(F.col("record_id").alias("b"), *cols).dropna()
        part = left.join(right, names).where("a <> b").select("a", "b")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


class Attacher:
    """``foreachBatch`` sink that keeps records and clusters up to date.

    ``records`` and ``clusters`` found a new folder; in one that holds batches
    already they are not read, and the state goes on from there.
    """

    def __init__(self, spark: SparkSession, folder: str, records: DataFrame, clusters: DataFrame, fields: list[str], threshold: float = 0.9, passes: list[list[str]] | None = None):
        self.spark, self.folder, self.fields, self.threshold = spark, folder.rstrip("/"), fields, threshold
        self.passes = passes or blocking.default_passes(records.columns)
        if -1 not in self.done():
            self._write(records, clusters, -1)

    def done(self) -> list[int]:
        """Batches whose rows are all there; -1 is the start."""
        names = [x for x in listed(self.spark, f"{self.folder}/clusters") if x.lstrip("-").isdigit()]
        return sorted(int(x) for x in names if "_SUCCESS" in listed(self.spark, f"{self.folder}/clusters/{x}"))

    @property
    def version(self) -> int:
        return max(self.done())

    def _write(self, records: DataFrame, clusters: DataFrame, batch: int) -> None:
        records.write.mode("overwrite").parquet(f"{self.folder}/records/{batch}")
        clusters.select("record_id", "cluster").write.mode("overwrite").parquet(f"{self.folder}/clusters/{batch}")

    def state(self, before: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Records and clusters of the finished batches (those before a number)."""
        kept = [k for k in self.done() if before is None or k < before]
        return tuple(self.spark.read.parquet(*[f"{self.folder}/{what}/{k}" for k in kept]) for what in ("records", "clusters"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.done():  # a repeat of a finished batch
            return
        records, clusters = self.state(batch_id)
        new = materialize(batch.dropDuplicates(["record_id"]).join(records, "record_id", "left_anti").select(*records.columns), "arrivals")
        pairs = candidates_between(new, records, self.passes)
        scored = scoring.mean_jaro_winkler(pairs, records.unionByName(new), self.fields).select("a", "b", "prob")
        self._write(new, linkage.placements(clusters, new, materialize(scored, "scored"), self.threshold), batch_id)


def watermarked_arrivals(stream: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "5 minutes", by: str = "source") -> DataFrame:
    """Arrivals a window and group; events later than ``delay`` are left out of closed windows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"))
