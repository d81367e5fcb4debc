"""Appending sinks and mergeable running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.table import append, clone_structure


class TableWriter:
    """A long-lived append sink whose first frame, or template, fixes the schema; each flush writes one set of files."""

    def __init__(self, path: str, template: DataFrame, batch: int = 8):
        self.path, self.template, self.batch = path, clone_structure(template), batch
        self.pending: list[DataFrame] = []
        self.is_open = True

    def append(self, df: DataFrame) -> TableWriter:
        if not self.is_open:
            raise ValueError("the writer is closed")
        self.pending.append(append(self.template, df))
        if len(self.pending) >= self.batch:
            self.flush()
        return self

    def flush(self) -> None:
        if self.pending:
            out = self.pending[0]
            for df in self.pending[1:]:
                out = out.union(df)
            out.write.mode("append").parquet(self.path)
            self.pending.clear()

    def close(self) -> None:
        self.flush()
        self.is_open = False


def append_stream(stream: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends its rows to a table, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def partial_moments(df: DataFrame, name: str) -> DataFrame:
    """``n, mean, m2, min, max`` of a chunk: what merging needs."""
    x = F.when(~F.isnan(F.col(name).cast("double")), F.col(name).cast("double"))
    return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("min"), F.max(x).alias("max"))


def merge_moments(parts: DataFrame) -> DataFrame:
    """Moments of all chunks together, from theirs (the pairwise update, in its sum form)."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    return parts.where("n > 0").agg(n.alias("n"), mean.alias("mean"), (F.sum("m2") + between).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"))
