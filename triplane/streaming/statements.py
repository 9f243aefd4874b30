"""N-Triples text read as a stream, and star patterns over it.

Parsing is the batch parser's column expressions. A star collects a subject's objects in state; a watermark on an event-time
column, where the stream has one, bounds that state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplane.sources import ntriples
from triplane.sources.shared import shared_path


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A streaming DataFrame of statements from the text files that arrive in a folder."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return ntriples.statements(lines)


def match_star(statements: DataFrame, predicates: dict[str, str]) -> DataFrame:
    """(subject, a column for each predicate) for subjects that have all of them; of repeated objects the least counts. One
    predicate needs no state."""
    if len(predicates) == 1:
        ((iri, name),) = predicates.items()
        return statements.where(F.col("p_lex") == iri).select(F.col("s_lex").alias("subject"), F.col("o_lex").alias(name))
    wanted = statements.where(F.col("p_lex").isin(*predicates))
    found = wanted.groupBy(F.col("s_lex").alias("subject")).agg(*[F.min(F.when(F.col("p_lex") == iri, F.col("o_lex"))).alias(name) for iri, name in predicates.items()])
    return found.dropna(subset=list(predicates.values()))


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what has arrived and gives its last result as a table. mode: append, whose batches add up, or complete,
    whose last batch is the result. Each batch is written under its number, so one that is replayed replaces itself."""
    if mode not in ("append", "complete"):
        raise ValueError(f"mode {mode}: a table can't hold rows that later ones supersede")
    spark = stream.sparkSession
    out = shared_path(spark, "stream")
    where = checkpoint or shared_path(spark, "progress")
    last: list[int] = [-1]

    def save(batch: DataFrame, n: int) -> None:
        last[0] = n
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(out if mode == "append" else f"{out}/batch={last[0]}").select(*[F.col(f"`{c}`") for c in stream.columns])
