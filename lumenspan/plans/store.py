"""Aggregates that are kept: written, versioned, merged batch by batch, and read back.

A folder holds three tables. `scores/batch=N` are the sample scores that batch N brought, each sample once for each version: what an earlier
batch has stays. `tasks/batch=N` is what they add to each task - sums, so the log of batches is merged by adding up. A batch writes both under its
own number, so a batch that is run again, after a crash or by a restarted stream, replaces itself and changes nothing. `compact` folds
the log up to a batch into one table. `runs/version=V/run_id=R` are run scores by a named method; a refresh replaces the partitions of the
runs that it computes and leaves all others alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.functions.stats import EXACT, QUERY_CLUSTER, exact_mean
from lumenspan.operators.rollup import TASK, summarise

IN_TASK = "run_id string, query_id long, provider string, mode string"
SCORES = f"version string, sample_id long, {IN_TASK}, score double, brand_present boolean, batch long"
TASKS = f"version string, {IN_TASK}, score_sum decimal(38,9), raw_n long, present long, batch long"
RUNS = "mode string, n long, raw_n long, cell_n long, mean double, median double, mad double, iqr double, stability double, presence double, low_n boolean, ci_method string, version string, run_id string"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _read(self, name: str, schema: str) -> DataFrame:
        where, fs = self._fs(name)
        if not fs.exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")

    def compacted(self) -> int:
        """The last batch of the log that is folded, -1 if none is."""
        where, fs = self._fs("folded")
        return max((int(s.getPath().getName().split("=")[1]) for s in (fs.listStatus(where) if fs.exists(where) else []) if self._whole(s)), default=-1)

    def _whole(self, status) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        return where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)

    def scores(self, version: str) -> DataFrame:
        return self._read("scores", SCORES).where(F.col("version") == version)

    def merge(self, samples: DataFrame, batch: int) -> None:
        """samples: version, sample_id, the columns of TASK, score, brand_present, seen_at - completed samples of one batch. Of a sample that
        comes more than once the first by seen_at stays, of equal ones the smallest."""
        if batch <= self.compacted():
            return
        columns = [c.split(" ")[0] for c in SCORES.split(", ") if not c.startswith("batch")]
        rest = F.struct("seen_at", *[c for c in columns if c not in ("version", "sample_id")])
        once = samples.groupBy("version", "sample_id").agg(F.min(rest).alias("s")).select("version", "sample_id", "s.*")
        # earlier batches only: run again, a batch must not see itself or what came after it
        known = self._read("scores", SCORES).where(F.col("batch") < batch).join(once.select("run_id").distinct(), "run_id", "left_semi")
        self._write(once.join(known.select("version", "sample_id"), ["version", "sample_id"], "left_anti").select(*columns), "scores", batch)
        added = self._read("scores", SCORES).where(F.col("batch") == batch).groupBy("version", *TASK).agg(
            F.sum(F.col("score").cast(EXACT)).cast("decimal(38,9)").alias("score_sum"), F.count(F.lit(1)).alias("raw_n"), F.count_if("brand_present").alias("present")
        )
        self._write(added, "tasks", batch)

    def listen(self, samples: DataFrame, checkpoint: str):
        """A stream of samples, merged as its batches come."""
        return samples.writeStream.foreachBatch(lambda df, batch: self.merge(df, batch)).option("checkpointLocation", checkpoint)

    def tasks(self, version: str) -> DataFrame:
        """TASK, mean, raw_n, presence, ci_method of each task."""
        at = self.compacted()
        log = self._read("tasks", TASKS).where(F.col("batch") > at)
        if at >= 0:
            log = log.unionByName(self.spark.read.schema(TASKS).parquet(f"{self.path}/folded/upto={at}"))
        sums = log.where(F.col("version") == version).groupBy(*TASK).agg(F.sum("score_sum").alias("s"), F.sum("raw_n").alias("raw_n"), F.sum("present").alias("p"))
        mean = F.round(F.col("s").cast("double") / F.col("raw_n"), 9)
        return sums.select(*TASK, mean.alias("mean"), "raw_n", (F.col("p") / F.col("raw_n")).alias("presence"), F.col("p").alias("present"), F.lit(QUERY_CLUSTER).alias("ci_method"))

    def compact(self, upto: int) -> None:
        """Fold the log up to a batch into one table; its batches are not merged again."""
        at, keys = self.compacted(), ["version", *TASK]
        log = self._read("tasks", TASKS).where((F.col("batch") > at) & (F.col("batch") <= upto))
        if at >= 0:
            log = log.unionByName(self.spark.read.schema(TASKS).parquet(f"{self.path}/folded/upto={at}"))
        sums = [F.sum(c).cast(kind).alias(c) for c, kind in (("score_sum", "decimal(38,9)"), ("raw_n", "long"), ("present", "long"))]
        log.groupBy(*keys).agg(*sums, F.lit(upto).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.path}/folded/upto={upto}")

    def refresh(self, version: str, runs: DataFrame | None = None, method: str = QUERY_CLUSTER) -> None:
        """Run scores out of the tasks, for the runs named (run_id) or all; their partitions are replaced, all at once for each run."""
        tasks = self.tasks(version)
        tasks = tasks if runs is None else tasks.join(runs.select("run_id").distinct(), "run_id", "left_semi")
        per_query = tasks.groupBy("run_id", "mode", "query_id").agg(
            exact_mean(F.col("mean")).alias("value"), F.sum("raw_n").alias("raw_n"), F.count(F.lit(1)).alias("cell_n"), F.sum("present").alias("present")
        )
        out = summarise(per_query, ["run_id", "mode"]).withColumns({"ci_method": F.lit(method), "version": F.lit(version)})
        out = out.select(*[c.split(" ")[0] for c in RUNS.split(", ")])
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "run_id").parquet(f"{self.path}/runs")

    def runs(self, version: str) -> DataFrame:
        return self._read("runs", RUNS).where(F.col("version") == version)


def readiness(samples: DataFrame, store: Store, version: str) -> DataFrame:
    """run_id, ready: whether scores and aggregates of the current method cover every completed sample. samples: sample_id, TASK, status.

    Ready are runs with completed samples all of which have a score, whose tasks and modes with such samples all have an aggregate of
    the method over just as many."""
    done = samples.where("status = 'COMPLETED'").select("sample_id", *TASK)
    scored = done.join(store.scores(version).select("sample_id", F.lit(1).alias("has")), "sample_id", "left")
    tasks = scored.groupBy(*TASK).agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("n_scored"))
    modern = F.col("ci_method") == QUERY_CLUSTER
    stored = store.tasks(version).where(modern).select(*TASK, "raw_n")
    whole = (F.col("n") == F.col("n_scored")) & (F.col("n_scored") == F.coalesce("raw_n", F.lit(-1)))
    modes = tasks.join(stored, TASK, "left").groupBy("run_id", "mode").agg(F.bool_and(whole).alias("tasks_ready"), F.sum("n").alias("n"))
    of_mode = store.runs(version).where(modern).select("run_id", "mode", "raw_n")
    ready = F.col("tasks_ready") & (F.col("n") == F.coalesce("raw_n", F.lit(-1)))
    return modes.join(of_mode, ["run_id", "mode"], "left").groupBy("run_id").agg(F.bool_and(ready).alias("ready"))


def repaired(samples: DataFrame, cancelling: DataFrame, in_flight: DataFrame) -> DataFrame:
    """TASK, done, failed, pending, status of the tasks of runs that are being cancelled (run_id) and have nothing in flight (run_id)
    any more: counters are counted anew from the samples, and a task that wasn't over is cancelled. samples: TASK, status."""
    closing = cancelling.select("run_id").distinct().join(in_flight.select("run_id").distinct(), "run_id", "left_anti")
    count = lambda s: F.count_if(F.col("status") == s)
    tasks = samples.join(closing, "run_id", "left_semi").groupBy(*TASK).agg(
        count("COMPLETED").alias("done"), count("FAILED").alias("failed"), F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("open"), count("CANCELLED").alias("cancelled")
    )
    over = F.when((F.col("done") == 0) & (F.col("failed") == 0), "CANCELLED").when(F.col("done") == 0, "FAILED").when(F.col("failed") + F.col("cancelled") > 0, "PARTIAL")
    status = F.when(F.col("open") > 0, "CANCELLED").otherwise(over.otherwise("COMPLETED"))
    return tasks.select(*TASK, "done", "failed", F.lit(0).cast("long").alias("pending"), status.alias("status"))
