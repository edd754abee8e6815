"""The strategy registry: an append-only event log in Parquet, and the latest state of each fingerprint."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "fingerprint string, status string, score double, generation int, origin string, parents array<string>, genome string, metrics string, error string, eval_secs double, token string, at double, seq bigint"
REJECTED = -1e9
#: Upper ends of the reward-to-risk bands of a niche.
BANDS = (1.5, 2.0, 3.0, 4.0)


class Registry:
    """One driver writes; Parquet has no unique keys, so reserving is atomic in one writer only."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def append(self, df: DataFrame) -> None:
        now = time.time()
        have = set(df.columns)
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMA).schema}
        cols = [F.col(c).cast(t) if c in have else F.lit(None).cast(t).alias(c) for c, t in kinds.items() if c not in ("at", "seq")]
        df.select(*cols, F.lit(now).alias("at"), F.lit(time.time_ns()).alias("seq")).write.mode("append").parquet(self.path)

    def latest(self) -> DataFrame:
        """One row a fingerprint: the last known value of each column."""
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        e = self.events()
        return e.groupBy("fingerprint").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in names if c != "fingerprint"))

    def unseen(self, candidates: DataFrame) -> DataFrame:
        return unseen(candidates, self.events())

    def reserve(self, candidates: DataFrame) -> DataFrame:
        """Writes the unseen candidates as pending and returns them."""
        token = uuid.uuid4().hex
        new = self.unseen(candidates)
        self.append(new.withColumns({"status": F.lit("pending"), "token": F.lit(token)}))
        return self.events().where(F.col("token") == token)

    def complete(self, results: DataFrame) -> None:
        self.append(results.withColumn("status", F.lit("ok")))

    def reject(self, results: DataFrame) -> None:
        self.append(results.withColumns({"status": F.lit("rejected"), "score": F.lit(REJECTED)}))

    def fail(self, results: DataFrame) -> None:
        self.append(results.withColumns({"status": F.lit("failed"), "score": F.lit(REJECTED), "error": F.substring("error", 1, 4000)}))

    def sweep(self, older_than: float = 3600) -> None:
        stale = self.latest().where((F.col("status") == "pending") & (F.col("at") < time.time() - older_than))
        self.fail(stale.select("fingerprint", F.lit("abandoned").alias("error")))

    def get(self, fingerprint: str) -> DataFrame:
        return self.latest().where(F.col("fingerprint") == fingerprint)

    def start_run(self, config: dict, note: str = "") -> str:
        """Records a run and its configuration; returns its id."""
        run = uuid.uuid4().hex
        row = [(run, time.time(), json.dumps(config, default=str), note)]
        self.spark.createDataFrame(row, "run_id string, started_at double, config string, note string").write.mode("append").parquet(f"{self.path}_runs")
        return run

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}_runs").orderBy("started_at")

    def set_meta(self, key: str, value: str) -> None:
        self.spark.createDataFrame([(key, str(value), time.time_ns())], "k string, v string, seq bigint").write.mode("append").parquet(f"{self.path}_meta")

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        try:
            row = self.spark.read.parquet(f"{self.path}_meta").where(F.col("k") == key).agg(F.max_by("v", "seq")).first()
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return default
        return default if row[0] is None else row[0]


def unseen(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates, one a fingerprint, that ``known`` (any table with fingerprint) doesn't hold."""
    return candidates.dropDuplicates(["fingerprint"]).join(known.select("fingerprint").distinct(), "fingerprint", "left_anti")


def stats(state: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return state.agg(F.count(F.lit(1)).alias("total"), *(n(s) for s in ("ok", "pending", "failed", "rejected")), F.max("score").alias("best_score"), F.max("generation").alias("max_generation"), F.avg("eval_secs").alias("avg_secs"))


def top(state: DataFrame, n: int, min_generation: int = -1) -> DataFrame:
    return state.where((F.col("status") == "ok") & F.col("score").isNotNull() & (F.col("generation") > min_generation)).orderBy(F.desc("score"), "fingerprint").limit(n)


def audit(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("fingerprint").alias("fingerprints"), F.countDistinct("genome").alias("genomes"))


def niche(rr: str = "rr", session: str = "session"):
    band = sum((F.when(F.col(rr) >= b, 1).otherwise(0) for b in BANDS), F.lit(0))
    return F.concat_ws("/", band.cast("string"), F.col(session))


def niched_elites(state: DataFrame, k: int) -> DataFrame:
    """k elites out of the top 4k: the best of each niche first, then by score; in order of score. A pool of at most k stays as it is."""
    pool = top(state, 4 * k).withColumn("niche", niche())
    ranked = pool.withColumn("place", F.row_number().over(Window.partitionBy("niche").orderBy(F.desc("score"), "fingerprint")))
    chosen = ranked.orderBy((F.col("place") > 1).cast("int"), F.desc("score"), "fingerprint").limit(k)
    return chosen.orderBy(F.desc("score"), "fingerprint")
