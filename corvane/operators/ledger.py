"""Work-item ledger: process only new or changed documents, whatever failed before.

An item is one version (content hash) of one document. It is *pending* from the first run that
can see it, *leased* by each run that starts while it is pending, and *done* once a lease holder
succeeds. The lease of a run that failed or never finished expires and the item is pending
again. A lease carries a fencing token, the rank of its run; a writer may settle an item only
with the newest token given out for it.

:func:`replay` computes the whole lease history of an observation log declaratively (one
shuffle by document); :class:`WorkLedger` is the same protocol as durable tables for live runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd  # a module global: the type hints of a pandas UDF are looked up there
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane import session

LEASES = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("token", T.IntegerType()),
        T.StructField("id", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("state", T.StringType()),
    ]
)
#: Run starts are held as one sorted array on the driver, 16 bytes each.
MAX_RUNS = 200_000


def canonical_hash(col: Column) -> Column:
    """Letter case, surrounding spaces and a ``sha256:`` prefix do not tell hashes apart."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(col, r"^\s+|\s+$", "")), "^sha256:", ""))


def _run_index(last_seen: Column, starts: list[int]) -> Column:
    """Index of the first run that starts at or after ``last_seen``: a binary search written as a
    balanced tree of comparisons, so it stays in generated code and costs log2(runs) a row."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(last_seen <= F.lit(starts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    if len(starts) <= 64:
        return tree(0, len(starts))
    edges = F.array(*[F.lit(s) for s in starts]) if len(starts) <= 512 else None
    if edges is not None:
        return F.size(F.filter(edges, lambda s: s < last_seen))
    return _search_udf(starts)(last_seen)


def _search_udf(starts: list[int]):
    edges = np.array(starts, dtype="int64")

    @F.pandas_udf("int")
    def search(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, x.to_numpy(dtype="int64"), side="left").astype("int32"))

    return search


def replay(states: DataFrame, runs: DataFrame, max_runs: int = MAX_RUNS) -> DataFrame:
    """Lease history (run_id, token, id, content_hash, state) of an observation log.

    ``states``: id, obs_id, content_hash, last_seen, last_changed; ``runs``: run_id, started_at,
    finished_at, ok. Other columns are ignored, whatever their names. state is ``done`` for the
    run that processed the version and ``expired`` for each failed run that held it before.

    Nulls: observations without id, content_hash or last_seen, and runs without started_at, are
    ignored; null last_changed falls back to last_seen. Exact repeats change nothing. Runs that
    start at the same moment are ordered by run_id. No runs or no observations: no rows.

    Scale: one shuffle by id after a map-side partial maximum per (id, run), so a document with a
    third of all observations arrives as at most one row per map task and run.
    """
    spark = states.sparkSession
    rows = (
        runs.where(F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
        .select("run_id", F.unix_micros("started_at").alias("at"), (F.coalesce(F.col("ok") == 1, F.lit(False)) & F.col("finished_at").isNotNull()).alias("good"))
        .distinct()
        .limit(max_runs + 1)
        .collect()
    )
    if len(rows) > max_runs:
        raise ValueError(f"more than {max_runs} runs: archive settled runs first, or raise max_runs")
    order = sorted(rows, key=lambda r: (r["at"], r["run_id"]))
    if not order:
        return spark.createDataFrame([], LEASES)
    n = len(order)
    settle, nxt = [n] * n, n  # the first successful run at or after each run
    for k in range(n - 1, -1, -1):
        nxt = k if order[k]["good"] else nxt
        settle[k] = nxt
    plan = spark.createDataFrame([(k, r["run_id"], settle[k]) for k, r in enumerate(order)], "k int, run_id string, settle int")

    # nulls go first: the three forms of _run_index would each place them differently
    seen = states.where(F.col("last_seen").isNotNull()).select(
        F.col("id").cast("string").alias("id"),
        canonical_hash(F.col("content_hash")).alias("content_hash"),
        F.coalesce("last_changed", "last_seen").alias("at"),
        F.col("obs_id").cast("long").alias("obs_id"),
        _run_index(F.unix_micros("last_seen"), [r["at"] for r in order]).alias("k"),
    ).where("id is not null and content_hash is not null and at is not null and k is not null")
    seen = seen.where(F.col("k") < n)
    best = seen.groupBy("id", "k").agg(F.max(F.struct("at", "obs_id", "content_hash")).alias("best"))
    by_run = Window.partitionBy("id").orderBy("k")
    upto = by_run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = by_run.rowsBetween(Window.unboundedPreceding, -1)
    versions = (
        best.withColumn("hash", F.max("best").over(upto)["content_hash"])
        .withColumn("until", F.coalesce(F.lead("k").over(by_run), F.lit(n)) - 1)
        .join(F.broadcast(plan.select("k", "settle")), "k")
        .withColumn("settled", F.col("settle") <= F.col("until"))
        .withColumn("had", F.last(F.when(F.col("settled"), F.col("hash")), ignorenulls=True).over(before))
        .where(~F.col("hash").eqNullSafe(F.col("had")))
    )
    leases = versions.select("id", "hash", "settle", F.explode(F.sequence("k", F.least("settle", "until"))).alias("k"))
    return leases.join(F.broadcast(plan.select("k", "run_id")), "k").select(
        "run_id",
        F.col("k").alias("token"),
        "id",
        F.col("hash").alias("content_hash"),
        F.when(F.col("k") == F.col("settle"), "done").otherwise("expired").alias("state"),
    )


def due(states: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, id): what each successful run has to process; the settled leases of :func:`replay`."""
    return replay(states, runs).where("state = 'done'").select("run_id", "id")


class StaleToken(RuntimeError):
    """A writer came back with a token that is no longer the newest."""


class WorkLedger:
    """Durable ledger below ``root`` on a file system that all executors share.

    ``items/batch=…`` are enqueued versions, ``leases/token=…`` the items of each lease and
    ``done/token=…`` those settled. Every folder is written once, at a path that follows from the
    token or batch name alone: a retry after a crash overwrites its own half-written folder, and
    a folder counts only once it has its ``_SUCCESS`` mark.

    Items are (id, content_hash). A document has one current version, the last one observed, and
    is due whenever that differs from the version of its newest lease that was settled or still
    holds. A return to an earlier hash is thus due again, and a version that another one replaced
    before anybody leased it is not.
    """

    ITEM = "id string, content_hash string"
    ORDER = ("at", "obs_id")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        fs, p = session.filesystem(self.spark, path)
        return fs.exists(p)

    def _parts(self, kind: str) -> list[str]:
        fs, p = session.filesystem(self.spark, f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if self._exists(f"{s.getPath().toString()}/_SUCCESS"))

    def _read(self, parts: list[str], more: str = "") -> DataFrame:
        """Items below ``parts``, which lie in one folder; ``more`` names further columns, of which
        ``token`` comes from the path."""
        schema = self.ITEM + more
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        return (reader.option("basePath", parts[0].rsplit("/", 1)[0]) if "token" in more else reader).parquet(*parts)

    def enqueue(self, batch: str, items: DataFrame) -> None:
        """Adds versions; a batch of a name that is already complete is left as it is.

        The current version of a document is the one with the greatest ``at``, then ``obs_id``
        (both bigint). Without these columns it is the one of the batch that was enqueued last;
        the batches of one ledger either all have them or all lack them.
        """
        path = f"{self.root}/items/batch={batch}"
        if not self._exists(f"{path}/_SUCCESS"):
            default = {"at": F.lit(len(self._parts("items"))), "obs_id": F.lit(0)}
            order = [(F.col(c) if c in items.columns else default[c]).cast("long").alias(c) for c in self.ORDER]
            items.select("id", canonical_hash(F.col("content_hash")).alias("content_hash"), *order).where("id is not null and content_hash is not null").distinct().write.mode("overwrite").parquet(path)

    def _leases(self) -> dict[int, tuple[str, float]]:
        """Lease folder and expiry time by token."""
        out = {}
        fs, p = session.filesystem(self.spark, f"{self.root}/tokens")
        for s in fs.listStatus(p) if fs.exists(p) else []:
            token, expires = s.getPath().getName().split("@")
            out[int(token)] = (f"{self.root}/leases/token={int(token):08d}", float(expires))
        return out

    def _done(self) -> list[str]:
        return self._parts("done")

    def done(self) -> DataFrame:
        return self._read(self._done())

    def pending(self, now: float) -> DataFrame:
        """Current versions that differ from the one of the document's newest lease, leases that
        ran out before ``now`` without being settled left aside."""
        settled = {p.rsplit("=", 1)[1] for p in self._done()}
        held = [path for t, (path, exp) in self._leases().items() if exp > now and f"{t:08d}" not in settled and self._exists(f"{path}/_SUCCESS")]
        items = self._read(self._parts("items"), "".join(f", {c} long" for c in self.ORDER))
        current = items.groupBy("id").agg(F.max(F.struct(*self.ORDER, "content_hash"))["content_hash"].alias("content_hash"))
        taken = self._read(self._done(), ", token int").union(self._read(held, ", token int"))
        had = taken.groupBy("id").agg(F.max(F.struct("token", "content_hash"))["content_hash"].alias("had"))
        return current.join(had, "id", "left").where(~F.col("content_hash").eqNullSafe(F.col("had"))).select("id", "content_hash")

    def _newest(self) -> int:
        """The greatest token claimed so far, be it leased or left behind by a crash."""
        fs, p = session.filesystem(self.spark, f"{self.root}/claims")
        claims = [int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()] if fs.exists(p) else []
        return max([*claims, *self._leases()], default=0)

    def _claim(self) -> int:
        """A token that nobody else gets: the next one whose claim file could be created."""
        while True:
            token = self._newest() + 1
            fs, p = session.filesystem(self.spark, f"{self.root}/claims/{token:08d}")
            try:
                fs.create(p, False).close()
                return token
            except Py4JJavaError:
                if not fs.exists(p):
                    raise

    def lease(self, now: float, ttl: float) -> int:
        """Leases everything pending and returns the fencing token. The claim file is created
        exclusively, so two workers never get the same token. A claim without a token, left by a
        worker that died before its lease was complete or is still at it, holds nothing."""
        token = self._claim()
        todo = self.pending(now)
        todo.write.mode("overwrite").parquet(f"{self.root}/leases/token={token:08d}")
        fs, p = session.filesystem(self.spark, f"{self.root}/tokens/{token}@{now + ttl}")
        fs.mkdirs(p)
        return token

    def leased(self, token: int) -> DataFrame:
        return self._read([f"{self.root}/leases/token={token:08d}"])

    def complete(self, token: int, now: float) -> None:
        """Settles the items of a lease. An expired token whose documents a newer lease took over is
        rejected, and so is one overtaken before its lease was complete, whose items a newer lease
        holds as well; settling twice has no further effect."""
        path = f"{self.root}/done/token={token:08d}"
        if self._exists(f"{path}/_SUCCESS"):
            return
        leases = self._leases()
        if token not in leases:
            raise StaleToken(f"token {token} was never leased")
        newer = [p for t, (p, _) in leases.items() if t > token]
        mine = self.leased(token)
        if newer and not mine.join(self._read(newer), ["id", "content_hash"], "left_semi").isEmpty():
            raise StaleToken(f"token {token}: its items were leased again")
        if leases[token][1] <= now and newer and not mine.join(self._read(newer), "id", "left_semi").isEmpty():
            raise StaleToken(f"token {token} expired and its documents were leased again")
        mine.write.mode("overwrite").parquet(path)


def drive(ledger: WorkLedger, states: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, id) that each successful run settles when ``ledger``, empty at first, is led through
    all runs in order: each enqueues what it is the first to see, leases what is pending and, if it
    is successful, completes its lease; else the lease has expired when the next run starts.

    The same rows as :func:`due`, by the durable tables instead of one plan; columns, nulls and
    order as there. Scale: three or four Spark jobs a run, each over all items so far.
    """
    spark = ledger.spark
    rows = (
        runs.where(F.col("started_at").isNotNull() & F.col("run_id").isNotNull())
        .select("run_id", F.unix_micros("started_at").alias("at"), (F.coalesce(F.col("ok") == 1, F.lit(False)) & F.col("finished_at").isNotNull()).alias("good"))
        .distinct()
        .collect()
    )
    order = sorted(rows, key=lambda r: (r["at"], r["run_id"]))
    log = states.where(F.col("last_seen").isNotNull()).select(
        F.col("id").cast("string").alias("id"),
        canonical_hash(F.col("content_hash")).alias("content_hash"),
        F.unix_micros(F.coalesce("last_changed", "last_seen")).alias("at"),
        F.col("obs_id").cast("long").alias("obs_id"),
        F.unix_micros("last_seen").alias("seen"),
    )
    settled, before = [], None
    for k, run in enumerate(order):
        fresh = log.where(F.col("seen") <= run["at"])
        if before is not None:
            fresh = fresh.where(F.col("seen") > before)
        before = run["at"]
        ledger.enqueue(f"{k:06d}", fresh)
        now = run["at"] / 1e6
        until = order[k + 1]["at"] / 1e6 if k + 1 < len(order) else now
        token = ledger.lease(now, (until - now) / 2)  # over before the next run, whatever the rounding
        if run["good"]:
            ledger.complete(token, now)
            settled.append((token, run["run_id"]))
    tokens = spark.createDataFrame(settled, "token int, run_id string")
    return ledger._read(ledger._done(), ", token int").join(F.broadcast(tokens), "token").select("run_id", "id")
