"""Change streams: an append-only log per partition, folded in batch or by Structured Streaming.

A record has partition_id, offset, commit_version, batch_index, batch_size, entity_id, target_id,
edge_type, op (CREATE, UPDATE, DELETE), valid_from and valid_to.  Applying is idempotent by
(partition_id, offset); a partition is applied up to its first gap, whole transactions only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("partition_id", T.IntegerType()),
        T.StructField("partition_epoch", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("commit_version", T.LongType()),
        T.StructField("txn_id", T.LongType()),
        T.StructField("batch_index", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("entity_id", T.LongType()),
        T.StructField("target_id", T.LongType()),
        T.StructField("edge_type", T.IntegerType()),
        T.StructField("op", T.StringType()),
        T.StructField("valid_from", T.LongType()),
        T.StructField("valid_to", T.LongType()),
    ]
)
KEYS = ("partition_id", "entity_id", "target_id", "edge_type")


def once(records: DataFrame) -> DataFrame:
    """Each (partition, offset) once; a repeated delivery changes nothing."""
    return records.dropDuplicates(["partition_id", "offset"])


def applicable(records: DataFrame, start: int | DataFrame = 1, block: int = 65_536) -> DataFrame:
    """The gapless prefix of each partition from its first offset on, less a last transaction that is incomplete.

    ``start`` is that first offset, or a table of it (partition_id, start); partitions that the
    table does not have start at 1.  Offsets are looked at in blocks of ``block``: a partition's
    blocks before its first incomplete one are there whole, and only that one is looked at row by
    row, so that a hot partition's log is not the work of one task.
    """
    rows = once(records)
    if isinstance(start, DataFrame):
        known = start.select(F.col("partition_id").alias("_p"), F.col("start").alias("_from"))
        rows = rows.join(known, F.col("partition_id") == F.col("_p"), "left").withColumn("_s", F.coalesce("_from", F.lit(1))).drop("_p", "_from")
    else:
        rows = rows.withColumn("_s", F.lit(start))
    prefix = _gapless(rows.where("offset >= _s").withColumn("_at", F.col("offset") - F.col("_s")), block)
    last = prefix.where("batch_index = batch_size - 1").groupBy(F.col("partition_id").alias("_q")).agg(F.max("offset").alias("_last"))
    return prefix.join(last, (F.col("partition_id") == F.col("_q")) & (F.col("offset") <= F.col("_last"))).select(*records.columns)


def _gapless(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` (partition_id, _at, ...; an _at once in a partition) whose _at is in the partition's run 0, 1, 2, ..."""
    rows = rows.withColumn("_b", F.expr(f"_at div {block}"))
    counts = rows.groupBy(F.col("partition_id").alias("_p"), F.col("_b").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("_p").orderBy("_c")
    whole = (F.col("_n") == block) & (F.col("_c") == F.row_number().over(order) - 1)
    counts = counts.withColumn("_w", whole).withColumn("_ok", F.min(F.col("_w")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    counts = counts.where("coalesce(_ok, true)").select("_p", "_c")
    inside = F.row_number().over(W.partitionBy("partition_id", "_b").orderBy("_at"))
    return rows.join(counts, (F.col("partition_id") == F.col("_p")) & (F.col("_b") == F.col("_c"))).withColumn("_k", inside + F.col("_b") * block - 1).where("_k = _at")


def in_version_order(records: DataFrame, done: DataFrame, block: int = 65_536) -> DataFrame:
    """The records of each partition up to the first commit version that is missing or not there with all its records.

    ``done`` (partition_id, applied_version) says which version each partition has reached; a
    partition that it does not have begins at version 1.
    """
    reached = done.select(F.col("partition_id").alias("_d"), F.col("applied_version").alias("_v"))
    rows = records.join(reached, F.col("partition_id") == F.col("_d"), "left").withColumn("_v", F.coalesce("_v", F.lit(0).cast("bigint"))).drop("_d")
    parts = rows.where("commit_version > _v").groupBy("partition_id", "commit_version", "_v").agg(F.count_distinct("batch_index").alias("_n"), F.min_by("batch_size", "batch_index").alias("_of"))
    run = _gapless(parts.where("_n >= _of").withColumn("_at", F.col("commit_version") - F.col("_v") - 1), block)
    last = run.groupBy(F.col("partition_id").alias("_q")).agg(F.max("commit_version").alias("_last"))
    return rows.join(last, F.col("partition_id") == F.col("_q"), "left").where(F.col("commit_version") <= F.coalesce("_last", "_v")).select(*records.columns)


def progress(records: DataFrame, start: int = 1) -> DataFrame:
    """(partition_id, applied_offset, gap): where each partition stands and whether a record is missing."""
    done = applicable(records, start).groupBy("partition_id").agg(F.max("offset").alias("applied_offset"))
    top = records.groupBy("partition_id").agg(F.max("offset").alias("_top"), F.count_distinct("offset").alias("_n"), F.min("offset").alias("_low"))
    gap = (F.col("_top") - start + 1 != F.col("_n")) | (F.col("_low") > start)
    return top.join(done, "partition_id", "left").select("partition_id", F.coalesce("applied_offset", F.lit(start - 1).cast("bigint")).alias("applied_offset"), gap.alias("gap"))


def read_after(records: DataFrame, offset: int, limit: int) -> DataFrame:
    """At most ``limit`` records of each partition after ``offset``, in order."""
    rank = F.row_number().over(W.partitionBy("partition_id").orderBy("offset"))
    return once(records.where(F.col("offset") > offset)).withColumn("_n", rank).where(F.col("_n") <= limit).drop("_n")


def snapshot(records: DataFrame, version: int | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Each key's newest record at ``commit_version`` <= version, unless it deletes."""
    rows = once(records if version is None else records.where(F.col("commit_version") <= version))
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("commit_version", "offset")).alias("_r"))
    return newest.where("_r.op <> 'DELETE'").select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def edge_records(records: DataFrame) -> DataFrame:
    """(src, dst, type, valid_from, valid_to, ...): a delete ends where it begins; no end is null."""
    start = F.when(F.col("valid_from") > 0, F.col("valid_from")).otherwise(F.col("commit_version"))
    end = F.when(F.col("op") == "DELETE", start).otherwise(F.when(F.col("valid_to") > 0, F.col("valid_to")))
    return records.select(F.col("entity_id").alias("src"), F.col("target_id").alias("dst"), F.col("edge_type").alias("type"), start.alias("valid_from"), end.alias("valid_to"), "op", "commit_version", "offset", "partition_id")


def scan_at(edges: DataFrame, when: int, vertex: int | None = None, direction: str = "out") -> DataFrame:
    """(src, dst, type, valid_from, valid_to) as of ``when``: each edge's newest interval that has begun, if it has not ended."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    rows = edges.where(F.col("valid_from") <= when)
    if vertex is not None:
        rows = rows.where(F.col(a) == vertex)
    order = F.struct("valid_from", "commit_version", "offset")
    newest = rows.groupBy("src", "dst", "type").agg(F.max_by(F.struct("valid_from", "valid_to"), order).alias("_r"))
    return newest.where(F.col("_r.valid_to").isNull() | (F.col("_r.valid_to") > when)).select("src", "dst", "type", "_r.valid_from", "_r.valid_to")


def safe_watermark(applied: int, oldest_query: int | None, now: int, retention: int) -> int:
    """The version below which nothing is needed: applied, not in use, and out of retention."""
    return min(applied, applied if oldest_query is None else oldest_query, now - retention)


def collect_garbage(edges: DataFrame, watermark: int) -> DataFrame:
    """Edges whose interval had not ended by ``watermark``."""
    return edges.where(F.col("valid_to").isNull() | (F.col("valid_to") >= watermark))


def ready(served_version: int | None, required_version: int) -> str:
    """Whether a view may answer: READY, NOT_READY before its first version, or VERSION_LAG."""
    return "NOT_READY" if served_version is None else "READY" if served_version >= required_version else "VERSION_LAG"


class BadRecord(ValueError):
    """A change record whose batch metadata cannot be."""


PROGRESS = T.StructType(
    [
        T.StructField("partition_id", T.IntegerType()),
        T.StructField("partition_epoch", T.LongType()),
        T.StructField("applied_offset", T.LongType()),
        T.StructField("applied_version", T.LongType()),
    ]
)


class EdgeView:
    """A materialised edge view: the change stream folded, batch by batch, into a table.

    Each micro-batch adds a folder of its own: the newest record of each key that it touched, the
    records that wait behind a gap, and where each partition stands.  The last of these is written
    last, and a folder without it does not count, so a view that is opened again on its path goes
    on where the newest complete folder ends.  Every ``compact_every`` folders the whole view is
    written and older folders go.  Reading folds what was written since.

    A batch that was applied before is skipped, and so is a record at or below its partition's
    applied offset: replays are harmless.  A partition is applied up to its first gap, whole
    transactions only.  It follows one epoch: records of older ones are dropped, those of a newer
    one wait until ``replace_partition`` moves the partition there.
    """

    def __init__(self, spark: SparkSession, path: str, compact_every: int = 8):
        self.spark, self.path, self.compact_every = spark, path.rstrip("/"), compact_every
        self.number, self.batch, self.parts = 0, -1, []
        for name in sorted(self._folders(), key=self._number_of):
            if self._exists(f"{name}/progress/_SUCCESS"):
                self._opened(name)

    @property
    def version(self) -> int | None:
        """The newest version that any partition has applied; None before the first."""
        return self.progress().agg(F.max("applied_version")).first()[0]

    # folders are called v<number>-b<batch>, those that hold the whole view v<number>-b<batch>-whole

    @staticmethod
    def _number_of(name: str) -> int:
        return int(name.split("-")[0][1:])

    def _hadoop(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _exists(self, name: str) -> bool:
        fs, where = self._hadoop(f"{self.path}/{name}")
        return fs.exists(where)

    def _folders(self) -> list[str]:
        fs, where = self._hadoop(self.path)
        found = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return [n for n in found if re.fullmatch(r"v\d+-b-?\d+(-whole)?", n)]

    def _opened(self, name: str) -> None:
        self.number, self.batch = self._number_of(name), int(re.search(r"-b(-?\d+)", name)[1])
        self.parts = [name] if name.endswith("-whole") else [*self.parts, name]

    def _table(self, kind: str, schema: T.StructType, names: Sequence[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}/{kind}" for n in names])

    def _write(self, batch: int, records: DataFrame, waiting: DataFrame, progress: DataFrame, whole: bool) -> None:
        name = f"v{self.number + 1}-b{batch}" + ("-whole" if whole else "")
        for kind, rows in (("records", records), ("waiting", waiting), ("progress", progress.coalesce(1))):
            rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{name}/{kind}")
        self._opened(name)
        if whole:
            for old in self._folders():
                if self._number_of(old) < self.number:
                    fs, where = self._hadoop(f"{self.path}/{old}")
                    fs.delete(where, True)

    def progress(self) -> DataFrame:
        """(partition_id, partition_epoch, applied_offset, applied_version)."""
        return self._table("progress", PROGRESS, self.parts[-1:])

    def waiting(self) -> DataFrame:
        """Records that are there but not applied: behind a gap, of an incomplete transaction or of an epoch to come."""
        return self._table("waiting", SCHEMA, self.parts[-1:])

    def read(self) -> DataFrame:
        """The newest record of each key, deletes too."""
        rows = self._table("records", SCHEMA, self.parts)
        return _newest(rows) if len(self.parts) > 1 else rows

    def edges(self) -> DataFrame:
        return self.read().where("op <> 'DELETE'")

    def apply(self, records: DataFrame, batch: int, unordered: bool = False) -> None:
        """The next folder of the view, with what of ``records`` and of the waiting ones can be applied.

        Of an ``unordered`` log a transaction is applied only after those of all earlier commit versions.
        """
        from timeweave.operators.traverse import checkpoint

        if batch <= self.batch:
            return
        if not records.where("batch_size IS NULL OR batch_index IS NULL OR batch_index < 0 OR batch_index >= batch_size").isEmpty():
            raise BadRecord("a change record has an impossible batch_index or batch_size")
        there = records.select(*SCHEMA.fieldNames()).unionByName(self.waiting())
        done = self.progress().select(F.col("partition_id").alias("_p"), F.col("partition_epoch").alias("_e"), F.col("applied_offset").alias("_o"))
        first = there.groupBy(F.col("partition_id").alias("_n")).agg(F.min("partition_epoch").alias("_first"))
        there = there.join(done, F.col("partition_id") == F.col("_p"), "left").join(first, F.col("partition_id") == F.col("_n"))
        there = there.withColumn("_e", F.coalesce("_e", "_first")).where((F.col("partition_epoch") > F.col("_e")) | (F.col("partition_epoch") == F.col("_e")) & (F.col("offset") > F.coalesce("_o", F.lit(0))))
        there = checkpoint(there.select(*SCHEMA.fieldNames(), (F.col("partition_epoch") == F.col("_e")).alias("_now")))
        start = self.progress().select("partition_id", (F.col("applied_offset") + 1).alias("start"))
        now = there.where("_now").drop("_now")
        now = checkpoint(applicable(in_version_order(now, self.progress()) if unordered else now, start))
        moved = now.groupBy("partition_id").agg(F.max("partition_epoch").alias("partition_epoch"), F.max("offset").alias("applied_offset"), F.max("commit_version").alias("applied_version"))
        stays = self.progress().join(moved.select(F.col("partition_id").alias("_p")), F.col("partition_id") == F.col("_p"), "left_anti")
        progress = stays.unionByName(moved)
        reached = moved.select(F.col("partition_id").alias("_p"), F.col("applied_offset").alias("_o"))
        left = there.join(reached, F.col("partition_id") == F.col("_p"), "left").where(~F.col("_now") | (F.col("offset") > F.coalesce("_o", F.lit(0))))
        left = left.select(*SCHEMA.fieldNames()).dropDuplicates(["partition_id", "partition_epoch", "offset"])
        whole = len(self.parts) + 1 >= self.compact_every
        self._write(batch, _newest(self.read().unionByName(now) if whole else now), left, progress, whole)

    def replace_partition(self, partition: int, records: DataFrame, offset: int, version: int, epoch: int = 1) -> None:
        """``partition`` as in ``records``, a snapshot of it at ``offset`` and ``version`` of ``epoch``; all others stay as they are.

        The stream's batches are not touched: it goes on after the last that was applied, and
        records up to ``offset`` are skipped.
        """
        rows = self.read().where(F.col("partition_id") != partition).unionByName(snapshot(records).select(*SCHEMA.fieldNames()))
        one = self.spark.createDataFrame([(partition, epoch, offset, version)], PROGRESS)
        progress = self.progress().where(F.col("partition_id") != partition).unionByName(one)
        past = (F.col("partition_epoch") < epoch) | (F.col("partition_epoch") == epoch) & (F.col("offset") <= offset)
        self._write(self.batch, rows, self.waiting().where((F.col("partition_id") != partition) | ~past), progress, True)

    def catch_up(self, partition: int, epoch: int, earliest: int, load: Callable[[], tuple[DataFrame, int, int]]) -> str:
        """What must happen before the log of ``partition`` can be followed, done; says which it was.

        TAIL if the view stands in the same epoch and the log still has the next record; otherwise
        ``load`` gives the partition's snapshot with its offset and version, and that replaces it.
        """
        row = self.progress().where(F.col("partition_id") == partition).first()
        how = resume(epoch, row and row["partition_epoch"], row and row["applied_offset"], earliest)
        if how == "SNAPSHOT":
            records, offset, version = load()
            self.replace_partition(partition, records, offset, version, epoch)
        return how

    def run(self, source: str, checkpoint: str, files_per_batch: int = 1, unordered: bool = False) -> None:
        """Apply all record files that are in ``source`` now, then stop.

        Files of an ``unordered`` log come in any order; what is early waits in the view's own
        table, not in a stream's state, so its size is bounded by disk alone.
        """
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        if unordered:
            stream = stream.where("commit_version IS NOT NULL AND batch_index IS NOT NULL AND batch_size IS NOT NULL")
        query = stream.writeStream.foreachBatch(lambda records, batch: self.apply(records, batch, unordered)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def _newest(records: DataFrame) -> DataFrame:
    """The newest record of each key, deletes too."""
    rest = [c for c in SCHEMA.fieldNames() if c not in KEYS]
    newest = records.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("commit_version", "offset")).alias("_r"))
    return newest.select(*[F.col(c) if c in KEYS else F.col(f"_r.{c}").alias(c) for c in SCHEMA.fieldNames()])


def reorder(records: DataFrame, start: int = 1) -> DataFrame:
    """Records in commit order per partition whatever order they came in; what follows a gap waits."""
    return applicable(records, start).sortWithinPartitions("partition_id", "commit_version", "offset")


def resume(epoch: int, saved_epoch: int | None, applied: int | None, earliest: int) -> str:
    """TAIL from a checkpoint of the same epoch whose next record is still in the log; otherwise SNAPSHOT first."""
    usable = saved_epoch == epoch and applied is not None and applied + 1 >= earliest
    return "TAIL" if usable else "SNAPSHOT"


def ordered_stream(records: DataFrame, start: int = 1, by: str = "offset", most: int = 1_000_000) -> DataFrame:
    """A stream's records in order of ``by`` within each partition, each once.

    By ``offset`` each record follows the one before; by ``commit_version`` each transaction (all
    its ``batch_size`` records) follows the version before.  What comes early waits in the
    partition's state, and what was handed on is dropped.  The state holds what lies beyond a gap,
    as text, so that no number passes through a float; more than ``most`` waiting records fail the
    batch, which is then not acknowledged: the source has to fill the gap first.
    """
    import pandas as pd

    names = SCHEMA.fieldNames()
    in_order = by == "offset"
    one = F.lit(1).cast("int")
    rows = records.select("partition_id", F.col(by).alias("_at"), (one - 1 if in_order else F.col("batch_index")).alias("_k"), (one if in_order else F.col("batch_size")).alias("_of"), F.to_json(F.struct(*names)).alias("_row"))

    def step(key, batches, state):
        import json

        following, waiting = state.get if state.exists else (start, "[]")
        held = {(at, k): (of, row) for at, k, of, row in json.loads(waiting)}
        for b in batches:
            for at, k, of, row in zip(b["_at"].tolist(), b["_k"].tolist(), b["_of"].tolist(), b["_row"].tolist(), strict=True):
                if at >= following:
                    held.setdefault((at, k), (of, row))
        there: dict[int, int] = {}
        for at, _ in held:
            there[at] = there.get(at, 0) + 1
        out = []
        while there.get(following):
            parts = sorted(k for k in range(there[following] + 1) if (following, k) in held)
            if not parts or len(parts) < held[(following, parts[0])][0]:
                break
            out += [held.pop((following, k))[1] for k in parts]
            following += 1
        if len(held) > most:
            raise RuntimeError(f"{len(held)} records of partition {key[0]} wait for {by} {following}")
        state.update((following, json.dumps([(at, k, of, row) for (at, k), (of, row) in sorted(held.items())])))
        yield pd.DataFrame({"_row": pd.Series(out, dtype="object")})

    usable = rows.where("_at IS NOT NULL AND _k IS NOT NULL AND _of IS NOT NULL")
    out = usable.groupBy("partition_id").applyInPandasWithState(step, "_row string", "following long, waiting string", "append", "NoTimeout")
    return out.select(F.from_json("_row", SCHEMA).alias("_r")).select("_r.*")
