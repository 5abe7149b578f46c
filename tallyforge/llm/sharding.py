"""Sharding by size-tiered compaction, with DataFrame functions alone.

A store is a folder: ``data/<generation>`` with immutable Parquet shards, ``manifest/<generation>`` with one row per live
shard (path, tier, bytes, rows), and ``commits/<version>``, a small file that names a manifest. ``append`` writes arrivals as
small shards without a shuffle, ``compact`` merges shards of one tier (sizes within a factor RATIO) in runs of about the
target size. Both write data and manifest first and then publish the commit under the next number, which only one writer
can do: by a rename that fails if the file is there (on a local file system by a hard link, which is exclusive). A writer
that comes second goes by the newer version: an append adds its shards to that one, a merge is committed if all the shards
it replaces are still live and planned anew otherwise. Readers see all of a change or nothing. What a lost driver or
executor leaves behind is named by no commit and hinders nobody. ``vacuum`` deletes files that none of the last versions
names and that are older than any write could be.

A run is a set of shards cut by the running sum of their bytes, so every merged shard is one task of about the target size;
no group grows with the data. The manifest is the only thing summed in one order: one row per shard, within its tier. Like
any table's file list, the paths of the shards to read go through the driver; rows never do.

Defined cases: an empty arrival commits a version without new shards; a shard larger than the target stays as it is;
a tier with fewer than FANOUT shards waits; nulls, long texts and repeated rows are kept as they come; rows may have
columns of any names.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import free, scratch_dir, table
from tallyforge.sources.commits import CommitLog

#: Compressed bytes of a full shard; a loader reads shards whole.
TARGET_BYTES = 32 << 20
RATIO = 4
FANOUT = 4
#: Shards are kept for long and read often.
CODEC = "zstd"
#: Tasks of a merge for each run, so that few tasks get several runs.
TASKS_PER_RUN = 4
#: Rows of an arriving shard, at most.
SMALL_ROWS = 50_000
ARRIVALS = 3
#: Versions that stay readable, and the age in seconds below which no file is deleted.
KEEP_VERSIONS, GRACE = 10, 86_400
SHARD = "path string, tier int, bytes long, rows long"


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, small_rows: int = SMALL_ROWS):
        self.spark, self.root, self.target, self.small_rows = spark, root.rstrip("/"), target_bytes, small_rows
        self.commits = CommitLog(spark, f"{self.root}/commits")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        """The committed versions, ascending."""
        return self.commits.numbers()

    def version(self) -> int:
        """The last committed version, 0 before the first."""
        return self.commits.last()

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(SHARD).parquet(f"{self.root}/manifest/{self.commits.texts([v])[v]}") if v else self.spark.createDataFrame([], SHARD)

    def _commit(self, shards: DataFrame, based_on: int) -> bool:
        """Write the manifest after the one a change was based on; False if another writer was first."""
        generation = uuid.uuid4().hex
        shards.coalesce(1).write.parquet(f"{self.root}/manifest/{generation}")
        return self.commits.publish(generation, based_on + 1)

    def _written(self, folder: str) -> DataFrame:
        """Manifest rows of the shards in a folder, from the files themselves."""
        files = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        found = files.groupBy("path").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))
        return found.select("path", tier_of(F.col("bytes"), self.target).alias("tier"), "bytes", "rows")

    def append(self, arrivals: DataFrame) -> int:
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.write.option("maxRecordsPerFile", self.small_rows).option("compression", CODEC).parquet(folder)
        while True:
            based_on = self.version()
            if self._commit(self.manifest(based_on).unionByName(self._written(folder)), based_on):
                return based_on + 1

    def compact(self) -> int:
        """Merge until no tier below the target has FANOUT shards."""
        while True:
            live = self.manifest(planned_on := self.version())
            runs = self.runs(live)
            n = runs.select("run").distinct().count()
            if not n:
                return planned_on
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            rows, shard = self._rows(runs)
            run = free("_run", rows.columns)
            rows = rows.join(runs.select(F.col("path").alias(shard), F.col("run").alias(run)), shard).drop(shard)
            rows.repartition(TASKS_PER_RUN * n, run).sortWithinPartitions(run).write.partitionBy(run).option("compression", CODEC).parquet(folder)
            while True:
                live = self.manifest(based_on := self.version())
                if not runs.join(live, "path", "left_anti").isEmpty():
                    break  # another merge has replaced some of these shards; the merged files stay unnamed
                if self._commit(live.join(runs.select("path"), "path", "left_anti").unionByName(self._written(folder)), based_on):
                    break

    def _rows(self, shards: DataFrame) -> tuple[DataFrame, str]:
        """Rows of these shards, and the name of the column that holds their file."""
        paths = [r[0] for r in shards.select("path").collect()]
        if not paths:
            raise ValueError("the store is empty")
        rows = self.spark.read.option("recursiveFileLookup", "true").parquet(*paths)
        shard = free("_shard", rows.columns)
        return rows.withColumn(shard, F.col("_metadata.file_path")), shard

    def runs(self, live: DataFrame) -> DataFrame:
        """(path, run): which shards are merged with which; a run has two shards at least."""
        tier = Window.partitionBy("tier")
        order = tier.orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, -1)
        due = live.where(F.col("tier") > 0).withColumn("n", F.count("*").over(tier)).where(F.col("n") >= FANOUT)
        cut = due.withColumn("run", F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / self.target))
        cut = cut.withColumn("together", F.count("*").over(Window.partitionBy("tier", "run"))).where("together > 1")
        return cut.select("path", F.concat_ws("-", "tier", "run").alias("run"))

    def read(self, version: int | None = None) -> DataFrame:
        """All live rows, each with its shard's file, tier, bytes and rows as _shard, _tier, _bytes and _rows."""
        live = self.manifest(version)
        rows, shard = self._rows(live)
        told = {c: free(f"_{c}", rows.columns) for c in ("tier", "bytes", "rows")}
        return rows.join(live.select(F.col("path").alias(shard), *[F.col(c).alias(name) for c, name in told.items()]), shard)

    def vacuum(self, keep_versions: int = KEEP_VERSIONS, grace: float = GRACE) -> int:
        """Forget versions but for the last ones and those younger than grace, and delete what no other version names and is as old; returns how many data folders."""
        before = time.time() - grace
        ages = self.commits.ages()
        kept = [v for v in ages if v in sorted(ages)[-keep_versions:] or ages[v] > before]
        manifests = set(self.commits.texts(kept).values())
        folders: set[str] = set()
        for v in kept:
            folders |= {r[0] for r in self.manifest(v).select(F.regexp_extract("path", r"/data/([^/]+)/", 1)).distinct().collect()}
        for v in set(ages) - set(kept):
            self.commits.forget(v)
        gone = 0
        for folder, named in (("data", folders), ("manifest", manifests)):
            fs, at = self._fs(f"{self.root}/{folder}")
            for x in fs.listStatus(at) if fs.exists(at) else []:
                if x.getPath().getName() not in named and x.getModificationTime() / 1000 <= before:
                    fs.delete(x.getPath(), True)
                    gone += folder == "data"
        return gone


def tier_of(size, target: int):
    """0 from three quarters of the target on, else 1 for each further factor RATIO below it."""
    return F.when(size >= 0.75 * target, 0).otherwise(F.least(F.lit(12), 1 + F.floor(F.ln(F.lit(float(target)) / F.greatest(size, F.lit(1))) / F.ln(F.lit(float(RATIO)))).cast("int")))


def op10(spark, sf_dir: str) -> DataFrame:
    """documents in ARRIVALS arrivals, appended, compacted and read back: each row's shard by number, with its size and tier."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{scratch_dir(spark)}/tallyforge/shards-{uuid.uuid4().hex}")
    for k in range(ARRIVALS):
        store.append(docs.where(F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(ARRIVALS)) == k))
    version = store.compact()
    store.vacuum(keep_versions=1, grace=0)  # nobody else writes or reads this store
    rows = store.read(version)
    shard = F.regexp_extract("_shard", "/data/(.*)$", 1)
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), shard.alias("shard"), F.col("_tier").alias("tier"), F.col("_bytes").alias("shard_bytes"), F.col("_rows").alias("shard_rows"), F.lit(version).alias("version"))
