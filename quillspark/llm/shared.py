"""What the training-data operators share: shared-folder tables and batch limits."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches sent to Python stay near this many bytes, so long texts don't pile up.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes where this Spark has the setting; safe to call again."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES)), ("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")):
        try:
            spark.conf.set(key, value)
        except Exception as error:  # an unknown or static setting only costs memory, not results
            if "CONF" not in str(error).upper():
                raise
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from spark.checkpoint.dir.

    Where that is unset, a session of one machine gets a temporary folder, as in tests;
    on a cluster it is an error, as executors would each write to their own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Folders of intermediate tables that this process has written and not deleted.
_written: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    if not _written:
        atexit.register(discard, spark)
    _written.append(f"{shared_dir(spark)}/quillspark/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again: lineage ends there and lost executors cost no recomputation."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Delete the intermediate tables written so far, except those that ``but`` reads; results not yet written need theirs.

    What is left when the process ends goes then, if the session still runs.
    """
    if spark.sparkContext._jsc is None:
        return
    needed = {f.rpartition("/")[0] for f in but.inputFiles()} if but is not None else set()
    base = lambda path: path.split(":", 1)[-1].lstrip("/")
    held = {base(f) for f in needed}
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _written if base(p) not in held]:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _written.remove(path)


#: Rows of ids up to this many (some 30 MB) are sent to all executors; beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def small(rows: DataFrame, times: int = 1) -> DataFrame:
    """``rows``, marked for broadcast if there are few; ``times``: the bound counts rows so many times over. Counts them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS * times else rows


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``ids``; rows with a null id stay."""
    ids = keep(ids.where("doc_id is not null").distinct(), "dropped-ids")
    return docs.join(small(ids), "doc_id", "left_anti").select(docs.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(column, n: int):
    """crc32 of the id as decimal text, modulo ``n``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def partitions_for(spark: SparkSession, total_bytes: int, each: int = 32 << 20) -> int:
    """A partition count that follows the data's size and is never below the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes) // each))
