"""What the corpus operators have in common: the shared work folder, word splitting and column names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Words are maximal runs without space and the five ASCII white-space controls.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Unicode's White_Space characters, as the inside of a character class. Python's \s and str.split() also take 1C to 1F.
SPACE = "\\t-\\r \\x85\\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: What str.split() takes as white space although a word may hold it.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f" + SPACE.removeprefix("\\t-\\r ") + "]")


def words_of(text: str | None) -> list[str]:
    """The words of a text, in order. str.split() is several times faster and equal unless other white space occurs."""
    if not text:
        return []
    if text.isascii():
        if not _ascii_controls(text):
            return text.split()
    elif not _OTHER_SPACE.search(text):
        return text.split()
    return WORD_RE.findall(text)


def _ascii_controls(text: str) -> bool:
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local_folder()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_LOCAL: list[str] = []


def _local_folder() -> str:
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="vigil-"))
    return _LOCAL[0]


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The same rows, written below the shared folder and read back: it cuts the lineage and outlives lost executors."""
    path = work_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(spark: SparkSession) -> int:
    """How many hash buckets packed exchanges use: as many as the session's shuffles have partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Work:
    """The work tables of one call, in a folder of its own below the shared folder. Superseded ones are deleted as soon as nothing reads them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.tables = spark, work_path(spark, what), {}

    def write(self, df: DataFrame, what: str) -> DataFrame:
        """The same rows, written and read back: it cuts the lineage and outlives lost executors."""
        path = f"{self.root}/{what}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(back)] = (back, path)
        return back

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.tables.pop(id(t))[1])

    def last(self, df: DataFrame, what: str) -> DataFrame:
        """Write df and delete all other tables of this call."""
        out = self.write(df, what)
        self.drop(*[t for t, _ in list(self.tables.values()) if t is not out])
        return out


def _store(spark: SparkSession, path: str):
    """The path and its file system, in whichever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    at, store = _store(spark, path)
    store.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _store(spark, path)
    return store.exists(at)


#: Logical operators that pass each row of a table at most once.
_ONE_TO_ONE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation"}


def _one_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _ONE_TO_ONE or plan.nodeName().startswith("Relation"):
        below = plan.children()
        if below.size() == 0:
            return True
        plan = below.head()
    return False


def identified(df: DataFrame, what: str) -> DataFrame:
    """doc, a struct of all columns of df, and row, a struct that tells its rows apart and is the same in every scan.

    A table that Spark reads from files is told apart by file and place in the file and isn't written again;
    anything else is written once below the shared folder, as its row numbers hold for one evaluation only.
    As all columns are in the struct, none can clash.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")
    if "_metadata" not in df.columns and _one_scan(df):
        try:
            return df.select(doc, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")).alias("row"))
        except AnalysisException:
            pass  # not a file source
    numbered = df.select(doc, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at")).alias("row"))
    return written(numbered, what)


def chosen(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """The documents of identified() rows whose row is in keep, with their columns as they were. Both sides are shuffled at any size."""
    return rows.join(keep.hint("merge"), "row", "left_semi").select("doc.*")
