"""What the operators share: written tables, unused column names, schemas that every input must have."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from timeweave.functions.partitions import spread
from timeweave.llm.textbatch import count_words


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset, a local session gets a temporary folder; a cluster gets an error, since no machine's own
    folder would do there.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="timeweave-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, no executor holds it, and the planner knows its size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table from `written` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to `name` that df doesn't have (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parts(spark: SparkSession) -> int:
    """How many pieces an exchange of packed arrays has: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """The planner's estimate of df's size, from its files; 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_words(df: DataFrame, key: str, kind: str) -> DataFrame:
    """key (cast to kind) and n, the number of whitespace-separated words of text (0 if null), for each row of df.

    Counted on the byte buffers of Arrow batches: a few nanoseconds a byte, where a regular expression takes many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count_words(batch.column(1)))], [key, "n"])

    return small_batches(df).select(F.col(key).cast(kind).alias(key), F.col("text").cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, n long")


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """df with its rows, of all columns, mapped by `run`, which finds them in their order; columns may have any names, with dots in them or repeated."""
    safe = [f"c{k}" for k in range(len(df.columns))]
    schema = StructType([StructField(s, f.dataType, f.nullable) for s, f in zip(safe, df.schema.fields)])
    return small_batches(df).toDF(*safe).mapInArrow(run, schema).toDF(*df.columns)


def small_batches(df: DataFrame) -> DataFrame:
    """df, on all cores; in its session, Arrow batches hold 2,000 rows unless another number is set, as rows with whole texts are large."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spread(df)


#: Characters that end a word, here and in DuckDB.
SPACE = r"[ \t\n\r\f\x0B]+"
#: A text's words in DuckDB.
N_WORDS_SQL = r"len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda w: w <> ''))::BIGINT"
