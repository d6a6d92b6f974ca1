"""What the corpus operators share: tables in the shared folder, bounded slices of Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the documents table, in order; what filtering stages return.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: ASCII white space as the contracts define it, as a Java or RE2 character class.
WHITE = r"\x20\x09-\x0D"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset (local sessions)."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN:
        _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="quillfern-")
        atexit.register(shutil.rmtree, _OWN[sc.applicationId], ignore_errors=True)
    return f"file://{_OWN[sc.applicationId]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillfern/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back.

    Cuts the lineage: a lost executor costs tasks of the current job alone, and what is used
    twice is computed once. drop_stash() deletes the files when the caller knows they are done with.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path  # noqa: SLF001
    return out


def drop_stash(*dfs: DataFrame) -> None:
    """Deletes the files behind DataFrames that stash() returned. Only for those from which no unwritten result hangs any more."""
    for df in dfs:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._stash_path)  # noqa: SLF001
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)  # noqa: SLF001


def free_name(df: DataFrame, label: str) -> str:
    """A column name that df does not have, in any case."""
    return "_" * (1 + max([0, *map(len, df.columns)])) + label


def text_slices(batches, max_bytes: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts (null: '') of (id, text) Arrow batches, in slices of about max_bytes or one text."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate([*lengths, max_bytes]):
            if i > start and (i == len(lengths) or size + n > max_bytes):
                yield ids.slice(start, i - start).to_pylist(), [t or "" for t in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n


def id_and_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that text operators read, under fixed names, so that other columns never clash."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
