"""Delta-maintained token counts by source, language and tokenizer version.

A rollup is a folder with a log and data folders. Each committed batch has a data folder with its signed ledger (one
row per document row: +1 inserted, -1 taken back, with token and character counts) and the delta that sums
the ledger by source, language and tokenizer. Totals are the sum of all deltas, so they never need the texts again.

A commit writes its data folder first, then claims the next number of the log by a rename that refuses an existing
target. Whoever comes second takes back what the winner's ledger now holds and tries the number after it, so
concurrent batches act as if one came after the other, and an id is never taken back twice. A failed or repeated
commit of a batch id changes nothing, whichever executors are lost on the way. The rename must be atomic, as on
HDFS; where a store's is not, there must be one writer at a time.

Changes are rows of (doc_id, op, source, lang, text): insert adds the row's counts, delete takes back
everything recorded for the id, revise does both. Counts taken back come from the ledgers, by an equi
join on the id with the rows that delete or revise; batches that only insert read no ledger. compact() replaces the ledgers and deltas
so far by their net, so that later batches and totals read one folder in place of one per batch.

Defined cases: null texts count zero tokens; null sources and languages are groups of their own (null); rows of a null id are
inserted, and nothing takes them back; several inserts of an id add up; deletes of unknown ids take nothing back; several deletes or revisions of one id in a
batch take back once; an unknown or null op raises; an empty batch commits an empty delta; a batch id is any text. Extra columns of the changes are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfern.llm.common import drop_stash, stash, text_slices

TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published split pattern of this vocabulary.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEDGER = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long, chars long"
_LOADED: dict[str, object] = {}


def load_tokenizer(path: str):
    """The byte-level BPE of a .tiktoken file; read once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def count_tokens(rows: DataFrame, path: str = TOKENIZER_PATH, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, lang, text) -> the ledger columns, docs = 1; whole texts, a slice of a batch at a time. carry: text columns that come along."""
    version = os.path.basename(path)
    more = [f"carried_{k}" for k in range(len(carry))]

    def each(batches):
        import pyarrow as pa

        enc = load_tokenizer(path)
        for batch in batches:
            done = 0
            for ids, texts in text_slices([batch]):
                n = len(ids)
                tokens = [len(enc.encode_ordinary(t)) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), batch.column(2).slice(done, n), batch.column(3).slice(done, n), pa.array([version] * n), pa.array([1] * n, pa.int64()), pa.array(tokens, pa.int64()), pa.array([len(t) for t in texts], pa.int64())]
                    + [batch.column(4 + k).slice(done, n) for k in range(len(more))],
                    ["doc_id", "source", "lang", "tokenizer", "docs", "tokens", "chars", *more],
                )
                done += n

    named = [F.col(c).cast("string").alias(m) for c, m in zip(carry, more, strict=True)]
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")), *named)
    return rows.mapInArrow(each, ", ".join([LEDGER, *(f"{m} string" for m in more)])).withColumnsRenamed(dict(zip(more, carry, strict=True)))


SUMS = ("docs", "tokens", "chars")
GROUP = ("source", "lang", "tokenizer")


class Rollup:
    """Token totals kept under a path that the driver and all executors share."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: str = TOKENIZER_PATH):
        self.spark, self.path, self.tokenizer = spark, path.rstrip("/"), tokenizer
        self._hadoop = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()  # noqa: SLF001
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _log(self) -> list[dict]:
        """The entries of the log, in order; one small file a commit, none of them ever changed."""
        if not self._fs.exists(self._at("log")):
            return []
        names = sorted(n for s in self._fs.listStatus(self._at("log")) if (n := s.getPath().getName()).isdigit())
        out = []
        for n in names:
            stream = self._fs.open(self._at("log", n))
            try:
                out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))  # noqa: SLF001
            finally:
                stream.close()
        return out

    def _claim(self, number: int, entry: dict) -> bool:
        """Puts the entry at this place of the log, unless one is there."""
        self._fs.mkdirs(self._at("log"))
        written = self._at(f"claim-{uuid.uuid4().hex}")
        stream = self._fs.create(written, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        context = self._hadoop.FileContext.getFileContext(written.toUri(), self._conf)
        keep = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)  # noqa: SLF001
        keep[0] = self._hadoop.Options.Rename.NONE
        try:
            context.rename(self._fs.makeQualified(written), self._fs.makeQualified(self._at("log", f"{number:020d}")), keep)
        except Py4JJavaError as e:
            self._fs.delete(written, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        return sorted(e["batch"] for e in self._log() if "batch" in e)

    def _read(self, kind: str, log: list[dict]) -> DataFrame | None:
        """The ledgers or deltas that count: those of the last compaction and of the batches after it."""
        last = max((k for k, e in enumerate(log) if "batch" not in e), default=0)
        paths = [f"{self.path}/data/{e['folder']}/{kind}" for e in log[last:]]
        return self.spark.read.schema(LEDGER).parquet(*paths) if paths else None

    def _write(self, ledger: DataFrame) -> str:
        """The data folder of a ledger and its delta."""
        folder = uuid.uuid4().hex
        ledger.write.option("compression", "zstd").parquet(f"{self.path}/data/{folder}/ledger")
        written = self.spark.read.schema(LEDGER).parquet(f"{self.path}/data/{folder}/ledger")
        delta = written.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))
        delta.select(F.lit(None).cast("long").alias("doc_id"), *GROUP, *SUMS).write.parquet(f"{self.path}/data/{folder}/delta")
        return folder

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch of changes once. False if the batch was committed before: nothing is done then."""
        if batch in self.batches():
            return False
        op = F.lower(F.trim("op"))
        known = F.when(op.isin("insert", "delete", "revise"), op).otherwise(F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))))
        rows = changes.select("doc_id", known.alias("op"), "source", "lang", F.when(known != "delete", F.col("text")).alias("text"))
        rows = stash(count_tokens(rows, self.tokenizer, ("op",)), "counted")
        counted = rows.where("op <> 'delete'").drop("op")
        gone = rows.where("op <> 'insert' and doc_id is not null").select("doc_id").distinct()
        takes = not gone.isEmpty()
        try:
            while True:
                log = self._log()
                if any(e.get("batch") == batch for e in log):
                    return False  # another writer committed it
                ledger = counted
                if takes and (old := self._read("ledger", log)) is not None:
                    taken = old.join(gone, "doc_id", "left_semi").groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0 or tokens <> 0")
                    ledger = ledger.unionByName(taken.select("doc_id", *GROUP, *((-F.col(c)).alias(c) for c in SUMS)))
                folder = self._write(ledger)
                if self._claim(len(log) + 1, {"batch": batch, "folder": folder}):
                    return True
                self._fs.delete(self._at("data", folder), True)
        finally:
            drop_stash(rows)

    def compact(self) -> bool:
        """Replaces all ledgers and deltas so far by their net, in one folder. False if another writer was first: nothing is changed then."""
        log = self._log()
        if (old := self._read("ledger", log)) is None:
            return False
        net = old.groupBy("doc_id", *GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0 or tokens <> 0 or chars <> 0")
        folder = self._write(net)
        if self._claim(len(log) + 1, {"folder": folder}):
            return True
        self._fs.delete(self._at("data", folder), True)
        return False

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, chars of all committed batches; groups that are down to nothing are left out."""
        deltas = self._read("delta", self._log())
        if deltas is None:
            return self.spark.createDataFrame([], LEDGER).drop("doc_id")
        return deltas.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS)).where("docs <> 0 or tokens <> 0 or chars <> 0")
