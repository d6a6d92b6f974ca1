"""Readers of plain files: text by lines, JSON registries, media probes and PCM audio.

All go through Spark's own file readers, so any store that Spark reads will do. Each file is one row at
first: files must fit a task (Spark's bound is 2 GB), their number need not be bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = (
    "struct<compensate:double,mdx_dim_f_set:int,mdx_dim_t_set:int,mdx_n_fft_scale_set:int,primary_stem:string,"
    "is_karaoke:boolean,config_yaml:string,is_roformer:boolean,model_type:string>"
)
PROBE = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,channels:int,sample_rate:string>>>"
AUDIO = "path string, channel int, rate int, first long, samples array<float>"


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, line (from 0, blank lines counted), text of every line with something in it; a leading byte order mark goes."""
    text = F.regexp_replace(F.regexp_replace("value", "^\ufeff", ""), "\r\n?", "\n")
    lines = _whole(spark, path).select("path", F.posexplode(F.split(text, "\n")).alias("line", "text"))
    return lines.withColumn("text", F.trim("text")).where("text <> ''")


def read_registry(spark: SparkSession, path: str | list[str], entry: str = REGISTRY) -> DataFrame:
    """md5 and the fields of every entry of JSON files that map keys to records; a file that is no such map gives no rows."""
    found = _whole(spark, path).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("md5", "e"))
    return found.select("md5", "e.*")


def read_probes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, duration (seconds), n_audio and, by audio stream, channels and sample rates; null where a probe does not say."""
    p = _whole(spark, path).select("path", F.from_json("value", PROBE).alias("p"))
    audio = F.filter("p.streams", lambda s: s.codec_type == "audio")
    return p.select(
        "path",
        F.expr("try_cast(p.format.duration as double)").alias("duration"),
        F.when(F.col("p.streams").isNotNull(), F.size(audio)).alias("n_audio"),
        F.transform(audio, lambda s: s.channels).alias("channels"),
        F.transform(audio, lambda s: s.sample_rate.try_cast("int")).alias("rates"),
    )


def _convert(x, channels: int | None):
    """Channels of x (channel, sample): mean for one, copies of a single one, else the first so many."""
    import numpy as np

    if channels is None or channels == len(x):
        return x
    if channels == 1:
        return x.mean(0, keepdims=True)
    if len(x) == 1:
        return np.repeat(x, channels, 0)
    if channels < len(x):
        return x[:channels]
    raise ValueError(f"{len(x)} channels do not make {channels}")


def decode_wav(raw: bytes, start: float = 0.0, duration: float | None = None, channels: int | None = None, chunk: int = 1 << 16) -> Iterator[tuple[int, int, int, object]]:
    """(channel, rate, first sample, samples in -1 to 1) of the range asked for, at most chunk samples at a time."""
    import io
    import wave

    import numpy as np

    with wave.open(io.BytesIO(raw)) as w:
        n, width, rate, total = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
        at = min(total, max(0, int(start * rate)))
        stop = total if duration is None else min(total, at + int(duration * rate))
        w.setpos(at)
        while at < stop:
            data = np.frombuffer(w.readframes(min(chunk, stop - at)), np.uint8).reshape(-1, n, width)
            if not len(data):
                return
            if width == 1:
                x = data[:, :, 0].astype(np.float32) / 128 - 1
            else:  # left-aligned in 32 bits, so that the sign is right for 16, 24 and 32 bits
                wide = np.zeros((*data.shape[:2], 4), np.uint8)
                wide[:, :, 4 - width :] = data
                x = wide.view("<i4")[:, :, 0].astype(np.float64) / 2**31
            for c, row in enumerate(_convert(x.T, channels)):
                yield c, rate, at, row.astype(np.float32)
            at += len(data)


def _at_rate(found: Iterator[tuple[int, int, int, object]], rate: int | None, chunk: int) -> Iterator[tuple[int, int, int, object]]:
    """Decoded chunks at the rate asked for."""
    import numpy as np

    from quillfern.functions.signal import resample

    held: dict[int, list] = {}
    for c, own, first, x in found:
        if rate is None or own == rate:
            yield c, own, first, x
        else:
            held.setdefault(c, []).append((own, first, x))
    for c, parts in held.items():
        own, first = parts[0][:2]
        y = resample(np.concatenate([p[2] for p in parts]), own, rate).astype(np.float32)
        for k in range(0, len(y), chunk):
            yield c, rate, first * rate // own + k, y[k : k + chunk]


def read_wav(spark: SparkSession, path: str | list[str], start: float = 0.0, duration: float | None = None, channels: int | None = None, chunk: int = 1 << 16, rate: int | None = None) -> DataFrame:
    """path, channel, rate, first (sample number) and samples of PCM files, in chunks; only the range of seconds asked for is decoded.

    rate: the samples' rate; the file's own if none is given. At another rate, the range is resampled as a whole and first counts its samples.
    A file that is not PCM raises.
    """

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for c, own, first, x in _at_rate(decode_wav(raw.as_py(), start, duration, channels, chunk), rate, chunk):
                    values = pa.array([x], pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([c], pa.int32()), pa.array([own], pa.int32()), pa.array([first], pa.int64()), values], ["path", "channel", "rate", "first", "samples"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(each, AUDIO)
