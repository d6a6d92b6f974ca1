"""Writers of plain files: one folder with one text file per key, its lines in order.

Lines are dealt by key and sorted on disk if need be, never collected into one cell, so a file may be larger than a
task's memory. Files are written by Spark's own committer: lost tasks leave nothing behind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The two subtitle styles and the column lists of the format.
STYLES = (
    "Style: Lat_Duet,Montserrat Bold,120,&H0000A5FF&,&H00FFFFFF&,&H00000000,&H80000000,-1,0,0,0,100,100,0,0,1,3,1,2,10,10,60,1",
    "Style: CJK_Duet,Noto Sans CJK SC,120,&H0000A5FF&,&H00FFFFFF&,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,3,1,2,10,10,60,1",
)
STYLE_COLUMNS = "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
EVENT_COLUMNS = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def subtitle_header(title: str, width: int = 1920, height: int = 1080) -> list[str]:
    script = ["[Script Info]", f"Title: {title}", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "ScaledBorderAndShadow: yes"]
    return [*script, "[V4+ Styles]", STYLE_COLUMNS, *STYLES, "[Events]", EVENT_COLUMNS]


def write_lines(lines: DataFrame, path: str, keys: list[str], order: list[str], line: str) -> None:
    """path/key=value/part-*.txt for each combination of keys; null lines are left out."""
    rows = lines.where(F.col(line).isNotNull()).repartition(*keys).sortWithinPartitions(*keys, *order)
    # The sort by keys is the one that the writer needs, so it adds none and the order within a key stays.
    rows.select(*keys, F.col(line).alias("value")).write.mode("errorifexists").partitionBy(*keys).text(path)


def write_subtitles(events: DataFrame, path: str, keys: list[str], order: list[str], event: str = "event", title: str = "Karaoke") -> None:
    """A subtitle file per key: byte order mark, header, events in order. Keys without events have no file."""
    head = "\ufeff" + "\n".join(subtitle_header(title))
    known = events.where(F.col(event).isNotNull())
    headers = known.select(*keys).distinct().select(*keys, F.lit(0).alias("__part"), *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in order), F.lit(head).alias("__line"))
    body = known.select(*keys, F.lit(1).alias("__part"), *order, F.col(event).alias("__line"))
    write_lines(headers.unionByName(body), path, keys, ["__part", *order], "__line")


def legacy_events(lines: DataFrame) -> DataFrame:
    """The event lines of the older format from (shown, hidden, lead, body); other columns stay."""
    return lines.withColumn("event", F.concat(F.lit("Dialogue: 0,"), "shown", F.lit(","), "hidden", F.lit(","), "lead", "body")).drop("shown", "hidden", "lead", "body")


def stem_name(stem: str, title: Column, shifts: int, overlap: float, segment: int) -> Column:
    """The file name of a separated stem, which says how it was made."""
    from quillfern.functions.text import safe_title

    return F.concat(F.lit(f"[S:{shifts},O:{overlap},SZ:{segment}]_{stem}_"), safe_title(title), F.lit(".wav"))


def encode_wav(samples, rate: int) -> bytes:
    """A PCM file of 16 bits from (channel, sample) values in -1 to 1; what lies outside is cut off."""
    import io
    import wave

    import numpy as np

    x = np.clip(np.round(np.asarray(samples, float) * 32767), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(x))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(x.T.tobytes())
    return out.getvalue()


def wav_files(chunks: DataFrame, name: str = "name") -> DataFrame:
    """(name, content): a PCM file for each name, from chunks of samples (name, channel, rate, first, samples). A file's samples must fit a task, as they must for its reader."""
    import numpy as np
    import pandas as pd

    def each(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["channel", "first"], kind="stable")
        rows = [np.concatenate(part["samples"].tolist()) for _, part in d.groupby("channel")]
        return pd.DataFrame({"name": [key[0]], "content": [encode_wav(np.stack(rows), int(d["rate"].iloc[0]))]})

    return chunks.select(F.col(name).alias("name"), "channel", "rate", "first", "samples").groupBy("name").applyInPandas(each, "name string, content binary")


def write_wavs(chunks: DataFrame, path: str, name: str = "name") -> None:
    """A table of PCM files (name, content) under path, written by Spark's own committer: one row a file."""
    wav_files(chunks, name).write.mode("errorifexists").parquet(path)


def write_sidecars(tracks: DataFrame, path: str, artist: str = "artist", title: str = "title", duration: str = "duration", filename: str = "filename", lyrics: str = "lyrics") -> None:
    """A Markdown file per artist and title in a safe spelling; of several records of one name each is written after the other."""
    from quillfern.functions.text import safe_title

    said = F.coalesce(F.nullif(F.col(lyrics), F.lit("")), F.lit("No lyrics available for this track."))
    name = F.coalesce(F.col(filename), F.lit(""))
    # The headings and field names of the file.
    text = F.concat(
        F.lit("## Metadata\n* **Title:** "), F.coalesce(F.col(title), F.lit("unknown")), F.lit("\n* **Artist:** "), F.coalesce(F.col(artist), F.lit("Unknown")),
        F.lit("\n* **Duration:** "), F.coalesce(F.col(duration), F.lit(0)).cast("string"), F.lit(" seconds\n\n## Local File\n* **Filename:** ["), name, F.lit("](./"), name, F.lit(")\n\n## Lyrics\n"), said,
    )
    rows = tracks.select(F.coalesce(F.col(artist), F.lit("Unknown")).alias("by"), safe_title(F.coalesce(F.col(title), F.lit("unknown"))).alias("name"), name.alias("__file"), text.alias("__text"))
    write_lines(rows, path, ["by", "name"], ["__file", "__text"], "__text")
