import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfern.sinks import files as K
from quillfern.sources import files as R
from quillfern.streaming.progress import advance, progress
from quillfern.streaming.sessions import read_stream, sessions


def test_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\ufefffirst\r\n\r\n  third  \n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    assert [(r.line, r.text) for r in R.read_lines(spark, str(tmp_path)).orderBy("line").collect()] == [(0, "first"), (2, "third")]


def test_registry_and_probes(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"k1": {"compensate": 1.5, "primary_stem": "Vocals", "is_karaoke": True}, "k2": {"model_type": "x"}}, indent=1))
    got = {r.md5: r for r in R.read_registry(spark, str(tmp_path / "r.json")).collect()}
    assert got["k1"].compensate == 1.5 and got["k1"].is_karaoke and got["k2"].model_type == "x" and got["k2"].compensate is None
    (tmp_path / "p.json").write_text(json.dumps({"format": {"duration": "12.5"}, "streams": [{"codec_type": "video"}, {"codec_type": "audio", "channels": 2, "sample_rate": "44100"}]}))
    (tmp_path / "q.json").write_text("{}")
    p, q = R.read_probes(spark, [str(tmp_path / "p.json"), str(tmp_path / "q.json")]).orderBy("path").collect()
    assert (p.duration, p.n_audio, p.channels, p.rates) == (12.5, 1, [2], [44100])
    assert q.duration is None and q.n_audio is None


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_ranges_and_channels(spark, tmp_path, width):
    left = np.linspace(-0.9, 0.9, 1000)
    both = np.stack([left, -left], 1)
    with wave.open(str(tmp_path / "x.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(width), w.setframerate(100)
        if width == 1:
            w.writeframes(np.round(both * 127 + 128).astype(np.uint8).tobytes())
        else:
            w.writeframes(b"".join(struct.pack("<i", int(v * (2 ** (8 * width - 1) - 1)))[:width] for v in both.ravel()))
    rows = R.read_wav(spark, str(tmp_path / "x.wav"), 2.0, 3.0, chunk=128).orderBy("channel", "first").collect()
    assert {r.rate for r in rows} == {100} and [r.first for r in rows if r.channel == 1] == [200, 328, 456]
    for c, sign in ((0, 1), (1, -1)):
        x = np.concatenate([r.samples for r in rows if r.channel == c])
        assert len(x) == 300 and np.allclose(x, sign * left[200:500], atol=0.02)
    mono = R.read_wav(spark, str(tmp_path / "x.wav"), channels=1).collect()
    assert np.allclose(np.concatenate([r.samples for r in mono]), 0, atol=0.02)
    assert R.read_wav(spark, str(tmp_path / "x.wav"), start=99.0).count() == 0


def test_subtitles_are_written_in_order(spark, tmp_path):
    rows = [(k, i, f"Dialogue: {k}-{i}") for i in range(40, -1, -1) for k in (1, 2)] + [(3, 0, None)]
    K.write_subtitles(spark.createDataFrame(rows, "song int, i int, event string").repartition(7), str(tmp_path / "out"), ["song"], ["i"], title="T")
    for k in (1, 2):
        (file,) = (tmp_path / "out" / f"song={k}").glob("part-*.txt")
        text = file.read_text(encoding="utf-8-sig")
        assert file.read_bytes().startswith(b"\xef\xbb\xbf[Script Info]\nTitle: T\n")
        assert text.splitlines() == [*K.subtitle_header("T"), *(f"Dialogue: {k}-{i}" for i in range(41))]
    assert not (tmp_path / "out" / "song=3").exists()


def test_sidecars(spark, tmp_path):
    rows = [("A", "My: Song!", 12, "f.mp4", None), (None, None, None, None, "la")]
    K.write_sidecars(spark.createDataFrame(rows, "artist string, title string, duration int, filename string, lyrics string"), str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "by=A" / "name=My Song").glob("part-*.txt")
    assert file.read_text() == "## Metadata\n* **Title:** My: Song!\n* **Artist:** A\n* **Duration:** 12 seconds\n\n## Local File\n* **Filename:** [f.mp4](./f.mp4)\n\n## Lyrics\nNo lyrics available for this track.\n"
    (file,) = (tmp_path / "out" / "by=Unknown" / "name=unknown").glob("part-*.txt")
    assert file.read_text().endswith("## Lyrics\nla\n")


def test_status_machine():
    assert advance(0, False, [(2, 50, False), (1, 20, False), (3, 40, False), (4, 90, True), (5, 99, False)]) == (90, True, [("downloading", 20, 20), ("downloading", 50, 30), ("finished", 90, 40)])
    assert advance(90, True, [(9, 95, False)]) == (90, True, [])


def test_progress_and_sessions_agree_on_streams(spark, sf_dir, tmp_path):
    batches = [[("a", 1, 10, False), ("b", 1, 5, False)], [("a", 2, 30, False), ("a", 3, 30, False)], [("a", 4, 30, True), ("b", 2, 9, False), ("a", 5, 99, False)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "id string, n int, bytes long, last boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    whole = spark.read.parquet(str(tmp_path / "in/*"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = progress(stream, "id", "n", "bytes", "last").writeStream.format("memory").queryName("reports").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = sorted(map(tuple, progress(whole, "id", "n", "bytes", "last").collect()))
    assert sorted(map(tuple, spark.table("reports").collect())) == want
    assert want == [("a", "downloading", 10, 10), ("a", "downloading", 30, 20), ("a", "finished", 30, 0), ("b", "downloading", 5, 5), ("b", "downloading", 9, 4)]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("user_id") < 20)
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    q = sessions(read_stream(spark, str(tmp_path / "events"))).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    want = {tuple(r) for r in sessions(events).collect()}
    got = {tuple(r) for r in spark.table("found").collect()}
    assert got and got <= want  # those within the watermark of the end are still open
