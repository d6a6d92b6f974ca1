"""Signal features against their definitions, PCM files in both directions, retries and seams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillfern.functions import signal as S
from quillfern.operators import seams
from quillfern.sinks import files as sinks
from quillfern.sources import files as sources

RATE = 16000


def tone(hz, seconds=0.5, rate=RATE):
    return np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def test_mel_scale_and_filters():
    assert np.allclose(S.mel_of([0, 200, 1000, 6400]), [0, 3, 15, 42]) and np.allclose(S.hz_of(S.mel_of([10, 999, 1001, 7000])), [10, 999, 1001, 7000])
    f = S.mel_filters(RATE, 1024, 40)
    assert f.shape == (40, 513) and (f >= 0).all()
    m = S.mel_power(tone(1000), RATE, 1024, 256, 40)
    centre = S.hz_of(np.linspace(0, S.mel_of(RATE / 2), 42))[1:-1]
    assert abs(centre[m[:, 10].argmax()] - 1000) < 100
    assert S.decibels(np.array([1.0, 0.1, 0.0])).tolist() == [0.0, -10.0, -80.0]


def test_harmonic_and_percussive_parts():
    click = np.zeros(8000)
    click[4000] = 50
    harmonic, percussive = S.harmonic_percussive(np.abs(S.spectrum(tone(1000) + click, 512, 128)))
    at, frame = 1000 * 512 // RATE, 4000 // 128
    assert harmonic[at, 10] > 10 * percussive[at, 10] and percussive[200, frame] > 10 * harmonic[200, frame]


@pytest.mark.parametrize("hz", [98.0, 220.0, 440.0, 1046.5])
def test_fundamental_and_pitch_class(hz):
    x = tone(hz) + 0.4 * tone(2 * hz) + 0.2 * tone(3 * hz)
    assert S.fundamental(x[:2048], RATE, 65, 2100) == pytest.approx(hz, rel=0.01)
    power = np.abs(S.spectrum(tone(hz), 8192, 1024)) ** 2
    assert S.chroma(power, RATE, 8192)[:, 4].argmax() == round(69 + 12 * np.log2(hz / 440)) % 12
    assert np.isnan(S.fundamental(np.random.default_rng(0).normal(size=2048), RATE, 65, 2100))


@pytest.mark.parametrize("new", [8000, 44100, 16000, 22050])
def test_resampling_keeps_tones(new):
    got = S.resample(tone(500), RATE, new)
    want = tone(500, 0.5, new)
    assert len(got) == len(want) and np.abs(got - want)[200:-200].max() < 2e-3
    assert np.allclose(S.resample(np.full(500, 0.3), RATE, new), 0.3)
    assert new != 8000 or np.abs(S.resample(tone(6000), RATE, new))[200:-200].max() < 2e-3


def test_pcm_files_there_and_back(spark, tmp_path):
    x = np.stack((tone(300, 0.1), tone(700, 0.1)))
    chunks = [("a.wav", c, RATE, k, x[c, k : k + 500].tolist()) for c in range(2) for k in range(0, 1600, 500)]
    df = spark.createDataFrame(chunks, "name string, channel int, rate int, first long, samples array<float>")
    sinks.write_wavs(df, f"{tmp_path}/w")
    (tmp_path / "f").mkdir()
    row = spark.read.parquet(f"{tmp_path}/w").first()
    (tmp_path / "f" / row.name).write_bytes(row.content)
    back = {(r.channel, r.first): r.samples for r in sources.read_wav(spark, f"{tmp_path}/f", chunk=800).collect()}
    assert sorted(back) == [(0, 0), (0, 800), (1, 0), (1, 800)] and np.allclose(back[1, 800], x[1, 800:1600], atol=1e-4)
    half = sources.read_wav(spark, f"{tmp_path}/f", rate=8000, channels=1).collect()
    assert [(r.rate, len(r.samples)) for r in half] == [(8000, 800)]
    assert np.allclose(half[0].samples[100:-100], S.resample(x.mean(0), RATE, 8000)[100:-100], atol=1e-3)
    name = spark.range(1).select(sinks.stem_name("vocs", F.lit("A/B: c?"), 1, 0.75, 200)).first()[0]
    assert name == "[S:1,O:0.75,SZ:200]_vocs_AB c.wav"


def test_legacy_events_and_seams(spark):
    df = spark.createDataFrame([(1, "0:00:01.00", "0:00:02.00", "Lat_Duet,,20,20,50,,{\\fad(300,200)}{\\an2}", "{\\kf10}a ")], "k int, shown string, hidden string, lead string, body string")
    assert tuple(sinks.legacy_events(df).first()) == (1, "Dialogue: 0,0:00:01.00,0:00:02.00,Lat_Duet,,20,20,50,,{\\fad(300,200)}{\\an2}{\\kf10}a ")
    with pytest.raises(ValueError, match="no recogniser"):
        seams.run(df, "separator", "x") if ("separator", "x") in seams.MODELS else seams.run(df, "recogniser", "none")
    with pytest.raises(ValueError, match="twice"):
        seams.register("aligner", "even")(seams.even)
    with pytest.raises(ValueError, match="unknown kind"):
        seams.register("painter", "x")
