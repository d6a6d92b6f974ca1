import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillfern.functions import phonetic as P
from quillfern.functions import text as T
from quillfern.operators import grouped as G
from quillfern.operators import series as S


def frames(spark, flags):
    return spark.createDataFrame([(1, i, bool(x)) for i, x in enumerate(flags)], "k int, i int, active boolean")


def test_gaps_merge_and_short_runs_drop(spark):
    runs = S.islands(frames(spark, [0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 0]), "k", "i", "active")
    assert [(r.start, r.stop) for r in S.merge_and_drop(runs, "k", 2, 0).orderBy("seg").collect()] == [(1, 6), (9, 10)]
    runs = S.islands(frames(spark, [0, 1, 0, 1, 1, 0]), "k", "i", "active")
    assert [(r.start, r.stop) for r in S.merge_and_drop(runs, "k", 0, 1).collect()] == [(3, 5)]


def test_onset_look_ahead_and_stretch(spark):
    df = frames(spark, [0, 0, 0, 1, 1]).withColumn("on", F.col("i") == 1)
    assert [r.filled for r in S.lookahead_fill(df, "k", "i", "active", "on", 3).orderBy("i").collect()] == [False, True, True, True, True]
    df = frames(spark, [1, 1, 1, 0, 0, 0, 0]).withColumn("v", F.col("i") == 5)
    assert [r.stretched for r in S.forward_stretch(df, "k", "i", "active", "v", 10).orderBy("i").collect()] == [True] * 5 + [False] * 2


def test_interior_gaps_divide_evenly(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, None, None), (1, 2, None, None), (1, 3, 2.0, 3.0)], "k int, i int, s double, e double")
    got = [(r.start_filled, r.end_filled) for r in S.interpolate_gaps(df, "k", "i", "s", "e").orderBy("i").collect()]
    assert got == [(0.0, 1.0), (1.0, 1.5), (1.5, 2.0), (2.0, 3.0)]


def test_range_ids(spark):
    df = spark.createDataFrame([(1, 0, [0]), (1, 1, None), (1, 2, []), (1, 3, [3])], "k int, i int, ids array<int>")
    assert [r.ids_filled for r in S.range_fill(df, "k", "i", "ids", F.lit(3)).orderBy("i").collect()] == [[0], [0, 1, 2, 3], [0, 1, 2, 3], [3]]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_moving_average_mirrors_the_ends(spark, n):
    x = [3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(x)], "k int, i int, v double")
    padded = np.concatenate((x[: n // 2][::-1], x, x[len(x) - (n - n // 2 - 1) :][::-1]))
    want = [padded[i : i + n].mean() for i in range(len(x))]
    assert np.allclose([r.smoothed for r in S.moving_average(df, "k", "i", "v", n).orderBy("i").collect()], want)


def test_text_rules(spark):
    r = spark.range(1).select(
        T.normalize_title(F.lit("Artist - Song (Official Video) // Übersetzung")).alias("title"),
        T.classify(F.lit("HTTP Error 403: Forbidden")).alias("a"),
        T.classify(F.lit("xyz")).alias("b"),
        T.classify(F.lit("sign in to confirm … rate limit")).alias("c"),
        T.ass_time(F.lit(6550)).alias("t"),
        T.hms(F.lit(65.5)).alias("h"),
        T.hms(F.lit(None).cast("double")).alias("n"),
        *(T.backoff(F.lit("RATE_LIMIT"), F.lit(k), 2.0).alias(f"w{k}") for k in (1, 3, 6)),
    ).first()
    assert tuple(r) == ("Artist - Song", "HTTP_403", "UNKNOWN", "AUTH", "0:01:5.50", "01:05.50", "--:--.--", 2.0, 8.0, 60.0)


def test_clusters_look_at_the_current_one_alone():
    assert G.cluster_lines([{0}, {0, 1}, {2}, {1}]) == [0, 0, 1, 2]


def test_alignment_of_a_mismatch():
    ops = [s[0] for s in G.align_tokens(["aaa", "kkk", "rrr"], ["aaa", "zzzz", "rrr", "mm"])]
    assert sorted(ops) == sorted(["M", "D", "I", "M", "I"])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("one two three tree won".split()), max_size=8), st.lists(st.sampled_from("one two three tree won".split()), max_size=8))
def test_alignment_keeps_all_tokens(ref, hyp):
    steps = G.align_tokens(ref, hyp)
    assert [s[1] for s in steps if s[1] is not None] == list(range(len(ref)))
    assert [s[2] for s in steps if s[2] is not None] == list(range(len(hyp)))
    assert all(ref[s[1]] == hyp[s[2]] for s in steps if s[0] == "M")


def test_repair_keeps_deleted_words():
    assert G.repaired("a b c d".split(), "a x c".split()) == "a x c d".split()


def test_valleys_and_prominence():
    x = np.array([0, 2, 1, 3, 3, 0, 5, 0.0])
    at = G.peaks(x)
    assert at.tolist() == [1, 3, 6]
    assert G.prominences(x, at).tolist() == [1, 3, 5]


def test_blocks_split_in_quiet_stretches_only():
    active, flux = np.ones(40, bool), np.ones(40, bool)
    flux[18:24] = False
    out = G.split_blocks(active, flux, np.zeros(40), np.array([20]), 20, 5, 3, 2, 1)
    assert (~out).sum() == 1 and not out[18:24].all()
    assert G.split_blocks(active, np.ones(40, bool), np.zeros(40), np.array([20]), 20, 5, 3, 2, 1).all()


def test_bandpass_is_a_butterworth_filter():
    rate, low, high, order = 16000, 200.0, 5000.0, 10
    f = np.array([50, 150, 200, 300, 1000, 3000, 4500, 5000, 5500, 7000.0])
    z = np.exp(-2j * np.pi * f / rate)
    got = np.prod([g * (1 - z**2) / (1 + a1 * z + a2 * z**2) for g, a1, a2 in G.bandpass_sections(low, high, rate, order)], axis=0)
    w1, w2, w = (np.tan(np.pi * x / rate) for x in (low, high, f))
    want = 1 / np.sqrt(1 + ((w**2 - w1 * w2) / (w * (w2 - w1))) ** (2 * order))
    assert len(G.bandpass_sections(low, high, rate, order)) == order and np.allclose(np.abs(got), want, rtol=1e-6)
    assert np.allclose(20 * np.log10(np.abs(got[[2, 7]])), -3.0103, atol=1e-3)
    x = np.random.default_rng(0).normal(size=1000)
    for section in G.bandpass_sections(low, high, rate, order):
        assert np.allclose(G.run_section(x, *section), G.run_section(x, *section, short=0), atol=1e-9)


def test_prominences_as_by_definition():
    rng = np.random.default_rng(1)
    for n in (3, 10, 200):
        x = rng.integers(0, 12, n).astype(float)
        at = G.peaks(x)
        for p, got in zip(at, G.prominences(x, at), strict=True):
            a = max((j for j in range(p) if x[j] > x[p]), default=-1) + 1
            b = min((j for j in range(p + 1, n) if x[j] > x[p]), default=n)
            assert got == x[p] - max(x[a : p + 1].min(), x[p:b].min())


def test_gap_width_counts_to_the_frames_with_flux():
    flux = np.ones(40, bool)
    flux[19:22] = False  # three quiet frames lie between frames with flux that are four apart
    cut = lambda least: (~G.split_blocks(np.ones(40, bool), flux, np.zeros(40), np.array([20]), 20, 5, 3, least, 1)).sum()
    assert (cut(4), cut(5)) == (1, 0)


def test_alignment_scores_as_by_brute_force():
    from functools import lru_cache

    rng = np.random.default_rng(2)
    words = "knight night nite won one two too kite".split()
    pair = lambda a, b: 2 if a == b else 1 if P.jaro_winkler_similarity(P.metaphone(a), P.metaphone(b)) >= 0.5 or P.sequence_ratio(a, b) >= 0.6 else -3
    for _ in range(30):
        ref, hyp = ([words[k] for k in rng.integers(0, len(words), rng.integers(0, 7))] for _ in range(2))

        @lru_cache(None)
        def best(i, j):
            if not i or not j:
                return -(i + j)
            return max(best(i - 1, j - 1) + pair(ref[i - 1], hyp[j - 1]), best(i - 1, j) - 1, best(i, j - 1) - 1)  # noqa: B023

        got = sum(-1 if op in "DI" else pair(ref[i], hyp[j]) for op, i, j in G.align_tokens(ref, hyp))
        assert got == best(len(ref), len(hyp))


def test_sound_codes():
    assert [P.metaphone(w) for w in ("knight", "phone", "thumb", "school", "")] == ["NT", "FN", "0M", "SKL", ""]
    assert round(P.jaro_winkler_similarity("martha", "marhta"), 4) == 0.9611
    assert P.jaro_winkler_similarity("", "a") == 0.0


def test_edge_words_share_the_room():
    lines, ids = G.fill_edges([[None, None, (2.0, 3.0)]], [[0]], [(0.0, 3.0)])
    assert lines[0] == [(0.0, 1.0), (1.0, 2.0), (2.0, 3.0)] and ids == [[0]]


def test_session_stream(spark, sf_dir, tmp_path):
    from quillfern.streaming.sessions import read_stream, sessions

    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in"))
    q = sessions(read_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("sess").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sess").columns == ["user_id", "start_us", "end_us", "n"]


def test_word_spans_of_long_lines(spark):
    """A line of 3,000 words within a minute, and words that are null, empty or beyond the spans."""
    import threading

    from quillfern.functions import media as M

    long = [f"w{k}" * (1 + k % 3) for k in range(3000)]
    lines = [(1, long, len("".join(long))), (2, ["ab", None, "", "cde", "f"], 5), (3, [], 0), (4, None, 2), (5, ["", ""], 0)]
    df = spark.createDataFrame([(i, w, [(2 * k, 2 * k + 1, 1.0 / (1 + k % 7)) for k in range(n)]) for i, w, n in lines], "i int, words array<string>, spans array<struct<start:int,end:int,score:double>>")
    spark.sparkContext.setJobGroup("word_spans", "word_spans", True)
    stop = threading.Timer(60, lambda: spark.sparkContext.cancelJobGroup("word_spans"))
    stop.start()
    try:
        got = {r.i: r.s for r in df.select("i", M.word_spans(F.col("words"), F.col("spans"), 320, 16000).alias("s")).collect()}
    finally:
        stop.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for i, words, n in lines:
        want, a = [], 0
        for k, w in enumerate(words or []):
            own = range(a, min(n, a + len(w or "")))
            a += len(w or "")
            if own:
                want.append((k, 640 * own[0] / 16000, 320 * (2 * own[-1] + 1) / 16000, pytest.approx(sum(1.0 / (1 + c % 7) for c in own) / len(own))))
        assert (got[i] is None and words is None) or [tuple(x) for x in got[i]] == want


def test_pairs_of_one_large_group_are_the_work_of_many_tasks(spark):
    from quillfern.operators import intervals as I

    rows = [("a", k, k % 3 != 0) for k in range(300)] + [("b", 5, True), ("b", 5, True), ("b", 6, None), (None, 1, True), (None, 2, True), ("c", None, True), ("c", 7, True), ("c", 8, True), ("d", 9, True)]
    df = spark.createDataFrame(rows, "k string, v long, r boolean")
    got = I.pairs_within(df, ["k"], "v", "w", right=F.col("r"), block=16, task_pairs=5000)
    want = [(x, y) for a, x, _ in rows for b, y, r in rows if a is not None and a == b and x is not None and y is not None and x != y and r]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    shares = got.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert len(shares) == 12 and max(shares) < len(want) / 4
    assert I.pairs_within(df.where("k = 'd'"), ["k"], "v", "w").count() == I.pairs_within(df.where("false"), ["k"], "v", "w").count() == 0
