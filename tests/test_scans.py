"""Two-level scans, curves, matching, closing and audio ranges against plain loops, over small buckets."""

import math
import random
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chirpline.operators import curves, gates, matching, scoring, signal
from chirpline.operators import intervals as I
from chirpline.sources import audio, readers

ROWS = "session string, event_id long, t0_us long, t1_us long"


def table(spark, rows, schema=ROWS):
    return spark.createDataFrame(rows, schema)


def drawn(rng, n, span=400, longest=30):
    """Intervals of two lines and of none, points and repeated rows among them."""
    out = []
    for i in range(n):
        a = rng.randrange(-span // 4, span)
        out.append((rng.choice(["a", "b", None]), i, a, a + rng.choice([0, 1, rng.randrange(longest), rng.randrange(4 * longest)])))
    return out


def lines(rows):
    got = {}
    for r in rows:
        got.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[2], r[3], r[1])) for k, v in got.items()}


def plain_events(own, strict=False, gap=0):
    events, reach = [], None
    for _, i, a, b in own:
        if reach is None or (a >= reach + gap if strict else a > reach + gap):
            events.append([])
            reach = None
        events[-1].append((i, a, b))
        reach = b if reach is None else max(reach, b)
    return events


@pytest.mark.parametrize("strict,gap,bucket", [(False, 0, 7), (True, 0, 7), (False, 5, 50), (False, 0, 10**9)])
def test_merging_over_buckets(spark, strict, gap, bucket):
    rows = drawn(random.Random(bucket + gap), 120)
    df = table(spark, rows)
    merged = I.merge_intervals(df, ["session"], strict, gap, bucket_us=bucket).collect()
    tagged = I.tag_merged(df, ["session"], strict, gap, ["event_id"], bucket).collect()
    for key, own in lines(rows).items():
        # reach is over all rows so far, so an event's end never falls
        reach, events = None, []
        for _, i, a, b in own:
            if reach is None or (a >= reach + gap if strict else a > reach + gap):
                events.append([])
            reach = b if reach is None else max(reach, b)
            events[-1].append((i, a, b))
        want = [(n, min(a for _, a, _ in e), max(b for *_, b in e), len(e)) for n, e in enumerate(events)]
        assert sorted((r.event_no, r.t0_us, r.t1_us, r.n_boxes) for r in merged if r.session == key) == want
        assert {r.event_id: r.event_no for r in tagged if r.session == key} == {i: n for n, e in enumerate(events) for i, *_ in e}


@pytest.mark.parametrize("bucket", [3, 40, 10**9])
def test_bouts_and_flags_over_buckets(spark, bucket):
    rng = random.Random(bucket)
    rows, others = drawn(rng, 100), drawn(rng, 60, longest=10)
    got = {r.event_id: (r.bout_id, r.ici_us) for r in I.bouts(table(spark, rows), ["session"], 6, ["event_id"], bucket).collect()}
    for own in lines(rows).values():
        bout = 0
        for k, (_, i, a, b) in enumerate(own):
            bout += k > 0 and a - own[k - 1][3] > 6
            follow = own[k + 1][2] - b if k + 1 < len(own) and own[k + 1][2] - b <= 6 else None
            assert got[i] == (bout, follow)
    hit = {r.event_id: r.hit for r in I.overlap_flag_asof(table(spark, rows), table(spark, others), ["session"], bucket_us=bucket).collect()}
    for s, i, a, b in rows:
        assert hit[i] == any(s == t and c < b and d > a and b > a and d > c for t, _, c, d in others)


@pytest.mark.parametrize("bucket", [1, 5, 1000])
def test_runs_and_windows_over_buckets(spark, bucket):
    rng = random.Random(bucket)
    frames = [(s, i, rng.random() < 0.6) for s in ("a", None) for i in sorted(rng.sample(range(80), 50))]
    for gap in (None, 3):
        got = sorted((str(r.session), r.t0_us, r.t1_us) for r in I.runs(table(spark, frames, "session string, frame long, lit boolean"), ["session"], F.col("lit"), "frame", 1, gap, bucket).collect())
        want = []
        for s in ("a", None):
            own, found = [f for f in frames if f[0] == s], []
            for k, (_, at, on) in enumerate(own):
                end = own[k + 1][1] if k + 1 < len(own) else at
                if on and (not k or not own[k - 1][2]):
                    found.append([at, end])
                elif on:
                    found[-1][1] = end
            joined = []
            for a, b in found:
                if gap is not None and joined and a - joined[-1][1] <= gap:
                    joined[-1][1] = b
                else:
                    joined.append([a, b])
            want += [(str(s), a, b) for a, b in joined if b - a >= 1]
        assert got == sorted(want)
    points = [(s, rng.randrange(100)) for s in ("a", "b", None) for _ in range(30)]
    starts = [(s, w) for s in ("a", None) for w in rng.sample(range(20, 90), 5)]
    got = I.assign_window(table(spark, points, "session string, at long"), table(spark, starts, "session string, w_start_us long"), ["session"], "at", bucket).collect()
    assert len(got) == len(points)
    for r in got:
        own = [w for s, w in starts if s == r.session]
        assert r.w_start_us == (max((w for w in own if w <= r.at), default=min(own)) if own else None)


@pytest.mark.parametrize("bucket", [11, 90, 10**9])
def test_curve_equals_merging_at_each_threshold(spark, bucket):
    rng = random.Random(bucket)
    calls = [(s or "c", i, a, b) for s, i, a, b in drawn(rng, 40)]
    found = [(rng.choice("mn"), s or "c", i, a, b, rng.choice([None, round(rng.random(), 2), 0.5])) for s, i, a, b in drawn(rng, 90)]
    got = curves.pr_curve(table(spark, calls), table(spark, found, "method string, session string, event_id long, t0_us long, t1_us long, score double"), levels=6, bucket_us=bucket).collect()
    meets = lambda a, b, c, d: c < b and d > a and b > a and d > c
    assert len(got) > 6
    for r in got:
        kept = [(s, i, a, b) for m, s, i, a, b, v in found if m == r.method and (r.threshold is None or (v is not None and v >= r.threshold))]
        events = [(k, min(a for _, a, _ in e), max(b for *_, b in e)) for k, own in lines(kept).items() for e in plain_events(own)]
        right = sum(any(s == k and meets(a, b, c, d) for s, _, c, d in calls) for k, a, b in events)
        tp = sum(any(s == t and meets(a, b, c, d) for t, _, c, d in kept) for s, _, a, b in calls)
        assert (r.tp, r.fn, r.pred_tp, r.fp) == (tp, len(calls) - tp, right, len(events) - right)


@pytest.mark.parametrize("bucket", [11, 90, 10**9])
def test_gate_sets_counted_at_once_equal_counting_each(spark, monkeypatch, bucket):
    rng = random.Random(bucket)
    calls, found = table(spark, drawn(rng, 40)), table(spark, drawn(rng, 90) + [("d", 999, 3, 9)])
    v = F.col("event_id")
    keep = [F.lit(True), v % 3 == 0, F.when(v % 2 == 0, v > 40), F.lit(False), v < 15]
    key = lambda r: tuple(map(str, r))
    got = scoring.counts_by_set(calls, found, keep, ["session"], bucket).collect()
    want = [(i, *r) for i, k in enumerate(keep) for r in scoring.counts(calls, found.where(k), ["session"], bucket_us=bucket).collect()]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_selection_copies_no_rows_for_each_gate(spark, monkeypatch):
    def copied(*_):
        raise AssertionError("rows copied for each gate set")

    monkeypatch.setattr(gates, "kept_by", copied)
    rng = random.Random(3)
    steps = gates.selection_steps(table(spark, drawn(rng, 30)), table(spark, drawn(rng, 20)), [("event_id", ">=", 10**6)])
    assert len(steps) == 1 and steps[0][0] is None and steps[0][1] > 0


def test_forward_selection_scores_no_gate_with_the_first_gates(spark, monkeypatch):
    jobs, score = [], gates.strategies
    monkeypatch.setattr(gates, "strategies", lambda det, gt, named: (jobs.append(len(named)), score(det, gt, named))[1])
    calls = [("a", i, 100 * i, 100 * i + 10) for i in range(8)]
    found = [("a", 10 + i, 100 * i + 5, 100 * i + 15) for i in range(6)] + [("a", i, 100 * i + 50, 100 * i + 60) for i in range(6)]
    pool = [("event_id", ">=", x) for x in (5, 10, 12)]
    steps = gates.selection_steps(table(spark, found), table(spark, calls), pool)
    f1 = lambda tp, ok, n: 2 * (tp / 8) * (ok / n) / (tp / 8 + ok / n)
    assert [g for g, _ in steps] == [None, pool[1]] and jobs == [4]
    assert np.allclose([s for _, s in steps], [f1(6, 6, 12), f1(6, 6, 6)])
    assert gates.selection_steps(table(spark, found), table(spark, calls), []) == [(None, steps[0][1])]
    none = table(spark, found).where("false")
    assert gates.selection_steps(none, none, pool) == [(None, 0.0)]


def one_by_one(calls, found):
    pairs = []
    for _, i, a, b in calls:
        for _, j, c, d in found:
            inter = min(b, d) - max(a, c)
            if inter > 0:
                pairs.append((inter / (max(b, d) - min(a, c)), (a, b, i), (c, d, j)))
    used, out = set(), set()
    for _, g, p in sorted(pairs, reverse=True):
        if ("g", g) not in used and ("p", p) not in used:
            used |= {("g", g), ("p", p)}
            out.add((g[2], p[2]))
    return out


def test_matching_equals_one_by_one(spark):
    rng = random.Random(4)
    calls, found = ([("a", i, a, a + rng.randint(1, 300)) for i, a in enumerate(rng.choices(range(2000), k=n))] for n in (50, 70))
    for bucket in (60, 10**9):
        got = matching.greedy_match(table(spark, calls), table(spark, found), ["session"], bucket_us=bucket)
        assert {(r.gt_id, r.pred_id) for r in got.collect()} == one_by_one(calls, found)


def rows_written(monkeypatch):
    """The rows of every table that a matching writes, as a list that grows."""
    rows, write = [], matching.cut

    def counted(df, tag, *more):
        out = write(df, tag, *more)
        rows.append(out.count())
        return out

    monkeypatch.setattr(matching, "cut", counted)
    return rows


def crowd(n, m):
    """Copies of a few intervals and others that overlap them all."""
    calls = [("a", i, -200 + i % 3, 300 + i % 3) for i in range(n)] + [("a", n + i, i - 150, i + 290) for i in range(m)]
    found = [("a", 5000 + i, -199 + i % 2, 301 + i % 2) for i in range(n)] + [("a", 7000 + i, i - 160, 2 * i + 280) for i in range(m)]
    return calls, found


@pytest.mark.parametrize("bucket", [40, 700, None])
def test_matching_of_crowds_writes_intervals_and_not_pairs(spark, monkeypatch, bucket):
    rows = rows_written(monkeypatch)
    calls, found = crowd(70, 25)
    got = matching.greedy_match(table(spark, calls + calls[:9]), table(spark, found + found[:9]), ["session"], bucket_us=bucket).collect()
    assert {(r.gt_id, r.pred_id) for r in got} == one_by_one(calls, found) and len(got) == 95
    assert max(rows) <= 20 * (len(calls) + len(found)) and (bucket == 40 or sum(rows) <= 2 * (len(calls) + len(found)))


def test_matching_score_of_crowds_writes_intervals_and_not_pairs(spark, monkeypatch):
    rows = rows_written(monkeypatch)
    calls, found = crowd(60, 20)
    got = matching.matching_score(table(spark, calls), table(spark, [*found, ("b", 1, 0, 9)]), ["session"]).collect()
    assert sorted((r.session, r.tp, r.fp, r.fn) for r in got) == [("a", 80, 0, 0), ("b", 0, 1, 0)]
    assert sum(rows) <= 2 * (len(calls) + len(found) + 1)


def test_matching_sweep_of_crowds_writes_intervals_and_not_pairs(spark, monkeypatch):
    rows = rows_written(monkeypatch)
    calls, found = crowd(60, 20)
    got = gates.matching_sweep(table(spark, found), table(spark, calls), {"all": F.lit(True), "early": F.col("event_id") < 5030}, ["session"]).collect()
    assert sorted((r.strategy, r.tp, r.fp, r.fn) for r in got) == [("all", 80, 0, 0), ("early", 30, 0, 50)]
    assert sum(rows) <= 4 * (len(calls) + len(found))


def test_matching_of_sets_deals_intervals_once(spark, monkeypatch):
    plans, write = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df, *more: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *more))[1])
    rng = random.Random(8)
    calls, found = ([("a", i, a, a + rng.randint(0, 300)) for i, a in enumerate(rng.choices(range(1500), k=n))] for n in (40, 60))
    of = {"all": (F.lit(True), lambda p: True), "none": (F.lit(False), lambda p: False), "odd": (F.when(F.col("event_id") % 2 == 1, True), lambda p: p[1] % 2), "late": (F.col("t0_us") > 700, lambda p: p[2] > 700)}
    want = {n: one_by_one(calls, [p for p in found if f(p)]) for n, (_, f) in of.items()}
    for bucket in (60, None):
        got = matching.greedy_match(table(spark, calls), table(spark, found), ["session"], bucket_us=bucket, keep=[c for c, _ in of.values()]).collect()
        assert {n: {(r.gt_id, r.pred_id) for r in got if r.set == i} for i, n in enumerate(of)} == want and len(got) == sum(map(len, want.values()))
    plans.clear()
    named = {n: c for n, (c, _) in of.items()}
    swept = gates.matching_sweep(table(spark, found), table(spark, calls), named, ["session"]).collect()
    assert plans and plans[0].count("Generate ") == 1  # over the stretches only, not over the strategies
    assert {r.strategy: (r.tp, r.fp, r.fn) for r in swept} == {n: (len(want[n]), sum(map(bool, map(f, found))) - len(want[n]), len(calls) - len(want[n])) for n, (_, f) in of.items()}


def test_a_long_chain_is_matched_in_few_rounds(spark):
    n = 10_000
    calls = [("a", i, i * 2_000_000, i * 2_000_000 + 1_000_000 + i * 20) for i in range(n)]
    found = [("a", i, i * 2_000_000 + 900_000, i * 2_000_000 + 2_100_000 + i * 20) for i in range(n)]
    pairs = {(g[1], p[1]) for g in calls for p in found[max(0, g[1] - 1) : g[1] + 2]}
    near = lambda g: [p for p in found[max(0, g - 2) : g + 3]]
    want, used, ranked = set(), set(), []
    for _, i, a, b in calls:
        for _, j, c, d in near(i):
            inter = min(b, d) - max(a, c)
            if inter > 0:
                ranked.append((inter / (max(b, d) - min(a, c)), (a, b, i), (c, d, j)))
    for _, g, p in sorted(ranked, reverse=True):
        if ("g", g) not in used and ("p", p) not in used:
            used |= {("g", g), ("p", p)}
            want.add((g[2], p[2]))
    start = time.time()
    got = {(r.gt_id, r.pred_id) for r in matching.greedy_match(table(spark, calls), table(spark, found), ["session"]).collect()}
    assert got == want and pairs >= want and time.time() - start < 120


def test_boxes_over_a_grid_give_the_same(spark):
    rng = random.Random(6)
    rows = []
    for i in range(260):
        x, y, w, h = rng.uniform(-20, 60), rng.uniform(0, 40), rng.choice([0.0, 3.0, 8.0, 30.0]), rng.uniform(1, 9)
        rows.append((rng.choice(["a", "b", None]), i, x, y, x + w, y + h, rng.choice([None, 0.5, round(rng.random(), 1)])))
    df = table(spark, rows + [rows[0]], "image string, id long, x1 double, y1 double, x2 double, y2 double, score double")
    streamed = sorted(map(str, matching.suppress(df, ["image"], 0.3, ["id"]).collect()))
    for dense in (0, 90):
        assert sorted(map(str, matching.suppress(df, ["image"], 0.3, ["id"], dense).collect())) == streamed
    assert matching.suppress(df.where("false"), ["image"], 0.3, ["id"], 0).collect() == [] and len(streamed) < len(rows)


def test_ellipse():
    assert sorted(signal.ellipse(7, 3)) == sorted([(0, -1), (0, 1), *((x, 0) for x in range(-3, 4))])
    assert signal.ellipse(1, 1) == [(0, 0)]


@pytest.mark.parametrize("seed", range(3))
def test_closing_equals_a_loop_over_the_image(spark, seed):
    rng = np.random.default_rng(seed)
    frames, bins = 17, 9
    image = rng.random((frames, bins)) < 0.35
    kernel = signal.ellipse(7, 3)
    inside = lambda f, b: 0 <= f < frames and 0 <= b < bins
    grown = np.array([[any(inside(f + x, b + y) and image[f + x, b + y] for x, y in kernel) for b in range(bins)] for f in range(frames)])
    want = {(f, b) for f in range(frames) for b in range(bins) if all(not inside(f + x, b + y) or grown[f + x, b + y] for x, y in kernel)}
    rows = [("c", int(f), int(b), frames, bins) for f, b in np.argwhere(image)]
    got = signal.close_pixels(table(spark, rows, "chunk string, frame int, bin int, __frames int, __bins int"), ["chunk"], kernel)
    assert {(r.frame, r.bin) for r in got.collect()} == want


def test_closing_joins_components_that_pass(spark):
    power = np.full((40, 16), 1e-9)
    power[5:15, 7:10] = power[17:30, 7:10] = 1.0  # two frames apart
    power[20, 2] = 1.0  # a speckle beside the line
    df = table(spark, [("c", i, [float(v) for v in row]) for i, row in enumerate(power)], "chunk string, frame int, power array<double>")
    plain = lambda c: F.transform(c, lambda v: v + 200)
    find = lambda **k: sorted((r.x_px, r.w_px, r.area_px) for r in signal.segment(df, ["chunk"], 90.0, 3, plain, **k).collect())
    assert find() == [(5, 10, 30), (17, 13, 39)]
    assert find(closing=(7, 3)) == [(5, 25, 71)]  # the kernel bridges the middle row only
    assert find(closing=(7, 3), gate=F.col("w_px") < 12) == [(5, 10, 30)]


def write_wav(path, data, sr, channels=1, width=2):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(sr)
        w.writeframes(data)


def test_ranges_equal_whole_files(spark, tmp_path):
    d = tmp_path / "experiment_1" / "idx_000"
    d.mkdir(parents=True)
    rng = np.random.default_rng(1)
    write_wav(d / "mic_0_a.wav", rng.integers(-30000, 30000, 10_050).astype("<i2").tobytes(), 1000)
    write_wav(d / "mic_0_b.wav", bytes(100), 1000)  # not the first by name
    write_wav(d / "mic_1_a.wav", rng.integers(0, 255, 2 * 3_500).astype(np.uint8).tobytes(), 500, 2, 1)
    write_wav(d / "mic_2_a.wav", rng.integers(0, 255, 3 * 2 * 2_000).astype(np.uint8).tobytes(), 500, 2, 3)
    write_wav(d / "mic_3_a.wav", bytes(20), 500)  # shorter than a chunk
    key = lambda r: (r.session, r.channel, r.chunk, r.sr, r.t0_us, r.t1_us, tuple(r.samples))
    want = sorted(map(key, readers.slice_chunks(readers.read_wav(spark, str(tmp_path), "mic"), 0.5).collect()))
    (d / "mic_4_a.wav").write_bytes(b"RIFF....WAVEnothing")  # only the ranged reader leaves such files out
    for stretch in (1, 3_000, 1 << 20):
        got = audio.read_wav_chunks(spark, str(tmp_path), "mic", 0.5, stretch)
        assert sorted(map(key, got.collect())) == want
    heads = {r.channel: r for r in audio.wav_headers(audio.wav_files(spark, str(tmp_path), "mic")).collect()}
    assert heads[4].error and heads[4].sr is None and (heads[2].width, heads[2].frames, heads[1].channels) == (3, 2_000, 2)


def test_header_variants(tmp_path):
    p = tmp_path / "x.wav"
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 100, 200, 2, 16)
    p.write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + struct.pack("<4sI", b"LIST", 3) + b"abc\0" + form + struct.pack("<4sI", b"data", 0xFFFFFFFF) + bytes(20))
    with audio.open_file(str(p)) as f:
        assert audio.read_header(f) == (100, 1, 2, 56, 10)
    p.write_bytes(b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + struct.pack("<4sIQQQI", b"ds64", 28, 0, 8, 4, 0) + form + struct.pack("<4sI", b"data", 0xFFFFFFFF) + bytes(20))
    with audio.open_file(f"file:{p}") as f:
        assert audio.read_header(f)[4] == 4
    p.write_bytes(b"RIFF" + struct.pack("<I", 0) + b"WAVE" + form.replace(struct.pack("<H", 1), struct.pack("<H", 3), 1))
    with audio.open_file(str(p)) as f, pytest.raises(ValueError):
        audio.read_header(f)


def test_windows_have_one_length(spark):
    sr, size = 100, 50
    x = np.arange(1, 201, dtype=float)  # four chunks, of which the third is missing
    chunks = table(spark, [("s", 0, c, sr, [float(v) for v in x[c * size : (c + 1) * size]]) for c in (0, 1, 3)], "session string, channel int, chunk int, sr int, samples array<double>")
    ms = 1_000
    events = [("s", 0, 0, 100 * ms), ("s", 0, 1_900 * ms, 2_000 * ms), ("s", 0, 900 * ms, 1_000 * ms), ("s", 0, 5_000 * ms, 5_100 * ms), ("s", 0, 0, 100 * ms), ("t", 0, 0, 100 * ms)]
    kind = "session string, channel int, t0_us long, t1_us long"
    heard = np.concatenate([np.zeros(100), x, np.zeros(800)])
    heard[100 + 2 * size : 100 + 3 * size] = 0
    got = signal.context_window(table(spark, events, kind), chunks, 500 * ms, 200 * ms, 300 * ms).collect()
    assert len(got) == 5 and all(len(r.samples) == 60 for r in got)
    for r in got:
        first = r.t0_us // (10 * ms) - 20
        assert r.samples == list(heard[100 + first : 160 + first])
    fixed = signal.context_window(table(spark, events, kind), chunks, 500 * ms, 200 * ms, 0, length=7).collect()
    assert len(fixed) == 5 and all(len(r.samples) == 7 for r in fixed)
    assert signal.context_window(table(spark, [], kind), chunks, 500 * ms, 0, 0).collect() == []


def test_power_within_the_band(spark):
    sr, n = 8_000, 800
    t = np.arange(n) / sr
    low, high = np.sin(2 * np.pi * 500 * t), 0.5 * np.sin(2 * np.pi * 2_000 * t)
    noise = [0.1] * 50
    rows = [(1, sr, 1_500.0, 2_500.0, (low + high).tolist()), (2, sr, 0.0, 2_500.0, (low + high).tolist()), (3, sr, 1_500.0, 2_500.0, [1.0] * 10), (4, sr, 1_500.0, 2_500.0, None)]
    df = table(spark, rows, "id int, sr int, f_low_hz double, f_high_hz double, event array<double>").withColumns({"before": F.array(*map(F.lit, noise)), "after": F.array().cast("array<double>")})
    got = {r.id: r for r in signal.band_power(df).collect()}
    assert math.isclose(got[1].power, 0.125, rel_tol=1e-6) and math.isclose(got[2].power, 0.625, rel_tol=1e-6)
    assert math.isclose(got[1].snr, 10 * math.log10(0.125 / 0.01), rel_tol=1e-6)
    assert (got[3].power, got[3].snr, got[4].power, got[4].snr) == (None,) * 4
