import math
import struct

import numpy as np
import pytest
from airtide.functions import categories, kernels
from airtide.operators import breaths as B
from airtide.operators import masks, select, signal, spectrum
from airtide.operators import maps as M
from airtide.operators import sequences as Q
from airtide.sources import vendors
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def series(spark, values, rate=1.0):
    return spark.createDataFrame([(0, k, k / rate, float(v)) for k, v in enumerate(values)], "recording_id long, idx long, time double, value double")


def test_breaths_of_a_cosine(spark):
    rate, f = 25, 1 / 3.5
    data = signal.moving_average(series(spark, [math.cos(2 * math.pi * f * k / rate) for k in range(70 * rate)], rate), signal.blackman(375))
    points = B.trimmed(B.suppressed(B.extrema(data), 17), data)
    found = B.assembled(B.without_low(B.alternating(points))).orderBy("breath_idx").collect()
    assert len(found) == 19
    assert all(r.start_idx < r.middle_idx < r.end_idx for r in found)


def test_alternating_keeps_the_earliest_of_equals(spark):
    rows = [(0, 0, 0.0, 1.0, -1), (0, 1, 1.0, 1.0, -1), (0, 2, 2.0, 5.0, 1), (0, 3, 3.0, 6.0, 1), (0, 4, 4.0, 0.0, -1)]
    points = spark.createDataFrame(rows, "recording_id long, idx long, time double, value double, kind int")
    assert [r.idx for r in B.alternating(points).orderBy("idx").collect()] == [0, 3, 4]


def test_plateau_counts_once(spark):
    data = series(spark, [0, 1, 2, 2, 2, 1, 0]).selectExpr("*", "0.5 AS average")
    assert [r.idx for r in B.extrema(data).where("kind = 1").collect()] == [3]


def test_fill_nearest_odd_run_prefers_the_right(spark):
    data = series(spark, range(10)).selectExpr("*", "idx BETWEEN 3 AND 5 AS invalid")
    assert [r.value for r in signal.fill_nearest(data).orderBy("idx").collect()][3:6] == [2.0, 6.0, 6.0]


def test_long_average_equals_the_short_way(spark, monkeypatch):
    data, weights = series(spark, [(k * 7) % 11 for k in range(40)]), signal.blackman(21)
    got = lambda: [r.average for r in signal.moving_average(data, weights).orderBy("idx").collect()]
    short = got()
    monkeypatch.setattr(signal, "SPAN", 5)
    wide = np.pad([(k * 7) % 11 for k in range(40)], 10, mode="edge")
    assert np.allclose(short, got()) and np.allclose(short, [wide[k : k + 21] @ weights for k in range(40)])


@pytest.mark.parametrize("padding", ["edge", "constant", "reflect", "symmetric", "wrap", "mean"])
def test_paddings_in_spans(spark, monkeypatch, padding):
    """Each padding, with recordings of many spans, of a span exactly, and shorter than the window; an even window is one longer."""
    monkeypatch.setattr(signal, "SPAN", 8)
    rng = np.random.default_rng(3)
    for n in (200, 64, 65, 70, 9, 5, 1):
        x = rng.normal(size=n)
        size = min(9, (n - 1) // 2 * 2 + 1)
        w = np.array(signal.blackman(size))
        want = np.convolve(np.pad(x, size // 2, mode=padding), w / w.sum(), mode="valid")
        got = signal.moving_average(series(spark, x), 8, signal.blackman, padding=padding).orderBy("idx").collect()
        assert [r.idx for r in got] == list(range(n)) and np.allclose([r.average for r in got], want), (padding, n)


def test_even_window_is_refused(spark):
    with pytest.raises(ValueError):
        signal.moving_average(series(spark, [1, 2]), [0.5, 0.5])


def test_selection(spark):
    data = series(spark, range(10))
    idx = lambda df: [r.idx for r in df.orderBy("idx").collect()]
    assert idx(select.by_index(data, -3)) == [7, 8, 9]
    assert idx(select.by_time(data, 2.5, 5.5)) == [3, 4, 5]
    assert idx(select.by_time(data, 2.5, 5.5, start_inclusive=True, end_inclusive=True)) == [2, 3, 4, 5, 6]
    assert idx(select.at_time(data, 2.5)) == [3]
    assert idx(select.by_time(data)) == list(range(10))


def test_concatenate_checks_order(spark):
    a, b = series(spark, range(3)), series(spark, range(3)).selectExpr("recording_id", "idx", "time + 3 AS time", "value")
    assert [r.idx for r in select.concatenate(a, b).orderBy("idx").collect()] == list(range(6))
    with pytest.raises(PySparkException):
        select.concatenate(b, a).collect()


def test_masks(spark):
    rows = lambda m: spark.createDataFrame([(r, c, float(w)) for (r, c), w in m.items()], "row int, col int, weight double")
    a, b = rows({(0, 2): 1, (0, 3): 1, (1, 0): 0.2, (1, 1): 0.3}), rows({(0, 0): 1, (0, 3): 1, (1, 1): 0.5, (1, 2): 1})
    as_dict = lambda df: {(r.row, r.col): round(r.weight, 6) for r in df.collect()}
    assert as_dict(masks.union(a, b)) == {(0, 0): 1, (0, 2): 1, (0, 3): 1, (1, 0): 0.2, (1, 1): 0.8, (1, 2): 1}
    assert as_dict(masks.difference(a, b)) == {(0, 2): 1, (1, 0): 0.2}
    assert as_dict(masks.intersection(a, b)) == {(0, 3): 1, (1, 1): 0.15}
    with pytest.raises(ValueError):
        masks.geometric(spark, ["L1"], 6, 8)


def test_regions(spark):
    pixels = [("m", 0, 0), ("m", 1, 1), ("m", 3, 0), ("m", 3, 1), ("n", 0, 0)]
    mask = spark.createDataFrame(pixels, "mask_id string, row int, col int")
    count = lambda c: masks.regions(mask, connectivity=c).select("mask_id", "region").distinct().count()
    assert (count(1), count(2)) == (4, 3)
    assert masks.by_size(mask, least=2, empty="drop").count() == 2
    with pytest.raises(PySparkException):  # mask n has no region of two
        masks.by_size(mask, least=2).collect()
    assert count([[0, 0, 1], [0, 1, 0], [1, 0, 0]]) == 5 and count([[1, 0, 0], [0, 1, 0], [0, 0, 1]]) == 4
    for wrong in (3, [[1, 1], [1, 1]], [[1, 0, 0], [0, 1, 0], [0, 0, 0]]):
        with pytest.raises(ValueError):
            masks.regions(mask, connectivity=wrong)


def test_normalize_by_zero_raises(spark):
    flat = spark.createDataFrame([(0, 0, 0, 0.0)], "map_id int, row int, col int, value double")
    with pytest.raises(PySparkException):
        M.normalize(flat, "maximum").collect()


@pytest.mark.parametrize("kind, cutoff", [("lowpass", 2.0), ("highpass", 2.0), ("bandpass", (1.0, 3.0)), ("bandstop", (1.0, 3.0))])
@pytest.mark.parametrize("order", [1, 3, 4])
def test_butterworth_gain(kind, cutoff, order):
    sos = kernels.butterworth(kind, cutoff, order, 50.0)
    gain = lambda f: abs(np.prod([np.polyval(s[:3], np.exp(2j * np.pi * f / 50)) / np.polyval(s[3:], np.exp(2j * np.pi * f / 50)) for s in sos]))
    for f in np.atleast_1d(cutoff):
        assert gain(f) == pytest.approx(math.sqrt(0.5), rel=1e-6)
    assert gain({"lowpass": 0, "highpass": 25, "bandpass": math.sqrt(3), "bandstop": 0}[kind]) == pytest.approx(1, abs=0.02)


def test_zero_phase_keeps_a_constant_and_phase():
    sos = kernels.butterworth("lowpass", 2.0, 4, 50.0)
    assert np.allclose(kernels.zero_phase(sos, np.ones(300)), 1)
    t = np.arange(5000) / 50
    y = kernels.zero_phase(sos, np.sin(2 * np.pi * 2 * t))
    assert np.allclose(y[1000:4000], 0.5 * np.sin(2 * np.pi * 2 * t)[1000:4000], atol=1e-3)
    with pytest.raises(ValueError):
        kernels.zero_phase(sos, np.array([np.nan] * 300))


def test_notch_bands():
    bands = spectrum.notch_bands(40 / 60, 55 / 60)
    assert len(bands) == 4 and bands[0][1] == pytest.approx((40 + 55) / 120)
    with pytest.raises(ValueError):
        spectrum.notch_bands(2.0, 1.0)


def test_rates(spark):
    t = np.arange(1200) / 20
    breath, beat = np.sin(2 * np.pi * 0.25 * t), np.sin(2 * np.pi * 1.3 * t)
    frames = [(0, k, [float(x) for x in (10 * breath[k] + beat[k], 10 * breath[k] - beat[k], 10 * breath[k])]) for k in range(len(t))]
    got = spectrum.rates(spark.createDataFrame(frames, "recording_id long, frame_idx long, pixels array<double>"), 20.0).first()
    assert got.respiratory_rate == pytest.approx(0.25, rel=0.05) and got.heart_rate == pytest.approx(1.3, rel=0.05)


def test_phase_lag_sign():
    t = np.arange(400)
    assert kernels.phase_lag(np.cos(2 * np.pi * (t - 7) / 100), np.cos(2 * np.pi * t / 100), 60) == pytest.approx(7, abs=1)


def test_categories(spark):
    assert categories.check("plateau pressure", "pressure") and categories.check("pressure", "physical measurement") and not categories.check("flow", "pressure")
    with pytest.raises(ValueError):
        categories.check("flow", "no such thing")
    with pytest.raises(ValueError):
        categories.check("flow", "pressure", raise_=True)
    with pytest.raises(ValueError):
        categories.nested({"a": {"b": {}}, "c": {"b": {}}})
    small = "top:\n- one:\n  - two\n  - three: \n    - four\n- five\n"
    want = [("top", None, ["top"], 0), ("one", "top", ["top", "one"], 1), ("two", "one", ["top", "one", "two"], 2), ("three", "one", ["top", "one", "three"], 2),
            ("four", "three", ["top", "one", "three", "four"], 3), ("five", "top", ["top", "five"], 1)]
    assert categories.compact(small) == want == categories.nested({"top": [{"one": ["two", {"three": ["four"]}]}, "five"]})
    assert categories.nested({"name": "top", "children": [{"name": "one", "children": [{"name": "two"}]}]})[-1] == ("two", "one", ["top", "one", "two"], 2)
    for wrong in (small + "- one\n", "top:\n- one\n  - two\n", "top:\none:\n"):
        with pytest.raises(ValueError):
            categories.compact(wrong)
    data = spark.createDataFrame([("flow",), ("airflow",), ("volume",)], "category string")
    assert sorted(r.category for r in categories.of_category(data, "flow").collect()) == ["airflow", "flow"]
    assert categories.categories(spark).where("parent = 'root'").count() == 3


def test_find_breaths_of_a_wave(spark):
    """A regular wave, with other shortest durations and with an outlier."""
    wave = [-math.cos(2 * math.pi * (k / 25) / 3.5) for k in range(25 * 70)]
    count = lambda values, **given: B.find_breaths(series(spark, values, 25.0), 25.0, **given).count()
    assert count(wave) == count(wave, minimum_duration=3) == count(wave, minimum_duration=1 / 25)
    assert 0 < count(wave, minimum_duration=4) < count(wave)
    outlier = list(wave)
    outlier[438] = -100.0
    assert 0 < count(wave) - count(outlier) <= 2 and count(outlier, invalid_window=3.5) < count(outlier)
    assert count([1.0] * 500) == 0 and count(wave[:30]) == 0
    found = B.find_breaths(series(spark, wave, 25.0), 25.0).orderBy("breath_idx").collect()
    assert all(a.end_idx == b.start_idx for a, b in zip(found, found[1:])) and all(abs(r.middle_value - 1) < 1e-3 and abs(r.start_value + 1) < 1e-3 for r in found)


def test_only_invalid_samples_are_an_error(spark):
    with pytest.raises(PySparkException):
        signal.fill_nearest(series(spark, [1, 2]).withColumn("invalid", F.lit(True))).collect()


def test_windows_grow_in_proportion(spark):
    """Twice the samples of one recording take about twice as long."""
    import time

    def seconds(n):
        data = spark.range(0, n, 1, 1).selectExpr("0L AS recording_id", "id AS idx", "double(id) AS time", "double(id % 97) AS value").withColumn("average", F.lit(40.0))
        valleys = data.where("idx % 97 = 0").selectExpr("*", "-1 AS kind").drop("average")
        began = time.perf_counter()
        signal.fill_nearest(data.withColumn("invalid", F.col("idx") % 11 == 0)).write.format("noop").mode("overwrite").save()
        B.trimmed(valleys, data).write.format("noop").mode("overwrite").save()
        Q.as_of(valleys.select("recording_id", (F.col("time") + 0.5).alias("time")), data).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(200_000) < 4 * seconds(50_000) + 4


def test_prominent_peaks_against_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        c = rng.integers(-3, 4, rng.integers(3, 25)).astype(float)
        least = float(rng.choice([0.0, 1.0, 2.5]))
        want = []
        for a in range(1, len(c) - 1):
            b = a
            while b + 1 < len(c) and c[b + 1] == c[a]:
                b += 1
            if c[a - 1] >= c[a] or b + 1 == len(c) or c[b + 1] >= c[a] or c[a] < 0:
                continue
            left, right = a, b
            while left > 0 and c[left - 1] <= c[a]:
                left -= 1
            while right + 1 < len(c) and c[right + 1] <= c[a]:
                right += 1
            if c[a] - max(c[left : a + 1].min(), c[a : right + 1].min()) >= least:
                want.append((a + b) // 2)
        assert kernels.prominent(c, 0.0, least) == want, c


def test_mask_collection(spark):
    grid = lambda *cells: spark.createDataFrame([(r, c, w) for r, c, w in cells], "row int, col int, weight double")
    held = masks.Collection({"a": grid((0, 0, 1.0), (0, 1, 0.5)), "b": grid((0, 1, 0.5), (1, 1, 1.0))})
    rows = lambda df: sorted((r.row, r.col, r.weight) for r in df.collect())
    assert not held.anonymous and len(held) == 2
    assert rows(held.combine("sum")) == [(0, 0, 1.0), (0, 1, 1.0), (1, 1, 1.0)] and rows(held.combine("product")) == [(0, 1, 0.25)]
    for wrong, error in ((lambda: held.add(grid((0, 0, 1.0)), "a"), KeyError), (lambda: held.add(grid((0, 0, 1.0))), ValueError), (lambda: held.add(grid((0, 0, 1.0)).drop("weight"), "c"), ValueError),
                         (lambda: held.combine("mean"), ValueError), (lambda: masks.Collection().combine(), ValueError)):
        with pytest.raises(error):
            wrong()
    held.add(grid((1, 0, 1.0)), "a", overwrite=True)
    assert rows(held["a"]) == [(1, 0, 1.0)]
    numbered = masks.Collection([grid((0, 0, 1.0)), grid((1, 1, 1.0))])
    assert numbered.anonymous and list(numbered.masks) == [0, 1]
    px = spark.createDataFrame([(0, 0, 2.0), (1, 1, 4.0)], "row int, col int, z double")
    assert sorted((r.label, r.z) for r in held.apply(px, label_format="z of {mask_label}").collect()) == [("z of b", 4.0)]
    with pytest.raises(ValueError):
        held.apply(px, label_format="z")


def test_map_kinds(spark):
    grid = lambda *v: spark.createDataFrame([(0, c, x) for c, x in enumerate(v)], "row int, col int, value double")
    values = lambda df: [r.value for r in df.orderBy("col").collect()]
    a, b = M.convert(grid(1.0, -2.0, None), "amplitude"), grid(2.0, 0.0, 1.0)
    assert [r.negative for r in a.orderBy("col").collect()] == [False, True, False]
    assert values(M.combine(a, b, "+")) == [3.0, -2.0, None] and values(M.combine(a, 2, "-", reverse=True)) == [1.0, 4.0, None]
    assert values(M.combine(a, b, "/")) == [0.5, None, None] and values(M.combine(a, b, "-", reverse=True)) == [1.0, 2.0, None]
    assert {r.kind for r in M.combine(a, b, "-").collect()} == {"difference"} and {r.kind for r in M.combine(a, 3, "*").collect()} == {"amplitude"}
    with pytest.raises(PySparkException):
        M.combine(a, grid(1.0), "+").collect()
    with pytest.raises(ValueError):
        M.convert(a, "no such kind")


def test_draeger(spark, tmp_path):
    records = np.zeros(3, dtype=vendors.draeger_dtype(52))
    records["time"] = np.arange(3) / 86400
    records["pixels"][:] = np.arange(1024)
    records["pixels"][1, 5] = -2e30
    records["marker"] = [1, 1, 2]
    (tmp_path / "a.bin").write_bytes(records.tobytes())
    frames = vendors.load(spark, str(tmp_path / "a.bin"), "dräger", first_frame=1)
    rows = frames.orderBy("frame_idx").collect()
    assert [r.frame_idx for r in rows] == [1, 2] and rows[0].pixels[5] is None and rows[0].pixels[6] == 6.0 and rows[0].time == pytest.approx(1)
    assert [r.marker for r in vendors.events(frames).collect()] == [2]
    with pytest.raises(NotImplementedError):
        vendors.load(spark, "x", "nobody")


def test_timpel(spark, tmp_path):
    line = lambda k: ",".join(["-1000", *["1.5"] * 1023, "10", "20", "30", "1", "0", "0"])
    (tmp_path / "a.txt").write_text("\n".join(line(k) for k in range(2)) + "\n")
    rows = vendors.load(spark, str(tmp_path / "a.txt"), "timpel").orderBy("frame_idx").collect()
    assert len(rows) == 2 and rows[1].time == 0.02 and rows[0].pixels[0] is None and rows[0].phase == -1 and rows[0].aux == [10, 20, 30]


def test_sentec(spark, tmp_path):
    image = struct.pack("<2B4f", 2, 2, 1, 2, 3, 4)
    packet = lambda us: struct.pack("<QBB", 0, 16, 2) + struct.pack("<BHI", 0, 4, us) + struct.pack("<BH", 5, len(image)) + image
    (tmp_path / "a.zri").write_bytes(b"\x01" + packet(2**32 - 10) + packet(5))
    rows = vendors.load(spark, str(tmp_path / "a.zri"), "sentec").orderBy("frame_idx").collect()
    assert rows[0].pixels == [-1, -2, -3, -4] and rows[1].time > rows[0].time


def test_streaming_markers(spark, tmp_path):
    from airtide.streaming.markers import marker_events

    frame = spark.createDataFrame([(0, 0.0, 1), (0, 1.0, 2), (0, 2.0, 2), (1, 0.0, 3)], "recording_id long, time double, marker int")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run = marker_events(source).writeStream.format("memory").queryName("markers").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    assert [tuple(r) for r in spark.table("markers").collect()] == [(0, 1.0, 2)]


def test_draeger_signals_phases_and_breaths(spark, tmp_path):
    records = np.zeros(9, dtype=vendors.draeger_dtype(58))
    records["time"] = np.arange(9) / 86400
    records["phase"] = [-1, 0, 1, 0, -1, 0, 1, 1, -1]
    records["pixels"][:, 0] = [0, 1, 4, 1, 0, 1, 3, 5, 0]
    records["aux"][:, 54] = 7
    (tmp_path / "p.bin").write_bytes(records.tobytes())
    frames = vendors.monotonic(vendors.load(spark, str(tmp_path / "p.bin"), "draeger"), 86400.0)
    held = vendors.signals(frames)
    assert held.select("label").distinct().count() == 10 and held.where("label = 'airway pressure (pod)' and value = 7").count() == 9
    assert vendors.phases(frames).count() == 6
    assert [(r.start_idx, r.middle_idx, r.end_idx) for r in vendors.device_breaths(frames).orderBy("breath_idx").collect()] == [(0, 2, 4), (4, 7, 8)]


def test_times_must_ascend(spark, tmp_path):
    records = np.zeros(2, dtype=vendors.draeger_dtype(52))
    (tmp_path / "t.bin").write_bytes(records.tobytes())
    with pytest.raises(PySparkException):
        vendors.monotonic(vendors.load(spark, str(tmp_path / "t.bin"), "draeger"), 86400.0).collect()


def test_data_source_reads_ranges(spark, tmp_path):
    from airtide.sources import datasource

    datasource.register(spark)
    records = np.zeros(10, dtype=vendors.draeger_dtype(52))
    records["time"], records["marker"] = np.arange(10) / 86400, np.arange(10)
    (tmp_path / "r.bin").write_bytes(records.tobytes())
    got = spark.read.format(datasource.NAME).option("path", str(tmp_path / "r.bin")).option("first_frame", 2).option("max_frames", 7).option("frames_per_task", 3).load()
    assert got.rdd.getNumPartitions() == 3
    assert [(r.frame_idx, r.marker) for r in got.orderBy("frame_idx").collect()] == [(k, k) for k in range(2, 9)]


def test_stored_tables_keep_their_rows(spark, tmp_path):
    from airtide.operators import sequences
    from airtide.sources import tables

    data = series(spark, range(20))
    tables.write(data, str(tmp_path / "out"))
    back = tables.read(spark, str(tmp_path / "out")).select(F.col("recording_id").cast("long"), "idx", "time", "value")
    assert sequences.equal(data, back).first().equal and not sequences.equal(data, back.where("idx > 0")).first().equal


def test_sequence_tail_and_concatenation(spark):
    from airtide.operators.sequences import Sequence

    data = series(spark, range(10))
    points = spark.createDataFrame([(0, 2.0, 1.0), (0, 5.0, None)], "recording_id long, time double, value double")
    whole = Sequence(continuous=data, sparse=points)
    assert whole.by_index(0, 6).sparse.count() == 1 and whole.by_index(0, 6, inclusive_tail=True).sparse.count() == 2
    with pytest.raises(ValueError):
        whole.concatenate(Sequence(continuous=data))
    with pytest.raises(PySparkException):
        whole.concatenate(whole).sparse.collect()


def test_intervals_may_touch(spark):
    a = spark.createDataFrame([(0, 0.0, 2.0)], "recording_id long, start_time double, end_time double")
    b = spark.createDataFrame([(0, 2.0, 3.0)], a.schema)
    assert select.concatenate_points(a, b).count() == 2
    with pytest.raises(PySparkException):
        select.concatenate_points(b, a).collect()


def test_as_of_takes_the_next_sample(spark):
    from airtide.operators.sequences import as_of

    points = spark.createDataFrame([(0, 1.0), (0, 1.5), (0, 99.0), (1, 0.0)], "recording_id long, time double")
    got = {(r.recording_id, r.time): r.idx for r in as_of(points, series(spark, range(4))).collect()}
    assert got == {(0, 1.0): 1, (0, 1.5): 2, (0, 99.0): None, (1, 0.0): None}


def test_catalogue(spark):
    from airtide.operators.sequences import Catalogue, Entry

    c = Catalogue([Entry("a", "frames", "impedance", parameters={"x": "1"}), Entry("b", "continuous", "impedance", parents=("a",))])
    with pytest.raises(KeyError):
        c.add(Entry("a", "frames", "impedance"))
    assert c.copied("b", "c", unit="AU", parameters={"y": "2"}).parents == ("b",)
    assert c.descendants("a") == {"b": 1, "c": 2} and c.loaded() == ["a"] and c.derived() == ["b", "c"] and c.table(spark).count() == 3


def test_spectra_of_short_and_flat_recordings(spark):
    rows = [(0, k, [1.0, None]) for k in range(4)] + [(1, k, [2.0, 2.0]) for k in range(40)]
    frames = spark.createDataFrame(rows, "recording_id long, frame_idx long, pixels array<double>")
    got = spectrum.spectra(frames, 20.0, 16, 8).collect()
    assert {r.recording_id for r in got} == {1} and all(r.total == 0 and r.pixels == 0 for r in got)
