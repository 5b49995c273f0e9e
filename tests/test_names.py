import importlib

import pytest

import __spark_entry__ as entry

QUERIES = {k: f for m in entry.MODULES for k, f in importlib.import_module(m).QUERIES.items()}

REGIONS = "frame_id string, split string, stem string, attenuation_db int, ann_idx int, label string, kind string, bandwidth_hz double, length_samples long, time_group int, row0 int, row1 int, col0 int, col1 int"


@pytest.fixture(scope="module")
def spelled(spark, tmp_path_factory):
    """One frame under three spellings, with a repeat, and a region that names its capture only."""
    at = str(tmp_path_factory.mktemp("spelled"))
    captures = [("quay_burst_1_attenuation_dB_5", 1e6, 2.4e9, 1024), ("quay_burst_2_attenuation_dB_5", 1e6, 2.4e9, 1024)]
    spark.createDataFrame(captures, "stem string, sample_rate double, center_freq_hz double, n_samples long").write.parquet(f"{at}/captures.parquet")
    a, b, c = "quay_burst_1_attenuation_dB_5", "QUAY-BURST-1-ATTENUATION-DB-5", "quay_burst_1_attenuation_dB_5.sigmf-meta"
    row = lambda frame, stem, i, kind, width, box: (frame, "train", stem, 5, i, "TONE", kind, width, 20_000 + i, 0, *box)
    rows = [
        row(f"{a}#3", a, 1, "waveform", 4e6, (0, 100, 0, 100)), row(f"{b}#3", None, 1, "waveform", 4e6, (0, 100, 0, 100)),
        row(f"{c}#3", b, 2, "annotation", 5e6, (0, 100, 0, 90)), row(f"{b}#3", a, 3, "annotation", 6e6, (500, 600, 1000, 1100)),
        row(f"{b}#3", a, 4, "annotation", 7e6, (700, 800, 2000, 2100)), row(None, b, 5, "annotation", 8e6, (0, 100, 0, 100)),
    ]
    spark.createDataFrame(rows, REGIONS).coalesce(1).write.parquet(f"{at}/regions.parquet")
    return at


FRAME = "quay_burst_1_attenuation_dB_5#3"


def test_frames_are_one_however_spelled(spark, spelled):
    got = lambda q: QUERIES[q](spark, spelled).collect()
    assert [(r.frame_id, r.ann_idx, r.best) for r in got("best_iou_per_region")] == [(FRAME, 1, 0.9)]
    assert sorted((r.frame_id, r.ann_idx) for r in got("suppressed_regions")) == [(FRAME, 2), (FRAME, 3), (FRAME, 4)]
    assert sorted((r.frame_id, r.row0, r.n) for r in got("merged_regions")) == [(FRAME, 0, 2), (FRAME, 500, 1), (FRAME, 700, 1)]
    assert sorted((r.frame_id, r.ann_idx, r.rank) for r in got("top_regions")) == [(FRAME, 2, 3), (FRAME, 3, 2), (FRAME, 4, 1)]
    assert [(r.frame_id, r.n) for r in got("matching_frames")] == [(FRAME, 4)]
    assert [r.frame_id for r in got("frame_masks")] == [FRAME]


def test_regions_without_frame_id_keep_their_capture(spark, spelled):
    for q in ("normalised_boxes", "physical_regions"):
        got = sorted((r.ann_idx, r.frame_id) for r in QUERIES[q](spark, spelled).collect())
        assert got == [(1, FRAME), (2, FRAME), (3, FRAME), (4, FRAME), (5, FRAME.split("#")[0])]


def test_repeats_count_once(spark, spelled, tmp_path):
    assert sum(r.n for r in QUERIES["region_buckets"](spark, spelled).collect()) == 5
    rows = [(1, 0, 5.0, "a"), (1, 0, 5.0, "b"), (2, 1, None, "c"), (2, 1, None, "d"), (3, 2, 7.0, "e")]
    t = spark.createDataFrame(rows, "sample_id long, cell_index int, latency_ms double, logged_at string").selectExpr("*", "date'2025-01-01' as run_day")
    t.write.parquet(f"{tmp_path}/latency_samples.parquet")
    assert [(r.rx_packets, round(r.missed_ratio, 6)) for r in QUERIES["network_log"](spark, str(tmp_path)).collect()] == [(2, 0.333333)]
