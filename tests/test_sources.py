import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.sources import sigmf


def test_frames_of_every_format(spark, tmp_path):
    sigmf.register(spark)
    rng = np.random.default_rng(0)
    for kind in ("cf32_le", "cf64_be", "ci16_le", "ci16_be", "ci8", "cu8", "cu16_le", "ci32_be"):
        t, middle, scale = sigmf.scalar_type(kind)
        n = 1000
        raw = rng.normal(size=2 * n).astype(t) if t.kind == "f" else rng.integers(np.iinfo(t).min, np.iinfo(t).max, 2 * n).astype(t)
        at = tmp_path / f"{kind}.sigmf-data"
        raw.tofile(at)
        got = spark.read.format("iq_frames").option("datatype", kind).option("frame_samples", 64).option("frames_per_partition", 3).load(str(at)).orderBy("frame_number").collect()
        assert len(got) == 16 and [r.n_read for r in got] == [64] * 15 + [40] and got[15].i[40:] == [0.0] * 24
        x = np.concatenate([np.stack([r.i, r.q], 1) for r in got])[:n]
        assert np.allclose(x.ravel(), (raw.astype(float) - middle) / scale, atol=1e-6)
    with pytest.raises(ValueError):
        sigmf.scalar_type("rf32_le")


def test_samples_written_and_read_by_uri(spark, tmp_path):
    sigmf.register(spark)
    df = spark.createDataFrame([(s, i, float(i), -float(i) if i else None) for s in ("a", "b") for i in range(10)] + [(None, 1, 1.0, 1.0)], "stem string, at int, i double, q double")
    at = f"file://{tmp_path}/rec"
    assert sorted(map(tuple, sigmf.write_samples(df, at).collect())) == [("a", 10), ("b", 10)]
    got = spark.read.format("iq_frames").option("frame_samples", 4).option("frames_per_partition", 2).load(at).collect()
    assert sorted((r.path[-12], r.frame_number, r.n_read, r.i[1]) for r in got) == [(s, k, n, x) for s in "ab" for k, n, x in ((0, 4, 1.0), (1, 4, 5.0), (2, 2, 9.0))]
    assert sigmf.write_samples(df.limit(0), at).count() == 0


def test_headers_round_trip(spark, tmp_path):
    ann = "array<struct<`core:sample_start`: long, `core:sample_count`: long, `core:freq_lower_edge`: double, `core:freq_upper_edge`: double, `core:label`: string>>"
    df = spark.createDataFrame([("a_attenuation_dB_20", 1e6, "cf32_le", 2.4e9, [(50, 5, 1.0, 2.0, "X"), (10, 0, -1.0, 2.0, None)]), ("b", 2e6, "ci16_le", None, [])], f"stem string, sample_rate double, datatype string, center_freq_hz double, anns {ann}")
    for r in sigmf.header_json(df, "anns").collect():
        (tmp_path / f"{r.stem}.sigmf-meta").write_text(r.value)
    (tmp_path / "c.sigmf-meta").write_text("no json")
    h = sigmf.read_headers(spark, str(tmp_path))
    c = {r.stem: (r.sample_rate, r.center_freq_hz, r.attenuation_db) for r in sigmf.captures(h).where(F.col("sample_rate").isNotNull()).collect()}
    assert c == {"a_attenuation_dB_20": (1e6, 2.4e9, 20), "b": (2e6, None, None)}
    a = [(r.stem, r.ann_idx, r.sample_start, r.label, r.kind) for r in sigmf.annotations(h).orderBy("ann_idx").collect()]
    assert a == [("a_attenuation_dB_20", 0, 10, "UNLABELED", "annotation"), ("a_attenuation_dB_20", 1, 50, "X", "annotation")]


def test_archives_and_words(spark):
    from wavemill.sources import archives, packets

    files = "array<struct<path: string, text: string>>"
    df = spark.createDataFrame([(1, [("a/x.txt", "abc"), ("b/y.txt", None), ("a/z.bin", "d")]), (2, [])], f"id int, files {files}")
    z = archives.packed(df, "id", "files")
    got = {r.id: (r.paths, r.n_bytes) for r in archives.matching_members(z, "id", "archive", "a/*").collect()}
    assert got == {1: ("a/x.txt:a/z.bin", 4), 2: ("", 0)}
    bad = spark.createDataFrame([(3, bytearray(b"no zip")), (4, None)], "id int, archive binary")
    assert [r.paths for r in archives.matching_members(bad, "id", "archive", "*").collect()] == [None, None]
    w = spark.createDataFrame([([0, 1, 2**32 - 1],)], "v array<long>").select(packets.words32(F.concat(packets.encode32(F.col("v")), F.lit(b"xyz"))).alias("w"), packets.words32(F.lit(b"ab")).alias("none")).first()
    assert w.w == [0, 1, 2**32 - 1] and w.none == []
