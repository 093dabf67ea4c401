import struct

import pytest

from kinetext.functions import text as X
from kinetext.sources import video


def box(kind, data, large=False):
    return (struct.pack(">I4sQ", 1, kind, 16 + len(data)) if large else struct.pack(">I4s", 8 + len(data), kind)) + data


def times(data):
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    return video.track_times(read, len(data)), sum(asked)


def test_rates_of_headers():
    film = video.header(25_000, 250_000, [(200, 1000), (50, 1000)])
    assert times(film)[0] == (25.0, 10.0)
    assert times(video.header(600, 6_000_000_000_000, [(1, 1)], wide=True))[0] == pytest.approx((1e-10, 1e10))
    pictures = box(b"mdat", b"moov" * 300_000, large=True)
    found, read = times(box(b"ftyp", b"isom") + pictures + film)
    assert found == (25.0, 10.0) and read < 2000  # pictures are passed over
    sound = video.header(48_000, 48_000, [(47, 1024)], kind=b"soun")
    both = box(b"moov", sound[8:] + film[8:])
    assert times(both)[0] == (25.0, 10.0)


def test_what_is_no_recording():
    for data in (b"", b"short", b"\0" * 64, struct.pack(">I4s", 4, b"moov"), struct.pack(">I4s", 1, b"moov"), box(b"moov", b""), video.header(0, 0, []), video.header(25, 100, []), video.header(25, 100, [(100, 1)])[:-30], video.header(48, 48, [(1, 1)], kind=b"soun")):
        assert times(data)[0] is None


def test_blocks_at_rates_of_their_own(spark, tmp_path):
    for name, data in (("entry_1", video.header(1000, 10_000, [(250, 40)])), ("entry_2", video.header(1000, 10_000, [(300, 33)])), ("entry_3", b"broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "video.mp4").write_bytes(data)
    blocks = spark.createDataFrame([(f"entry_{i}", 2000) for i in range(1, 5)], "entry string, start_ms long")
    timed = video.with_rates(blocks, video.frame_rates(spark, f"{tmp_path}/*/video.mp4"))
    got = {r["entry"]: r["f"] for r in timed.select("entry", X.ms_to_frame("start_ms", timed["fps"]).alias("f")).collect()}
    assert got == {"entry_1": 50, "entry_2": 60, "entry_3": 100, "entry_4": 100}
