"""Capture files read by byte ranges, as streams, and written."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from aerolens.sources import captures
from aerolens.sources.captures import HEADER, CaptureFile, read_large_captures, stream_captures, write_captures


def capture(records, magic=0xA1B2C3D4, order="<", unit=1, longest=4096):
    out = struct.pack(f"{order}IHHiIII", 0xA1B2C3D4 if unit == 1 else 0xA1B23C4D, 2, 4, 0, 0, longest, 105)
    for us, raw in records:
        out += struct.pack(f"{order}IIII", us // 1_000_000, us % 1_000_000 * unit, len(raw), len(raw) + 2) + raw
    return out


def packets(n, seed=1):
    """Packets of every size and kind of payload: random, zeros, and captures of captures."""
    rng = random.Random(seed)
    inner = capture([(1_700_000_000_000_000 + i, b"x" * 40) for i in range(60)])
    kinds = [lambda: rng.randbytes(rng.randrange(1, 200)), lambda: b"\0" * rng.randrange(1, 4096), lambda: inner[:4096], lambda: inner[24 : 24 + rng.randrange(100, 3000)], lambda: b"\xff"]
    return [(1_700_000_000_000_000 + 1000 * i, rng.choice(kinds)()) for i in range(n)]


FORMS = {"plain": {}, "big endian": {"order": ">"}, "nanoseconds": {"unit": 1000}}


@pytest.mark.parametrize("form", FORMS)
def test_any_ranges_give_the_same_records(tmp_path, form):
    """Ranges of any size, most of them starting inside packets, give each record once."""
    given = packets(150)
    path = tmp_path / "a.pcap"
    for tail in (b"", b"cut", capture([(5, b"y" * 90)])[HEADER:-7]):
        path.write_bytes(capture(given, **FORMS[form]) + tail)
        file = CaptureFile(str(path), block=1 << 14)
        whole = [(t, raw) for _, t, _, raw in file.records(0, file.size)]
        assert whole == given
        for size in (37, 1000, 5000, 40_000, file.size):
            parts = [r for at in range(0, file.size, size) for r in file.records(at, min(at + size, file.size))]
            assert [(t, raw) for _, t, _, raw in parts] == given and len({p for p, *_ in parts}) == len(given)
        file.close()


def test_starts_are_found_from_every_byte(tmp_path):
    given = packets(40, 3)
    (tmp_path / "a.pcap").write_bytes(capture(given))
    file = CaptureFile(str(tmp_path / "a.pcap"))
    starts = [p for p, *_ in file.records(0, file.size)]
    for at in range(0, file.size, 7):
        assert file.next_record(at) == next((p for p in starts if p >= at), file.size)


def test_one_file_is_many_tasks(spark, tmp_path):
    given = packets(400)
    (tmp_path / "node1.pcap").write_bytes(capture(given) + b"cut off")
    (tmp_path / "node2.pcap").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"something else, longer than a header of a capture")
    df = read_large_captures(spark, str(tmp_path), split_bytes=20_000)
    assert df.rdd.getNumPartitions() > 10
    got = df.orderBy("frame_id").collect()
    assert [(r["ts_us"], bytes(r["raw"])) for r in got] == given and {r["length"] - len(r["raw"]) for r in got} == {2}
    tasks = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) > 5
    assert read_large_captures(spark, f"{tmp_path}/node2.pcap").collect() == []


def test_a_stream_follows_a_growing_file(spark, tmp_path):
    """Each whole record comes once, a half written one when it is whole, and a restart goes on where it stopped."""
    given = packets(60, 5)
    data = capture(given)
    (tmp_path / "in").mkdir()
    file = tmp_path / "in" / "a.pcap"

    def run():
        q = stream_captures(spark, f"{tmp_path}/in", split_bytes=9000).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [(r["ts_us"], bytes(r["raw"])) for r in spark.read.schema(captures.SCHEMA).parquet(f"{tmp_path}/out").orderBy("frame_id").collect()]

    seen = 0
    for size in (10, len(data) // 3, len(data) // 2 + 5, len(data)):
        file.write_bytes(data[:size])
        got = run()
        assert got == given[: len(got)] and len(got) >= seen
        seen = len(got)
    assert got == given
    (tmp_path / "in" / "b.pcap").write_bytes(data)
    assert sorted(run()) == sorted(given + given)


def test_written_captures_read_back(spark, tmp_path):
    given = [(t, 5, raw) for t, raw in packets(80)] + [(None, 5, b"z"), (7, 5, None), (2**40, None, b"w")]
    df = spark.createDataFrame(given, "ts_us long, length int, raw binary").repartition(3)
    files = write_captures(df, f"{tmp_path}/out", longest=4096).collect()
    back = read_large_captures(spark, f"{tmp_path}/out", split_bytes=5000).collect()
    assert sorted((r["ts_us"], bytes(r["raw"])) for r in back) == sorted((t, raw) for t, _, raw in given if t is not None and raw is not None)
    assert sum(f["packets"] for f in files) == 81 and all(r["length"] >= len(r["raw"]) for r in back)
