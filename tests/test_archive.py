import lzma
import random

import pytest
from helpers import at, record, rows, write_hour
from pyspark.sql import functions as F

from quotemill import decode_archive, explode_batches, file_status, land_archive, list_archive, read_archive
from quotemill.queries.fixture_archive import write_archive
from quotemill.schemas import RAW_TICKS
from quotemill.sources import archive as archive_module
from quotemill.sources.archive import ArchiveFault, filesystem, inflate, spread_files, whole_records

GOOD = "EURUSD/2024/00/15/12h_ticks.bi5"


def test_two_records_in_file_order(spark, tmp_path):
    write_hour(tmp_path, GOOD, record(0, 110010, 110000, 1.5, 2.5) + record(1000, 4_294_967_295, 110001))
    got = rows(read_archive(spark, str(tmp_path)).withColumn("hour", F.col("hour").cast("string")), "seq")
    assert got == [
        ("eurusd", "2024-01-15 12:00:00", 0, 0, 110010, 110000, 1.5, 2.5),
        ("eurusd", "2024-01-15 12:00:00", 1, 1000, 4294967295, 110001, 1.0, 2.0),
    ]


FAULTY = {
    "EURUSD/2024/00/15/13h_ticks.bi5": (b"x" * 25, True, "invalid data length: 25"),
    "EURUSD/2024/00/15/14h_ticks.bi5": (b"", False, "empty input"),
    "EURUSD/2024/00/15/15h_ticks.bi5": (b"\0\1\2\3", False, "LZMA error"),
    "EURUSD/2024/00/15/16h_ticks.bi5": (
        lzma.compress(record(0, 1, 1) * 500, format=lzma.FORMAT_ALONE)[:-12],
        False,
        "LZMA error",
    ),
}


@pytest.mark.parametrize("path", list(FAULTY))
def test_strict_reading_fails(spark, tmp_path, path):
    write_hour(tmp_path, GOOD, record(0, 1, 1))
    payload, compress, message = FAULTY[path]
    write_hour(tmp_path, path, payload, compress)
    with pytest.raises(Exception, match=message):
        read_archive(spark, str(tmp_path)).collect()


@pytest.fixture
def damaged(tmp_path):
    write_hour(tmp_path, GOOD, record(0, 1, 1) + record(5, 2, 2))
    write_hour(tmp_path, "EURUSD/2024/00/15/17h_ticks.bi5", b"")  # no record, but a valid file
    for path, (payload, compress, _) in FAULTY.items():
        write_hour(tmp_path, path, payload, compress)
    write_hour(tmp_path, "EURUSD/2024/00/15/notes.txt", b"", False)
    write_hour(tmp_path, "EURUSD/2024/12/15/12h_ticks.bi5", b"", False)  # no such month
    return str(tmp_path)


def wanted(spark):
    hours = [(h, f"EURUSD/2024/00/15/{h}h_ticks.bi5") for h in range(12, 19)]
    return spark.createDataFrame(
        [("eurusd", at(f"2024-01-15 {h}:00:00"), path) for h, path in hours],
        "instrument string, hour timestamp, path string",
    )


def test_resilient_reading_skips_whole_hours(spark, damaged):
    assert read_archive(spark, damaged, "skip").count() == 2
    assert read_archive(spark, damaged, "skip", wanted(spark)).count() == 2


def test_file_status(spark, damaged):
    status = file_status(spark, damaged, wanted(spark))
    got = rows(status.select(F.hour("hour"), "status", "n_ticks", F.col("error").isNotNull()))
    assert got == [
        (12, "ok", 2, False),
        (13, "error", 0, True),
        (14, "error", 0, True),
        (15, "error", 0, True),
        (16, "error", 0, True),
        (17, "empty", 0, False),
        (18, "no_data", 0, False),
    ]


def test_listing_shows_zero_length_files(spark, damaged):
    listed = list_archive(spark, damaged)
    assert rows(listed.select(F.hour("hour"), F.col("length") == 0)) == [
        (12, False),
        (13, False),
        (14, True),
        (15, False),
        (16, False),
        (17, False),
    ]


def test_landing_decodes_once(spark, damaged, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("landed") / "table")
    raw, statuses = land_archive(spark, damaged, out, manifest=wanted(spark))
    assert raw.count() == 2 and raw.schema == RAW_TICKS
    assert statuses.count() == 7


def test_policy_name(spark, damaged):
    with pytest.raises(ValueError, match="on_error"):
        decode_archive(wanted(spark), damaged, "ignore")


def test_pieces_of_any_size():
    payload = b"".join(record(i, i, i) for i in range(1000))
    packed = lzma.compress(payload, format=lzma.FORMAT_ALONE)
    rng = random.Random(3)
    chunks, at_ = [], 0
    while at_ < len(packed):
        step = rng.randrange(1, 300)
        chunks.append(packed[at_ : at_ + step])
        at_ += step
    assert b"".join(inflate(chunks)) == payload
    sizes = [payload[i : i + 33] for i in range(0, len(payload), 33)]
    assert sum(len(part) for part in whole_records(sizes)) == 1000
    with pytest.raises(ArchiveFault, match="20003 bytes"):
        list(whole_records([payload, b"abc"]))


@pytest.mark.parametrize("tail", [b"", b"bad"])
def test_large_files_are_streamed(tmp_path, monkeypatch, tail):
    """A file over the limits is read twice in chunks, and gives all records or none."""
    monkeypatch.setattr(archive_module, "WHOLE_FILE_BYTES", 64)
    monkeypatch.setattr(archive_module, "CHUNK_BYTES", 50)
    rng = random.Random(5)
    payload = b"".join(record(rng.randrange(3_600_000), rng.randrange(9**9), i) for i in range(500))
    write_hour(tmp_path, GOOD, payload + tail)
    store, base = filesystem(str(tmp_path))
    file = archive_module._HourFile(store, f"{base}/{GOOD}")
    assert file._data is None
    if tail:
        with pytest.raises(ArchiveFault):
            archive_module._read_hour(file)
        return
    n, parts = archive_module._read_hour(file)
    assert n == 500 and not isinstance(parts, list)
    assert [int(v) for part in parts for v in part["bid"]] == list(range(500))


def test_trailing_bytes_after_the_stream_are_ignored():
    packed = lzma.compress(record(0, 1, 1), format=lzma.FORMAT_ALONE)
    assert b"".join(inflate([packed + b"more"])) == record(0, 1, 1)


def test_round_trip(spark, tmp_path):
    rng = random.Random(11)
    data = []
    for hour in range(30):
        stamp = at(f"2024-02-{1 + hour // 24:02d} {hour % 24:02d}:00:00")
        times = sorted(rng.randrange(3_600_000) for _ in range(rng.randrange(1, 40)))
        data += [
            ("gbpusd", stamp, i, ms, rng.randrange(1 << 32), rng.randrange(1 << 32), rng.randrange(64) / 8, 0.25)
            for i, ms in enumerate(times)
        ]
    frame = spark.createDataFrame(data, RAW_TICKS)
    assert write_archive(frame, str(tmp_path)) == 30
    assert rows(read_archive(spark, str(tmp_path))) == rows(frame)


def test_every_file_row_is_spread_by_its_count(spark, tmp_path):
    files = wanted(spark)
    assert spread_files(files).rdd.getNumPartitions() == 4
    assert spread_files(files, 11).rdd.getNumPartitions() == 11


def test_root_names():
    assert filesystem("/a/b/")[1] == "/a/b"
    assert filesystem("file:/a/b")[1] == "/a/b"
    assert filesystem("file:///a/b")[1] == "/a/b"


def test_explode_batches(spark):
    schema = "instrument string, hour timestamp, ticks array<struct<ms_offset bigint, ask_raw bigint>>"
    frame = spark.createDataFrame(
        [("a", at("2024-01-01"), [(1, 10), (2, 20)]), ("a", at("2024-01-01 01:00:00"), []), ("b", at("2024-01-01"), None)],
        schema.replace("ms_offset bigint", "ms_offset: bigint").replace("ask_raw bigint", "ask_raw: bigint"),
    )
    assert rows(explode_batches(frame).select("instrument", "ms_offset", "ask_raw")) == [("a", 1, 10), ("a", 2, 20)]


class Flaky:
    """A store whose reads of one file fail at given openings."""

    def __init__(self, path, refused):
        self.path, self.refused, self.opened = path, refused, 0

    def open_input_file(self, _):
        self.opened += 1
        if self.opened in self.refused:
            raise OSError("storage is away")
        return filesystem("/")[0].open_input_file(self.path)


@pytest.fixture
def large(tmp_path, monkeypatch):
    """A file that counts as large, and whose records do not all fit the first pass."""
    write_hour(tmp_path, GOOD, b"".join(record(i, i, i) for i in range(5000)))
    monkeypatch.setattr(archive_module, "WHOLE_FILE_BYTES", 1000)
    monkeypatch.setattr(archive_module, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(archive_module, "PAUSES", (0, 0))
    return str(tmp_path / GOOD)


def test_the_second_pass_of_a_large_file_needs_no_storage(large):
    store = Flaky(large, {3, 4, 5, 6})
    n, parts = archive_module._read_hour(archive_module._HourFile(store, large))
    assert n == 5000 and store.opened == 2
    assert [int(ms) for part in parts for ms in part["ms"]] == list(range(5000)) and store.opened == 2


def test_the_second_pass_of_a_huge_file_goes_on_after_an_error(large, monkeypatch):
    monkeypatch.setattr(archive_module, "HELD_BYTES", 0)
    store = Flaky(large, {3, 4})
    n, parts = archive_module._read_hour(archive_module._HourFile(store, large))
    assert [int(ms) for part in parts for ms in part["ms"]] == list(range(5000)) and store.opened == 5
    store = Flaky(large, {3, 4, 5})
    with pytest.raises(OSError, match="away"):
        list(archive_module._read_hour(archive_module._HourFile(store, large))[1])
