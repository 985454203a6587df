"""Capture files: a Python data source that decodes 802.11 frames, and the sinks of results."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import date, datetime, timedelta, timezone

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKETS = "path string, frame_id long, ts_us long, length int, raw binary"
DECODED = "ftype int, fsubtype int, dir int, retry boolean, protected boolean, seq int, ra string, ta string, sa string, da string, bssid string, ssid string, bcn_int int, adv_channel int, cipher_bits int, ethertype int, tags array<int>, bad_ciphers boolean, group_cipher int, ibss boolean, tid int, version int"


#: The first number of a capture file tells byte order and units a microsecond.
MAGICS = {0xA1B2C3D4: ("<", 1), 0xD4C3B2A1: (">", 1), 0xA1B23C4D: ("<", 1000), 0x4D3CB2A1: (">", 1000)}
#: Ciphers and key managements by their codes, as bits of the cipher set; unknown ones and those of other vendors.
CIPHERS, KEYS, UNKNOWN, VENDOR = {1: 1, 2: 2, 4: 4, 5: 1}, {1: 16, 2: 8}, 512, 256
RSN, WPA = bytes([0x00, 0x0F, 0xAC]), bytes([0x00, 0x50, 0xF2])


def packets_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(time in us, original length, bytes) of each record of a capture file; none of a file of another kind."""
    if len(data) < 24:
        return
    magic = struct.unpack_from("<I", data)[0]
    if magic not in MAGICS:
        return
    order, unit = MAGICS[magic]
    at = 24
    while at + 16 <= len(data):
        sec, frac, kept, whole = struct.unpack_from(f"{order}IIII", data, at)
        if at + 16 + kept > len(data):
            return
        yield sec * 1_000_000 + frac // unit, whole, data[at + 16 : at + 16 + kept]
        at += 16 + kept


def read_captures(spark: SparkSession, path: str, limit: int | None = None, keep: float = 1.0, seed: int = 1) -> DataFrame:
    """Records of all capture files under a path, read by Spark; keep is the share of a random sample."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, n, t, size, raw) for n, (t, size, raw) in enumerate(packets_of(bytes(content)))]
                yield pd.DataFrame(rows, columns=["path", "frame_id", "ts_us", "length", "raw"])

    out = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(split, PACKETS)
    out = out if keep >= 1 else out.sample(keep, seed)
    return out if limit is None else out.limit(limit)


def elements(raw: bytes, at: int) -> tuple[list[tuple[int, bytes]], list[int]]:
    """(tag and body of each whole information element from a place on, the tags of all, a last one cut off included)."""
    found, tags = [], []
    while at + 2 <= len(raw):
        tag, size = raw[at], raw[at + 1]
        tags.append(tag)
        body = raw[at + 2 : at + 2 + size]
        if len(body) == size:
            found.append((tag, body))
        at += 2 + size
    return found, tags


def suite_bits(body: bytes, oui: bytes) -> tuple[int, int] | None:
    """(group cipher, bits of the pairwise ciphers and the key managements) of an RSN or WPA element; null if it is malformed."""
    if len(body) < 8 or body[:2] != b"\x01\x00":
        return None
    group = CIPHERS.get(body[5], UNKNOWN) if body[2:5] == oui else VENDOR
    bits, at = 0, 6
    for codes, same in ((CIPHERS, group), (KEYS, UNKNOWN)):
        if at + 2 > len(body):
            break
        n = struct.unpack_from("<H", body, at)[0]
        at += 2
        if at + 4 * n > len(body):
            return None
        for k in range(n):
            suite = body[at + 4 * k : at + 4 * k + 4]
            bits |= VENDOR if suite[:3] != oui else same if suite[3] == 0 else codes.get(suite[3], UNKNOWN)
        at += 4 * n
    return group, bits


def network_ciphers(capability: int, found: list[tuple[int, bytes]]) -> tuple[int, int, bool]:
    """(group cipher, other cipher bits of a beacon or probe response, whether an element of ciphers is malformed).

    Without the privacy bit there are none and nothing is malformed. RSN comes
    before WPA; a private network that names neither, or both badly, has WEP with
    a shared key.
    """
    if not capability & 16:
        return 0, 0, False
    absent = (0, 0)
    rsn = next((suite_bits(body, RSN) for tag, body in found if tag == 48), absent)
    wpa = next((suite_bits(body[4:], WPA) for tag, body in found if tag == 221 and body[:4] == WPA + b"\x01"), absent)
    group, bits = next((x for x in (rsn, wpa) if x and x != absent), (CIPHERS[1], CIPHERS[1] | KEYS[2]))
    return group, bits, rsn is None or wpa is None


#: Bytes of fixed fields before the elements of management frames by subtype: fixed values.
FIXED_FIELDS = {0: 4, 1: 6, 2: 10, 3: 6, 4: 0, 5: 12, 8: 12}


def decode(raw: bytes) -> tuple:
    """Typed fields of one frame; addresses follow the direction bits, a frame with both has no BSSID.

    A frame too short for its header has the fields that are there.
    """
    if len(raw) < 2:
        return (None,) * len(FIELDS)
    fc, flags = raw[0], raw[1]
    ftype, sub, direction = fc >> 2 & 3, fc >> 4, flags & 3
    got = {"ftype": ftype, "fsubtype": sub, "dir": direction, "retry": bool(flags & 8), "protected": bool(flags & 0x40), "version": fc & 3}
    mac = lambda k: ":".join(f"{b:02x}" for b in raw[k : k + 6]) if len(raw) >= k + 6 else None
    a1, a2, a3 = mac(4), mac(10), mac(16)
    got["ra"] = a1
    if ftype == 1:
        got |= {"ta": a2 if sub in (8, 9, 10, 11) else None, "bssid": a1 if sub == 10 else None}
        return tuple(got.get(f) for f in FIELDS)
    seq = struct.unpack_from("<H", raw, 22)[0] >> 4 if len(raw) >= 24 else None
    a4 = mac(24) if direction == 3 else None
    sa, da, bssid = {0: (a2, a1, a3), 1: (a2, a3, a1), 2: (a3, a1, a2), 3: (a4, a3, None)}[direction]
    got |= {"seq": seq, "ta": a2, "sa": sa, "da": da, "bssid": bssid}
    if ftype == 0 and sub in FIXED_FIELDS and not got["protected"]:
        start = 24 + FIXED_FIELDS[sub]
        found, got["tags"] = elements(raw, start)
        if sub in (4, 5, 8):
            got["ssid"] = next((body.decode("latin-1") for t, body in found if t == 0), None)
            got["adv_channel"] = next((body[0] for t, body in found if t == 3 and len(body) == 1), None)
        if sub in (5, 8) and len(raw) >= start:
            got["bcn_int"], capability = struct.unpack_from("<HH", raw, 32)
            got["ibss"] = bool(capability & 2)
            got["group_cipher"], got["cipher_bits"], got["bad_ciphers"] = network_ciphers(capability, found)
    if ftype == 2:
        body = 24 + 6 * (direction == 3)
        if sub & 8:
            got["tid"] = raw[body] & 15 if len(raw) > body else None
            body += 2
        if not sub & 4 and not got["protected"] and raw[body : body + 6] == b"\xaa\xaa\x03\0\0\0" and len(raw) >= body + 8:
            got["ethertype"] = struct.unpack_from(">H", raw, body + 6)[0]
    return tuple(got.get(f) for f in FIELDS)


#: The decoded fields in the order of decode.
FIELDS = [f.split()[0] for f in DECODED.split(", ")]


def decode_frames(packets: DataFrame) -> DataFrame:
    """Packets with their typed fields."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packets.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fields = pd.DataFrame([decode(bytes(r)) for r in batch["raw"]], columns=FIELDS, index=batch.index, dtype=object)
            yield pd.concat([batch, fields], axis=1)

    return packets.mapInPandas(run, f"{schema}, {DECODED}")


def set_sniffer(df: DataFrame, sniffer_id: int | None = None, channel: int | None = None, pattern: str = r"node(\d+)") -> DataFrame:
    """Stamp a constant sniffer and channel; without a sniffer it is read off the file's path."""
    sniffer = F.lit(sniffer_id) if sniffer_id is not None else F.regexp_extract("path", pattern, 1).try_cast("int")
    return df.withColumn("sniffer_id", sniffer).withColumn("channel", F.lit(channel or 0))


def write_daily(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Frames in one folder a day."""
    df.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").parquet(path)


def write_routed(df: DataFrame, path: str, route: str = "route") -> None:
    """Rows in one folder a route, as `filters.route` names them; a route with most rows is still written by many tasks."""
    df.write.mode("append").partitionBy(route).parquet(path)


def prune_daily(spark: SparkSession, path: str, keep_from: str) -> DataFrame:
    """The days on or after keep_from; the partition filter reads no older folder."""
    return spark.read.parquet(path).filter(F.col("date") >= F.lit(keep_from).cast("date"))


def expire_daily(path: str, keep_days: int, today: date | None = None, dry_run: bool = True) -> list[str]:
    """The days whose folders are keep_days old or more, oldest first; they are deleted unless it is a dry run.

    A job of its own, beside the writers: today's folder and later ones are never
    touched, nor is anything but folders of days. The days of a table are few.
    """
    if keep_days < 1:
        raise ValueError("today's folder is kept at least")
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    limit = (today or datetime.now(timezone.utc).date()) - timedelta(days=keep_days)
    days = {}
    for info in system.get_file_info(fs.FileSelector(inner)):
        if info.type == fs.FileType.Directory and (m := re.fullmatch(r"date=(\d{4}-\d{2}-\d{2})", info.base_name)):
            days[m[1]] = info.path
    old = sorted(d for d in days if date.fromisoformat(d) <= limit)
    if not dry_run:
        for d in old:
            system.delete_dir(days[d])
    return old


def write_hourly_logs(entries: DataFrame, path: str, least: int = 2) -> None:
    """Entries of level rank `least` and up, one folder a day and hour."""
    line = F.concat_ws(" ", F.date_format("ts", "MMM dd HH:mm:ss.SSS"), "source", "level", "data")
    entries.filter(F.col("level_rank") >= least).select(line.alias("value"), F.to_date("ts").alias("date"), F.hour("ts").alias("hour")).write.mode("append").partitionBy("date", "hour").text(path)


def upsert(current: DataFrame | None, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key after the changes, to be written beside the old table."""
    both = changes if current is None else current.unionByName(changes)
    fields = [c for c in both.columns if c not in (key,)]
    return both.groupBy(key).agg(F.max_by(F.struct(*fields), version).alias("v")).select(key, "v.*")


def write_jdbc(df: DataFrame, url: str, table: str, **properties: str) -> None:
    """Append to a table of a database."""
    df.write.jdbc(url, table, mode="append", properties=properties)
