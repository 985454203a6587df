"""Scalar functions of the wireless domain as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the cipher set.
CIPHER_BITS = {"none": 0, "WEP": 1, "TKIP": 2, "CCMP": 4, "PSK": 8, "802.1X": 16, "vendor-specific": 256, "unknown": 512}


def frame_hash(raw: Column) -> Column:
    """A stable hash for grouping equal frames."""
    return F.xxhash64(raw)


def escape_ssid(ssid: Column) -> Column:
    """The name, or all of it in hex if any character is not printable or is a quote."""
    return F.when(ssid.rlike(r"[^\x20-\x21\x23-\x7E]"), F.hex(F.encode(ssid, "UTF-8"))).otherwise(ssid)


def visible_ssid(ssid: Column) -> Column:
    """A name of NULs only is a hidden network's empty name."""
    return F.when(ssid.rlike(r"^\x00*$"), F.lit("")).otherwise(ssid)


def addresses(direction: Column, a1: Column, a2: Column, a3: Column, a4: Column) -> dict[str, Column]:
    """Receiver, transmitter, source, destination and BSSID of a data or management frame by direction.

    0: neither DS bit, 1: to the DS, 2: from the DS, 3: both (no BSSID).
    """
    pick = lambda *c: F.when(direction == 0, c[0]).when(direction == 1, c[1]).when(direction == 2, c[2]).when(direction == 3, c[3])
    none = F.lit(None).cast("string")
    return {"ra": a1, "ta": a2, "sa": pick(a2, a2, a3, a4), "da": pick(a1, a3, a1, a3), "bssid": pick(a3, a1, a2, none)}


def cipher_bits(codes: Column, sum_repeats: bool = False) -> Column:
    """One number from an array of bits; the quirk adds repeated ones instead of joining them."""
    return F.aggregate(codes, F.lit(0), (lambda a, x: a + x) if sum_repeats else (lambda a, x: a.bitwiseOR(x)))


def cipher_names(bits: Column) -> Column:
    """The names of all bits set, joined by a comma; none for 0."""
    named = F.array(*(F.when(bits.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in CIPHER_BITS.items() if b))
    return F.when(bits == 0, F.lit("none")).otherwise(F.array_join(F.array_compact(named), ","))


#: Ports that web servers are known to use.
WEB_PORTS = (80, 3128, 8080, 8088)


def site_of_host(host: Column, ports: Sequence[int] = WEB_PORTS) -> Column:
    """The site of a host name: port cut off, the last two labels, three under co.xx and for the sites that differ by service.

    Null for addresses, names without a dot and ports that are none of the web's.
    """
    name = F.lower(F.regexp_extract(host, rf"^([^:]*)(?::0*(?:{'|'.join(map(str, ports))}))?$", 1))
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    three = name.rlike(r"\.co\.[a-z]{2}$") | name.rlike(r"(^|\.)(google|amazon|live)\.[a-z.]+$")
    bad = host.isNull() | (name == "") | (n < 2) | name.rlike(r"^[0-9.]+$")
    return F.when(~bad, F.when(three & (n >= 3), last(3)).otherwise(last(2)))


def user_sites(df: DataFrame, site: str, remap: DataFrame, blocked: DataFrame) -> DataFrame:
    """Rows of sites that people visit: a site that serves another one (remap: site, target) counts as that, blocked ones (site) go.

    Both lists are small and hold each site once; Spark broadcasts them by size.
    """
    named = df.join(remap.select(F.col("site").alias("_s"), "target"), F.col(site) == F.col("_s"), "left")
    moved = named.withColumn(site, F.coalesce("target", site)).drop("_s", "target")
    return moved.filter(F.col(site).isNotNull()).join(blocked.select(F.col("site").alias(site)), site, "left_anti").select(*df.columns)


def search_query(resource: Column, host: Column, least: int = 1) -> Column:
    """The first `q=term` (`p=term` at yahoo.com) of a url's query with so many characters of a term at least, else null."""
    find = lambda key: F.regexp_extract(resource, rf"[?&]({key}=([^&#]{{{least},}}))", 1)
    got = F.when(F.coalesce(host.contains("yahoo.com"), F.lit(False)), find("p")).otherwise(find("q"))
    return F.when(got != "", got)


def cookie_domain(headers: Column) -> Column:
    """The longest domain that a Set-Cookie header names, without leading dot; null if none."""
    found = F.regexp_extract_all(headers, F.lit(r"(?m)^Set-Cookie:[^\r\n]*?[;\s](?:domain|Domain|DOMAIN)=\.?([^\s;,]+)"), F.lit(1))
    best = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return F.get(best, F.lit(0))


def port_range(text: Column) -> Column:
    """struct(low, high) of `80` or `20-21`; both null for any other text."""
    one = r"^\s*(\d{1,5})\s*(?:-\s*(\d{1,5})\s*)?$"
    low, high = (F.regexp_extract(text, one, i).try_cast("int") for i in (1, 2))
    return F.struct(low.alias("low"), F.coalesce(high, low).alias("high"))


def is_multicast(mac: Column) -> Column:
    return F.conv(F.substring(mac, 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(1)) == 1


#: key, key=word or key="quoted words"
_PAIR = r'([^\s="]+)(?:=("[^"]*"|[^\s"]*))?'


def kv_map(text: Column, dashes: bool = False) -> Column:
    """MAP of a key=value text: quotes removed, a key alone has null, the last of equal keys counts; null for invalid text.

    dashes: underscores in keys become dashes.
    """
    t = F.trim(text)
    keys = F.regexp_extract_all(t, F.lit(_PAIR), F.lit(1))
    pairs = F.regexp_extract_all(t, F.lit(_PAIR), F.lit(0))
    value = lambda p: F.when(F.instr(p, "=") > 0, F.regexp_replace(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1), '^"|"$', ""))
    name = lambda k: F.translate(k, "_", "-") if dashes else k
    entries = F.zip_with(keys, pairs, lambda k, p: F.struct(name(k).alias("k"), value(p).alias("v")))
    # the last entry of each key, in order
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda later: later["k"] == e["k"]))
    valid = t.rlike(rf"^({_PAIR}(\s+|$))*$")
    return F.when(valid, F.map_from_entries(last))


def kv_field(text: Column, key: str) -> Column:
    """The value of one key of a key=value text, found without building the map; null where it is missing.

    As in kv_map the last of equal keys counts, quotes are removed and an
    underscore in the text stands for a dash of the key. What follows the key is
    not looked at.
    """
    name = "[-_]".join(re.escape(part) for part in re.split("[-_]", key))
    value = F.regexp_extract(text, rf'(?s)^(?:(?:[^\s="]++(?:=(?:"[^"]*+"|[^\s"]*+))?)?\s++)*{name}=("[^"]*"|[^\s"]*)', 1)
    return F.when(value != "", F.regexp_replace(value, '^"|"$', ""))


#: The valid pairs that a text begins with, and one pair more whatever follows it.
_BEGIN = r'(?s)^((?:(?:[^\s="]++(?:=(?:"[^"]*+"|[^\s"]*+))?)?\s++)*+(?:[^\s="]++=(?:"[^"]*"|[^\s"]*))?)'


def line_pairs(text: Column) -> Column:
    """The key=value pairs of a text as they stand, for pair_value; what kv_field would find, found once for all keys."""
    return F.regexp_extract_all(F.regexp_extract(text, _BEGIN, 1), F.lit(r'([^\s="]++=(?:"[^"]*+"|[^\s"]*+))'), F.lit(1))


def pair_value(pairs: Column, key: str) -> Column:
    """As kv_field on the text of the pairs: the last of equal keys, quotes removed, underscores as dashes; null where there is none."""
    own = F.filter(pairs, lambda p: F.translate(F.substring_index(p, "=", 1), "_", "-") == key.replace("_", "-"))
    value = F.substring(F.try_element_at(own, F.lit(-1)), len(key) + 2, 1 << 30)
    return F.when(value != "", F.regexp_replace(value, '^"|"$', ""))


def split_records(text: Column) -> Column:
    """The records of a line, separated by bars."""
    return F.transform(F.split(text, r"\|"), lambda x: F.trim(x))


def midpoint(a: Column, b: Column) -> Column:
    """Midpoint of two times in microseconds without overflow."""
    return F.least(a, b) + F.floor((F.greatest(a, b) - F.least(a, b)) / 2).cast("long")


def alert_fields(text: Column) -> dict[str, Column]:
    """Counts and ranges of a portscan alert; missing ones are -1 or null."""
    number = lambda label: F.coalesce(F.when(text.rlike(rf"(?m)^{label}:\s*\d+"), F.regexp_extract(text, rf"(?m)^{label}:\s*(\d+)", 1).cast("int")), F.lit(-1))
    between = lambda label: F.nullif(F.regexp_extract(text, rf"(?m)^{label}:\s*(\S+)", 1), F.lit(""))
    return {"priority_count": number("Priority Count"), "connection_count": number("Connection Count"), "ip_count": number("IP Count"), "ip_range": between("Scann?er IP Range"), "port_count": number("Port/Proto Count"), "port_range": between("Port/Proto Range")}


def human_bytes(n: Column) -> Column:
    """Bytes for people: 2 digits and a binary unit."""
    out = F.concat(F.format_number(n, 0), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.concat(F.format_number(n / 1024**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out


def geo_candidates(df: DataFrame, key: str = "bssid", ssid: str | None = None) -> DataFrame:
    """Geo results worth keeping: placed ones, of each network the infrastructure ones if any, else neither ad-hoc nor probe."""
    placed = df.filter("lat <> 0 or lon <> 0")
    if ssid is not None:
        placed = placed.filter(F.col("ssid") == ssid)
    any_infra = F.max(F.col("kind") == "infra").over(Window.partitionBy(key))
    return placed.withColumn("_any", any_infra).filter(F.when(F.col("_any"), F.col("kind") == "infra").otherwise(~F.col("kind").isin("adhoc", "probe"))).drop("_any")


def link(a: Column, b: Column) -> Column:
    """The two ends of a link in order."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
