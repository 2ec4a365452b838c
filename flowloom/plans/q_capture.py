"""Queries: capture files and column contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.flows import missing_packet_fields
from ..schema import EXCLUDED, FEATURES, RAW_COLUMNS
from ..sources import captures as cap
from ..sources.tables import staging_dir
from . import mapping as m
from .registry import query


def _le(x, width):
    """Little-endian hex text of a whole number."""
    h = F.lpad(F.hex(x), width * 2, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in range(width - 1, -1, -1)])


def _be(x, width):
    return F.lpad(F.hex(x), width * 2, "0")


def capture_files(spark, d):
    """(capture, content): every packet of the table as a small capture file, built by Spark expressions."""
    p = m.packets(spark, d)
    us, size, thl = F.col("timestamp_us"), F.col("ip_total_len"), F.col("transport_header_len")
    ip_hex = lambda a: F.concat(*[_be(F.split(a, r"\.")[i].cast("int"), 1) for i in range(4)])
    ports = F.concat(_be(F.col("src_port"), 2), _be(F.col("dst_port"), 2))
    tcp = F.concat(ports, F.lit("00" * 8), _be(F.floor(thl / 4) * 16, 1), _be(F.col("tcp_flags"), 1), _be(F.col("tcp_window"), 2), F.lit("00" * 4),
                   F.repeat(F.lit("00"), thl - 20))
    udp = F.concat(ports, _be(F.col("payload_len") + 8, 2), F.lit("0000"))
    seg = F.when(F.col("protocol") == 6, tcp).when(F.col("protocol") == 17, udp).otherwise(F.lit(""))
    ip = F.concat(F.lit("4500"), _be(size, 2), F.lit("0000000040"), _be(F.col("protocol"), 1), F.lit("0000"), ip_hex("src_ip"), ip_hex("dst_ip"),
                  seg, F.repeat(F.lit("00"), F.col("payload_len")))
    frame = F.concat(F.lit("00" * 12 + "0800"), ip)
    n = (F.length(frame) / 2).cast("long")
    head = F.lit("d4c3b2a1020004000000000000000000ffff000001000000")
    text = F.concat(head, _le(F.floor(us / 1000000), 4), _le(us % 1000000, 4), _le(n, 4), _le(n, 4), frame)
    return p.select(F.col("index").cast("string").alias("capture"), F.unhex(text).alias("content"))


_FIELDS = ["timestamp_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ip_total_len", "ip_header_len", "transport_header_len",
           "payload_len", "tcp_flags", "tcp_window"]


@query("scan_pcap", f"""WITH {m.packets_sql()} SELECT CAST("index" AS VARCHAR) AS capture, {", ".join(_FIELDS)} FROM packets""")
def scan_pcap(spark, d):
    return cap.packets(cap.decode(capture_files(spark, d))).select("capture", *_FIELDS)


_FILES = "capture_no, count(*) AS frames, CAST(sum(ip_total_len) AS BIGINT) AS bytes, CAST(sum(payload_len) AS BIGINT) AS payload, min(timestamp_us) AS first_us, max(timestamp_us) AS last_us, count(tcp_flags) AS tcp"


@query("scan_pcap_files", f"""WITH {m.packets_sql()}, p AS (SELECT *, "index" // 500 AS capture_no FROM packets), good AS (SELECT {_FILES} FROM p GROUP BY 1),
n AS (SELECT DISTINCT capture_no FROM p)
SELECT good.*, CASE WHEN capture_no % 3 = 1 THEN 'record: header cut short' WHEN capture_no % 3 = 2 THEN 'record: data cut short' END AS reason FROM good JOIN n USING (capture_no)""")
def scan_pcap_files(spark, d):
    """Captures of many packets, stored and read back; a third ends in half a record header, a third in half a record."""
    one = capture_files(spark, d).select(F.col("capture").cast("long").alias("i"), F.col("content"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.hex(F.substring("content", 25, 1 << 20)).alias("x")))), lambda r: r["x"]), "")
    head = F.lit("d4c3b2a1020004000000000000000000ffff000001000000")
    tail = F.when(F.col("no") % 3 == 1, "0000000000000000ff").when(F.col("no") % 3 == 2, "000000000000000010000000100000000102").otherwise("")
    files = one.groupBy(F.floor(F.col("i") / 500).alias("no")).agg(body.alias("body")).select(
        F.unhex(F.concat(head, "body", tail)).alias("content"), "no")
    path = staging_dir(spark, "captures")
    files.select(F.concat(F.lit("capture-"), F.col("no").cast("string")).alias("capture"), "content").write.parquet(path)
    rows = cap.decode(spark.read.parquet(path)).withColumn("capture_no", F.element_at(F.split("capture", "-"), -1).cast("long"))
    good = cap.packets(rows).groupBy("capture_no").agg(F.count(F.lit(1)).alias("frames"), F.sum("ip_total_len").alias("bytes"), F.sum("payload_len").alias("payload"),
                                                       F.min("timestamp_us").alias("first_us"), F.max("timestamp_us").alias("last_us"), F.count("tcp_flags").alias("tcp"))
    bad = rows.where("reason IS NOT NULL").select("capture_no", "reason")
    return good.join(bad, "capture_no", "left")


@query("scan_pcap_ranges", f"""WITH {m.packets_sql()}, p AS (SELECT *, "index" // 500 AS capture_no, "index" % 500 // 250 AS part, "index" % 250 AS place FROM packets)
SELECT capture_no, part, {_FILES.split(", ", 1)[1]}, CAST(sum(place * ip_total_len) AS BIGINT) AS places FROM p GROUP BY 1, 2""")
def scan_pcap_ranges(spark, d):
    """Files of 250 packets read in ranges of 4 kB; two rotated files are one capture whose frames are numbered through."""
    one = capture_files(spark, d).select(F.col("capture").cast("long").alias("i"), F.hex(F.substring("content", 25, 1 << 20)).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]), "")
    head = F.lit("d4c3b2a1020004000000000000000000ffff000001000000")
    files = one.groupBy(F.floor(F.col("i") / 250).alias("no")).agg(body.alias("body")).select(
        F.format_string("link%d-%d.pcap", F.floor(F.col("no") / 2), F.col("no") % 2).alias("name"), F.unhex(F.concat(head, "body")).alias("content"))
    folder = staging_dir(spark, "pcap_files")
    cap.store_captures(files, folder)
    rows = cap.read_captures(spark, folder, link=F.regexp_extract("file", r"link(\d+)-\d+\.pcap$", 1), range_bytes=4096)
    part, place = F.floor(F.col("index") / cap.FILE_STEP), F.col("index") % cap.FILE_STEP
    return cap.packets(rows).groupBy(F.col("capture").cast("long").alias("capture_no"), part.alias("part")).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("ip_total_len").alias("bytes"), F.sum("payload_len").alias("payload"), F.min("timestamp_us").alias("first_us"),
        F.max("timestamp_us").alias("last_us"), F.count("tcp_flags").alias("tcp"), F.sum(place * F.col("ip_total_len")).alias("places"))


@query("scan_pcap_malformed", """SELECT CAST(doc_id AS VARCHAR) AS capture, 0 AS frame, CASE WHEN octet_length(encode(text)) < 14 THEN 'Truncated link header.'
ELSE 'No IPv4 layer present (e.g. ARP or other non-IP frame).' END AS reason FROM documents""")
def scan_pcap_malformed(spark, d):
    """Each document's whole text as the only frame of a capture: no frame is readable, none is lost."""
    body = F.encode("text", "UTF-8")
    size = _le(F.length(body), 4)
    head = F.lit("d4c3b2a1020004000000000000000000ffff000001000000" + "01000000" + "00000000")
    files = m.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("capture"), F.unhex(F.concat(head, size, size, F.hex(body))).alias("content"))
    return cap.malformed(cap.decode(files)).select("capture", F.col("index").cast("int").alias("frame"), "reason")


@query("contract_packet_fields", f"""WITH {m.packets_sql()} SELECT count(*) AS packets, count("index") AS "index", count(timestamp_us) AS timestamp_us, count(src_ip) AS src_ip, count(dst_ip) AS dst_ip,
count(protocol) AS protocol, count(src_port) AS src_port, count(dst_port) AS dst_port, count(tcp_flags) AS tcp_flags FROM packets""")
def contract_packet_fields(spark, d):
    """How many packets have each field; a table that lacks one fails."""
    p = m.packets(spark, d)
    gone = missing_packet_fields(p)
    if gone:
        raise ValueError(f"packet fields missing: {gone}")
    fields = ["index", "timestamp_us", "src_ip", "dst_ip", "protocol", "src_port", "dst_port", "tcp_flags"]
    return p.agg(F.count(F.lit(1)).alias("packets"), *[F.count(x).alias(x) for x in fields])


_PLAN = [*FEATURES, "Protocol", "Dst Port", "Timestamp", *EXCLUDED, "Label"]


@query("column_contract", f"""WITH {m.raw_text_sql(RAW_COLUMNS)}, h AS (SELECT * FROM rawt WHERE "Label" = 'Label'),
cell AS (UNPIVOT h ON COLUMNS(* EXCLUDE row_id) INTO NAME place VALUE v), n AS (SELECT row_id, count(*) AS cells, count(DISTINCT v) AS names, count(*) FILTER (WHERE v = place) AS planned FROM cell GROUP BY 1)
SELECT count(*) AS headers, count(*) FILTER (WHERE cells = 80 AND names = 80 AND planned = 80) AS covered, count(*) FILTER (WHERE planned < 80) AS incomplete FROM n""")
def column_contract(spark, d):
    """Header lines among the rows, held against the feature plan: each planned column must be there exactly once."""
    from .q_profile import _header_rows

    h = _header_rows(spark, d)
    plan = F.array(*[F.lit(x) for x in _PLAN])
    missing, surplus = F.size(F.array_except(plan, "cells")), F.size(F.array_except("cells", plan))
    exact = (missing == 0) & (surplus == 0) & (F.size("cells") == len(_PLAN))
    return h.agg(F.count(F.lit(1)).alias("headers"), F.count_if(exact).alias("covered"), F.count_if(missing > 0).alias("incomplete"))
