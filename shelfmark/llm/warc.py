"""A content-addressed web archive.

`write_archive` makes a WARC record of every page and stores it in two tables: `payloads` holds the
bytes of each distinct payload once, under its SHA-256, and `heads` the exact header bytes of every
record (WARC fields, then the HTTP header). `read_records` joins the two back to whole records,
after the stored bytes have been digested anew: a payload whose digest, length or copies disagree
raises an error instead of being handed on. `read_pages` takes the records apart again.

Of records with equal payloads of at least `LEAST` bytes the one with the largest page id is the
response, and the others are revisits of it; smaller payloads are always responses. Null ids are
smaller than all others; ties go to the larger URL, then to the first of equal rows. Equal rows are
counted before they move and come back as often as they were given. A null html is an empty payload,
a null URL gives no target field, and control characters in a URL are percent-encoded. Very long
payloads move once to be stored and once to be read. Digests with a thousandth of all records or
more are met by a broadcast (there are at most a thousand of them), and small payloads that many
records share are dealt under several salts. An empty table gives an empty archive. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.work import keep

LEAST = 1000
#: Keys that hold at least this part of all rows are joined by a broadcast: its inverse bounds it.
HEAVY = 1000
#: Records that share one salt of a payload; copies of a row made at a time.
SHARE = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def _joined(rows: DataFrame, facts: DataFrame, key: str, count: str, total: Column) -> DataFrame:
    """`rows` with the one row of `facts` of each key, which says in `count` how many rows it meets.
    Keys with many rows go by a broadcast of at most `HEAVY` rows, all others by a shuffle."""
    often = F.col(count) * HEAVY >= total
    heavy = rows.join(F.broadcast(facts.filter(often).drop(count)), key)
    light = rows.join(F.broadcast(facts.filter(often).select(key)), key, "left_anti")
    return heavy.unionByName(light.join(facts.filter(~often).drop(count), key))


def _field(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def _safe(url: Column) -> Column:
    """The URL without characters that would end a header line."""
    for c in (*range(0x20), 0x7F):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return url


def _uuid(*parts: Column) -> Column:
    """A record id from what the record holds."""
    h = F.sha2(F.concat_ws("\x01", *[F.coalesce(p.cast("string"), F.lit("\x02")) for p in parts]),
               256)
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _heads(rows: DataFrame, date: str) -> DataFrame:
    """Each record's exact header bytes, from page_id, url, sha1, size, copy, first (the response's
    page_id, url) and revisit."""
    own = _uuid(F.col("page_id"), F.col("url"), F.col("sha1"), F.col("copy"))
    first = _uuid(F.col("first.page_id"), F.col("first.url"), F.col("sha1"), F.lit(1))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    _field("Content-Length", F.col("size")), F.lit("\r\n"))
    body = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("size"))
    again = F.col("revisit")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _field("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _field("WARC-Record-ID", own), _field("WARC-Date", F.lit(date)),
        _field("WARC-Target-URI", _safe(F.col("url"))),
        _field("WARC-Page-ID", F.col("page_id")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _field("WARC-Refers-To", F.when(again, first)),
        _field("WARC-Profile", F.when(again, F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", body), F.lit("\r\n"), http)
    return rows.select(F.encode(head, "UTF-8").alias("head"), "digest",
                       F.when(again, None).otherwise(
                           F.pmod(F.xxhash64("page_id", "url", "copy"), "salts")).cast("int")
                       .alias("salt"))


def write_archive(pages: DataFrame, path: str, date: str = DATE, id_col: str = "page_id",
                  url_col: str = "url", html_col: str = "html") -> None:
    """Write a record per row of `pages` to the archive at `path`."""
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        payload.alias("payload"))
    # Equal rows once with their number: what follows never holds a group of copies together.
    alike = keep(rows.select("page_id", "url", F.sha2("payload", 256).alias("digest"),
                             F.sha1("payload").alias("sha1"),
                             F.octet_length("payload").cast("bigint").alias("size"))
                 .groupBy("page_id", "url", "digest", "sha1", "size")
                 .agg(F.count(F.lit(1)).alias("copies")), "captures")
    facts = keep(alike.groupBy("digest").agg(
        F.max(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("met"),
        F.sum("copies").alias("records"), F.max("size").alias("bytes"))
        .withColumn("salts", F.when(F.col("bytes") >= LEAST, F.lit(1)).otherwise(
            F.ceil(F.col("records") / SHARE))), "digests")
    total = alike.agg(F.count(F.lit(1)).alias("n")).scalar()
    # Both extremes of the bytes under a digest: the store is verified where they are equal.
    bytes_of = rows.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(
        F.min("payload").alias("payload"), F.max(F.xxhash64("payload")).alias("_other"))
    clean = F.xxhash64("payload") == F.col("_other")
    stored = bytes_of.join(facts.select("digest", "salts", "bytes"), "digest")
    stored.select("digest", F.when(clean, F.col("payload")).otherwise(F.raise_error(
        F.concat(F.lit("two payloads under digest "), "digest"))).alias("payload"), "salts",
        "bytes").write.parquet(f"{path}/payloads")
    known = _joined(alike, facts.select("digest", "first", "met", "salts"), "digest", "met", total)
    some = known.withColumn("_lot", F.explode(F.sequence(
        F.lit(0), ((F.col("copies") - 1) / SHARE).cast("bigint"))))
    each = some.withColumn("copy", F.explode(F.sequence(
        F.col("_lot") * SHARE + 1, F.least("copies", (F.col("_lot") + 1) * SHARE))))
    responds = (F.col("size") < LEAST) | ((F.col("copy") == 1) & F.col("first").eqNullSafe(
        F.struct("page_id", "url")))
    _heads(each.withColumn("revisit", ~responds), date).write.parquet(f"{path}/heads")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive as they stand in a WARC file, without the two line ends after each:
    one column `record`. Stored payloads are verified first."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("digest")) & (
        F.octet_length("payload") == F.col("bytes"))
    stored = stored.select("digest", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1))
                           .alias("salt"), F.when(sound, F.col("payload")).otherwise(F.raise_error(
                               F.concat(F.lit("damaged payload "), "digest"))).alias("payload"))
    heads = spark.read.parquet(f"{path}/heads")
    revisits = heads.filter(F.col("salt").isNull()).select(F.col("head").alias("record"))
    # A record without its payload must not vanish: the left side is kept, and missing bytes raise.
    whole = heads.filter(F.col("salt").isNotNull()).join(stored, ["digest", "salt"], "left")
    body = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(
        F.concat(F.lit("no payload "), "digest")))
    return revisits.unionByName(whole.select(F.concat("head", body).alias("record")))


PARSED = ("record_type string, record_id string, refers_to_id string, page_id string, url string, "
          "digest string, bytes bigint, payload binary")


def _fields(head: bytes) -> dict[str, str]:
    """The named fields of a WARC or HTTP header."""
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines if x)}


def parse_record(record: bytes) -> tuple[str | None, ...]:
    """A record's values in the order of `PARSED`. `bytes` is the HTTP header's length of the
    payload, which a revisit keeps; its own payload is none. Raises where lengths disagree."""
    end = record.index(END) + len(END)
    warc = _fields(record[:end])
    body = record[end:]
    if int(warc["content-length"]) != len(body):
        raise ValueError(f"record {warc['warc-record-id']} has not its length")
    split = body.index(END) + len(END)
    http, payload = _fields(body[:split]), body[split:]
    digest = warc["warc-payload-digest"].removeprefix("sha1:")
    size = int(http["content-length"])
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {warc['warc-record-id']} has not its payload")
    return (warc["warc-type"], warc["warc-record-id"], warc.get("warc-refers-to"),
            warc.get("warc-page-id"), warc.get("warc-target-uri"), digest, size,
            None if revisit else payload)


def parse_records(records: DataFrame) -> DataFrame:
    """The values of each record; see `parse_record`."""
    names = [x.split(" ")[0] for x in PARSED.split(", ")]
    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_record(x) for x in batch.column(0).to_pylist()]
            columns = zip(*found, strict=True) if found else [[] for _ in names]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return records.mapInArrow(run, PARSED)


def read_pages(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every page of an archive: page_id (as text), url, payload_bytes, payload_digest, record_type,
    refers_to (page id of the response that a revisit names), and the payload if asked for. A
    revisit gets what it lacks from the record it names; one that names none raises an error."""
    found = parse_records(read_records(spark, path))
    found = keep(found if with_payload else found.drop("payload"), "records")
    response = found.filter("record_type = 'response'")
    named = ["payload"] if with_payload else []
    own = response.select(
        "page_id", "url", F.col("bytes").alias("payload_bytes"), F.col("digest").alias(
            "payload_digest"), "record_type", F.lit(None).cast("string").alias("refers_to"), *named)
    again = found.filter("record_type = 'revisit'").select(
        "page_id", "url", "record_type", "digest", "bytes", F.col("refers_to_id").alias("key"))
    met = again.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
    total = again.agg(F.count(F.lit(1)).alias("n")).scalar()
    facts = keep(met.join(response.select(
        F.col("record_id").alias("key"), F.col("page_id").alias("refers_to"),
        F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.lit(True).alias("there")), "key", "left").withColumn(
            "salts", F.ceil(F.col("met") / SHARE)), "named")
    back = _joined(again, facts, "key", "met", total)
    right = F.col("there") & (F.col("bytes") == F.col("payload_bytes")) & (
        F.col("digest") == F.col("payload_digest"))
    back = back.withColumn("record_type", F.when(right, F.col("record_type")).otherwise(
        F.raise_error(F.concat(F.lit("no such response: "), "key"))))
    if with_payload:
        dealt = facts.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                         F.col("salts") - 1)).alias("salt"))
        bodies = dealt.join(response.select(F.col("record_id").alias("key"), "payload"), "key")
        back = back.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), "salts")).join(
            bodies, ["key", "salt"])
    return own.unionByName(back.select(*own.columns))


def write_files(records: DataFrame, folder: str, per_file: int = 50_000) -> None:
    """The records as .warc text files, each record followed by two line ends."""
    records.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").option(
        "maxRecordsPerFile", per_file).text(folder)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the .warc files in a folder. A file is held whole by one task, so its size is
    bounded by `per_file` of the writer; records are found by their lengths, whatever they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data, at, out = batch.column(0)[i].as_py(), 0, []
                while at < len(data):
                    start = data.index(END, at) + len(END)
                    end = start + int(_fields(data[at:start])["content-length"])
                    out.append(data[at:end])
                    at = end + len(END)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return (spark.read.format("binaryFile").load(folder).select("content")
            .mapInArrow(run, "record binary"))
