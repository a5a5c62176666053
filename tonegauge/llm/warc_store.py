"""Content-addressed WARC archive.

An archive is a folder of two tables.  ``payloads`` holds the bytes of each payload once, under its
SHA-256.  ``records`` holds one exact header per record (the WARC header fields and, for a response,
the HTTP head) and the payload's digest.  A record's bytes are its header, its payload (a revisit has
none) and two line ends; ``rebuild`` puts them together again by a join on the digest, and
``export_files`` writes them as standard ``.warc`` files through Spark's text sink.

Digests are checked, not trusted: writing compares size and SHA-1 of all payloads of one address, and
reading hashes every stored payload again and compares it with its address and with the size and digest
that the headers name; any difference, and a missing payload, fails the job.

Records of equal payloads of ``SMALL`` bytes or more: the one with the largest ``page_id`` is a response
and the others are revisits of it.  All smaller ones are responses (their bytes are stored once as well).

A payload may be shared by any part of all records.  Sizes and representatives come from aggregates
with map-side combine.  Payloads of more than a thousandth of all records (fewer than 1000, whatever
the data) meet their records by a broadcast of digests and numbers; the others by an ordinary join.

Defined results: a null html is an empty payload; a null url leaves the target field out; line ends and
percent signs in a url are percent-encoded in the header; a null ``page_id`` ranks below all others and
its record is named ``unknown``; records that repeat the largest ``page_id`` are all responses; if every
id of a payload is null they are responses too; no rows make an archive of two empty tables; further
columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegauge.llm.store import keep
from tonegauge.session import checkpoint_dir

SMALL = 1000
#: share of all records, as a divisor, from which a payload is matched by broadcast: at most so many are
_FEW = 1000
#: most places that one payload's bytes are copied to when records are rebuilt (64 uses each, more beyond)
_MOST_SALTS = 4096
DATE = "2000-01-01T00:00:00Z"
#: fixed values of the WARC 1.1 format
VERSION, END = "WARC/1.1", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("unknown")), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, null when ``value`` is null (``concat_ws`` leaves it out)."""
    return F.concat(F.lit(f"{name}: "), value)


def _header() -> Column:
    """The exact bytes before a record's payload, as text."""
    revisit = F.col("record_type") == "revisit"
    size = F.col("payload_bytes").cast("string")
    http = F.concat_ws(END, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), _field("Content-Length", size), F.lit(END))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    url = F.replace(F.replace(F.replace("url", F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = F.concat_ws(
        END, F.lit(VERSION), _field("WARC-Type", F.col("record_type")), _field("WARC-Record-ID", _uri(F.col("page_id"))), _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", url), _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, _field("WARC-Refers-To", _uri(F.col("refers_to")))), F.when(revisit, _field("WARC-Profile", F.lit(PROFILE))),
        F.lit("Content-Type: application/http; msgtype=response"), _field("Content-Length", block.cast("string")), F.lit(END))
    return F.concat(fields, http)


def _value(name: str) -> Column:
    """A field of the WARC part of ``header`` (no field holds a line end), null without it."""
    return F.when(F.contains("header", F.lit(f"{END}{name}: ")), F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1))


def _same(good: Column, what: str) -> Column:
    """True, or a failed job."""
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(what)).cast("boolean"))


def skewed_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, total: int, how: str) -> DataFrame:
    """``left`` joined to the narrow ``right`` (one row a key): keys of many rows by broadcast, the rest by shuffle.

    ``counts`` holds (key, n) of ``left``.  Fewer than ``_FEW`` keys can hold more than 1 / ``_FEW`` of ``total`` rows.
    """
    many = counts.filter(F.col("n") * _FEW > total).select(key)
    held = F.broadcast(right.join(F.broadcast(many), key, "left_semi"))
    light = left.join(F.broadcast(many), key, "left_anti").join(right, key, how)
    return left.join(F.broadcast(many), key, "left_semi").join(held, key, how).unionByName(light)


def write(pages: DataFrame, folder: str) -> None:
    """Writes ``pages`` (page_id, url, html) as an archive."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("address", F.unhex(F.sha2("payload", 256)))
    heads = keep(rows.select("page_id", "url", "address", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")), "heads")
    groups = heads.groupBy("address").agg(
        F.count("*").alias("n"), F.max("page_id").alias("first"), F.min("payload_bytes").alias("least"), F.max("payload_bytes").alias("most"),
        F.min("payload_digest").alias("low"), F.max("payload_digest").alias("high"))
    alike = (F.col("least") == F.col("most")) & (F.col("low") == F.col("high"))
    groups = keep(groups.withColumn("alike", _same(alike, "two payloads have one address")).filter("alike"), "addresses")
    # payloads of one record need no representative
    chosen = groups.filter((F.col("n") > 1) & (F.col("most") >= SMALL)).select("address", "first")
    records = skewed_join(heads, chosen, "address", groups, heads.count(), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    records = records.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("first")))
    records.select(_header().alias("header"), "address").write.parquet(f"{folder}/records")
    rows.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = spark.read.schema("header string, address binary").parquet(f"{folder}/records")
    return records, spark.read.schema("address binary, payload binary").parquet(f"{folder}/payloads")


def _checked(payloads: DataFrame) -> DataFrame:
    good = F.unhex(F.sha2("payload", 256)) == F.col("address")
    return payloads.withColumn("good", _same(good, "a stored payload does not have its address's digest")).filter("good").drop("good")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of all records, from headers and payloads."""
    records, payloads = _tables(spark, folder)
    facts = _checked(payloads).select("address", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    facts = keep(facts, "facts")
    counts = keep(records.groupBy("address").agg(F.count("*").alias("n")), "uses")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = skewed_join(records, facts, "address", counts, total, "left")
    named = rows.select(
        _value("WARC-Record-ID").alias("id"), _value("WARC-Target-URI").alias("url"), _value("WARC-Type").alias("record_type"), _value("WARC-Refers-To").alias("to"),
        _value("WARC-Payload-Digest").alias("digest"), F.regexp_extract("header", r"\r\n\r\nHTTP[\s\S]*\r\nContent-Length: (\d+)\r\n\r\n\z", 1).alias("size"),
        "payload_bytes", "payload_digest")
    good = F.col("digest").eqNullSafe(F.concat(F.lit("sha1:"), "payload_digest")) & F.col("size").eqNullSafe(F.col("payload_bytes").cast("string"))

    def number(column):
        return F.regexp_extract(column, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")

    url = F.replace(F.replace(F.replace("url", F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    return (named.withColumn("good", _same(good, "a header does not name its payload's size and digest")).filter("good")
            .select(number("id").alias("page_id"), url.alias("url"), "payload_bytes", "payload_digest", "record_type", number("to").alias("refers_to")))


def rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """(header, payload) of all records: the full payload also for revisits, whose own bytes have none.

    Bytes go to as many places as records use them.  A payload of very many records would send them all to
    one task, so each use is dealt to a salt and a payload is copied only to the salts its uses fill.
    """
    records, payloads = _tables(spark, folder)
    counts = records.groupBy("address").agg(F.count("*").alias("n"))
    sized = counts.select("address", F.least(F.ceil(F.col("n") / 64.0), F.lit(_MOST_SALTS)).cast("long").alias("salts"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    uses = skewed_join(records, sized, "address", counts, total, "left").withColumn("salt", F.pmod(F.xxhash64("header"), F.col("salts")))
    dealt = _checked(payloads).join(sized, "address").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return uses.join(dealt, ["address", "salt"], "left").select("header", "payload")


def export_files(spark: SparkSession, folder: str, out: str) -> None:
    """Writes the archive as standard WARC text files (one a task) into ``out``."""
    payload = F.when(F.col("header").startswith(f"{VERSION}{END}WARC-Type: revisit"), "").otherwise(F.decode("payload", "UTF-8"))
    rebuild(spark, folder).select(F.concat("header", payload).alias("value")).write.option("lineSep", END * 2).text(out)


def archived(pages: DataFrame) -> DataFrame:
    """``pages`` written as an archive in the shared folder and read back."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    write(pages, folder)
    return read(spark, folder)
