"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing: payload digests are grouped; the smallest page_id of equal payloads is a response,
the others are revisits that name it. The payload is not shuffled: only (page_id, digest) is,
and the pages learn whether they are revisits from a join whose small side is counted first.
Spark's text writer, with the record terminator as line separator, gives the files.

Reading: Spark's text reader splits the files at the version line, so every task sees
candidate records at known byte offsets, true ones and ones inside payloads alike. Each
candidate states its successor's offset. Pointer jumping from offset 0 of each file, with
joins that double the jump in each round over runs of candidates that follow each other
without a gap, leaves the candidates on the chain; all others are payload bytes and are joined to the record that holds them.

Defined results: null html is an empty payload; a null page_id or url writes no such field
(page_id reads as null), and rows of null page_id are revisits of a non-null equal or else
responses; rows that repeat a page_id and payload are all responses where that id is the
smallest; line breaks in urls are percent-encoded; an empty table gives no record.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format.
MAGIC, CRLF, END = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD_PREFIX = "urn:seqforge:page:"
#: Records of one archive file at most.
MAX_RECORDS = 50_000


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: eight groups of five hexadecimal digits, each four base-32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), DIGITS32, BASE32)


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, refers_to of the pages whose payload an earlier page has; kept."""
    narrow = pages.select("page_id", payload_digest(_payload("html")).alias("digest"), F.octet_length(_payload("html")).alias("n"))
    narrow = narrow.where(F.col("n") >= min_bytes)
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    later = narrow.join(firsts, "digest").where("NOT page_id <=> refers_to AND refers_to IS NOT NULL")
    return common.cut(later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").distinct())


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html), F.lit("")).cast("binary")


def _field(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record for each row of ``pages`` (page_id, url, html), in text files under ``path``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", payload_digest(F.col("html").cast("binary")))
    again = common.sized(revisits(pages, min_bytes))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    rows = rows.withColumn("block", F.concat(http, F.when(is_revisit, F.lit("")).otherwise(F.col("html"))))
    urn = lambda c: F.concat(F.lit(f"<{RECORD_PREFIX}"), F.col(c).cast("string"), F.lit(">"))
    header = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF),
        _field("WARC-Record-ID", urn("page_id")),
        _field("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.lit(f"WARC-Date: {date}{CRLF}"),
        _field("WARC-Refers-To", urn("refers_to")),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}{CRLF}")).otherwise(F.lit("")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        F.octet_length("block").cast("string"),
        F.lit(END),
    )
    records = rows.select(F.concat(header, F.col("block")).alias("value"))
    records.write.option("lineSep", END).option("maxRecordsPerFile", MAX_RECORDS).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq (order in the block) and the raw text after each version line; seq and block order a file's chunks."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def _placed(chunks: DataFrame) -> DataFrame:
    """``start``: the offset of each chunk's version line in its file, from the bytes of the chunks before it; what stands before the first one is left out."""
    before = Window.partitionBy("file").orderBy("block", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # each chunk but the first stands after a version line
    place = F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(before), F.lit(0)) - len(MAGIC)
    return chunks.withColumn("start", place).where("start >= 0")


def _header(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("head"), rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row for each chunk: file, start (offset of its version line), next (offset of its successor), run and what its header says; kept.

    Candidates of a run follow each other without a gap: each names the next one as its successor.

    What stands before the first version line of a file is no candidate.
    """
    c = _chunks(spark, path).withColumn("split", F.instr("value", END))
    c = c.withColumn("head", F.when(F.col("split") > 0, F.substring_index("value", END, 1)))
    c = c.withColumn("body", F.expr("substring(value, split + 4)"))
    c = c.withColumn("content", F.expr(r"try_cast(regexp_extract(head, '(?i)(?:^|\\r\\n)Content-Length:[ \\t]*([0-9]+)', 1) AS bigint)"))
    whole = F.octet_length("body") >= F.col("content")
    payload = F.expr("substring(cast(body AS binary), 1, cast(content AS int))")
    c = c.withColumn("payload", F.when(whole, payload_of(payload)))
    narrow = c.select(
        "file",
        "block",
        "seq",
        F.octet_length("value").cast("long").alias("bytes"),
        (F.octet_length("head") + F.col("content") + len(MAGIC) + 2 * len(END)).alias("span"),
        "content",
        _header("WARC-Type").alias("record_type"),
        _header("WARC-Record-ID").alias("record_id"),
        _header("WARC-Refers-To").alias("refers"),
        _header("WARC-Payload-Digest").alias("stated"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        payload_digest(F.col("payload")).alias("payload_digest"),
    )
    placed = _placed(narrow).withColumn("next", F.col("start") + F.col("span"))
    order = Window.partitionBy("file").orderBy("start")
    broken = F.when(F.lag("next").over(order) == F.col("start"), 0).otherwise(1)
    return common.cut(placed.withColumn("run", F.sum(broken).over(order.rowsBetween(Window.unboundedPreceding, 0))))


def payload_of(block: Column) -> Column:
    """What follows the HTTP header of a binary block."""
    return F.substring(block, F.instr(F.decode(block, "ISO-8859-1"), END) + len(END), 2_147_483_647)


def reachable(found: DataFrame) -> DataFrame:
    """file, run, entry: the runs on the chain from offset 0 and where it enters them, by pointer jumping.

    A run is left at its last candidate only, so runs are the nodes; each round joins the
    reached ones with jumps of twice the length. A file without false candidates is one run.
    """
    runs = found.groupBy("file", "run").agg(F.max_by("next", "start").alias("start"))
    jump = runs.join(found.select("file", "start", F.col("run").alias("to")), ["file", "start"]).select("file", "run", "to", F.col("start").alias("entry"))
    jump = common.cut(jump)
    reached = common.cut(found.where("start = 0").select("file", "run", F.col("start").alias("entry")))
    most = runs.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(max(0, most - 1).bit_length()):
        ahead = reached.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        reached = common.cut(reached.unionByName(ahead).distinct())
        onward = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"), F.col("entry").alias("last"))
        jump = common.cut(jump.join(onward, ["file", "to"]).select("file", "run", F.col("far").alias("to"), F.col("last").alias("entry")))
    return reached


def read(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, refers, stated (digest), payload_bytes, payload_digest of every record on the chains (payload as stored)."""
    found = candidates(spark, path)
    marked = found.join(common.sized(reachable(found)), ["file", "run"], "left").withColumn("on_chain", F.coalesce(F.col("start") >= F.col("entry"), F.lit(False)))
    so_far = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("owner", F.last(F.when(F.col("on_chain"), F.col("start")), ignorenulls=True).over(so_far))
    fields = ["record_id", "record_type", "refers", "stated", "payload_bytes", "payload_digest"]
    parted = common.cut(owned.where("owner IS NOT NULL AND NOT on_chain").select("file", "owner").distinct())
    keys = ["file", "owner"]
    plain = owned.where("on_chain").select(*keys, "content", *fields).join(common.sized(parted), keys, "left_anti").select(*fields)
    if parted.isEmpty():
        return plain
    # records whose payload holds a version line: their chunks, put together again. They are found by their offset, which no split of the files changes
    places = owned.join(common.sized(parted), keys, "left_semi").select("file", "owner", "start", "content", *fields[:4])
    whole_files = common.cut(parted.select("file").distinct())
    chunks = _placed(_chunks(spark, path).join(common.sized(whole_files), "file", "left_semi").withColumn("bytes", F.octet_length("value").cast("long")))
    pieces = common.cut(places).join(chunks.select("file", "start", "value"), ["file", "start"])
    block = F.concat_ws(MAGIC, F.transform(F.sort_array(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]))
    first = [F.max(F.when(F.col("start") == F.col("owner"), F.col(f))).alias(f) for f in ("content", *fields[:4])]
    joined = pieces.groupBy(*keys).agg(block.alias("value"), *first)
    joined = joined.withColumn("payload", payload_of(F.expr(f"substring(cast(substring(value, instr(value, '{_sql(END)}') + 4) AS binary), 1, cast(content AS int))")))
    return plain.unionByName(joined.select(*fields[:4], F.octet_length("payload").cast("long").alias("payload_bytes"), payload_digest(F.col("payload")).alias("payload_digest")))


def _sql(text: str) -> str:
    return text.replace("\r", "\\r").replace("\n", "\\n")


def page_records(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` to a new archive folder, reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '{RECORD_PREFIX}(-?[0-9]+)', 1) AS bigint)")
    read_back = read(spark, path).withColumn("stated", F.regexp_replace("stated", "^sha1:", ""))
    records = common.cut(read_back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "stated", "record_type", number("refers").alias("refers_to")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'")
    # a revisit has the payload of the response that it names
    sources = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated"), F.col("payload_bytes").alias("b")).distinct()
    named = records.where("record_type = 'revisit'").join(sources, ["refers_to", "stated"], "left")
    named = named.withColumns({"payload_bytes": F.col("b"), "payload_digest": F.when(F.col("b").isNotNull(), F.col("stated"))})
    return responses.select(*columns).unionByName(named.select(*columns))
