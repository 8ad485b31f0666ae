"""WARC archives: written through Spark's text writer, read back by boundary-chain verification.

Writing.  A record is a string whose last bytes, the blank lines between
records, are the writer's line separator; so archives are plain files of
records, written by all tasks to the shared folder.  Of equal payloads the one
with the smallest page_id is a response, the others revisit it.

Reading.  Archives are split on the magic that opens a record, so any task can
start anywhere; but payloads may hold the magic too.  Each task emits, for
every segment it finds, where it starts within its split and, if it reads as a
record, where its successor would start.  Pointer jumping then keeps what is
reachable from the file's start: within a split by doubling over arrays, across
splits by doubling joins over the few entries of splits.  What is not reached
is magic inside a payload and goes back to the record around it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notefold.llm.common import cut, lean, new_path, small_batches

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Fixed values of the format: the alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: each 5 hex digits are 4 of base 32."""
    fives = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, record: each page as a record without its final blank lines."""
    page = pages.select(pages["page_id"].cast("long").alias("page_id"), F.coalesce(pages["url"], F.lit("")).alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    slim = cut(page.select("page_id", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size"), F.xxhash64("html").alias("chk")), "payloads")
    first = cut(slim.where(F.col("size") >= least).groupBy("digest", "size", "chk").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    key = ["page_id", "digest", "size", "chk"]  # a page_id may repeat with another payload
    refers = cut(slim.join(first, key[1:]).where("page_id <> first").select(*key, "first").distinct(), "revisits")
    page = page.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long"), "chk": F.xxhash64("html")}).join(refers, key, "left")
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("digest")), F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    return page.select("page_id", F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write a record for each page to archives in the folder at path."""
    records(pages, least).select("record").write.option("lineSep", END).text(path)


_SEGMENT = "file string, at long, rel long, len long, seq long, succ long, exit long, last long, head string, http string, digest string, body string"


@lean
def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of segments within their split, successors of candidates, and where the chain from each leaves the split.

    Rows come in the order of the file; a task may hold several splits.
    Successors are relative to the split's first segment; exit is where the
    chain from a candidate first passes the split's end (-1: it meets no
    candidate), last the record before that.
    """

    def done(t: pa.Table) -> pa.RecordBatch:
        n = t["len"].to_numpy().copy()
        if t["at"][0].as_py() == 0 and n[0] == len(MAGIC):
            n[0] = 0  # before the magic that a file starts with lies nothing
        rel, total = np.cumsum(n) - n, int(n.sum())
        span = t["span"].to_numpy(zero_copy_only=False)
        succ = np.where(np.isnan(span.astype(float)), -1, rel + np.nan_to_num(span.astype(float)).astype(np.int64))
        at = np.searchsorted(rel, succ)
        inside = (succ >= 0) & (succ < total)
        hit = inside & (rel[np.minimum(at, len(rel) - 1)] == succ)
        to = np.where(hit, at, np.arange(len(rel)))  # a candidate whose successor is outside, or nothing, points to itself
        while True:
            jump = to[to]
            if (jump == to).all():
                break
            to = jump
        leaves = (succ >= total)[to]
        cols = [t["file"], t["at"], pa.array(rel), pa.array(n), pa.array(np.arange(len(rel))), pa.array(succ), pa.array(np.where(leaves, succ[to], -1)), pa.array(rel[to]), t["head"], t["http"], t["digest"], t["body"]]
        return pa.table(cols, names=[x.split()[0] for x in _SEGMENT.split(", ")]).combine_chunks()

    held = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        key = np.array([f"{f} {a}" for f, a in zip(t["file"].to_pylist(), t["at"].to_pylist(), strict=True)])
        edge = np.flatnonzero(key[1:] != key[:-1]) + 1
        for lo, hi in zip(np.r_[0, edge[:-1]], edge, strict=True) if len(edge) else ():
            yield from done(t.slice(lo, hi - lo)).to_batches(2000)
        held = t.slice(edge[-1] if len(edge) else 0)
    if held is not None:
        yield from done(held).to_batches(2000)


def _reached(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of a split with the record that each belongs to: itself, if reached from the split's entry."""
    left = left.sort_by("seq")
    rel, succ = left["rel"].to_numpy(), left["succ"].to_numpy()
    n, entry = len(rel), right["entry"].to_pylist()
    before = right["before"].to_pylist()[0] if len(right) else None
    base = right["base"].to_pylist()[0] if len(right) else 0
    at = np.minimum(np.searchsorted(rel, succ), n - 1)
    jump = np.where(rel[at] == succ, at, np.arange(n))  # nothing here follows: to itself
    reached = (rel == entry[0]) if entry and entry[0] is not None else np.zeros(n, bool)
    while True:  # each round reaches twice as far
        wider = reached.copy()
        wider[jump[reached]] = True
        if (wider == reached).all():
            break
        reached, jump = wider, jump[jump]
    own = np.where(reached, rel, -1)
    mark = np.maximum.accumulate(np.where(own >= 0, np.arange(n), -1))
    of = np.where(mark >= 0, base + rel[np.maximum(mark, 0)], -1 if before is None else before)
    names = ["file", "off", "len", "record", "head", "http", "digest", "body"]
    return pa.table([left["file"], pa.array(base + rel), left["len"], pa.array(of), left["head"], left["http"], left["digest"], left["body"]], names=names)


def _segments(spark, path: str, every: bool, only: DataFrame | None = None) -> DataFrame:
    """Segments of the archives at path with their places; body: the text of those that are no whole record, or of every one."""
    lines = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    if only is not None:
        lines = lines.join(F.broadcast(only), ["file", "at"], "left_semi")
    # the reader drops the separator: a segment is what follows a magic
    seg = lines.withColumn("head", F.substring_index("value", END, 1))
    seg = seg.withColumn("length", F.regexp_extract("head", r"(?:^|\r\n)Content-Length: (\d+)", 1).try_cast("long"))
    seg = seg.withColumn("span", F.when(F.col("head").rlike(r"(?:^|\r\n)WARC-Type: "), F.lit(len(MAGIC) + 8) + F.octet_length("head") + F.col("length")))
    seg = seg.withColumn("len", (F.octet_length("value") + len(MAGIC)).cast("long")).withColumn("whole", F.coalesce(F.col("len") == F.col("span"), F.lit(False)))
    seg = seg.withColumn("rest", F.expr("substring(value, char_length(head) + 5)")).withColumn("http", F.substring_index("rest", END, 1))
    payload = F.expr("substring(rest, char_length(http) + 5, char_length(rest) - char_length(http) - 8)")
    seg = seg.withColumn("sha", F.when(F.col("whole"), F.sha1(payload.cast("binary"))))
    body = F.col("value") if every else F.when(~F.col("whole"), F.col("value"))
    return seg.select("file", "at", "len", "span", "head", "http", F.col("sha").alias("digest"), body.alias("body")).mapInArrow(_chains, _SEGMENT)


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of the archives in the folder at path."""
    small_batches(spark)
    found = cut(_segments(spark, path, False).where("len > 0"), "segments")

    splits = found.groupBy("file", "at").agg(F.sum("len").alias("size"))
    here = Window.partitionBy("file").orderBy("at")
    splits = cut(splits.select("file", "at", "size", (F.sum("size").over(here) - F.col("size")).alias("base"), F.row_number().over(here).alias("nth"), F.count("*").over(Window.partitionBy("file")).alias("of")), "splits")
    # entries of splits: where a chain that leaves a split comes in; the file's start is the first
    leaving = found.where("exit >= 0").join(splits, ["file", "at"]).select("file", (F.col("base") + F.col("rel")).alias("off"), (F.col("base") + F.col("exit")).alias("to"), (F.col("base") + F.col("last")).alias("before"))
    hops = cut(leaving.join(leaving.select("file", F.col("to").alias("off")).union(splits.select("file", F.lit(0).cast("long"))).distinct(), ["file", "off"], "left_semi"), "hops")
    reach = splits.select("file", F.lit(0).cast("long").alias("off"), F.lit(None).cast("long").alias("before")).distinct()
    reach, jump = cut(reach, "reach"), hops
    most = splits.agg(F.max("of")).first()[0] or 1
    for _ in range(int(most).bit_length()):
        more = reach.select("file", "off").join(jump, ["file", "off"]).select("file", F.col("to").alias("off"), "before")
        reach = cut(reach.union(more).distinct(), "reach")
        jump = cut(jump.join(jump.select("file", F.col("off").alias("to"), F.col("to").alias("far"), F.col("before").alias("prior")), ["file", "to"]).select("file", "off", F.col("far").alias("to"), F.col("prior").alias("before")), "jump")
    # a split's entry is the reached offset that lies in it
    place = found.select("file", "at", "rel").join(splits.select("file", "at", "base"), ["file", "at"]).select("file", "at", "rel", "base", (F.col("base") + F.col("rel")).alias("off"))
    entry = place.join(reach, ["file", "off"]).select("file", "at", F.col("rel").alias("entry"), "base", "before")
    # splits without an entry lie inside one record: that which the next reached offset follows
    gap = splits.join(entry.select("file", "at", "entry", "before"), ["file", "at"], "left")
    later = F.first("before", ignorenulls=True).over(Window.partitionBy("file").orderBy("at").rowsBetween(1, Window.unboundedFollowing))
    entry = cut(gap.select("file", "at", "entry", "base", F.coalesce("before", F.when(F.col("entry").isNull(), later)).alias("before")), "entries")
    marked = found.groupBy("file", "at").cogroup(entry.groupBy("file", "at")).applyInArrow(_reached, "file string, off long, len long, record long, head string, http string, digest string, body string")
    marked = cut(marked, "marked")

    whole = marked.where("off = record and body is null").select("head", "http", base32(F.col("digest")).alias("digest"))
    broken = marked.where("record >= 0 and body is not null").select("file", "record", "off", "body")
    inner = cut(marked.where("record >= 0 and off <> record and body is null").select("file", "off", "record"), "inner")
    if not inner.isEmpty():  # what reads as a whole record but lies in a payload: its text is needed after all
        where = cut(inner.join(splits, "file").where("off >= base and off < base + size").select("file", "at").distinct(), "where")
        again = _segments(spark, path, True, where).where("len > 0").join(splits.select("file", "at", "base"), ["file", "at"]).select("file", (F.col("base") + F.col("rel")).alias("off"), "body")
        broken = broken.union(inner.join(again, ["file", "off"]).select("file", "record", "off", "body"))
    joined = broken.groupBy("file", "record").applyInArrow(_join, "head string, http string, digest string")
    field = lambda name: F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    urn = lambda name: F.regexp_extract(field(name), r"<urn:page:(-?\d+)>", 1)
    number = lambda c: F.when(c != "", c).cast("long")
    kind = field("WARC-Type")
    declared = F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1)
    return whole.union(joined).select(
        number(urn("WARC-Record-ID")).alias("page_id"), number(F.regexp_extract("http", r"Content-Length: (\d+)", 1)).alias("payload_bytes"),
        F.when(kind == "revisit", declared).otherwise(F.col("digest")).alias("payload_digest"), kind.alias("record_type"), number(urn("WARC-Refers-To")).alias("refers_to"),
    )


def _join(t: pa.Table) -> pa.Table:
    """A record from the segments that magic in its payload has cut it into."""
    t = t.sort_by("off")
    raw = MAGIC.join(t["body"].to_pylist()).encode()
    head, _, rest = raw.partition(END.encode())
    length = next(int(x[16:]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))
    http, _, payload = rest[:length].partition(END.encode())
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return pa.table([pa.array([x]) for x in (head.decode(), http.decode(), digest)], names=["head", "http", "digest"])


def archive_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back; a row for each page.

    Payloads are the html in UTF-8 (null: empty).  Of records with equal
    payloads of at least `least` bytes, that with the smallest page_id is the
    response, the others are revisits that refer to it.  Rows that repeat
    a page_id get a record each, on their own payload (all rows of a response's
    page_id and payload are responses), and rows without one a record whose
    page_id reads back as null; they are responses.  A url may be null or
    hold any character; white space in it is escaped.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, least)
    return read_archives(pages.sparkSession, path)
