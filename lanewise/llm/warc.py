"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Writing uses Spark's text writer (a record is text, its line separator closes the record),
reading uses Spark's splittable text reader with the record magic as separator, so both
work on every file system Spark knows and no archive passes through one task whole.

Reading: every magic is only a *candidate* boundary, since payloads may hold it too. Each
task emits its candidates with the offset of their successor (from Content-Length). Chains
are first followed inside a split; then pointer jumping over splits, in a logarithmic
number of joins, finds what is reachable from the start of a file. Candidates that are not
reachable (magic inside payloads) are dropped, and the payloads they cut are put together.
A header runs to its blank line, however far: a line of it that ends like the magic (a url,
say) makes a candidate too, and the header goes on behind it, over the edge of a split as well.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lanewise.llm.common import as_batch, bounded_batches, discard, fresh_path, stage, table, to_arrow

MAGIC = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
URN = "urn:lanewise:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisit links are broadcast up to this many rows (about 100 bytes each), else shuffled.
BROADCAST_ROWS = 50_000
SEGMENT = (
    "file string, block long, local long, size long, candidate boolean, succ long, exit long, tin long, tout long, "
    "whole boolean, header_bytes long, content_bytes long, record_type string, record_id string, refers_to string, "
    "target_uri string, content_type string, stated_digest string, payload_bytes long, payload_digest string"
)
#: Of a header that its split leaves open, and (in the first row) of the bytes of a split up to its first blank line.
EDGE = "open boolean, lead_bytes long, lead_closed boolean, lead map<string,string>"
FIELD = re.compile(rb"(?im)^(content-length|content-type|warc-type|warc-record-id|warc-refers-to|warc-target-uri|warc-payload-digest):[ \t]*(.*?)\r?$")


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit: int = 100) -> None:
    """Write one record per row of ``pages`` (page_id, url, html; other columns are ignored).

    Null html is an empty payload; a null url leaves out WARC-Target-URI. Of equal payloads
    of at least ``min_revisit`` bytes the one with the smallest page_id is a response and
    those with larger ids revisit it; rows that repeat the smallest id are responses too,
    and rows with a null page_id are always responses. page_id is an integer (TypeError else).
    An empty table gives empty archives.
    """
    if not isinstance(pages.schema["page_id"].dataType, IntegralType):
        raise TypeError(f"page_id must be an integer, not {pages.schema['page_id'].dataType.simpleString()}")
    body = F.coalesce(F.col("html"), F.lit(""))
    page = pages.select(F.col("page_id").alias("id"), F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), body.alias("body"), F.octet_length(body).alias("n"), F.sha2(body, 256).alias("digest"))
    # both sides are staged, so that Spark can split the rows of a payload that very many pages have
    slim = stage(page.filter((F.col("n") >= min_revisit) & F.col("id").isNotNull()).select("id", "digest"), "digests")
    first = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "first")
    first = stage(first, "first-pages")
    links = stage(slim.join(first, "digest").filter("id > first").distinct(), "revisits")
    for old in (slim, first):
        discard(old)
    if links.count() <= BROADCAST_ROWS:
        links = F.broadcast(links)
    page = page.join(links, ["id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        F.coalesce(line(f"WARC-Record-ID: <{URN}", F.col("id").cast("string"), ">"), F.lit("")),
        F.coalesce(line("WARC-Target-URI: ", F.col("url")), F.lit("")),
        line(f"WARC-Date: {date}"),
        F.coalesce(line(f"WARC-Refers-To: <{URN}", F.col("first").cast("string"), ">"), F.lit("")),
        F.when(revisit, line(f"WARC-Profile: {REVISIT}")).otherwise(""),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
        line("Content-Type: application/http;msgtype=response"),
        line("Content-Length: ", (F.when(revisit, 0).otherwise(F.col("n")) + len(HTTP)).cast("string")),
        F.lit("\r\n" + HTTP),
        F.when(revisit, "").otherwise(F.col("body")),
        F.lit("\r\n"),
    )
    page.select(record.alias("value")).write.option("lineSep", "\r\n").text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between two magics, in the order of each split."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("value").cast("binary").alias("bytes"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _fields(data: bytes, end: int) -> dict[str, str]:
    """The header fields before ``end``, or (-1) of all lines, the last of which ends in the magic behind ``data``."""
    out = {}
    for m in FIELD.finditer(data, 0, len(data) if end < 0 else end):
        value = data[m.start(2) :] + MAGIC.encode()[:-2] if end < 0 and m.end() == len(data) else m[2]
        out[m[1].decode().lower()] = value.decode("utf-8", "replace")
    return out


def _header(row: dict, size: int, h: dict[str, str]) -> bool:
    """Fill in a record header of ``size`` bytes with the blank line; False if it is none."""
    length = h.get("content-length", "")
    if not length.isdecimal() or len(length) > 18:
        return False
    n = int(length)
    row |= {"header_bytes": size, "content_bytes": n, "succ": row["local"] + size + n + 4 + len(MAGIC), "whole": False, "content_type": h.get("content-type"), "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"), "stated_digest": h.get("warc-payload-digest")}
    return True


def payload(content: bytes, content_type: str | None) -> bytes:
    """What follows the HTTP header, or the whole content of other records."""
    if content_type and content_type.startswith("application/http"):
        return content.partition(b"\r\n\r\n")[2]
    return content


def _chain(part: list[dict], end: int) -> None:
    """Follow the successors inside a split. ``exit``: where a chain leaves the split.
    [tin, tout): a candidate is on the chain of another if its interval holds the other's tin."""
    at = {r["local"]: r for r in part if r["succ"] is not None}
    size = dict.fromkeys(at, 1)
    for k in sorted(at):  # a successor lies behind, so it has gathered all that lead to it
        if (s := at[k]["succ"]) in at:
            size[s] += size[k]
    roots, free = 0, {}
    for k in sorted(at, reverse=True):
        r, s = at[k], at[k]["succ"]
        if s in at:
            r["tin"], r["exit"] = free[s], at[s]["exit"]
            free[s] += size[k]
        else:
            r["tin"], r["exit"] = roots, s
            roots += size[k]
        r["tout"] = r["tin"] + size[k]
        free[k] = r["tin"] + 1


def _candidates(schema: pa.Schema, behind: dict[tuple, tuple[int, dict]]):
    """``behind``: for splits that leave a header open, size and fields of its rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, pos = None, [], 0
        waiting: list[tuple[dict, dict, bool]] = []  # rows whose blank line is yet to come, fields of their segment, whether for the lead

        def settle(stop: int, h: dict, closed: bool = True) -> None:
            for row, own, lead in reversed(waiting):
                h = own | h
                if lead:
                    row |= {"lead_bytes": stop, "lead_closed": closed, "lead": list(h.items())}
                elif closed:
                    _header(row, stop - row["local"], h)
                else:
                    row["open"] = True
            waiting.clear()

        def flush() -> pa.RecordBatch:
            if key in behind:
                size, h = behind[key]
                settle(pos + size, h)
            settle(pos, {}, False)
            _chain(part, pos)
            return as_batch({f.name: [r.get(f.name) for r in part] for f in schema}, schema)

        for batch in batches:
            for data, file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, block) != key:
                    if part:
                        yield flush()
                    key, part, pos = (file, block), [], 0
                row = {"file": file, "block": block, "local": pos, "size": len(data) + len(MAGIC), "candidate": not (block == 0 and pos == 0), "succ": None}
                if row["candidate"]:
                    if pos == 0:
                        waiting.append((row, {}, True))
                    end = data.find(b"\r\n\r\n")
                    h = _fields(data, end)
                    if data.startswith(b"\r\n"):  # the blank line follows a line that ends like the magic
                        settle(pos + 2, {})
                    elif end >= 0:
                        settle(pos + end + 4, h)
                    if end < 0:
                        waiting.append((row, h, False))
                    elif _header(row, end + 4, h) and end + 4 + row["content_bytes"] <= len(data):
                        own = payload(data[end + 4 : end + 4 + row["content_bytes"]], row["content_type"])
                        row |= {"whole": True, "payload_bytes": len(own), "payload_digest": hashlib.sha256(own).hexdigest()}
                part.append(row)
                pos += row["size"]
        if part:
            yield flush()

    return run


def _behind(found: DataFrame) -> dict[tuple, tuple[int, dict]]:
    """For each split that leaves a header open: size and fields of what follows up to the blank line."""
    left = {(r["file"], r["block"]) for r in found.filter("open").select("file", "block").distinct().collect()}
    if not left:
        return {}
    files = found.filter("open").select("file").distinct()
    edges = found.filter("lead IS NOT NULL").join(files, "file", "left_semi").select("file", "block", "lead_bytes", "lead_closed", "lead").collect()
    edges.sort(key=lambda r: (r["file"], r["block"]), reverse=True)
    out, rest = {}, None
    for r, before in zip(edges, [*edges[1:], None], strict=True):
        if r["lead_closed"]:
            rest = (r["lead_bytes"], r["lead"])
        elif rest:
            rest = (r["lead_bytes"] + rest[0], r["lead"] | rest[1])
        same = before is not None and before["file"] == r["file"]
        at = (r["file"], before["block"] if same else 0)
        if rest and at in left:
            out[at] = rest
        if not same:
            rest = None
    return out


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of WARC/1.1 files (plain, or gzipped whole or by record) under ``path``.

    One row per reachable record: file, offset, record_type, record_id, refers_to,
    target_uri, stated_digest (the header's), payload_bytes and payload_digest (of the
    payload as read) and, on request, payload. Files that do not
    start with the magic hold no reachable record; the chain of a damaged file ends at the
    last record that is whole; empty files give no rows.
    """
    bounded_batches(spark)
    schema = f"{SEGMENT}, {EDGE}"
    segments = lambda behind: stage(_segments(spark, path).mapInArrow(_candidates(to_arrow(spark, schema), behind), schema), "segments")
    found = segments({})
    if behind := _behind(found):
        discard(found)
        found = segments(behind)
    found = found.drop("open", "lead_bytes", "lead_closed", "lead")
    by_file = Window.partitionBy("file").orderBy("block")
    splits = found.groupBy("file", "block").agg(F.sum("size").alias("bytes"))
    splits = stage(splits.select("file", "block", F.coalesce(F.sum("bytes").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("bytes").over(Window.partitionBy("file")).alias("total"), F.count("*").over(Window.partitionBy("file")).alias("n_splits")), "splits")
    shift = lambda c: (F.col(c) + F.col("base")).alias(c)
    nodes = found.join(splits, ["file", "block"]).select("file", "block", "total", "n_splits", shift("local"), shift("succ"), shift("exit"), *[c for c in found.columns if c not in ("file", "block", "local", "succ", "exit")])
    links = nodes.filter("succ IS NOT NULL").select("file", F.col("local").alias("at"), F.col("exit"))
    reached = links.filter(F.col("at") == len(MAGIC)).select("file", "at")
    longest = splits.agg(F.max("n_splits")).first()[0] or 1
    if longest > 1:
        entries = links.select("file", F.col("exit").alias("at")).distinct().unionByName(reached).distinct()
        jumps = stage(links.join(entries, ["file", "at"], "left_semi"), "jumps")
        for step in range(math.ceil(math.log2(longest))):
            reached = stage(reached.unionByName(reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))).distinct(), "reached")
            if 2 ** (step + 1) < longest:
                further = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("next"))
                jumps = stage(jumps.join(further, ["file", "exit"]).select("file", "at", F.col("next").alias("exit")), "jumps")
    entry = nodes.join(reached.withColumnRenamed("at", "local"), ["file", "local"], "left_semi").filter("succ IS NOT NULL").select("file", "block", F.col("tin").alias("entry"))
    chain = nodes.filter("succ IS NOT NULL AND succ <= total").join(entry, ["file", "block"]).filter("tin <= entry AND entry < tout")
    kept = stage(chain.select("file", (F.col("local") - len(MAGIC)).alias("offset"), "local", "header_bytes", "content_bytes", "whole", "content_type", "record_type", "record_id", "refers_to", "target_uri", "stated_digest", "payload_bytes", "payload_digest"), "records")
    columns = ["file", "offset", "record_type", "record_id", "refers_to", "target_uri", "stated_digest", "payload_bytes", "payload_digest"]
    cut = kept if with_payload else kept.filter(~F.col("whole"))
    if not with_payload and cut.isEmpty():
        return kept.select(columns)
    whole = _payloads(spark, path, cut, nodes)
    if with_payload:
        return whole.select(*columns, "payload")
    return kept.filter("whole").select(columns).unionByName(whole.select(columns))


def _payloads(spark: SparkSession, path: str, records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Read again the segments of ``records`` and put their contents together."""
    where = _segments(spark, path)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos = None, 0
        for batch in batches:
            at = []
            for size, file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (file, block) != key:
                    key, pos = (file, block), 0
                at.append(pos)
                pos += len(size) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], names=["bytes", "file", "block", "local0"])

    placed = where.mapInArrow(place, "bytes binary, file string, block long, local0 long")
    base = nodes.select("file", "block", "local", "size")
    starts = records.select("file", F.col("local").alias("start"), (F.col("local") + F.col("header_bytes") + F.col("content_bytes")).alias("stop"))
    # each segment belongs to the last reachable record that starts at or before it: in its split, or else in a split before
    own = base.join(starts.select("file", F.col("start").alias("local"), F.lit(True).alias("begins")), ["file", "local"], "left").withColumn("begun", F.when(F.col("begins"), F.col("local")))
    in_split = Window.partitionBy("file", "block").orderBy("local").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy("file", "block").agg(F.max("begun").alias("last")).select("file", "block", F.last("last", ignorenulls=True).over(before).alias("carried"))
    own = own.withColumn("begun", F.last("begun", ignorenulls=True).over(in_split)).join(carried, ["file", "block"]).withColumn("start", F.coalesce("begun", "carried"))
    owner = own.join(starts, ["file", "start"]).filter(F.col("local") - len(MAGIC) < F.col("stop")).select("file", "block", "local", "start")
    lowest = nodes.groupBy("file", "block").agg(F.min("local").alias("base"))
    owner = owner.join(lowest, ["file", "block"]).withColumn("local0", F.col("local") - F.col("base"))
    pieces = placed.join(owner, ["file", "block", "local0"]).groupBy("file", F.col("start").alias("local")).agg(F.array_sort(F.collect_list(F.struct("local", "bytes"))).alias("pieces"))
    joined = records.drop("payload_bytes", "payload_digest").join(pieces, ["file", "local"])
    schema = "payload binary"

    @F.pandas_udf(schema.split()[1])
    def content(pieces, head, size, kind):
        import pandas as pd

        out = []
        for p, h, n, k in zip(pieces, head, size, kind, strict=True):
            out.append(payload(MAGIC.encode().join(bytes(x["bytes"]) for x in p)[h : h + n], k))
        return pd.Series(out)

    full = joined.withColumn("payload", content("pieces", "header_bytes", "content_bytes", "content_type"))
    return full.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records of :func:`write_archives` by page: a revisit takes the size of the response that it refers to and
    whose payload has the digest that the revisit states, since several rows may share a page_id. Without such a
    response, size and digest stay those of the record itself."""
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '{URN}(-?[0-9]+)', 1), '') AS bigint)")
    revisit = F.col("record_type") == "revisit"
    digest = F.when(revisit, F.regexp_replace("stated_digest", "^sha256:", "")).otherwise(F.col("payload_digest"))
    pages = records.select(page("record_id").alias("page_id"), "record_type", F.when(revisit, page("refers_to")).alias("refers_to"), digest.alias("digest"), F.col("payload_bytes").alias("own_bytes"), F.col("payload_digest").alias("own_digest"))
    # both sides of the join are staged, so that Spark can split the revisits of one page
    pages = stage(pages, "page-records")
    named = pages.filter("record_type = 'revisit'").select("refers_to", "digest").distinct()
    sources = pages.filter("record_type = 'response' AND page_id IS NOT NULL").select(F.col("page_id").alias("refers_to"), "digest", "own_bytes").join(named, ["refers_to", "digest"], "left_semi")
    sources = stage(sources.groupBy("refers_to", "digest").agg(F.max("own_bytes").alias("bytes")), "sources")
    again = pages.filter("record_type = 'revisit'").join(sources, ["refers_to", "digest"], "left")
    again = again.select("page_id", F.coalesce("bytes", "own_bytes").alias("payload_bytes"), F.when(F.col("bytes").isNotNull(), F.col("digest")).otherwise(F.col("own_digest")).alias("payload_digest"), "record_type", "refers_to")
    plain = pages.filter("record_type <> 'revisit'").select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to")
    return plain.unionByName(again)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back, one row per page."""
    path = fresh_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages", spread=True), path)
    return resolve_revisits(read_archives(spark, path))


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
     f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""
