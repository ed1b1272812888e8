"""WARC captures, and not-modified revisits resolved to the responses that they confirm.

A revisit says that a server answered 304: it has headers but no payload.  It is
resolved by an as-of join: of the full responses with the same canonical URL, the
latest before it.  Its validators must agree with that response's: the entity
tag where the revisit has one (weak comparison), else the date of last
modification.  Then the response's headers are merged with those of the revisit
that a 304 may update.

Records are parsed once; what the join needs of them (no payloads, only their
sizes and digests) is a table in the shared folder.  The as-of join needs no row
of a URL together with all others: captures are cut into spans of time, the last
response of each URL and span is an aggregate, and those are carried forward by
URL over spans that have any.  A URL with a third of all captures is split by its
spans.

Canonical URL: scheme and host in lower case, http as https, without www. or m.,
default port, fragment, tracking parameters, index page and trailing slashes,
other parameters in order.

Defined cases: a null URL has no canonical URL and resolves to nothing
(`no_response`), and so does a revisit without a time; a response without a time
is earlier than nothing.  A response at the very time of a revisit counts as
earlier, of several at one time the one with the largest capture_id; repeated
rows are captures of their own.  Without a validator that both sides have, the
status is `no_validator`, and nothing is merged.  Header names may repeat: all
lines stay, the first is the validator, and a name that the revisit sends takes
the place of all the response's lines of that name.  Null headers count as none,
null names of headers are left out.  An empty table gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Tables

#: Headers of a stored response that a 304 doesn't replace (they describe the payload or the connection).
KEPT = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
#: Fixed value: the profile of not-modified revisits.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
SPAN = 3600
CAPTURE = "capture_id long, kind string, url string, at long, headers array<struct<name:string,value:string>>, payload binary"
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
#: Records that a worker holds as Python objects at a time.
AT_ONCE = 256
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_breaks = re.compile(r"\r\n|[\r\n]")
_line = re.compile(rb"\r?\n")


def canonical_url(url: Column) -> Column:
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(head, r"^(www|m)\.", ""), ":(80|443)$", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/index\.(html?|php)$", "/"), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    return F.when(url.isNotNull(), F.concat(F.lit("https://"), host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def warc_date(at: int | None) -> str | None:
    """Seconds since 1970 as the format has them; null for a null and for what is no time of the years 1 to 9999."""
    try:
        return None if at is None else (_EPOCH + timedelta(seconds=at)).isoformat().replace("+00:00", "Z")
    except OverflowError:
        return None


def write_records(captures: DataFrame) -> DataFrame:
    """capture_id and `record`, a gzip member with one WARC/1.1 record, of each row of captures (CAPTURE).

    Line ends in a URL are percent-encoded and in a header are spaces, so that a
    value can't begin a line; a null time, or none of the years 1 to 9999, is a
    record without a date.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for x in batch.to_pylist():
                revisit, body = x["kind"] == "revisit", x["payload"] or b""
                lines = ["HTTP/1.1 304 Not Modified" if revisit else "HTTP/1.1 200 OK"]
                lines += [_breaks.sub(" ", f"{h['name']}: {h['value'] or ''}") for h in x["headers"] or [] if h and h["name"]]
                block = "\r\n".join(lines).encode() + b"\r\n\r\n" + (b"" if revisit else body)
                head = ["WARC/1.1", f"WARC-Type: {x['kind']}", f"WARC-Record-ID: <urn:capture:{x['capture_id']}>"]
                head += [f"WARC-Date: {date}"] if (date := warc_date(x["at"])) else []
                head += ["WARC-Target-URI: " + x["url"].replace("\r", "%0D").replace("\n", "%0A")] if x["url"] is not None else []
                head += [f"WARC-Profile: {PROFILE}"] * revisit
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
                out.append(gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0))
            yield pa.record_batch([batch.column("capture_id"), pa.array(out, pa.binary())], ["capture_id", "record"])

    return captures.select("capture_id", "kind", "url", "at", "headers", "payload").mapInArrow(run, "capture_id long, record binary")


def _fields(head: bytes) -> list[tuple[str, str]]:
    """Names in lower case and values of header lines after the first; a line that begins with a space goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in _line.split(head)[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {text.strip()}")
        elif ":" in text:
            name, _, value = text.partition(":")
            out.append((name.strip().lower(), value.strip(" \t")))
    return out


def _halves(data: bytes) -> tuple[bytes, bytes]:
    """What stands before and after the first empty line."""
    m = re.search(rb"\r?\n\r?\n", data)
    return (data[: m.start()], data[m.end() :]) if m else (data, b"")


def record_number(name: str) -> int:
    """The capture_id of a record: N of <urn:capture:N>, else 63 bits of the SHA-256 of its id."""
    m = re.fullmatch(r"<?urn:capture:(-?\d+)>?", name)
    return int(m[1]) if m else int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big") >> 1


def parse_record(data: bytes) -> dict | None:
    """One record, compressed or not, as a row of CAPTURE, header names in lower case; null if it is neither response nor revisit."""
    head, rest = _halves(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    fields = dict(reversed(_fields(head)))
    kind, date = fields.get("warc-type"), fields.get("warc-date")
    if kind not in ("response", "revisit"):
        return None
    http, body = _halves(rest[: int(fields.get("content-length", len(rest)))])
    at = None if date is None else int((datetime.fromisoformat(date.replace("Z", "+00:00")) - _EPOCH).total_seconds() // 1)
    headers = [{"name": k, "value": v} for k, v in _fields(http)]
    url = fields.get("warc-target-uri")
    return {"capture_id": record_number(fields.get("warc-record-id", "")), "kind": kind, "url": url and url.removeprefix("<").removesuffix(">"), "at": at, "headers": headers, "payload": None if kind == "revisit" else body}


def read_records(records: DataFrame) -> DataFrame:
    """The captures (CAPTURE) of rows with `record`; records that are no captures are left out."""
    fields = [("capture_id", pa.int64()), ("kind", pa.string()), ("url", pa.string()), ("at", pa.int64()), ("headers", _HEADERS), ("payload", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = [r for x in batch.column("record").to_pylist() if x is not None and (r := parse_record(x))]
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in fields], [k for k, _ in fields])

    return records.select("record").mapInArrow(run, CAPTURE)


def resolve(captures: DataFrame, span: int = SPAN) -> DataFrame:
    """Of each revisit: capture_id, canonical, response_id, status, headers (merged where status is `resolved`), payload_bytes, payload_md5.

    span: seconds of capture time that are looked at together for one URL.
    """
    first = lambda name: F.try_element_at(F.filter("headers", lambda h: F.lower(h["name"]) == name), F.lit(1))["value"]
    lines = F.filter(F.coalesce("headers", F.array().cast("array<struct<name:string,value:string>>")), lambda h: h["name"].isNotNull())
    found = captures.select("capture_id", "kind", "at", canonical_url(F.col("url")).alias("canonical"), lines.alias("headers"), F.length("payload").cast("long").alias("payload_bytes"), F.md5("payload").alias("payload_md5"))
    found = found.withColumns({"etag": F.regexp_replace(first("etag"), "^W/", ""), "modified": first("last-modified"), "span": F.floor(F.col("at") / span)})
    found = Tables(captures.sparkSession).write("captures", found)
    full = F.struct("at", F.col("capture_id").alias("response_id"), F.col("etag").alias("r_etag"), F.col("modified").alias("r_modified"), F.col("headers").alias("r_headers"), "payload_bytes", "payload_md5")
    placed = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    is_full = (F.col("kind") == "response") & placed
    last = found.where(is_full).groupBy("canonical", "span").agg(F.max_by(full, F.struct("at", "capture_id")).alias("last"))
    asked = found.where((F.col("kind") == "revisit") & placed).select("canonical", "span").distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType)).withColumn("asked", F.lit(True))
    spans = last.withColumn("asked", F.lit(False)).unionByName(asked)
    before = W.partitionBy("canonical").orderBy("span").rangeBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("older", F.last("last", True).over(before))
    carried = carried.where("asked").select("canonical", "span", F.col("older").alias("carried"))
    here = W.partitionBy("canonical", "span").orderBy("at", F.when(is_full, 0).otherwise(1), "capture_id").rowsBetween(W.unboundedPreceding, -1)
    revisits = found.where(placed).withColumn("near", F.last(F.when(is_full, full), True).over(here)).where(F.col("kind") == "revisit")
    lost = found.where((F.col("kind") == "revisit") & ~placed).withColumn("near", F.lit(None).cast(last.schema["last"].dataType))
    joined = revisits.join(carried, ["canonical", "span"], "left").unionByName(lost.withColumn("carried", F.col("near")))
    r = F.coalesce("near", "carried")
    both_tags = F.col("etag").isNotNull() & r["r_etag"].isNotNull()
    both_dates = F.col("modified").isNotNull() & r["r_modified"].isNotNull()
    agrees = F.when(both_tags, F.col("etag") == r["r_etag"]).when(F.col("etag").isNull() & both_dates, F.col("modified") == r["r_modified"])
    status = F.when(r.isNull(), "no_response").when(agrees.isNull(), "no_validator").when(agrees, "resolved").otherwise("mismatch")
    new = F.filter("headers", lambda h: ~F.lower(h["name"]).isin(*KEPT))
    sent = F.transform(new, lambda h: F.lower(h["name"]))
    merged = F.concat(F.filter(r["r_headers"], lambda h: ~F.array_contains(sent, F.lower(h["name"]))), new)
    out = joined.select("capture_id", "canonical", r["response_id"].alias("response_id"), status.alias("status"), merged.alias("merged"), r["payload_bytes"].alias("payload_bytes"), r["payload_md5"].alias("payload_md5"))
    ok = F.col("status") == "resolved"
    return out.select("capture_id", "canonical", "response_id", "status", *(F.when(ok, F.col(c)).alias(n) for c, n in (("merged", "headers"), ("payload_bytes", "payload_bytes"), ("payload_md5", "payload_md5"))))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A crawl of the pages, fetches and questions mixed in time: page p is fetched at p minutes.

    Every fourth page is fetched again after 200 minutes, its text changed.  Most pages are asked for again up to 500 minutes later, when others with the
    same canonical URL may have come in between or come later still; every
    eleventh page is asked for half a minute before its fetch, every seventh of the
    rest at its very second.  Responses have an entity tag, but for every third
    page a date only; a question sends the validators of its page's own answer, so
    where another page is the latest response they don't agree, and every
    thirteenth sends none.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    n = F.col("page_id")
    header = lambda name, value: F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value).alias("value"))
    tag, date = header("etag", F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))), header("last-modified", F.concat(F.lit("day "), (F.length("html") % 365).cast("string")))
    validators = F.when(n % 3 != 0, F.array(tag, date)).otherwise(F.array(date))
    size = header("content-length", F.length(F.encode("html", "UTF-8")).cast("string"))
    lag = F.when(n % 11 == 0, -30).when(n % 7 == 0, 0).otherwise(n * 37 % 500 * 60 + 30)
    answer = lambda df, number, at: df.select(number.alias("capture_id"), F.lit("response").alias("kind"), "url", at.alias("at"), F.concat(validators, F.array(header("content-type", "text/html"), size, header("cache-control", "max-age=60"))).alias("headers"), F.encode("html", "UTF-8").alias("payload"))
    first, changed = answer(p, n * 3, n * 60), answer(p.where(n % 4 == 1).withColumn("html", F.concat("html", F.lit(" again"))), n * 3 + 1, n * 60 + 12_015)
    asks = F.array(header("content-length", "0"), header("cache-control", "max-age=600"), header("age", (n % 60).cast("string")))
    again = p.select((n * 3 + 2).alias("capture_id"), F.lit("revisit").alias("kind"), "url", (n * 60 + lag).alias("at"), F.when(n % 13 == 5, asks).otherwise(F.concat(validators, asks)).alias("headers"), F.lit(None).cast("binary").alias("payload"))
    return first.unionByName(changed).unionByName(again)


def flat_headers(resolved: DataFrame) -> DataFrame:
    """headers as one string, sorted."""
    return resolved.withColumn("headers", F.array_join(F.array_sort(F.transform("headers", lambda e: F.concat(e["name"], F.lit("="), F.coalesce(e["value"], F.lit(""))))), "|"))


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(trim(url), '#.*$', '') AS u, url FROM pages),
c AS (SELECT page_id, html, CASE WHEN url IS NOT NULL THEN 'https://'
  || regexp_replace(regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/index\.(html?|php)$', '/'), '/+$', '')
  || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q FROM p)),
f AS (SELECT page_id, canonical, html, page_id * 3 AS id, page_id * 60 AS at FROM c UNION ALL SELECT page_id, canonical, html || ' again', page_id * 3 + 1, page_id * 60 + 12015 FROM c WHERE page_id % 4 = 1),
v AS (SELECT *, CASE WHEN page_id % 3 <> 0 THEN '"' || substr(md5(html), 1, 16) || '"' END AS etag, 'day ' || (length(html) % 365) AS modified FROM f),
a AS (SELECT page_id, canonical, page_id * 60 + CASE WHEN page_id % 11 = 0 THEN -30 WHEN page_id % 7 = 0 THEN 0 ELSE page_id * 37 % 500 * 60 + 30 END AS at,
  CASE WHEN page_id % 13 <> 5 THEN etag END AS etag, CASE WHEN page_id % 13 <> 5 THEN modified END AS modified FROM v WHERE id % 3 = 0),
j AS (SELECT a.*, r.id AS rid, r.etag AS r_etag, r.modified AS r_modified, r.html AS r_html FROM a ASOF LEFT JOIN v r ON a.canonical = r.canonical AND a.at >= r.at),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN etag IS NOT NULL AND r_etag IS NOT NULL THEN CASE WHEN etag = r_etag THEN 'resolved' ELSE 'mismatch' END
  WHEN etag IS NULL AND modified IS NOT NULL THEN CASE WHEN modified = r_modified THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS status FROM j)
SELECT page_id * 3 + 2 AS capture_id, canonical, rid AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'age=' || (page_id % 60) || '|cache-control=max-age=600|content-length=' || octet_length(encode(r_html)) || '|content-type=text/html'
    || coalesce('|etag=' || coalesce(etag, r_etag), '') || '|last-modified=' || modified END AS headers,
  CASE WHEN status = 'resolved' THEN CAST(octet_length(encode(r_html)) AS BIGINT) END AS payload_bytes, CASE WHEN status = 'resolved' THEN md5(r_html) END AS payload_md5
FROM s
"""
