"""Deterministic sharded WARC 1.1 archives.

Records are range-sorted by page id into shards of about equal payload; a file is rolled when its compressed size
reaches a limit; every record is a gzip member of its own with regenerated headers and digests. The same rows and
parameters give the same bytes, however Spark dealt them. Of equal payloads of MIN_REVISIT bytes or more, the record with
the largest page id holds the payload and the others are revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import MANIFEST, commit, deal, spread
from .common import Tables, few, hot_keys, reading, split_join, writing

MIN_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, payload, bytes, digest, response): response is the page to refer to, null for responses."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = own.select("id", "url", "payload", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    tables = Tables(pages.sparkSession)
    large = own.where((F.col("bytes") >= MIN_REVISIT) & F.col("id").isNotNull())
    firsts = large.groupBy("digest").agg(F.max("id").alias("response"), F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("low < response")
    firsts = tables.write(firsts.select("digest", "response", "n"), "responses")
    if few(firsts):
        out = own.join(F.broadcast(firsts), "digest", "left")
    else:  # a payload of very many copies is split
        out = split_join(own, firsts.select("digest", "response"), ["digest"], hot_keys(tables, firsts, "digest"), ["id"], "left")
    return out.select("id", "url", "payload", "bytes", "digest", F.when(F.col("id") < F.col("response"), F.col("response")).alias("response"))


def _named(head: bytes, fields: list[tuple[str, str]]) -> bytes:
    return head + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"


def _uri(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text or "") or "urn:unknown"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, nth: int, url: str | None, payload: bytes, size: int, digest: str, response: int | None, date: str) -> bytes:
    """One record. nth counts rows that repeat a page id, so that record ids stay unique."""
    http = _named(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))])
    block = http if response is not None else http + payload
    fields = [("WARC-Type", "response" if response is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'null' if page is None else page}{f':{nth}' * (nth > 0)}>")]
    fields += [("WARC-Date", date), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("WARC-Block-Digest", _sha1(block))]
    if response is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{response}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _named(b"WARC/1.1", fields) + block + b"\r\n\r\n"


def _info(name: str, date: str) -> bytes:
    block = b"software: lectern\r\nformat: WARC File Format 1.1\r\n"
    return _named(b"WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def _writer(out: str, roll_bytes: int, date: str):
    def run(batches):
        import pyarrow as pa

        made, opened, seq, last, nth = [], None, 0, object(), 0
        for batch in batches:
            shards = batch.column("shard").to_pylist()
            cols = [batch.column(c) for c in ("id", "url", "payload", "bytes", "digest", "response")]
            for i, shard in enumerate(shards):
                page, url, payload, size, digest, response = (c[i].as_py() for c in cols)
                nth = nth + 1 if page == last else 0
                last = page
                if opened is None:
                    name = f"part-{shard:06d}-{seq:05d}.warc.gz"
                    row = [shard, seq, f"{out}/_temporary/{uuid.uuid4().hex}-{name}", f"{out}/{name}", 0, 0, 0]
                    opened = writing(row[2])
                    f = opened.__enter__()
                    member = gzip.compress(_info(name, date), 6, mtime=0)
                    f.write(member)
                    row[6] = len(member)
                member = gzip.compress(record(page, nth, url, payload, size, digest, response, date), 6, mtime=0)
                f.write(member)
                row[4], row[5], row[6] = row[4] + 1, row[5] + size, row[6] + len(member)
                if row[6] >= roll_bytes:
                    opened.__exit__(None, None, None)
                    made.append(row)
                    opened, seq = None, seq + 1
        if opened is not None:
            opened.__exit__(None, None, None)
            made.append(row)
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kinds[i]) for i in range(7)], names=["shard", "seq", "temporary", "final", "records", "units", "bytes"])

    return run


def write_archives(pages: DataFrame, out: str, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record a row under `out` (a folder that all executors share) and returns the manifest.

    A null html is an empty payload; a null url becomes urn:unknown; a null id sorts first and is always a response.
    Rows that repeat the largest id of a payload are responses all. Other columns of pages are not read. An empty table
    gives an empty manifest. shard_bytes: payload a shard; roll_bytes: compressed size at which a file is rolled.
    """
    dealt = deal(with_revisits(pages, id_col, url_col, html_col), "id", "bytes", shard_bytes, "digest", "url")
    return commit(pages.sparkSession, dealt.mapInArrow(_writer(out, roll_bytes, date), MANIFEST), out)


def members(stream, size: int = 1 << 20):
    """The gzip members of a stream, one at a time."""
    d, parts = zlib.decompressobj(31), []
    while data := stream.read(size):
        while data:
            parts.append(d.decompress(data))
            data = d.unused_data
            if d.eof:
                yield b"".join(parts)
                d, parts = zlib.decompressobj(31), []
    if any(parts):
        raise EOFError("truncated gzip member")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _page(urn: str) -> int | None:
    own = urn.removeprefix("<urn:page:").removesuffix(">").split(":")[0]
    return None if own == "null" else int(own)


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _reader(with_payload: bool):
    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in READ.split(", ")]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(7)], names=names)
        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with reading(path) as stream:
                    for data in members(stream):
                        fields, block = parse(data)
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        if _sha1(block) != fields["WARC-Block-Digest"]:
                            raise ValueError(f"block digest of {fields['WARC-Record-ID']} in {path}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != said):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} in {path}")
                        refers = _page(fields["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, size, said, refers, payload if with_payload and kind == "response" else None))
                        held += len(payload) * with_payload + 200
                        if held > 8 << 20:
                            yield give(rows)
                            rows, held = [], 0
        yield give(rows)

    return run


def read_archives(spark: SparkSession, out: str, with_payload: bool = False) -> DataFrame:
    """READ's columns of every record of a committed archive; digests are checked on the way."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out}/_manifest")
    rows = spread(manifest, "final").mapInArrow(_reader(with_payload), READ)
    return rows if with_payload else rows.drop("payload")
