"""A deterministic sharded WARC writer, and a reader."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import discard, integral, stored

#: Cells of the id histogram for each shard that a part of it should give, as a power of two.
CELL_BITS = 3
#: Payload bytes of a writing task, if shards are smaller.
TASK_BYTES = 8 << 20
#: Compressed bytes that a reading task gets.
READ_BYTES = 32 << 20
#: Copies of one payload are dealt over so many salts, by their ids.
SALTS = 60
#: No clock enters the records, so equal input gives equal bytes.
DATE = "2000-01-01T00:00:00Z"
RECORD_SPACE = uuid.UUID("7a0c1d52-8d6e-5c0b-9a54-0f3d9f6b2c11")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder, on whichever machine this runs."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def uri(path: str) -> str:
    """file:/x, as Hadoop writes it, as file:///x."""
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, ordinal: int) -> bytes:
    """One WARC/1.1 record, uncompressed; the HTTP header is made anew from the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    made = lambda x: f"<urn:uuid:{uuid.uuid5(RECORD_SPACE, x)}>"
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", made(f"{page_id}/{digest}/{ordinal}")), ("WARC-Date", DATE), ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", sha1_base32(block)),
        ("WARC-Page-ID", "" if page_id is None else str(page_id)), ("WARC-Payload-Length", str(size)),
    ]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", made(f"{refers_to}/{digest}/0")), ("WARC-Refers-To-Page-ID", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    clean = lambda v: " ".join(v.split())
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def packed(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class _File:
    name: str
    path: str
    out: object
    size: int = 0
    records: int = 0
    digest: object = None


@dataclass(frozen=True)
class Shards:
    """Where shards begin: the first id of each range, the ranges' first shard
    numbers, and how many shards a range has, by digest, if it is one heavy id.
    Null ids come last and are a range of their own."""

    starts: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    null_first: int
    null_parts: int

    @property
    def number(self) -> int:
        return self.null_first + self.null_parts

    def of(self, ids: Column, digest: Column) -> Column:
        at = self

        @F.pandas_udf("int")
        def shard(i: pd.Series, d: pd.Series) -> pd.Series:
            none = i.isna().to_numpy()
            k = np.searchsorted(at.starts, i.fillna(0).to_numpy().astype(np.int64), "right") - 1
            k = np.maximum(k, 0)
            first = np.where(none, at.null_first, at.first[k])
            parts = np.where(none, max(1, at.null_parts), at.parts[k])
            share = np.array([int(x[:8], 16) for x in d], dtype=np.int64)
            return pd.Series((first + share * parts // (1 << 32)).astype(np.int32))

        return shard(ids, digest)


def cut(keyed: DataFrame, per: int) -> Shards:
    """Shard bounds from the payload bytes of ids, so that they depend on the data alone.

    Ids are summed by their high bits; cells above ``per`` bytes are summed
    again by more bits, until a cell fits or is one id. So an id far away from
    the others costs a round and no balance. Numbers that reach the driver are
    some for each shard, as are the rows of the manifest.
    """
    low, high, total, nulls = keyed.agg(F.min("id"), F.max("id"), F.coalesce(F.sum(F.when(F.col("id").isNotNull(), F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("size") + 1)), F.lit(0))).first()
    cells: list[tuple[int, int, int]] = []  # first id, shift, bytes
    if low is not None:
        wide, bits = (high - low).bit_length(), max(1, -(-total // per)).bit_length() + CELL_BITS
        shift = max(0, min(63, wide - bits))
        heavy, rows = None, keyed.filter("id is not null")
        while True:
            cell = F.expr(f"shiftright(id, {shift})")
            some = rows if heavy is None else rows.join(F.broadcast(heavy), F.expr(f"shiftright(id, {before})") == F.col("up"), "left_semi")
            sums = [(c, int(n)) for c, n in some.groupBy(cell.alias("c")).agg(F.sum("size")).collect()]
            over = [c for c, n in sums if n > per and shift]
            cells += [(c << shift, shift, n) for c, n in sums if not (n > per and shift)]
            if not over:
                break
            most = max(n for _, n in sums)
            heavy = keyed.sparkSession.createDataFrame([(c,) for c in over], "up long")
            before, shift = shift, max(0, shift - max(1, -(-most // per)).bit_length() - CELL_BITS)
    starts, first, parts, filled, to = [], [], [], 0, -1
    for at, _, n in sorted(cells):
        of = max(1, -(-n // per))
        if not starts or filled + n > per or of > 1:
            to += parts[-1] if parts else 1
            starts.append(at)
            first.append(to)
            parts.append(of)
            filled = 0
        filled += n if of == 1 else per
    after = first[-1] + parts[-1] if starts else 0
    if not starts:
        starts, first, parts = [0], [0], [1]
    return Shards(np.array(starts, np.int64), np.array(first, np.int64), np.array(parts, np.int64), after, -(-nulls // per) if nulls else 0)


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = 256 << 20, shard_bytes: int = 1 << 30, least: int = 100) -> DataFrame:
    """Write one record per row and return the manifest (shard, part, name, bytes, records, sha256).

    Records are sorted by id and payload digest in shards of about
    ``shard_bytes`` of payload, whose bounds depend on the data alone. A shard
    is written by one task; its files roll when their compressed size passes
    ``roll_bytes``. Each attempt of a task writes under names of its own; the
    manifest, which Spark commits, has the names of the attempts that counted,
    and only then are those files renamed. Both steps can be repeated. Of equal
    payloads of at least ``least`` bytes the row of the smallest id is a
    response and the others are revisits, which hold no payload.

    Ids must be integers (else TypeError). A null id comes after all others; if
    all ids of a payload are null, or the smallest is repeated, one row is the
    response and the others revisit it. An id whose rows are larger than a
    shard is dealt over several by digest; only rows equal in id and payload
    stay together. Null urls and payloads are written as empty; rows without
    any payload bytes are responses. An empty table gives an empty manifest;
    other columns are ignored.
    """
    integral(pages, id_col)
    spark = pages.sparkSession
    folder = uri(folder)
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.select("id", F.sha2("payload", 256).alias("digest"), "url", "payload")
    keyed = stored(rows.select("id", "digest", F.octet_length("payload").cast("bigint").alias("size")), "keyed")
    shards = cut(keyed, max(1, shard_bytes))
    n = max(1, shards.number)

    # Copies are counted by digest and salt before they are counted by digest, and told the same way.
    large = keyed.filter(F.col("size") >= least).select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    part = large.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull().alias("k"), "id")).alias("m"))
    groups = part.groupBy("digest").agg(F.sum("n").alias("n"), F.min("m").alias("m"), F.collect_set("salt").alias("salts")).filter("n > 1").select("digest", F.col("m.id").alias("first"), F.explode("salts").alias("salt"))
    again = stored(large.join(groups, ["digest", "salt"]).select("id", "digest", "first").distinct(), "copies")
    # A row without payload goes ahead of the pages of its id and tells the writer which payload is known.
    both = rows.select("id", F.lit(1).alias("kind"), "digest", "url", "payload", F.lit(None).cast("bigint").alias("first"))
    both = both.unionByName(again.select("id", F.lit(0).alias("kind"), "digest", F.lit("").alias("url"), F.lit(b"").alias("payload"), "first"))
    # Small shards share a task with their neighbours, in order.
    per = max(1, TASK_BYTES // max(1, shard_bytes))
    both = both.select(shards.of(F.col("id"), F.col("digest")).alias("shard"), "*").repartitionById(-(-n // per), F.floor(F.col("shard") / per).cast("int"))
    both = both.sortWithinPartitions("shard", F.asc_nulls_last("id"), "digest", "kind", "url")
    fields = "shard int, part int, name string, temporary string, bytes long, records long, sha256 string"

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, base = opened(folder)
        attempt = uuid.uuid4().hex
        now: tuple[int, int] | None = None
        file: _File | None = None
        known: tuple | None = None
        ordinal, done = 0, []

        def close() -> None:
            nonlocal file
            if file:
                file.out.close()
                done.append((now[0], now[1], file.name, file.path, file.size, file.records, file.digest.hexdigest()))
                file = None

        for b in batches:
            for s, i, kind, digest, url, payload, first in zip(b["shard"], b["id"].astype("object").where(b["id"].notna(), None), b["kind"], b["digest"], b["url"], b["payload"], b["first"].astype("object").where(b["first"].notna(), None), strict=True):
                i, first = (None if x is None else int(x) for x in (i, first))
                if kind == 0:
                    known, ordinal = (i, digest, first), 0
                    continue
                if known is None or known[:2] != (i, digest):
                    known, ordinal = (i, digest, "none"), 0
                revisit = known[2] != "none" and (i != known[2] or ordinal > 0)
                data = packed(record("revisit" if revisit else "response", i, url, b"" if revisit else bytes(payload), digest, len(payload), known[2] if revisit else None, ordinal))
                ordinal += 1
                if now is None or now[0] != s or file is None or file.size >= roll_bytes:
                    close()
                    now = (s, now[1] + 1 if now and now[0] == s else 0)
                    name = f"pages-{now[0]:06d}-{now[1]:04d}.warc.gz"
                    disk.create_dir(f"{base}/_temporary/{attempt}", recursive=True)
                    path = f"{base}/_temporary/{attempt}/{name}"
                    file = _File(name, path, disk.open_output_stream(path, compression=None), digest=hashlib.sha256())
                file.out.write(data)
                file.digest.update(data)
                file.size, file.records = file.size + len(data), file.records + 1
        close()
        yield pd.DataFrame(done, columns=["shard", "part", "name", "temporary", "bytes", "records", "sha256"])

    both.mapInPandas(write, fields).write.mode("overwrite").parquet(f"{folder}/_manifest")
    discard(keyed, again)
    manifest = spark.read.schema(fields).parquet(f"{folder}/_manifest")

    def commit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, base = opened(folder)
        for b in batches:
            for name, temporary in zip(b["name"], b["temporary"], strict=True):
                if disk.get_file_info(temporary).type != pafs.FileType.NotFound:
                    disk.move(temporary, f"{base}/{name}")
                elif disk.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
                    raise FileNotFoundError(name)
            yield b[["name"]]

    manifest.mapInPandas(commit, "name string").write.mode("overwrite").parquet(f"{folder}/_committed")
    disk, base = opened(folder)
    if disk.get_file_info(f"{base}/_temporary").type == pafs.FileType.Directory:  # what failed attempts left
        disk.delete_dir(f"{base}/_temporary")
    return manifest.drop("temporary")


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, out = zlib.decompressobj(31), []
    for data in chunks:
        while data:
            out.append(z.decompress(data))
            if not z.eof:
                break
            yield b"".join(out)
            data, z, out = z.unused_data, zlib.decompressobj(31), []
    if out and b"".join(out):
        raise EOFError("a record is cut short")


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; lengths and digests are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = dict(x.partition(": ")[::2] if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or sha1_base32(block) != h["WARC-Block-Digest"]:
        raise ValueError(f"record {h['WARC-Record-ID']} is damaged")
    payload = block.partition(b"\r\n\r\n")[2]
    if h["WARC-Type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != h["WARC-Payload-Digest"]:
        raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
    return h, payload


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the files in a folder's manifest: page_id, url, record_type,
    payload_bytes, payload_digest (both of the full payload), refers_to,
    headers (JSON), payload (null for a revisit, or if not asked for). A null id
    comes back as null, a null url or payload as empty. Lengths and digests of
    all records are checked, and a damaged one is an error. An empty manifest
    gives no rows."""
    folder = uri(folder)
    manifest = spark.read.parquet(f"{folder}/_manifest").select("name", "bytes")
    count, total = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    files = manifest.repartition(max(1, min(count, max(2 * spark.sparkContext.defaultParallelism, total // READ_BYTES))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        disk, base = opened(folder)
        for b in batches:
            for name in b["name"]:
                with disk.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for data in members(iter(lambda f=f: f.read(1 << 20), b"")):
                        h, payload = parsed(data)
                        number = lambda k, h=h: int(h[k]) if h.get(k, "") not in ("", "None") else None
                        kind = h["WARC-Type"]
                        rows.append((number("WARC-Page-ID"), h["WARC-Target-URI"], kind, number("WARC-Payload-Length"), h["WARC-Payload-Digest"].removeprefix("sha256:"), number("WARC-Refers-To-Page-ID"), json.dumps(h), payload if with_payload and kind == "response" else None))
                        held += len(data)
                        if held > 4 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                    yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "headers", "payload"], dtype=object)
        return out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    return files.mapInPandas(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, headers string, payload binary")
