"""WARC archives with a Zstandard dictionary of their own.

Each task gathers records up to ``ARCHIVE`` bytes, trains a dictionary on records spread over them, and writes one archive:
the dictionary in a leading skippable frame, then every record as a frame of its own. Of records with equal payloads of at
least ``LEAST`` bytes the one with the smallest page id holds the payload, the others are revisits of it. An archive counts
once its name is in the manifest that the write job commits, so a lost or repeated task leaves no record twice.

Defined cases: null html is an empty payload; a null page id is never the smallest, and equal payloads of null ids only are
all responses; rows repeated under the smallest id are all responses; an empty table makes no archive.
"""

from __future__ import annotations

import io
import re
import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, work_dir

#: Fixed values of the format: magic number of the skippable frame, version line, profile of a revisit.
MAGIC, VERSION, PROFILE = 0x184D2A5D, "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, DICTIONARY, TRAINED, LEAST, SALTS, LEVEL = 16_000_000, 65_536, 4_000_000, 100, 32, 6
#: Most digests of repeated payloads that are broadcast, about 100 bytes each.
REPEATED = 200_000
_LINE = re.compile(r"[\x00-\x20\x7f]")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response, or if ``refers_to`` is given a revisit that keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _LINE.sub(lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """Trained on records spread evenly; from raw content where there are too few to train on."""
    import zstandard

    step = max(1, -(-sum(map(len, records)) // TRAINED))
    some = records[::step]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, some)) // 16)), some)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(x[:512] for x in some)[-DICTIONARY:].ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> bytes:
    import zstandard

    known = build_dictionary(records)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=known)
    raw = known.as_bytes()
    return b"".join([struct.pack("<II", MAGIC, len(raw)), raw, *map(press.compress, records)])


def read_archive(stream):
    """(headers, block) of each record, from a binary stream; one record in memory at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("no leading dictionary frame")
    raw = stream.read(size)
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    text = io.BufferedReader(opener.stream_reader(stream, read_across_frames=True), 1 << 16)
    while first := text.readline():
        if first.strip().decode() != VERSION:
            raise ValueError("a record must begin with its version")
        headers = {}
        while line := text.readline().rstrip(b"\r\n").decode():
            name, _, value = line.partition(": ")
            headers[name] = value
        block = text.read(int(headers["Content-Length"]))
        text.read(4)
        yield headers, block


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to.

    Digests of repeated payloads are broadcast if there are at most ``REPEATED``, and no payload is moved; beyond that rows are
    joined by salted digest.
    """
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body, 256).alias("digest"), F.octet_length(body).alias("_n"))
    again = rows.where(F.col("_n") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("_least"), F.count("*").alias("_c")).where("_c > 1")
    again = materialize(again.select("digest", "_least"), "repeated")
    if again.count() <= REPEATED:
        joined = rows.join(F.broadcast(again), "digest", "left")
    else:
        spread = again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(spread, ["digest", "_salt"], "left")
    revisit = F.col("_least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_least"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("_least")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives under ``folder`` (a URI all executors share) and returns the manifest: path, records, bytes."""
    folder = folder or f"{work_dir(pages.sparkSession)}/warc"

    def put(records: list[bytes]) -> pd.DataFrame:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, data = f"part-{uuid.uuid4().hex}.warc.zst", archive(records)
        with store.open_output_stream(f"{base}/{name}") as out:
            out.write(data)
        return pd.DataFrame({"path": [f"{folder}/{name}"], "records": [len(records)], "bytes": [len(data)]})

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for p, u, h, d, r in zip(*(batch[c] for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                held.append(record(None if pd.isna(p) else int(p), u, h.encode(), d, None if pd.isna(r) else int(r), date))
                size += len(held[-1])
                if size >= ARCHIVE:
                    yield put(held)
                    held, size = [], 0
        if held:
            yield put(held)

    rows = with_originals(pages)
    text = F.col("page_id").cast("string").alias("page_id"), F.col("refers_to").cast("string").alias("refers_to")  # ids beyond 2^53 stay exact beside nulls
    return materialize(rows.select(text[0], "url", "html", "digest", text[1]).mapInPandas(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit).

    A response's size and digest are computed from its payload; a revisit's are those its header states.
    """
    import hashlib

    number = lambda s: s[len("<urn:page:") : -1] or None

    def rows_of(path: str):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at) as stream:
            for headers, block in read_archive(stream):
                head, _, payload = block.partition(b"\r\n\r\n")
                own, response = headers["WARC-Payload-Digest"].removeprefix("sha256:"), headers["WARC-Type"] == "response"
                size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                if response and (hashlib.sha256(payload).hexdigest() != own or len(payload) != size):
                    raise ValueError(f"a payload in {path} is not what its header states")
                yield number(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, own, headers["WARC-Type"], number(headers.get("WARC-Refers-To", "<urn:page:>")), payload if response else None

    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def run(batches):
        for batch in batches:
            for path in batch["path"]:
                held, size = [], 0
                for row in rows_of(path):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size > 4_000_000 or len(held) == 10_000:
                        yield pd.DataFrame(held, columns=columns)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=columns)

    spread = manifest.select("path").repartition(max(8, manifest.sparkSession.sparkContext.defaultParallelism))
    found = spread.mapInPandas(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
