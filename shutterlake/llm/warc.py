"""WARC archives with a shared Zstandard dictionary.

Each archive file starts with a skippable frame that holds the dictionary,
followed by one Zstandard frame for each record, so a record can be read alone.
The dictionary is built once, from a bounded sample of the records to be
archived. Tasks write whole files under names of their own in the shared
folder and report (file, offset, length) of each record; only files that a
finished task reported are ever read, so a retried task does no harm.

Of records with equal payloads of at least ``LEAST_REVISIT`` bytes, that with
the least id is the response and the others revisit it, with no payload of
their own. Shorter ones are all responses.

Rows: null html has an empty payload. Null ids come after all others and
revisit like them. A page that appears twice is written twice. Columns other
than id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.common import hash_sample, new_path, small_batches

#: Shortest payload that is stored once.
LEAST_REVISIT = 100
#: Records that the dictionary is built from, the size of the largest one that is taken, the dictionary's size.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 512, 131_072, 65_536
#: Bytes of an archive that a reader holds at a time (more only for a record that is longer).
READ_BYTES = 4 << 20
#: Of the leading frame, and of a Zstandard dictionary.
SKIPPABLE, DICTIONARY_MAGIC = 0x184D2A5D, b"\x37\xa4\x30\xec"
LEVEL = 3


def with_revisits(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, and refers_to, null for responses."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    groups = base.where(F.col("payload_bytes") >= LEAST_REVISIT).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = base.join(groups, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))).drop("first_id")


def build_dictionary(pages: DataFrame, sample: int = SAMPLE) -> bytes:
    """A Zstandard dictionary from about ``sample`` whole records of ``SAMPLE_BYTES`` at most; empty where they are too few to build one.

    The driver holds ``2 * sample * SAMPLE_BYTES`` bytes of them at most.
    """
    whole = pages.where("html is not null").select("page_id", F.encode("html", "UTF-8").alias("payload")).where(F.octet_length("payload").between(1, SAMPLE_BYTES))
    samples = sorted(bytes(r["payload"]) for r in hash_sample(whole, "page_id", sample).select("payload").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    """A skippable frame that holds the dictionary."""
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. The payload of a revisit is left out."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {digest}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        *([f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def write(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Write the records of ``pages`` (see :func:`with_revisits`) and return the index (file, offset, length), stored in ``folder``."""
    spark = pages.sparkSession
    spark_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    spark_path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark_path)

    def write_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pafs.FileSystem.from_uri(folder)
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True)
        file, out, at = None, None, 0
        try:
            for batch in batches:
                if out is None:
                    file = f"{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{path}/{file}", compression=None)
                    at = out.write(leading_frame(dictionary))
                spans = []
                for page_id, url, html, digest, refers in zip(batch["page_id"], batch["url"], batch["html"], batch["payload_digest"], batch["refers_to"], strict=True):
                    number = lambda x: None if pd.isna(x) else int(x)
                    frame = press.compress(record(number(page_id), url, html.encode(), digest, number(refers)))
                    out.write(frame)
                    spans.append((file, at, len(frame)))
                    at += len(frame)
                yield pd.DataFrame(spans, columns=["file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    typed = pages.select("page_id", "url", "html", "payload_digest", "refers_to")
    index = typed.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("page_id", "refers_to")}).mapInPandas(write_part, "file string, offset long, length long")
    index.write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def _stretches(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The records of a file in its order, some ``READ_BYTES`` of neighbours at a time."""
    part = part.sort_values("offset")
    low = part["offset"].to_numpy()
    ends, at = low + part["length"].to_numpy(), 0
    while at < len(part):
        stop = max(at + 1, int(np.searchsorted(ends, low[at] + READ_BYTES, side="right")))
        yield part.iloc[at:stop]
        at = stop


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record that the index of ``folder`` lists, decompressed and parsed, with or without the payloads themselves.

    Size and digest of a response's payload are those of the bytes read; a
    revisit has none, so they are its header's. ``intact`` says that the bytes
    have the size and digest in their header.
    """
    spans = spark.read.parquet(f"{folder}/index")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", *(["payload"] if payloads else [])]

    def read_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, part in batch.groupby("file", sort=False):
                with store.open_input_file(f"{path}/{file}") as source:
                    magic, size = struct.unpack("<II", source.read_at(8, 0))
                    if magic != SKIPPABLE:
                        raise ValueError(f"{file} has no leading dictionary frame")
                    held = source.read_at(size, 8)
                    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
                    for some in _stretches(part):
                        low, high = int(some["offset"].min()), int((some["offset"] + some["length"]).max())
                        data, rows = memoryview(source.read_at(high - low, low)), []
                        for offset, length in zip(some["offset"], some["length"], strict=True):
                            headers, body = parse_record(unpress.stream_reader(io.BytesIO(data[offset - low : offset - low + length])).read())
                            refers, page = headers.get("X-Refers-To-Page-ID"), headers["X-Page-ID"]
                            said = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].partition(":")[2]
                            own = said if refers is not None else (len(body), hashlib.sha256(body).hexdigest())
                            row = (int(page) if page else None, headers["WARC-Target-URI"], *own, headers["WARC-Type"], int(refers) if refers else None, own == said)
                            rows.append((*row, None if refers is not None else body.decode()) if payloads else row)
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"
    return spans.mapInPandas(read_part, schema + (", payload string" if payloads else ""))


def archive(pages: DataFrame) -> str:
    """Archive ``pages`` (page_id, url, html) in a new folder of the shared one, and return it."""
    small_batches(pages.sparkSession)
    folder = new_path(pages.sparkSession, "warc")
    write(with_revisits(pages), folder, build_dictionary(pages))
    return folder
