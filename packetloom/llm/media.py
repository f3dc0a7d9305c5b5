"""Media columns by signature sniffing: an Aho-Corasick pass locates magic bytes, format validators confirm structure and length,
declared types are corrected and embedded media carved."""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the public formats: magic bytes, each with the type it may begin.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"RIFF": "riff",
    b"\x1f\x8b\x08": "application/gzip",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"fLaC": "audio/flac",
    b".snd": "audio/basic",
}
JPEG_END, PDF_END, PDF_TABLE, ZIP_END = b"\xff\xd9", b"%%EOF", b"startxref", b"PK\x05\x06"
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
OTHER = "application/octet-stream"
WAV_HEADER = 44
#: Offsets of the inner marks, ascending, all found in the one pass; what validators keep for each other.
Marks = dict


def after(places: list[int], at: int) -> int:
    """The first place at an offset or later, -1 if there is none."""
    k = bisect_left(places, at)
    return places[k] if k < len(places) else -1


def _png(d: bytes, at: int, marks: Marks) -> int:
    k = at + 8
    while k + 12 <= len(d):
        size, kind = struct.unpack_from(">I4s", d, k)
        stop = k + 12 + size
        if stop > len(d) or zlib.crc32(d[k + 4 : stop - 4]) != struct.unpack_from(">I", d, stop - 4)[0] or (k == at + 8) != (kind == b"IHDR"):
            return 0
        if kind == b"IEND":
            return stop - at
        k = stop
    return 0


def _gif(d: bytes, at: int, marks: Marks) -> int:
    if at + 13 > len(d):
        return 0
    flags, k = d[at + 10], at + 13
    k += 3 << ((flags & 7) + 1) if flags & 128 else 0
    while k < len(d):
        if d[k] == 0x3B:
            return k + 1 - at
        if d[k] == 0x21:
            k += 2
        elif d[k] == 0x2C and k + 10 <= len(d):
            k += 11 + (3 << ((d[k + 9] & 7) + 1) if d[k + 9] & 128 else 0)
        else:
            return 0
        while k < len(d) and d[k]:
            k += d[k] + 1
        k += 1
    return 0


def _jpeg(d: bytes, at: int, marks: Marks) -> int:
    k = at + 2
    while k + 4 <= len(d) and d[k] == 0xFF:
        size = struct.unpack_from(">H", d, k + 2)[0]
        if size < 2 or not 0xC0 <= d[k + 1] <= 0xFE:
            return 0
        scan, k = d[k + 1] == 0xDA, k + 2 + size
        if scan:
            stop = after(marks[JPEG_END], k)
            return stop + 2 - at if stop >= 0 else 0
    return 0


def riff_chunks(d: bytes, at: int) -> tuple[int, dict[bytes, tuple[int, int]]]:
    """Length of a sound RIFF file at an offset (0: none) and the place of each chunk's body."""
    if at + 12 > len(d):
        return 0, {}
    stop = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    k, found = at + 12, {}
    while k + 8 <= stop <= len(d):
        kind, size = struct.unpack_from("<4sI", d, k)
        found.setdefault(kind, (k + 8, size))
        k += 8 + size + (size & 1)
    return (stop - at, found) if found and k == stop else (0, {})


def _gzip(d: bytes, at: int, marks: Marks) -> int:
    inflate = zlib.decompressobj(31)
    try:
        rest = memoryview(d)[at:]
        for k in range(0, len(rest), 1 << 16):
            part = rest[k : k + (1 << 16)]
            while part and not inflate.eof:
                inflate.decompress(part, 1 << 20)
                part = inflate.unconsumed_tail
            if inflate.eof:
                return min(k + (1 << 16), len(rest)) - len(inflate.unused_data)
    except zlib.error:
        pass
    return 0


def _pdf(d: bytes, at: int, marks: Marks) -> int:
    stop = after(marks[PDF_END], at)
    return stop + 5 - at if stop >= 0 and 0 <= after(marks[PDF_TABLE], at) < stop else 0


def _zip(d: bytes, at: int, marks: Marks) -> int:
    k = at
    while d[k : k + 4] == b"PK\x03\x04" and k + 30 <= len(d):
        flags, packed, name, extra = struct.unpack_from("<H", d, k + 6)[0], *struct.unpack_from("<I", d, k + 18), *struct.unpack_from("<HH", d, k + 26)
        if flags & 8:  # sizes come after the data, so the archive is found from its end
            return _zip_from_end(d, at, marks)
        k += 30 + packed + name + extra
    stop = _zip_table(d, k)
    return stop - at if stop else 0


def _zip_table(d: bytes, k: int) -> int:
    """Where an archive ends whose central directory begins at an offset; 0 if none does."""
    while d[k : k + 4] == b"PK\x01\x02" and k + 46 <= len(d):
        k += 46 + sum(struct.unpack_from("<HHH", d, k + 28))
    return k + 22 + struct.unpack_from("<H", d, k + 20)[0] if d[k : k + 4] == ZIP_END and k + 22 <= len(d) else 0


def _zip_from_end(d: bytes, at: int, marks: Marks) -> int:
    """Length of the archive at an offset by the end record that points back to it (no 64-bit sizes)."""
    if "archives" not in marks:
        marks["archives"] = {}
        for end in marks[ZIP_END]:
            if end + 22 <= len(d):
                size, start = struct.unpack_from("<II", d, end + 12)
                marks["archives"].setdefault(end - size - start, end - size)
    table = marks["archives"].get(at, -1)
    stop = _zip_table(d, table) if table >= 0 else 0
    return stop - at if stop else 0


def _flac(d: bytes, at: int, marks: Marks) -> int:
    return len(d) - at if len(d) >= at + 42 and d[at + 4] & 127 == 0 and d[at + 5 : at + 8] == b"\x00\x00\x22" else 0


def _au(d: bytes, at: int, marks: Marks) -> int:
    if at + 24 > len(d):
        return 0
    head, size, code, rate, channels = struct.unpack_from(">5I", d, at + 4)
    return head + size if head >= 24 and 1 <= code <= 27 and rate and 0 < channels < 256 and at + head + size <= len(d) else 0


VALIDATE: dict[str, Callable[[bytes, int, Marks], int]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/gzip": _gzip, "application/pdf": _pdf, "application/zip": _zip,
    "audio/flac": _flac, "audio/basic": _au,
}


@cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        out.add_word(magic.decode("latin-1"), (kind, len(magic)))
    for mark in (JPEG_END, PDF_END, PDF_TABLE, ZIP_END):
        out.add_word(mark.decode("latin-1"), (mark, len(mark)))
    out.make_automaton()
    return out


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of every valid medium, outer ones before those inside them. A signature without valid structure is none.

    One pass finds the signatures and the marks inside formats, so a text full of signatures without an end is not read again for each.
    """
    found, starts, marks = [], [], {mark: [] for mark in (JPEG_END, PDF_END, PDF_TABLE, ZIP_END)}
    for end, (kind, size) in automaton().iter(data.decode("latin-1")):
        (marks[kind] if kind in marks else starts).append(end + 1 - size if kind in marks else (kind, end + 1 - size))
    for kind, at in starts:
        if kind == "riff":
            kind = RIFF_FORMS.get(data[at + 8 : at + 12], "")
            length = riff_chunks(data, at)[0] if kind else 0
        else:
            length = VALIDATE[kind](data, at, marks)
        if length:
            found.append((kind, at, length))
    return sorted(found, key=lambda x: (x[1], -x[2]))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A sound file that holds the payload as unsigned 8-bit mono samples, byte for byte."""
    pad = b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + pad


def wav_samples(data: bytes, at: int = 0) -> bytes:
    """The samples of the sound file at an offset, read by its own chunk table."""
    start, size = riff_chunks(data, at)[1][b"data"]
    return data[start : start + size]


def sniff_column(df: DataFrame, id_col: str, data_col: str, declared_col: str | None = None) -> DataFrame:
    """(id, declared, media_type, corrected, parts array<struct<type, offset, length>>) of a binary column, one row per input row.

    media_type is that of a valid medium at offset 0, else application/octet-stream; corrected tells whether it differs from the
    declared one. parts has every carved medium by offset, length. Null or empty data: octet-stream and no part; a null declaration
    counts as differing. Extra columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [sniff(x or b"") for x in batch.column(2).to_pylist()]
        kinds = [next((k for k, at, _ in p if at == 0), OTHER) for p in parts]
        declared = batch.column(1).to_pylist()
        kind = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        return common.batch_of(
            id=(batch.column(0), pa.string()), declared=(declared, pa.string()), media_type=(kinds, pa.string()),
            corrected=([a != b for a, b in zip(kinds, declared, strict=True)], pa.bool_()),
            parts=([[{"type": k, "offset": a, "length": n} for k, a, n in p] for p in parts], kind),
        )

    narrow = df.select(F.col(id_col).cast("string").alias("id"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("declared"), F.col(data_col).cast("binary").alias("data"))
    return common.map_batches(narrow, run, "id string, declared string, media_type string, corrected boolean, parts array<struct<type string, offset long, length long>>")


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text stored as a sound file of 8-bit samples, found again by sniffing, carved and read back; one row per input row.

    The payload is the text's UTF-8 bytes with zeros up to a positive multiple of 64. The file's declared type is octet-stream; the sniffer
    must find the sound file, whose samples are then the payload that the digests and features come from. Null and empty texts are 64
    zeros. Equal texts give equal rows but for doc_id; repeated rows each return. keep_media adds the file itself as `media`. A file over
    4 GiB does not fit the format and raises; very long texts are stored whole; extra columns are ignored.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media)}
        for raw in common.blobs(batch.column(1)):
            media = to_wav(raw + bytes(-len(raw) % 64 or (64 if not raw else 0)))
            parts = sniff(media)
            kind, at, length = parts[0]
            back = wav_samples(media[at : at + length])
            wave = np.frombuffer(back, np.uint8)
            inside = ",".join(f"{k}@{a - WAV_HEADER}+{n}" for k, a, n in parts[1:])
            feature = f"{kind};u8;mono;8000;mean={int(wave.sum(dtype=np.int64)) / len(wave):.4f};peak={wave.max()};cross={int(np.count_nonzero((wave[1:] < 128) != (wave[:-1] < 128)))};inside={inside}"
            got = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, media)
            for k, v in zip(rows, got, strict=False):
                rows[k].append(v)
        kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media": pa.binary()}
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), **{k: (v, kinds.get(k, pa.string())) for k, v in rows.items()})

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return common.map_batches(common.id_text(docs, id_col, text_col), run, schema + ", media binary" * keep_media)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(common.documents(spark, sf_dir))
