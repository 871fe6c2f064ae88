"""Media columns: types by signature sniffing, and embedded media carved out.

An Aho-Corasick automaton locates the magic bytes of all formats in one pass over
a blob; each hit is confirmed by its format's validator, which walks the structure
and returns the true length.  The type of the item at offset 0 corrects the
declared type; confirmed items at any offset can be carved.  What archives and documents
end with is located once a blob, so hits that are no items cost little each; PDFs nested
more than ``PDF_DEPTH`` deep aren't told apart.

Texts become media as 8-bit mono PCM in a RIFF/WAVE container.

Defined results: a null blob counts as empty, has no items and keeps its declared
type; magic bytes without a valid structure are no item; a null declared type is corrected
by any item at offset 0; very long blobs are sniffed whole; repeated blobs are judged alike;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallysieve.llm.textkit import raw_texts, text_or_empty

BLOCK = 576
RATE = 8000
PDF_DEPTH = 16
#: File names and comments of archives longer than this aren't read.
NAME_BYTES = 4096
#: What texts are declared as before they are sniffed.
DECLARED = "text/plain"
_BITS = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
_PDF_END = re.compile(rb"startxref\s+(\d{1,15})\s+%%EOF")
_PDF_TABLE = re.compile(rb"xref\b|\d{1,10} \d{1,5} obj\b")


class Blob:
    """Bytes, and what is found once for all hits in them."""

    def __init__(self, data: bytes):
        self.data = data
        self.walked = 0  # the end of the Ogg pages that were walked last

    def __len__(self) -> int:
        return len(self.data)

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start to end of what zip end records close, the last one of each start: records lie behind their central directory."""
        out = {}
        at = self.data.find(b"PK\x05\x06")
        while at >= 0:
            if at + 22 <= len(self.data):
                entries, size, start, note = struct.unpack("<HIIH", self.data[at + 10 : at + 22])
                begin, end = at - size - start, at + 22 + note
                if begin >= 0 and entries and end <= len(self.data) and self.data[at - size : at - size + 4] == b"PK\x01\x02":
                    out[begin] = max(end, out.get(begin, 0))
            at = self.data.find(b"PK\x05\x06", at + 1)
        return out

    @cached_property
    def documents(self) -> dict[int, int]:
        """Start to end of PDFs: the last ``%%EOF`` whose startxref, counted from the header, is a cross-reference table or object."""
        headers = [m.start() for m in re.finditer(rb"%PDF-\d", self.data)]
        out, gone = {}, set()
        for end in _PDF_END.finditer(self.data):
            last = bisect.bisect_left(headers, end.start()) - 1
            tried, level = [], 0
            while last >= 0 and level < PDF_DEPTH:
                if headers[last] not in gone:
                    level += 1
                    table = headers[last] + int(end[1])
                    if table < end.start() and _PDF_TABLE.match(self.data, table):
                        out[headers[last]] = end.end()
                        gone |= set(tried)  # an outer document goes on: the inner ones are over
                        break
                    tried.append(headers[last])
                elif len(tried) >= PDF_DEPTH:
                    break
                last -= 1
        return out


def _png(b: Blob, i: int) -> int | None:
    at = i + 8
    while at + 12 <= len(b):
        size, kind = struct.unpack(">I4s", b.data[at : at + 8])
        if at == i + 8 and (kind != b"IHDR" or size != 13):
            return None
        if at + 12 + size > len(b) or zlib.crc32(memoryview(b.data)[at + 4 : at + 8 + size]) != struct.unpack(">I", b.data[at + 8 + size : at + 12 + size])[0]:
            return None
        at += 12 + size
        if kind == b"IEND":
            return at - i
    return None


def _jpeg(b: Blob, i: int) -> int | None:
    data, at = b.data, i + 2
    while at + 4 <= len(b) and data[at] == 0xFF:
        mark, size = data[at + 1], (data[at + 2] << 8) + data[at + 3]
        if mark in (0xD8, 0xD9, 0x00, 0xFF) or size < 2:
            return None
        at += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is no restart
            at = data.find(b"\xff", at)
            while 0 <= at < len(b) - 1 and data[at + 1] in (0, *range(0xD0, 0xD8)):
                at = data.find(b"\xff", at + 2)
            if at < 0 or at + 1 >= len(b):
                return None
            if data[at + 1] == 0xD9:
                return at + 2 - i
    return None


def _gif(b: Blob, i: int) -> int | None:
    if i + 13 > len(b):
        return None
    data = b.data
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    at, images = i + 13 + table(data[i + 10]), 0
    while at < len(b):
        lead, at = data[at], at + 1
        if lead == 0x3B:
            return at - i if images else None
        if lead == 0x2C and at + 10 <= len(b):
            at += 9 + table(data[at + 8]) + 1
            images += 1
        elif lead == 0x21:
            at += 1
        else:
            return None
        while at < len(b) and data[at]:
            at += 1 + data[at]
        at += 1
    return None


def _riff(b: Blob, i: int) -> int | None:
    if i + 12 > len(b):
        return None
    size = struct.unpack("<I", b.data[i + 4 : i + 8])[0] + 8
    end, at = i + size, i + 12
    if end > len(b) or size < 20:
        return None
    kinds = set()
    while at + 8 <= end:
        kind, part = struct.unpack("<4sI", b.data[at : at + 8])
        kinds.add(kind)
        at += 8 + part + (part & 1)
    wanted = {b"WAVE": {b"fmt ", b"data"}, b"WEBP": set()}.get(b.data[i + 8 : i + 12])
    return size if at == end and wanted is not None and wanted <= kinds else None


def _bmp(b: Blob, i: int) -> int | None:
    if i + 26 > len(b):
        return None
    size, _, start, head = struct.unpack("<IIII", b.data[i + 2 : i + 18])
    return size if head in (12, 40, 52, 56, 108, 124) and 14 + head <= start <= size and i + size <= len(b) else None


def _pdf(b: Blob, i: int) -> int | None:
    end = b.documents.get(i)
    return end and end - i


def _zip(b: Blob, i: int) -> int | None:
    end = b.archives.get(i)
    return end and end - i


def _gzip(b: Blob, i: int) -> int | None:
    data, flags, body = b.data, b.data[i + 3], i + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        body += 2 + struct.unpack("<H", data[body : body + 2])[0]
    for bit in (8, 16):  # file name, comment
        if flags & bit:
            body = data.find(b"\0", body, body + NAME_BYTES) + 1
            if not body:
                return None
    inflate, at, step = zlib.decompressobj(31), i, 256
    try:
        while at < len(b):
            part = data[at : at + step]
            inflate.decompress(part, 1 << 20)
            while inflate.unconsumed_tail:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            at += len(part)
            if inflate.eof:
                return at - i - len(inflate.unused_data)
            step = min(2 * step, 1 << 16)
    except zlib.error:
        pass
    return None


def ogg_checksum(page: bytes) -> int:
    """The CRC of an Ogg page whose checksum field is zero: zlib's, over mirrored bits and from zero."""
    return int(f"{zlib.crc32(page.translate(_BITS), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _ogg(b: Blob, i: int) -> int | None:
    if i < b.walked or i + 6 > len(b) or not b.data[i + 5] & 2:
        return None  # a page of a stream that begins earlier
    at, last, begun = i, False, False
    while at + 27 <= len(b) and b.data[at : at + 5] == b"OggS\0" and not last:
        head = at + 27 + b.data[at + 26]
        end = head + sum(b.data[at + 27 : head])
        page = b.data[at:end]
        first = page[5] & 2
        if end > len(b) or begun and first or ogg_checksum(page[:22] + bytes(4) + page[26:]) != struct.unpack("<I", page[22:26])[0]:
            break
        begun, last, at = not first, bool(page[5] & 4), end
    b.walked = max(b.walked, at)
    return at - i if last else None


def _mp4(b: Blob, i: int) -> int | None:
    at, kinds = i, []
    while at + 8 <= len(b):
        size, kind = struct.unpack(">I4s", b.data[at : at + 8])
        if size < 8 or at + size > len(b) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"meta", b"moof", b"uuid") or kinds and kind == b"ftyp":
            break
        kinds.append(kind)
        at += size
    return at - i if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


#: magic bytes: (bytes before them, type, validator)
FORMATS: dict[bytes, tuple[int, str, Callable[[Blob, int], int | None]]] = {
    b"\x89PNG\r\n\x1a\n": (0, "image/png", _png),
    b"\xff\xd8\xff": (0, "image/jpeg", _jpeg),
    b"GIF87a": (0, "image/gif", _gif),
    b"GIF89a": (0, "image/gif", _gif),
    b"WAVE": (8, "audio/wav", _riff),
    b"WEBP": (8, "image/webp", _riff),
    b"BM": (0, "image/bmp", _bmp),
    b"%PDF-": (0, "application/pdf", _pdf),
    b"PK\x03\x04": (0, "application/zip", _zip),
    b"\x1f\x8b\x08": (0, "application/gzip", _gzip),
    b"OggS": (0, "audio/ogg", _ogg),
    b"ftyp": (4, "video/mp4", _mp4),
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic in FORMATS:
        found.add_word(magic.decode("latin-1"), magic)
    found.make_automaton()
    return found


def items(blob: bytes, machine: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(offset, length, type) of every confirmed item.

    A validator sees the bytes from its hit to the blob's end.  Hits inside an
    item are looked at too: media can hold media.
    """
    whole, out = Blob(blob), []
    for last, magic in machine.iter(blob.decode("latin-1")):
        before, kind, valid = FORMATS[magic]
        i = last - len(magic) + 1 - before
        if i < 0 or before == 8 and blob[i : i + 4] != b"RIFF":
            continue
        try:
            size = valid(whole, i)
        except (struct.error, IndexError):
            size = None
        if size:
            out.append((i, size, kind))
    return sorted(out)


def judged(blob: bytes, declared: str | None, machine: ahocorasick.Automaton) -> tuple[str | None, bool, list[tuple[int, int, str]]]:
    """(type, whether that corrects the declared one, confirmed items) of a blob."""
    found = items(blob, machine)
    kind = next((k for i, _, k in found if i == 0), declared)
    return kind, kind != declared, found


def sniff(blobs: DataFrame, blob: str = "blob", declared: str = "declared", carve: bool = False) -> DataFrame:
    """The rows of (id, blob, declared) with type, corrected and items; ``carve`` adds the items' bytes."""
    kind_of = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            types, fixed, every = [], [], []
            for data, told in zip(batch.column("blob"), batch.column("declared").to_pylist(), strict=True):
                data = data.as_py() or b""
                kind, corrected, found = judged(data, told, machine)
                types.append(kind)
                fixed.append(corrected)
                every.append([{"offset": i, "length": n, "type": k, "data": data[i : i + n] if carve else None} for i, n, k in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(every, kind_of)], names=["id", "type", "corrected", "items"])

    kind = dict(blobs.dtypes)["id"]
    rows = blobs.select("id", blobs[blob].alias("blob"), blobs[declared].cast("string").alias("declared"))
    return rows.mapInArrow(run, f"id {kind}, type string, corrected boolean, items array<struct<offset:long,length:long,type:string,data:binary>>")


def to_wav(payload: bytes) -> bytes:
    """8-bit mono PCM; a payload of odd length gets the format's pad byte."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def from_wav(blob: bytes) -> bytes:
    """The samples of the first data chunk."""
    at = 12
    while at + 8 <= len(blob):
        kind, size = struct.unpack("<4sI", blob[at : at + 8])
        if kind == b"data":
            return blob[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def padded(raw: bytes, block: int = BLOCK) -> bytes:
    """``raw`` and bytes 255 up to a positive multiple of ``block``."""
    return raw + b"\xff" * (max(1, -(-len(raw) // block)) * block - len(raw))


def text_media(docs: DataFrame) -> DataFrame:
    """Every text as WAVE media declared as ``DECLARED``: sniffed, the type corrected, the item carved, read back and described."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            out: list[list] = [[] for _ in range(9)]
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                stored = to_wav(padded(data[i:j].tobytes()))
                kind, corrected, found = judged(stored, DECLARED, machine)
                at, size, _ = next(x for x in found if x[0] == 0 and x[2] == kind)
                samples = from_wav(stored[at : at + size])
                level = np.frombuffer(samples, dtype=np.uint8)
                total = int(level.sum(dtype=np.int64))
                crossings = int(np.count_nonzero((level[1:] >= 128) != (level[:-1] >= 128)))
                feature = f"{kind};samples={len(level)};sum={total};low={int(level.min())};high={int(level.max())};crossings={crossings};embedded={len(found) - 1}"
                row = (j - i, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), size, hashlib.sha256(stored[at : at + size]).hexdigest(), feature, kind, corrected)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media_type string, corrected boolean")
