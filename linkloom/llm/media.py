"""Media columns by signature sniffing: magic bytes, format validators, corrected types, carved content."""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import typing
import zlib
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.textops import utf8

#: Magic bytes and the format each one announces; RIFF needs its form type too.
MAGIC = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"\xff\xd8\xff": "image/jpeg",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"RIFF": "audio/wav",
    b"BM": "image/bmp",
    b"%PDF-": "application/pdf",
    b"PK\x03\x04": "application/zip",
    b"\x1f\x8b\x08": "application/gzip",
    b"OggS": "audio/ogg",
    b"fLaC": "audio/flac",
}


STRIDE = 512
#: The polynomial of the check sum, lowest power in the highest bit.
CRC32 = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two such polynomials."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (CRC32 if b & 1 else 0)
    return out


#: x to the powers 8, 16, 32, ...: what one, two, four, ... more bytes do to a sum.
MORE = [0x00800000]
for _ in range(47):
    MORE.append(_times(MORE[-1], MORE[-1]))


def crc_shifted(crc: int, n: int) -> int:
    """What a check sum becomes in that of n further bytes: crc32(a + b) is crc_shifted(crc32(a), len(b)) ^ crc32(b)."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            crc = _times(MORE[k], crc)
    return crc


class Buffer:
    """Bytes in which items are looked for. What formats say at their end is listed once, so no hit reads on to the end itself."""

    def __init__(self, data: bytes):
        self.data = data
        self.gif_places: dict[int, int] = {}
        #: For chunk chains: by place the next place, a further one on the chain, its depth, and how many fmt and data chunks lie on it.
        self.riff: dict[int, tuple[int, int, int, int, int]] = {}
        self.png_ends: dict[int, int] = {}
        self.jpeg_places: dict[int, int] = {}
        self.deflated: dict[int, tuple[int, int, int] | None] = {}

    def __len__(self) -> int:
        return len(self.data)

    @cached_property
    def zeros(self) -> np.ndarray:
        return np.flatnonzero(np.frombuffer(self.data, np.uint8) == 0)

    @cached_property
    def sums(self) -> list[int]:
        """Check sums of the first k * STRIDE bytes."""
        view, out = memoryview(self.data), [0]
        for at in range(0, len(self.data) - STRIDE + 1, STRIDE):
            out.append(zlib.crc32(view[at : at + STRIDE], out[-1]))
        return out

    def crc32(self, begin: int, end: int) -> int:
        """The check sum of a range; a long one from those of its ends, so that its length does not matter."""
        view = memoryview(self.data)
        if end - begin <= 8 * STRIDE:
            return zlib.crc32(view[begin:end])
        at = lambda i: zlib.crc32(view[i // STRIDE * STRIDE : i], self.sums[i // STRIDE])
        return at(end) ^ crc_shifted(at(begin), end - begin)

    def riff_holds(self, begin: int, end: int) -> bool:
        """Whether the chunks that go on at `begin` come to `end`, a fmt and a data chunk among them.

        What follows a place does not depend on where the chain began: each place is walked once over all hits, and each
        keeps one far jump, so any place on a chain is found in a logarithmic number of steps.
        """
        data, fresh, at = self.data, [], begin
        while at not in self.riff:
            fresh.append(at)
            if at + 8 > len(data):
                break
            n = struct.unpack_from("<I", data, at + 4)[0]
            at += 8 + n + (n & 1)
        for here in reversed(fresh):
            if here + 8 > len(data):
                self.riff[here] = (here, here, 0, 0, 0)
                continue
            name, n = data[here : here + 4], struct.unpack_from("<I", data, here + 4)[0]
            to = here + 8 + n + (n & 1)
            _, far, depth, fmt, content = self.riff[to]
            farther, level = self.riff[far][1], self.riff[far][2]
            jump = farther if depth - level == level - self.riff[farther][2] else to
            self.riff[here] = (to, jump, depth + 1, fmt + (name == b"fmt "), content + (name == b"data"))
        at = begin
        while at < end:
            to, jump = self.riff[at][:2]
            if to == at:
                return False
            at = jump if jump <= end else to
        return at == end and self.riff[begin][3] > self.riff[end][3] and self.riff[begin][4] > self.riff[end][4]

    def png_end(self, at: int) -> int:
        """End of the PNG whose chunks go on at that place, 0 if they break off or a check sum is wrong; each place once."""
        walked, end = [], 0
        while at not in self.png_ends:
            walked.append(at)
            if at + 12 > len(self.data):
                break
            n, name = struct.unpack_from(">I", self.data, at)[0], self.data[at + 4 : at + 8]
            if at + 12 + n > len(self.data) or self.crc32(at + 4, at + 8 + n) != struct.unpack_from(">I", self.data, at + 8 + n)[0]:
                break
            at += 12 + n
            if name == b"IEND":
                end = at
                break
        else:
            end = self.png_ends[at]
        self.png_ends.update(dict.fromkeys(walked, end))
        return end

    def jpeg_end(self, at: int) -> int:
        """End of the JPEG whose segments go on at that place, 0 if they break off; each place once."""
        data, walked, end = self.data, [], 0
        while at not in self.jpeg_places:
            walked.append(at)
            if at + 4 > len(data) or data[at] != 0xFF:
                break
            kind, n = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            if kind == 0xDA:
                i = bisect.bisect_left(self.jpeg_ends, at + 6)
                end = self.jpeg_ends[i] if i < len(self.jpeg_ends) else 0
                break
            if n < 2:
                break
            at += 2 + n
        else:
            end = self.jpeg_places[at]
        self.jpeg_places.update(dict.fromkeys(walked, end))
        return end

    def inflated(self, at: int) -> tuple[int, int, int] | None:
        """(end, check sum, length of the content) of the deflated blocks that go on at that byte, None if they break off.

        Stored blocks are passed over by their lengths, and each place once over all hits; their sums are those of ranges. Coded
        blocks are inflated from the place where they begin. Raises if those reach back before it: then what went before matters.
        """
        data, walked = self.data, []
        while at not in self.deflated:
            if at + 5 > len(data) and (at >= len(data) or not data[at] & 6):
                self.deflated[at] = None
                break
            if data[at] & 6:
                one, to, crc, n = zlib.decompressobj(-15), at, 0, 0
                try:
                    while not one.eof and to < len(data):
                        left = memoryview(data)[to : to + (1 << 16)]
                        to += len(left)
                        while len(left) and not one.eof:
                            out = one.decompress(left, 1 << 20)
                            crc, n, left = zlib.crc32(out, crc), n + len(out), one.unconsumed_tail
                except zlib.error as error:
                    if "too far back" in str(error) and walked:
                        raise
                    self.deflated[at] = None
                    break
                self.deflated[at] = (to - len(one.unused_data), crc, n) if one.eof else None
                break
            n, check = struct.unpack_from("<HH", data, at + 1)
            if n ^ check != 0xFFFF or at + 5 + n > len(data):
                self.deflated[at] = None
                break
            if data[at] & 1:
                self.deflated[at] = (at + 5 + n, self.crc32(at + 5, at + 5 + n), n)
                break
            walked.append((at, n))
            at += 5 + n
        rest = self.deflated[at]
        for here, n in reversed(walked):
            rest = rest and (rest[0], crc_shifted(self.crc32(here + 5, here + 5 + n), rest[2]) ^ rest[1], n + rest[2])
            self.deflated[here] = rest
        return rest

    @cached_property
    def jpeg_ends(self) -> list[int]:
        return [m.end() for m in re.finditer(rb"\xff\xd9", self.data)]

    @cached_property
    def zip_ends(self) -> dict[int, int]:
        """Each archive's end by its start: the end record says how far before it the archive begins."""
        out = {}
        for m in re.finditer(rb"PK\x05\x06", self.data):
            at = m.start()
            if at + 22 > len(self.data):
                break
            n, size, where, note = struct.unpack_from("<HIIH", self.data, at + 10)
            start, end = at - size - where, at + 22 + note
            if start >= 0 and end <= len(self.data) and (self.data.startswith(b"PK\x01\x02", start + where) if n else not size):
                out[start] = end
        return out

    @cached_property
    def pdf_ends(self) -> dict[int, int]:
        """Each document's last end by its start: a trailer gives the distance from the start to its table of objects."""
        tables = [m.start() for m in re.finditer(rb"(?<!start)xref\s|\b\d{1,10} \d{1,5} obj\b", self.data)]
        out = {}
        for m in re.finditer(rb"startxref\s{1,4}(\d{1,15})\s{1,4}%%EOF", self.data):
            i = bisect.bisect_left(tables, m.start()) - 1
            # The table is the last thing before its trailer that can be one; a trailer between holds no object.
            if i >= 0 and (start := tables[i] - int(m[1])) >= 0:
                out[start] = m.end()
        return out


    def gif_end(self, at: int) -> int:
        """End of the GIF whose blocks go on at that place, 0 if they break off.

        What follows a place does not depend on what went before, so over all hits each place is walked once.
        """
        data, walked, inside = self.data, [], False
        while (state := 2 * at + inside) not in self.gif_places:
            walked.append(state)
            end = None
            if at >= len(data):
                end = 0
            elif inside:
                at, inside = at + data[at] + 1, data[at] > 0
            elif data[at] == 0x3B:
                end = at + 1
            elif data[at] == 0x21:
                at, inside = at + 2, True
            elif data[at] == 0x2C and at + 10 < len(data):
                at, inside = at + 11 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0), True
            else:
                end = 0
            if end is not None:
                self.gif_places[state] = end
                break
        end = self.gif_places[state]
        self.gif_places.update(dict.fromkeys(walked, end))
        return end


def _wav(buffer: Buffer, start: int) -> int:
    """Length of the RIFF/WAVE file that begins there, 0 if its chunks don't add up."""
    data = buffer.data
    if start + 44 > len(data) or data[start + 8 : start + 12] != b"WAVE":
        return 0
    total = start + 8 + struct.unpack_from("<I", data, start + 4)[0]
    if total > len(data):
        return 0
    return total - start if buffer.riff_holds(start + 12, total) else 0


def _png(buffer: Buffer, start: int) -> int:
    data, at = buffer.data, start + 8
    if at + 12 > len(data) or data[at + 4 : at + 8] != b"IHDR" or struct.unpack_from(">I", data, at)[0] != 13:
        return 0
    end = buffer.png_end(at)
    return end - start if end else 0


def _jpeg(buffer: Buffer, start: int) -> int:
    end = buffer.jpeg_end(start + 2)
    return end - start if end else 0


def _gif(buffer: Buffer, start: int) -> int:
    data = buffer.data
    if start + 14 > len(data):
        return 0
    end = buffer.gif_end(start + 13 + (3 << (data[start + 10] & 7) + 1 if data[start + 10] & 0x80 else 0))
    return end - start if end else 0


def _bmp(buffer: Buffer, start: int) -> int:
    if start + 30 > len(buffer):
        return 0
    total, _, where, head = struct.unpack_from("<IIII", buffer.data, start + 2)
    return total if head in (12, 40, 52, 56, 108, 124) and 26 <= where <= total <= len(buffer) - start else 0


def _pdf(buffer: Buffer, start: int) -> int:
    end = buffer.pdf_ends.get(start, start)
    return end - start if buffer.data[start + 5 : start + 6].isdigit() else 0


def _zip(buffer: Buffer, start: int) -> int:
    return buffer.zip_ends.get(start, start) - start


def _gzip(buffer: Buffer, start: int) -> int:
    """Head, deflated blocks, then the sum and the length of their content."""
    data, at = buffer.data, start + 10
    if at > len(data) or (flags := data[start + 3]) & 0xE0:
        return 0
    if flags & 4:
        if at + 2 > len(data):
            return 0
        at += 2 + struct.unpack_from("<H", data, at)[0]
    for kind in (8, 16):
        if flags & kind:
            i = int(np.searchsorted(buffer.zeros, at))
            if i == len(buffer.zeros):
                return 0
            at = int(buffer.zeros[i]) + 1
    if flags & 2:
        if at + 2 > len(data) or buffer.crc32(start, at) & 0xFFFF != struct.unpack_from("<H", data, at)[0]:
            return 0
        at += 2
    try:
        found = buffer.inflated(at) if at <= len(data) else None
    except zlib.error:
        return _inflate(buffer, start)
    if not found or found[0] + 8 > len(data) or struct.unpack_from("<II", data, found[0]) != (found[1], found[2] & 0xFFFFFFFF):
        return 0
    return found[0] + 8 - start


def _inflate(buffer: Buffer, start: int) -> int:
    """The same by reading from the head on, for coded blocks that repeat what stored ones before them hold."""
    view, one, at = memoryview(buffer.data), zlib.decompressobj(31), start
    try:
        while not one.eof and at < len(view):
            left = view[at : at + (1 << 16)]
            at += len(left)
            while len(left) and not one.eof:
                one.decompress(left, 1 << 20)
                left = one.unconsumed_tail
        return at - len(one.unused_data) - start if one.eof else 0
    except zlib.error:
        return 0


def _ogg(buffer: Buffer, start: int) -> int:
    """Pages from one that begins a stream to the last that follows without a gap."""
    data, at = buffer.data, start
    while at + 27 <= len(data) and data.startswith(b"OggS\0", at) and (at > start or data[at + 5] & 2):
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        if at + 27 + n > len(data) or end > len(data):
            break
        at = end
    return at - start


def _crc_table(poly: int, bits: int) -> list[int]:
    out, top = [], 1 << bits - 1
    for x in range(256):
        x <<= bits - 8
        for _ in range(8):
            x = (x << 1 ^ poly) if x & top else x << 1
        out.append(x & (1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _flac_frame(data: bytes, at: int) -> int:
    """Length of the frame header at that place, 0 if it is none: sync code, coded number, check sum."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 2] >> 4 == 0 or data[at + 2] & 15 == 15 or data[at + 3] & 1:
        return 0
    first = data[at + 4]
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    if first >= 0x80 and not 1 <= more <= 6:
        return 0
    n = 5 + more + {6: 1, 7: 2}.get(data[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
    if at + n >= len(data):
        return 0
    crc = 0
    for x in data[at : at + n]:
        crc = CRC8[crc ^ x]
    return n + 1 if crc == data[at + n] else 0


def _flac_samples(data: bytes, at: int) -> int:
    """Samples in the frame at that place, from its header."""
    code = data[at + 2] >> 4
    if code in (6, 7):
        first = data[at + 4]
        place = at + 5 + (0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1)
        return 1 + int.from_bytes(data[place : place + code - 5], "big")
    return 192 if code == 1 else 576 << code - 2 if code < 6 else 256 << code - 8


def _flac(buffer: Buffer, start: int) -> int:
    """Metadata blocks, then frames whose check sums hold, up to the number of samples that the head states."""
    data, at, last = buffer.data, start + 4, False
    if data[at + 1 : at + 4] != b"\x00\x00\x22" or at + 38 > len(data) or data[at] & 0x7F:
        return 0
    least, most = (int.from_bytes(data[at + i : at + i + 3], "big") for i in (8, 11))
    total = int.from_bytes(data[at + 17 : at + 22], "big") & (1 << 36) - 1
    while not last and at + 4 <= len(data):
        last = bool(data[at] & 0x80)
        at += 4 + int.from_bytes(data[at + 1 : at + 4], "big")
    done = 0
    while last and (n := _flac_frame(data, at)):
        done += _flac_samples(data, at)
        crc, first, end = 0, 0, 0
        for i in range(at, min(len(data), at + (most or 1 << 24))):
            crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ data[i]]
            # Over a frame with its own sum the check sum is zero; the last sample or a further frame must be due there.
            if not crc and i + 1 - at >= max(least, n + 3):
                if (total and done >= total) or _flac_frame(data, i + 1):
                    end = i + 1
                    break
                first = first or i + 1
        at = end or (0 if total else first)
        if not at or (total and done >= total):
            break
    return at - start if at and done and (done >= total if total else last) else 0


VALIDATE = {
    "audio/wav": _wav, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac,
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(data: bytes, found) -> list[tuple[int, int, str]]:
    """(start, length, type) of every outermost confirmed item, in order; items inside one that is confirmed are its own."""
    buffer, out, free = Buffer(data), [], 0
    for end, (n, kind) in found.iter(data.decode("latin-1")):
        at = end - n + 1
        if at >= free and (length := VALIDATE[kind](buffer, at)):
            out.append((at, length, kind))
            free = at + length
    return out


def identify(df: DataFrame, content: str = "content", declared: str | None = None, into: str = "media") -> DataFrame:
    """Adds a struct column: true type of the bytes, whether the declared type was wrong, and the items carved from inside.

    Null content: type null, nothing carved. Unconfirmed and empty bytes: application/octet-stream. Overlapping items: the one
    that begins first. Very long content: one value in memory at a time, read once whatever magic bytes it repeats.
    Repeated rows: each on its own. Empty table: no rows. Every other column is kept, but one named as `into` is replaced.
    """
    schema = "type string, corrected boolean, items array<struct<start:long,length:long,type:string,sha256:string>>"

    def read(cols: typing.Iterator[tuple[pd.Series, ...]]) -> typing.Iterator[pd.DataFrame]:
        found = automaton()
        for content_, declared_ in cols:
            rows = []
            for data, said in zip(content_, declared_):
                if data is None:
                    rows.append((None, None, []))
                    continue
                items = sniff(bytes(data), found)
                kind = items[0][2] if items and items[0][0] == 0 else "application/octet-stream"
                rows.append((kind, said is not None and said != kind, [{"start": a, "length": n, "type": k, "sha256": hashlib.sha256(data[a : a + n]).hexdigest()} for a, n, k in items]))
            yield pd.DataFrame(rows, columns=["type", "corrected", "items"])

    said = F.col(declared).cast("string") if declared else F.lit(None).cast("string")
    return df.withColumn(into, F.pandas_udf(read, schema)(F.col(content), said))


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """8-bit mono samples, one per payload byte, in a RIFF/WAVE file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload


def samples(stored: bytes) -> bytes:
    """The data chunk of a confirmed RIFF/WAVE file."""
    at = 12
    while at + 8 <= len(stored):
        name, n = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if name == b"data":
            return stored[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def padded(text: str | None, unit: int = 64) -> bytes:
    """The text's UTF-8 bytes and zeros up to a positive multiple of `unit`."""
    raw = utf8(text)
    return raw + bytes(-len(raw) % unit if raw else unit)


def store_texts(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """Adds each text as a WAV file of 8-bit samples (binary column `into`), one per padded byte, and n_bytes before padding.

    Null text: as empty, 64 zeros. Repeated rows: equal files. Very long texts: one at a time (a file ends at 4 GB). Empty
    table: no rows. Map-only; every other column is kept, but those named as `into` and n_bytes are replaced.
    """

    def write(texts: pd.Series) -> pd.Series:
        return pd.Series([wav(padded(x)) for x in texts], dtype=object)

    body = F.col(text).cast("string")
    return docs.withColumn(into, F.pandas_udf(write, "binary")(body)).withColumn("n_bytes", F.coalesce(F.octet_length(body), F.lit(0)).cast("long"))


SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_file(stored: bytes, found) -> tuple:
    items = sniff(stored, found)
    if not items or items[0] != (0, len(stored), "audio/wav"):
        raise ValueError("not one whole WAV file")
    back = samples(stored)
    inner = sniff(back, found)
    wave = np.frombuffer(back, np.uint8)
    kind = inner[0][2] if inner and inner[0][0] == 0 else "text/plain"
    feature = f"{kind};min={wave.min()};max={wave.max()};sum={int(wave.sum(dtype=np.int64))};carved=" + ",".join(f"{k}@{a}+{n}" for a, n, k in inner)
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature


def read_back(df: DataFrame, media: str = "media", into: str = "samples") -> DataFrame:
    """Adds a struct of what the stored files hold: they are recognised by signature, confirmed, and their samples carved.

    A file that is not one whole WAV file fails the job: the store would not be lossless. Null media: null fields.
    feature: type of the samples as bytes (text/plain if no signature is confirmed), their range and sum, carved items.
    Repeated rows: each on its own. Very long files: one at a time. Empty table: no rows. Every other column is kept, but
    one named as `into` is replaced.
    """

    def read(files: typing.Iterator[pd.Series]) -> typing.Iterator[pd.DataFrame]:
        found = automaton()
        for batch in files:
            yield pd.DataFrame([(None,) * 6 if x is None else read_file(bytes(x), found) for x in batch], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.withColumn(into, F.pandas_udf(read, SCHEMA)(F.col(media)))
