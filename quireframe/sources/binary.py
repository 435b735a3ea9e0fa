"""Binary evidence: raster headers, metafile records and streams of compound files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vectorized import vectorized

# Metafile functions that write text, draw, or only change state.
TEXT_RECORDS = (0x0521, 0x0A32)
DRAWING_RECORDS = (0x0213, 0x0418, 0x0419, 0x041B, 0x041F, 0x061C, 0x061D, 0x0817, 0x081A, 0x0830, 0x0922, 0x0B23, 0x0324, 0x0325, 0x0228, 0x0429, 0x012A, 0x012B, 0x0538, 0x0940, 0x0B41, 0x0F43, 0x0548)
STATE_RECORDS = (
    0x0000, 0x001E, 0x0102, 0x0103, 0x0104, 0x0105, 0x0106, 0x0107, 0x0108, 0x0109, 0x0127, 0x012D, 0x012E, 0x012F, 0x0139, 0x0142, 0x01F0, 0x0201, 0x0209, 0x020A, 0x020B, 0x020C, 0x020D, 0x020E, 0x020F,
    0x0211, 0x0214, 0x0220, 0x022C, 0x0231, 0x0234, 0x0235, 0x02FA, 0x02FB, 0x02FC, 0x02FD, 0x02FE, 0x0300, 0x0320,
)
ESCAPE, COMMENT, PLACEABLE = 0x0626, 15, 0x9AC6CDD7
# Bytes and records that a metafile may have, bytes of its comments, bytes of an object and of its payload.
MAX_METAFILE, MAX_RECORDS, MAX_COMMENTS, MAX_OBJECT, MAX_PAYLOAD = 64 << 20, 250_000, 16 << 20, 64 << 20, 16 << 20

METAFILE = "placeable boolean, records array<struct<at:bigint,size:bigint,function:int,comment:binary>>, warnings array<string>, error string"


def metafile(data: bytes) -> tuple:
    """(placeable, records, warnings, error) of a classic metafile; only comments keep their bytes."""
    warnings, records, held = [], [], 0
    if len(data) > MAX_METAFILE:
        return False, records, warnings, "the metafile is too large"
    placeable = len(data) >= 22 and data[:4] == struct.pack("<I", PLACEABLE)
    at = 22 if placeable else 0
    if placeable:
        words = struct.unpack_from("<11H", data)
        check = 0
        for w in words[:10]:
            check ^= w
        if check != words[10]:
            warnings.append("placeable header checksum mismatch")
        left, top, right, bottom, inch = struct.unpack_from("<hhhhH", data, 6)
        if not inch or right <= left or bottom <= top:
            warnings.append("placeable header has invalid geometry")
    if len(data) < at + 18:
        return placeable, records, warnings, "truncated METAHEADER"
    kind, words, version = struct.unpack_from("<HHH", data, at)
    if kind not in (1, 2) or words < 9 or version not in (0x0100, 0x0300):
        return placeable, records, warnings, "invalid WMF METAHEADER"
    at += 2 * words
    while at + 6 <= len(data):
        size, function = struct.unpack_from("<IH", data, at)
        if size < 3 or at + 2 * size > len(data):
            return placeable, records, warnings, "truncated or invalid WMF record table"
        comment = None
        if function == ESCAPE and size >= 5:
            escape, n = struct.unpack_from("<HH", data, at + 6)
            comment = data[at + 10 : at + 2 * size][:n] if escape == COMMENT else None
        held += len(comment or b"")
        if len(records) == MAX_RECORDS or held > MAX_COMMENTS:
            return placeable, records, warnings, "too many records or comments"
        records.append((at, 2 * size, function, comment))
        at += 2 * size
        if not function:
            return placeable, records, warnings, None
    return placeable, records, warnings, "WMF record table has no META_EOF"


@vectorized(METAFILE)
def metafile_records(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([metafile(bytes(d)) if d is not None else (None, None, None, "no data") for d in data], columns=["placeable", "records", "warnings", "error"])


def metafile_summary(m: Column) -> dict[str, Column]:
    """Counts by class of record, and whether anything can be seen."""

    def count(test) -> Column:
        return F.size(F.filter(m["records"], test)).cast("long")

    drawing, text = count(lambda r: r["function"].isin(*DRAWING_RECORDS)), count(lambda r: r["function"].isin(*TEXT_RECORDS))
    unknown = count(lambda r: ~r["function"].isin(*TEXT_RECORDS, *DRAWING_RECORDS, *STATE_RECORDS) & r["comment"].isNull())
    state = F.when(drawing + text > 0, "visible").when(m["error"].isNull() & (unknown == 0), "empty").otherwise("uncertain")
    return {"n_records": F.size(m["records"]).cast("long"), "drawing": drawing, "text": text, "unknown": unknown, "visual_state": state}


# Where an equation's data may lie in its object, in order.
EQUATION_STREAMS = ("Equation Native", "EquationNative", "Equation")
FREE, END_OF_CHAIN = 0xFFFFFFFF, 0xFFFFFFFE


class CompoundFile:
    """Streams of a compound file by name; chains that loop or leave the file are errors."""

    def __init__(self, data: bytes) -> None:
        if len(data) < 512 or data[:8] != bytes.fromhex("d0cf11e0a1b11ae1"):
            raise ValueError("not a compound file")
        self.data = data
        sector, mini = struct.unpack_from("<HH", data, 30)
        self.size, self.mini_size = 1 << sector, 1 << mini
        (directory,) = struct.unpack_from("<I", data, 48)
        self.cutoff, mini_fat, _, difat, _ = struct.unpack_from("<5I", data, 56)
        tables = list(struct.unpack_from("<109I", data, 76))
        width, seen = self.size // 4, set()
        while difat < END_OF_CHAIN - 1 and difat not in seen:
            seen.add(difat)
            *more, difat = struct.unpack(f"<{width}I", self.sector(difat))
            tables += more
        self.fat = [x for t in tables if t < END_OF_CHAIN - 2 for x in struct.unpack(f"<{width}I", self.sector(t))]
        entries = self.chain(directory, self.fat, self.sector)
        self.entries = {}
        root = None
        for at in range(0, len(entries), 128):
            e = entries[at : at + 128]
            length, kind = struct.unpack_from("<HB", e, 64)
            start, size = struct.unpack_from("<IQ", e, 116)
            if kind == 5:
                root = start, size
            if kind == 2:
                self.entries.setdefault(e[: max(0, length - 2)].decode("utf-16-le"), (start, size & 0xFFFFFFFF))
        small = self.chain(mini_fat, self.fat, self.sector) if mini_fat < END_OF_CHAIN - 1 else b""
        self.mini_fat = struct.unpack(f"<{len(small) // 4}I", small)
        self.mini = self.chain(root[0], self.fat, self.sector)[: root[1]] if root and root[0] < END_OF_CHAIN - 1 else b""

    def sector(self, i: int) -> bytes:
        at = (i + 1) * self.size
        if at + self.size > len(self.data):
            raise ValueError("a sector lies outside the file")
        return self.data[at : at + self.size]

    def chain(self, start: int, table, read) -> bytes:
        out, seen = [], set()
        while start < END_OF_CHAIN - 1:
            if start in seen or start >= len(table):
                raise ValueError("a chain is broken")
            seen.add(start)
            out.append(read(start))
            start = table[start]
        return b"".join(out)

    def stream(self, name: str) -> bytes:
        start, size = self.entries[name]
        small = lambda i: self.mini[i * self.mini_size : (i + 1) * self.mini_size]
        data = self.chain(start, self.mini_fat, small) if size < self.cutoff else self.chain(start, self.fat, self.sector)
        return data[:size]


def equation(data: bytes | None) -> tuple:
    """(payload, state, error): an equation's data without its 28-byte header."""
    if len(data or b"") > MAX_OBJECT:
        return None, "too_large", "the object is too large"
    try:
        file = CompoundFile(data or b"")
        native = next((file.stream(n) for n in EQUATION_STREAMS if n in file.entries), None)
        if native is None:
            return None, "unknown", "no equation stream"
        if len(native) < 28:
            return None, "corrupted", "the stream is shorter than its header"
        header, size = struct.unpack_from("<H6xI", native)
        payload = native[28:] if header == 28 else native
        if header == 28 and 0 < size <= len(payload):
            payload = payload[:size]
        if len(payload) > MAX_PAYLOAD:
            return None, "too_large", "the payload is too large"
        return (payload, "present", None) if len(payload) > 1 and payload[0] in (3, 5) else (None, "corrupted", "invalid payload")
    except (ValueError, struct.error, UnicodeDecodeError) as e:
        return None, "corrupted", str(e)


@vectorized("payload binary, state string, error string")
def equation_payload(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([equation(d) for d in data], columns=["payload", "state", "error"])


def raster(data: bytes | None) -> tuple:
    """(format, width, height) from a picture's first bytes; nulls where they say nothing."""
    d = data or b""
    try:
        if d[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack_from(">II", d, 16)
        if d[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack_from("<HH", d, 6)
        if d[:2] == b"BM":
            w, h = struct.unpack_from("<ii", d, 18)
            return "bmp", w, abs(h)
        if d[:4] == b"RIFF" and d[8:12] == b"WEBP":
            if d[12:16] == b"VP8X":
                return "webp", int.from_bytes(d[24:27], "little") + 1, int.from_bytes(d[27:30], "little") + 1
            if d[12:16] == b"VP8L":
                bits = int.from_bytes(d[21:25], "little")
                return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            w, h = struct.unpack_from("<HH", d, 26)
            return "webp", w & 0x3FFF, h & 0x3FFF
        if d[:4] in (b"II*\0", b"MM\0*"):
            order = "<" if d[:1] == b"I" else ">"
            (at,) = struct.unpack_from(order + "I", d, 4)
            tags = {}
            for i in range(struct.unpack_from(order + "H", d, at)[0]):
                tag, kind = struct.unpack_from(order + "HH", d, at + 2 + 12 * i)
                tags[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), d, at + 10 + 12 * i)[0]
            return "tiff", tags.get(256), tags.get(257)
        if d[:2] == b"\xff\xd8":
            at = 2
            while at < len(d):
                mark, size = d[at + 1], struct.unpack_from(">H", d, at + 2)[0]
                if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack_from(">HH", d, at + 5)
                    return "jpeg", w, h
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return None, None, None


@vectorized("format string, width long, height long")
def raster_header(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([raster(d) for d in data], columns=["format", "width", "height"]).astype({"width": "Int64", "height": "Int64"})
