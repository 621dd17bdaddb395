"""Bytes of pages to text, with what was lost on the way."""

from __future__ import annotations

import codecs
import re
import zlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparquill.functions import references
from sparquill.functions.pieces import by_pieces

# Fixed values.
BOMS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
DEFAULT, WIDER = "euc_jp", "euc_jis_2004"
META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
HEADER = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)
SNIFFED, MAX_BODY = 64 << 10, 24 << 20

DECODED = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("lossy", T.BooleanType()),
    # replacement characters that the page holds itself, and those that decoding put in
    T.StructField("literal", T.LongType()), T.StructField("introduced", T.LongType()), T.StructField("error_code", T.StringType()),
])


# Codecs that are no character sets of pages.
NO_CHARSETS = frozenset(("idna", "punycode", "unicode-escape", "unicode_escape", "raw-unicode-escape", "raw_unicode_escape", "undefined"))


def codec(label: str | None) -> str | None:
    """The character set of a label, null for others."""
    try:
        found = codecs.lookup((label or "").strip())
    except (LookupError, ValueError):
        return None
    return found.name if getattr(found, "_is_text_encoding", True) and found.name not in NO_CHARSETS else None


def inflate(raw: bytes, encoding: str | None) -> bytes:
    """A body without its content coding; ValueError names what is wrong.  No more
    than MAX_BODY bytes are unpacked, however much a small body holds."""
    kind = (encoding or "identity").strip().lower()
    if kind == "identity":
        if len(raw) > MAX_BODY:
            raise ValueError("page_too_large")
        return raw
    if kind not in ("gzip", "x-gzip", "deflate"):
        raise ValueError("unsupported_compression")
    try:
        if kind == "deflate":
            try:
                return unpacked(raw, zlib.MAX_WBITS)
            except zlib.error:
                return unpacked(raw, -zlib.MAX_WBITS)
        return unpacked(raw, 16 + zlib.MAX_WBITS)
    except (EOFError, zlib.error) as e:
        raise ValueError("invalid_compression") from e


def unpacked(raw: bytes, window: int) -> bytes:
    """One zlib stream, or the members of a gzip body one after the other."""
    out, size = [], 0
    while raw:
        stream = zlib.decompressobj(window)
        part = stream.decompress(raw, MAX_BODY + 1 - size)
        size += len(part)
        if size > MAX_BODY:
            raise ValueError("page_too_large")
        if not stream.eof:
            raise EOFError
        out.append(part)
        raw = stream.unused_data.lstrip(b"\0") if window > zlib.MAX_WBITS else b""
    return b"".join(out)


def decode_page(raw: bytes, content_type: str | None, override: str | None = None) -> tuple[str, str, bool]:
    """Text, encoding and whether characters were replaced.  An override goes
    first, then the header, a byte order mark, a meta element, the default; strict
    decoding first, the default's wider form next."""
    if override is not None and codec(override) is None:
        raise ValueError("invalid_encoding")
    header = HEADER.search(content_type or "")
    bom = next((c for mark, c in BOMS if raw.startswith(mark)), None)
    meta = META.search(raw[:SNIFFED])
    name = codec(override) or codec(header[1] if header else None) or bom or codec(meta[1].decode() if meta else None) or DEFAULT
    for attempt in (name, WIDER) if name == DEFAULT else (name,):
        try:
            return raw.decode(attempt), attempt, False
        except UnicodeError:
            pass
    return raw.decode(name, "replace"), name, True


def replacement_counts(raw: bytes, text: str, encoding: str) -> tuple[int, int]:
    """How many replacement characters were in the bytes, and how many are new."""
    total = text.count("\ufffd")
    try:
        literal = min(total, raw.count("\ufffd".encode(encoding)))
    except UnicodeError:
        literal = 0
    return literal, total - literal


def decode(bodies, content_types, codings, override: str | None = None):
    """A column of ``DECODED`` for columns of bodies, content types and codings."""
    return decode_as(bodies, content_types, codings, F.lit(override).cast("string"))


@by_pieces(DECODED, 4)
def decode_as(bodies: pd.Series, content_types: pd.Series, codings: pd.Series, overrides: pd.Series) -> pd.DataFrame:
    rows = []
    for raw, kind, coding, override in zip(bodies, content_types, codings, overrides, strict=True):
        if raw is None:
            rows.append((None, None, None, None, None, "no_body"))
            continue
        try:
            body = inflate(bytes(raw), coding)
            text, encoding, lossy = decode_page(body, kind, override)
            rows.append((text, encoding, lossy, *replacement_counts(body, text, encoding), None))
        except ValueError as e:
            rows.append((None, None, None, None, None, str(e)))
    return pd.DataFrame(rows, columns=DECODED.fieldNames())


def encode_title(title: str) -> str | None:
    """Percent-escaped EUC-JP bytes of a title, the wider form only where it must
    be; null unless they decode to the title again."""
    for name in (DEFAULT, WIDER):
        try:
            raw = title.encode(name)
            if raw.decode(name) == title:
                return "".join(chr(b) if re.match(rb"[A-Za-z0-9_.~-]", bytes([b])) else f"%{b:02X}" for b in raw)
        except UnicodeError:
            pass
    return None


@F.pandas_udf(T.StringType())
def title_escape(titles: pd.Series) -> pd.Series:
    return titles.map(encode_title, na_action="ignore")


#: Two references to the halves of one character, one behind the other.
SURROGATE_PAIR = "&#(?:[xX]0*[dD][89a-bA-B][0-9a-fA-F]{2}|0*5(?:529[6-9]|5[3-9][0-9]{2}|6[0-2][0-9]{2}|63[01][0-9]));&#(?:[xX]0*[dD][c-fC-F][0-9a-fA-F]{2}|0*5(?:6[3-9][0-9]{2}|7[0-3][0-9]{2}));"


def repaired(pages, html: str = "html"):
    """``pages`` with surrogate pairs joined where references count (see ``references``)."""
    return references.prepared(pages, html, "utf16").drop("references")


# --- bytes beyond the default character set -------------------------------------

# One unit of two-byte text beyond ASCII; row 13 of its plane, and that row's lead byte in the vendor's set.
UNIT = re.compile(rb"\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}|[\xa1-\xfe]{2}|[\x80-\xff]")
SHARED_ROW, VENDOR_LEAD = 0xAD, 0x87
PLACES = T.ArrayType(T.StructType([T.StructField("unit", T.BinaryType()), T.StructField("offset", T.LongType()), T.StructField("line", T.LongType())]))


def _fits(unit: bytes, name: str) -> bool:
    try:
        unit.decode(name)
    except UnicodeError:
        return False
    return True


@by_pieces(PLACES)
def odd_units(bodies: pd.Series) -> pd.Series:
    """Units of a body that the default character set lacks: bytes, offset (from
    0) and line (from 1) of each."""
    known: dict[bytes, bool] = {}
    out = []
    for raw in bodies:
        found, line, seen = [], 1, 0
        for m in UNIT.finditer(raw or b""):
            unit = m[0]
            if known.setdefault(unit, _fits(unit, DEFAULT)):
                continue
            line, seen = line + raw.count(b"\n", seen, m.start()), m.start()
            found.append({"unit": unit, "offset": m.start(), "line": line})
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(T.StringType())
def unit_category(units: pd.Series) -> pd.Series:
    """undecodable_unit where the wider set lacks it too; common_nec_mapping_agrees
    where a vendor's set has the same sign; else source_mapping_unconfirmed."""

    def category(unit: bytes) -> str:
        if not _fits(unit, WIDER):
            return "undecodable_unit"
        if len(unit) == 2 and unit[0] == SHARED_ROW:
            cell = unit[1] - 0xA0  # of the row; in the vendor's set cells begin at 0x40 and leave out 0x7F
            other = bytes((VENDOR_LEAD, 0x3F + cell + (cell > 63)))
            if _fits(other, "cp932") and other.decode("cp932") == unit.decode(WIDER):
                return "common_nec_mapping_agrees"
        return "source_mapping_unconfirmed"

    return units.map(lambda u: category(bytes(u)), na_action="ignore")
