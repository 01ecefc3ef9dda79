"""File signatures, and what the bytes of a file say about its size and kind."""

from __future__ import annotations

import struct
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Signature(NamedTuple):
    """A kind of file by its header, perhaps at an offset, and perhaps its footer and a parser of its size."""

    name: str
    extension: str
    file_type: str
    header: bytes
    offset: int
    footer: bytes
    max_mb: int
    parser: str


# Name, extension, type, header, its offset, footer, largest size in MB, parser. The order decides: of several headers at a place the first counts.
_TABLE = """
JPEG | jpg | Image | FFD8FF | 0 | FFD9 | 50 | jpeg
PNG | png | Image | 89504E470D0A1A0A | 0 | 0000000049454E44AE426082 | 100 | png
GIF87a | gif | Image | 474946383761 | 0 | 003B | 50 | gif
GIF89a | gif | Image | 474946383961 | 0 | 003B | 50 | gif
BMP | bmp | Image | 424D | 0 |  | 200 | bmp
TIFF-LE | tiff | Image | 49492A00 | 0 |  | 500 | 
TIFF-BE | tiff | Image | 4D4D002A | 0 |  | 500 | 
WebP | webp | Image | 52494646 | 0 |  | 100 | riff
HEIF/HEIC | heic | Image | 66747970 | 4 |  | 100 | 
MP4 | mp4 | Video | 66747970 | 4 |  | 4096 | 
AVI | avi | Video | 52494646 | 0 |  | 4096 | riff
MKV | mkv | Video | 1A45DFA3 | 0 |  | 8192 | 
FLV | flv | Video | 464C5601 | 0 |  | 4096 | 
MP3-ID3 | mp3 | Audio | 494433 | 0 |  | 100 | 
MP3-Sync | mp3 | Audio | FFFB | 0 |  | 100 | 
WAV | wav | Audio | 52494646 | 0 |  | 2048 | riff
FLAC | flac | Audio | 664C6143 | 0 |  | 500 | flac
OGG | ogg | Audio | 4F676753 | 0 |  | 500 | 
M4A/AAC | m4a | Audio | 66747970 | 4 |  | 500 | 
PDF | pdf | Document | 25504446 | 0 | 2525454F46 | 500 | pdf
DOCX/XLSX/PPTX | docx | Document | 504B0304 | 0 |  | 200 | zip
DOC/XLS/PPT | doc | Document | D0CF11E0A1B11AE1 | 0 |  | 200 | 
RTF | rtf | Document | 7B5C727466 | 0 | 7D | 100 | 
ZIP | zip | Archive | 504B0304 | 0 |  | 4096 | zip
RAR5 | rar | Archive | 526172211A070100 | 0 |  | 4096 | 
RAR4 | rar | Archive | 526172211A0700 | 0 |  | 4096 | 
7z | 7z | Archive | 377ABCAF271C | 0 |  | 4096 | 
GZIP | gz | Archive | 1F8B08 | 0 |  | 2048 | 
XZ | xz | Archive | FD377A585A00 | 0 |  | 4096 | 
BZIP2 | bz2 | Archive | 425A68 | 0 |  | 2048 | 
ELF | elf | Executable | 7F454C46 | 0 |  | 500 | 
PE/EXE | exe | Executable | 4D5A | 0 |  | 500 | 
SQLite | sqlite | Database | 53514C69746520666F726D6174203300 | 0 |  | 2048 | 
Canon CR2 | cr2 | Image | 49492A00100000004352 | 0 |  | 100 | 
Nikon NEF | nef | Image | 4D4D002A | 0 |  | 100 | 
Sony ARW | arw | Image | 49492A0008000000 | 0 |  | 100 | 
Adobe DNG | dng | Image | 49492A00 | 0 |  | 200 | 
Photoshop PSD | psd | Image | 38425053 | 0 |  | 2048 | 
Adobe Illustrator / EPS | eps | Image | 252150532D41646F6265 | 0 | 2525454F46 | 200 | 
SVG | svg | Image | 3C3F786D6C | 0 | 3C2F7376673E | 50 | 
ICO | ico | Image | 00000100 | 0 |  | 10 | 
GIMP XCF | xcf | Image | 67696D7020786366 | 0 |  | 2048 | 
WebM | webm | Video | 1A45DFA3 | 0 |  | 4096 | 
MPEG-TS | ts | Video | 47 | 0 |  | 8192 | 
MPEG-PS | mpg | Video | 000001BA | 0 |  | 4096 | 
WMV/ASF | wmv | Video | 3026B2758E66CF11 | 0 |  | 4096 | 
AIFF | aiff | Audio | 464F524D | 0 |  | 2048 | 
MIDI | mid | Audio | 4D546864 | 0 |  | 10 | 
WMA | wma | Audio | 3026B2758E66CF11 | 0 |  | 500 | 
Opus | opus | Audio | 4F676753 | 0 |  | 500 | 
EPUB | epub | Document | 504B0304 | 0 |  | 500 | zip
OpenDocument ODT | odt | Document | 504B0304 | 0 |  | 200 | zip
XML | xml | Document | 3C3F786D6C | 0 |  | 100 | 
HTML | html | Code | 3C21444F43545950452068746D6C | 0 | 3C2F68746D6C3E | 50 | 
HTML-lower | html | Code | 3C68746D6C | 0 | 3C2F68746D6C3E | 50 | 
TAR | tar | Archive | 7573746172 | 257 |  | 8192 | 
ISO 9660 | iso | Archive | 4344303031 | 32769 |  | 8192 | 
ZSTD | zst | Archive | 28B52FFD | 0 |  | 4096 | 
LZ4 | lz4 | Archive | 04224D18 | 0 |  | 4096 | 
Mach-O 64 | macho | Executable | FEEDFACF | 0 |  | 500 | 
Mach-O 32 | macho | Executable | FEEDFACE | 0 |  | 500 | 
Java Class | class | Executable | CAFEBABE | 0 |  | 50 | 
DEX (Android) | dex | Executable | 6465780A | 0 |  | 100 | 
WASM | wasm | Executable | 0061736D | 0 |  | 100 | 
TrueType Font | ttf | Other | 0001000000 | 0 |  | 50 | 
OpenType/WOFF2 | woff2 | Other | 774F4632 | 0 |  | 50 | 
WOFF | woff | Other | 774F4646 | 0 |  | 50 | 
PEM Certificate | pem | Other | 2D2D2D2D2D424547494E | 0 | 2D2D2D2D2D454E44 | 10 | 
PCAP | pcap | Other | D4C3B2A1 | 0 |  | 2048 | 
PCAPNG | pcapng | Other | 0A0D0D0A | 0 |  | 2048 | 
"""


def _parsed(line: str) -> Signature:
    name, ext, kind, header, offset, footer, most, parser = (x.strip() for x in line.split("|"))
    return Signature(name, ext, kind, bytes.fromhex(header), int(offset), bytes.fromhex(footer), int(most), parser)


SIGNATURES = [_parsed(line) for line in _TABLE.strip().splitlines()]


def png_size(data: bytes) -> int | None:
    """End of the IEND chunk, walking from chunk to chunk."""
    at = 8
    while at + 12 <= len(data) and at <= 100_000_000:
        length, kind = struct.unpack_from(">I4s", data, at)
        at += 12 + length
        if kind == b"IEND":
            return at
    return None


def zip_size(data: bytes) -> int | None:
    """End of the last end-of-central-directory record and its comment, looked for in the last 64 KiB."""
    at = data.rfind(b"PK\x05\x06", max(0, len(data) - 65_558), max(0, len(data) - 18))
    return at + 22 + struct.unpack_from("<H", data, at + 20)[0] if at >= 0 else None


def bmp_size(data: bytes) -> int | None:
    """The size field, if it is plausible."""
    size = struct.unpack_from("<I", data, 2)[0] if len(data) >= 6 else 0
    return size if 14 < size < 200_000_000 else None


def riff_size(data: bytes) -> int | None:
    """The size field and the eight bytes before what it counts."""
    size = struct.unpack_from("<I", data, 4)[0] + 8 if len(data) >= 8 else 0
    return size if 12 < size < 2_000_000_000 else None


def mp4_size(data: bytes) -> int | None:
    """End of the last box, walking from box to box; a box of size 0 runs to the end."""
    at = 0
    while at + 8 <= len(data):
        size = struct.unpack_from(">I", data, at)[0]
        if size == 0:
            return len(data)
        if size < 8:
            break
        at += size
        if at >= len(data):
            return at
    return at if at > 8 else None


def _unknown(data: bytes) -> int | None:
    return None


#: Size parsers by name; more can be registered. Some formats say nothing of their size.
PARSERS: dict[str, Callable[[bytes], int | None]] = {"png": png_size, "zip": zip_size, "bmp": bmp_size, "riff": riff_size, "mp4": mp4_size, "jpeg": _unknown, "gif": _unknown, "pdf": _unknown, "flac": _unknown}

# Kinds of RIFF files and brands of MP4 files.
RIFF_KINDS = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}
MP4_BRANDS = {b"M4A ": "m4a", b"M4B ": "m4a", b"qt  ": "mov", b"3gp4": "3gp", b"3gp5": "3gp", b"3gp6": "3gp"}


def resolved_extension(signature: Signature, head: bytes) -> str:
    """The extension, by the inner kind where the header is shared."""
    if len(head) >= 12 and signature.header == b"RIFF":
        return RIFF_KINDS.get(head[8:12], "riff")
    if len(head) >= 12 and signature.header == b"ftyp" and signature.offset == 4:
        return MP4_BRANDS.get(head[8:12], "mp4")
    return signature.extension


def find_footer(data: bytes, footer: bytes, least: int) -> int | None:
    """First place of ``footer`` that is ``least`` bytes in, or more."""
    at = data.find(footer, least) if footer else -1
    return at if at >= 0 else None


def little_endian(binary: Column, at: int, size: int = 4) -> Column:
    """An unsigned number from ``size`` bytes, in the JVM; NULL where there are fewer."""
    part = F.substring(binary, at + 1, size)
    return F.when(F.octet_length(part) == size, F.conv(F.hex(_reversed(part, size)), 16, 10).cast("long"))


def _reversed(part: Column, size: int) -> Column:
    return F.concat(*(F.substring(part, size - i, 1) for i in range(size)))


def sniffed(head: bytes) -> str | None:
    """The extension that the first bytes of a content speak for; None where no header fits."""
    for late in (False, True):
        for s in SIGNATURES:
            if (s.offset > 0) == late and len(s.header) > 1 and head[s.offset : s.offset + len(s.header)] == s.header:
                return resolved_extension(s, head)
    return None
