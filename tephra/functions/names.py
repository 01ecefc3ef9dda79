"""File names: parts, kinds, and the predicates that searches and duplicate detection use."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Extensions of each file type.
FILE_TYPES = {
    "Image": "jpg jpeg png gif webp bmp ico svg tiff tif raw cr2 nef arw dng heic heif",
    "Video": "mp4 avi mkv mov wmv flv webm m4v mpeg mpg 3gp vob",
    "Audio": "mp3 flac wav aac ogg m4a wma aiff opus alac",
    "Document": "pdf doc docx xls xlsx ppt pptx odt ods odp txt md rtf csv epub mobi",
    "Archive": "zip tar gz 7z rar bz2 xz lz lzma cab iso dmg",
    "Code": "rs py js ts jsx tsx c cpp h hpp java go rb php swift kt scala cs fs html css scss sass less json yaml yml toml xml sql sh bash ps1 bat cmd",
    "Executable": "exe dll so dylib app msi deb rpm apk",
    "Database": "db sqlite sqlite3 mdb accdb",
}
# Extensions of each media type of the chunkers.
MEDIA_TYPES = {
    "text": "txt text log csv",
    "markdown": "md markdown mdx rst",
    "code": "rs py js ts tsx jsx go java c cpp h hpp cs rb php swift kt scala r sql sh bash zsh ps1 psm1 lua zig nim v d ml hs elm ex exs clj cljs erl fs fsx toml yaml yml json xml html css scss sass less vue svelte",
    "image": "png jpg jpeg gif bmp webp svg ico tiff tif heic heif avif",
    "pdf": "pdf",
    "binary": "exe dll so dylib bin o a lib wasm zip tar gz bz2 xz 7z rar",
}
# Programming languages by extension.
LANGUAGES = {
    "rust": "rs",
    "python": "py",
    "javascript": "js jsx",
    "typescript": "ts tsx",
    "go": "go",
    "java": "java",
    "c": "c h",
    "cpp": "cpp hpp cc cxx",
    "csharp": "cs",
    "ruby": "rb",
    "php": "php",
    "swift": "swift",
    "kotlin": "kt",
    "scala": "scala",
    "r": "r",
    "sql": "sql",
    "shell": "sh bash zsh",
    "powershell": "ps1 psm1",
    "lua": "lua",
    "zig": "zig",
}
# Names by which a search may ask for a type.
TYPE_ALIASES = {
    "Image": "image images photo photos",
    "Video": "video videos",
    "Audio": "audio music sound",
    "Document": "document documents doc docs",
    "Archive": "archive archives compressed",
    "Code": "code source",
}
# Extensions of disk images.
DISK_IMAGES = "img iso dmg raw dd bin vhd vhdx vmdk"
# Extensions a preview can be made of.
PREVIEWABLE = "jpg jpeg png gif webp bmp ico tiff tif"
# What marks a name as a temporary or backup copy.
TEMP_ENDS = ["~", ".bak", ".tmp", ".swp", ".orig"]
TEMP_PARTS = ["_old", "_backup", "_copy", " - copy", "(1)", "(2)", "(3)"]
TEMP_STARTS = ["~$"]
# What is stripped from a name, in this order, before names are compared.
STRIPPED = ["_old", "_backup", "_bak", "_copy", " - Copy", " - copy", "_final", "_FINAL", "_draft", "-draft", "~"]
STRIPPED_PATTERNS = [r"\s*\(\d+\)", r"_v\d+", r"_rev\d+", r"_\d{4}-\d{2}-\d{2}", r"_\d{8}_\d{6}", r"_\d{8}", r"\s*-\s*\d+$", r"_copy\d*"]


def file_name(path: Column) -> Column:
    """What follows the last separator."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the file name; empty for none, and for names like ``.profile``."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The file name without its extension."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def looked_up(key: Column, groups: dict[str, str], default: str) -> Column:
    """The group whose list has ``key``."""
    found = None
    for name, members in groups.items():
        test = key.isin(members.split())
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise(default)


def sql_lookup(key: str, groups: dict[str, str], default: str) -> str:
    """The same lookup in SQL."""
    cases = " ".join(f"WHEN {key} IN ({', '.join(repr(m) for m in members.split())}) THEN '{name}'" for name, members in groups.items())
    return f"CASE {cases} ELSE '{default}' END"


def file_type(ext: Column) -> Column:
    """One of nine types by extension."""
    return looked_up(ext, FILE_TYPES, "Other")


def media_type(ext: Column) -> Column:
    """One of seven media types by extension."""
    return looked_up(ext, MEDIA_TYPES, "unknown")


def language(ext: Column) -> Column:
    """Programming language by extension."""
    return looked_up(ext, LANGUAGES, "unknown")


def is_temp_name(path: Column) -> Column:
    """Whether the name looks like a temporary or backup copy."""
    alternatives = [re.escape(s) + "$" for s in TEMP_ENDS] + [re.escape(s) for s in TEMP_PARTS] + ["^" + re.escape(s) for s in TEMP_STARTS]
    return F.lower(file_name(path)).rlike("|".join(alternatives))


def is_hidden(relative: Column) -> Column:
    """Whether any part of a relative path starts with a dot."""
    return relative.rlike(r"(^|[/\\])\.")


def depth(path: Column) -> Column:
    """Number of parts of a path."""
    return F.size(F.split(F.regexp_replace(path, r"^[/\\]+", ""), r"[/\\]+"))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def normalised_name(path: Column) -> Column:
    """The name that copies share: composed accents, marks of copies and dates stripped, lower case, with extension."""
    plain = stem(path)
    s = _nfc(plain)
    for mark in STRIPPED:
        s = F.replace(s, F.lit(mark), F.lit(""))
    for pattern in STRIPPED_PATTERNS:
        s = F.regexp_replace(s, pattern, "")
    s = F.lower(F.trim(s))
    return F.concat(F.when(s == "", F.lower(plain)).otherwise(s), F.lit("."), extension(path))


def glob_pattern(glob: str) -> str:
    """A glob (``* ? [..] [!..] {a,b}``) as an anchored regular expression."""
    out, i, depth_ = "", 0, 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
            i += glob[i : i + 2] == "**"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            i = end
        elif c == "{":
            out, depth_ = out + "(?:", depth_ + 1
        elif c == "}" and depth_:
            out, depth_ = out + ")", depth_ - 1
        elif c == "," and depth_:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def subsequence_pattern(text: str) -> str:
    """A regular expression of names that hold the characters of ``text`` in order."""
    return ".*".join(re.escape(c) for c in text.lower())
