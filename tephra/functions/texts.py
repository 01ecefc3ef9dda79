"""Scalar functions on texts, sizes, durations and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Errors that no retry can mend.
FATAL_ERRORS = ["permission denied", "access denied", "file not found", "no such file", "directory not found", "invalid path"]
# Which repair an error asks for, first match first.
REPAIRS = [("gpu", ["gpu", "cuda", "out of memory"]), ("timeout", ["timeout", "timed out"]), ("network", ["connection", "network", "refused"]), ("io", ["i/o error", "io error"]), ("bad_sector", ["bad sector", "read error"])]


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at least two bytes."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) >= 2)


def snippet(text: Column, terms: list[str], width: int = 150) -> Column:
    """``width`` characters around the earliest match of a term, with dots where text is left out."""
    low = F.lower(text)
    places = [F.when(F.instr(low, t.lower()) > 0, F.instr(low, t.lower()) - 1) for t in terms] or [F.lit(0)]
    first = F.coalesce(F.least(*places) if len(places) > 1 else places[0], F.lit(0))
    start = F.greatest(first - width // 2, F.lit(0))
    body = F.substring(text, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + width < F.length(text), "...").otherwise(""))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """The terms that the text holds, whatever their case, joined by a comma."""
    low = F.lower(text)
    return F.concat_ws(",", *(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms))


def html_escaped(text: Column) -> Column:
    """Five characters as entities, the ampersand first."""
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def parsed_size(text: Column) -> Column:
    """Bytes of a whole number with B, KB, MB or GB (powers of 1024), else NULL."""
    up = F.upper(F.trim(text))
    unit = F.regexp_extract(up, r"^\d+\s*(B|KB|MB|GB)?$", 1)
    number = F.regexp_extract(up, r"^(\d+)\s*(?:B|KB|MB|GB)?$", 1).try_cast("long")
    factor = F.when(unit == "KB", 1 << 10).when(unit == "MB", 1 << 20).when(unit == "GB", 1 << 30).otherwise(1)
    return number * factor.cast("long")


def size_text(size: Column) -> Column:
    """A size in binary units with two decimals."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = out.when(size < 1024 ** (power + 1), F.format_string(f"%.2f {unit}", size / float(1024**power)))
    return out.otherwise(F.format_string("%.2f PiB", size / float(1024**5)))


def duration_text(seconds: Column) -> Column:
    """``250ms``, ``30.0s``, ``1m 30s`` or ``1h 1m 40s``."""
    whole = F.floor(seconds).cast("long")
    return (
        F.when(seconds < 1, F.format_string("%dms", F.floor(seconds * 1000).cast("long")))
        .when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(whole / 60).cast("long"), whole % 60))
        .otherwise(F.format_string("%dh %dm %ds", F.floor(whole / 3600).cast("long"), F.floor(whole % 3600 / 60).cast("long"), whole % 60))
    )


def age_text(seconds: Column) -> Column:
    """How long ago: just now, minutes, hours or days."""
    n = lambda d: F.floor(seconds / d).cast("long")
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.format_string("%d min ago", n(60)))
        .when(seconds < 86400, F.format_string("%d hours ago", n(3600)))
        .otherwise(F.format_string("%d days ago", n(86400)))
    )


def heading_level(line: Column) -> Column:
    """1 to 6 for a Markdown heading, else NULL."""
    marks = F.regexp_extract(line, r"^\s*(#{1,6}) ", 1)
    return F.when(marks != "", F.length(marks))


def is_fence(line: Column) -> Column:
    """Whether a line opens or closes a fenced block."""
    return F.trim(line).rlike("^(```|~~~)")


def is_recoverable(error: Column) -> Column:
    """Whether a retry may mend an error."""
    return ~F.lower(error).rlike("|".join(FATAL_ERRORS))


def repair_for(error: Column) -> Column:
    """The repair an error asks for; generic where nothing is known."""
    low, found = F.lower(error), None
    for name, parts in REPAIRS:
        test = low.rlike("|".join(parts))
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise("generic")


def retry_delay_ms(attempt: Column, first: int = 100, factor: int = 2, cap: int = 5000) -> Column:
    """Exponential delay before attempt 0, 1, ..."""
    return F.least(F.lit(first) * F.pow(F.lit(float(factor)), attempt), F.lit(float(cap))).cast("long")


def day_start(text: Column) -> Column:
    """Start of a ``YYYY-MM-DD`` day in UTC, else NULL."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))


def day_end(text: Column) -> Column:
    """Last second of a ``YYYY-MM-DD`` day."""
    return day_start(text) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def recency_factor(hours: Column) -> Column:
    """1 + 0.1 / (1 + age in days), from whole hours."""
    return F.lit(1.0) + F.lit(0.1) / (F.lit(1.0) + F.floor(hours) / F.lit(24.0))


def percent(done: Column, total: Column) -> Column:
    """Share done; nothing to do is 100."""
    return F.when(total == 0, F.lit(100.0)).otherwise(done * 100.0 / total)


def content_with_prefix(source: Column, kind: Column, index: Column, total: Column, start: Column, end: Column, metadata: Column, content: Column) -> Column:
    """A chunk with a line that says where it comes from; metadata by sorted key."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(F.lit(" | "), e["key"], F.lit(": "), e["value"])), "")
    return F.concat(F.format_string("File: %s | Type: %s | Chunk: %d/%d | Bytes: %d-%d", source, kind, index + 1, total, start, end), F.coalesce(pairs, F.lit("")), F.lit("\n---\n"), content)


def utc_text(at: Column) -> Column:
    """``2031-01-02 03:04:05 UTC``, whatever the session's zone."""
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def case_number(at: Column) -> Column:
    """``DD-20310102-0304``: a case number from a time in UTC."""
    return F.concat(F.lit("DD-"), F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyyMMdd-HHmm"))


def block_count(size: Column, block: int = 4096) -> Column:
    """Blocks that a file takes up, the last one in part."""
    return F.floor((size + (block - 1)) / F.lit(block)).cast("long")


def throughput(size: Column, milliseconds: Column) -> Column:
    """Whole bytes a second; 0 where no time has passed."""
    return F.when(milliseconds > 0, F.floor(size.cast("decimal(20,0)") * 1000 / milliseconds.cast("decimal(20,0)"))).otherwise(0).cast("long")


def remaining_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time that the rest takes at the rate so far; NULL as long as nothing is done."""
    return F.when(done > 0, F.greatest(total - done, F.lit(0)) * elapsed / done)


def size_similarity(size: Column, reference: Column) -> Column:
    """100 for equal sizes, less by each whole percent the size is away from the reference; 0 at twice the reference."""
    share = F.least(F.floor(size * 100 / reference), F.lit(255))
    return F.when(reference <= 0, 0).when(share <= 100, share).otherwise(F.greatest(F.lit(0), 200 - share)).cast("int")
