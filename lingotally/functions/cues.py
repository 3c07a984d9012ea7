"""Subtitle cues: parsing whole bodies and rendering, row-local."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally.functions.binding import let
from lingotally.functions.text import WS_CLASS, strip


def format_ms(ms: Column, sep: str = ",") -> Column:
    """``HH:MM:SS,mmm`` (or another fraction separator); hours grow past two digits."""
    def part(c: Column, width: int) -> Column:
        digits = c.cast("bigint").cast("string")
        return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))

    return F.concat(
        part(F.floor(ms / 3_600_000), 2), F.lit(":"),
        part(F.floor(ms % 3_600_000 / 60_000), 2), F.lit(":"),
        part(F.floor(ms % 60_000 / 1000), 2), F.lit(sep),
        part(ms % 1000, 3),
    )


def short_ms(ms: Column) -> Column:
    """``M:SS`` with unwrapped minutes."""
    return F.concat(
        F.floor(ms / 60_000).cast("string"), F.lit(":"),
        F.lpad(F.floor(ms % 60_000 / 1000).cast("string"), 2, "0"),
    )


def mmss(ms: Column) -> Column:
    """``MM:SS`` with unwrapped minutes."""
    minutes = F.floor(ms / 60_000).cast("string")
    return F.concat(
        F.lpad(minutes, F.greatest(F.length(minutes), F.lit(2)), F.lit("0")), F.lit(":"),
        F.lpad(F.floor(ms % 60_000 / 1000).cast("string"), 2, "0"),
    )


def _stamp_ms(stamp: Column, sep: str) -> Column:
    pattern = rf"^\+?(\d+):\+?(\d+):\+?(\d+){sep}\+?(\d+)$"

    def field(i: int) -> Column:
        return F.regexp_extract(stamp, pattern, i).try_cast("bigint")

    def scaled(i: int, ms: int) -> Column:
        return F.try_multiply(field(i), F.lit(ms).cast("bigint"))

    # A time beyond the number range is a bad stamp of its cue, not the end of the job.
    return F.try_add(F.try_add(scaled(1, 3_600_000), scaled(2, 60_000)),
                     F.try_add(scaled(3, 1000), field(4)))


def cue_blocks(body: Column) -> Column:
    text = F.replace(F.regexp_replace(body, "^\\x{FEFF}", ""), F.lit("\r\n"), F.lit("\n"))
    blocks = F.transform(F.split(text, "\n\n+"), lambda b: F.btrim(b, F.lit("\n")))
    return F.filter(blocks, lambda b: b != "")


def _cue(index: Column, start: Column, end: Column, text: Column, error: Column | None) -> Column:
    """Cue of a block whose time line was found; times that do not parse are the error."""
    def build(t: Column) -> Column:
        bad = F.when(t["a"].isNull() | t["b"].isNull(), "bad time stamp")
        reason = bad if error is None else F.coalesce(error, bad)
        good = reason.isNull()
        return F.struct(
            F.when(good, index).cast("int").alias("cue_idx"),
            F.when(good, t["a"]).alias("start_ms"),
            F.when(good, t["b"]).alias("end_ms"),
            F.when(good, text).alias("text"),
            reason.alias("error"),
        )

    return let(F.struct(start.alias("a"), end.alias("b")), build)


def _rest(lines: Column, first: Column | int) -> Column:
    return F.array_join(F.slice(lines, first, F.greatest(F.size(lines), F.lit(1))), "\n")


def _srt_cue(lines: Column, position: Column) -> Column:
    bare = lines[0].contains("-->")
    clock = F.when(bare, lines[0]).otherwise(F.get(lines, F.lit(1)))
    number = F.when(~bare & strip(lines[0]).rlike(r"^\+?\d+$"), strip(lines[0]).try_cast("int"))
    start = _stamp_ms(strip(F.substring_index(clock, "-->", 1)), ",")
    end = _stamp_ms(strip(F.regexp_extract(clock, "(?s)-->(.*)$", 1)), ",")
    error = F.when(clock.isNull(), "block has no time line").when(
        ~clock.contains("-->"), "time line has no arrow"
    )
    text = F.when(bare, _rest(lines, 2)).otherwise(_rest(lines, 3))
    return _cue(F.when(number > 0, number).otherwise(position), start, end, text, error)


def _vtt_cue(raw: Column, position: Column) -> Column:
    skip = F.when(raw[0].contains("-->"), 0).otherwise(1)
    clock = F.get(raw, skip)
    start = _stamp_ms(strip(F.substring_index(clock, "-->", 1)), r"\.")
    after = strip(F.regexp_extract(clock, "(?s)-->(.*)$", 1))
    end = _stamp_ms(F.regexp_extract(after, rf"^[^{WS_CLASS}]+", 0), r"\.")
    error = F.when(~clock.contains("-->"), "time line has no arrow")
    return _cue(position, start, end, _rest(raw, skip + 2), error)


def parse_cues(body: Column, kind: Column) -> Column:
    """Array of cues of one subtitle body (``srt`` or ``vtt``).

    One malformed block rejects the whole body, which then yields a single row with ``error`` set.
    """
    blocks = cue_blocks(body)
    srt = F.transform(blocks, lambda b, i: let(F.split(b, "\n"), lambda ls: _srt_cue(ls, i + 1)))
    timed = F.filter(blocks, lambda b: b.contains("-->"))
    vtt = F.transform(timed, lambda b, i: let(F.split(b, "\n"), lambda ls: _vtt_cue(ls, i + 1)))
    unknown = F.array(
        _cue(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.lit(""),
             F.lit("not a subtitle kind"))
    )
    cues = F.when(kind == "srt", srt).when(kind == "vtt", vtt).otherwise(unknown)

    def whole_or_error(parsed: Column) -> Column:
        failed = F.filter(parsed, lambda c: c["error"].isNotNull())
        return F.when(F.size(failed) > 0, F.slice(failed, 1, 1)).otherwise(parsed)

    return let(cues, whole_or_error)


def srt_cue(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(
        number.cast("string"), F.lit("\n"), format_ms(start, ","), F.lit(" --> "),
        format_ms(end, ","), F.lit("\n"), text, F.lit("\n\n"),
    )


def vtt_cue(start: Column, end: Column, text: Column) -> Column:
    return F.concat(
        format_ms(start, "."), F.lit(" --> "), format_ms(end, "."), F.lit("\n"), text,
        F.lit("\n\n"),
    )


VTT_HEADER = "WEBVTT\n\n"
