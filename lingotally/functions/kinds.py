"""File kinds from names and leading bytes, and the size gate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lingotally.functions.binding import let

# ---- fixed values: extensions per kind -------------------------------------------------------
VIDEO_EXT = ["mp4", "mov", "avi", "mkv", "m4v", "wmv", "webm", "3gp"]
IMAGE_EXT = ["png", "jpg", "jpeg", "tiff", "tif", "bmp", "gif"]
SUBTITLE_EXT = ["srt", "vtt"]
VIEWER_AUDIO_EXT = ["mp3", "wav", "m4a", "aac", "ogg", "flac"]
VIEWER_VIDEO_EXT = [e for e in VIDEO_EXT if e != "wmv"]
VIEWER_IMAGE_EXT = [e for e in IMAGE_EXT if e != "tif"]

MAX_FILE_BYTES = 500 * 1024 * 1024
MAX_TEXT_BYTES = 10 * 1024 * 1024


def extension(path: Column) -> Column:
    """Lower-cased extension; a leading dot alone does not start one."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def kind_from_ext(path: Column) -> Column:
    return let(extension(path), lambda ext: (
        F.when(ext.isin(VIDEO_EXT), "video")
        .when(ext.isin(IMAGE_EXT), "image")
        .when(ext == "pdf", "pdf")
        .when(ext.isin(SUBTITLE_EXT), "subtitle")
        .otherwise("audio")
    ))


def _starts(head: Column, hex_text: str, at: int = 1) -> Column:
    n = len(hex_text) // 2
    return F.substring(head, at, n) == F.unhex(F.lit(hex_text))


def magic_name(head: Column) -> Column:
    """Container named by its leading bytes, else null."""
    lead = F.conv(F.hex(F.substring(head, 2, 1)), 16, 10).cast("int")
    mp3_sync = _starts(head, "FF") & (F.length(head) >= 2) & (lead >= 0xE0)
    return (
        F.when(_starts(head, "25504446"), "pdf")
        .when(_starts(head, "66747970", 5), "mp4")
        .when(_starts(head, "52494646") & _starts(head, "57415645", 9), "wav")
        .when(_starts(head, "494433") | mp3_sync, "mp3")
        .when(_starts(head, "FFD8FF"), "jpeg")
        .when(_starts(head, "89504E470D0A1A0A"), "png")
        .when(_starts(head, "504B0304"), "zip")
        .when(_starts(head, "1F8B"), "gzip")
    )


def kind_from_magic(head: Column) -> Column:
    return let(magic_name(head), lambda name: (
        F.when(name == "pdf", "pdf")
        .when(name == "mp4", "video")
        .when(name.isin("jpeg", "png"), "image")
        .when(name.isin("wav", "mp3"), "audio")
    ))


def kind_robust(path: Column, head: Column) -> Column:
    return F.coalesce(kind_from_magic(head), kind_from_ext(path))


def kind_viewer(path: Column) -> Column:
    return let(extension(path), lambda ext: (
        F.when(ext.isin(VIEWER_AUDIO_EXT), "audio")
        .when(ext.isin(VIEWER_VIDEO_EXT), "video")
        .when(ext.isin(SUBTITLE_EXT), "subtitle")
        .when(ext.isin(VIEWER_IMAGE_EXT), "image")
        .otherwise("document")
    ))


def size_gate(
    length: Column, text: Column | None = None,
    max_file: int = MAX_FILE_BYTES, max_text: int = MAX_TEXT_BYTES,
) -> Column:
    """Error class of a file outside the limits, else null."""
    gate = F.when(length == 0, "corrupt").when(length > max_file, "too_large")
    return gate if text is None else gate.when(F.octet_length(text) > max_text, "too_large")
