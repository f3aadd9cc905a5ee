"""Modality of a file from its name, from its first bytes, or as the user said."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import _col

# File extensions of each modality.
EXTENSIONS = {
    "image": [".jpg", ".jpeg", ".png", ".bmp"],
    "audio": [".wav", ".mp3", ".ogg"],
    "text": [".txt", ".md", ".json"],
    "video": [".mp4", ".avi", ".mkv", ".mov"],
    "csv": [".csv"],
    "pdf": [".pdf"],
}

# Leading dots of the file name belong to the name, not to an extension.
EXTENSION_PATTERN = r"[^/.][^/]*(\.[^./]*)$"


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(_col(path), EXTENSION_PATTERN, 1))


def modality_from_path(path: Column | str) -> Column:
    """Modality by file extension; NULL when the extension is unknown."""
    ext = extension(path)
    out = None
    for modality, known in EXTENSIONS.items():
        out = (
            F.when(ext.isin(known), F.lit(modality))
            if out is None
            else out.when(ext.isin(known), F.lit(modality))
        )
    return out


def modality_from_content(content: Column | str) -> Column:
    """Modality by published file signatures; NULL when none matches."""
    head = F.hex(F.substring(_col(content), 1, 12))

    def at(offset: int, signature: str) -> Column:
        return F.substring(head, 2 * offset + 1, len(signature)) == signature

    riff = at(0, "52494646")
    return (
        # PNG, JPEG, BMP
        F.when(at(0, "89504E470D0A1A0A") | at(0, "FFD8FF") | at(0, "424D"), "image")
        # RIFF with WAVE, ID3, OggS
        .when((riff & at(8, "57415645")) | at(0, "494433") | at(0, "4F676753"), "audio")
        # RIFF with AVI, ISO media "ftyp", Matroska
        .when((riff & at(8, "41564920")) | at(4, "66747970") | at(0, "1A45DFA3"), "video")
        # %PDF
        .when(at(0, "25504446"), "pdf")
    )


def detect_modality(method: Column, path: Column, content: Column, user: Column) -> Column:
    """Dispatch on the detection method; NULL for an unknown method."""
    return (
        F.when(method == "file_extension", modality_from_path(path))
        .when(method == "content_based", modality_from_content(content))
        .when(method == "user_input", user)
    )


def checkpoint_step(name: Column | str) -> Column:
    """Step number in a checkpoint name such as ``out/step_1000.pt``."""
    found = F.regexp_extract(_col(name), r"step_(\d+)[^/]*$", 1)
    return F.when(found != "", found.cast("bigint"))
