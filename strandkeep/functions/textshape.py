"""Lines of a text, and the newline style a merge must give back."""

from __future__ import annotations

from typing import NamedTuple


class Shape(NamedTuple):
    newline: str
    final: bool


def shape_of(ours: bytes, theirs: bytes) -> Shape:
    """Newline style and final newline of ours, or of theirs if ours is empty."""
    text = (ours or theirs).decode("utf-8", "replace")
    return Shape("\r\n" if "\r\n" in text else "\n", text.endswith("\n"))


def lines_of(data: bytes) -> list[str]:
    """The lines without their ends; one final newline adds no line, and empty data has none."""
    if not data:
        return []
    text = data.decode("utf-8", "replace").removesuffix("\n").removesuffix("\r")
    return [line.rstrip("\r") for line in text.split("\n")]


def join_lines(lines: list[str], shape: Shape) -> bytes:
    return (shape.newline.join(lines) + shape.newline * shape.final).encode() if lines else b""


def ordinal(text: str) -> bytes:
    """A key that orders strings by UTF-16 code units."""
    return text.encode("utf-16-be", "surrogatepass")
