"""Splitting one text into overlapping chunks.

The text is never cut into piece strings.  A cut is an offset; a chunk is the
stripped text between two cuts.  A separator stays with the piece it opens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from lorespan.fixed_values import CHUNK_OVERLAP, CHUNK_SIZE, SEPARATORS


def _cuts(text: str, start: int, end: int, separator: str) -> list[int]:
    """Offsets in ``[start, end]`` where a piece begins or the span ends."""
    if not separator:
        return list(range(start, end + 1))
    cuts = [start]
    at = text.find(separator, start, end)
    while at >= 0:
        if at > cuts[-1]:
            cuts.append(at)
        at = text.find(separator, at + len(separator), end)
    cuts.append(end)
    return cuts


def _windows(text: str, cuts: list[int], marks: list[int], size: int,
             overlap: int) -> Iterator[str]:
    """Slide over neighbouring pieces: grow to ``size``, step back to ``overlap``.

    ``marks`` holds the running length at each cut.
    """
    first = 0
    for last in range(1, len(cuts)):
        if first < last - 1 and marks[last] - marks[first] > size:
            yield text[cuts[first]:cuts[last - 1]].strip()
            while first < last - 1 and (marks[last - 1] - marks[first] > overlap
                                        or marks[last] - marks[first] > size):
                first += 1
    if len(cuts) > 1:
        yield text[cuts[first]:cuts[-1]].strip()


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
               separators: Sequence[str] = SEPARATORS,
               length: Callable[[str], int] = len) -> list[str]:
    """Chunks of at most ``size``, neighbours sharing at most ``overlap``.

    The first separator present cuts the span; pieces shorter than ``size`` are
    packed, a longer one is cut again by the separators after it.
    """
    deepest = len(separators) - 1

    def split(start: int, end: int, level: int) -> Iterator[str]:
        while level < deepest and separators[level] and text.find(separators[level], start, end) < 0:
            level += 1
        last_resort = level == deepest or not separators[level]
        cuts, marks = [start], [0]
        for cut in _cuts(text, start, end, separators[level])[1:]:
            piece = cut - cuts[-1] if length is len else length(text[cuts[-1]:cut])
            if piece < size:
                cuts.append(cut)
                marks.append(marks[-1] + piece)
                continue
            yield from _windows(text, cuts, marks, size, overlap)
            if last_resort:
                yield text[cuts[-1]:cut]
            else:
                yield from split(cuts[-1], cut, level + 1)
            cuts, marks = [cut], [0]
        yield from _windows(text, cuts, marks, size, overlap)

    return [chunk for chunk in split(0, len(text), 0) if chunk]
