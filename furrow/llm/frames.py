"""Texts as seekable compressed frames.

A text is cut into pieces of a fixed number of bytes (at code points), each
an independent zstandard frame that carries the units, bytes and code points
up to its end. A place in the text is found in the cumulative counts, and only
the frame that holds it is decompressed; reading on means one frame after the
other. So nothing longer than a frame is ever held uncompressed.

A unit is a run of non-white-space characters with the white space before it,
or the white space at the end of the text: it ends where such a run ends.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard
from pyspark.sql import types as T

#: Bytes of text in a frame.
FRAME = 64 << 10
LEVEL = 3

SCHEMA = T.ArrayType(T.StructType([
    T.StructField("data", T.BinaryType()), T.StructField("units", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("chars", T.LongType())]))

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _run_ends(raw: bytes, then_space: bool) -> np.ndarray:
    """Byte places after each run that ends in ``raw``; ``then_space`` says
    whether white space or the end of the text follows."""
    space = np.empty(len(raw) + 1, bool)
    space[:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    space[-1] = then_space
    return np.flatnonzero(~space[:-1] & space[1:]) + 1


def _chars(raw: bytes) -> int:
    b = np.frombuffer(raw, np.uint8)
    return len(b) - int(np.count_nonzero((b & 0xC0) == 0x80))


class Frames:
    """Writes and reads frames; holds the compressor of a task."""

    def __init__(self, size: int = FRAME):
        self.size = size
        self.pack, self.unpack = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def write(self, parts: Iterable[bytes]) -> list[dict]:
        """The frames of the text that ``parts`` (whole code points each) make
        up. An empty text has none."""
        out, units, total, chars = [], 0, 0, 0
        for raw, following in self._cut(parts):
            ends = len(_run_ends(raw, following is None or bool(_SPACE[following])))
            # white space at the end of the text is a unit of its own
            units += ends + (following is None and bool(_SPACE[raw[-1]]))
            total, chars = total + len(raw), chars + _chars(raw)
            out.append({"data": self.pack.compress(raw), "units": units, "bytes": total, "chars": chars})
        return out

    def _cut(self, parts: Iterable[bytes]) -> Iterator[tuple[bytes, int | None]]:
        """Pieces of at most ``size`` bytes (a code point at least), each with
        the byte that follows it, None at the end."""
        held = b""
        for part in parts:
            at = 0
            while at < len(part):
                take = self.size + 4 - len(held)
                held, at = held + part[at:at + take], at + take
                while len(held) > self.size:
                    end = self.size
                    while end and (held[end] & 0xC0) == 0x80:
                        end -= 1
                    if not end:  # a code point longer than a piece
                        end = self.size
                        while end < len(held) and (held[end] & 0xC0) == 0x80:
                            end += 1
                        if end == len(held):
                            break
                    yield held[:end], held[end]
                    held = held[end:]
        if held:
            yield held, None

    def place(self, frames: list[dict], units: int) -> tuple[int, int]:
        """Bytes and code points before the end of the first ``units`` units."""
        if units <= 0:
            return 0, 0
        if units >= frames[-1]["units"]:
            return frames[-1]["bytes"], frames[-1]["chars"]
        at = bisect_left(frames, units, key=lambda f: f["units"])
        before = frames[at - 1] if at else {"units": 0, "bytes": 0, "chars": 0}
        raw = self.unpack.decompress(frames[at]["data"])
        end = int(_run_ends(raw, True)[units - before["units"] - 1])
        return before["bytes"] + end, before["chars"] + _chars(raw[:end])

    def read(self, frames: list[dict], start: int = 0, stop: int | None = None) -> Iterator[bytes]:
        """Bytes ``start`` to ``stop`` of the text, a frame at a time."""
        stop = frames[-1]["bytes"] if stop is None and frames else stop or 0
        at = bisect_left(frames, start + 1, key=lambda f: f["bytes"])
        while at < len(frames) and start < stop:
            first = frames[at - 1]["bytes"] if at else 0
            raw = self.unpack.decompress(frames[at]["data"])
            yield raw[max(0, start - first):stop - first]
            start, at = frames[at]["bytes"], at + 1

    def find(self, frames: list[dict], marks: tuple[bytes, ...]) -> dict[bytes, int]:
        """The first byte place of each mark that the text has."""
        found, held, gone = {}, b"", 0
        longest = max(map(len, marks))
        for raw in self.read(frames):
            held += raw
            for m in marks:
                if m not in found and (i := held.find(m)) >= 0:
                    found[m] = gone + i
            cut = max(0, len(held) - longest + 1)
            gone, held = gone + cut, held[cut:]
        return found
