"""Looping GIF."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable

import numpy as np

from lumidisc.raster import kernels as K
from lumidisc.sinks.sheets import flatten


def _lzw(indices: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    out, held, filled = bytearray(), 0, 0
    codes: dict[bytes, int] = {}
    width = bits + 1

    def put(code: int) -> None:
        nonlocal held, filled
        held |= code << filled
        filled += width
        while filled >= 8:
            out.append(held & 255)
            held >>= 8
            filled -= 8

    def start() -> None:
        nonlocal codes, width
        codes, width = {bytes((i,)): i for i in range(clear)}, bits + 1

    start()
    put(clear)
    run = b""
    following = end + 1
    for i in indices:
        longer = run + bytes((i,))
        if longer in codes:
            run = longer
            continue
        put(codes[run])
        if following < 4096:
            codes[longer] = following
            if following == 1 << width:
                width += 1
            following += 1
        else:
            put(clear)
            start()
            following = end + 1
        run = bytes((i,))
    if run:
        put(codes[run])
    put(end)
    if filled:
        out.append(held & 255)
    return bytes(out)


def encode(frames: list[np.ndarray] | Callable[[], Iterable[np.ndarray]], milliseconds: int = 80, background: tuple[int, int, int] = (0, 0, 0)) -> bytes:
    """Frames of equal size with one palette of 256 colours; nothing for no frames. They are gone through twice, one at a time."""
    source = frames if callable(frames) else lambda: frames
    flat = lambda: (flatten(f, background) if f.shape[2] == 4 else f for f in source())
    key = lambda f: f.reshape(-1, 3).astype(np.int32) @ np.array((65536, 256, 1), np.int32)
    counts, shape = np.zeros(1 << 24, np.int64), None
    for f in flat():
        shape = f.shape
        found, n = np.unique(key(f), return_counts=True)
        counts[found] += n
    if shape is None:
        return b""
    keys = np.flatnonzero(counts)
    colors = np.stack((keys >> 16, keys >> 8 & 255, keys & 255), 1).astype(np.uint8)
    palette = colors if len(colors) <= 256 else K.median_cut(colors, counts[keys], 256)
    back = np.concatenate([K.nearest_swatch(colors[i : i + 4096], palette) for i in range(0, len(colors), 4096)])
    table = np.zeros((256, 3), np.uint8)
    table[: len(palette)] = palette
    h, w = shape[:2]
    out = [b"GIF89a", struct.pack("<HHBBB", w, h, 0xF7, 0, 0), table.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    for f in flat():
        data = _lzw(back[np.searchsorted(keys, key(f))].astype(np.uint8).tobytes(), 8)
        blocks = b"".join(bytes((len(data[i : i + 255]),)) + data[i : i + 255] for i in range(0, len(data), 255))
        out += [b"\x21\xf9\x04\x04" + struct.pack("<H", milliseconds // 10) + b"\x00\x00", b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0), b"\x08", blocks, b"\x00"]
    return b"".join([*out, b"\x3b"])
