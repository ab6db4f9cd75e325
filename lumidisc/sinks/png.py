"""PNG, 8 bits a channel: grey, RGB or RGBA."""

from __future__ import annotations

import struct
import zlib

import numpy as np

_MAGIC = b"\x89PNG\r\n\x1a\n"
_KIND = {1: 0, 3: 2, 4: 6}


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def encode(image: np.ndarray) -> bytes:
    image = image[..., None] if image.ndim == 2 else image
    h, w, n = image.shape
    up = image.astype(np.uint8).reshape(h, w * n).copy()
    up[1:] -= image.reshape(h, w * n)[:-1]  # the "up" filter
    rows = np.concatenate((np.full((h, 1), 2, np.uint8), up), 1)
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, _KIND[n], 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """What encode made, and other files of its kinds without interlace."""
    if data[:8] != _MAGIC:
        raise ValueError("no PNG")
    at, packed = 8, b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    n = {v: k for k, v in _KIND.items()}.get(kind)
    if n is None or depth != 8 or interlace:
        raise ValueError("unsupported PNG")
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, w * n + 1)
    out = np.zeros((h, w, n), np.uint8)
    above = np.zeros((w, n), np.uint8)
    for y in range(h):
        filter_, line = rows[y, 0], rows[y, 1:].reshape(w, n).copy()
        if filter_ == 1:
            line = np.cumsum(line, 0, dtype=np.uint8)
        elif filter_ == 2:
            line += above
        elif filter_ in (3, 4):
            left, corner = np.zeros(n, int), np.zeros(n, int)
            for x in range(w):
                b = above[x].astype(int)
                if filter_ == 3:
                    guess = (left + b) // 2
                else:
                    p = left + b - corner
                    da, db, dc = abs(p - left), abs(p - b), abs(p - corner)
                    guess = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, b, corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x].astype(int), b
        above = out[y] = line
    return out
