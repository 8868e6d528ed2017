"""PNG images as arrays and back, with the standard library: 8 bits a channel, not interlaced."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(image: np.ndarray) -> bytes:
    """A grey, RGB or RGBA array (height, width[, channels]) as a PNG file."""
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, channels = image.shape
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
    rows = np.concatenate([np.zeros((height, 1), np.uint8), image.astype(np.uint8).reshape(height, -1)], 1)

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """RGB array of a PNG file; other kinds of PNG and other files raise ValueError."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed, palette = 8, b"", None
    width = height = kind = 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            width, height, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", body)
            if bits != 8 or interlaced or kind not in (*CHANNELS, 3):
                raise ValueError("only 8 bits a channel without interlace")
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += 12 + n
    channels = CHANNELS.get(kind, 1)
    stride = width * channels
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride), np.uint8)
    for y in range(height):
        f, line, up = raw[y, 0], raw[y, 1:].astype(np.int32), out[y].astype(np.int32)
        if f == 2:
            line = line + up
        elif f in (1, 3, 4):
            for x in range(stride):
                left = line[x - channels] if x >= channels else 0
                corner = up[x - channels] if x >= channels else 0
                if f == 4:
                    guess = left + up[x] - corner
                    p = min((abs(guess - left), 0, left), (abs(guess - up[x]), 1, up[x]), (abs(guess - corner), 2, corner))[2]
                else:
                    p = left if f == 1 else (left + up[x]) // 2
                line[x] = (line[x] + p) & 255
        out[y + 1] = line & 255
    image = out[1:].reshape(height, width, channels)
    if kind == 3:
        return palette[image[:, :, 0]]
    return np.repeat(image[:, :, :1], 3, 2) if channels <= 2 else image[:, :, :3]


def visible_part(image: np.ndarray, left: float, top: float, right: float, bottom: float) -> np.ndarray:
    """What is left of an image with these shares of its sides cropped, at least one pixel."""
    height, width = image.shape[:2]
    x, y = max(0, min(width - 1, round(width * left))), max(0, min(height - 1, round(height * top)))
    return image[y : max(y + 1, min(height, round(height * (1 - bottom)))), x : max(x + 1, min(width, round(width * (1 - right))))]


def visual_hash(image: np.ndarray, side: int = 64) -> str:
    """A hash of the image at `side` by `side`: equal for equal pictures of any file form. Not comparable with hashes made by other resamplers."""
    height, width = image.shape[:2]
    y, x = (np.arange(side) * n // side for n in (height, width))
    return hashlib.sha256(np.ascontiguousarray(image[y][:, x]).tobytes()).hexdigest()
