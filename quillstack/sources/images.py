"""PNG files decoded in full: size, share of ink, and why a file is no whole picture."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: signature, samples by colour type, depths by colour type, passes (x, y, dx, dy).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = {0: [(0, 0, 1, 1)], 1: [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]}
#: Grey of 16.16 weights, and the least grey that is paper.
WEIGHTS, HALF, PAPER = (19595, 38470, 7471), 32768, 248
#: Pixels made grey at once.
BLOCK = 1 << 20


class BadPicture(ValueError):
    pass


def chunks(data: bytes):
    """(kind, body) of each chunk up to the end mark; every checksum must hold."""
    if not data.startswith(SIGNATURE):
        raise BadPicture("signature")
    at = len(SIGNATURE)
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            break
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise BadPicture("checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise BadPicture("cut short")


def unfiltered(raw: np.ndarray, rows: int, width: int, step: int) -> np.ndarray:
    """rows x width bytes of a pass after its filters (0 none, 1 left, 2 up, 3 mean, 4 nearest of three)."""
    lines = raw.reshape(rows, width + 1)
    out = np.zeros((rows + 1, width + step), np.uint8)  # a blank line above and a blank pixel to the left
    for y in range(rows):
        kind, line, above = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind > 4:
            raise BadPicture("filter")
        if kind in (0, 2):
            out[y + 1, step:] = line if kind == 0 else line + above[step:]
        elif kind == 1:
            for s in range(step):
                out[y + 1, step + s :: step] = np.cumsum(line[s::step], dtype=np.uint8)
        else:
            left, over, now = bytearray(width + step), above.tolist(), line.tolist()
            for x in range(width):
                a, b, c = left[x], over[x + step], over[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    far = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = (a, b, c)[far.index(min(far))]
                left[x + step] = (now[x] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(left), np.uint8)
    return out[1:, step:]


def grey(lines: np.ndarray, width: int, depth: int, colour: int, palette: np.ndarray | None) -> np.ndarray:
    """Grey of 0 to 255 of each pixel; the high byte of wide samples, and no regard to transparency."""
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, :width]
        values = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2)
        values = values if colour == 3 else values * 255 // ((1 << depth) - 1)
        values = values[:, :, None]
    else:
        values = lines.reshape(len(lines), width, -1)[:, :, :: depth // 8].astype(np.int64)
    if colour == 3:
        if palette is None or values.max(initial=0) >= len(palette):
            raise BadPicture("palette")
        values = palette[values[:, :, 0]]
    if values.shape[2] < 3:
        return values[:, :, 0]
    return (values[:, :, 0] * WEIGHTS[0] + values[:, :, 1] * WEIGHTS[1] + values[:, :, 2] * WEIGHTS[2] + HALF) >> 16


def facts(data: bytes, most_pixels: int) -> tuple[int | None, int | None, float | None, str | None]:
    """width, height, ink and None, or what is wrong with the file."""
    width = height = None
    try:
        head, packed, palette = None, [], None
        for kind, body in chunks(data):
            if head is None:
                if kind != b"IHDR" or len(body) != 13:
                    raise BadPicture("head")
                head = width, height, depth, colour, method, filters, lace = struct.unpack(">IIBBBBB", body)
                if not width or not height or depth not in DEPTHS.get(colour, ()) or method or filters or lace > 1:
                    raise BadPicture("head")
                if width * height > most_pixels:
                    raise BadPicture("too large")
            elif kind == b"PLTE":
                if not body or len(body) % 3:
                    raise BadPicture("palette")
                palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int64)
            elif kind == b"IDAT":
                packed.append(body)
        if head is None:
            raise BadPicture("head")
        bits = SAMPLES[colour] * depth
        sizes = [((width - x + dx - 1) // dx, (height - y + dy - 1) // dy) for x, y, dx, dy in PASSES[lace]]
        sizes = [(w, h, (w * bits + 7) // 8) for w, h in sizes if w > 0 and h > 0]
        need = sum(h * (n + 1) for _, h, n in sizes)
        raw = zlib.decompressobj().decompress(b"".join(packed), need)
        if len(raw) < need:
            raise BadPicture("cut short")
        ink, at = 0, 0
        for w, h, n in sizes:
            lines = unfiltered(np.frombuffer(raw, np.uint8, h * (n + 1), at), h, n, max(1, bits // 8))
            block = max(1, BLOCK // w)
            ink += sum(int((grey(lines[y : y + block], w, depth, colour, palette) < PAPER).sum()) for y in range(0, h, block))
            at += h * (n + 1)
        return width, height, ink / (width * height), None
    except zlib.error:
        return width, height, None, "packing"
    except BadPicture as e:
        return width, height, None, str(e)


def png_facts(files: DataFrame, most_pixels: int = 100_000_000) -> DataFrame:
    """files (content) with width, height, ink (share of pixels darker than paper) and error (null for a whole picture).

    Every pixel is decoded, one picture at a time, so a task's memory is bounded by the bytes of most_pixels
    pixels, twice; larger pictures are reported as such.
    """

    @F.pandas_udf("width long, height long, ink double, error string")
    def decode(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([facts(c or b"", most_pixels) for c in contents], columns=["width", "height", "ink", "error"])

    found = files.withColumn("_p", decode("content"))
    return found.select(*[F.col(c) for c in files.columns], "_p.*")


def invalid_pngs(files: DataFrame) -> DataFrame:
    """path, error: the files that can't be decoded whole."""
    return png_facts(files).where("error is not null").select("path", "error")
