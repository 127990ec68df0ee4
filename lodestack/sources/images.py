"""Image files to pixels: PNG files, inflated and unfiltered in vectorised code, and the grey values that models see."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.operators.imaging import HIGH, LEAST_SPAN, LOW

MARK = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples of a pixel by kind of colour; and of the seven passes of an interlaced image the first row and column and the steps.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PALETTE = 3
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(MARK)
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise ValueError("the image ends early")
        yield kind, body
        at += 12 + n


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of rows whose first byte names their filter; step: bytes of a pixel.

    A byte depends on those to its left, above, and left above. So all bytes on a diagonal (row plus pixel) are known once the two diagonals before it are, and
    each diagonal is one vectorised step over all rows, whatever their filters.
    """
    kinds, n, length = lines[:, 0], lines.shape[0], lines.shape[1] - 1
    if (kinds > 4).any():
        raise ValueError("a row has an unknown filter")
    pixels = -(-length // step)
    raw = np.zeros((n, pixels, step), np.int16)
    raw.reshape(n, -1)[:, :length] = lines[:, 1:]
    if (kinds == 0).all():
        return lines[:, 1:]
    out = np.zeros((n + 1, pixels + 1, step), np.int16)  # with a row and a pixel of zeros before
    for d in range(n + pixels - 1):
        y = np.arange(max(0, d - pixels + 1), min(n, d + 1))
        x, kind = d - y, kinds[y, None]
        left, above, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        guess = left + above - corner
        to_left, to_above, to_corner = np.abs(guess - left), np.abs(guess - above), np.abs(guess - corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        out[y + 1, x + 1] = raw[y, x] + np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, above, (left + above) // 2, nearest], 0) & 255
    return out[1:, 1:].reshape(n, -1)[:, :length].astype(np.uint8)


def _samples(data: bytes, height: int, width: int, samples: int, depth: int) -> tuple[np.ndarray, int]:
    """(height, width, samples) numbers of an image or pass at the beginning of data, and the bytes it takes."""
    length = -(-width * samples * depth // 8)
    if not (height and width):
        return np.zeros((height, width, samples), np.uint16), 0
    size = height * (length + 1)
    if len(data) < size:
        raise ValueError("the image ends early")
    own = unfiltered(np.frombuffer(data, np.uint8, size).reshape(height, length + 1), max(1, samples * depth // 8))
    if depth == 16:
        values = own.reshape(height, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    elif depth == 8:
        values = own.astype(np.uint16)
    else:
        bits = np.unpackbits(own, axis=1).reshape(height, -1, depth)
        values = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint16)
    return values[:, : width * samples].reshape(height, width, samples), size


def png_pixels(data: bytes) -> tuple[np.ndarray, int]:
    """(height, width, channels) of a PNG file, and its bits; of one with a palette, its colours. Any kind, depth and interlacing of the format."""
    if data[: len(MARK)] != MARK:
        raise ValueError("not a PNG file")
    packed, palette, about = [], None, None
    for kind, body in _chunks(data):
        if kind == b"IHDR":
            about = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            break
    if about is None or about[3] not in SAMPLES:
        raise ValueError("a PNG file without a header that is known")
    width, height, depth, colour, _, _, interlaced = about
    samples, lines = SAMPLES[colour], zlib.decompress(b"".join(packed))
    if interlaced:
        out = np.zeros((height, width, samples), np.uint16)
        for y, x, down, right in PASSES:
            part = out[y::down, x::right]
            values, n = _samples(lines, part.shape[0], part.shape[1], samples, depth)
            out[y::down, x::right] = values
            lines = lines[n:]
    else:
        out = _samples(lines, height, width, samples, depth)[0]
    if colour == PALETTE:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour that the palette lacks")
        return palette[out[..., 0]].astype(np.uint16), 8
    return out, depth


def shown(pixels: np.ndarray, bits: int = 8) -> np.ndarray:
    """(height, width, 3) bytes of an image as models see it.

    Colours of eight bits pass as they are, without opacity. Of others the first channel is scaled to 0..255 over its range from the 1st to the 99th percentile,
    numbers that are not finite becoming the median; a narrow range becomes the full one. An image without finite numbers is an error.
    """
    pixels = np.squeeze(pixels)
    if pixels.ndim == 3 and pixels.shape[-1] in (3, 4) and bits == 8:
        return pixels[..., :3].astype(np.uint8)
    grey = np.atleast_2d(pixels if pixels.ndim <= 2 else pixels[..., 0]).astype(np.float64)
    good = np.isfinite(grey)
    if not good.any():
        raise ValueError("no finite pixels")
    own = grey[good]
    low, high = np.quantile(own, (LOW, HIGH))
    if high - low < LEAST_SPAN:
        low, high = own.min(), own.max()
    grey = np.where(good, grey, np.median(own))
    scaled = (np.clip((grey - low) / max(high - low, LEAST_SPAN), 0, 1) * 255).astype(np.uint8)
    return np.repeat(scaled[..., None], 3, 2)


def decoded_images(files: DataFrame) -> DataFrame:
    """(path, height, width, channels, bits, values, error) of PNG files (path, content): samples row by row, pixel by pixel. A file that is none has an error, and ends no other."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                row, error = [None] * 5, None
                try:
                    pixels, bits = png_pixels(content.as_py())
                    row = [*pixels.shape, bits, pixels.ravel().astype(np.int32)]
                except Exception as e:  # one bad file must not end the others
                    error = f"{type(e).__name__}: {e}"
                columns = [pa.array([path]), *(pa.array([v], pa.int32()) for v in row[:4]), pa.array([row[4]], pa.list_(pa.int32())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "height", "width", "channels", "bits", "values", "error"])

    return files.select("path", "content").mapInArrow(of, "path string, height int, width int, channels int, bits int, values array<int>, error string")


def shown_images(images: DataFrame) -> DataFrame:
    """(path, height, width, values, error): three bytes a pixel, as shown() gives them, of decoded_images()."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, values in zip(batch.drop_columns(["values"]).to_pylist(), batch.column("values")):
                out, error = None, r["error"]
                if error is None:
                    try:
                        out = shown(values.values.to_numpy().reshape(r["height"], r["width"], r["channels"]), r["bits"]).ravel().astype(np.int32)
                    except ValueError as e:
                        error = f"ValueError: {e}"
                columns = [pa.array([r["path"]]), *(pa.array([r[c]], pa.int32()) for c in ("height", "width")), pa.array([out], pa.list_(pa.int32())), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["path", "height", "width", "values", "error"])

    return images.select("path", "height", "width", "channels", "bits", "values", "error").mapInArrow(of, "path string, height int, width int, values array<int>, error string")
