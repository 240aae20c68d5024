"""Compression, prediction and chunked stores of image files: what TIFF files and zarr folders hold their pixels in."""

from __future__ import annotations

import gzip
import json
import math
import zlib
from collections.abc import Callable, Iterator, Mapping
from itertools import product

import numpy as np

from profloom.errors import DatatypeException

# -- TIFF segments

CLEAR, END = 256, 257


def lzw(data: bytes) -> bytes:
    """The bytes that the LZW codes in ``data`` stand for; codes come from the high bit and grow one code early."""
    out = bytearray()
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    known, last, width, bits, n = list(single), b"", 9, 0, 0
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, bits = bits >> n, bits & (1 << n) - 1
        if code == END:
            break
        if code == CLEAR:
            known, last, width = list(single), b"", 9
            continue
        if code > len(known) or (code == len(known) and not last):
            raise DatatypeException("a TIFF file with broken LZW data")
        word = known[code] if code < len(known) else last + last[:1]
        out += word
        if last:
            known.append(last + word[:1])
            if len(known) >= (1 << width) - 1 and width < 12:
                width += 1
        last = word
    return bytes(out)


def packed_runs(data: bytes) -> bytes:
    """The bytes of runs: a length below 128 and as many bytes and one more, or one above and a byte to repeat."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:  # 128 stands for nothing
            i += 1
    return bytes(out)


# The codes of compressions in TIFF files.
TIFF_COMPRESSIONS: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: packed_runs}


def unpredicted(raw: bytes, shape: tuple[int, int, int], dtype: np.dtype, predictor: int) -> np.ndarray:
    """Pixels (rows, columns, samples) of a segment: as they are, from the differences within rows (2), or from those of the bytes of floats (3)."""
    rows, columns, samples = shape
    size = rows * columns * samples
    if len(raw) < size * dtype.itemsize:
        raise DatatypeException("a TIFF file with too few pixels")
    if predictor == 1:
        return np.frombuffer(raw, dtype, size).reshape(shape).astype(dtype.newbyteorder("="))
    if predictor == 2 and dtype.kind in "ui":
        steps = np.frombuffer(raw, dtype, size).reshape(shape).astype(dtype.newbyteorder("="))
        return np.cumsum(steps, axis=1, dtype=steps.dtype)
    if predictor == 3 and dtype.kind == "f":
        steps = np.frombuffer(raw, np.uint8, size * dtype.itemsize).reshape(rows, columns * dtype.itemsize, samples)
        planes = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, columns * samples)  # the highest bytes first
        whole = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(dtype.newbyteorder(">"))
        return whole.reshape(shape).astype(dtype.newbyteorder("="))
    raise DatatypeException(f"TIFF predictor {predictor} of {dtype} can't be read")


# -- zarr stores


def _zstd(data: bytes) -> bytes:
    try:
        import zstandard
    except ImportError as e:
        raise DatatypeException("zarr arrays in zstd need the package zstandard") from e
    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


# The names of compressions in zarr stores.
ZARR_COMPRESSIONS: dict[str, Callable[[bytes], bytes]] = {"zlib": zlib.decompress, "gzip": gzip.decompress, "zstd": _zstd}

Read = Callable[[str], bytes | None]


def _json(read: Read, name: str) -> dict | None:
    text = read(name)
    return None if text is None else json.loads(text)


def _layout(read: Read, folder: str) -> dict | None:
    """Shape, chunks, type, decompression and names of chunks of the array in ``folder``; None if there is none."""
    about = _json(read, f"{folder}.zarray")
    if about is not None:
        codec, separator = about.get("compressor"), about.get("dimension_separator", ".")
        if about.get("filters") or (codec and codec["id"] not in ZARR_COMPRESSIONS):
            raise DatatypeException(f"zarr arrays of compressor {codec} and filters {about.get('filters')} can't be read")
        return {
            "shape": about["shape"], "chunks": about["chunks"], "dtype": np.dtype(about["dtype"]), "fill": about.get("fill_value") or 0, "order": about.get("order", "C"),
            "steps": [codec["id"]] if codec else [], "name": lambda at: folder + separator.join(map(str, at)),
        }
    about = _json(read, f"{folder}zarr.json")
    if about is None or about.get("node_type") != "array":
        return None
    steps, order = [c["name"] for c in about["codecs"]], "<"
    for c in about["codecs"]:
        if c["name"] == "bytes" and c.get("configuration", {}).get("endian") == "big":
            order = ">"
    if bad := [s for s in steps if s != "bytes" and s not in ZARR_COMPRESSIONS]:
        raise DatatypeException(f"zarr arrays of codecs {bad} can't be read")
    keys = about.get("chunk_key_encoding", {"name": "default"})
    separator = keys.get("configuration", {}).get("separator", "/" if keys["name"] == "default" else ".")
    start = ["c"] if keys["name"] == "default" else []
    return {
        "shape": about["shape"], "chunks": about["chunk_grid"]["configuration"]["chunk_shape"], "dtype": np.dtype(about["data_type"]).newbyteorder(order), "fill": about.get("fill_value") or 0,
        "order": "C", "steps": [s for s in steps if s != "bytes"], "name": lambda at: folder + separator.join([*start, *map(str, at)]),
    }


def _chunks(read: Read, about: Mapping) -> Iterator[tuple[tuple[slice, ...], np.ndarray]]:
    counts = [math.ceil(n / c) for n, c in zip(about["shape"], about["chunks"])]
    for at in product(*map(range, counts)):
        raw = read(about["name"](at))
        if raw is None:
            continue
        for step in reversed(about["steps"]):
            raw = ZARR_COMPRESSIONS[step](raw)
        part = np.frombuffer(raw, about["dtype"]).reshape(about["chunks"], order=about["order"])
        place = tuple(slice(i * c, min((i + 1) * c, n)) for i, c, n in zip(at, about["chunks"], about["shape"]))
        yield place, part[tuple(slice(0, s.stop - s.start) for s in place)]


def read_zarr(read: Read) -> np.ndarray:
    """The array of a store, or of an image of several scales the first. ``read`` gives a file's bytes by its name in the store, None without it."""
    about = _layout(read, "")
    if about is None:
        attributes = _json(read, ".zattrs") or (_json(read, "zarr.json") or {}).get("attributes", {})
        scales = (attributes.get("ome") or attributes).get("multiscales")
        path = scales[0]["datasets"][0]["path"] if scales else "0"
        about = _layout(read, path.strip("/") + "/")
    if about is None:
        raise DatatypeException("a zarr store without an array")
    out = np.full(about["shape"], about["fill"], about["dtype"].newbyteorder("="))
    for place, part in _chunks(read, about):
        out[place] = part
    return out
