"""Image files: a small TIFF decoder and encoder, file lookup, segmentation matching.

Images are structs of our own: shape, element type, and the pixels as bytes in row order.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from profloom.errors import DatatypeException, ProfileException
from profloom.functions.ids import IMAGE_SUFFIXES
from profloom.sources import storage
from profloom.sources.discovery import expand_path, walk_files
from profloom.sources.rasters import TIFF_COMPRESSIONS, read_zarr, unpredicted

IMAGE_TYPE = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("dtype", T.StringType()), T.StructField("pixels", T.BinaryType())])
ARROW_IMAGE = pa.struct([("shape", pa.list_(pa.int32())), ("dtype", pa.string()), ("pixels", pa.binary())])

# Tags, and sizes and codes of the element types, of the TIFF format.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PREDICTOR, TILE, FORMAT = 254, 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339
PLANAR, TILE_HEIGHT, TILES, TILE_COUNTS = 284, 323, 324, 325
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _directories(data: bytes, order: str) -> Iterator[dict[int, tuple]]:
    """The tags of every image of a TIFF, along the chain of its directories."""
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(data):
            raise DatatypeException("a TIFF file whose directories are cut short or run in a circle")
        seen.add(at)
        n_tags = struct.unpack(order + "H", data[at : at + 2])[0]
        end = at + 2 + 12 * n_tags
        if end + 4 > len(data):
            raise DatatypeException("a TIFF file whose directories are cut short or run in a circle")
        tags: dict[int, tuple] = {}
        for i in range(n_tags):
            tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            if kind not in CODES:
                continue
            size = SIZES[kind] * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = struct.unpack(f"{order}{n}{CODES[kind]}", data[place : place + size])
        yield tags
        at = struct.unpack(order + "I", data[end : end + 4])[0]


def _plane(data: bytes, order: str, tags: Mapping[int, tuple]) -> np.ndarray:
    """The pixels of one directory, put together from its strips or tiles."""
    compression, predictor = tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    if compression not in TIFF_COMPRESSIONS:
        raise DatatypeException(f"TIFF compression {compression} can't be read")
    height, width, samples = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    dtype = np.dtype(f"{order}{kind}{tags.get(BITS, (8,))[0] // 8}")
    apart = samples if tags.get(PLANAR, (1,))[0] == 2 else 1  # samples in planes of their own
    tiled = TILE in tags
    rows, columns = (tags[TILE_HEIGHT][0], tags[TILE][0]) if tiled else (min(height, tags.get(ROWS, (height,))[0]), width)
    offsets, counts = (tags[TILES], tags[TILE_COUNTS]) if tiled else (tags[STRIPS], tags[COUNTS])
    places = [(s, y, x) for s in range(apart) for y in range(0, height, rows) for x in range(0, width, columns)]
    out = np.zeros((height, width, samples), dtype.newbyteorder("="))
    for (s, y, x), at, n in zip(places, offsets, counts):
        shape = (rows if tiled else min(rows, height - y), columns, samples // apart)
        part = unpredicted(TIFF_COMPRESSIONS[compression](data[at : at + n]), shape, dtype, predictor)
        channels = slice(s, s + 1) if apart > 1 else slice(None)
        out[y : y + rows, x : x + columns, channels] = part[: height - y, : width - x]
    return out if samples > 1 else out[:, :, 0]


def decode_tiff(data: bytes) -> np.ndarray:
    """All images of a TIFF in strips or tiles, 8 to 64 bits a sample, uncompressed or by deflate, LZW or PackBits, with any predictor.

    One image is (height, width) or (height, width, samples), several are (planes, height, width, samples) in the
    order of the file. Directories marked as smaller copies of another are no planes.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise DatatypeException("not a TIFF file")
    found = list(_directories(data, order))
    if not found:
        raise DatatypeException("a TIFF file without an image")
    planes = [_plane(data, order, tags) for tags in [t for t in found if not t.get(SUBFILE, (0,))[0] & 1] or found[:1]]
    if len({(p.shape, p.dtype) for p in planes}) > 1:
        raise DatatypeException("TIFF files with images of different shapes or types can't be read")
    return planes[0] if len(planes) == 1 else np.stack([p if p.ndim == 3 else p[:, :, None] for p in planes])


def encode_tiff(image: np.ndarray, deflate: bool = False) -> bytes:
    """A little-endian TIFF with one strip."""
    height, width = image.shape[:2]
    samples = image.shape[2] if image.ndim == 3 else 1
    raw = np.ascontiguousarray(image.astype(image.dtype.newbyteorder("<"))).tobytes()
    raw = zlib.compress(raw) if deflate else raw
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    entries = [(WIDTH, 4, width), (HEIGHT, 4, height), (BITS, 3, image.dtype.itemsize * 8), (COMPRESSION, 3, 8 if deflate else 1), (STRIPS, 4, 8), (SAMPLES, 3, samples), (ROWS, 4, height), (COUNTS, 4, len(raw)), (FORMAT, 3, kind)]
    table = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", t, k, 1) + struct.pack("<I" if k == 4 else "<HH", v, *([] if k == 4 else [0])) for t, k, v in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + table


def load_image(path: str, at: storage.Locate = storage.locate) -> np.ndarray:
    """A TIFF file, or the array of a zarr folder, whose leading axes are planes."""
    if not path.lower().endswith(".zarr"):
        return decode_tiff(storage.read_bytes(path, at))

    def read(name: str) -> bytes | None:
        system, place = at(f"{path}/{name}")
        return storage.read_bytes(f"{path}/{name}", at) if system.get_file_info(place).type == fs.FileType.File else None

    image = read_zarr(read)
    planes = image.reshape(-1, *image.shape[-2:])
    return planes[0] if len(planes) == 1 else planes[..., None]


def image_struct(image: np.ndarray | None) -> dict | None:
    return None if image is None else {"shape": list(image.shape), "dtype": str(image.dtype), "pixels": np.ascontiguousarray(image).tobytes()}


def image_array(value: Mapping) -> np.ndarray:
    return np.frombuffer(value["pixels"], np.dtype(value["dtype"])).reshape(value["shape"])


def crop(image: np.ndarray, x_min: int, x_max: int, y_min: int, y_max: int) -> np.ndarray:
    """The part within the bounds, of every plane; bounds below 0 are 0, bounds beyond the image end with it."""
    rows, columns = slice(max(0, y_min), max(0, y_max)), slice(max(0, x_min), max(0, x_max))
    return image[rows, columns] if image.ndim == 2 else image[..., rows, columns, :]


def list_images(root: str) -> list[str]:
    """Paths of the images below ``root``, relative to it; zarr folders count as one image each."""
    root, out = expand_path(root), []
    if "://" in root:
        names = [os.path.relpath(p, root) for p in walk_files(root)]
        stores = {n[: m.end() - 1] for n in names if (m := re.match(r"(?i).*?\.zarr/", n))}
        return sorted([*stores, *(n for n in names if n.lower().endswith(IMAGE_SUFFIXES) and not re.search(r"(?i)\.zarr/", n))])
    for folder, below, names in os.walk(root, followlinks=True):
        stores = [d for d in below if d.lower().endswith(".zarr")]
        below[:] = sorted(set(below) - set(stores))
        out += [os.path.relpath(os.path.join(folder, n), root) for n in (*names, *stores) if n.lower().endswith(IMAGE_SUFFIXES)]
    return sorted(out)


def file_stem(name: str) -> str:
    base = name.rpartition("/")[2]
    low = base.lower()
    suffix = max((s for s in IMAGE_SUFFIXES if low.endswith(s)), key=len, default=os.path.splitext(base)[1])
    return base[: len(base) - len(suffix)] if suffix else base


def index_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(kind, name, path, n): how a file may be referred to: by relative path, name or stem; n files share that."""
    rows = [(k, n, p) for p in paths for k, n in (("path", p), ("name", p.rpartition("/")[2]), ("stem", file_stem(p)))]
    return index_frame(spark.createDataFrame(rows, "kind string, name string, path string"))


def index_frame(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "name").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n"))


def resolve_files(values: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Distinct values with the file that each refers to: (column, path, n), n > 1 where it is ambiguous.

    The whole path counts first, then ever shorter ends of it, then the name, then the stem.
    """
    parts = F.split(F.col(column), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("rank"), F.lit("path").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("name")))
    name = F.element_at(parts, -1)
    suffixes = "|".join(re.escape(s) for s in sorted(IMAGE_SUFFIXES, key=len, reverse=True))
    stem = F.when(F.lower(name).rlike(f"({suffixes})$"), F.regexp_replace(name, f"(?i)({suffixes})$", "")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))
    more = F.array(F.struct((F.size(parts) + 1).alias("rank"), F.lit("name").alias("kind"), name.alias("name")), F.struct((F.size(parts) + 2).alias("rank"), F.lit("stem").alias("kind"), stem.alias("name")))
    tries = values.select(column).where(F.col(column).isNotNull()).distinct().withColumn("try", F.explode(F.concat(ends, more))).select(column, "try.rank", "try.kind", "try.name")
    hits = tries.join(index, ["kind", "name"])
    best = F.min_by(F.struct("path", "n"), "rank")
    return hits.groupBy(column).agg(best.alias("best")).select(column, "best.path", "best.n")


def resolve_or_fail(values: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """(column, path); ambiguous references raise when they are read."""
    found = resolve_files(values, column, index)
    problem = F.raise_error(F.concat(F.lit("several images are named like "), F.col(column)))
    return found.select(column, F.when(F.col("n") > 1, problem).otherwise(F.col("path")).alias("path"))


def _first_containing(parts: Sequence[str], stems: Sequence[str]) -> dict[str, int]:
    """Of each part the place of the first stem that contains it: one walk over the stems for all parts."""
    found: dict[str, int] = {}
    if not parts:
        return found
    try:
        import ahocorasick
    except ImportError:
        for p in parts:
            at = next((i for i, s in enumerate(stems) if p in s), None)
            if at is not None:
                found[p] = at
        return found
    automaton = ahocorasick.Automaton()
    for p in parts:
        automaton.add_word(p, p)
    automaton.make_automaton()
    for i, s in enumerate(stems):
        for _, p in automaton.iter(s):
            found.setdefault(p, i)
    return found


def match_segmentations(values: Sequence[str], candidates: Sequence[str], names: Sequence[str], patterns: Mapping[str, str]) -> list[str | None]:
    """The mask or outline file that belongs to each image.

    Of each pair (pattern of segmentation files, pattern of images) whose image pattern is found in
    a value, the first file by name fits that matches the file pattern and contains, without regard to case, one of
    the image's identifiers: the pattern's groups, the value's stem, the candidate's stem. All values of a call are
    looked up in one walk over the files.
    """
    out: list[str | None] = [None] * len(values)
    for of_file, of_image in patterns.items():
        files = sorted((n for n in names if re.search(of_file, n.rpartition("/")[2])), key=lambda n: n.rpartition("/")[2])
        wanted: dict[int, set[str]] = {}
        for i, (v, c) in enumerate(zip(values, candidates)):
            hit = re.search(of_image, v) if out[i] is None else None
            if hit is not None:
                groups = {g.strip().lower() for g in hit.groups() if g and g.strip()}
                wanted[i] = {x for x in groups | {file_stem(v).lower(), file_stem(c).lower()} if x}
        first = _first_containing(sorted(set().union(*wanted.values())) if wanted else [], [file_stem(n).lower() for n in files])
        for i, parts in wanted.items():
            places = [first[p] for p in parts if p in first]
            if places:
                out[i] = files[min(places)]
    return out


def match_segmentation(value: str, candidate: str, names: Sequence[str], patterns: Mapping[str, str]) -> str | None:
    return match_segmentations([value], [candidate], names, patterns)[0]


def segmentation_paths(images: DataFrame, value: str, candidate: str, names: Sequence[str], patterns: Mapping[str, str] | None, index: DataFrame) -> DataFrame:
    """(value, path) of the distinct image values: by patterns if given, else like image files."""
    if patterns is None:
        return resolve_files(images, value, index).where("n = 1").select(value, "path")
    shared = list(names)  # the listing of one folder

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            found = match_segmentations(f[value].tolist(), [c or v for v, c in zip(f[value], f[candidate])], shared, patterns)
            yield f.assign(path=pd.Series(found, index=f.index, dtype=object))[[value, "path"]]

    pairs = images.select(value, candidate).where(F.col(value).isNotNull()).distinct()
    return pairs.mapInPandas(run, T.StructType([pairs.schema[value], T.StructField("path", T.StringType())])).where("path IS NOT NULL")


def require_folder(path: str | None, what: str) -> None:
    if path is not None and not storage.is_folder(expand_path(path)):
        raise ProfileException(f"{what} {path} isn't a folder")


def all_of(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
