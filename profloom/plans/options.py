"""Checks of option combinations."""

from __future__ import annotations

from profloom.errors import DatatypeException, ProfileException

# Names of formats.
BACKENDS = ("parquet", "iceberg")
DATATYPES = ("parquet", "anndata_h5ad", "anndata_zarr")


def check_options(
    backend: str, datatype: str, *, concat: bool, join: bool, drop_null: bool,
    image_dir: str | None = None, mask_dir: str | None = None, outline_dir: str | None = None,
    include_source_images: bool = False, segmentation_file_regex: object = None,
) -> None:
    """Raise for combinations that make no sense, the most basic first."""
    if backend not in BACKENDS:
        raise DatatypeException(f"unknown backend {backend!r}; there are {', '.join(BACKENDS)}")
    if datatype not in DATATYPES:
        raise DatatypeException(f"unknown datatype {datatype!r}; there are {', '.join(DATATYPES)}")
    image_options = any((mask_dir, outline_dir, include_source_images, segmentation_file_regex))
    if image_options and image_dir is None:
        raise ProfileException("image options need image_dir")
    if (image_options or image_dir) and backend != "iceberg":
        raise ProfileException("images are exported to a warehouse only")
    if (image_options or image_dir) and not join:
        raise ProfileException("images are exported from joined profiles only")
    if backend == "iceberg":
        for bad, text in ((datatype != "parquet", "holds Parquet only"), (not concat, "needs concat"), (not join, "needs join"), (drop_null, "can't drop nulls")):
            if bad:
                raise ProfileException(f"the warehouse backend {text}")
    if datatype != "parquet" and not (concat and join):
        raise ProfileException("AnnData needs joined and concatenated profiles")
