"""Named configurations for the exports of common tools."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from profloom.errors import DatatypeException
from profloom.plans.joins import JoinSpec


@dataclass(frozen=True)
class Preset:
    """What a tool's exports look like and how their tables join."""

    metadata: tuple[str, ...] = ()
    compartments: tuple[str, ...] = ()
    identifying_columns: tuple[str, ...] = ()
    page_keys: dict[str, str] = field(default_factory=dict)
    joins: JoinSpec | str | None = None
    chunk_size: int = 1000

    def resolve(self, **given: Any) -> Preset:
        """With the settings of ``given`` that aren't None."""
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None})

    @property
    def targets(self) -> list[str]:
        return [*self.compartments, *self.metadata]


# Names of presets, and of tables and columns in the exports of each tool.
_OBJECTS = ("cells", "nuclei", "cytoplasm")
_IMAGE = ("image",)
_OBJECT_PAGES = {"image": "ImageNumber", "cells": "ObjectNumber", "nuclei": "ObjectNumber", "cytoplasm": "ObjectNumber", "join": "Cytoplasm_Number_Object_Number"}
_NUMBER_PAGES = {
    "image": "ImageNumber", "cells": "Cells_Number_Object_Number", "nuclei": "Nuclei_Number_Object_Number",
    "cytoplasm": "Cytoplasm_Number_Object_Number", "join": "Cytoplasm_Number_Object_Number",
}
_PLATE = ("ImageNumber", "ObjectNumber", "Metadata_Well", "Metadata_Plate", "Parent_Cells", "Parent_Nuclei")
_KEY = "Metadata_ImageNumber"
_TABLE_KEY = "Metadata_TableNumber"

PRESETS: dict[str, Preset] = {
    "cellprofiler_csv": Preset(
        _IMAGE, _OBJECTS, _PLATE, _OBJECT_PAGES,
        JoinSpec(
            keys=(_KEY,),
            match={
                "cells": ("Metadata_ObjectNumber", "Metadata_Cytoplasm_Parent_Cells"),
                "nuclei": ("Metadata_ObjectNumber", "Metadata_Cytoplasm_Parent_Nuclei"),
            },
            image_select=(_KEY,), without=(_KEY,),
        ),
    ),
    "cellprofiler_sqlite": Preset(
        _IMAGE, _OBJECTS, ("ImageNumber", "Metadata_Well", "Parent_Cells", "Parent_Nuclei"), _NUMBER_PAGES,
        JoinSpec(
            keys=(_KEY,),
            match={
                "cells": ("Cells_Number_Object_Number", "Cytoplasm_Parent_Cells"),
                "nuclei": ("Nuclei_Number_Object_Number", "Cytoplasm_Parent_Nuclei"),
            },
            image_select=(_KEY, "Image_Metadata_Well", "Image_Metadata_Plate"), without=(_KEY,),
        ),
    ),
    "cellprofiler_sqlite_cpg0016_jump": Preset(
        _IMAGE, _OBJECTS, _PLATE, _OBJECT_PAGES,
        JoinSpec(
            keys=(_KEY,),
            match={
                "cells": ("Metadata_ObjectNumber", "Metadata_Cytoplasm_Parent_Cells"),
                "nuclei": ("Metadata_ObjectNumber", "Metadata_Cytoplasm_Parent_Nuclei"),
            },
            image_select=(_KEY, "Image_TableNumber", "Metadata_Plate", "Metadata_Well", "Image_Metadata_Site", "Image_Metadata_Row"),
            without=(_KEY,), keep_unmatched=True,
        ),
    ),
    "cellprofiler_sqlite_pycytominer": Preset(
        _IMAGE, _OBJECTS,
        ("ImageNumber", "Metadata_Well", "Parent_Cells", "Parent_Nuclei", "Cytoplasm_Parent_Cells", "Cytoplasm_Parent_Nuclei", "Cells_Number_Object_Number", "Nuclei_Number_Object_Number"),
        _NUMBER_PAGES,
        JoinSpec(
            keys=(_KEY,),
            match={
                "cells": ("Metadata_Cells_Number_Object_Number", "Metadata_Cytoplasm_Parent_Cells"),
                "nuclei": ("Metadata_Nuclei_Number_Object_Number", "Metadata_Cytoplasm_Parent_Nuclei"),
            },
            image_select=(_KEY, "Image_Metadata_Well", "Image_Metadata_Plate"), without=(_KEY,),
        ),
    ),
    "cell-health-cellprofiler-to-cytominer-database": Preset(
        _IMAGE, _OBJECTS,
        ("TableNumber", "ImageNumber", "Metadata_Well", "Parent_Cells", "Parent_Nuclei", "Cytoplasm_Parent_Cells", "Cytoplasm_Parent_Nuclei", "Cells_ObjectNumber", "Nuclei_ObjectNumber"),
        _OBJECT_PAGES,
        JoinSpec(
            keys=(_TABLE_KEY, _KEY),
            match={
                "cells": ("Cells_ObjectNumber", "Metadata_Cytoplasm_Parent_Cells"),
                "nuclei": ("Nuclei_ObjectNumber", "Metadata_Cytoplasm_Parent_Nuclei"),
            },
            image_select=(_TABLE_KEY, _KEY, "Image_Metadata_Well", "Image_Metadata_Plate"), without=(_TABLE_KEY, _KEY),
        ),
    ),
    "in-carta": Preset(identifying_columns=("OBJECT ID", "Row", "Column", "FOV", "WELL LABEL", "Z", "T"), page_keys={"test": "OBJECT ID"}),
    "deepprofiler": Preset(page_keys={"join": "Metadata_Site"}),
}


def preset(name: str | None) -> Preset:
    """A preset by name; None is one without any setting."""
    if name is None:
        return Preset()
    if name not in PRESETS:
        raise DatatypeException(f"unknown preset {name!r}; there are {', '.join(PRESETS)}")
    return PRESETS[name]
