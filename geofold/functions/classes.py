"""Class schemas and the mappings between them, as column expressions. NULL is nodata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven classes, their colours, and the mappings from other schemas.
CLASSES = {"water": 0, "trees": 1, "shrub": 2, "grass": 3, "crops": 4, "built": 5, "bare": 6}
COLORS = {0: "#0077BE", 1: "#228B22", 2: "#90EE90", 3: "#ADFF2F", 4: "#FFD700", 5: "#DC143C", 6: "#D2B48C"}
LEGACY = {0: 6, 1: 1, 2: 2, 3: 3, 4: 6, 5: 0, 6: 6, 7: 5}
DYNAMIC_WORLD = {0: 0, 1: 1, 2: 3, 3: 4, 4: 4, 5: 2, 6: 5, 7: 6, 8: 0}
WORLDCOVER = {10: 1, 20: 2, 30: 3, 40: 4, 50: 5, 60: 6, 70: 0, 80: 0, 90: 3, 95: 1, 100: 3}
ALIASES = {
    "water": ["Water", "WATER", "water_body"],
    "trees": ["Forest", "FOREST", "tree", "Trees", "TREES", "tree_cover"],
    "shrub": ["Shrub", "SHRUB", "Shrubland", "shrubs", "shrub_and_scrub"],
    "grass": ["Grass", "GRASS", "Grassland", "herbaceous", "Herbaceous"],
    "crops": ["Crops", "CROPS", "Agriculture", "cropland", "Cropland"],
    "built": ["Built", "BUILT", "Urban", "built_up", "developed", "Developed"],
    "bare": ["Bare", "BARE", "Bareland", "bare_ground", "barren", "Barren"],
}
NODATA = 255
N_CLASSES = len(CLASSES)
NAMES = {v: k for k, v in CLASSES.items()}


def lookup(mapping: dict, key: Column | str) -> Column:
    """The value of a key in a small literal map; NULL for keys that it lacks."""
    key = F.col(key) if isinstance(key, str) else key
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.try_element_at(table, key)


def class_name(cls: Column | str, schema: dict[str, int] | None = None) -> Column:
    """Name of a class index, in another schema where one is given; ``class_k`` beyond the schema, NULL for nodata."""
    cls = F.col(cls) if isinstance(cls, str) else cls
    names = {v: k for k, v in schema.items()} if schema else NAMES
    return F.coalesce(lookup(names, cls.cast("int")), F.concat(F.lit("class_"), cls.cast("string")))


def class_index(name: Column | str) -> Column:
    """Index of a class name, whatever its case and outer spaces; NULL if unknown."""
    name = F.col(name) if isinstance(name, str) else name
    return lookup(CLASSES, F.lower(F.trim(name)))


def reference_class(label_str: Column | str, label_int: Column | str) -> Column:
    """A reference label held as an index or a name; indices are kept as they are."""
    as_int = F.col(label_int) if isinstance(label_int, str) else label_int
    return F.coalesce(as_int.cast("int"), class_index(label_str))


def alias_class(value: Column | str, custom: dict[str, str] | None = None) -> Column:
    """Class name of a label as users write it: alias, alias of its lower case, or a class name in any case."""
    value = F.trim(F.col(value) if isinstance(value, str) else value)
    table = {a: name for name, many in ALIASES.items() for a in many} | (custom or {})
    found = F.coalesce(lookup(table, value), lookup(table, F.lower(value)), F.lower(value))
    return F.when(found.isin(*CLASSES), found)


def from_nodata(cls: Column | str, nodata: int = NODATA) -> Column:
    """File value to engine value: nodata becomes NULL."""
    cls = F.col(cls) if isinstance(cls, str) else cls
    return F.when(cls != nodata, cls)
