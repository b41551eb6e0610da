"""String functions for catalog names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common names and the catalog names that they stand for. Keys are compared without spaces, "_" and "-".
ALIASES = {
    "cifar10": "CIFAR_10",
    "cifar100": "CIFAR_100",
    "mnist": "mnist_784",
    "mnist784": "mnist_784",
    "fashionmnist": "Fashion-MNIST",
    "fmnist": "Fashion-MNIST",
    "modamnist": "Fashion-MNIST",
    "usps": "USPS",
    "stl10": "STL_10",
    "coil100": "coil2000",
}


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def normalize_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_\-]+", "")


def resolve_alias(text: Column) -> Column:
    """The catalog name that a name stands for, or the name itself."""
    pairs = [F.lit(x) for pair in ALIASES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), normalize_key(text)), text)


def candidate_names(text: Column) -> Column:
    """Spellings to look up, in order, without repeats."""
    text = F.trim(text)
    alias = resolve_alias(text)
    return F.array_distinct(F.array(alias, text, F.translate(text, "-", "_"), F.translate(text, "_", "-"), F.translate(text, " ", "_"), F.translate(text, " ", "-")))


def first_target(text: Column) -> Column:
    """The first of a comma-separated list of targets; null if there is none."""
    name = F.trim(F.split(text, ",")[0])
    return F.when(name != "", name)


def class_text(names: Column, counts: Column) -> Column:
    """'a:50; b:50' from parallel arrays."""
    return F.array_join(F.zip_with(names, counts, lambda n, c: F.concat_ws(":", n.cast("string"), c.cast("string"))), "; ")


def signature(sizes: Column) -> Column:
    """Sorted sizes joined by '-'; null if all are null."""
    present = F.filter(sizes, lambda v: v.isNotNull())
    return F.when(F.size(present) > 0, F.array_join(F.array_sort(present).cast("array<string>"), "-"))
