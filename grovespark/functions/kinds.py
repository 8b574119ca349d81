"""Fixed dimensions of the graph model, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Search bonus per node kind.
KIND_BONUS = {
    "class": 8, "component": 8, "constant": 3, "enum": 5, "enum_member": 3, "export": 1, "field": 3, "file": 0, "function": 10, "import": 1, "interface": 9,
    "method": 10, "module": 4, "namespace": 4, "parameter": 0, "property": 3, "protocol": 9, "route": 9, "struct": 6, "trait": 9, "type_alias": 6, "variable": 2,
}
#: Languages whose symbols may refer to each other.
LANGUAGE_FAMILY = {
    "arkts": "web", "c": "c", "cpp": "c", "csharp": "dotnet", "java": "jvm", "javascript": "web", "jsx": "web", "kotlin": "jvm", "objc": "apple", "razor": "dotnet", "scala": "jvm", "swift": "apple", "tsx": "web", "typescript": "web",
}


def lookup(table: dict, key: Column, default=None) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def kind_bonus(kind: Column) -> Column:
    return lookup(KIND_BONUS, kind, 0)


def family(language: Column) -> Column:
    """The known family of a language, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGE_FAMILY.items() for x in kv]), language)


def same_family(a: Column, b: Column) -> Column:
    return F.coalesce((a == b) | (family(a) == family(b)), F.lit(False))


def crosses_known_family(a: Column, b: Column) -> Column:
    return F.coalesce((family(a) != family(b)) & (a != b), F.lit(False))


def is_config_leaf(kind: Column, language: Column) -> Column:
    return (kind == "constant") & language.isin("yaml", "properties")


def lifted_confidence(weight: Column) -> Column:
    return F.when(weight >= 10, 0.9).when(weight >= 3, 0.7).otherwise(0.5)


def cohesion_confidence(cohesion: Column) -> Column:
    return F.when(cohesion >= 0.3, 0.8).when(cohesion >= 0.1, 0.6).otherwise(0.4)


def explore_budget(n_files: Column) -> Column:
    """Calls allowed by the number of files: one more at 500, 5,000, 15,000 and 25,000."""
    return F.lit(1) + sum((n_files >= x).cast("int") for x in (500, 5000, 15000, 25000))


def edge_kind_priority(kind: Column) -> Column:
    return F.when(kind == "contains", 0).when(kind == "calls", 1).otherwise(2)


def edge_label(kind: Column, passed: Column) -> Column:
    """How an edge is named in a list of callers: nothing for a call; `passed` marks a function that is handed over by name."""
    return F.when(kind == "calls", None).when(F.coalesce(passed, F.lit(False)), "callback registration").when(kind == "instantiates", "instantiation").when(kind == "imports", "import").when(kind == "references", "reference").otherwise(kind)
