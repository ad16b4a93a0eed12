"""Schema of a dataset: entity classes, relationship classes, their attributes; kept as JSON beside the tables."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

VERSION = "2025.2"
LAYOUTS = ("scalar", "list", "vector", "sparse")
#: Hidden column of entity tables: the number of the addition that an id came with.
ADDED = "_added"
REPEATS = ("forbidden", "allowed", "present")


def id_col(name: str) -> str:
    return f"{name}_id"


def num_col(name: str) -> str:
    return f"{name}_num"


def check_name(name: str, attribute: bool = False) -> None:
    """Names are word characters without a leading underscore; attributes may not look like id or number columns."""
    if not re.fullmatch(r"\w+", name) or name.startswith("_"):
        raise ValueError(f"invalid name: {name!r}")
    if attribute and re.search(r"_(id|num)$", name):
        raise ValueError(f"reserved name: {name!r}")


@dataclass
class Attribute:
    layout: str = "scalar"
    names: list[str] | None = None
    size: int | None = None


@dataclass
class EntityClass:
    attributes: dict[str, Attribute] = field(default_factory=dict)


@dataclass
class RelationshipClass:
    #: Entity class of each role, in order.
    entities: dict[str, str]
    interaction: bool = False
    repeats: str = "allowed"
    attributes: dict[str, Attribute] = field(default_factory=dict)


@dataclass
class Schema:
    name: str | None = None
    default_interaction: str | None = None
    entities: dict[str, EntityClass] = field(default_factory=lambda: {"item": EntityClass()})
    relationships: dict[str, RelationshipClass] = field(default_factory=dict)
    version: str = VERSION

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> Schema:
        d = json.loads(text)
        attributes = lambda a: {k: Attribute(**v) for k, v in a.items()}
        return cls(
            d.get("name"),
            d.get("default_interaction"),
            {k: EntityClass(attributes(v.get("attributes", {}))) for k, v in d["entities"].items()},
            {k: RelationshipClass(v["entities"], v.get("interaction", False), v.get("repeats", "allowed"), attributes(v.get("attributes", {}))) for k, v in d["relationships"].items()},
            d.get("version", "2025.1"),
        )
