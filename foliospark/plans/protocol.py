"""Protocols: what a review asks, as a value that survives a JSON file."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from foliospark.operators.extract import Field, check_fields
from foliospark.plans.readers import RECIPES

#: Stands for what the user has to fill in; a protocol that still holds it does not run.
PLACEHOLDER = "REPLACE"


@dataclass(frozen=True)
class Protocol:
    name: str
    question: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    fields: tuple[Field, ...] = ()
    outline: tuple[str, ...] = ()
    recipe: str = "thorough"
    description: str = ""
    search: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name or not self.question:
            raise ValueError("a protocol needs a name and a question")
        if self.recipe not in RECIPES:
            raise ValueError(f"no recipe {self.recipe!r}")
        if self.fields:
            check_fields(list(self.fields))


PROTOCOLS: dict[str, Protocol] = {}


def register_protocol(protocol: Protocol) -> Protocol:
    """The latest registration of a name wins."""
    PROTOCOLS[protocol.name] = protocol
    return protocol


for _p in (
    Protocol("bibliography", f"What is {PLACEHOLDER} about?", fields=(Field("title", "string"), Field("year", "integer"), Field("authors", "string"))),
    Protocol("evidence_table", f"What does the study report on {PLACEHOLDER}?", fields=(Field("design", "string"), Field("n", "integer"), Field("effect", "number"), Field("direction", "enum", values=("positive", "null", "negative", "mixed")))),
    Protocol("claims", f"What is claimed about {PLACEHOLDER}?"),
    Protocol("systematic_review", f"What is the effect of {PLACEHOLDER}?", include=(f"Studies {PLACEHOLDER}",), exclude=(f"Not about {PLACEHOLDER}",), fields=(Field("design", "string"), Field("n", "integer"))),
):
    register_protocol(_p)


def ready(protocol: Protocol) -> Protocol:
    """The protocol, or an error that names what is still to be filled in."""
    texts = {"question": protocol.question, **{f"include {k}": t for k, t in enumerate(protocol.include, 1)}, **{f"exclude {k}": t for k, t in enumerate(protocol.exclude, 1)}}
    left = [k for k, t in texts.items() if PLACEHOLDER in t]
    if left:
        raise ValueError(f"still to be written: {', '.join(left)}")
    return protocol


def to_json(protocol: Protocol) -> str:
    return json.dumps(asdict(protocol), ensure_ascii=False, indent=2, sort_keys=True)


def from_json(text: str) -> Protocol:
    raw = json.loads(text)
    unknown = set(raw) - {f.name for f in fields(Protocol)}
    if unknown:
        raise ValueError(f"not in a protocol: {', '.join(sorted(unknown))}")
    raw["fields"] = tuple(Field(**(f | {"values": tuple(f.get("values", ()))})) for f in raw.get("fields", ()))
    return Protocol(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def drift(before: Protocol, after: Protocol) -> dict[str, tuple]:
    """Fields of a protocol that changed, with both values."""
    a, b = asdict(before), asdict(after)
    return {k: (a[k], b[k]) for k in a if a[k] != b[k]}
