"""Manifests: bounded, versioned requests for snapshots, checked against a table of fields."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any
from urllib.parse import urlparse

NAME = re.compile(r"[a-z0-9][a-z0-9_-]{2,63}")
REQUIRED = object()
#: Fixed: the host that serves quarterly archives.
ARCHIVE_HOST = "fis.fda.gov"


@dataclass(frozen=True)
class Field:
    """What a value must be, in words and as a test, and what it is if it is left out."""

    must: str
    test: Callable[[Any], bool]
    default: Any = REQUIRED


def _whole(low: int, high: int) -> Field:
    return Field(f"a whole number from {low} to {high}", lambda v: isinstance(v, int) and not isinstance(v, bool) and low <= v <= high)


def _matching(pattern: re.Pattern, what: str) -> Field:
    return Field(what, lambda v: isinstance(v, str) and pattern.fullmatch(v) is not None)


def _filled(default: Any = REQUIRED, optional: bool = False) -> Field:
    return Field("text that is not blank", lambda v: (optional and v is None) or (isinstance(v, str) and bool(v.strip())), default)


#: Fields of the kinds of manifests, with the limits of their interfaces.
KINDS: dict[str, dict[str, Field]] = {
    "openfda": {"manifest_version": _whole(1, 1), "snapshot_id": _matching(NAME, "a safe identifier"), "search": _filled(), "page_size": _whole(1, 1_000), "max_records": _whole(1, 25_000)},
    "socrata": {
        "manifest_version": _whole(1, 1), "source": _matching(NAME, "a safe identifier"), "snapshot_id": _matching(NAME, "a safe identifier"), "domain": _matching(re.compile(r"[a-z0-9.-]+\.[a-z]{2,}"), "a host name"),
        "dataset_id": _matching(re.compile(r"[a-z0-9]{4}-[a-z0-9]{4}"), "of the form xxxx-xxxx"), "page_size": _whole(1, 50_000), "max_records": _whole(1, 250_000), "where": _filled(None, True), "order": _filled(":id"), "select": _filled(None, True),
    },
}


@dataclass(frozen=True)
class Manifest:
    kind: str
    values: dict[str, Any]

    def __getitem__(self, name: str) -> Any:
        return self.values[name]

    @property
    def source(self) -> str:
        return self.values.get("source", self.kind)

    @property
    def digest(self) -> str:
        """SHA-256 of all values, defaults included, as sorted ASCII JSON (without the newline that files end with)."""
        return hashlib.sha256(json.dumps(self.values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def canonical(value: Any) -> bytes:
    """JSON with sorted keys, no spaces, characters as themselves, and a closing newline."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode() + b"\n"


def manifest(kind: str, given: dict[str, Any]) -> Manifest:
    """The manifest of a kind; unknown, missing and unfit fields are named in the error."""
    fields = KINDS[kind]
    faults = [f"{name}: unknown" for name in sorted(set(given) - set(fields))]
    values = {name: given.get(name, f.default) for name, f in fields.items()}
    faults += [f"{name}: missing" if values[name] is REQUIRED else f"{name}: must be {f.must}" for name, f in fields.items() if values[name] is REQUIRED or not f.test(values[name])]
    if faults:
        raise ValueError("; ".join(faults))
    return Manifest(kind, values)


def load(kind: str, path: str) -> Manifest:
    with open(path, encoding="utf-8") as f:
        return manifest(kind, json.load(f))


def archives(given: dict[str, Any], quarters: Iterable[str] | None = None) -> list[dict[str, Any]]:
    """The archives of a quarterly manifest, in its order; of some quarters on request, all of which it must list.

    A quarter appears once, and an archive is a ZIP file under HTTPS on the one allowed host.
    """
    listed = given["archives"]
    names = [a["quarter"] for a in listed]
    for a in listed:
        place = urlparse(a["url"])
        if not re.fullmatch(r"\d{4}Q[1-4]", a["quarter"]):
            raise ValueError(f"not a quarter: {a['quarter']!r}")
        if (place.scheme, place.hostname) != ("https", ARCHIVE_HOST) or not place.path.lower().endswith(".zip"):
            raise ValueError(f"not a ZIP file under HTTPS on {ARCHIVE_HOST}: {a['url']}")
    if len(set(names)) < len(names):
        raise ValueError("a quarter appears twice")
    wanted = set(names if quarters is None else quarters)
    if wanted - set(names):
        raise ValueError(f"quarters that the manifest lacks: {sorted(wanted - set(names))}")
    return [a for a in listed if a["quarter"] in wanted]
