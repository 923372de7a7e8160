"""Versioned state of a component: bounded JSON with a checksum, upgraded step by step before it is used."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace

#: Bounds of a state, its nesting, and a chain of upgrades.
MAX_BYTES, MAX_DEPTH, MAX_HOPS = 1 << 20, 64, 64


class StateError(ValueError):
    """A state that can't be trusted or understood; nothing is read from it."""


def encode(value: dict) -> bytes:
    """Canonical JSON of an object within the bounds."""
    if not isinstance(value, dict):
        raise StateError("a state is an object")
    todo, deepest = [(value, 1)], 0
    while todo:
        at, depth = todo.pop()
        deepest = max(deepest, depth)
        if deepest > MAX_DEPTH:
            raise StateError("a state is nested too deeply")
        todo += [(v, depth + 1) for v in (at.values() if isinstance(at, dict) else at) if isinstance(v, (dict, list))]
    data = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()
    if len(data) > MAX_BYTES:
        raise StateError("a state is too large")
    return data


@dataclass(frozen=True)
class Envelope:
    """A payload with what it takes to read it: namespace, schema and codec with versions, checksum."""

    namespace: str
    schema: str
    schema_version: int
    codec: str
    codec_version: int
    payload: bytes
    checksum: str

    @classmethod
    def of(cls, namespace: str, schema: str, schema_version: int, value: dict, codec: str = "json", codec_version: int = 1) -> Envelope:
        data = encode(value)
        return cls(namespace, schema, schema_version, codec, codec_version, data, hashlib.sha256(data).hexdigest())


@dataclass
class Codec:
    """The current version of a schema, and one upgrade at most out of each older version: ``{from: (to, change)}``."""

    schema: str
    version: int
    upgrades: dict[int, tuple[int, Callable[[dict], dict]]] = field(default_factory=dict)
    codec: str = "json"
    codec_version: int = 1

    def open(self, envelope: Envelope) -> tuple[dict, Envelope]:
        """The value at the current version, and the envelope to keep, rewritten only if the payload changed."""
        if hashlib.sha256(envelope.payload).hexdigest() != envelope.checksum:
            raise StateError("the checksum is wrong")
        if envelope.codec != self.codec:
            raise StateError("another codec")
        if envelope.schema != self.schema:
            raise StateError("another schema")
        if envelope.schema_version > self.version or envelope.codec_version > self.codec_version:
            raise StateError("a newer version")
        value, at, hops = json.loads(envelope.payload), envelope.schema_version, 0
        while at != self.version:
            if at not in self.upgrades:
                raise StateError(f"no upgrade leads on from version {at}")
            at, change = self.upgrades[at]
            if at > self.version:
                raise StateError("an upgrade leads past the current version")
            if (hops := hops + 1) > MAX_HOPS:
                raise StateError("too many upgrades")
            value = change(value)
            encode(value)
        data = encode(value)
        changed = data != envelope.payload or at != envelope.schema_version
        kept = replace(envelope, schema_version=at, payload=data, checksum=hashlib.sha256(data).hexdigest()) if changed else envelope
        return value, kept


@dataclass(frozen=True)
class ExternalReference:
    """A state that is kept elsewhere, named by what it holds."""

    sha256: str
    size: int

    @classmethod
    def of(cls, data: bytes) -> ExternalReference:
        return cls(hashlib.sha256(data).hexdigest(), len(data))

    def verified(self, data: bytes) -> bytes:
        if ExternalReference.of(data) != self:
            raise StateError("the external state is not the one that was referred to")
        return data
