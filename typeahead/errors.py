"""Errors, with a hint at the closest known name."""

from __future__ import annotations

from collections.abc import Iterable


class TypeaheadError(Exception):
    """Base of all errors raised here."""


class InvalidInputError(TypeaheadError, ValueError):
    pass


class StorageError(TypeaheadError, OSError):
    pass


class CorruptionError(TypeaheadError):
    pass


class ConflictError(TypeaheadError):
    pass


class NotFoundError(TypeaheadError, LookupError):
    pass


class NamespaceNotFoundError(NotFoundError):
    pass


class LayerNotFoundError(NotFoundError):
    pass


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def closest(name: str, known: Iterable[str]) -> str | None:
    """The known name nearest to a misspelt one, within a quarter of its length (1 to 3 edits)."""
    reach = min(3, max(1, len(name) // 4))
    found = [(levenshtein(name.lower(), k.lower()), i, k) for i, k in enumerate(known)]
    found = [f for f in found if f[0] <= reach]
    return min(found)[2] if found else None


def unknown(what: str, name: str, known: Iterable[str]) -> str:
    """A message that names what is missing and, if there is one, the likely intention."""
    near = closest(name, known := list(known))
    return f"{what} {name!r} not found" + (f"; did you mean {near!r}?" if near else "")
