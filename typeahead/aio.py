"""Awaitable facades: the same names, run in a thread."""

from __future__ import annotations

import asyncio

from .engine import Client, Collection, Engine, Namespace
from .storage.database import Database


class _Awaited:
    """Calls of the wrapped object's methods become awaitable; building a plan stays synchronous."""

    _plans = ("complete", "complete_aliases", "vector_search", "hybrid_search")
    _wraps: dict[type, type] = {}

    def __init__(self, inner):
        self.inner = inner

    def __getattr__(self, name: str):
        found = getattr(self.inner, name)
        if not callable(found) or name in self._plans:
            return found

        async def call(*args, **kwargs):
            out = await asyncio.to_thread(found, *args, **kwargs)
            return self._wraps[type(out)](out) if type(out) in self._wraps else out

        return call


class AsyncDatabase(_Awaited):
    pass


class AsyncEngine(_Awaited):
    pass


class AsyncNamespace(_Awaited):
    pass


class AsyncClient(_Awaited):
    pass


class AsyncCollection(_Awaited):
    pass


_Awaited._wraps = {Database: AsyncDatabase, Engine: AsyncEngine, Namespace: AsyncNamespace, Client: AsyncClient, Collection: AsyncCollection}
