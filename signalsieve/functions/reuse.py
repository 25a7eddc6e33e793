"""Columns built once per application.

A scoring plan has a few thousand expression nodes, and every node is a call into the JVM.
Columns are immutable and bound to no session, so the same ones serve every plan; this
matters for streams, which plan anew for every micro-batch.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
KEPT = 64  # results; the least recently used one goes first
_BUILT: OrderedDict[tuple, tuple] = OrderedDict()


def reuse(kind: str, parts: tuple, make: Callable[[], T]) -> T:
    """``make()``, or its earlier result for the very same ``parts`` objects."""
    session = SparkSession.getActiveSession()
    application = session.sparkContext.applicationId if session else ""
    key = (kind, application, *map(id, parts))
    if key not in _BUILT:
        # the parts are kept with the result, so that their ids stay theirs
        _BUILT[key] = (make(), parts)
        if len(_BUILT) > KEPT:
            _BUILT.popitem(last=False)
    _BUILT.move_to_end(key)
    return _BUILT[key][0]
