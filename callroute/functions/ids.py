"""Generated call-context ids and namespaced state keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callroute.sources.dims import STATE_KEY_PREFIX


def hyphenate_md5(hex32: Column) -> Column:
    """32 hex digits -> UUID layout 8-4-4-4-12."""
    return F.concat_ws(
        "-",
        F.substring(hex32, 1, 8),
        F.substring(hex32, 9, 4),
        F.substring(hex32, 13, 4),
        F.substring(hex32, 17, 4),
        F.substring(hex32, 21, 12),
    )


def generated_context(resource_id: Column, seq: Column) -> Column:
    """A new call context, UUID-shaped and deterministic.

    ``md5(resource_id | seq)`` means a replay of the same input (a restarted
    stream, a re-run batch) produces the same ids, which a random UUID would not.
    """
    return hyphenate_md5(F.md5(F.concat(resource_id, F.lit("|"), seq.cast("string"))))


def namespaced_key(resource_id: Column) -> Column:
    """The key under which the call context of a resource is stored."""
    return F.concat(F.lit(STATE_KEY_PREFIX), resource_id)
