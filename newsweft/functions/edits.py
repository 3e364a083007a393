"""Sets, removes and tests of nested keys of JSON objects, by variants and maps: no Python runs for a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsweft.functions.names import let


def _object(value: Column) -> Column:
    """The members of a variant that is an object, else none."""
    return F.coalesce(F.try_variant_get(value, "$", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))


def _variant(members: Column) -> Column:
    return F.parse_json(F.to_json(members))


def set_key(value: Column, path: list[str], new: Column) -> Column:
    """The variant with ``new`` (a variant) at ``path``; what is no object on the way becomes one. Null stays null."""
    key, rest = path[0], path[1:]

    def put(members: Column) -> Column:
        inner = set_key(F.coalesce(F.try_element_at(members, F.lit(key)), F.parse_json(F.lit("{}"))), rest, new) if rest else new
        others = F.map_filter(members, lambda k, _: k != key)
        return _variant(F.map_concat(others, F.create_map(F.lit(key), inner)))

    return F.when(value.isNotNull(), let(_object(value), put))


def remove_key(value: Column, path: list[str]) -> Column:
    """The variant without ``path``; as it is where the path is not there."""
    key, rest = path[0], path[1:]

    def drop(members: Column) -> Column:
        others = F.map_filter(members, lambda k, _: k != key)
        if rest:
            others = F.map_concat(others, F.create_map(F.lit(key), remove_key(F.try_element_at(members, F.lit(key)), rest)))
        return _variant(others)

    return F.when(has_key(value, path), let(_object(value), drop)).otherwise(value)


def has_key(value: Column, path: list[str]) -> Column:
    """Objects lead to the path's last key, whatever its value, JSON null included."""
    key, rest = path[0], path[1:]
    there = F.coalesce(F.map_contains_key(_object(value), F.lit(key)), F.lit(False))
    return there & has_key(F.try_element_at(_object(value), F.lit(key)), rest) if rest else there
