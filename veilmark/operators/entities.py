"""Named entities that a model has found: which field they belong to, how near they stand to its anchors, and the best of them.

The model itself is not part of this library; its result is a column, an array of structs (entity_group, word, score, start)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .detect import blacklisted
from ..functions.rules import ENTITY_FIELDS
from ..functions.scalars import once, strip

#: Weights of the model's score and of nearness to an anchor, and the most confidence that an entity gets (fixed values).
SCORE_SHARE, NEAR_SHARE, MOST = 0.7, 0.3, 0.95


def entity_groups(field: str) -> list[str]:
    """Entity groups that may fill a field."""
    return [group for group, fields in ENTITY_FIELDS.items() if field in fields]


def nearness(start: Column, text: Column, anchors: list[str] | Column) -> Column:
    """1 at the first place of an anchor, falling to 0 at a whole text's length from it, or without an anchor in the text."""
    n = F.length(text)
    lower = F.transform(anchors, F.lower) if isinstance(anchors, Column) else F.array(*[F.lit(a.lower()) for a in anchors]).cast("array<string>")
    at = F.filter(F.transform(lower, lambda a: F.instr(F.lower(text), a) - 1), lambda i: i >= 0)
    least = F.least(F.array_min(F.transform(at, lambda i: F.abs(start - i))), n)
    return F.greatest(F.lit(0.0), 1 - F.coalesce(least, n) / F.greatest(n, F.lit(1)))


def best_entity(entities: Column, text: Column, field: str | Column, anchors: list[str] | Column) -> Column:
    """Struct (value, confidence) of the best entity for the field, the first of equals; null if none fits."""
    if isinstance(field, Column):
        fills = F.create_map(*[x for g, own in ENTITY_FIELDS.items() for x in (F.lit(g), F.array(*[F.lit(f) for f in own]))])
        fits = F.filter(entities, lambda e: F.coalesce(F.array_contains(F.try_element_at(fills, e["entity_group"]), field), F.lit(False)))
    else:
        groups = entity_groups(field)
        fits = F.filter(entities, lambda e: e["entity_group"].isin(groups))
    named = F.transform(fits, lambda e, i: F.struct((e["score"] * SCORE_SHARE + nearness(e["start"], text, anchors) * NEAR_SHARE).alias("confidence"), (-i).alias("order"), strip(e["word"]).alias("value")))
    if isinstance(field, Column):
        named = F.filter(named, lambda e: ~field.isin("name", "father_name") | ~blacklisted(e["value"]))
    elif field in ("name", "father_name"):
        named = F.filter(named, lambda e: ~blacklisted(e["value"]))
    return once(F.array_max(named), lambda best: F.when(F.coalesce(best["value"], F.lit("")) != "", F.struct(best["value"].alias("value"), F.least(best["confidence"], F.lit(MOST)).alias("confidence"))))
