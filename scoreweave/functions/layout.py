"""Texts from rows by a caller's layout: blocks of ``label: value`` lines, empty ones left out.

A layout is a list of blocks, a block a list of fields; every operator that writes a text takes one. Without one,
the columns stand under their own names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreweave.functions.fields import fixed


@dataclass(frozen=True)
class Field:
    """A column and how it is shown. ``digits`` rounds a number; ``empty`` stands for a missing value, None leaves its
    line out. Arrays are joined by ``between``, maps are shown as ``key=value``."""

    column: str
    label: str | None = None
    digits: int | None = None
    empty: str | None = None
    between: str = "; "


@dataclass(frozen=True)
class Block:
    """Lines under a title; the block is left out if none of its lines has a value."""

    fields: Sequence[Field | str]
    title: str | None = None


def _value(field: Field, kind: T.DataType) -> Column:
    c = F.col(f"`{field.column}`")
    if isinstance(kind, T.ArrayType):
        text = F.array_join(c, field.between)
    elif isinstance(kind, T.MapType):
        text = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), field.between)
    elif isinstance(kind, T.BooleanType):
        text = F.when(c, "yes").when(~c, "no")
    elif field.digits is not None:
        text = fixed(c, field.digits)
    else:
        text = c.cast("string")
    text = F.when(text != "", text)
    return text if field.empty is None else F.coalesce(text, F.lit(field.empty))


def rendered(df: DataFrame, blocks: Sequence[Block]) -> Column:
    """The text of a row of ``df``; fields whose column the table lacks are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for block in blocks:
        lines = []
        for field in block.fields:
            field = Field(field) if isinstance(field, str) else field
            if field.column in kinds:
                label = field.label or field.column.replace("_", " ")
                lines.append(F.concat(F.lit(f"{label}: "), _value(field, kinds[field.column])))
        if lines:
            text = F.concat_ws("\n", *lines)
            head = F.concat(F.lit(f"{block.title}\n"), text) if block.title else text
            parts.append(F.when(text != "", head))
    return F.concat_ws("\n\n", *parts)
