"""Rows that fail to parse: the good ones loaded, the bad ones apart, each with its reasons.

Method: one anchored regular expression is generated from the schema for the whole row.  A row it matches is good.  A row
it does not match goes through prefix patterns that grow by one field each: the first that fails names the first
broken field, and since the fields before it only have to be well formed, each later field is tested the same way.  The
patterns use possessive quantifiers, so a text of any length is read once, without recursion.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A column of a record.  ``pattern``: what its value must match in full (no anchors, no commas or quotes in what it can
    match); none: any text.  ``reason``: what a value that does not match is reported as."""

    name: str
    pattern: str | None = None
    reason: str = ""


@dataclass(frozen=True)
class RecordSchema:
    fields: list[Field] = field(default_factory=list)

    # An unquoted field holds no quote; a quoted one only doubled quotes, and ends before a comma or the end.
    BARE = r'[^",]*+'
    QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'

    @property
    def any_field(self) -> str:
        return rf"(?:{self.QUOTED}(?=,|\z)|(?!\"){self.BARE}(?=,|\z))"

    def typed(self, f: Field) -> str:
        return self.any_field if f.pattern is None else rf'(?:"(?:{f.pattern})"|(?:{f.pattern}))(?=,|\z)'

    @property
    def row(self) -> str:
        """The whole row, every field typed."""
        return r"\A" + ",".join(self.typed(f) for f in self.fields) + r"\z"

    @property
    def quoting(self) -> str:
        """Any number of well-formed fields."""
        return rf"\A{self.any_field}(?:,{self.any_field})*+\z"

    @property
    def count(self) -> str:
        return rf"\A{self.any_field}(?:,{self.any_field}){{{len(self.fields) - 1}}}\z"

    def prefix(self, at: int) -> str:
        """The row up to and with field ``at``: that one typed, those before it only well formed."""
        return r"\A" + f"{self.any_field}," * at + self.typed(self.fields[at])

    def shape(self, at: int) -> str:
        """The row up to and with field ``at``, well formed; group 1 is that field."""
        return r"\A" + f"{self.any_field}," * at + f"({self.any_field})"


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(pattern), F.lit(False))


def row_reasons(record: Column, schema: RecordSchema) -> Column:
    """The reasons a record is bad, in the order of its fields; an empty array for a good one.

    ``quoting`` alone if the record's quotes are broken, ``field_count`` alone if it has another number of fields (a null
    record has none), else the reasons of all fields with unusable values, each once.
    """
    typed = [F.when(~_matches(record, schema.prefix(i)), F.lit(f.reason)) for i, f in enumerate(schema.fields) if f.pattern is not None]
    values = F.array_distinct(F.array_compact(F.array(*typed))) if typed else F.array().cast("array<string>")
    shaped = F.when(record.isNull(), F.array(F.lit("field_count"))).when(~_matches(record, schema.quoting), F.array(F.lit("quoting")))
    shaped = shaped.when(~_matches(record, schema.count), F.array(F.lit("field_count"))).otherwise(values)
    return F.when(_matches(record, schema.row), F.array().cast("array<string>")).otherwise(shaped)


def first_broken(record: Column, schema: RecordSchema) -> Column:
    """Position (from 1) of the first field that is malformed, missing or unusable; null for a good record."""
    steps = [F.when(~_matches(record, schema.prefix(i)), F.lit(i + 1)) for i in range(len(schema.fields))]
    return F.when(~_matches(record, schema.row), F.coalesce(*steps, F.lit(len(schema.fields) + 1)))


def record_fields(record: Column, schema: RecordSchema) -> list[Column]:
    """The values of a well-formed record, unquoted."""
    out = []
    for i, f in enumerate(schema.fields):
        raw = F.regexp_extract(record, schema.shape(i), 1)
        inner = F.regexp_replace(raw.substr(F.lit(2), F.length(raw) - 2), '""', '"')
        out.append(F.when(raw.startswith('"'), inner).otherwise(raw).alias(f.name))
    return out


def split_records(df: DataFrame, record: str, schema: RecordSchema) -> tuple[DataFrame, DataFrame]:
    """``(loaded, rejected)`` of a table with one text record a row.

    Both keep the table's own columns; ``loaded`` adds a struct ``fields`` with the record's values, ``rejected`` adds ``reasons``
    and ``first_broken``.  A row is in exactly one of them, whatever it holds (null and empty records are rejected as
    ``field_count``); repeated rows are kept.  Columns of ``df`` named like the added ones are replaced.
    """
    added = ("fields", "reasons", "first_broken")
    base = df.select(*(F.col(f"`{c}`") for c in df.columns if c not in added or c == record))
    judged = base.withColumn("__reasons", row_reasons(F.col(record), schema))
    loaded = judged.where(F.size("__reasons") == 0).withColumn("fields", F.struct(*record_fields(F.col(record), schema))).drop("__reasons")
    rejected = judged.where(F.size("__reasons") > 0).withColumn("first_broken", first_broken(F.col(record), schema)).withColumnRenamed("__reasons", "reasons")
    return loaded, rejected


_APART = "\x1f"


def column_reasons(schema: RecordSchema, columns: dict[str, Column] | None = None) -> Column:
    """The reasons of a row whose fields are columns already, by the same patterns: its typed fields are put into one
    record with a separator that no field may hold (one found in a value is replaced, which no pattern accepts)."""
    typed = [f for f in schema.fields if f.pattern is not None]
    value = lambda f: (columns or {}).get(f.name, F.col(f.name)).cast("string")
    record = F.concat_ws(_APART, *(F.translate(F.coalesce(value(f), F.lit("")), _APART, "\x1e") for f in typed))
    whole = r"\A" + _APART.join(f"(?:{f.pattern})" for f in typed) + r"\z"
    skip = f"[^{_APART}]*+{_APART}"
    each = [F.when(~_matches(record, rf"\A(?:{skip}){{{i}}}(?:{f.pattern})(?={_APART}|\z)"), F.lit(f.reason)) for i, f in enumerate(typed)]
    return F.when(_matches(record, whole), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array_compact(F.array(*each))))
