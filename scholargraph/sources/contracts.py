"""Schema contracts: which versions of a table are known, how older ones are brought up to date, and refusal of others."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownSchema(ValueError):
    """The table is of no version that is known."""


@dataclass(frozen=True)
class Version:
    """Columns that a version adds to the one before, with the SQL expression that older rows get; and names that it changes."""

    adds: dict[str, tuple[str, str]] = field(default_factory=dict)
    renames: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Contract:
    """A table's first columns and what each later version changed. Types are SQL names; other columns are let through."""

    name: str
    first: dict[str, str]
    later: tuple[Version, ...] = ()

    def columns(self, version: int) -> dict[str, str]:
        """name -> type of the columns of a version, from 1 on."""
        now = dict(self.first)
        for v in self.later[: version - 1]:
            now = {v.renames.get(c, c): kind for c, kind in now.items()} | {c: kind for c, (kind, _) in v.adds.items()}
        return now

    def version_of(self, schema: T.StructType, stated: int | None = None) -> int:
        """The version of a schema: the stated one, or the latest whose columns are all there. Types must agree (or be
        widened without loss); what fits no version, or not the stated one, is refused with what is missing."""
        has = {f.name: f.dataType for f in schema}
        problems = []
        for version in [stated] if stated is not None else range(len(self.later) + 1, 0, -1):
            if not 1 <= version <= len(self.later) + 1:
                raise UnknownSchema(f"{self.name}: version {version} is not among 1 to {len(self.later) + 1}")
            wanted = {c: T.StructType.fromDDL(f"c {k}")["c"].dataType for c, k in self.columns(version).items()}
            wrong = [f"{c} {k.simpleString()}" for c, k in wanted.items() if c not in has or not _fits(has[c], k)]
            if not wrong:
                return version
            problems.append(f"version {version} lacks {', '.join(wrong)}")
        raise UnknownSchema(f"{self.name}: {'; '.join(problems)}")

    def current(self, df: DataFrame, stated: int | None = None) -> DataFrame:
        """The table with the columns of the latest version first, then those that no version names. Only the schema is
        looked at: nothing is read."""
        version = self.version_of(df.schema, stated)
        for v in self.later[version - 1 :]:
            for old, new in v.renames.items():
                df = df.withColumnRenamed(old, new)
            df = df.withColumns({c: F.expr(value).cast(kind) for c, (kind, value) in v.adds.items()})
        latest = self.columns(len(self.later) + 1)
        rest = [c for c in df.columns if c not in latest]
        return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in latest.items()], *[F.col(f"`{c}`") for c in rest])


_WIDER = ["tinyint", "smallint", "int", "bigint", "decimal(20,0)"]


def _fits(has: T.DataType, wanted: T.DataType) -> bool:
    a, b = has.simpleString(), wanted.simpleString()
    return a == b or (a in _WIDER and b in _WIDER and _WIDER.index(a) <= _WIDER.index(b)) or (a == "float" and b == "double")


#: Stored corpus records: version 2 split the title off its normal form, version 3 added where a record came from.
RECORDS = Contract(
    "records", {"ut": "string", "title": "string", "pub_year": "int"},
    (Version(adds={"normalized_title": ("string", "lower(trim(title))")}, renames={"pub_year": "year"}),
     Version(adds={"origin": ("string", "'IMPORT'"), "batch": ("bigint", "NULL")})))
