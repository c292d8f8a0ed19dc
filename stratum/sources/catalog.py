"""Named tables and indexes over Parquet folders."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.relational import build_index, open_index, scan
from ..schema import Relation


@dataclass(frozen=True)
class TableEntry:
    relation: Relation
    path: str


@dataclass(frozen=True)
class IndexEntry:
    table: str
    field: str
    path: str


@dataclass
class Catalog:
    root: str
    entries: dict[str, TableEntry | IndexEntry] = field(default_factory=dict)

    def add_table(self, relation: Relation, path: str | None = None) -> TableEntry:
        self.entries[relation.name] = entry = TableEntry(relation, path or f"{self.root}/{relation.name}")
        return entry

    def add_index(self, table: str, field_name: str, path: str | None = None) -> IndexEntry:
        self.table_entry(table).relation.width(field_name)
        self.entries[f"{table}.{field_name}"] = entry = IndexEntry(table, field_name, path or f"{self.root}/{table}_by_{field_name}")
        return entry

    def table_entry(self, name: str) -> TableEntry:
        if not isinstance(entry := self.entries.get(name), TableEntry):
            raise KeyError(f"no table {name}")
        return entry

    def store(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.table_entry(name).path)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return scan(spark, (e := self.table_entry(name)).path, e.relation.names)

    def store_index(self, spark: SparkSession, name: str, field_name: str) -> None:
        entry = self.entries[f"{name}.{field_name}"]
        build_index(self.table(spark, name), field_name, self.table_entry(name).relation.width(field_name), entry.path)

    def index(self, spark: SparkSession, name: str, field_name: str) -> DataFrame:
        if not isinstance(entry := self.entries.get(f"{name}.{field_name}"), IndexEntry):
            raise KeyError(f"no index on {name}.{field_name}")
        return open_index(spark, entry.path, field_name)
