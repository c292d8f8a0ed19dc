"""Relations of fixed-width string fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

PAGE_BYTES, PAGE_HEADER = 4096, 4


@dataclass(frozen=True)
class Field:
    name: str
    width: int  # UTF-8 bytes

    def __post_init__(self):
        if not self.name or self.width < 1:
            raise ValueError(f"bad field: {self.name!r} of {self.width} bytes")


@dataclass(frozen=True)
class Relation:
    """An ordered list of fields; a record is their widths added up."""

    name: str
    fields: tuple[Field, ...]

    @classmethod
    def of(cls, name: str, /, **widths: int) -> Relation:
        return cls(name, tuple(Field(k, v) for k, v in widths.items()))

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def record_bytes(self) -> int:
        return sum(f.width for f in self.fields)

    @property
    def page_rows(self) -> int:
        """Records of a page."""
        return (PAGE_BYTES - PAGE_HEADER) // self.record_bytes

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.StringType(), True, {"width": f.width}) for f in self.fields])

    def width(self, name: str) -> int:
        for f in self.fields:
            if f.name == name:
                return f.width
        raise KeyError(f"{self.name} has no field {name}")


MOVIES = Relation.of("movies", movieId=10, title=482)
WORKEDON = Relation.of("workedon", movieId=10, personId=10, category=20)
PEOPLE = Relation.of("people", personId=10, name=105)
