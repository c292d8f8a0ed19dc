"""The three-table range query: titles in a range and the people credited in a category."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.relational import equi_join, index_range, project, select_equal, select_range


def credits_in_range(movies: DataFrame, workedon: DataFrame, people: DataFrame, start: str, end: str, category: str = "director", width: int = 482, order: str = "signed", indexed: bool = False) -> DataFrame:
    """title, name of each credit. `movies` is the table, or its title-sorted copy when `indexed`. The filters sit
    on the scans and only joined columns are read; which side is broadcast is left to the planner."""
    hits = index_range(movies, "title", start, end, width) if indexed else select_range(movies, "title", start, end, width, order)
    credits = project(select_equal(workedon, "category", category), ["movieId", "personId"])
    first = equi_join(hits, credits, "movieId", "movieId", ["movieId", "title", "personId"])
    second = equi_join(first, people, "personId", "personId", ["movieId", "title", "personId", "name"])
    return project(second, ["title", "name"])
