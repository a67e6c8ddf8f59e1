"""Options of a projection and their valid ranges."""

from __future__ import annotations

from dataclasses import asdict, dataclass


class OptionError(ValueError):
    """An option lies outside of its range."""


@dataclass(frozen=True)
class ProjectionOptions:
    """Settings of a build and of the scans over it.

    ``strict`` keeps the capability limits (two keys, sixteen payload columns, 32-byte
    text keys, no text as second key, no decimal keys); without it they are lifted.
    """

    strict: bool = True
    #: Rows of a leaf, the unit of statistics.
    leaf_rows: int = 65_536
    #: Leaves under one entry of the next level.
    fanout: int = 8
    build_zone_maps: bool = True
    build_bloom_filters: bool = True
    zone_maps: bool = True
    bloom_filters: bool = True
    bloom_nhash: int = 2
    #: Parquet's own filter on the leading key, for keys absent inside a range.
    parquet_bloom: bool = False
    row_group_bytes: int = 16 << 20
    #: Share of distinct runs from which a leaf no longer counts as run-length coded.
    rle_uniqueness_threshold: float = 0.98
    cost_page: float = 1.0
    cost_tup: float = 1.0

    def __post_init__(self) -> None:
        for name, low, high in (
            ("leaf_rows", 1, 1 << 30),
            ("fanout", 2, 1 << 20),
            ("bloom_nhash", 1, 4),
            ("row_group_bytes", 1 << 10, 1 << 32),
            ("rle_uniqueness_threshold", 0.0, 1.0),
            ("cost_page", 0.0, 10_000.0),
            ("cost_tup", 0.0, 10_000.0),
        ):
            value = getattr(self, name)
            if not low <= value <= high:
                raise OptionError(f"{value} is outside the valid range for {name} ({low} .. {high})")

    def to_dict(self) -> dict:
        return asdict(self)
