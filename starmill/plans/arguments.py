"""Arguments of the pipelines.

What has to hold of them is declared beside each class as a table of rules and looked up when an object is made:
all rules of all its classes are judged in order, and the first one broken is raised.  What follows from the
arguments (readers, paths, opened catalogs) is then worked out by ``derive``.
"""

from __future__ import annotations

import os
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, ClassVar, NamedTuple

from starmill.functions.geometry import margin_order_for, min_distance_arcmin
from starmill.functions.healpix import MAX_ORDER
from starmill.sources.layout import KEYS, Catalog, remove
from starmill.sources.readers import InputReader, find_input_paths, get_file_reader

STAGES = ("mapping", "binning", "reducing", "finishing")
NAME_CHARACTERS = frozenset(string.ascii_letters + string.digits + "._-\\")


class Rule(NamedTuple):
    """``holds`` of the arguments; else ``text`` is raised after the name of ``subject``."""

    subject: str
    holds: Callable[[Any], bool]
    text: str
    raises: type[Exception] = ValueError


def given(*subjects: str) -> tuple[Rule, ...]:
    return tuple(Rule(s, lambda a, s=s: bool(getattr(a, s)), "has to be given") for s in subjects)


def within(subject: str, low: float, high: float, only: Callable[[Any], bool] = lambda a: True) -> Rule:
    return Rule(subject, lambda a: not only(a) or low <= getattr(a, subject) <= high, f"has to lie in {low:,}..{high:,}")


def folder(subject: str) -> Rule:
    """A local folder that is there; what has a scheme is left to its file system."""
    return Rule(subject, lambda a: not (path := getattr(a, subject)) or "://" in path or os.path.isdir(path), "is no folder", FileNotFoundError)


@dataclass(kw_only=True)
class RuntimeArguments:
    """What all pipelines take.

    resume=False deletes an earlier catalog of the name.  Work in progress lies in resume_tmp, else in a folder of
    the artifact's name in tmp_dir or spark_tmp, else in ``intermediate`` in the catalog.  n_tasks: tasks of the wide
    stages, the session's setting if 0.  progress_bar writes each stage's end to stderr, as a bar or, with
    simple_progress_bar, as plain lines.
    """

    output_path: str
    output_artifact_name: str
    addl_properties: dict[str, Any] = field(default_factory=dict)
    tmp_dir: str | None = None
    spark_tmp: str | None = None
    resume_tmp: str | None = None
    n_tasks: int = 0
    resume: bool = True
    progress_bar: bool = True
    simple_progress_bar: bool = False
    delete_intermediate_parquet_files: bool = True
    delete_resume_log_files: bool = True
    completion_email_address: str = ""

    RULES: ClassVar[tuple[Rule, ...]] = (
        *given("output_path", "output_artifact_name"),
        Rule("output_artifact_name", lambda a: NAME_CHARACTERS.issuperset(a.output_artifact_name), "may hold letters, digits, dots, dashes and underscores only"),
        Rule("n_tasks", lambda a: a.n_tasks >= 0, "cannot be negative"),
        *(folder(s) for s in ("tmp_dir", "spark_tmp")),
    )

    def __post_init__(self) -> None:
        for rule in self.rules():
            if not rule.holds(self):
                raise rule.raises(f"{rule.subject} {rule.text}")
        self.derive()
        if not self.resume:
            remove(self.catalog_path)

    @classmethod
    def rules(cls) -> Iterator[Rule]:
        """Those of the base class first."""
        for c in reversed(cls.__mro__):
            yield from c.__dict__.get("RULES", ())

    def derive(self) -> None:
        """Work out what follows from the arguments."""

    @property
    def catalog_path(self) -> str:
        return f"{self.output_path.rstrip('/')}/{self.output_artifact_name}"

    @property
    def tmp_path(self) -> str:
        if self.resume_tmp:
            return self.resume_tmp.rstrip("/")
        base = self.tmp_dir or self.spark_tmp
        return f"{base.rstrip('/')}/{self.output_artifact_name}/intermediate" if base else f"{self.catalog_path}/intermediate"


def _adaptive(a: ImportArguments) -> bool:
    return a.constant_healpix_order < 0


@dataclass(kw_only=True)
class ImportArguments(RuntimeArguments):
    """Import of files into a catalog.

    With use_healpix_29 the index column of the input tells the place; it stays in the leaves as a column of the
    input, whatever add_healpix_29 says, and no sort columns are taken.  run_stages: only these stages are run.
    """

    catalog_type: str = "object"
    input_path: str | None = None
    input_file_list: list[str] | None = None
    ra_column: str = "ra"
    dec_column: str = "dec"
    use_healpix_29: bool = False
    sort_columns: str | None = None
    add_healpix_29: bool = True
    use_schema_file: str | None = None
    expected_total_rows: int = 0
    constant_healpix_order: int = -1
    lowest_healpix_order: int = 0
    highest_healpix_order: int = 10
    pixel_threshold: int = 1_000_000
    drop_empty_siblings: bool = False
    run_stages: list[str] = field(default_factory=list)
    debug_stats_only: bool = False
    file_reader: InputReader | str = "parquet"

    RULES: ClassVar[tuple[Rule, ...]] = (
        Rule("catalog_type", lambda a: a.catalog_type in ("object", "source"), "is object or source"),
        within("constant_healpix_order", -1, MAX_ORDER),
        within("highest_healpix_order", 0, MAX_ORDER, _adaptive),
        Rule("lowest_healpix_order", lambda a: not _adaptive(a) or 0 <= a.lowest_healpix_order <= a.highest_healpix_order, "has to lie in 0..highest_healpix_order"),
        within("pixel_threshold", 100, 1_000_000_000, _adaptive),
        Rule("sort_columns", lambda a: not (a.use_healpix_29 and a.sort_columns), "have no use where the index column gives the order: sort columns and use_healpix_29 exclude each other"),
        Rule("run_stages", lambda a: set(a.run_stages) <= set(STAGES), f"knows {', '.join(STAGES)}"),
        Rule("input_path", lambda a: (a.input_path is None) != (a.input_file_list is None), "or input_file_list is needed, and not both"),
    )

    def derive(self) -> None:
        if _adaptive(self) and self.lowest_healpix_order == self.highest_healpix_order:
            self.constant_healpix_order = self.highest_healpix_order
        if isinstance(self.file_reader, str):
            self.file_reader = get_file_reader(self.file_reader)
        self.input_paths = find_input_paths(self.input_path, input_file_list=self.input_file_list)

    @property
    def mapping_order(self) -> int:
        return self.highest_healpix_order if _adaptive(self) else self.constant_healpix_order


@dataclass(kw_only=True)
class MarginCacheArguments(RuntimeArguments):
    """Margin catalog of a catalog. margin_order -1: from the threshold."""

    input_catalog_path: str
    margin_threshold: float = 5.0
    margin_order: int = -1
    fine_filtering: bool = True
    boundary_samples: int | None = None
    debug_filter_pixel_list: list[tuple[int, int]] = field(default_factory=list)

    RULES: ClassVar[tuple[Rule, ...]] = (*given("input_catalog_path"), Rule("margin_threshold", lambda a: a.margin_threshold > 0, "has to be positive"))

    def derive(self) -> None:
        self.catalog = Catalog.open(self.input_catalog_path)
        if self.debug_filter_pixel_list:
            self.catalog = self.catalog.overlapping(self.debug_filter_pixel_list)
        if self.margin_order < 0:
            self.margin_order = margin_order_for(self.margin_threshold)
        if (finest := self.catalog.highest_order) >= self.margin_order:
            raise ValueError(f"margin_order {self.margin_order} is too coarse: it needs a higher order than the finest partition, {finest}")
        if min_distance_arcmin(self.margin_order) * 60 < self.margin_threshold:
            raise ValueError(f"margin_order {self.margin_order} is too fine: its cells are narrower than margin_threshold")


@dataclass(kw_only=True)
class IndexArguments(RuntimeArguments):
    """Secondary index of a catalog; its columns have to be columns of the catalog."""

    input_catalog_path: str
    indexing_column: str
    extra_columns: list[str] = field(default_factory=list)
    include_healpix_29: bool = True
    include_order_pixel: bool = True
    include_radec: bool = False
    drop_duplicates: bool = True
    compute_partition_size: int = 1_000_000_000
    division_hints: list | None = None

    RULES: ClassVar[tuple[Rule, ...]] = (
        *given("input_catalog_path", "indexing_column"),
        Rule("include_order_pixel", lambda a: a.include_order_pixel or a.include_healpix_29, "and include_healpix_29 cannot both be off: an index has to tell where a row lies"),
        Rule("compute_partition_size", lambda a: a.compute_partition_size >= 100_000, "is at least 100,000 bytes"),
    )

    def derive(self) -> None:
        self.catalog = Catalog.open(self.input_catalog_path)
        radec = [self.catalog.properties[KEYS[k]] for k in ("col_ra", "col_dec")] if self.include_radec else []
        self.extra_columns = list(dict.fromkeys([*self.extra_columns, *radec]))
        known = self.catalog.column_names()
        if known is not None and (unknown := [c for c in [self.indexing_column, *self.extra_columns] if c not in known]):
            raise ValueError(f"the catalog has no columns {', '.join(unknown)}")


@dataclass(kw_only=True)
class SoapArguments(RuntimeArguments):
    """Association of a source catalog with an object catalog.

    compute_partition_size: bytes of a row group's aim in the leaves.
    """

    object_catalog_dir: str
    object_id_column: str
    source_catalog_dir: str
    source_object_id_column: str
    source_id_column: str | None = None
    write_leaf_files: bool = False
    compute_partition_size: int = 1_000_000_000

    RULES: ClassVar[tuple[Rule, ...]] = (
        *given("object_catalog_dir", "object_id_column", "source_catalog_dir", "source_object_id_column"),
        Rule("compute_partition_size", lambda a: a.compute_partition_size >= 100_000, "is at least 100,000 bytes"),
    )

    def derive(self) -> None:
        self.objects, self.sources = Catalog.open(self.object_catalog_dir), Catalog.open(self.source_catalog_dir)


@dataclass(kw_only=True)
class ConversionArguments(RuntimeArguments):
    """Conversion of a catalog of the older layout."""

    input_catalog_path: str

    RULES: ClassVar[tuple[Rule, ...]] = given("input_catalog_path")


@dataclass(kw_only=True)
class VerificationArguments(RuntimeArguments):
    """Checks of a catalog, by its path or opened, written as a report."""

    input_catalog_path: str | None = None
    input_catalog: Catalog | None = None
    field_distribution_cols: list[str] = field(default_factory=list)

    RULES: ClassVar[tuple[Rule, ...]] = (Rule("input_catalog_path", lambda a: bool(a.input_catalog_path) or a.input_catalog is not None, "or input_catalog is needed"),)

    def derive(self) -> None:
        self.catalog = self.input_catalog or Catalog.open(self.input_catalog_path)
