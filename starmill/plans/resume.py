"""Done markers of stages, so that a broken run goes on where it stopped.

A stage is done if its marker exists.  Within the stages that write files a file that is there is its own marker, as
the sinks move files into place when they are whole: ``Stages.todo`` tells which are still to be written.
"""

from __future__ import annotations

import json
import sys
import time

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from starmill.sources.layout import filesystem, footers, leaf_path, read_text, remove, write_text

Pixel = tuple[int, int]


class Stages:
    """Stages in their order; all before a done one have to be done.

    progress: None, "bar" or "lines", see ``touch``.
    """

    def __init__(self, path: str, names: tuple[str, ...], resume: bool, progress: str | None = None):
        self.path, self.names, self.progress, self.since = path, names, progress, time.monotonic()
        if not resume:
            remove(path)
        elif self._exists(""):
            self._say(f"going on with the work in {path}")
        done = [self.done(n) for n in names]
        for k, stage in enumerate(names):
            if done[k] and (lacking := [n for n, d in zip(names[:k], done, strict=False) if not d]):
                raise ValueError(f"{path} is broken: {stage} is done, but {', '.join(lacking)} must be complete before it")

    def _say(self, text: str) -> None:
        if self.progress:
            print(text, file=sys.stderr)

    def _exists(self, name: str) -> bool:
        fs, p = filesystem(f"{self.path}/{name}" if name else self.path)
        return fs.get_file_info(p).type != pafs.FileType.NotFound

    def done(self, stage: str) -> bool:
        return self._exists(f"{stage}_done")

    def touch(self, stage: str) -> None:
        """Mark a stage as done and tell so: its name, how many there are, the seconds it took."""
        write_text(f"{self.path}/{stage}_done", "")
        k, now = self.names.index(stage) + 1, time.monotonic()
        drawn = f"[{'#' * k}{'.' * (len(self.names) - k)}] " if self.progress == "bar" else ""
        self._say(f"{stage:<10} {drawn}{k}/{len(self.names)} {now - self.since:.1f} s")
        self.since = now

    def todo(self, spark: SparkSession, dataset: str, expected: dict[Pixel, int]) -> list[Pixel]:
        """The pixels whose leaf is not there or has not the expected number of rows."""
        pixels = sorted(expected)
        whole = {r.at: r.n_rows for r in footers(spark, dataset, [leaf_path("", *p).lstrip("/") for p in pixels]).select("at", "n_rows").toLocalIterator()} if pixels else {}
        return [p for k, p in enumerate(pixels) if whole.get(k) != expected[p]]

    def complete(self, stage: str, left: list) -> None:
        """Stop if something of a stage is left."""
        if left:
            raise RuntimeError(f"{stage}: {len(left)} of its keys are left, such as {left[:3]}")

    def same_inputs(self, paths: list[str]) -> None:
        """A resumed run has to have the inputs of the first one, each once."""
        if len(set(paths)) != len(paths):
            raise ValueError("an input file is listed twice")
        known = read_text(f"{self.path}/input_paths.json")
        if known is None:
            write_text(f"{self.path}/input_paths.json", json.dumps(sorted(paths)))
        elif json.loads(known) != sorted(paths):
            raise ValueError(f"the input files are not those the work in {self.path} was begun with")

    def same_plan(self, plan: dict) -> bool:
        """False if the work in the folder was begun with another plan, whose results are of no use then."""
        text = json.dumps(plan, sort_keys=True)
        known = read_text(f"{self.path}/plan.json")
        if known != text:
            write_text(f"{self.path}/plan.json", text)
        return known is None or known == text

    def forget(self, *stages: str) -> None:
        for stage in stages:
            fs, p = filesystem(f"{self.path}/{stage}_done")
            if fs.get_file_info(p).type == pafs.FileType.File:
                fs.delete_file(p)

    def clean(self, intermediate: bool, markers: bool) -> None:
        """Both flags are needed to remove the work folder."""
        if intermediate and markers:
            remove(self.path)
