"""A search, from spec to results."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.operators import render, summary
from textquarry.operators.filters import by_line, content_conditions, path_matches, scan_filter, searched_lines, select_files
from textquarry.operators.windows import with_windows
from textquarry.plans.spec import NoCandidates, NoMatches, QuerySpec
from textquarry.sources.bundle import write_parts


@dataclass
class Search:
    """Everything is lazy; each attribute is a DataFrame over the corpus."""

    corpus: DataFrame
    spec: QuerySpec

    @cached_property
    def candidates(self) -> DataFrame:
        return scan_filter(self.corpus, self.spec)

    @cached_property
    def selected(self) -> DataFrame:
        return select_files(self.corpus, self.spec)

    def _windowed(self, **fields: bool) -> DataFrame:
        """The selected files, with windows if context is asked. Where every match lies in a line, the windows tell which files are selected, and no other pass looks for it."""
        if not self.spec.context:
            return self.selected
        files = with_windows(searched_lines(self.corpus, self.spec), self.spec.pattern, self.spec.context, **fields)
        return files.where(F.size("windows") > 0) if by_line(self.spec) else files

    @cached_property
    def blocks(self) -> DataFrame:
        return render.rendered(self._windowed(matches=False), self.spec)

    @cached_property
    def sized(self) -> DataFrame:
        """Selected files with the size of their blocks, which aren't put together for it."""
        return self._windowed(chars=True, lines=False, matches=False).withColumn("size", render.block_size(self.spec))

    @cached_property
    def sizes(self) -> DataFrame:
        return summary.file_sizes(self.sized.where(render.gives_block(self.spec)))

    def unreadable(self) -> DataFrame:
        """Selected files that could not be read, and why."""
        return self.selected.where("content IS NULL").select("rel", "error") if "error" in self.selected.columns else self.selected.where("false").select("rel", F.lit("").alias("error"))

    def require(self) -> None:
        """Raises NoCandidates or NoMatches."""
        if self.candidates.isEmpty():
            raise NoCandidates("no files with the asked extensions")
        if self.selected.isEmpty():
            raise NoMatches("no files match")

    def outcome(self) -> DataFrame:
        """One row: how many candidates and selected files there are, and the exit code that follows."""
        some = F.count("*")
        kept = F.lit(True)
        for condition in content_conditions(self.spec):
            kept &= F.coalesce(condition, F.lit(False))
        counts = path_matches(self.candidates, self.spec).agg(some.alias("candidates"), F.coalesce(F.sum((F.col("_path") & kept).cast("long")), F.lit(0)).alias("selected"))
        code = F.when(F.col("candidates") == 0, NoCandidates.exit_code).when(F.col("selected") == 0, NoMatches.exit_code).otherwise(0)
        return counts.withColumn("exit_code", code)

    def preview(self) -> DataFrame:
        return self.selected.select("rel", "ord").orderBy("ord")

    def bundle(self) -> Iterator[str]:
        return render.bundle(self.selected, self.blocks, self.spec)

    def write_bundle(self, path: str, parts: int | None = None, overwrite: bool = False) -> dict:
        """Writes the bundle as ordered parts to a shared folder, by the tasks that render it; gives its manifest (see ``sources.bundle``)."""
        return write_parts(render.pieces(self.selected, self.blocks, self.spec), path, parts, overwrite)

    def totals(self) -> DataFrame:
        return summary.totals(self.sized)

    def extensions(self) -> DataFrame:
        return summary.extensions_found(self.selected).orderBy("ext")

    def top_files(self, n: int = summary.TOP) -> DataFrame:
        return summary.top_files(self.sizes, n)
