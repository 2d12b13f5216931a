"""Corpora: rows of rel, root_rel, root_ord, ext_ord, ord, length and content."""

from __future__ import annotations

import json
import operator
import os
import re
import stat
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains,
    StringEndsWith, StringStartsWith,
)

from textquarry.operators.filters import extension_rank, extension_regex
from textquarry.plans.spec import QuerySpec

#: Paths that rows of a table stand for, so that path rules have something to decide.
VIRTUAL_EXTENSIONS = ("ts", "tsx", "js", "jsx", "py", "md", "d.ts", "test.ts", "min.js", "JSON", "log", "bin")
VIRTUAL_FOLDERS = ("src", "src/components", "docs", "node_modules/pkg", "dist", ".hidden", "packages/app/test", "tmp", "__tests__", "examples")


def virtual_path(doc_id: Column) -> Column:
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), (i % len(values)).cast("int"))
    return F.concat(pick(VIRTUAL_FOLDERS, F.floor(doc_id / len(VIRTUAL_EXTENSIONS))), F.lit("/doc_"), doc_id.cast("string"), F.lit("."), pick(VIRTUAL_EXTENSIONS, doc_id))


def table_corpus(rows: DataFrame, path: Column, content: Column, ord_: Column) -> DataFrame:
    """A table as a corpus of one root: ord_ is the output order."""
    return rows.select(path.alias("rel"), path.alias("root_rel"), F.lit(0).alias("root_ord"), ord_.alias("ord"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))


#: A session setting: into how many partitions a table of texts is dealt before it is searched. For small tables, whose single row group would be a single task; unset, rows stay where they are read.
SPREAD = "spark.textquarry.spread"


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The columns are known: no job reads a footer for them.
    rows = spark.read.schema("doc_id long, text string").parquet(f"{sf_dir}/documents.parquet")
    if spread := spark.conf.get(SPREAD, None):
        rows = rows.repartition(int(spread))
    return table_corpus(rows, virtual_path(F.col("doc_id")), F.col("text"), F.col("doc_id")).withColumnRenamed("ord", "doc_id").withColumn("ord", F.col("doc_id"))


class _Part(InputPartition):
    def __init__(self, folders: list[str], files: list[str]):
        self.folders, self.files = folders, files


class _Walk:
    """Options: path; keep, drop (regular expressions of paths within a root that a file must and must not match), prune (of folders that are not walked), roots (a JSON list of paths; a file counts if it
    passes for one of them), maxBytes (larger files come without content, unopened), folders (into how many the walk is parted at least)."""

    def __init__(self, options: dict):
        self.top = os.path.abspath(options["path"])
        self.roots = json.loads(options["roots"]) if options.get("roots") else [self.top]
        self.keep, self.drop, self.prune = (options.get(k) for k in ("keep", "drop", "prune"))
        self.max_bytes = int(options["maxbytes"]) if options.get("maxbytes") else None
        self.least = int(options.get("folders", "256"))
        self.filters: list[Filter] = []

    def _listed(self, folder: str, prune) -> tuple[list[str], list[str]]:
        """Folders and files of a folder. Hidden names are never searched; those with a leading underscore are. A link to a folder is not followed."""
        folders, files = [], []
        try:
            with os.scandir(folder) as found:
                for e in sorted(found, key=lambda e: e.name):
                    if e.name.startswith("."):
                        continue
                    if not e.is_dir(follow_symlinks=False):
                        files.append(e.path)
                    elif not (prune and all(prune.search(f"{r}/_") for r in self._within(e.path))) and self._reaches(e.path):
                        folders.append(e.path)
        except OSError:  # a folder that can't be read holds nothing
            pass
        return folders, files

    def _within(self, path: str) -> list[str]:
        """path as each root that holds it sees it."""
        return [path[len(r) :].lstrip("/") for r in self.roots if path.startswith(r.rstrip("/") + "/")]

    def _reaches(self, folder: str) -> bool:
        """Whether paths below a folder may begin as the filters ask."""
        begins = [f.value for f in self.filters if isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("path",)]
        return all(b.startswith(folder + "/") or (folder + "/").startswith(b) for b in begins)

    def _walked(self, folders: list[str]):
        prune, todo = self.prune and re.compile(self.prune), list(folders)
        while todo:
            more, files = self._listed(todo.pop(), prune)
            todo += more
            yield from files

    def _wanted(self, paths):
        """Those that the rules and the filters on paths keep."""
        keep, drop = (re.compile(x) if x else None for x in (self.keep, self.drop))
        for p in paths:
            if any((not keep or keep.search(r)) and not (drop and drop.search(r)) for r in self._within(p)) and self._passes("path", p):
                yield p

    def _passes(self, column: str, value) -> bool:
        return all(holds(f, value) for f in self.filters if _column(f) == column)

    def _row(self, p: str):
        """(path, length, content, error) of a file; None of what is none or has a length that the filters rule out. Only a file that is wanted is opened."""
        length = data = error = None
        try:
            found = os.stat(p)
            if not stat.S_ISREG(found.st_mode):
                return None
            length = found.st_size
            if (self.max_bytes is None or length <= self.max_bytes) and self._passes("length", length):
                with open(p, "rb") as f:
                    data = f.read()
                length = len(data)
        except OSError as e:
            error = str(e)
        return (p, length, data, error) if self._passes("length", length) else None


#: Filters that a file's path or length is held against before it is opened.
_COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: operator.contains}


def _column(f: Filter) -> str:
    f = f.child if isinstance(f, Not) else f
    return f.attribute[0]


def holds(f: Filter, value) -> bool | None:
    """What SQL says of a filter on a value; None where that is null."""
    if isinstance(f, Not):
        found = holds(f.child, value)
        return None if found is None else not found
    if isinstance(f, (IsNull, IsNotNull)):
        return (value is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, In):
        return True if value in f.value else None if None in f.value else False
    return None if f.value is None else _COMPARED[type(f)](value, f.value)


def _known(f: Filter) -> bool:
    if isinstance(f, Not):
        return not isinstance(f.child, Not) and _known(f.child)
    return isinstance(f, (*_COMPARED, In, IsNull, IsNotNull, EqualNullSafe)) and f.attribute in (("path",), ("length",))


class _FolderReader(_Walk, DataSourceReader):
    def partitions(self):
        """The walk goes on in the tasks: here only until there are enough folders."""
        prune = self.prune and re.compile(self.prune)
        folders, files = [self.top], []
        while folders and len(folders) < self.least:
            below, more = [], []
            for f in folders:
                names, own = self._listed(f, prune)
                below += names
                more += own
            files += more
            folders = below
        return [_Part([f], []) for f in folders] + [_Part([], files[i : i + 256]) for i in range(0, len(files), 256)] or [_Part([], [])]

    def read(self, partition):
        return filter(None, map(self._row, self._wanted((*partition.files, *self._walked(partition.folders)))))


class _FilteringReader(_FolderReader):
    def pushFilters(self, filters):
        """Filters on path and length are settled here, before a file is opened; one on the beginning of paths also says which folders are walked."""
        self.filters = [f for f in filters if _known(f)]
        return [f for f in filters if not _known(f)]


class _Arrived(InputPartition):
    def __init__(self, files: list[str], end: tuple[int, str]):
        self.files, self.end = files, end


class _FolderStream(_Walk, DataSourceStreamReader):
    """Files in the order of their change times (of the inode: writing, renaming and moving into place set it), then paths; that of the last file is the offset.

    A file that changes comes again, whole. Files younger than settle seconds wait for a later batch, as others of the same
    instant may still arrive. The driver lists the folder for each batch; files are read in the tasks.
    """

    #: Files, and bytes by the listing, of a task.
    FILES, BYTES = 256, 64 << 20

    def __init__(self, options: dict):
        super().__init__(options)
        self.settle = int(float(options.get("settle", "1")) * 1e9)
        self.listed: tuple[tuple[int, str], list[tuple[int, str, int]]] | None = None

    def _files(self) -> list[tuple[int, str, int]]:
        """(change time, path, length) of all files, in order."""
        out = []
        for p in self._wanted(self._walked([self.top])):
            try:
                found = os.stat(p)
            except OSError:  # gone since
                continue
            if stat.S_ISREG(found.st_mode):
                out.append((found.st_ctime_ns, p, found.st_size))
        return sorted(out)

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - self.settle
        files = [f for f in self._files() if f[0] <= until]
        if not files:
            return self.initialOffset()
        self.listed = (files[-1][:2], files)
        return {"changed": files[-1][0], "path": files[-1][1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = ((o["changed"], o["path"]) for o in (start, end))
        files = self.listed[1] if self.listed and self.listed[0] == last else self._files()
        parts, held, size = [], [], 0
        for f in files:
            if first < f[:2] <= last:
                if held and (len(held) >= self.FILES or size + f[2] > self.BYTES):
                    parts.append(_Arrived(held, last))
                    held, size = [], 0
                held.append(f[1])
                size += f[2]
        return [*parts, _Arrived(held, last)] if held or not parts else parts

    def read(self, partition):
        for p in partition.files:
            try:
                # What has changed since comes again in a later batch, and only there.
                if (os.stat(p).st_ctime_ns, p) > partition.end:
                    continue
            except OSError:
                continue
            if row := self._row(p):
                yield row

    def commit(self, end: dict) -> None:
        self.listed = None


class FolderSource(DataSource):
    """Files under a folder that driver and executors share: path string, length long, content binary, error string (why a file could not be read). Unlike Spark's listing it keeps names with a leading underscore.

    Also a stream. With the option pushdown=true, which takes spark.sql.python.filterPushdown.enabled, filters on path and length
    decide before files are opened. Spark (4.1) keeps the filters of a loaded DataFrame's last scan: a later query of it without
    any that go down would get them, too (``path IS NOT NULL`` is enough of one), and a plan that has it twice with different
    filters is answered by one of them. So it is off unless asked for.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, length long, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return (_FilteringReader if self.options.get("pushdown") == "true" else _FolderReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _FolderStream(self.options)


def utf8(content: Column) -> Column:
    """Bytes as text; what is no UTF-8 becomes U+FFFD."""
    return F.call_function("make_valid_utf8", content.cast("string"))


def is_remote(root: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", root) is not None


def tops(roots: list[str], prune: str | None = None, hidden: tuple[str, ...] = (".",)) -> list[str]:
    """The roots to walk: one that lies in another is met there, unless a pruned folder or one with a hidden beginning is on the way."""

    def met(inner: str, outer: str) -> bool:
        if not inner.startswith(outer.rstrip("/") + "/"):
            return False
        names = inner[len(outer) :].strip("/").split("/")
        return not any(n.startswith(hidden) for n in names) and not (prune and any(re.search(prune, "/".join(names[: i + 1]) + "/_") for i in range(len(names))))

    return [r for i, r in enumerate(roots) if r not in roots[:i] and not any(met(r, o) for o in roots if o != r)]


def first_root(path: Column, roots: list[str], spec: QuerySpec) -> Column:
    """struct<root_ord, ext_ord, root_rel> of the first of roots that shows a file at path, null if none does. The path within the root decides."""
    found = []
    for i, root in enumerate(dict.fromkeys(roots)):
        base = root.rstrip("/") + "/"
        within = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1_000_000))
        rank = extension_rank(within, spec.extensions)
        shown = rank.isNotNull() & ~within.rlike(spec.ignore_regex)
        found.append(F.when(shown, F.struct(F.lit(i).alias("root_ord"), rank.alias("ext_ord"), within.alias("root_rel"))))
    return F.coalesce(*found)


def root_paths(spec: QuerySpec, cwd: str) -> list[str]:
    """The roots of spec as paths begin with them; Spark writes a scheme without a host with one slash."""
    return [re.sub(r"^([^:/]+):///+", r"\1:/", r).rstrip("/") if is_remote(r) else os.path.abspath(os.path.join(cwd, r)) for r in spec.roots]


def located(files: DataFrame, roots: list[str], spec: QuerySpec, cwd: str) -> DataFrame:
    """files (by path) that a root of spec shows, with root_ord, ext_ord and root_rel of the first that does, and rel, the path as seen from cwd."""
    found = files.withColumn("_found", first_root(F.col("path"), roots, spec)).where("_found IS NOT NULL").select(*files.columns, "_found.*")
    # Paths as seen from the working folder, also where that lies beside or below the root.
    below = F.when(F.startswith("path", F.lit(cwd.rstrip("/") + "/")), F.substring("path", len(cwd.rstrip("/")) + 2, 1_000_000))
    seen = F.array(*(F.lit(r + "/" if is_remote(r) else os.path.relpath(r, cwd) + "/") for r in dict.fromkeys(roots)))
    return found.withColumn("rel", F.coalesce(below, F.concat(F.get(seen, F.col("root_ord")), "root_rel")))


def _folder_options(spec: QuerySpec, roots: list[str], top: str) -> dict[str, str]:
    inside = [r for r in dict.fromkeys(roots) if (r + "/").startswith(top.rstrip("/") + "/")]
    options = {"keep": extension_regex(spec.extensions), "drop": spec.ignore_regex, "prune": spec.prune_regex, "roots": json.dumps(inside)}
    # Larger files stay candidates, without content.
    return options | ({"maxBytes": str(spec.max_bytes)} if spec.strings or spec.exclude_strings else {})


def _corpus(parts: list[DataFrame], roots: list[str], spec: QuerySpec, cwd: str) -> DataFrame:
    corpus = parts[0]
    for p in parts[1:]:
        corpus = corpus.unionByName(p)
    return located(corpus, roots, spec, cwd).select("path", "rel", "root_rel", "root_ord", "ext_ord", F.struct("root_ord", "ext_ord", "path").alias("ord"), "length", utf8(F.col("content")).alias("content"), "error")


def files_corpus(spark: SparkSession, spec: QuerySpec, cwd: str | None = None, underscored: bool = True, pushdown: bool = False) -> DataFrame:
    """Files under all roots of spec, each once, with their output order: by root, then by extension as asked, then by path.

    underscored: read by FolderSource; else, and for roots with a scheme, by Spark's own listing (any store, but without names
    that start with an underscore). Extensions, exclusions and the size guard go down to either reader: what they rule out is
    not opened. Which root has a file follows from its path alone, so overlapping roots cost no shuffle.
    pushdown: later filters on path and length go down to FolderSource as well, by spark.sql.python.filterPushdown.enabled, which
    this sets in the session. For corpora that no plan has twice (see FolderSource).
    """
    cwd = os.path.abspath(cwd or os.getcwd())
    roots = root_paths(spec, cwd)
    guarded = bool(spec.strings or spec.exclude_strings)
    parts = []
    for top in tops(roots, spec.prune_regex):
        if underscored and not is_remote(top):
            spark.dataSource.register(FolderSource)
            options = _folder_options(spec, roots, top)
            if pushdown:
                spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
                options["pushdown"] = "true"
            df = spark.read.format("folder").options(**options).load(top).where("path IS NOT NULL")
        else:
            names = "*.{" + ",".join(spec.extensions) + "}" if len(spec.extensions) > 1 else f"*.{spec.extensions[0]}"
            df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(top)
            df = df.where(F.col("length") <= spec.max_bytes) if guarded else df
            path = F.col("path") if is_remote(top) else F.regexp_replace("path", "^file:/+", "/")
            df = df.select(path.alias("path"), "length", "content", F.lit(None).cast("string").alias("error"))
            hidden = F.substring("path", len(top.rstrip("/")) + 1, 1_000_000).rlike(r"/\.[^/]")
            df = df.where(~hidden)
        parts.append(df)
    return _corpus(parts, roots, spec, cwd)


def files_stream(spark: SparkSession, spec: QuerySpec, cwd: str | None = None, settle: float = 1.0) -> DataFrame:
    """The same as a stream of files that are new or have changed. Roots are folders that driver and executors share."""
    cwd = os.path.abspath(cwd or os.getcwd())
    roots = root_paths(spec, cwd)
    if any(map(is_remote, roots)):
        raise ValueError("a stream's roots are folders without a scheme")
    spark.dataSource.register(FolderSource)
    parts = [spark.readStream.format("folder").options(settle=str(settle), **_folder_options(spec, roots, top)).load(top) for top in tops(roots, spec.prune_regex)]
    return _corpus(parts, roots, spec, cwd)
