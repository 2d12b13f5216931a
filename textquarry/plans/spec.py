"""What a search asks for, settled before any data is read."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from textquarry.functions.patterns import any_literal
from textquarry.plans import globs

#: Extensions of a search that names none, in output order.
DEFAULT_EXTENSIONS = (
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "rb", "go", "java", "cpp", "c", "h", "rs", "swift", "kt", "scala", "php", "vue", "svelte", "astro",
    "css", "scss", "less", "json", "yaml", "yml", "toml", "xml", "md", "mdx", "txt", "sh", "bash", "zsh", "fish", "sql", "graphql", "gql",
)
MAX_BYTES = 10 * 1024 * 1024


class NoCandidates(Exception):
    """No file has one of the extensions."""

    exit_code = 2


class NoMatches(Exception):
    """No candidate passes the filters."""

    exit_code = 3


def split_csv(value: str | None) -> list[str]:
    return [x for part in (value or "").split(",") if (x := part.strip("﻿ \t\n\r\v\f\xa0"))]


def as_tuple(value) -> tuple[str, ...]:
    """What a setting may be given as, a single value, several or none, as a tuple."""
    if value is None or value == "":
        return ()
    return (value,) if isinstance(value, str) else tuple(value)


def extension_list(values) -> tuple[str, ...]:
    """Lower case, without leading dot, each once, in order."""
    return tuple(dict.fromkeys(v.lower().removeprefix(".") for v in values if v))


@dataclass(frozen=True)
class QuerySpec:
    """Each list may be given as a single value, too. strings: any of them must occur; exclude_strings: none may. extensions: () means the defaults. exclude: globs taken out while scanning.
    include, ignore: globs on paths, bare names expanded. lines: context around matches; 0 or None packs whole files."""

    strings: tuple[str, ...] = ()
    exclude_strings: tuple[str, ...] = ()
    extensions: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    lines: int | None = None
    case_sensitive: bool = False
    style: str = "xml"
    max_bytes: int = MAX_BYTES
    roots: tuple[str, ...] = field(default=(".",))

    def __post_init__(self):
        if self.lines is not None and (isinstance(self.lines, bool) or not isinstance(self.lines, int) or self.lines < 0):
            raise ValueError(f"lines must be a whole number from 0 on: {self.lines!r}")
        for name in ("strings", "exclude_strings", "extensions", "exclude", "include", "ignore", "roots"):
            object.__setattr__(self, name, as_tuple(getattr(self, name)))
        object.__setattr__(self, "roots", self.roots or (".",))
        object.__setattr__(self, "strings", tuple(s for s in self.strings if s))
        object.__setattr__(self, "exclude_strings", tuple(s for s in self.exclude_strings if s))
        object.__setattr__(self, "extensions", extension_list(self.extensions) or DEFAULT_EXTENSIONS)

    def where(self, **changes) -> QuerySpec:
        return replace(self, **changes)

    @property
    def pattern(self) -> str | None:
        return any_literal(self.strings, self.case_sensitive)

    @property
    def exclude_pattern(self) -> str | None:
        return any_literal(self.exclude_strings, self.case_sensitive)

    @property
    def context(self) -> int:
        """Lines of context; without strings there is nothing to put in context."""
        return (self.lines or 0) if self.strings else 0

    @property
    def ignore_regex(self) -> str:
        """What scanning leaves out; a leading ! has no meaning here."""
        return globs.union_regex(self._ignored)

    @property
    def prune_regex(self) -> str:
        """The ignored patterns that mean whole folders: a folder that one of them matches with a name in it need not be walked."""
        return globs.union_regex([p for p in self._ignored if p.endswith("/**")])

    @property
    def _ignored(self) -> list[str]:
        return [*globs.BUILTIN_IGNORES, *("[!]" + p[1:] if p.startswith("!") else p for p in self.exclude)]

    def check(self) -> QuerySpec:
        """Compiles all patterns, so that one that can't be read is refused at once, with a ValueError."""
        _ = self.pattern, self.exclude_pattern, self.ignore_regex, self.include_globs, self.ignore_globs
        return self

    @property
    def include_globs(self) -> list[globs.Glob]:
        return [globs.compile_glob(x, dot=True, case_sensitive=self.case_sensitive) for p in self.include for x in globs.expand(p)]

    @property
    def ignore_globs(self) -> list[globs.Glob]:
        return [globs.compile_glob(x, dot=True, case_sensitive=self.case_sensitive) for p in self.ignore for x in globs.expand(p)]
