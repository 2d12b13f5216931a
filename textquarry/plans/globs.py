"""Path globs to regular expressions that Java and RE2 read alike.

``**`` as a whole segment stands for any number of segments, ``*`` for any part
of one, ``?`` for one character, ``[...]`` for a class, ``{a,b}`` for either and
``{1..3}`` or ``{a..c}`` for each of a range (a third number is its step). A
leading ``!`` negates, a leading ``#`` matches nothing. Extended globs are refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.patterns import alike, literal

#: What every scan leaves out.
BUILTIN_IGNORES = ("**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/.next/**", "**/coverage/**", "**/.cache/**", "**/tmp/**", "**/temp/**", "**/*.log", "**/.DS_Store", "**/Thumbs.db")

#: Named classes within brackets.
NAMED = {
    "alnum": r"\p{L}\p{Nl}\p{Nd}", "alpha": r"\p{L}\p{Nl}", "digit": r"\p{Nd}", "lower": r"\p{Ll}", "upper": r"\p{Lu}", "punct": r"\p{P}",
    "space": r"\p{Z}\t\r\n\x0B\f", "word": r"\p{L}\p{Nl}\p{Nd}\p{Pc}", "xdigit": "A-Fa-f0-9",
}


@dataclass(frozen=True)
class Glob:
    """regex matches whole paths; negated: the paths it does not match are meant."""

    regex: str
    negated: bool = False

    def matches(self, path: Column) -> Column:
        hit = path.rlike(self.regex)
        return ~hit if self.negated else hit


def has_glob(pattern: str) -> bool:
    return bool(re.search(r"[*?\[\]{}!]", pattern))


def expand(pattern: str) -> list[str]:
    """A bare name stands for itself at the top and anywhere, as a file and as a folder; leading dots and slashes go."""
    if has_glob(pattern):
        return [pattern]
    name = re.sub(r"^[./]+", "", pattern)
    return list(dict.fromkeys([name, f"**/{name}", f"{name}/**", f"**/{name}/**"]))


def from_exclusion(value: str) -> str:
    """An excluded extension becomes a glob for it; what looks like a path or glob stays."""
    return value if "/" in value or "*" in value else f"**/*.{re.sub(r'^[.]', '', value)}"


def _braces(pattern: str) -> list[str]:
    """The patterns that {a,b} stands for."""
    depth, start, cuts = 0, -1, []
    for i, ch in enumerate(pattern):
        if ch == "{":
            depth += 1
            if depth == 1:
                start, cuts = i, [i]
        elif ch == "," and depth == 1:
            cuts.append(i)
        elif ch == "}" and depth:
            depth -= 1
            if depth == 0 and len(cuts) > 1:
                parts = [pattern[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], i], strict=True)]
                return [x for p in parts for x in _braces(pattern[:start] + p + pattern[i + 1 :])]
            if depth == 0 and (each := _range(pattern[start + 1 : i])):
                return [x for p in each for x in _braces(pattern[:start] + p + pattern[i + 1 :])]
    return [pattern]


def _range(text: str) -> list[str]:
    """1..3 or a..c, with a step or without, spelt out; nothing if text is no range. Numbers are as wide as the widest that starts with 0."""
    m = re.fullmatch(r"(?:(-?\d+)\.\.(-?\d+)|([A-Za-z])\.\.([A-Za-z]))(?:\.\.(-?\d+))?", text)
    if not m:
        return []
    ends = [m[1], m[2]] if m[1] else [m[3], m[4]]
    a, b = (int(x) if m[1] else ord(x) for x in ends)
    values = range(a, b + (1 if a <= b else -1), max(1, abs(int(m[5] or 1))) * (1 if a <= b else -1))
    if not m[1]:
        return [chr(v) for v in values]
    width = max(map(len, ends)) if any(re.match(r"-?0\d", x) for x in ends) else 0
    return [str(v).zfill(width) for v in values]


def _class(body: str, case_sensitive: bool) -> str:
    """A class's body for a regular expression. Without case, every unit that any of its units is alike to belongs to it."""
    out, i = "", 0
    while i < len(body):
        name = re.match(r"\[:(\w+):\]", body[i:])
        if name and name[1] in NAMED:
            out += NAMED[name[1]]
            i += name.end()
            continue
        last = i + 2 if body[i + 1 : i + 2] == "-" and i + 2 < len(body) else i
        first, end = ord(body[i]), ord(body[last])
        if first > end:
            raise ValueError(f"range out of order in class [{body}]")
        out += _unit(first) + (f"-{_unit(end)}" if end > first else "")
        if not case_sensitive:
            out += "".join(_unit(ord(c)) for c in sorted({c for code in range(first, end + 1) for c in alike(chr(code))}) if not first <= ord(c) <= end)
        i = last + 1
    return out


def _unit(code: int) -> str:
    return "\\" + chr(code) if chr(code) in "\\[]^-&~" else chr(code)


def _segment(seg: str, dot: bool, case_sensitive: bool) -> str:
    out, i = [], 0
    while i < len(seg):
        ch = seg[i]
        if ch == "*":
            while i + 1 < len(seg) and seg[i + 1] == "*":
                i += 1
            # A star that is the whole segment stands for at least one character.
            out.append("[^/]+" if len(seg.strip("*")) == 0 else "[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and (m := re.match(r"\[([!^]?)((?:\[:\w+:\]|[^\]])(?:\[:\w+:\]|[^\]])*|\](?:\[:\w+:\]|[^\]])*)\]", seg[i:])):
            out.append("[" + ("^/" if m[1] else "") + _class(m[2], case_sensitive) + "]")
            i += m.end() - 1
        else:
            out.append(literal(ch, case_sensitive))
        i += 1
    body = "".join(out)
    if not dot and seg[:1] in "*?[":
        # Names that start with a dot are hidden from leading wildcards.
        first = {"*": "[^./]", "?": "[^./]"}.get(seg[0])
        if first and seg[0] == "*":
            rest = body[len("[^/]*") :] if body.startswith("[^/]*") else ""
            # The star may also stand for nothing if something else follows it.
            body = f"(?:{first}[^/]*{rest}" + (f"|{rest}" if rest and not rest.startswith("\\.") else "") + ")"
        elif first:
            body = first + body[len("[^/]") :]
    return body


def compile_glob(pattern: str, dot: bool = False, case_sensitive: bool = True) -> Glob:
    """dot: whether wildcards match names that start with a dot."""
    if pattern.startswith("#"):
        return Glob(r"^[^\s\S]$")
    if re.search(r"[?*+@!]\(", pattern):
        raise ValueError(f"extended globs are not supported: {pattern}")
    negated = False
    while pattern.startswith("!"):
        negated, pattern = not negated, pattern[1:]
    any_name = r"(?:[^./][^/]*|\.[^./][^/]*|\.\.[^/]+)" if dot else r"[^./][^/]*"
    options = []
    for one in _braces(pattern):
        segments = one.split("/")
        out = ""
        for i, seg in enumerate(segments):
            last = i == len(segments) - 1
            if seg == "**":
                out += f"(?:{any_name}(?:/{any_name})*)" if last else f"(?:{any_name}/)*"
            else:
                out += _segment(seg, dot, case_sensitive) + ("" if last else "/")
        options.append(out)
    return Glob("^(?:" + "|".join(options) + ")$", negated)


def any_match(path: Column, globs: list[Glob]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | g.matches(path)
    return out


def union_regex(patterns: list[str] | tuple[str, ...], dot: bool = False, case_sensitive: bool = True) -> str:
    """One pattern for globs that aren't negated."""
    return "|".join(compile_glob(p, dot, case_sensitive).regex for p in patterns)


def extension_glob(ext: str) -> str:
    return f"**/*.{ext.lstrip('.')}"
