"""Named queries over the standard tables, each with its SQL beside it.

``documents`` stands for a folder of files (see ``sources.corpus``). The SQL of
scans and content filters is written by hand, without the pattern compiler, so
that a wrong glob or fold shows; that of lines, windows and rendering goes by the
compiled patterns, which those queries don't test.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.patterns import any_literal
from textquarry.functions.text import csv_values, extension, fence_language, grouped_digits, has_glob, pad_start, token_estimate, utf16_length, without_leading_dots
from textquarry.operators import filters, render
from textquarry.operators.line_windows import context_lines, line_positions, line_windows
from textquarry.operators.ordinals import with_ordinal
from textquarry.operators.windows import context_windows, hits, match_positions, positions, split_lines, windows_by_rows, with_windows
from textquarry.plans import globs
from textquarry.plans.config import config_rows, parse_config
from textquarry.plans.spec import QuerySpec
from textquarry.search import Search
from textquarry.sources.corpus import VIRTUAL_EXTENSIONS, VIRTUAL_FOLDERS, documents_corpus, first_root, located, utf8
from textquarry.sources.lines import Lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Terms that the tables hold; their order decides what is matched where two start at one place.
TERMS = ("that with", "with", "Éa", "from", "license")
ALL = QuerySpec(extensions=VIRTUAL_EXTENSIONS)
SEARCH = ALL.where(strings=TERMS)
CONFIG = "[search]\n# terms\nlicense\ntoken\n\n[extensions]\nts\nmd\npy\n\n[exclude]\n**/docs/**\n"


def q(text: str) -> str:
    """An SQL string."""
    return "'" + text.replace("'", "''") + "'"


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def _list(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


_REL = f"{_list(VIRTUAL_FOLDERS)}[1 + (doc_id // {len(VIRTUAL_EXTENSIONS)}) % {len(VIRTUAL_FOLDERS)}] || '/doc_' || doc_id || '.' || {_list(VIRTUAL_EXTENSIONS)}[1 + doc_id % {len(VIRTUAL_EXTENSIONS)}]"
CORPUS = f"corpus AS (SELECT doc_id, text AS content, strlen(text) AS length, {_REL} AS rel FROM documents)"


def _re(column: str, regex: str) -> str:
    return f"regexp_matches({column}, {q(regex)})"


def _scan(spec: QuerySpec) -> str:
    return f"{_re('rel', filters.extension_regex(spec.extensions))} AND NOT {_re('rel', spec.ignore_regex)}"


def _any(gs: list[globs.Glob]) -> str:
    return "(" + " OR ".join(("NOT " if g.negated else "") + _re("rel", g.regex) for g in gs) + ")"


def _selected(spec: QuerySpec) -> str:
    """WITH parts: corpus and selected."""
    where = [_scan(spec)]
    if spec.include:
        where.append(_any(spec.include_globs))
    if spec.ignore:
        where.append("NOT " + _any(spec.ignore_globs))
    if spec.strings or spec.exclude_strings:
        where.append(f"length <= {spec.max_bytes}")
    if spec.exclude_strings:
        where.append("NOT " + _re("content", spec.exclude_pattern))
    if spec.strings:
        where.append(_re("content", spec.pattern))
    return f"{CORPUS}, selected AS (SELECT * FROM corpus WHERE {' AND '.join(where)})"


def _search(name: str, spec: QuerySpec, where: str) -> None:
    """A query of the files that spec selects. where: the same in SQL, by hand, over rel, content and length."""
    query(name, f"WITH {CORPUS} SELECT doc_id, rel FROM corpus WHERE {where}")(lambda spark, d: filters.select_files(documents_corpus(spark, d), spec).select("doc_id", "rel"))


#: By hand: what every scan leaves out, of the folders and names that the corpus has or might have; hidden folders and names.
_SHOWN = (
    "NOT list_has_any(string_split(rel, '/')[:-2], ['node_modules', 'dist', 'build', 'coverage', 'tmp', 'temp']) AND NOT contains('/' || rel, '/.') AND NOT (ends_with(rel, '.log') AND length(string_split(rel, '/')[-1]) > 4)"
)


def _ends(*extensions: str) -> str:
    """By hand: a name, not only a dot, before one of the extensions, which are compared as they stand."""
    return "(" + " OR ".join(f"(ends_with(rel, '.{e}') AND length(string_split(rel, '/')[-1]) > {len(e) + 1})" for e in extensions) + ")"


_VIRTUAL = f"{_SHOWN} AND {_ends('ts', 'tsx', 'js', 'jsx', 'py', 'md', 'log', 'bin')}"

# Scans and path filters. Names end in .JSON too, which no extension of lower case is.
_search("scan_extension_filter", ALL.where(extensions=("ts", "TSX", ".md")), f"{_SHOWN} AND {_ends('ts', 'tsx', 'md')}")
_search("scan_default_extensions", QuerySpec(), f"{_SHOWN} AND {_ends('ts', 'tsx', 'js', 'jsx', 'py', 'md')}")
_search("scan_builtin_ignores", ALL, _VIRTUAL)
_search("scan_user_excludes", ALL.where(exclude=("docs/**", globs.from_exclusion("test.ts"), "!src/**")), f"{_VIRTUAL} AND NOT starts_with(rel, 'docs/') AND NOT ends_with(rel, '.test.ts')")
_search("include_globs", ALL.where(include=("src", "**/*.PY")), f"{_VIRTUAL} AND (list_contains(string_split(lower(rel), '/'), 'src') OR ends_with(lower(rel), '.py'))")
_search("ignore_globs", ALL.where(ignore=("examples", "*.{ts,tsx}")), f"{_VIRTUAL} AND NOT list_contains(string_split(lower(rel), '/'), 'examples')")
_search(
    "include_and_ignore", ALL.where(include=("src/**", "docs/doc_?[0-4].*"), ignore=("components",)),
    f"{_VIRTUAL} AND (starts_with(rel, 'src/') OR (starts_with(rel, 'docs/doc_') AND length(string_split(rel[10:], '.')[1]) = 2 AND rel[11:11] BETWEEN '0' AND '4')) AND NOT list_contains(string_split(rel, '/'), 'components')",
)
_search("path_case_sensitive", ALL.where(include=("**/*.MD", "src/**"), case_sensitive=True), f"{_VIRTUAL} AND starts_with(rel, 'src/')")
_search("glob_classes_and_ranges", ALL.where(include=("[D-S]*/DOC_{1..3}?.{TS,m[a-e]}",)), f"{_VIRTUAL} AND rel[1:1] BETWEEN 'd' AND 's' AND len(string_split(rel, '/')) = 2 AND length(string_split(rel, '/')[2]) = 9 AND string_split(rel, '/')[2][5:5] IN ('1', '2', '3') AND rel[-3:] IN ('.ts', '.md')")
_search("select_all_mode", ALL, _VIRTUAL)

_RANKED = ALL.where(extensions=("md", "TSX", ".ts", "ts", "py", "MD"))


@query(
    "output_order",
    f"WITH {CORPUS} SELECT doc_id, rel, (CASE WHEN {_ends('md')} THEN 0 WHEN {_ends('tsx')} THEN 1 WHEN {_ends('ts')} THEN 2 ELSE 3 END)::INT AS ext_ord FROM corpus WHERE {_SHOWN} AND {_ends('md', 'tsx', 'ts', 'py')}",
)
def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions are normalised, each counts once, and files go in their order; within one, by path."""
    found = filters.scan_filter(documents_corpus(spark, sf_dir), _RANKED)
    return found.select("doc_id", "rel", filters.extension_rank(F.col("rel"), _RANKED.extensions).alias("ext_ord"))


_ROOTS = ("src", "src/components", "packages")


@query(
    "scan_multi_root_distinct",
    f"WITH {CORPUS} SELECT doc_id, rel, min(root_ord)::INT AS root_ord FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, rel, {i} AS root_ord FROM corpus WHERE starts_with(rel, '{r}/') AND {_VIRTUAL}" for i, r in enumerate(_ROOTS))
    + ") GROUP BY doc_id, rel",
)
def scan_multi_root_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots overlap; the first that shows a file counts."""
    corpus = documents_corpus(spark, sf_dir)
    return corpus.withColumn("_r", first_root(F.concat(F.lit("/"), "rel"), [f"/{r}" for r in _ROOTS], ALL)).where("_r IS NOT NULL").select("doc_id", "rel", "_r.root_ord")


# Content filters. By hand: ASCII letters fold as lower() does, and é and É are one.
_lower = "contains(lower(content), {0})".format
_any_term = " OR ".join(_lower(q(t.lower())) for t in TERMS)
_search("size_guard", SEARCH.where(max_bytes=1500), f"{_VIRTUAL} AND length <= 1500 AND ({_any_term})")
_search("contains_any_ci", ALL.where(strings=("LICENSE", "thé", "token")), f"{_VIRTUAL} AND ({_lower(q('license'))} OR {_lower(q('thé'))} OR {_lower(q('token'))})")
_search("contains_any_cs", ALL.where(strings=("license", "Éa"), case_sensitive=True), f"{_VIRTUAL} AND (contains(content, 'license') OR contains(content, 'Éa'))")
_search("contains_one_cs", ALL.where(strings="license", case_sensitive=True), f"{_VIRTUAL} AND contains(content, 'license')")
_search("contains_repeated_terms", ALL.where(strings=("token", "", "token", "TOKEN"), exclude_strings=("", "zzz", "zzz")), f"{_VIRTUAL} AND {_lower(q('token'))}")
_search("contains_special_chars", ALL.where(strings=("nd.", "|", "@", "$$")), f"{_VIRTUAL} AND ({_lower(q('nd.'))} OR contains(content, '|') OR contains(content, '@') OR contains(content, '$$'))")
_search("exclude_strings", SEARCH.where(exclude_strings=("license", "###")), f"{_VIRTUAL} AND ({_any_term}) AND NOT {_lower(q('license'))} AND NOT contains(content, '###')")
_search("exclude_only_mode", ALL.where(exclude_strings=("the", "una")), f"{_VIRTUAL} AND NOT {_lower(q('the'))} AND NOT {_lower(q('una'))}")

_SETTINGS = parse_config(CONFIG)
_search("config_driven_search", QuerySpec(strings=(*_SETTINGS["search"], "Éa"), extensions=(*_SETTINGS["extensions"], "tsx"), exclude=tuple(_SETTINGS["exclude"])), f"{_SHOWN} AND {_ends('ts', 'md', 'py', 'tsx')} AND NOT starts_with(rel, 'docs/') AND ({_lower(q('license'))} OR {_lower(q('token'))} OR {_lower(q('éa'))})")

# Lines and matches.
_SELECT = _selected(SEARCH)
_P = q(SEARCH.pattern)
_LINES = "lines AS (SELECT doc_id, rel, unnest(l) AS line, generate_subscripts(l, 1) AS ln, len(l) AS n_lines FROM (SELECT doc_id, rel, string_split(content, chr(10)) AS l FROM selected))"
_U16 = r"(length({0}) + len(regexp_extract_all({0}, '[\x{{10000}}-\x{{10FFFF}}]')))"


@query("line_split_numbered", f"WITH {_SELECT}, {_LINES} SELECT doc_id, ln::INT AS line, line AS text FROM lines")
def line_split_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = filters.select_files(documents_corpus(spark, sf_dir), SEARCH)
    return files.select("doc_id", F.posexplode(split_lines(F.col("content"))).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("line"), "text")


def _positions_sql(with_parts: str, pattern: str) -> str:
    u = _U16.format("z")
    return f"""WITH {with_parts}, {_LINES},
hit AS (SELECT doc_id, ln, string_split_regex(line, {pattern}) AS g, regexp_extract_all(line, {pattern}) AS h FROM lines WHERE regexp_matches(line, {pattern})),
each AS (SELECT doc_id, ln, g, h, unnest(h) AS m, generate_subscripts(h, 1) AS i FROM hit)
SELECT doc_id, ln::INT AS line, m AS match,
       (list_sum(list_transform(g[1:i], lambda z: {u})) + coalesce(list_sum(list_transform(h[1:i - 1], lambda z: {u})), 0))::INT AS "column"
FROM each"""


def _positions(spark: SparkSession, sf_dir: str, spec: QuerySpec) -> DataFrame:
    return positions(filters.searched_lines(documents_corpus(spark, sf_dir), spec), spec.pattern, "doc_id")


@query("match_positions", _positions_sql(_SELECT, _P))
def match_positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir, SEARCH)


_ORDERED = ALL.where(strings=("th", "that", "the"))
query("alternation_order", _positions_sql(_selected(_ORDERED), q(_ORDERED.pattern)))(lambda spark, d: _positions(spark, d, _ORDERED))


@query("match_count_per_doc", f"WITH {_SELECT}, {_LINES} SELECT doc_id, sum(len(regexp_extract_all(line, {_P})))::BIGINT AS n_matches FROM lines GROUP BY doc_id HAVING n_matches > 0")
def match_count_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = filters.select_files(documents_corpus(spark, sf_dir), SEARCH)
    per_line = F.transform(split_lines(F.col("content")), lambda line: F.size(hits(line, SEARCH.pattern)))
    return files.select("doc_id", F.aggregate(per_line, F.lit(0).cast("long"), lambda acc, n: acc + n).alias("n_matches")).where("n_matches > 0")


_ACROSS = ALL.where(strings=(".\nThe ", ".\nÉ"))


@query(
    "multiline_literal_no_windows",
    f"WITH {_selected(_ACROSS)}, {_LINES}, c AS (SELECT doc_id, sum(CASE WHEN {_re('line', _ACROSS.pattern)} THEN 1 ELSE 0 END) AS n FROM lines GROUP BY doc_id) SELECT doc_id, n::BIGINT AS n_windows FROM c",
)
def multiline_literal_no_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = filters.select_files(documents_corpus(spark, sf_dir), _ACROSS)
    return files.select("doc_id", F.size(context_windows(F.col("content"), _ACROSS.pattern, 2, lines=False, matches=False)).cast("long").alias("n_windows"))


# Windows.
def _windows_sql(n: int, with_parts: str = _SELECT, pattern: str = _P) -> str:
    return f"""{with_parts}, {_LINES},
hit AS (SELECT doc_id, rel, ln, n_lines, len(regexp_extract_all(line, {pattern})) AS n FROM lines WHERE regexp_matches(line, {pattern})),
new AS (SELECT *, CASE WHEN ln - lag(ln) OVER (PARTITION BY doc_id ORDER BY ln) <= {2 * n + 1} THEN 0 ELSE 1 END AS fresh FROM hit),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ln) AS g FROM new),
windows AS (SELECT doc_id, rel, g, greatest(1, min(ln) - {n})::INT AS start_line, least(min(n_lines), max(ln) + {n})::INT AS end_line, sum(n)::BIGINT AS n_matches FROM island GROUP BY doc_id, rel, g)"""


def _windows(spark: SparkSession, sf_dir: str, n: int, *more: str, **fields: bool) -> DataFrame:
    files = with_windows(filters.searched_lines(documents_corpus(spark, sf_dir), SEARCH), SEARCH.pattern, n, **({"lines": False, "matches": False} | fields))
    return files.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.start_line", "w.end_line", "w.n_matches", *(f"w.{c}" for c in more))


@query(
    "window_bounds_raw",
    f"WITH {_SELECT}, {_LINES} SELECT doc_id, ln::INT AS line, greatest(1, ln - 2)::INT AS start_line, least(n_lines, ln + 2)::INT AS end_line FROM (SELECT *, unnest(regexp_extract_all(line, {_P})) FROM lines)",
)
def window_bounds_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = filters.select_files(documents_corpus(spark, sf_dir), SEARCH)
    n_lines = F.size(split_lines(F.col("content")))
    each = files.select("doc_id", n_lines.alias("n"), F.explode(match_positions(F.col("content"), SEARCH.pattern)).alias("m"))
    return each.select("doc_id", "m.line", F.greatest(F.lit(1), F.col("m.line") - 2).alias("start_line"), F.least("n", F.col("m.line") + 2).alias("end_line"))


for _name, _n in (("context_windows_merged", 2), ("context_windows_merged_n5", 5)):
    query(_name, f"WITH {_windows_sql(_n)} SELECT doc_id, start_line, end_line, n_matches FROM windows")(lambda spark, d, n=_n: _windows(spark, d, n))


@query("context_windows_by_rows", f"WITH {_windows_sql(2)} SELECT doc_id, start_line, end_line, n_matches FROM windows")
def context_windows_by_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows_by_rows(filters.searched_lines(documents_corpus(spark, sf_dir), SEARCH), "doc_id", SEARCH.pattern, 2)


def _one_file(spark: SparkSession, sf_dir: str) -> Lines:
    """All documents, one after the other, as the lines of a single file, a block each."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return Lines.of(rows.select(F.lit("all").alias("path"), F.col("doc_id").alias("block"), F.posexplode(split_lines(F.col("text"))).alias("i", "text")))


_ONE_FILE = "selected AS (SELECT 'all' AS doc_id, '' AS rel, string_agg(text, chr(10) ORDER BY doc_id) AS content FROM documents)"


@query("context_windows_by_blocks", f"WITH {_windows_sql(2, _ONE_FILE)} SELECT doc_id AS path, start_line, end_line, n_matches FROM windows")
def context_windows_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file without bound: its lines are never together in a task."""
    return line_windows(_one_file(spark, sf_dir), SEARCH.pattern, 2)


@query("match_positions_by_blocks", _positions_sql(_ONE_FILE, _P).replace("SELECT doc_id, ln::INT", "SELECT doc_id AS path, ln::INT"))
def match_positions_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_positions(_one_file(spark, sf_dir), SEARCH.pattern)


@query("context_lines_by_blocks", f"WITH {_windows_sql(2, _ONE_FILE)} SELECT w.doc_id AS path, l.ln AS line, l.line AS text, l.ln = w.start_line AS begins FROM windows w JOIN lines l ON l.ln BETWEEN w.start_line AND w.end_line")
def context_lines_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_lines(_one_file(spark, sf_dir), SEARCH.pattern, 2).drop("first")


@query("windows_per_doc", f"WITH {_windows_sql(2)} SELECT doc_id, count(*)::BIGINT AS n_windows FROM windows GROUP BY doc_id")
def windows_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = with_windows(filters.select_files(documents_corpus(spark, sf_dir), SEARCH), SEARCH.pattern, 2, lines=False, matches=False)
    return files.select("doc_id", F.size("windows").cast("long").alias("n_windows")).where("n_windows > 0")


_TEXTS = ", texts AS (SELECT w.doc_id, w.rel, w.start_line, w.end_line, w.n_matches, string_agg({0}, {1} ORDER BY l.ln) AS text FROM windows w JOIN lines l ON l.doc_id = w.doc_id AND l.ln BETWEEN w.start_line AND w.end_line GROUP BY ALL)"


@query("window_lines_text", f"WITH {_windows_sql(2)}{_TEXTS.format('l.line', 'chr(10)')} SELECT doc_id, start_line, text FROM texts")
def window_lines_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir, 2, "lines", lines=True).select("doc_id", "start_line", F.array_join("lines", "\n").alias("text"))


# Rendering.
_NUMBERED = f"repeat(' ', greatest(0, 6 - length(l.ln::VARCHAR))) || l.ln || {q(render.BAR)} || l.line || chr(10)"
_FORMATTED = f"WITH {_windows_sql(2)}{_TEXTS.format(_NUMBERED, q(''))}, files AS (SELECT doc_id, rel, count(*) AS n_windows, sum(n_matches)::BIGINT AS n_matches, string_agg(text, chr(10) || '  ...' || chr(10) ORDER BY start_line) AS body FROM texts GROUP BY doc_id, rel)"
_LANG = r"CASE WHEN regexp_extract(rel, '[^/]\.([^./]*)$', 1) = '' THEN 'txt' ELSE regexp_extract(rel, '[^/]\.([^./]*)$', 1) END"
_NL = "chr(10)"
_BLOCKS = {
    "render_xml_full": f"""WITH {_SELECT} SELECT doc_id, '<file path="' || rel || '">' || {_NL} || content || {_NL} || '</file>' || {_NL} || {_NL} AS block FROM selected""",
    "render_md_full": f"WITH {_SELECT} SELECT doc_id, '### ' || rel || {_NL} || {_NL} || '```' || {_LANG} || {_NL} || content || {_NL} || '```' || {_NL} || {_NL} AS block FROM selected",
    "render_xml_context": f"""{_FORMATTED} SELECT doc_id, '<file path="' || rel || '" matches="' || n_matches || '" windows="' || n_windows || '">' || {_NL} || body || '</file>' || {_NL} || {_NL} AS block FROM files""",
    "render_md_context": f"{_FORMATTED} SELECT doc_id, '### ' || rel || {_NL} || {_NL} || '**Matches:** ' || n_matches || ' | **Context windows:** ' || n_windows || {_NL} || {_NL} || '```' || {_LANG} || {_NL} || body || '```' || {_NL} || {_NL} AS block FROM files",
}
for _name, _sql in _BLOCKS.items():
    _spec = SEARCH.where(style="xml" if "xml" in _name else "markdown", lines=2 if "context" in _name else None)
    query(_name, _sql)(lambda spark, d, spec=_spec: Search(documents_corpus(spark, d), spec).blocks.select("doc_id", "block"))


@query("render_context_block", f"{_FORMATTED} SELECT doc_id, body AS block FROM files")
def render_context_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = with_windows(filters.select_files(documents_corpus(spark, sf_dir), SEARCH), SEARCH.pattern, 2, matches=False).where(F.size("windows") > 0)
    return files.select("doc_id", render.format_windows(F.col("windows")).alias("block"))


# Summary.
_CONTEXT = SEARCH.where(lines=2)
_SIZES = f"sizes AS (SELECT *, {_U16.format('block')}::BIGINT AS size FROM ({_BLOCKS['render_xml_context']}))"


@query("file_sizes_tokens", f"WITH {_SIZES} SELECT doc_id AS ord, size, (size + 2) // 4 AS tokens FROM sizes")
def file_sizes_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search(documents_corpus(spark, sf_dir), _CONTEXT).sizes.select("ord", "size", "tokens")


@query(
    "summary_totals",
    f"""WITH {_SIZES}, f AS (WITH {_SELECT} SELECT count(*) AS total_files FROM selected), w AS (WITH {_windows_sql(2)} SELECT sum(n_matches)::BIGINT AS total_matches, count(*) AS total_windows FROM windows)
SELECT total_files, total_matches, total_windows, (SELECT sum(size)::BIGINT FROM sizes) AS total_chars, ((SELECT sum(size)::BIGINT FROM sizes) + 2) // 4 AS total_tokens FROM f, w""",
)
def summary_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search(documents_corpus(spark, sf_dir), _CONTEXT).totals()


@query("extensions_found", rf"WITH {_SELECT} SELECT DISTINCT lower(regexp_extract(rel, '[^/](\.[^./]*)$', 1)) AS ext FROM selected WHERE ext <> ''")
def extensions_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search(documents_corpus(spark, sf_dir), SEARCH).extensions()


@query("top10_by_tokens", f"WITH {_SIZES} SELECT s.doc_id AS ord, rel, (size + 2) // 4 AS tokens FROM sizes s JOIN (WITH {CORPUS} SELECT doc_id, rel FROM corpus) c ON c.doc_id = s.doc_id ORDER BY tokens DESC, ord LIMIT 10")
def top10_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Search(documents_corpus(spark, sf_dir), _CONTEXT).top_files()


_LISTED = ALL.where(strings=("license",))


@query("directory_listing", f"WITH {_selected(_LISTED)} SELECT string_agg(rel, chr(10) ORDER BY doc_id) AS listing FROM selected")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing is one value by nature; a bundle's own goes row by row through ``render.bundle``."""
    files = Search(documents_corpus(spark, sf_dir), _LISTED).selected
    return files.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rel"))), lambda r: r["rel"]), "\n").alias("listing"))


@query("directory_listing_rows", f"WITH {_selected(_LISTED)} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, rel FROM selected")
def directory_listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing of any number of files: each with its place in the output."""
    files = Search(documents_corpus(spark, sf_dir), _LISTED).selected.select("ord", "rel")
    return with_ordinal(files, "ord", "n").select("n", "rel")


@query(
    "bundle_sections",
    f"""WITH {_SIZES}, f AS (WITH {_SELECT} SELECT count(*) AS n, sum({_U16.format('rel')} + 1)::BIGINT AS listed FROM selected),
fixed AS (SELECT n, listed, {len(render.head(_CONTEXT, 0)[0]) - 1} + length(n::VARCHAR) AS before, {len(render.head(_CONTEXT, 0)[1])} - CASE WHEN n > 0 THEN 1 ELSE 0 END AS after FROM f)
SELECT 0::INT AS section, 1::BIGINT AS pieces, before::BIGINT AS chars FROM fixed UNION ALL SELECT 1, n, listed FROM fixed WHERE n > 0 UNION ALL SELECT 2, 1, after FROM fixed
UNION ALL SELECT 3, count(*), sum(size)::BIGINT FROM sizes HAVING count(*) > 0 UNION ALL SELECT 4, 1, {len(render.tail(_CONTEXT))}""",
)
def bundle_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written of a bundle: pieces and UTF-16 units of head, listing, what follows it, blocks and tail."""
    search = Search(documents_corpus(spark, sf_dir), _CONTEXT)
    return render.pieces(search.selected, search.blocks, _CONTEXT).groupBy("section").agg(F.count("*").alias("pieces"), F.sum(utf16_length(F.col("text"))).cast("long").alias("chars"))


@query("extensions_sorted", rf"WITH {_SELECT} SELECT row_number() OVER (ORDER BY ext) - 1 AS n, ext FROM (SELECT DISTINCT lower(regexp_extract(rel, '[^/](\.[^./]*)$', 1)) AS ext FROM selected WHERE ext <> '')")
def extensions_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ordinal(Search(documents_corpus(spark, sf_dir), SEARCH).extensions(), "ext", "n")


_OUTCOMES = {"none with the extension": ALL.where(extensions=("zzz",)), "no match": ALL.where(strings=("no such string",)), "all ignored": ALL.where(ignore=("**",)), "fine": ALL.where(strings=("license",), exclude_strings=("###",), ignore=("examples",))}


@query(
    "outcomes",
    f"""WITH {CORPUS}, shown AS (SELECT * FROM corpus WHERE {_VIRTUAL}), n AS (SELECT count(*) AS n FROM shown)
SELECT 'none with the extension' AS search, 0::BIGINT AS candidates, 0::BIGINT AS selected, 2 AS exit_code UNION ALL SELECT 'no match', n, 0, 3 FROM n UNION ALL SELECT 'all ignored', n, 0, 3 FROM n
UNION ALL SELECT 'fine', n, (SELECT count(*) FROM shown WHERE contains(lower(content), 'license') AND NOT contains(content, '###') AND NOT list_contains(string_split(lower(rel), '/'), 'examples')), 0 FROM n""",
)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of searches: 2 without candidates, 3 without matches."""
    rows = [Search(documents_corpus(spark, sf_dir), spec).outcome().select(F.lit(name).alias("search"), "candidates", "selected", "exit_code") for name, spec in _OUTCOMES.items()]
    return reduce(DataFrame.unionByName, rows)


_SEEN = QuerySpec(extensions=("ts", "md", "py"))


@query(
    "paths_from_a_folder",
    f"""WITH {CORPUS}, s AS (SELECT doc_id, '/' || rel AS path, rel FROM corpus WHERE {_SHOWN} AND {_ends('ts', 'md', 'py')})
SELECT doc_id, path, CASE WHEN starts_with(rel, 'src/') THEN substr(rel, 5) ELSE '../' || rel END AS rel FROM s WHERE starts_with(rel, 'src/') OR starts_with(rel, 'docs/')""",
)
def paths_from_a_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute paths, and the same as seen from one of the folders."""
    files = documents_corpus(spark, sf_dir).select("doc_id", F.concat(F.lit("/"), "rel").alias("path"))
    return located(files, ["/docs", "/src"], _SEEN, "/src").select("doc_id", "path", "rel")


# Settings, as functions of columns.
@query(
    "setting_functions",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS x FROM documents WHERE text IS NOT NULL),
v AS (SELECT doc_id, x, list_filter(list_transform(string_split(x || chr(160) || ',, .', ','), lambda y: trim(y, chr(65279) || ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160))), lambda y: y <> '') AS vs FROM l)
SELECT doc_id, vs AS "values", ltrim('./' || x, './') AS stripped, contains(x, '*') OR contains(x, '?') OR contains(x, '[') OR contains(x, ']') OR contains(x, '{') OR contains(x, '}') OR contains(x, '!') AS globbed FROM v""",
)
def setting_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of each document as a comma-separated setting and as a path pattern."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select("doc_id", F.get(split_lines(F.col("text")), F.lit(0)).alias("x"))
    return rows.select("doc_id", csv_values(F.concat("x", F.lit("\xa0,, ."))).alias("values"), without_leading_dots(F.concat(F.lit("./"), "x")).alias("stripped"), has_glob(F.col("x")).alias("globbed"))


# Config files.
_HEADERS = ("[search]", "[extensions]", "[ignore]", "[other]", "[strings]")


@query(
    "config_files",
    rf"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i, trim(CASE WHEN i % 4 = 1 THEN {_list(_HEADERS)}[1 + (doc_id + i // 4) % {len(_HEADERS)}] WHEN i % 7 = 3 THEN ' # ' || x ELSE x END, chr(65279) || ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)) AS v FROM d),
h AS (SELECT *, CASE v WHEN '[search]' THEN 'search' WHEN '[strings]' THEN 'search' WHEN '[extensions]' THEN 'extensions' WHEN '[ignore]' THEN 'exclude' WHEN '[include]' THEN 'extensions' WHEN '[exclude]' THEN 'exclude' WHEN '[exclude-extensions]' THEN 'exclude' END AS header FROM l WHERE v <> '' AND NOT starts_with(v, '#')),
s AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS field FROM h)
SELECT doc_id AS path, i::INT AS n, field, v AS value FROM s WHERE header IS NULL AND field IS NOT NULL""",
)
def config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a config file, with headers and comments put between its lines."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.posexplode(split_lines(F.col("text"))).alias("n", "text"))
    header = F.get(F.array(*map(F.lit, _HEADERS)), ((F.col("path") + F.floor(F.col("n") / 4)) % len(_HEADERS)).cast("int"))
    text = F.when(F.col("n") % 4 == 1, header).when(F.col("n") % 7 == 3, F.concat(F.lit(" # "), "text")).otherwise(F.col("text"))
    return config_rows(rows.withColumn("text", text))


# Scalar functions.
@query("grouped_digits", f"WITH {CORPUS} SELECT doc_id, format('{{:,}}', length * 997) AS digits, lpad(format('{{:,}}', length), greatest(8, length(format('{{:,}}', length)))::INT, ' ') AS padded FROM corpus")
def grouped_digits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_corpus(spark, sf_dir).select("doc_id", grouped_digits(F.col("length") * 997).alias("digits"), pad_start(grouped_digits(F.col("length")), 8).alias("padded"))


#: Bytes that are no UTF-8, before and after each text: a lone start byte, a continuation byte, and a start byte with too few.
_BROKEN = "FF80E282"


@query("utf8_decoding", "SELECT doc_id, '\ufffd\ufffd\ufffd' || text || '\ufffd\ufffd\ufffd' AS content FROM documents WHERE text IS NOT NULL")
def utf8_decoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.unhex(F.lit(_BROKEN))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL")
    return rows.select("doc_id", utf8(F.concat(broken, F.col("text").cast("binary"), broken)).alias("content"))


@query("path_functions", rf"WITH {CORPUS} SELECT doc_id, lower(regexp_extract(rel, '[^/](\.[^./]*)$', 1)) AS ext, {_LANG} AS language, {_U16.format('content')}::BIGINT AS size, ({_U16.format('content')} + 2) // 4 AS tokens FROM corpus")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = utf16_length(F.col("content"))
    return documents_corpus(spark, sf_dir).select("doc_id", F.lower(extension(F.col("rel"))).alias("ext"), fence_language(F.col("rel")).alias("language"), size.alias("size"), token_estimate(size).alias("tokens"))


# Other corpora.
_PAGES = any_literal(("<b>", "track(", "&copy;"))
_TURNS = any_literal(("the", "ist", "est"))


def _other_sql(source: str, key: str, content: str, pattern: str) -> str:
    parts = f"selected AS (SELECT {key} AS doc_id, '' AS rel, {content} AS content FROM {source} WHERE {_re(content, pattern)})"
    return f"WITH {_windows_sql(1, parts, q(pattern))} SELECT doc_id, start_line, end_line, n_matches FROM windows"


def _other(df: DataFrame, key: str, content: str, pattern: str) -> DataFrame:
    files = with_windows(df.where(F.col(content).rlike(pattern)).select(df[key].alias("doc_id"), F.col(content).alias("content")), pattern, 1, lines=False, matches=False)
    return files.select("doc_id", F.explode("windows").alias("w")).select("doc_id", "w.start_line", "w.end_line", "w.n_matches")


query("pages_search", _other_sql("pages", "page_id", "html", _PAGES))(lambda spark, d: _other(spark.read.parquet(f"{d}/pages.parquet"), "page_id", "html", _PAGES))
query("conversations_search", _other_sql("(SELECT conv_id || '/' || turn AS path, text FROM conversations)", "path", "text", _TURNS))(
    lambda spark, d: _other(spark.read.parquet(f"{d}/conversations.parquet").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), "text"), "path", "text", _TURNS)
)
query("benchmark_search", _other_sql("benchmark", "item_id", "text", _TURNS))(lambda spark, d: _other(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text", _TURNS))

