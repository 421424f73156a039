"""Columns over source text and paths: byte classes, canonical text, languages, module names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions and their languages; what has none of them is read as Python.
EXTENSIONS = {
    ".py": "python",
    ".pyi": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".rs": "rust",
}
#: Directories that are never read.
#: Short names of languages.
ALIASES = {"py": "python", "js": "javascript", "ts": "typescript", "rs": "rust"}
IGNORED_DIRS = (".git", ".hg", ".svn", "node_modules", "target", "vendor", "__pycache__", ".venv", "venv", "dist", "build", ".stack-work")
#: Combining marks that are composed, and the letters that they compose with.
MARKS = {
    "́": ("aeiouyAEIOUY", "áéíóúýÁÉÍÓÚÝ"),
    "̀": ("aeiouAEIOU", "àèìòùÀÈÌÒÙ"),
    "̈": ("aeiouyAEIOU", "äëïöüÿÄËÏÖÜ"),
    "̂": ("aeiouAEIOU", "âêîôûÂÊÎÔÛ"),
    "̃": ("anoANO", "ãñõÃÑÕ"),
    "̧": ("cC", "çÇ"),
}


def scan_class(text: Column) -> Column:
    """What a text needs before it is canonical; anything but ASCII decides before line ends do."""
    return (
        F.when(text.rlike(r"[^\x00-\x7F]"), "needs_composition")
        .when(text.contains("\r"), "carriage_returns")
        .otherwise("plain")
    )


def unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def composed(text: Column) -> Column:
    """Letters with a combining mark of the fixed table as one character."""
    pairs = [(base + mark, whole) for mark, (bases, wholes) in MARKS.items() for base, whole in zip(bases, wholes, strict=True)]
    done = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    return F.when(text.rlike("[̀-̧̃̈]"), done).otherwise(text)


def canonical_text(text: Column) -> Column:
    return composed(unix_lines(text))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("python"))


def language_named(name: Column) -> Column:
    """A language by its name or alias, in any case; other names stay as they are, in lower case."""
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(name)), F.lower(name))


def is_source(path: Column) -> Column:
    """Whether the scan reads a path: a known extension, and no ignored directory above it."""
    return extension(path).isin(*EXTENSIONS) & ~F.arrays_overlap(F.split(slashes(path), "/"), F.array(*map(F.lit, IGNORED_DIRS)))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def folded_path(path: Column) -> Column:
    return F.lower(slashes(path))


def within(path: Column, root: Column) -> Column:
    """Whether a path is its root or below it, without regard to case."""
    top = F.regexp_replace(folded_path(root), "/+$", "")
    return (folded_path(path) == top) | folded_path(path).startswith(F.concat(top, F.lit("/")))


def module_name(path: Column) -> Column:
    """Dotted name of a path without its extension; a package's __init__ is the package."""
    parts = F.filter(F.split(F.regexp_replace(slashes(path), r"\.[^./]+$", ""), "/"), lambda x: ~x.isin("", ".", "/"))
    last = F.element_at(parts, -1) == "__init__"
    return F.array_join(F.when(last & (F.size(parts) > 1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts), ".")


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(slashes(path), "/", -1), r"\.[^.]*$", ""))


def is_test_file(path: Column) -> Column:
    """Test files by where they lie or how they are named."""
    p = folded_path(path)
    return p.rlike(r"(^|/)(tests?|spec|__tests__)/") | p.rlike(r"(^|/)test_[^/]*$|_test\.[^/]*$|\.(test|spec)\.[^/]*$|_spec\.[^/]*$")


def leading_dots(name: Column) -> Column:
    return F.length(F.regexp_extract(name, r"^\.*", 0))
