"""File extensions of the supported languages and the rules for ids and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by extension (fixed values).
EXTENSIONS: dict[str, str] = {
    "py": "python", "pyi": "python",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
    "rb": "ruby", "cs": "csharp", "php": "php", "kt": "kotlin", "kts": "kotlin",
    "swift": "swift", "scala": "scala", "sc": "scala", "lua": "lua", "sh": "bash", "bash": "bash", "r": "r",
}
#: Folders that discovery leaves out (fixed values).
IGNORED_DIRS = (
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "node_modules", "dist", "build",
    ".eggs", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".idea", ".vscode", ".tox", "site-packages",
)


def extension(path: Column) -> Column:
    """The lower-cased extension of the last part of a path, '' where it has none; a leading dot of a name starts none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([A-Za-z0-9_+-]+)$", 1))


def language_for(path: Column) -> Column:
    """The language of a path by its extension, null if it is not supported."""
    pairs = [F.lit(x) for kv in EXTENSIONS.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), extension(path))
