"""Which paths are read: the path guard, pruned folders, and ignore patterns."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from fnmatch import translate
from pathlib import Path

#: Folders that are never part of a repository's own source (fixed values).
PRUNED = frozenset({
    ".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", "node_modules", ".flowlens", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox",
    "build", "dist", ".eggs", ".idea", ".vscode",
})
#: Those of them that are not even listed; imports may lead into the others.
UNREAD = frozenset({".git", ".hg", ".svn", "node_modules", "__pycache__", ".flowlens"})


def guard(path: str | Path | None) -> Path:
    """The absolute path of a repository; ValueError for none, a blank one, or one with a `..` part."""
    if path is None:
        raise ValueError("a repository path is required")
    text = os.fspath(path)
    if not text.strip():
        raise ValueError("the repository path is blank")
    if ".." in re.split(r"[/\\]", text):
        raise ValueError("the repository path may not contain '..'")
    return Path(text).expanduser().resolve()


@dataclass(frozen=True)
class Ignore:
    """Patterns of an ignore file: comments and negations are skipped; a star crosses slashes."""

    rules: tuple[tuple[re.Pattern, re.Pattern | None, bool], ...] = ()

    @classmethod
    def parse(cls, text: str) -> Ignore:
        rules = []
        for line in (raw.strip() for raw in text.splitlines()):
            folder, anchored = line.endswith("/"), line.startswith("/")
            glob = line.removesuffix("/").removeprefix("/") if not line.startswith(("#", "!")) else ""
            if glob:
                whole = re.compile(translate(glob) + "|" + translate(f"{glob}/*")) if anchored else re.compile(translate(glob)) if "/" in glob else None
                rules.append((re.compile("(?!)") if anchored else re.compile(translate(glob)), whole, folder))
        return cls(tuple(rules))

    def hides(self, relative: str, is_folder: bool) -> bool:
        name = relative.rpartition("/")[2]
        return any((is_folder or not folder) and bool(base.match(name) or (whole and whole.match(relative))) for base, whole, folder in self.rules)
