"""Schemas of the index tables and enumerations shared by the operators."""

SCHEMA_VERSION = "4"

FILES = "path string NOT NULL, lang string NOT NULL, hash string NOT NULL, content string NOT NULL"
SYMBOLS = "file_path string, name string, kind string, line int, end_line int, range_evidence string, signature string"
IMPORTS = "file_path string, target string, kind string, line int"
EDGES = "source_path string, raw_target string, target_path string, kind string, line int, resolution string, resolver string, candidate_paths array<string>"
METADATA = "repo_root string, indexed_at timestamp, version string, schema_version string"

# Extensions by language (case-sensitive); any other is unknown and not indexed.
LANGUAGES = {
    "rust": ("rs",),
    "typescript": ("ts", "tsx"),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "python": ("py",),
    "go": ("go",),
    "java": ("java",),
    "ruby": ("rb",),
    "php": ("php",),
    "swift": ("swift",),
    "kotlin": ("kt", "kts"),
    "c": ("c", "h"),
    "cpp": ("cc", "cpp", "hpp"),
    "csharp": ("cs",),
    "markdown": ("md",),
    "config": ("toml", "yaml", "yml", "json"),
}

# Directories, and file endings, that are never indexed (in any case of letters).
SKIPPED_DIRS = (".git", ".codeloom", ".research", "node_modules", "target", "dist", "build", "snapshots", ".next", ".venv", "venv", "env", ".env", "site-packages", "__pypackages__", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".nox", "htmlcov", "coverage", ".parcel-cache", ".turbo")
SKIPPED_DIR_PREFIXES = (".venv-", ".venv_", "venv-", "venv_")
SKIPPED_ENDINGS = (".lock", "-lock.json", "pnpm-lock.yaml", "bun.lockb", ".min.js", ".min.css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".pdf", ".sqlite", ".db")
#: Further directories that a search for repositories does not enter.
SKIPPED_IN_DISCOVERY = (".cache", ".cargo", ".npm", ".rustup", ".local", ".trash", "library", "applications", "downloads", "movies", "music", "pictures", "public")
