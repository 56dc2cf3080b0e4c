"""Language of a snippet by its shebang, its name's extension or a special name, as one column expression."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import fold

# Languages by extension, interpreter and name, and the extension of a new file.
BY_EXTENSION = {
    "sh": "bash", "bash": "bash", "zsh": "zsh", "fish": "fish", "py": "python", "pyw": "python", "pyx": "python", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "js": "javascript", "mjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "rb": "ruby", "rake": "ruby", "java": "java", "kt": "kotlin",
    "kts": "kotlin", "json": "json", "yml": "yaml", "yaml": "yaml", "toml": "toml", "xml": "xml", "sql": "sql", "dockerfile": "dockerfile",
    "mk": "makefile", "md": "markdown", "markdown": "markdown", "lua": "lua", "pl": "perl", "pm": "perl", "php": "php", "swift": "swift",
    "scala": "scala", "sc": "scala", "r": "r", "hs": "haskell", "ex": "elixir", "exs": "elixir", "css": "css", "scss": "scss",
    "sass": "sass", "less": "less", "html": "html", "htm": "html", "vim": "vim", "vimrc": "vim",
}
INTERPRETERS = {
    "bash": "bash", "sh": "bash", "zsh": "zsh", "fish": "fish", "python": "python", "python2": "python", "python3": "python", "node": "javascript",
    "nodejs": "javascript", "ruby": "ruby", "perl": "perl", "php": "php", "lua": "lua", "awk": "awk", "sed": "sed",
}
SPECIAL_NAMES = {"makefile": "makefile", "gnumakefile": "makefile", ".bashrc": "bash", ".bash_profile": "bash", ".zshrc": "bash", ".profile": "bash", ".gitignore": "gitconfig", ".gitattributes": "gitconfig"}
FILE_EXTENSIONS = {
    "python": ".py", "bash": ".sh", "shell": ".sh", "javascript": ".js", "typescript": ".ts", "cpp": ".cpp", "c++": ".cpp", "c": ".c", "go": ".go",
    "rust": ".rs", "ruby": ".rb", "java": ".java", "sql": ".sql", "yaml": ".yaml", "json": ".json", "markdown": ".md",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), key)


def _interpreter(content: Column) -> Column:
    """The word after ``env``, else after the last slash of the first line; null without either."""
    line = F.regexp_extract(content, r"^#!([^\n]*)", 1)
    after_env = F.regexp_extract(line, r"env [ \t]*([^ \t]*)", 1)
    after_slash = F.regexp_extract(line, r"/([^/ \t]*)[^/]*$", 1)
    word = F.when(line.contains("env "), after_env).when(line.contains("/"), after_slash)
    return F.when(content.startswith("#!") & (word != ""), word)


def detect_language(content: Column, name: Column) -> Column:
    """Shebang, then extension, then special name, then text."""
    interpreter = _interpreter(content)
    shebang = F.coalesce(_lookup(INTERPRETERS, interpreter), interpreter)
    folded = fold(F.coalesce(name, F.lit("")))
    extension = F.regexp_extract(folded, r"\.([^.]+)$", 1)
    special = F.when(folded.startswith("dockerfile"), "dockerfile").otherwise(_lookup(SPECIAL_NAMES, folded))
    return F.coalesce(shebang, _lookup(BY_EXTENSION, extension), special, F.lit("text"))


def file_extension(language: Column) -> Column:
    return F.coalesce(_lookup(FILE_EXTENSIONS, language), F.lit(".txt"))
