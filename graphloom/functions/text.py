"""Text functions: tokens, trigrams, hashed embeddings, paths, SQL tables, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search leaves out, what it looks for besides a word, patterns of names.
STOP_WORDS = (
    "a an the what if i change modify remove delete update fix break happens depends on which features use can safely will would should my this that "
    "when where how why who is are was were be been being have has had do does did doing could may might must shall"
).split()
SYNONYMS = {
    "login": ["github", "oauth", "auth", "callback", "session", "sign"],
    "oauth": ["github", "auth", "callback", "token"],
    "github": ["oauth", "auth", "connect", "callback"],
    "authentication": ["auth", "oauth", "login"],
    "repository": ["repo", "connect", "analyze"],
    "analysis": ["analyze", "parser", "scan"],
    "session": ["token", "auth", "cookie"],
    "connect": ["repo", "github", "repository"],
}
AUTH = "(?i)auth|oauth|login|session|token|password|credential|jwt|cookie|github"
DATABASE = "(?i)database|db_|postgres|sqlalchemy|redis|migrate|repository|query"
CRITICAL = r"(?i)main\.py|app\.py|router|middleware|config|settings|connect|analyze"
MAX_TOKENS, DIMS = 16, 128


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: as the variable of a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def tokens(text: Column, synonyms: dict[str, list[str]] | None = None, limit: int = MAX_TOKENS) -> Column:
    """Lower-case words of two or more characters without stop words, related words after their word; distinct."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_./-]+)"), F.lit(1))
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))
    table = SYNONYMS if synonyms is None else synonyms
    if table:
        known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        words = F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(known[w], F.array().cast("array<string>")))))
    return F.slice(F.array_distinct(words), 1, limit)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-case word, padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all trigrams; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def embedding_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def embedding(words: Column, dims: int = DIMS) -> Column:
    """Bag of words hashed by md5 into ``dims`` places, at unit length, rounded to six digits; zeros for no words."""
    places = F.transform(words, lambda w: F.pmod(F.conv(F.right(F.md5(w), F.lit(8)), 16, 10).cast("long"), F.lit(dims)))
    counts = lambda p: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(p, lambda x: x == k)).cast("double"))
    unit = lambda c, norm: F.transform(c, lambda x: F.when(norm > 0, F.round(x / norm, 6)).otherwise(F.lit(0.0)))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    return bound(places, lambda p: bound(counts(p), lambda c: bound(norm(c), lambda n: unit(c, n))))


def embedding_of(text: str, dims: int = DIMS) -> list[float]:
    """The same for one text, on the driver."""
    import hashlib
    import math
    import re

    out = [0.0] * dims
    for word in re.findall("[a-z0-9]+", text.lower()):
        out[int(hashlib.md5(word.encode()).hexdigest()[-8:], 16) % dims] += 1
    norm = math.sqrt(sum(x * x for x in out))
    return [round(x / norm, 6) if norm else 0.0 for x in out]


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    both = length(a) * length(b)
    return F.when(both > 0, dot / both).otherwise(F.lit(0.0))


def posix_path(path: Column) -> Column:
    """Forward slashes, no doubled ones, no leading ./"""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), r"^(\./)+", "")


def folder_depth(path: Column) -> Column:
    return F.size(F.split(F.trim(posix_path(path), F.lit("/")), "/")) - 1


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


#: Language of a file extension.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "cs": "csharp", "rb": "ruby", "rs": "rust", "php": "php", "sql": "sql", "html": "html", "css": "css", "md": "markdown"}


def language(path: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(known[extension(path)], F.lit("unknown"))


def sql_tables(code: Column) -> Column:
    """Array of (operation, table) that a text reads, writes, updates or deletes from."""
    found = []
    for kind, pattern in (("reads", r"(?is)select\b[^;]*?\bfrom\s+([A-Za-z_][\w.]*)"), ("writes", r"(?i)insert\s+into\s+([A-Za-z_][\w.]*)"), ("updates", r"(?i)update\s+([A-Za-z_][\w.]*)\s+set\b"), ("deletes", r"(?i)delete\s+from\s+([A-Za-z_][\w.]*)")):
        found.append(_tagged(code, kind, pattern))
    return F.array_distinct(F.concat(*found))


def _tagged(code: Column, kind: str, pattern: str) -> Column:
    tables = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
    return F.transform(tables, lambda t: F.struct(F.lit(kind).alias("operation"), F.lower(t).alias("table")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """The prefix and the first 24 hex digits of a SHA-256 over the parts, each led by its length; a null is ``-``."""
    said = [F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *said), 256), 1, 24))


def relevance(name: Column, path: Column, summary: Column, term: str) -> Column:
    """1 exact name, 2 prefix, 3 inside the name, 4 in the path, 5 in the summary, else 6."""
    t = term.lower()
    n = F.lower(name)
    return F.when(n == t, 1).when(n.startswith(t), 2).when(n.contains(t), 3).when(F.lower(path).contains(t), 4).when(F.lower(summary).contains(t), 5).otherwise(6)


#: Names of entry points.
ENTRY_POINTS = ("main.py", "app.py", "index.js", "index.ts", "main.ts")


def importance(path: Column) -> Column:
    """1.0 entry points by their file name, 0.9 paths with router, route or api in them, 0.3 tests, else 0.5."""
    name = F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1))
    routed = path.contains("route") | path.contains("api")
    return F.when(name.isin(*ENTRY_POINTS), 1.0).when(routed, 0.9).when(path.startswith("test") | path.contains("/test"), 0.3).otherwise(0.5)
