"""Project folders as a source: files by kind, staleness by hash, and seed memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and endings that are passed over, and starting heats.
SKIPPED_FOLDERS = (
    ".git", ".hg", ".svn", "node_modules", ".node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".venv", "venv", "env", ".env",
    "dist", "build", "out", "target", ".next", ".nuxt", ".output", ".tox", ".nox", "vendor", ".terraform", ".idea", ".vscode", "coverage", ".coverage",
)
BINARY_ENDINGS = ("pyc", "pyo", "so", "o", "a", "dll", "exe", "dylib", "png", "jpg", "jpeg", "gif", "bmp", "ico", "svg", "webp", "woff", "woff2", "ttf", "eot", "otf", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "pdf", "doc", "docx", "xls", "xlsx", "mp3", "mp4", "avi", "mov", "wav", "flac", "wasm", "class", "jar", "db", "sqlite", "sqlite3", "lock")
HEAT = {"overview": 0.9, "documentation": 0.85, "config": 0.7, "ci_cd": 0.6, "entry_point": 0.75, "component": 0.5}
CONFIG_FILES = r"(?i)^(pyproject\.toml|setup\.(py|cfg)|pipfile|requirements.*\.txt|package\.json|tsconfig\.json|cargo\.toml|go\.mod|pom\.xml|build\.gradle|gemfile|composer\.json|makefile|dockerfile|docker-compose\.ya?ml)$"
ENTRY_FILES = r"(?i)^(main|app|index|server|cli|__main__|manage|wsgi|asgi)\.(py|js|ts|tsx|go|rs|rb|java)$"
DOC_FILES = r"(?i)^(readme|contributing|changelog|architecture|license)[^/]*$|\.(md|rst|adoc)$"
CI_PATHS = r"(?i)(^|/)(\.github/workflows/.*|\.gitlab-ci\.yml|\.circleci/.*|jenkinsfile|azure-pipelines\.yml|\.travis\.yml)$"


def files(spark: SparkSession, folder: str, most_bytes: int = 64 << 10) -> DataFrame:
    """(path, name, kind, hash, size, text) of text files; contents over ``most_bytes`` are hashed but not read as text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    skipped = F.lit(False)
    for part in SKIPPED_FOLDERS:
        skipped = skipped | F.contains("path", F.lit(f"/{part}/"))
    rows = raw.where(~skipped & ~F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*BINARY_ENDINGS))
    kind = F.when(name.rlike(CONFIG_FILES), "config").when(F.col("path").rlike(CI_PATHS), "ci_cd").when(name.rlike(DOC_FILES), "documentation").when(name.rlike(ENTRY_FILES), "entry_point").otherwise("component")
    binary = F.position(F.lit("00"), F.hex(F.substring("content", 1, 8192))) % 2 == 1
    text = F.when((F.col("length") <= most_bytes) & ~binary, F.decode("content", "UTF-8"))
    return rows.select("path", name.alias("name"), kind.alias("kind"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), text.alias("text"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, hash, state) of files that are new, changed or gone between two snapshots of (path, hash)."""
    both = old.select("path", F.col("hash").alias("_old")).join(new.select("path", "hash"), "path", "full_outer")
    state = F.when(F.col("_old").isNull(), "new").when(F.col("hash").isNull(), "gone").when(F.col("_old") != F.col("hash"), "changed")
    return both.select("path", F.coalesce("hash", "_old").alias("hash"), state.alias("state")).where("state is not null")


def stale(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids of memories whose file hash was replaced, or whose directory holds a changed file, each once."""
    hit = memories.join(changes.select(F.col("old_hash").alias("file_hash")).distinct(), "file_hash", "left_semi").select("id")
    folders = changes.select(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).distinct()
    return hit.unionAll(memories.join(folders, "directory", "left_semi").select("id")).distinct()


def seed(found: DataFrame, folder: str) -> DataFrame:
    """(content, kind, heat, tags): a memory of the whole, one for each notable file, and one for each folder of components."""
    heat = lambda k: F.element_at(F.create_map(*(F.lit(x) for p in HEAT.items() for x in p)), k)
    whole = found.agg(F.concat(F.lit("project with "), F.count(F.lit(1)), F.lit(" files: "), F.array_join(F.array_sort(F.collect_set(F.regexp_extract("name", r"\.([^.]+)$", 1))), " ")).alias("content")).withColumn("kind", F.lit("overview"))
    single = found.where("kind <> 'component'").select(F.concat(F.col("name"), F.lit(": "), F.substring(F.coalesce("text", F.lit("")), 1, 500)).alias("content"), "kind")
    parts = found.where("kind = 'component'").groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    grouped = parts.select(F.concat("d", F.lit(" holds "), F.col("n"), F.lit(" files")).alias("content"), F.lit("component").alias("kind"))
    out = whole.select("content", "kind").unionByName(single).unionByName(grouped)
    return out.select("content", "kind", heat(F.col("kind")).alias("heat"), F.array(F.lit("seed"), F.col("kind")).alias("tags"), F.lit(folder).alias("directory"))


def manifest_summary(name: str = "name", text: str = "text") -> Column:
    """One line for a package manifest: its kind, name, version and number of dependencies; null for other files."""
    t, n = F.col(text), F.lower(name)
    package = F.from_json(t, "name string, version string, dependencies map<string,string>, devDependencies map<string,string>")
    size = lambda m: F.coalesce(F.size(F.map_keys(m)), F.lit(0))
    of = lambda pattern: F.regexp_extract(t, pattern, 1)
    named = r'(?m)^name\s*=\s*"([^"]+)"'
    version = r'(?m)^version\s*=\s*"([^"]+)"'
    block = F.regexp_extract(t, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1)
    crates = F.regexp_extract(t, r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1)
    line = lambda kind, a, b, c: F.concat_ws(" ", F.lit(kind), a, b, F.concat(c.cast("string"), F.lit(" dependencies")))
    return (
        F.when(n == "package.json", line("npm", package["name"], package["version"], F.greatest(size(package["dependencies"]), F.lit(0)) + F.greatest(size(package["devDependencies"]), F.lit(0))))
        .when(n == "pyproject.toml", line("python", of(named), of(version), F.regexp_count(block, F.lit(r'"[^"]+"'))))
        .when(n == "cargo.toml", line("rust", of(named), of(version), F.regexp_count(crates, F.lit(r"(?m)^[\w-]+\s*="))))
        .when(n == "go.mod", line("go", of(r"(?m)^module\s+(\S+)"), of(r"(?m)^go\s+(\S+)"), F.regexp_count(t, F.lit(r"(?m)^\s+\S+\s+v\d"))))
    )
