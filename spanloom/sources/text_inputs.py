"""Smaller inputs: source trees, unified diffs, commit history, repository lists, rule packs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import path_allowed
from spanloom.operators.ranged import carry_forward

# Folders that hold no sources, extensions of the languages understood.
SKIPPED = ["node_modules", ".git", "dist", "build", "coverage", "__pycache__", ".venv", "venv"]
LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python"}


def source_files(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """(path, lang, content_sha256, content) of the sources under ``root``.

    Exclusion wins over inclusion; no inclusion means everything; skipped folders never count.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.locate(root.rstrip("/") + "/", F.col("path"))
    rel = F.substr("path", at + len(root.rstrip("/")) + 1)
    lang = F.lit(None).cast("string")
    for ext, name in LANGUAGES.items():
        lang = F.when(F.lower("path").endswith(f".{ext}"), name).otherwise(lang)
    rows = files.select(rel.alias("path"), lang.alias("lang"), F.sha2("content", 256).alias("content_sha256"), F.col("content").cast("string").alias("content"))
    skipped = "(^|/)(" + "|".join(map(re.escape, SKIPPED)) + ")/"
    return rows.filter(F.col("lang").isNotNull() & ~F.col("path").rlike(skipped) & path_allowed(F.col("path"), list(include), list(exclude)))


def hunks(lines: DataFrame, diff: str = "diff_id", at: str = "line_no", text: str = "text") -> DataFrame:
    """(diff, file, first, last) of the new-side line ranges of unified diffs.

    ``lines`` holds one row per line. A ``+++`` header sets the file for what follows, one to
    /dev/null clears it; a range without a count is one line; a pure deletion has no range.
    """
    header = F.col(text).startswith("+++ ")
    name = F.regexp_replace(F.regexp_extract(text, r"^\+\+\+ (\S.*?)\s*$", 1), "^b/", "")
    marked = lines.filter(header | F.col(text).startswith("@@")).select(diff, at, text, F.when(header, name).alias("file"))
    filed = carry_forward(marked, [diff], [at], "file", "diff-files")
    found = filed.filter(F.col(text).startswith("@@") & (F.col("file") != "/dev/null") & (F.col("file") != ""))
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    first = F.regexp_extract(text, pattern, 1).try_cast("int")
    count = F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("int"), F.lit(1))
    return found.select(diff, "file", first.alias("first"), (first + count - 1).alias("last")).filter("first is not null and last >= first")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(sha, date, author, file) from an export of ``git log --no-merges --name-only`` lines.

    A commit line has three fields split by the unit separator, its files follow. Files of one
    export stay in order, as one text file is one log.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("text"))
    commit = F.when(F.col("text").contains("\u001f"), F.split("text", "\u001f"))
    rows = carry_forward(lines.withColumn("c", commit), ["log"], ["n"], "c", "log-commits")
    return rows.filter(~F.col("text").contains("\u001f") & (F.trim("text") != "") & F.col("c").isNotNull()).select(F.col("c")[0].alias("sha"), F.col("c")[1].alias("date"), F.col("c")[2].alias("author"), F.trim("text").alias("file"))


# What a repository list may say.
REPO_LANGUAGES = ["javascript", "typescript", "python"]
REPO_FRAMEWORKS = ["fastify", "fastapi", "none"]


def repositories(spark: SparkSession, text: str) -> DataFrame:
    """(repo_id, name, root_path, service_name, lang, framework, include, exclude, port, base_url_env) of a list in JSON.

    Keys starting ``//`` are comments. base_url_env maps names of variables to the service
    they lead to; port is where the service listens locally. Whatever is wrong is an error
    that names its repository.
    """
    rows, names = [], set()
    for i, repo in enumerate(json.loads(text).get("repos", [])):
        repo = {k: v for k, v in repo.items() if not k.startswith("//")}
        name, root = repo.get("name"), repo.get("root", "")

        def need(holds: bool, what: str) -> None:
            if not holds:
                raise ValueError(f"{name or f'repository {i}'}: {what}")

        need(bool(name), "has no name")
        need(name not in names, "is listed twice")
        need(isinstance(root, str) and root.startswith("/"), "the root must be absolute")
        need(repo.get("lang") in REPO_LANGUAGES, f"language {repo.get('lang')!r} is not one of {REPO_LANGUAGES}")
        need(repo.get("framework", "none") in REPO_FRAMEWORKS, f"framework {repo.get('framework')!r} is not one of {REPO_FRAMEWORKS}")
        for key in ("include", "exclude"):
            need(isinstance(repo.get(key, []), list) and all(isinstance(g, str) for g in repo.get(key, [])), f"{key} must be a list of globs")
        port, env = repo.get("port"), repo.get("baseUrlEnv", {})
        need(port is None or type(port) is int and 0 < port < 65536, f"port {port!r} is no port")
        need(isinstance(env, dict) and all(isinstance(v, str) for v in env.values()), "baseUrlEnv must map names to services")
        names.add(name)
        rows.append((i + 1, name, root, repo.get("service") or name, repo["lang"], repo.get("framework", "none"), repo.get("include", []), repo.get("exclude", []), port, env))
    return spark.createDataFrame(rows, "repo_id long, name string, root_path string, service_name string, lang string, framework string, include array<string>, exclude array<string>, port int, base_url_env map<string,string>")


def service_places(repos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hosts (host, service), ports (port, service), env (name, service)) of a repository list."""
    hosts = repos.select(F.explode(F.array_distinct(F.array("service_name", "name"))).alias("host"), F.col("service_name").alias("service"))
    return hosts, repos.filter("port is not null").select("port", F.col("service_name").alias("service")), repos.select(F.explode("base_url_env").alias("name", "service"))


def check_rules(lines: Iterable[str]) -> tuple[dict[str, str], list[str]]:
    """(helper -> kind, error builders) from a rule pack of two-level lists.

    A line it cannot read is an error that names its number.
    """
    helpers: dict[str, str] = {}
    builders: list[str] = []
    section = kind = None
    for n, raw in enumerate(lines, 1):
        line = raw.split("#", 1)[0].rstrip()
        if not line.strip():
            continue
        item = re.fullmatch(r"\s*-\s+([\w.$]+)", line)
        head = re.fullmatch(r"(\s*)([\w-]+):", line)
        if head and not head[1]:
            section, kind = head[2], None
        elif head and section == "check_kinds":
            kind = head[2]
        elif item and section == "check_kinds" and kind:
            helpers[item[1]] = kind
        elif item and section == "error_builders":
            builders.append(item[1])
        else:
            raise ValueError(f"rule pack, line {n}: cannot read {raw.strip()!r}")
    return helpers, builders
