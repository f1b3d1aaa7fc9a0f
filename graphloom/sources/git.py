"""Commits and uncommitted changes of a folder under git, as rows.

The log's length is a parameter and a working tree's changes are few: both come
through the driver, which alone is sure to have the folder and the program.
"""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS, SECONDS = 40, 20
RECORD, FIELD = "\x01", "\x1f"


def _git(root: str, *args: str) -> str:
    """What git says, empty where there is no repository, no git, or no answer in time."""
    if not os.path.exists(os.path.join(root, ".git")):
        return ""
    try:
        told = subprocess.run(["git", "-c", "core.quotePath=false", "-C", root, *args], capture_output=True, timeout=SECONDS, check=False)
    except (OSError, subprocess.SubprocessError):
        return ""
    return told.stdout.decode("utf-8", "replace") if told.returncode == 0 else ""


def parse_log(text: str) -> list[tuple[str, str, str, str, list[str]]]:
    """(hash, subject, date, author, files) of records that begin with \\x01 and whose fields \\x1f parts."""
    rows = []
    for record in text.split(RECORD):
        head, _, files = record.strip("\n").partition("\n")
        hash_, subject, date, author = [*head.split(FIELD), "", "", "", ""][:4]
        if hash_:
            rows.append((hash_, subject, date, author, [f.strip() for f in files.split("\n") if f.strip()]))
    return rows


def commits(spark: SparkSession, root: str, limit: int = COMMITS) -> DataFrame:
    """(hash, subject, date, author, files) of the latest commits that aren't merges."""
    text = _git(root, "log", f"-{max(1, limit)}", "--no-merges", "--name-only", f"--pretty=format:%x01{FIELD.join(('%h', '%s', '%aI', '%an'))}")
    return spark.createDataFrame(parse_log(text), "hash string, subject string, date string, author string, files array<string>")


def parse_status(text: str, own: str = ".graphloom/") -> list[str]:
    """Sorted paths of ``git status --porcelain``; of a renamed file the new name, without what lies below ``own``."""
    found = set()
    for line in text.splitlines():
        path = line[3:].rsplit(" -> ", 1)[-1].strip().strip('"').replace("\\", "/")
        if path and not path.startswith(own):
            found.add(path)
    return sorted(found)


def working_changes(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files that differ from the last commit, untracked ones too."""
    return spark.createDataFrame([(p,) for p in parse_status(_git(root, "status", "--porcelain"))], "path string")


def sessions(log: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session nodes, touches edges) of commits; only files that are nodes (path) are touched."""
    at = log.withColumn("id", F.concat(F.lit("session:"), "hash"))
    label = F.substring(F.trim(F.concat_ws(" ", "hash", "subject")), 1, 80)
    told = F.trim(F.concat(F.lit("commit "), "hash", F.lit(" by "), "author", F.lit(" "), F.substring("date", 1, 10)))
    nodes = at.select("id", label.alias("label"), told.alias("description"), "date", F.create_map(F.lit("author"), "author", F.lit("subject"), "subject").alias("extra"))
    touched = at.select(F.col("id").alias("source"), F.explode(F.array_distinct("files")).alias("target"))
    return nodes.dropDuplicates(["id"]), touched.join(files.select(F.col("path").alias("target")), "target", "left_semi").select("source", "target").distinct()
