"""An exported commit log as records.

The log is what ``git log --numstat --summary --patch`` prints with a header line of fields between
vertical bars and a delimiter before each commit. Reading is one scan with the delimiter as the line
separator; everything else is column expressions, so blocks are parsed where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DELIMITER = "==COMMIT=="
HEADER = ("commit_id", "parents", "author_name", "author_email", "committer_name", "authored_timestamp", "committed_timestamp", "message")
ISSUE = r"\b([A-Z]+-\d+|#\d+|GH-\d+)\b"


def read_log(spark: SparkSession, path: str, delimiter: str = DELIMITER) -> DataFrame:
    """Blocks of the log at ``path``, one per row in ``block``."""
    return spark.read.option("lineSep", delimiter).text(path).withColumnRenamed("value", "block").where(F.trim("block") != "")


def new_path(path: Column) -> Column:
    """The new name of ``a/{old => new}/b`` or ``old => new``; other paths stay."""
    braces = F.regexp_replace(F.regexp_replace(path, r"\{(.*?) => (.*?)\}", "$2"), "//", "/")
    return F.when(path.rlike(r"\{.* => .*\}"), braces).when(F.instr(path, " => ") > 0, F.substring_index(path, " => ", -1)).otherwise(path)


def old_path(path: Column) -> Column:
    braces = F.regexp_replace(F.regexp_replace(path, r"\{(.*?) => (.*?)\}", "$1"), "//", "/")
    return F.when(path.rlike(r"\{.* => .*\}"), braces).when(F.instr(path, " => ") > 0, F.substring_index(path, " => ", 1)).otherwise(path)


def issues(message: Column) -> Column:
    """Issue keys of a message, distinct and sorted; none for a null message."""
    return F.coalesce(F.array_sort(F.array_distinct(F.regexp_extract_all(message, F.lit(ISSUE), F.lit(1)))), F.array().cast("array<string>"))


def directory_depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def package_of(path: Column) -> Column:
    """The directory of a path; empty at the top."""
    return F.regexp_extract(path, "^(.+)/", 1)


def exclude_odd_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """Without paths that hold a colon, which a tree reference could not name."""
    return df.where(~F.col(path).contains(":"))


def status_lines(lines: Column) -> Column:
    """``status, path`` of name-status lines; a rename gives D of the old and A of the new path."""
    parts = F.split(lines, "\t")
    letter = F.substring(parts[0], 1, 1)
    one = lambda s, p: F.struct(s.alias("status"), p.alias("path"))
    return F.when(letter == "R", F.array(one(F.lit("D"), parts[1]), one(F.lit("A"), parts[2]))).when(letter.isin("A", "M", "D"), F.array(one(letter, parts[1])))


def parse_log(blocks: DataFrame, suffix: str = ".java", scope: str = "modified") -> DataFrame:
    """Records of ``blocks`` (column ``block``).

    Blocks with fewer than eight header fields, without numeric times or without a file of the suffix
    are dropped. ``scope`` says whether lines added and deleted and the depth count modified files
    (modified) or all (all). The message may hold further lines after the header's last field as
    ``\\n`` is written into it as is; it ends before the first numstat or summary line.
    """
    if scope not in ("modified", "all"):
        raise ValueError("scope is modified or all")
    at = F.instr("block", "\ndiff --git")
    df = blocks.select(F.regexp_replace("block", r"^\s+|\s+$", "").alias("block"))
    df = df.select(F.when(at > 0, F.substring("block", F.lit(1), at - 1)).otherwise(F.col("block")).alias("head"), F.when(at > 0, F.substring("block", at + 1, F.length("block"))).otherwise("").alias("diff"))
    df = df.withColumn("lines", F.split("head", "\n")).withColumn("h", F.split(F.col("lines")[0], r"\|", 8)).where(F.size("h") == 8)
    df = df.withColumns({name: F.col("h")[i] for i, name in enumerate(HEADER)})
    for c in ("authored_timestamp", "committed_timestamp"):
        df = df.withColumn(c, F.expr(f"try_cast(trim({c}) AS bigint)")).where(F.col(c).isNotNull())
    data = F.filter(F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda x: F.trim(x)), lambda x: x != "")
    df = df.withColumn("data", data)
    df = df.withColumn("stat", F.transform(F.filter("data", lambda x: x.rlike(r"^(\d+|-)\t(\d+|-)\t.")), lambda x: F.split(x, "\t", 3)))
    named = F.transform("stat", lambda s: s[2])
    ends = lambda p: F.lower(p).endswith(suffix)
    summary = lambda kind: F.transform(F.filter("data", lambda x: x.startswith(kind)), lambda x: F.regexp_extract(x, rf"^{kind}\S* (.*?)( \(\d+%\))?$", 1))
    mode = lambda kind: F.transform(F.filter("data", lambda x: x.startswith(kind)), lambda x: F.regexp_extract(x, rf"^{kind} \d+ (.*)$", 1))
    df = df.withColumns({"named": named})
    df = df.withColumns({
        "made": F.filter(mode("create mode"), lambda p: F.array_contains("named", p)), "gone": F.filter(mode("delete mode"), lambda p: F.array_contains("named", p)),
        "moved": F.filter(summary("rename"), lambda p: F.array_contains("named", p)), "copied": F.filter(summary("copy"), lambda p: F.array_contains("named", p)),
    })
    df = df.withColumn("handled", F.concat("made", "gone", "moved", "copied"))
    rest = F.filter("stat", lambda s: ~F.array_contains("handled", s[2]) & ends(new_path(s[2])))
    df = df.withColumn("rest", rest)
    counted = F.col("rest") if scope == "modified" else F.filter("stat", lambda s: ends(new_path(s[2])))
    number = lambda s: F.coalesce(s.try_cast("bigint"), F.lit(0).cast("bigint"))
    total = lambda i: F.aggregate(counted, F.lit(0).cast("bigint"), lambda a, s: a + number(s[i]))
    out = df.select(
        "commit_id", F.when(F.trim("parents") == "", F.array().cast("array<string>")).otherwise(F.split(F.trim("parents"), " ")).alias("parents"),
        "author_name", "author_email", "committer_name", "authored_timestamp",
        F.date_format(F.timestamp_seconds("authored_timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("authored_datetime"),
        F.date_format(F.timestamp_seconds("committed_timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("committed_datetime"),
        F.trim("message").alias("message"), "diff", issues(F.col("message")).alias("linked_issues"),
        F.filter("made", ends).alias("files_added_list"), F.filter("gone", ends).alias("files_deleted_list"),
        F.transform("rest", lambda s: new_path(s[2])).alias("files_modified_list"),
        F.filter(F.transform("moved", lambda p: F.struct(old_path(p).alias("old"), new_path(p).alias("new"))), lambda r: ends(r["new"])).alias("files_renamed_list"),
        F.filter(F.transform("copied", new_path), ends).alias("files_copied_list"),
        total(0).alias("lines_added"), total(1).alias("lines_deleted"),
        F.coalesce(F.array_max(F.transform(counted, lambda s: directory_depth(new_path(s[2])))), F.lit(0)).cast("long").alias("max_directory_depth"),
        F.octet_length("diff").cast("long").alias("commit_size_bytes"),
    )
    sizes = [F.size(c) for c in ("files_added_list", "files_deleted_list", "files_modified_list", "files_renamed_list", "files_copied_list")]
    return out.withColumn("files_changed_count", sum(sizes[1:], sizes[0]).cast("long")).where("files_changed_count > 0")
