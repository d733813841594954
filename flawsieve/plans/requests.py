"""A table of scan requests, answered together.

A request is a JSON object ``{"method": ..., "params": {...}}``:

* ``analyze_code``: ``code`` and optional ``filename``;
* ``analyze_file``: ``file_content`` if it is not empty, else the file at ``file_path``;
* ``analyze_repository``: all source files under ``repo_path``.

However many requests name a file, it is scanned once; what the requests meet are counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalogue import DEFAULT_CATALOGUE
from ..operators.report import COUNTED, severity_counts
from ..sources.files import is_source_file
from ..sources.staging import staged
from .scan import scan

REQUEST_SCHEMA = ("method string, params struct<file_path:string,file_content:string,"
                  "code:string,filename:string,repo_path:string>")
_COUNTS = ["total_findings", *[f"{s.lower()}_count" for s in COUNTED]]


def parse_requests(requests: DataFrame, request: str = "request") -> DataFrame:
    """``(request_id, method, error, file, content, kind, target)``.

    ``content`` is set where the text came with the request; otherwise ``kind`` and ``target``
    say what to look up.
    """
    r = F.from_json(request, REQUEST_SCHEMA, {"mode": "PERMISSIVE"})
    p = F.col("r.params")
    method = F.coalesce("r.method", F.lit(""))
    path = F.coalesce(p.file_path, F.lit(""))
    by_content = (method == "analyze_file") & (F.coalesce(p.file_content, F.lit("")) != "")
    by_path = (method == "analyze_file") & ~by_content
    is_json = F.try_parse_json(request).isNotNull()
    return requests.select("request_id", r.alias("r"), is_json.alias("is_json")).select(
        "request_id", method.alias("method"),
        F.when(~F.col("is_json"), "invalid JSON")
        .when(~method.isin("analyze_file", "analyze_code", "analyze_repository"),
              F.concat(F.lit("unknown method: "), method)).alias("error"),
        F.when(method == "analyze_code", F.coalesce(p.filename, F.lit("code.py")))
        .when(by_content, F.regexp_extract(path, r"([^/]*)$", 1)).alias("file"),
        F.when(method == "analyze_code", F.coalesce(p.code, F.lit("")))
        .when(by_content, p.file_content).alias("content"),
        F.when(by_path, "file").when(method == "analyze_repository", "directory")
        .alias("kind"),
        F.when(by_path, path)
        .when(method == "analyze_repository", _directory(F.coalesce(p.repo_path, F.lit("."))))
        .alias("target"))


def _directory(path: Column) -> Column:
    """Without ``./`` in front and ``/`` behind; ``.`` for the whole table."""
    trimmed = F.regexp_replace(F.regexp_replace(path, r"^(\./)+", ""), r"/+$", "")
    return F.when(trimmed.isin("", "."), ".").otherwise(trimmed)


def _targets(path: Column, source: Column) -> Column:
    """What can be asked for to get a file: the file, and each directory above it."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    folders = F.transform(
        F.when(depth > 1, F.sequence(F.lit(1), depth - 1)).otherwise(F.array().cast("array<int>")),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    as_target = lambda kind: lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target"))
    return F.concat(
        F.array(as_target("file")(path)),
        F.when(source, F.transform(F.concat(F.array(F.lit(".")), folders),
                                   as_target("directory")))
        .otherwise(F.array().cast("array<struct<kind:string,target:string>>")))


def answer_requests(requests: DataFrame, files: DataFrame, catalogue=DEFAULT_CATALOGUE,
                    request: str = "request") -> DataFrame:
    """One row per request: its error, or the counts of its report.

    Requests are parsed once, and each text that is asked for, in a request or a file, is scanned
    once, in one scan.  All the rest is done on the small tables of requests, paths and counts; a
    directory, also the one of all files, is summed up in each task before anything is shuffled.
    """
    parsed = staged(parse_requests(requests, request))
    valid = parsed.where("error IS NULL")
    inline = valid.where("content IS NOT NULL")
    lookups = valid.where("content IS NULL").select("request_id", "kind", "target")
    asked = lookups.select("kind", "target").distinct()
    size = F.col("size") if "size" in files.columns else F.octet_length("content")
    source = is_source_file(F.col("path"), size)
    # Which files are asked for is settled on paths; texts only pass the semi join.  Paths
    # and answers may be as many as the files, so they are merged and not broadcast.
    met = staged(files.select("path", F.inline(_targets(F.col("path"), source))).join(
        asked, ["kind", "target"]))
    request_id = parsed.schema["request_id"].dataType
    texts = files.select(
        F.lit(None).cast(request_id).alias("request_id"), F.col("path").alias("key"), "path",
        "content").join(met.select("path").hint("merge"), "path", "left_semi").unionByName(inline.select(
            "request_id", F.lit(None).cast("string").alias("key"), F.col("file").alias("path"),
            "content"))
    counts = staged(scan(texts, catalogue, keep=("request_id", "key")).groupBy(
        "request_id", "key").agg(F.count("*").alias("total_findings"), *severity_counts()))
    inline_answers = inline.select("request_id").join(
        counts.where("key IS NULL").drop("key").hint("merge"), "request_id", "left").withColumn(
        "files_scanned", F.lit(1).cast("long"))
    # A path that several files have is one key of the counts.
    paths = met.groupBy("kind", "target", "path").agg(F.count("*").alias("n"))
    found = paths.join(counts.where("key IS NOT NULL").select(
        F.col("key").alias("path"), *_COUNTS).hint("merge"), "path", "left").groupBy("kind", "target").agg(
        *[F.sum(c).alias(c) for c in _COUNTS], F.sum("n").alias("files_scanned"))
    looked_up = lookups.join(found, ["kind", "target"], "left")

    answers = inline_answers.select("request_id", *_COUNTS, "files_scanned").unionByName(
        looked_up.select("request_id", *_COUNTS, "files_scanned"))
    missing = (F.col("error").isNull() & F.col("files_scanned").isNull())
    return parsed.join(answers.hint("merge"), "request_id", "left").select(
        "request_id", "method",
        F.when(missing & (F.col("kind") == "file"),
               F.concat(F.lit("file not found: "), F.col("target")))
        .when(missing, F.concat(F.lit("no such directory: "), F.col("target")))
        .otherwise(F.col("error")).alias("error"),
        *[F.when(F.col("files_scanned").isNotNull(), F.coalesce(c, F.lit(0).cast("long")))
          .alias(c) for c in _COUNTS], "files_scanned")
