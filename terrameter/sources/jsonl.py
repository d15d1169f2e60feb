"""JSON Lines features and manifests, read strictly.

A line must be an object with unique keys, no NaN or Infinity and bounded depth; a file is bounded in
size and rows and ends with a line's end; its rows must be in feature order and agree with the
manifest's counts.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Limits


def nesting(value: object) -> tuple[int, int]:
    """(depth, number of values) of parsed JSON; an explicit stack, so depth cannot overflow it."""
    deepest = count = 0
    todo = [(value, 1)]
    while todo:
        v, depth = todo.pop()
        count += 1
        deepest = max(deepest, depth)
        if isinstance(v, dict):
            todo += [(x, depth + 1) for x in v.values()]
        elif isinstance(v, list):
            todo += [(x, depth + 1) for x in v]
    return deepest, count


#: Longest key and number that either form of the check takes, those of the JVM's parser.
_KEY_CHARS, _NUMBER_CHARS = 50_000, 1000


def _unique(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs) or any(len(k) > _KEY_CHARS for k in out):
        raise ValueError("repeated or overlong key")
    return out


def _constant(name: str) -> None:
    raise ValueError(name)


def _number(digits: str, kind: type = float) -> float:
    value = kind(digits) if len(digits) <= _NUMBER_CHARS else math.inf
    if value in (math.inf, -math.inf):
        raise ValueError("a number is too large")
    return value


def _integer(digits: str) -> int:
    return _number(digits, int)


# A JSON string, without backtracking; what is left of a line without them is structure.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def too_deep(line: str, depth: int) -> bool:
    """Whether brackets nest deeper than ``depth``, in a line that need not be balanced."""
    left = re.sub(r"[^\[\]{}]", "", re.sub(_STRING, "", line, flags=re.DOTALL))
    for _ in range(depth):
        left = re.sub(r"[\[{][\]}]", "", left)
    return re.search(r"[\[{][\]}]", left) is not None or left.count("[") + left.count("{") > depth


def strict_json(text: str) -> object:
    """The value of a JSON text; ValueError for repeated or overlong keys, and for numbers that are not finite or overlong."""
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_constant, parse_float=_number, parse_int=_integer)


def problem_of(line: str | bytes | None, limits: Limits = Limits()) -> str | None:
    """Why a line is no acceptable feature, or None.  White space is JSON's: space, tab and line ends."""
    raw = line.encode("utf-8", "surrogatepass") if isinstance(line, str) else line
    if raw is None or not raw.strip(b" \t\r\n"):
        return "blank"
    if len(raw) > limits.feature_json_bytes:
        return "too_long"
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return "malformed"
    if too_deep(text, limits.json_depth):  # before parsing, so that no depth reaches the parser's recursion
        return "too_deep"
    try:
        value = strict_json(text)
    except (ValueError, RecursionError):
        return "malformed"
    if not isinstance(value, dict):
        return "no_object"
    return "too_many_values" if nesting(value)[1] > limits.json_values else None


def _brackets(levels: int) -> str:
    """Pattern of a pair of brackets that holds nothing but pairs, ``levels`` deep at most."""
    inner = ""
    for _ in range(levels):
        inner = rf"[\[{{](?:{inner})*+[\]}}]" if inner else r"[\[{][\]}]"
    return inner


# Tokens that stand for strings and for other values once these are recognised; neither may be in a line.
_TEXT, _VALUE = "\x01", "\x02"
_STRICT_STRING = r'"[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+"'
_DIGITS = r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_SCALAR = rf"(?<![^ \t\r\n,:\[{{])(?:true|false|null|{_DIGITS})(?![^ \t\r\n,\]}}])"
_LEVELS = 3


def _container(levels: int) -> str:
    """Pattern of an object or array of tokens and of containers, ``levels`` deep at most.

    After a value comes a comma and more, or the closing bracket; possessive, so it neither backtracks
    nor recurses however long a list is.
    """
    value = f"[{_TEXT}{_VALUE}]" if levels == 1 else f"(?:[{_TEXT}{_VALUE}]|{_container(levels - 1)})"
    return rf"(?:\{{(?:{_TEXT}:{value}(?:,(?={_TEXT})|(?=\}})))*+\}}|\[(?:{value}(?:,(?!\])|(?=\])))*+\])"


def strict_problem(line: Column, limits: Limits = Limits()) -> Column:
    """Column form of ``problem_of``, inside the JVM; ``line`` may be a string of any bytes.

    Strings and then other scalars become tokens, and containers of tokens become a token, some levels
    at a time; a line is well formed if one token is left.  The numbers of tokens, colons and openings
    give the number of values.  The variant parser, which stops after the first value, is only asked
    whether keys repeat.
    """
    structure = F.regexp_replace(line, f"(?s){_STRING}", "")
    left = F.regexp_replace(structure, r"[^\[\]{}]", "")
    for levels in [8] * (limits.json_depth // 8) + [limits.json_depth % 8]:
        left = F.regexp_replace(left, _brackets(levels), "") if levels else left
    # without more openings than levels no line is deep
    deep = (F.length(F.regexp_replace(structure, r"[^\[{]", "")) > limits.json_depth) & left.rlike(rf"[\[{{][\]}}]|(?:[\[{{][^\[{{]*){{{limits.json_depth + 1}}}")
    texts = F.regexp_replace(line, _STRICT_STRING, _TEXT)
    tokens = F.regexp_replace(F.regexp_replace(texts, _SCALAR, _VALUE), r"[ \t\r\n]", "")

    def verdict(t: Column) -> Column:
        openings = F.length(t) - F.length(F.translate(t, "[{", ""))
        values = F.length(t) - F.length(F.translate(t, f"{_TEXT}{_VALUE}[{{", "")) - (F.length(t) - F.length(F.translate(t, ":", "")))
        rounds = F.least(openings, F.lit(limits.json_depth + _LEVELS - 1)) / _LEVELS
        one = F.aggregate(F.sequence(F.lit(0), rounds.cast("int")), t, lambda x, _: F.regexp_replace(x, _container(_LEVELS), _VALUE))
        formed = F.length(one) == 1
        return F.when(~(formed & ((one == _TEXT) | (one == _VALUE))), "malformed").when(F.try_parse_json(line).isNull(), "malformed").when(~t.startswith("{"), "no_object").when(values > limits.json_values, "too_many_values")

    numbers = F.regexp_extract_all(texts, F.lit(f"({_DIGITS})"), 1)
    huge = texts.rlike(r"[eE]\+?0*[1-9][0-9]{2}|[0-9]{300}") & F.exists(numbers, lambda x: (F.length(x) > _NUMBER_CHARS) | x.rlike("[.eE]") & (F.abs(x.try_cast("double")) == float("inf")))
    foreign = ~F.is_valid_utf8(line) | line.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    blank = F.coalesce(F.trim(line, F.lit(" \t\r\n")), F.lit("")) == ""
    long = F.octet_length(line) > limits.feature_json_bytes
    return (
        F.when(blank, "blank").when(long, "too_long").when(~F.is_valid_utf8(line), "malformed").when(deep, "too_deep").when(foreign | huge, "malformed")
        .otherwise(F.transform(F.array(tokens), verdict)[0])
    )


def _files(spark: SparkSession, source: str | DataFrame, limits: Limits) -> DataFrame:
    """(file, lines, file_problem) of every file that has a byte; files beyond the limit are never read.

    ``source``: a path, or scanned files with path, length and content (null where the length is beyond the
    limit).  A file is bounded, so one task splits it: its rows, its last line's end and its size are known
    without moving a line.
    """
    files = spark.read.format("binaryFile").load(source) if isinstance(source, str) else source
    text = F.col("content").cast("string")
    # splitting makes characters of bytes: those that are none go through an encoding with one for each byte
    bytewise = F.transform(F.split(F.decode("content", "ISO-8859-1"), "\n", -1), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    parts = F.when(F.is_valid_utf8(text), F.split(text, "\n", -1)).otherwise(bytewise)
    fine = files.where(F.col("length") <= limits.output_bytes).select(F.col("path").alias("file"), parts.alias("parts"))
    ended = F.element_at("parts", -1) == ""
    lines = F.when(ended, F.slice("parts", F.lit(1), F.size("parts") - 1)).otherwise(F.col("parts"))
    fine = fine.select("file", lines.alias("lines"), ended.alias("ended"))
    fine = fine.select("file", "lines", F.when(F.size("lines") > limits.features, "too_many_rows").when(~F.col("ended"), "truncated").alias("file_problem"))
    large = files.where(F.col("length") > limits.output_bytes).select(F.col("path").alias("file"), F.lit(None).cast("array<string>").alias("lines"), F.lit("too_large").alias("file_problem"))
    return fine.unionByName(large)


def read_feature_lines(spark: SparkSession, source: str | DataFrame, schema: str, limits: Limits = Limits()) -> DataFrame:
    """Parsed features of JSON Lines files (a path or scanned files) with ``problem``; rows keep their own feature_index.

    A problem of a whole file (see ``file_problems``) is that of each of its rows; a file that is too
    large to be read has one row.
    """
    rows = _files(spark, source, limits).select("file_problem", F.explode_outer("lines").alias("value"))
    rows = rows.withColumn("problem", F.coalesce("file_problem", strict_problem(F.col("value"), limits)))
    return rows.select("problem", F.when(F.col("problem").isNull(), F.from_json("value", schema)).alias("feature")).select("problem", "feature.*")


def file_problems(spark: SparkSession, source: str | DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(file, rows, file_problem) of every file that has a byte.

    too_large: beyond the limit in bytes (and its rows unknown); too_many_rows; truncated: the last
    line has no end.
    """
    return _files(spark, source, limits).select("file", F.when(F.col("lines").isNotNull(), F.size("lines")).cast("long").alias("rows"), "file_problem")


def protocol_problem(features: DataFrame, manifest: dict) -> DataFrame:
    """One row: null, or the first way in which features and manifest disagree."""
    statuses = {s: F.count_if(F.col("measurement_status") == s) for s in ("MEASURED", "NOT_APPLICABLE", "UNSUPPORTED", "ERROR")}
    seen = features.agg(
        F.count("*").alias("n"), F.count_if(F.col("problem").isNotNull()).alias("bad"), F.min("feature_index").alias("lo"), F.max("feature_index").alias("hi"), F.count_distinct("feature_index").alias("ids"),
        *[c.alias(s) for s, c in statuses.items()],
    )
    keys = {"MEASURED": "measured_count", "NOT_APPLICABLE": "not_applicable_count", "UNSUPPORTED": "unsupported_count", "ERROR": "error_count"}
    wrong = F.lit(False)
    for status, key in keys.items():
        wrong = wrong | (F.col(status) != int(manifest[key]))
    n = int(manifest["feature_count"])
    order = (F.col("n") > 0) & ((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("ids") != F.col("n")))
    return seen.select(F.when(F.col("bad") > 0, "malformed_feature").when(F.col("n") != n, "feature_count").when(order, "feature_order").when(wrong, "status_counts").alias("problem"))


def read_manifest(spark: SparkSession, path: str, limits: Limits = Limits()) -> dict:
    """One manifest; ValueError if it is too large, not strict JSON or not in a known final state."""
    rows = spark.read.text(path, wholetext=True).withColumn("size", F.octet_length("value")).limit(2).collect()
    if len(rows) != 1 or rows[0]["size"] > limits.manifest_bytes:
        raise ValueError("no manifest of an acceptable size")
    value = strict_json(rows[0]["value"])
    counts = ["feature_count", "measured_count", "not_applicable_count", "unsupported_count", "error_count"]
    done = isinstance(value, dict) and value.get("status") == "COMPLETED"
    if not done and not (isinstance(value, dict) and value.get("status") == "FAILED" and value.get("failure")):
        raise ValueError("no final state")
    if done and (not all(isinstance(value.get(c), int) and value[c] >= 0 for c in counts) or value["feature_count"] != sum(value[c] for c in counts[1:])):
        raise ValueError("the counters disagree")
    return value


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One row as JSON, nulls included; the committer makes the folder appear whole."""
    manifest.select(F.to_json(F.struct(*manifest.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)
