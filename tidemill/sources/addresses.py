"""Files addressed inside SQL: ``FROM 'orders.csv'`` and ``FROM read_json_auto('data/*.json')``."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from .files import format_of, read_source

#: Comments and white space, strings, quoted names, words and numbers, any other character.
_TOKEN = re.compile(r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|''|\\.)*')|(?P<name>`(?:[^`]|``)*`|"(?:[^"]|"")*")|(?P<word>[\w$]+)|(?P<sign>.)""", re.S)

#: Functions that read files, by format; their options by Spark's names.
READERS = {"read_csv": "csv", "read_csv_auto": "csv", "read_json": "json", "read_json_auto": "json", "read_parquet": "parquet", "parquet_scan": "parquet"}
OPTIONS = {"delim": "sep", "sep": "sep", "header": "header", "quote": "quote", "escape": "escape", "nullstr": "nullValue", "dateformat": "dateFormat", "timestampformat": "timestampFormat", "comment": "comment"}
#: Words after which no further relation of a FROM clause comes, and those that may follow a relation but are no alias of it.
_ENDS = {"WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "QUALIFY", "SELECT", "CLUSTER", "DISTRIBUTE", "SORT", "SET", "VALUES"}
_FOLLOW = _ENDS | {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "SEMI", "ANTI", "ON", "USING", "LATERAL", "PIVOT", "UNPIVOT", "FROM"}


def _unquoted(text: str) -> str:
    return text[1:-1].replace("''", "'")


class _Level:
    """What is known of a pair of parentheses: whether it is a query, and whether a relation comes next in its FROM clause."""

    def __init__(self, fresh: bool, due: bool):
        self.fresh, self.query, self.clause, self.due = fresh, False, due, due


def addresses(sql: str) -> Iterator[tuple[int, int, str | None, list[str], dict]]:
    """(start, end, format or None, paths, options) of each file named where a relation stands; strings elsewhere are values."""
    tokens = [m for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]
    levels, k = [_Level(True, False)], 0
    while k < len(tokens):
        kind, own, level = tokens[k].lastgroup, tokens[k].group(), levels[-1]
        word = own.upper() if kind == "word" else own
        if level.due and kind == "text":
            yield tokens[k].start(), tokens[k].end(), None, [_unquoted(own)], {}
            level.due = False
        elif level.due and kind == "word" and own.lower() in READERS and k + 1 < len(tokens) and tokens[k + 1].group() == "(":
            end, paths, options = _arguments(tokens, k + 2)
            yield tokens[k].start(), tokens[end].end(), READERS[own.lower()], paths, options
            level.due, k = False, end
        elif own == "(":
            # in a relation's place a parenthesis holds a query or more relations; elsewhere perhaps a query
            levels.append(_Level(True, level.due))
            level.due = False
        elif own == ")":
            if len(levels) > 1:
                levels.pop()
        elif kind == "word" and word in ("FROM", "JOIN"):
            before = tokens[k - 1].group().upper() if k else ""
            compared = word == "FROM" and before == "DISTINCT" and k > 1 and tokens[k - 2].group().upper() in ("IS", "NOT")
            if not compared and (word == "JOIN" or level.query or level.fresh):
                level.query = level.clause = level.due = True
        elif kind == "word" and word in ("SELECT", "WITH"):
            level.query, level.clause, level.due = True, False, False
        elif own == ",":
            level.due = level.clause
        elif own == ";":
            levels = [_Level(True, False)]
            k += 1
            continue
        else:
            level.clause = level.clause and word not in _ENDS
            level.due = level.due and word == "LATERAL"
        levels[-1].fresh = levels[-1].fresh and own == "("
        k += 1


def _arguments(tokens: list, k: int) -> tuple[int, list[str], dict]:
    """Place of the closing parenthesis, paths (a string or a list of strings) and options (name = value) of a reader's call."""
    paths, options, depth, name = [], {}, 0, None
    while k < len(tokens):
        kind, own = tokens[k].lastgroup, tokens[k].group()
        if own == ")" and not depth:
            return k, paths, options
        if own in ("[", "]"):
            depth += 1 if own == "[" else -1
        elif kind == "word" and k + 1 < len(tokens) and tokens[k + 1].group() in ("=", ":"):
            name, k = own.lower(), k + (2 if tokens[k + 1 : k + 3] and tokens[k + 1].group() == ":" else 1)
        elif kind in ("text", "word"):
            value = _unquoted(own) if kind == "text" else own.lower()
            if name is None:
                paths.append(value)
            else:
                options[name], name = value, None
        k += 1
    raise ValueError("the call of a file reader is not closed")


def _frame(spark: SparkSession, fmt: str, paths: list[str], options: Mapping, schema) -> DataFrame:
    unknown = set(options) - set(OPTIONS)
    if unknown:
        raise ValueError(f"options of a file in SQL that are not supported: {', '.join(sorted(unknown))}")
    given = {OPTIONS[k]: v for k, v in options.items()}
    if fmt == "json" and "multiLine" not in given:
        given["multiLine"] = str(not _json_lines(spark, paths)).lower()
    return read_source(spark, paths if len(paths) > 1 else paths[0], fmt, schema, **given)


def _json_lines(spark: SparkSession, paths: list[str]) -> bool:
    """Whether a file holds an object a line: its first line that is not blank is one. Else it is one document."""
    first = spark.read.text(paths).filter("trim(value) != ''").limit(1).first()
    try:
        return first is None or isinstance(json.loads(first["value"]), dict)
    except ValueError:
        return False


def with_files(spark: SparkSession, sql: str, schemas: Mapping | None = None) -> str:
    """The statement with each file it addresses bound as a view of the right reader, under the file's name unless it has an alias.

    A file is a string, or a call of one of :data:`READERS`, where a relation stands: after FROM, JOIN or a comma of a FROM clause. All other
    strings stay as they are, and so do strings whose suffix is of no known format. Types of CSV and JSON are inferred, by
    a pass over the file, unless ``schemas`` has one for the path. Nothing else is read before the statement runs.
    """
    out, at = [], 0
    for start, end, fmt, paths, options in addresses(sql):
        fmt = fmt or (format_of(paths[0], "") if paths else "")
        if not fmt:
            continue
        view = "file_" + hashlib.sha256(json.dumps([fmt, paths, options]).encode()).hexdigest()[:24]
        _frame(spark, fmt, paths, options, (schemas or {}).get(paths[0])).createOrReplaceTempView(view)
        after = next((m for m in _TOKEN.finditer(sql, end) if m.lastgroup != "space"), None)
        named = after is not None and (after.lastgroup == "name" or after.lastgroup == "word" and after.group().upper() not in _FOLLOW)
        stem = paths[0].rstrip("/").rsplit("/", 1)[-1].split(".")[0].replace("`", "")
        out += [sql[at:start], view, "" if named or not re.search(r"\w", stem) else f" AS `{stem}`"]
        at = end
    return "".join([*out, sql[at:]])
