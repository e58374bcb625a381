"""Fields that edits use: nested selection sets of queries, and nested options of calls on models.

A text is cut into tokens (names, brackets, strings, comments) and walked once by a machine with a stack of
open brackets. It gives out a tree: each used field with the field in whose braces it stands, or with the
type that the text itself names there. The type of everything else follows from a table of fields
(``typed``): level by level, a field's type is that of the field above it, looked up by an equi-join, for
all texts at once. What stands below a field without a known type says nothing and is left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.batches import map_batches
from quarry.session import kept

NODES = "doc string, block int, node int, parent int, given string, name string, line int, depth int"
TOKEN = re.compile(
    r"(?P<name>[A-Za-z_$][\w$]*)|(?P<string>\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`)"
    r"|(?P<spread>\.\.\.)|(?P<sign>[{}()\[\]:,@.!=|&])"
)
COMMENTS = {"#": re.compile(r"#[^\n]*"), "/": re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")}
TAGGED = re.compile(r"\b(?:gql|graphql)\s*`([^`]*)`")
SDL = ("type", "input", "enum", "interface", "union", "scalar", "extend", "schema", "directive")
ROOTS = {"query": "Query", "mutation": "Mutation", "subscription": "Subscription"}

# Receivers and methods of calls on models, and keys of their options that hold fields.
RECEIVERS = ("prisma", "tx", "db", "client", "trx")
METHODS = ("findUnique", "findFirst", "findMany", "create", "createMany", "update", "updateMany", "upsert", "delete", "deleteMany", "count", "aggregate", "groupBy")
OPTIONS = ("where", "select", "include", "data", "orderBy", "create", "update", "distinct", "by")
# Keys that stand between a relation or condition and its fields.
BETWEEN = ("AND", "OR", "NOT", "some", "every", "none", "is", "isNot")

CALL = re.compile(rf"\b(?:{'|'.join(RECEIVERS)})\s*\.\s*([a-z]\w*)\s*\.\s*({'|'.join(METHODS)})\s*(?=\()")
TABLE = re.compile(r"\b(?:db|tx|trx|conn)\s*\.\s*(?:insert|update|delete)\s*\(\s*([A-Za-z_]\w*)\s*[,)]|\bselect(?:Distinct(?:On)?)?\s*\([^)]*\)\s*\.\s*from\s*\(\s*([A-Za-z_]\w*)\s*[,)]")

Token = tuple[str, str, int]


def tokens(text: str, comment: str) -> list[Token]:
    """(kind, text, place) of the tokens; comments and all else are left out."""
    skip, out, at = COMMENTS[comment], [], 0
    while at < len(text):
        found = skip.match(text, at) if text[at] == comment else None
        if found:
            at = found.end()
            continue
        found = TOKEN.match(text, at)
        if found:
            out.append((found.lastgroup or "", found[0], at))
        at = found.end() if found else at + 1
    return out


def past(found: list[Token], i: int) -> int:
    """The place behind the bracket that closes the one at ``i``, or behind all."""
    depth = 0
    for j in range(i, len(found)):
        if found[j][0] == "sign":
            depth += (found[j][1] in "{([") - (found[j][1] in "})]")
            if depth == 0:
                return j + 1
    return len(found)


class Nodes:
    """Rows of one block as they are found."""

    def __init__(self, doc: str, block: int, text: str, first_line: int) -> None:
        self.doc, self.block, self.text, self.first_line = doc, block, text, first_line
        self.rows: list[tuple] = []

    def add(self, parent: tuple[int, int], given: str | None, name: str, place: int) -> tuple[int, int]:
        """``parent`` and the result are (node, depth)."""
        node, depth = len(self.rows), 0 if given else parent[1] + 1
        line = self.first_line + self.text.count("\n", 0, place)
        self.rows.append((self.doc, self.block, node, parent[0], given, name, line, depth))
        return node, depth


ROOT = (-1, -1)


def selections(text: str, nodes: Nodes) -> None:
    """Fields of the operations and fragments of a document; a schema has none."""
    found = tokens(text, "#")
    if any(kind == "name" and word in SDL and (i == 0 or found[i - 1][1] in ("}", ")")) for i, (kind, word, _) in enumerate(found)):
        return
    i, open_type = 0, "Query"
    # one entry for each open brace: (parent of the fields within, the type if the text names it, last field)
    stack: list[list] = []
    while i < len(found):
        kind, word, place = found[i]
        after = found[i + 1] if i + 1 < len(found) else ("", "", 0)
        if word == "(":
            i = past(found, i)
        elif word == "@":
            i += 2
        elif word == "{":
            if not stack:
                stack.append([ROOT, open_type, None])
            elif isinstance(stack[-1][2], str):  # an inline fragment on a type
                stack.append([ROOT, stack[-1][2], None])
            elif stack[-1][2] == ():  # one without a type
                stack.append([*stack[-1][:2], None])
            else:
                stack.append([stack[-1][2] or stack[-1][0], None, None])
            i += 1
        elif word == "}":
            if stack:
                stack.pop()
            open_type = open_type if stack else "Query"
            i += 1
        elif not stack:
            if word in ROOTS:
                open_type = ROOTS[word]
            elif word == "on" and after[0] == "name":
                open_type = after[1]
            i += 1
        elif kind == "spread":
            if after[1] == "on" and i + 2 < len(found):
                stack[-1][2] = found[i + 2][1]
                i += 3
            elif after[0] == "name":
                i += 2
            else:
                stack[-1][2] = ()
                i += 1
        elif kind == "name":
            if after[1] == ":" and i + 2 < len(found) and found[i + 2][0] == "name":
                i += 2
                _, word, place = found[i]
            parent, given, _ = stack[-1]
            # __typename and the like are everywhere
            stack[-1][2] = None if word.startswith("__") else nodes.add(parent, given, word, place)
            i += 1
        else:
            i += 1


def options(found: list[Token], i: int, model: str, nodes: Nodes) -> None:
    """Fields in the arguments that begin with the bracket at ``i``."""
    # (bracket, whose fields stand within, the model if it is the call's own, whether fields stand within)
    stack: list[tuple] = [(found[i][1], ROOT, model, False)]
    i += 1
    while i < len(found) and stack:
        kind, word, place = found[i]
        opener, parent, given, inside = stack[-1]
        if word == "(":  # a value that is computed
            i = past(found, i)
        elif word in ("{", "["):
            stack.append((word, parent, given, inside))
            i += 1
        elif word in ("}", ")", "]") and kind == "sign":
            stack.pop()
            i += 1
        elif opener == "{" and found[i - 1][1] in ("{", ",") and i + 1 < len(found) and found[i + 1][1] == ":" and kind in ("name", "string"):
            key = word.strip("\"'`") if kind == "string" else word
            opens = i + 2 < len(found) and found[i + 2][1] in ("{", "[")
            if opens and (key in OPTIONS or inside and key in BETWEEN):
                stack.append((found[i + 2][1], parent, given, True))
                i += 3
            elif inside:
                node = nodes.add(parent, given, key, place)
                if opens:
                    stack.append((found[i + 2][1], node, None, True))
                i += 3 if opens else 2
            else:  # an option without fields
                i = past(found, i + 2) if opens else i + 2
        elif inside and opener == "[" and kind == "string":  # names in a list, as of ``by``
            nodes.add(parent, given, word.strip("\"'`"), place)
            i += 1
        elif inside and opener == "{" and kind == "name" and found[i - 1][1] in ("{", ",") and (i + 1 == len(found) or found[i + 1][1] in (",", "}")):
            nodes.add(parent, given, word, place)  # a key and variable of one name
            i += 1
        else:
            i += 1


def _of_queries(doc: str, text: str) -> Iterator[tuple]:
    for block, found in enumerate(TAGGED.finditer(text)):
        nodes = Nodes(doc, block, found[1], 1 + text.count("\n", 0, found.start()))
        selections(found[1], nodes)
        yield from nodes.rows


def _of_calls(doc: str, text: str) -> Iterator[tuple]:
    found = tokens(text, "/")
    places = {place: i for i, (_, _, place) in enumerate(found)}
    for block, call in enumerate(CALL.finditer(text)):
        i = places.get(call.end())
        if i is None or call.start() not in places:  # within a string or comment
            continue
        nodes = Nodes(doc, block, text, 1)
        options(found, i, call[1][0].upper() + call[1][1:], nodes)
        yield from nodes.rows


def _walked(texts: DataFrame, walk: Callable[[str, str], Iterator[tuple]]) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(NODES))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [row for doc, text in zip(*(c.to_pylist() for c in part.columns), strict=True) if text for row in walk(doc, text)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return of

    return map_batches(texts.select(F.col("doc").cast("string").alias("doc"), "text"), ["doc", "text"], NODES, make)


def query_fields(texts: DataFrame) -> DataFrame:
    """``NODES`` of the tagged query templates of texts (doc, text)."""
    return _walked(texts, _of_queries)


def call_fields(texts: DataFrame) -> DataFrame:
    """``NODES`` of the calls on models of texts (doc, text)."""
    return _walked(texts, _of_calls)


def base_type(written: Column) -> Column:
    """The name in a type as written, without lists and marks."""
    return F.regexp_extract(written, r"([A-Za-z_]\w*)", 1)


def typed(nodes: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc, block, node, model, name, line) of the nodes whose type is known, in ``fields`` (model, name, type).

    Nodes of given types begin; each further level takes its model from the type of the field above, if that
    is a model with fields. Texts are walked once, and levels are written down as they are found, so that each
    is one join of its own however deep texts go; a level without rows is the last.
    """
    nodes = kept(nodes)
    depth = nodes.agg(F.max("depth")).first()[0]
    columns = ["doc", "block", "node", "model", "name", "line"]
    level = nodes.filter("depth = 0").withColumnRenamed("given", "model").select(*columns)
    models = fields.select(F.col("model").alias("t")).distinct()
    # a table of known size: few types are sent to the nodes, which would else meet by names that most texts share
    types = kept(fields.select(F.col("model").alias("m"), F.col("name").alias("f"), base_type(F.col("type")).alias("t")).distinct().join(models, "t", "left_semi"))
    out = level
    for at in range(1, (depth or 0) + 1):
        above = level.select("doc", "block", F.col("node").alias("parent"), F.col("model").alias("m"), F.col("name").alias("f")).join(types, ["m", "f"])
        level = kept(nodes.filter(F.col("depth") == at).join(above, ["doc", "block", "parent"]).withColumnRenamed("t", "model").select(*columns))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def tables_used(texts: DataFrame) -> DataFrame:
    """(doc, name) of tables that chains of a query builder name."""
    found = F.regexp_extract_all("text", F.lit(TABLE.pattern), F.lit(0))
    name = F.coalesce(F.nullif(F.regexp_extract("x", TABLE.pattern, 1), F.lit("")), F.regexp_extract("x", TABLE.pattern, 2))
    return texts.select("doc", F.explode(found).alias("x")).select("doc", name.alias("name")).distinct()


FIELDS = "model string, name string, type string"


def schema_fields(texts: DataFrame) -> DataFrame:
    """(model, name, type) of the types, inputs and interfaces that schema texts (doc, text) declare."""
    schema = to_arrow_schema(StructType.fromDDL(FIELDS))

    def rows_of(text: str) -> Iterator[tuple]:
        found = tokens(text, "#")
        i, model = 0, None
        while i < len(found):
            kind, word, _ = found[i]
            if model is None and kind == "name" and word in ("type", "input", "interface") and i + 1 < len(found):
                name, i = found[i + 1][1], i + 2
                while i < len(found) and found[i][1] != "{" and found[i][1] not in SDL:
                    i += 1
                if i < len(found) and found[i][1] == "{":
                    model, i = name, i + 1
            elif word == "}":
                model, i = None, i + 1
            elif model and kind == "name":
                i += 1
                if i < len(found) and found[i][1] == "(":
                    i = past(found, i)
                if i < len(found) and found[i][1] == ":":
                    first = i = i + 1
                    while i < len(found) and (found[i][1] in ("[", "]", "!") or i == first or found[i - 1][1] == "["):
                        i += 1
                    yield model, word, "".join(t for _, t, _ in found[first:i])
            elif word == "@":
                i += 2
                i = past(found, i) if i < len(found) and found[i][1] == "(" else i
            else:
                i = past(found, i) if word in ("{", "(") else i + 1

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [row for text in part.column(0).to_pylist() if text for row in rows_of(text)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        return of

    return map_batches(texts.select("text"), ["text"], FIELDS, make)
