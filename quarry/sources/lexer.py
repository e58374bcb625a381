"""Symbols of source files by a lexer with scopes: name, kind, parent, signature, line; and typed receivers.

A table has for each language what its comments and strings look like and which words declare. First a
text is masked: comments and the inside of strings become blanks, so nothing in them opens a scope or
declares. A machine then walks the rest once with a stack of scopes: braces, or ``end`` words, or indents. A
declaration waits for the scope that it opens; what is declared directly in a type is its member.

A receiver's type is what the same file says of it: its annotation, its constructor, or its own name if that
is a type. A call on it is then looked up as a member of that type alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.batches import map_batches

NAME = r"[A-Za-z_$][\w$]*"
C_LIKE = r"//[^\n]*|/\*[\s\S]*?\*/"
DOUBLE, SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
TYPES = ("class", "interface", "struct", "enum", "trait", "record", "object", "module", "namespace", "protocol")
#: Words before a bracket that are no functions, in any of the languages.
NOT_CALLED = ("if", "for", "while", "switch", "catch", "return", "new", "using", "lock", "synchronized", "when", "match", "else", "function", "throw", "await", "super", "typeof", "sizeof", "foreach", "elseif")


@dataclass(frozen=True)
class Language:
    extensions: tuple[str, ...]
    #: What is masked: comments whole, strings but for their marks.
    comments: str
    strings: str
    #: (kind, pattern) of declarations; group ``name``, and ``owner`` where the text names the type.
    declares: tuple[tuple[str, str], ...]
    scopes: str = "braces"
    #: Patterns of (variable, type), groups ``v`` and ``t``.
    typed: tuple[str, ...] = field(default=())


_NEW = rf"\b(?P<v>{NAME})\s*=\s*new\s+(?P<t>[A-Z][\w$]*)"
_DECLARED = rf"\b(?P<t>[A-Z][\w$]*)(?:<[^<>;(){{}}]*>)?\s+(?P<v>{NAME})\s*(?=[=;,):])"
_COLON = rf"\b(?P<v>{NAME})\s*\??\s*:\s*(?P<t>[A-Z][\w$]*)"
_METHOD = rf"(?:^|(?<=[{{}};]))[ \t]*(?:[\w$<>\[\],.?@]+[ \t]+)*(?P<name>{NAME})\s*(?:<[^<>(){{}};]*>)?\([^;{{}}]*\)[^;{{}}()=]*(?=\{{)"

LANGUAGES = {
    "javascript": Language(
        ("js", "jsx", "mjs", "cjs", "ts", "tsx"), C_LIKE, rf"{DOUBLE}|{SINGLE}|`(?:[^`\\]|\\[\s\S])*`",
        (("type", rf"\b(?P<kind>class|interface|enum|namespace)\s+(?P<name>{NAME})"), ("function", rf"\bfunction\s*\*?\s*(?P<name>{NAME})"),
         ("function", rf"\b(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=;{{}}]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{NAME})\s*(?::[^=;{{}}]+)?=>"), ("method", _METHOD)),
        typed=(_NEW, _COLON),
    ),
    "java": Language(("java",), C_LIKE, rf'"""[\s\S]*?"""|{DOUBLE}|{SINGLE}', (("type", rf"\b(?P<kind>class|interface|enum|record)\s+(?P<name>{NAME})"), ("method", _METHOD)), typed=(_DECLARED, _NEW)),
    "csharp": Language(("cs",), C_LIKE, rf'@"(?:[^"]|"")*"|{DOUBLE}|{SINGLE}', (("type", rf"\b(?P<kind>class|interface|enum|struct|record|namespace)\s+(?P<name>{NAME}(?:\.{NAME})*)"), ("method", _METHOD)), typed=(_DECLARED, _NEW)),
    "kotlin": Language(
        ("kt", "kts"), C_LIKE, rf'"""[\s\S]*?"""|{DOUBLE}|{SINGLE}',
        (("type", rf"\b(?P<kind>class|interface|object)\s+(?P<name>{NAME})"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:(?P<owner>[A-Z][\w$]*)\.)?(?P<name>{NAME})")),
        typed=(rf"\b(?:val|var)\s+(?P<v>{NAME})\s*=\s*(?P<t>[A-Z][\w$]*)\(", _COLON),
    ),
    "go": Language(
        ("go",), C_LIKE, rf"{DOUBLE}|`[^`]*`|{SINGLE}",
        (("type", rf"\btype\s+(?P<name>{NAME})\s+(?P<kind>struct|interface)"), ("function", rf"\bfunc\s+(?:\(\s*\w*\s*\*?(?P<owner>{NAME})[^)]*\)\s*)?(?P<name>{NAME})")),
        typed=(rf"\b(?P<v>{NAME})\s*:?=\s*&?(?P<t>[A-Z]\w*)\{{", rf"\bvar\s+(?P<v>{NAME})\s+\*?(?P<t>[A-Z]\w*)", rf"[(,]\s*(?P<v>{NAME})\s+\*?(?P<t>[A-Z]\w*)(?=\s*[,)])"),
    ),
    "rust": Language(
        ("rs",), C_LIKE, rf'r#*"[\s\S]*?"#*|{DOUBLE}|' + r"'(?:[^'\\\n]|\\.)'",
        (("type", rf"\b(?P<kind>struct|enum|trait|mod)\s+(?P<name>{NAME})"), ("impl", rf"\bimpl\b(?:\s*<[^{{;]*?>)?\s+(?:[\w:<>, ]+?\s+for\s+)?(?P<name>{NAME})"), ("function", rf"\bfn\s+(?P<name>{NAME})")),
        typed=(rf"\blet\s+(?:mut\s+)?(?P<v>{NAME})\s*(?::[^=;]+)?=\s*(?P<t>[A-Z]\w*)(?:::|\s*\{{)", rf"\b(?P<v>{NAME})\s*:\s*&?(?:mut\s+)?(?P<t>[A-Z]\w*)"),
    ),
    "php": Language(("php",), rf"{C_LIKE}|#[^\n]*", rf"{DOUBLE}|{SINGLE}", (("type", rf"\b(?P<kind>class|interface|trait|enum)\s+(?P<name>{NAME})"), ("function", rf"\bfunction\s+&?(?P<name>{NAME})")), typed=(r"(?P<v>\$\w+)\s*=\s*new\s+(?P<t>[A-Z]\w*)", r"\b(?P<t>[A-Z]\w*)\s+(?P<v>\$\w+)")),
    "swift": Language(("swift",), C_LIKE, rf'"""[\s\S]*?"""|{DOUBLE}', (("type", rf"\b(?P<kind>class|struct|enum|protocol|extension)\s+(?P<name>{NAME})"), ("function", rf"\bfunc\s+(?P<name>{NAME})")), typed=(rf"\b(?:let|var)\s+(?P<v>{NAME})\s*=\s*(?P<t>[A-Z]\w*)\(", _COLON)),
    "scala": Language(("scala",), C_LIKE, rf'"""[\s\S]*?"""|{DOUBLE}', (("type", rf"\b(?P<kind>class|trait|object)\s+(?P<name>{NAME})"), ("function", rf"\bdef\s+(?P<name>{NAME})")), typed=(rf"\b(?:val|var)\s+(?P<v>{NAME})\s*=\s*new\s+(?P<t>[A-Z]\w*)", _COLON)),
    "cpp": Language(("c", "h", "cc", "cpp", "hpp"), C_LIKE, rf"{DOUBLE}|{SINGLE}", (("type", rf"\b(?P<kind>class|struct|enum|namespace)\s+(?P<name>{NAME})(?=[^;(){{}}]*\{{)"), ("method", _METHOD.replace("(?P<name>", r"(?:[*&]\s*)?(?:(?P<owner>[A-Za-z_]\w*)::)?(?P<name>"))), typed=(_DECLARED.replace(r"\s+(?P<v>", r"\s*[*&\s]\s*(?P<v>"),)),
    "ruby": Language(("rb",), r"#[^\n]*|(?m:^=begin[\s\S]*?^=end)", rf"{DOUBLE}|{SINGLE}", (("type", r"^[ \t]*(?P<kind>class|module)\s+(?P<name>[A-Z]\w*)"), ("function", r"^[ \t]*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)")), scopes="ends", typed=(r"\b(?P<v>[a-z_]\w*)\s*=\s*(?P<t>[A-Z]\w*)\.new\b",)),
    "python": Language(("py",), r"#[^\n]*", rf'"""[\s\S]*?"""|' + r"'''[\s\S]*?'''" + rf"|{DOUBLE}|{SINGLE}", (("type", rf"^[ \t]*(?P<kind>class)\s+(?P<name>{NAME})"), ("function", rf"^[ \t]*(?:async\s+)?def\s+(?P<name>{NAME})")), scopes="indents", typed=(rf"\b(?P<v>{NAME})\s*(?::[^=\n]+)?=\s*(?P<t>[A-Z]\w*)\(", _COLON)),
}
OF_EXTENSION = {e: name for name, of in LANGUAGES.items() for e in of.extensions}
#: Words that open and close a scope of a language with ``end``.
ENDS = re.compile(r"(?m)^[ \t]*(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b|(?:=|<<|return|\()\s*(?:if|unless|case|begin)\b|\bend\b")


def masked(text: str, language: Language) -> str:
    """The text with comments and the inside of strings as blanks; lines and places stay."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    found = re.compile(rf"(?P<c>{language.comments})|(?P<s>{language.strings})")
    return found.sub(lambda m: blank(m[0]) if m.lastgroup == "c" else m[0][0] + blank(m[0][1:-1]) + m[0][-1], text)


@dataclass
class Found:
    at: int
    end: int
    kind: str
    name: str
    owner: str | None
    signature: str


def declarations(text: str, code: str, language: Language) -> list[Found]:
    """Declarations in order of place; where two begin at one name, the first of the table is taken."""
    taken: dict[int, Found] = {}
    for kind, pattern in language.declares:
        for m in re.finditer(pattern, code, re.MULTILINE):
            name, at = m["name"], m.start("name")
            if at in taken or kind == "method" and name in NOT_CALLED:
                continue
            words = m.groupdict()
            first = code.rfind("\n", 0, at) + 1
            stop = min((p for p in (code.find("{", m.end()), code.find("\n", m.end())) if p >= 0), default=len(code))
            taken[at] = Found(at, m.end(), words.get("kind") or kind, name, words.get("owner"), " ".join(text[first:stop].split()).rstrip(":{ "))
    return [taken[at] for at in sorted(taken)]


def scoped(code: str, found: list[Found], scopes: str) -> Iterator[tuple[Found, Found | None]]:
    """(declaration, the one in whose scope it stands)."""
    if scopes == "indents":
        stack: list[tuple[int, Found]] = []
        for one in found:
            first = code.rfind("\n", 0, one.at) + 1
            before = code[first : one.at].expandtabs(8)
            depth = len(before) - len(before.lstrip(" "))
            while stack and stack[-1][0] >= depth:
                stack.pop()
            yield one, stack[-1][1] if stack else None
            stack.append((depth, one))
        return
    marks = [(m.start(), m[0]) for m in (re.finditer(r"[{};]", code) if scopes == "braces" else ENDS.finditer(code))]
    waiting: Found | None = None
    open_: list[Found | None] = []
    events = sorted([(p, 1, m) for p, m in marks] + [(one.at if scopes == "braces" else code.rfind("\n", 0, one.at) + 1, 0, one) for one in found], key=lambda e: e[:2])
    for _, kind, what in events:
        if kind == 0:
            # a function within another is not a member of the class around both
            yield what, open_[-1] if open_ else None
            waiting = what
        elif what in ("}", "end") or what.endswith("end") and scopes == "ends":
            if open_:
                open_.pop()
        elif what == ";":
            waiting = None
        else:
            open_.append(waiting)
            waiting = None


SYMBOLS = "path string, language string, name string, kind string, parent string, signature string, line int"


def _rows(path: str, text: str) -> Iterator[tuple]:
    name = OF_EXTENSION[path.rsplit(".", 1)[-1].lower()]
    language = LANGUAGES[name]
    code = masked(text, language)
    for one, around in scoped(code, declarations(text, code, language), language.scopes):
        if one.kind == "impl":
            continue
        parent = one.owner or (around.name if around and (around.kind in TYPES or around.kind in ("impl", "extension", "mod")) else None)
        if one.kind == "method" and name in ("javascript", "java", "csharp") and parent is None:
            continue  # a call with a block
        kind = one.kind if one.kind in TYPES or one.kind in ("extension", "mod") else "method" if parent else "function"
        yield path, name, one.name, kind, parent, one.signature, 1 + text.count("\n", 0, one.at)


CALLS = "doc string, model string, name string, line int"


def _calls(path: str, text: str) -> Iterator[tuple]:
    language = LANGUAGES[OF_EXTENSION[path.rsplit(".", 1)[-1].lower()]]
    code = masked(text, language)
    types: dict[str, str] = {}
    for pattern in language.typed:
        for m in re.finditer(pattern, code):
            types.setdefault(m["v"], m["t"])
    for m in re.finditer(rf"(?<![\w$.>])(?P<v>\$?{NAME})\s*(?:\.|->|::|\?\.)\s*(?P<m>{NAME})\s*\(", code):
        of = types.get(m["v"]) or (m["v"] if m["v"][:1].isupper() else None)
        if of:
            yield path, of, m["m"], 1 + code.count("\n", 0, m.start("m"))


def _over(files: DataFrame, of_file: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    known = F.lower(F.substring_index("path", ".", -1)).isin(*OF_EXTENSION)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            rows = [row for path, text in zip(*(c.to_pylist() for c in part.columns), strict=True) for row in of_file(path, text)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return of

    return map_batches(files.filter(known & F.col("text").isNotNull() & F.col("path").contains(".")), ["path", "text"], schema, make)


def symbols(files: DataFrame) -> DataFrame:
    """``SYMBOLS`` of files (path, text) of a known language."""
    return _over(files, _rows, SYMBOLS)


def member_calls(files: DataFrame) -> DataFrame:
    """(doc, model, name, line) of calls on receivers of a known type."""
    return _over(files, _calls, CALLS)


def members(found: DataFrame) -> DataFrame:
    """(model, name) of the members of types, for ``grounding.members``."""
    return found.filter("parent is not null").select(F.col("parent").alias("model"), "name").distinct()
