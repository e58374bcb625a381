"""Names in source files and configuration: one row for each name, by domain.

Extractors that are patterns are data and run in the JVM. Formats that need a parser (nested JSON,
Python) run over Arrow batches.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import normalize_route

NAME = "([A-Za-z_][A-Za-z0-9_]*)"
ENV = "([A-Z_][A-Z0-9_]*)"
KEY = r"([\w./-]+)"
Q = "['\"`]"

FLAG_FILES = "js jsx ts tsx mjs cjs py go java rb kt"

#: domain -> kind -> (extensions, pattern with the name as group 1)
PATTERNS: dict[str, dict[str, tuple[str, str]]] = {
    "env": {
        "js": ("js jsx ts tsx mjs cjs", rf"(?:process|import\.meta|Bun)\.env(?:\.|\[\s*{Q}){ENV}"),
        "deno": ("ts js", rf"Deno\.env\.get\(\s*{Q}{ENV}"),
        "python": ("py", rf"os\.(?:environ(?:\.get\(|\[)|getenv\()\s*{Q}{ENV}"),
        "go": ("go", rf"os\.(?:Getenv|LookupEnv)\(\s*{Q}{ENV}"),
        "rust": ("rs", rf"env(?:::var(?:_os)?\(|!\(|::option_env!\()\s*{Q}{ENV}"),
        "java": ("java kt", rf"System\.getenv\(\s*{Q}{ENV}"),
        "ruby": ("rb", rf"ENV(?:\.fetch\(|\[)\s*{Q}{ENV}"),
        "shell": ("sh bash", rf"\$\{{?{ENV}"),
        "compose": ("yml yaml", rf"(?m)\$\{{{ENV}"),
        # declarations, by the names of their sources
        "zod-schema": ("ts js mjs", rf"\b{ENV}\s*:\s*z\s*\."),
        "envalid": ("ts js mjs", rf"\b{ENV}\s*:\s*(?:str|num|bool|url|port|host|email|json)\s*\("),
        "docker-compose": ("yml yaml", rf"(?m)^\s+(?:-\s*)?{ENV}(?:=|\s*:(?:\s|$))"),
        "github-actions": ("yml yaml", rf"\$\{{\{{\s*(?:secrets|vars|env)\.{ENV}"),
    },
    # Calls that read a flag.
    "flag": {
        "variation": (FLAG_FILES, r"\.\s*variation(?:Detail)?\s*\(\s*['\"]([\w\-./]+)['\"]"),
        "enabled": (FLAG_FILES, r"\bisEnabled\s*\(\s*['\"]([\w\-./]+)['\"]"),
        "statsig": (FLAG_FILES, r"Statsig\.\s*(?:checkGate|getConfig|getFeatureGate|checkGateSync)\s*\(\s*['\"]([\w\-./]+)['\"]"),
        "posthog": (FLAG_FILES, r"posthog\.\s*(?:isFeatureEnabled|getFeatureFlag)\s*\(\s*['\"]([\w\-./]+)['\"]"),
        "growth": (FLAG_FILES, r"\b(?:gb|growthbook)\.\s*(?:feature|evalFeature|isOn|isOff|getFeatureValue)\s*\(\s*['\"]([\w\-./]+)['\"]"),
        "table": (FLAG_FILES, r"(?:featureFlags|flags)\s*\[\s*['\"]([\w\-./]+)['\"]\s*\]"),
        "get": (FLAG_FILES, r"(?:featureFlags|flags)\.\s*get\s*\(\s*['\"]([\w\-./]+)['\"]"),
    },
    "css": {
        "tailwind": ("js ts cjs mjs", r"(?m)^\s+['\"]?([a-z][\w-]*)['\"]?\s*:\s*(?:['\"]#|\{\s*(?:DEFAULT|\d{2,3})\b)"),
        "class": ("css scss less", r"\.([A-Za-z_][\w-]*)(?=[^{}]*\{)"),
    },
    "i18n": {
        "po": ("po pot", r'(?m)^msgid\s+"((?:[^"\\]|\\.)+)"'),
        "ftl": ("ftl", r"(?m)^([a-zA-Z][\w-]*)\s*="),
    },
    "model": {
        "prisma": ("prisma", rf"(?m)^\s*model\s+{NAME}\s*\{{"),
        "sql": ("sql", rf"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(?:\w+\.)?{NAME}"),
        "drizzle": ("ts js", rf"(?:pg|mysql|sqlite)Table\(\s*{Q}{NAME}"),
        "typeorm": ("ts", rf"@Entity\([^)]*\)\s*export\s+(?:default\s+)?class\s+{NAME}"),
    },
    "graphql": {
        "inline": ("ts tsx js jsx mjs", rf"(?s)gql\s*`[^`]*?\b(?:type|input|interface|enum)\s+{NAME}"),
        "type": ("graphql gql graphqls", rf"(?m)^\s*(?:extend\s+)?(?:type|interface|input|enum|union|scalar)\s+{NAME}"),
    },
    "export": {
        "js": ("js jsx ts tsx mjs", rf"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:abstract\s+)?(?:function\*?|class|const|let|var|type|interface|enum)\s+{NAME}"),
        "python": ("py", rf"(?m)^(?:async\s+def|def|class)\s+{NAME}"),
    },
    "symbol": {
        "go": ("go", rf"(?m)^(?:func\s+(?:\([^)]*\)\s*)?|type\s+){NAME}"),
        "rust": ("rs", rf"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:fn|struct|enum|trait|mod|type|const)\s+{NAME}"),
        "ruby": ("rb", r"(?m)^\s*(?:def|class|module)\s+(?:self\.)?([A-Za-z_]\w*[?!]?)"),
        "shell": ("sh bash", rf"(?m)^\s*(?:function\s+)?{NAME}\s*\(\)\s*\{{"),
        "java": ("java kt cs", rf"(?m)^\s*(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|data|partial)\s+)*(?:class|interface|enum|record|object)\s+{NAME}"),
        "php": ("php", rf"(?m)^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:function|class|interface|trait)\s+{NAME}"),
        "kotlin": ("kt", rf"(?m)^\s*(?:(?:public|private|internal|override|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?{NAME}"),
        "ts": ("ts tsx js jsx", rf"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum)\s+{NAME}"),
    },
    "url": {
        "call": ("js jsx ts tsx py", rf"\b(?:fetch|axios(?:\.\w+)?|requests\.\w+|httpx\.\w+|client\.(?:get|post|put|patch|delete))\s*\(\s*{Q}(/[^'\"`\s]*)"),
    },
    "bibliography": {
        "entry": ("bib", r"@\w+\s*\{\s*([^,\s]+)\s*,"),
    },
}
# Variables that a shell sets itself.
SHELL_OWN = (
    "PATH HOME USER SHELL PWD OLDPWD PS1 PS2 IFS TERM LANG LC_ALL EDITOR VISUAL DISPLAY TMPDIR RANDOM SECONDS LINENO BASH BASH_VERSION "
    "BASH_SOURCE FUNCNAME BASHPID EUID UID GROUPS PIPESTATUS REPLY OPTARG OPTIND HOSTNAME OSTYPE MACHTYPE HOSTTYPE 0 1 2 3 4 5 6 7 8 9"
).split()
SECRET = "(?i)(secret|token|password|passwd|api_?key|private|credential)"


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def names(files: DataFrame, *domains: str) -> DataFrame:
    """(path, domain, kind, name) of each distinct name in ``files`` (path, text); all domains by default."""
    found = []
    for domain in domains or PATTERNS:
        for kind, (kinds, pattern) in PATTERNS[domain].items():
            hits = F.when(extension(F.col("path")).isin(*kinds.split()), F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))
            if kind == "shell" and domain == "env":
                hits = F.filter(hits, lambda n: ~n.isin(*SHELL_OWN))
            found.append(F.transform(hits, lambda n: F.struct(F.lit(domain).alias("domain"), F.lit(kind).alias("kind"), n.alias("name"))))  # noqa: B023
    none = F.array().cast("array<struct<domain:string,kind:string,name:string>>")
    every = F.array_distinct(F.concat(*[F.coalesce(f, none) for f in found]))
    return files.select("path", F.explode(every).alias("n")).select("path", "n.*")


def dotenv(files: DataFrame) -> DataFrame:
    """(path, line, name, value, comment, secret) of the assignments of environment files.

    The comment is the one on the line before.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("line", "s"))
    w = Window.partitionBy("path").orderBy("line")
    lines = lines.withColumn("comment", F.nullif(F.trim(F.regexp_extract(F.lag("s").over(w), r"^\s*#\s*(.*)$", 1)), F.lit("")))
    pattern = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$"
    rows = lines.filter(F.col("s").rlike(pattern)).withColumns({"name": F.regexp_extract("s", pattern, 1), "raw": F.trim(F.regexp_extract("s", pattern, 2))})
    quoted = F.regexp_extract("raw", r"^(['\"])(.*)\1$", 2)
    bare = F.nullif(F.trim(F.regexp_replace("raw", "#.*$", "")), F.lit(""))
    value = F.when(F.col("raw").rlike(r"^(['\"]).*\1$"), quoted).otherwise(bare)
    return rows.select("path", (F.col("line") + 1).alias("line"), "name", value.alias("value"), "comment", F.col("name").rlike(SECRET).alias("secret"))


def model_fields(files: DataFrame) -> DataFrame:
    """(path, model, field, type, required, key) of Prisma schemas, SQL DDL and GraphQL types."""
    ext = extension(F.col("path"))
    block = F.when(ext == "prisma", r"(?ms)^\s*model\s+\w+\s*\{.*?^\s*\}").when(ext.isin("graphql", "gql", "graphqls"), r"(?s)\b(?:type|input|interface)\s+\w+[^{]*\{[^}]*\}")
    block = block.when(ext == "sql", r"(?is)create\s+table\s+[^(;]+\((?:[^()]|\([^()]*\))*\)")
    rows = files.select("path", ext.alias("ext"), F.explode(F.regexp_extract_all("text", block, F.lit(0))).alias("b"))
    model = F.when(F.col("ext") == "sql", F.regexp_extract("b", r"(?i)table\s+(?:if\s+not\s+exists\s+)?[\"`\[]?(?:\w+\.)?(\w+)", 1)).otherwise(
        F.regexp_extract("b", r"\b(?:model|type|input|interface)\s+(\w+)", 1)
    )
    body = F.regexp_extract("b", r"(?s)[({](.*)[)}]", 1)
    # commas inside parentheses, as of numeric(10, 2), do not end a column
    parts = F.when(F.col("ext") == "sql", F.split(body, r",(?![^(]*\))")).otherwise(F.split(body, "\n"))
    lines = rows.select("path", "ext", model.alias("model"), F.explode(parts).alias("s")).withColumn("s", F.trim(F.regexp_replace("s", r"(?m)(//|--|#).*$", "")))
    lines = lines.filter(~F.col("s").rlike(r"(?i)^(@@|primary\s+key|foreign\s+key|unique\s*\(|check|constraint|index|$)"))
    gql = F.col("ext").isin("graphql", "gql", "graphqls")
    field = F.regexp_extract("s", r"^[\"`\[]?(\w+)", 1)
    kind = F.when(gql, F.regexp_extract("s", r":\s*([\[\]\w!]+)", 1)).otherwise(F.regexp_extract("s", r"^\S+\s+([\w\[\]?]+(?:\([^)]*\))?)", 1))
    required = F.when(gql, kind.endswith("!")).when(F.col("ext") == "sql", F.col("s").rlike(r"(?i)not\s+null|primary\s+key")).otherwise(~kind.endswith("?"))
    return lines.select("path", "model", field.alias("field"), kind.alias("type"), required.alias("required"), F.col("s").rlike(r"(?i)@id\b|primary\s+key").alias("key")).filter("field <> '' and type <> ''")


ROUTES = {
    "express": r"\b\w+\.(get|post|put|patch|delete|head|options|all)\s*\(\s*['\"`](/[^'\"`]*)",
    "decorator": r"@\w+\.(get|post|put|patch|delete|head|options|route)\s*\(\s*['\"](/[^'\"]*)",
    "nest": r"@(Get|Post|Put|Patch|Delete|Head|Options)\s*\(\s*['\"]([^'\"]*)",
    "django": r"\b(re_path|path)\s*\(\s*r?['\"]\^?([^'\"$]*)",
}
SCRIPTS = ("js", "jsx", "ts", "tsx", "mjs")


def routes(files: DataFrame) -> DataFrame:
    """(path, framework, method, route) of route declarations in code."""
    found = []
    for framework, pattern in ROUTES.items():
        ext = ("py",) if framework in ("decorator", "django") else SCRIPTS
        hits = F.when(extension(F.col("path")).isin(*ext), F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.regexp_extract_all("text", F.lit(pattern), F.lit(2))).cast("array<struct<method:string,raw:string>>"))
        found.append(F.transform(hits, lambda h: F.struct(F.lit(framework).alias("framework"), h["method"].alias("method"), h["raw"].alias("raw"))))  # noqa: B023
    none = F.array().cast("array<struct<framework:string,method:string,raw:string>>")
    rows = files.select("path", F.explode(F.concat(*[F.coalesce(f, none) for f in found])).alias("r")).select("path", "r.*")
    rows = rows.filter((F.col("framework") != "django") | F.col("path").rlike(r"urls\w*\.py$"))
    method = F.when(F.upper("method").isin("ALL", "ROUTE", "PATH", "RE_PATH"), "*").otherwise(F.upper("method"))
    angle = F.regexp_replace("raw", r"<(?:\w+:)?(\w+)>", ":$1")
    slashed = F.when(angle.startswith("/"), angle).otherwise(F.concat(F.lit("/"), angle))
    return rows.select("path", "framework", method.alias("method"), normalize_route(slashed).alias("route"))


def file_routes(files: DataFrame) -> DataFrame:
    """(path, framework, method, route) of routes that files serve by their place: handlers of an ``app``
    folder by the verbs that they export, and files of ``pages/api`` for any verb."""
    app = r"(?:^|/)app/((?:.*/)?)route\.(?:ts|tsx|js|jsx)$"
    api = r"(?:^|/)pages/(api/.+)\.(?:ts|tsx|js|jsx)$"
    verbs = F.regexp_extract_all("text", F.lit(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"), F.lit(1))
    served = F.when(F.col("path").rlike(app), F.array_distinct(verbs)).when(F.col("path").rlike(api), F.array(F.lit("*")))
    place = F.when(F.col("path").rlike(app), F.regexp_extract("path", app, 1)).otherwise(F.regexp_replace(F.regexp_extract("path", api, 1), r"(^|/)index$", ""))
    tidy = normalize_route(F.concat(F.lit("/"), F.regexp_replace(place, r"\([^/)]*\)/", "")))
    return files.select("path", F.lit("next").alias("framework"), F.explode(served).alias("method"), tidy.alias("route"))


def openapi_routes(files: DataFrame) -> DataFrame:
    """(path, framework, method, route) of the paths of OpenAPI documents, as JSON or as YAML by its lines."""
    verb = "get|put|post|delete|options|head|patch|trace"
    lines = files.filter(extension(F.col("path")).isin("yml", "yaml") & F.col("text").rlike(r"(?m)^(?:openapi|swagger)\s*:")).select("path", F.posexplode(F.split("text", "\r?\n")).alias("n", "s"))
    w = Window.partitionBy("path").orderBy("n")
    indent = F.length(F.regexp_extract("s", r"^( *)", 1))
    head = F.regexp_extract("s", r"^ *['\"]?(/[^'\":]*)['\"]?\s*:\s*$", 1)
    at = lines.withColumns({"route": F.last(F.when(head != "", head), ignorenulls=True).over(w), "depth": F.last(F.when(head != "", indent), ignorenulls=True).over(w)})
    method = F.regexp_extract("s", rf"^ *({verb})\s*:\s*$", 1)
    yaml = at.filter((method != "") & (indent > F.col("depth"))).select("path", F.upper(method).alias("method"), "route")
    paths = F.from_json("text", "struct<openapi:string,swagger:string,paths:map<string,map<string,string>>>")
    docs = files.filter(extension(F.col("path")) == "json").select("path", paths.alias("d")).filter("d.openapi is not null or d.swagger is not null")
    found = docs.select("path", F.explode("d.paths").alias("route", "ops")).select("path", "route", F.explode(F.map_keys("ops")).alias("method")).filter(F.col("method").rlike(f"^(?:{verb})$"))
    both = yaml.unionByName(found.withColumn("method", F.upper("method")).select("path", "method", "route"))
    return both.select("path", F.lit("openapi").alias("framework"), "method", normalize_route(F.col("route")).alias("route"))


def declared_pages(files: DataFrame) -> DataFrame:
    """(path, framework, route) of pages that routers declare in code."""
    react = F.regexp_extract_all("text", F.lit(r"<Route\b[^>]*?\bpath\s*=\s*\{?['\"]([^'\"]+)"), F.lit(1))
    vue = F.regexp_extract_all("text", F.lit(r"\bpath\s*:\s*['\"](/[^'\"]*)['\"]\s*,\s*(?:name|component|element|children|redirect)\b"), F.lit(1))
    tag = lambda found, name: F.transform(found, lambda r: F.struct(F.lit(name).alias("framework"), r.alias("route")))
    rows = files.filter(extension(F.col("path")).isin(*SCRIPTS, "vue")).select("path", F.explode(F.array_distinct(F.concat(tag(react, "react-router"), tag(vue, "vue-router")))).alias("r"))
    slashed = F.when(F.col("r.route").startswith("/"), F.col("r.route")).otherwise(F.concat(F.lit("/"), F.col("r.route")))
    return rows.select("path", "r.framework", normalize_route(slashed).alias("route"))


def orm_fields(files: DataFrame) -> DataFrame:
    """(path, model, field, type) of the fields of Drizzle tables and TypeORM entities."""
    kinds = "serial|bigserial|integer|int|bigint|text|varchar|char|boolean|timestamp|date|json|jsonb|uuid|numeric|decimal|real|doublePrecision"
    code = files.filter(extension(F.col("path")).isin("ts", "js", "mjs"))
    tables = code.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)(?:pg|mysql|sqlite)Table\(\s*['\"`]\w+['\"`]\s*,\s*\{.*?\n?\}\s*[,)]"), F.lit(0))).alias("b"))
    pair = rf"\b(\w+)\s*:\s*({kinds})\s*\("
    drizzle = tables.select("path", F.regexp_extract("b", r"Table\(\s*['\"`](\w+)", 1).alias("model"), F.explode(F.arrays_zip(F.regexp_extract_all("b", F.lit(pair), F.lit(1)), F.regexp_extract_all("b", F.lit(pair), F.lit(2))).cast("array<struct<field:string,type:string>>")).alias("f"))
    classes = code.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?ms)@Entity\b.*?^\}"), F.lit(0))).alias("b"))
    column = r"(?s)@(?:PrimaryGeneratedColumn|PrimaryColumn|Column|CreateDateColumn|UpdateDateColumn)\([^)]*\)\s*(\w+)[?!]?\s*:\s*([\w\[\]]+)"
    typeorm = classes.select("path", F.regexp_extract("b", r"class\s+(\w+)", 1).alias("model"), F.explode(F.arrays_zip(F.regexp_extract_all("b", F.lit(column), F.lit(1)), F.regexp_extract_all("b", F.lit(column), F.lit(2))).cast("array<struct<field:string,type:string>>")).alias("f"))
    return drizzle.unionByName(typeorm).select("path", "model", "f.field", "f.type")


def declared_flags(files: DataFrame) -> DataFrame:
    """(path, kind, name) of flags that JSON files (the keys of ``flags`` or of the document, where values are
    objects or booleans) and scripts (keys with a default) declare."""
    whole, inner = F.from_json("text", "map<string,string>"), F.from_json("text", "struct<flags:map<string,string>,featureFlags:map<string,string>>")
    docs = files.filter((extension(F.col("path")) == "json") & F.col("path").rlike(r"(?i)flags?[^/]*\.json$")).select("path", F.coalesce(inner["flags"], inner["featureFlags"], whole).alias("m"))
    keyed = docs.select("path", F.explode("m").alias("name", "v")).filter(F.col("v").rlike(r"^\s*(?:\{|true|false)")).select("path", F.lit("json").alias("kind"), "name")
    calls = F.regexp_extract_all("text", F.lit(r"['\"]?([A-Za-z][\w.-]*)['\"]?\s*:\s*\{\s*(?:default|defaultValue|enabled)\b"), F.lit(1))
    scripts = files.filter(extension(F.col("path")).isin(*SCRIPTS) & F.col("path").rlike(r"(?i)flags?[^/]*$")).select("path", F.lit("script").alias("kind"), F.explode(F.array_distinct(calls)).alias("name"))
    return keyed.unionByName(scripts)


def page_route(path: Column) -> Column:
    """The route that a file serves by its place, in five file-based frameworks, or null."""
    sub = lambda pattern: F.regexp_extract(path, pattern, 1)
    tidy = lambda s: normalize_route(F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(s, r"\([^/)]*\)(/|$)", ""), r"(^|/)index$", "")))
    svelte, app = r"(?:^|/)src/routes/((?:.*/)?)\+page\.\w+$", r"(?:^|/)app/((?:.*/)?)page\.(?:tsx|jsx|ts|js|mdx)$"
    astro, remix = r"(?:^|/)src/pages/(.+)\.(?:astro|mdx|md)$", r"(?:^|/)app/routes/(.+)\.(?:tsx|jsx|ts|js)$"
    pages = r"(?:^|/)pages/(?!api/)(?!_)(.+)\.(?:tsx|jsx|ts|js)$"
    dotted = F.regexp_replace(F.regexp_replace(F.translate(sub(remix), ".", "/"), r"(^|/)_[^/]*", ""), r"\$(\w+)", "[$1]")
    return (
        F.when(path.rlike(svelte), tidy(sub(svelte)))
        .when(path.rlike(remix), tidy(dotted))
        .when(path.rlike(app), tidy(sub(app)))
        .when(path.rlike(astro), tidy(sub(astro)))
        .when(path.rlike(pages), tidy(sub(pages)))
    )


def json_keys(files: DataFrame) -> DataFrame:
    """(path, locale, name) of the dotted paths of all leaves of JSON objects; broken files give none."""

    def walk(value: object, prefix: str) -> Iterator[str]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from walk(v, f"{prefix}.{k}" if prefix else str(k))
        else:
            yield prefix

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    value = json.loads(text or "")
                except ValueError:
                    continue
                if isinstance(value, dict):
                    locale = str(path).rsplit("/", 1)[-1].rsplit(".", 1)[0]
                    by = value if all(len(k) in (2, 5) and k[:2].islower() and isinstance(v, dict) for k, v in value.items()) else {locale: value}
                    out += [(path, loc, name) for loc, v in by.items() for name in walk(v, "")]
            yield pd.DataFrame(out, columns=["path", "locale", "name"])

    return files.select("path", "text").mapInPandas(cut, "path string, locale string, name string")


def python_symbols(files: DataFrame) -> DataFrame:
    """(path, name, kind, parent, line, doc) of classes, functions and methods; broken files give none."""

    def of(path: str, tree: ast.AST, parent: str | None) -> Iterator[tuple]:
        for node in ast.iter_child_nodes(tree):
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
                yield path, node.name, kind, parent, node.lineno, (ast.get_docstring(node) or "").split("\n")[0] or None
                if isinstance(node, ast.ClassDef):
                    yield from of(path, node, node.name)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out: list[tuple] = []
            for path, text in zip(part["path"], part["text"], strict=True):
                try:
                    out += of(path, ast.parse(text or ""), None)
                except (SyntaxError, ValueError):
                    continue
            yield pd.DataFrame(out, columns=["path", "name", "kind", "parent", "line", "doc"])

    return files.select("path", "text").mapInPandas(cut, "path string, name string, kind string, parent string, line int, doc string")


def qualified(symbols: DataFrame) -> DataFrame:
    """Symbols with ``qualified_name`` and the line of the class they belong to."""
    owners = symbols.filter("kind = 'class'").select(F.col("path").alias("_p"), F.col("name").alias("_n"), F.col("line").alias("parent_line"))
    joined = symbols.join(owners, (F.col("path") == F.col("_p")) & (F.col("parent") == F.col("_n")), "left").drop("_p", "_n")
    return joined.withColumn("qualified_name", F.concat_ws(".", "parent", "name"))


def embedding_text(name: Column, signature: Column, doc: Column) -> Column:
    return F.concat_ws("\n", name, signature, doc)
