"""Extraction of names, observations and lint on small files."""

from __future__ import annotations

import pytest

from quarry.operators import lint
from quarry.sources import code
from quarry.sources.observations import observations

FILES = [
    ("/r/a.ts", "process.env.API_URL; process.env['DB_HOST']; ld.variation('new-ui', false); app.get('/users/:id', h); router.post(`/items`, h)\nexport class Foo {}\nexport const bar = 1\nfetch('/api/users')"),
    ("/r/b.py", "import os\nos.getenv('TOKEN')\n@app.get('/x/{id}')\ndef f():\n    'Doc.'\nclass C:\n    def m(self): pass\n@app.route('/y/<int:n>')\ndef g(): pass"),
    ("/r/c.go", 'os.Getenv("GO_VAR")\nfunc (s *T) Run() {}\ntype T struct{}'),
    ("/r/d.sh", "echo $HOME ${CUSTOM}\nrun() {\n}"),
    ("/r/e.css", ".btn, .btn-primary { color: red } .x:hover{}"),
    ("/r/schema.prisma", "model User {\n  id Int @id\n  name String?\n  // note\n  @@map(\"users\")\n}\n"),
    ("/r/m.sql", "CREATE TABLE IF NOT EXISTS public.orders (id bigint PRIMARY KEY, total numeric(10, 2) NOT NULL, note text, UNIQUE (id));"),
    ("/r/t.graphql", "type Query {\n  user(id: ID!): User!\n}\nenum Role { A B }"),
    ("/r/de.po", 'msgid ""\nmsgid "Hello"\n'),
    ("/r/broken.py", "def ("),
]


@pytest.fixture
def files(spark):
    return spark.createDataFrame(FILES, "path string, text string")


def of(df, domain):
    return {r.name for r in df.collect() if r.domain == domain}


def test_names_by_domain(files):
    got = code.names(files)
    assert of(got, "env") == {"API_URL", "DB_HOST", "TOKEN", "GO_VAR", "CUSTOM"}
    assert of(got, "flag") == {"new-ui"} and of(got, "url") == {"/api/users"}
    assert {"btn", "btn-primary", "x"} <= of(got, "css") and of(got, "i18n") == {"Hello"}
    assert {"User", "orders"} <= of(got, "model") and {"Query", "Role"} == of(got, "graphql")
    assert {"Foo", "bar", "f", "C", "g"} <= of(got, "export") and {"Run", "T", "run"} <= of(got, "symbol")


def test_routes_and_pages(spark, files):
    got = {(r.method, r.route) for r in code.routes(files).collect()}
    assert got == {("GET", "/users/:id"), ("POST", "/items"), ("GET", "/x/:id"), ("*", "/y/:n")}
    cases = {
        "app/blog/[slug]/page.tsx": "/blog/:slug", "app/(shop)/cart/page.tsx": "/cart", "pages/index.tsx": "/", "pages/docs/[...all].js": "/docs/*",
        "pages/api/x.ts": None, "pages/_app.tsx": None, "src/routes/a/+page.svelte": "/a", "src/pages/about.astro": "/about",
        "app/routes/users.$id.tsx": "/users/:id", "lib/x.ts": None,
    }
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(p,) for p in cases], "p string")
    assert {r.p: r.r for r in df.select("p", code.page_route(F.col("p")).alias("r")).collect()} == cases


def test_fields(files):
    got = {(r.model, r.field): (r.required, r.key) for r in code.model_fields(files).collect()}
    assert got[("User", "id")] == (True, True) and got[("User", "name")] == (False, False)
    assert got[("orders", "id")] == (True, True) and got[("orders", "total")] == (True, False) and got[("orders", "note")] == (False, False)
    assert got[("Query", "user")][0] and ("orders", "UNIQUE") not in got


def test_dotenv_json_and_python(spark, files):
    env = spark.createDataFrame([("/.env", "# the url\nAPI_URL=http://x # note\n\nexport SECRET_KEY='a # b'\nbad line\nEMPTY=")], "path string, text string")
    got = {r.name: (r.value, r.comment, r.secret, r.line) for r in code.dotenv(env).collect()}
    assert got == {"API_URL": ("http://x", "the url", False, 2), "SECRET_KEY": ("a # b", None, True, 4), "EMPTY": (None, None, False, 6)}
    loc = spark.createDataFrame([("/l/en.json", '{"a": {"b": "x"}, "c": 1}'), ("/l/all.json", '{"en": {"k": "v"}, "de": {"k": "w"}}'), ("/l/bad.json", "{")], "path string, text string")
    assert {(r.locale, r.name) for r in code.json_keys(loc).collect()} == {("en", "a.b"), ("en", "c"), ("en", "k"), ("de", "k")}
    symbols = {r.qualified_name: (r.kind, r.doc, r.parent_line) for r in code.qualified(code.python_symbols(files.filter("path like '%.py'"))).collect()}
    assert symbols == {"f": ("function", "Doc.", None), "C": ("class", None, None), "C.m": ("method", None, 6), "g": ("function", None, None)}


def test_observations(spark):
    text = (
        '<observation type="bugfix"><title>Fixed it</title><subtitle>sub</subtitle><fact>one</fact><fact>two</fact><files>a.py, b.py</files>\nDecision: inside tags is not a marker</observation>\n'
        "**Decision:** use the second approach\nLearned: short\nLearned: the cache was never written\n<summary>first line\nrest</summary>"
    )
    rows = observations(spark.createDataFrame([(1, text), (2, None)], "id int, content string")).collect()
    got = {(r.kind, r.title) for r in rows}
    assert got == {("bugfix", "Fixed it"), ("discovery", "first line"), ("decision", "use the second approach"), ("discovery", "the cache was never written")}
    tagged = next(r for r in rows if r.kind == "bugfix")
    assert (tagged.subtitle, tagged.facts, tagged.files) == ("sub", ["one", "two"], ["a.py", "b.py"])


def test_lint(spark, files):
    index = code.names(files).select("domain", "name")
    edits = spark.createDataFrame([("good", "x.ts", "process.env.API_URL"), ("typo", "x.ts", "process.env.API_URLS"), ("bad", "x.ts", "process.env.WHOLLY_NEW"), ("none", "x.ts", "1")], "doc string, path string, text string")
    issues = lint.ground(lint.references(edits, "env"), index)
    got = {r.doc: (r.severity, r.candidate) for r in issues.collect()}
    assert got == {"good": ("ok", "API_URL"), "typo": ("low", "API_URL"), "bad": ("unknown", None)}
    assert {r.doc: r.verdict for r in lint.verdicts(issues).collect()} == {"good": "ok", "typo": "warn", "bad": "block"}
    assert lint.typo_like(issues).count() == 1
    assert lint.ground(lint.references(edits, "env"), index.filter("domain = 'css'")).count() == 0
    called = {r.name for r in lint.called_names(spark.createDataFrame([("d", "print(len(x)); helper(1); obj.method(2); Foo()")], "doc string, text string")).collect()}
    assert called == {"helper", "Foo"}


MORE = [
    ("/r/env.ts", "const S = z.object({ API_URL: z.string(), PORT : z.coerce.number() });\ncleanEnv(process.env, { MAIL_FROM: email(), DEBUG: bool({default: false}) })"),
    ("/r/compose.yml", "services:\n  web:\n    environment:\n      - DB_HOST=db\n      CACHE_URL: redis\n    image: x\n"),
    ("/r/.github/ci.yaml", "env:\n  KEY: ${{ secrets.DEPLOY_KEY }}\n"),
    ("/r/app/urls.py", "urlpatterns = [path('users/<int:pk>/', v), re_path(r'^old/$', w)]"),
    ("/r/views.py", "os.path('not/a/route')"),
    ("/r/app/api/items/[id]/route.ts", "export async function GET() {}\nexport const DELETE = 1"),
    ("/r/pages/api/users/index.ts", "export default f"),
    ("/r/spec.yaml", "openapi: 3.0.0\npaths:\n  /pets/{id}:\n    get:\n      responses: {}\n    delete:\n  '/pets':\n    post:\n"),
    ("/r/spec.json", '{"swagger": "2.0", "paths": {"/a/{b}": {"get": {}, "parameters": []}}}'),
    ("/r/router.tsx", "<Route exact path=\"/home\" /> <Route path={'users/:id'} />"),
    ("/r/router.js", "const routes = [{ path: '/about', component: About }, { path: '/x/:y', name: 'x' }]"),
    ("/r/schema.ts", "export const users = pgTable('users', {\n  id: serial('id').primaryKey(),\n  name: text('name'),\n});\n@Entity()\nexport class Order {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column({ nullable: true })\n  note?: string;\n}\n"),
    ("/r/flags.json", '{"flags": {"new-ui": true, "beta": {"on": 1}, "version": "x"}}'),
    ("/r/featureFlags.ts", "export const f = { darkMode: { default: false }, other: 1 }"),
    ("/r/broken.json", "{"),
]


def test_declarations_of_variables(spark):
    got = code.names(spark.createDataFrame(MORE, "path string, text string"), "env")
    kinds = {(r.kind, r.name) for r in got.collect()}
    assert {("zod-schema", "API_URL"), ("zod-schema", "PORT"), ("envalid", "MAIL_FROM"), ("envalid", "DEBUG"), ("docker-compose", "DB_HOST"), ("docker-compose", "CACHE_URL"), ("github-actions", "DEPLOY_KEY")} <= kinds


def test_routes_by_place_and_document(spark):
    files = spark.createDataFrame(MORE, "path string, text string")
    assert {(r.method, r.route) for r in code.routes(files).filter("framework = 'django'").collect()} == {("*", "/users/:pk"), ("*", "/old")}
    assert {(r.method, r.route) for r in code.file_routes(files).collect()} == {("GET", "/api/items/:id"), ("DELETE", "/api/items/:id"), ("*", "/api/users")}
    assert {(r.method, r.route) for r in code.openapi_routes(files).collect()} == {("GET", "/pets/:id"), ("DELETE", "/pets/:id"), ("POST", "/pets"), ("GET", "/a/:b")}
    assert {(r.framework, r.route) for r in code.declared_pages(files).collect()} == {("react-router", "/home"), ("react-router", "/users/:id"), ("vue-router", "/about"), ("vue-router", "/x/:y")}


def test_fields_and_flags_in_code(spark):
    files = spark.createDataFrame(MORE, "path string, text string")
    got = {(r.model, r.field): r.type for r in code.orm_fields(files).collect()}
    assert got == {("users", "id"): "serial", ("users", "name"): "text", ("Order", "id"): "number", ("Order", "note"): "string"}
    assert {(r.kind, r.name) for r in code.declared_flags(files).collect()} == {("json", "new-ui"), ("json", "beta"), ("script", "darkMode")}
