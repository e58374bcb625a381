"""Selection sets and call chains: nesting, aliases, fragments, relations, and what is not code."""

from __future__ import annotations

from quarry.operators import grounding
from quarry.sources import walks

SCHEMA = '''
"""A person { not: Code }"""
type User implements Node @key(fields: "id") {
  id: ID!  # unique } {
  email(verified: Boolean = true, like: [String!]): String!
  posts(first: Int): [Post!]!
  profile: Profile
}
type Post { id: ID! title: String author: User! tags: [Tag] }
interface Profile { bio: String user: User }
input Filter { term: String }
enum Role { A B }
type Tag { label: String }
type Query { user(id: ID!): User me: User search(q: String): [Post] }
extend type Mutation { createUser(email: String!): User }
'''


def fields(spark):
    return walks.schema_fields(spark.createDataFrame([("s", SCHEMA), ("n", None)], "doc string, text string"))


def used(spark, text, walk=walks.query_fields):
    nodes = walk(spark.createDataFrame([("d", text), ("e", ""), ("f", None)], "doc string, text string"))
    return sorted((r.model, r.name, r.line) for r in walks.typed(nodes, fields(spark)).collect())


def test_schema(spark):
    got = {(r.model, r.name): r.type for r in fields(spark).collect()}
    assert got[("User", "posts")] == "[Post!]!" and got[("Mutation", "createUser")] == "User" and got[("Post", "tags")] == "[Tag]" and got[("User", "email")] == "String!"
    assert {m for m, _ in got} == {"User", "Post", "Profile", "Filter", "Tag", "Query", "Mutation"} and len(got) == 16


def test_selections(spark):
    text = """
const a = gql`
  query Q($id: ID = "}", $f: Filter) @cached(ttl: 3) {
    u: user(id: $id, where: {a: {b: 1}}) @include(if: $x) {
      __typename
      mail: email(like: ["{"])
      posts(first: 2) { title author { emaill } nope { deep { deeper } } tags { label } }
      ... on User { profile { bio } ... @skip(if: true) { id } }
      ...Parts
    } # } comment {
    search { id }
  }
  fragment Parts on Post { title author { id } }
  mutation { createUser(email: "x") { id } }
`
const b = graphql`{ me { wrong } }`; const c = gql`type X { y: Int }`; const d = 'query { me { no } }'
"""
    got = used(spark, text)
    assert got == sorted([
        ("Query", "user", 4), ("User", "email", 6), ("User", "posts", 7), ("Post", "title", 7), ("Post", "author", 7), ("User", "emaill", 7), ("Post", "nope", 7), ("Post", "tags", 7),
        ("Tag", "label", 7), ("User", "profile", 8), ("Profile", "bio", 8), ("User", "id", 8), ("Query", "search", 11), ("Post", "id", 11),
        ("Post", "title", 13), ("Post", "author", 13), ("User", "id", 13), ("Mutation", "createUser", 14), ("User", "id", 14), ("Query", "me", 16), ("User", "wrong", 16),
    ])
    nodes = walks.query_fields(spark.createDataFrame([("d", text)], "doc string, text string"))
    found = grounding.graphql(walks.typed(nodes, fields(spark)), fields(spark))
    wrong = {r.name: (r.severity, r.candidate) for r in found.collect() if r.severity != "ok"}
    assert wrong == {"User.emaill": ("low", "User.email"), "Post.nope": ("unknown", None), "User.wrong": ("unknown", None)}


def test_calls(spark):
    text = """
// prisma.user.findMany({ where: { no: 1 } })
const s = "prisma.user.findMany({ where: { no: 1 } })"
await prisma.user.findMany({ take: 3, skip: f({ where: { no: 1 } }), where: { OR: [{ email: { contains: '}' } }, { NOT: { id: 7 } }], posts: { some: { title: x, 'author': { is: { emial } } } } },
  orderBy: [{ id: 'asc' }], select: { profile: { select: { bio: true } }, posts: { where: { tags: { every: { labell: 1 } } }, orderBy: { id: 'asc' } } }, distinct: ['email', "id"] })
tx.post.create({ data: { title, author: { create: { email: a ? b : c } } }, /* include: { no: 1 } */ include: { tags: true } })
db.tag.explode({ where: { no: 1 } }); prisma.nothing.count({ where: { x: 1 } })
const rows = db.select({ a: 1 }).from(orders); tx.insert(users).values({}); Array.from(things)
"""
    got = [(m, n) for m, n, _ in used(spark, text, walks.call_fields)]
    assert got == sorted([
        ("User", "email"), ("User", "id"), ("User", "posts"), ("Post", "title"), ("Post", "author"), ("User", "emial"), ("User", "id"), ("User", "profile"), ("Profile", "bio"),
        ("User", "posts"), ("Post", "tags"), ("Tag", "labell"), ("Post", "id"), ("User", "email"), ("User", "id"),
        ("Post", "title"), ("Post", "author"), ("User", "email"), ("Post", "tags"), ("Nothing", "x"),
    ])
    tables = walks.tables_used(spark.createDataFrame([("d", text)], "doc string, text string")).collect()
    assert sorted(r.name for r in tables) == ["orders", "users"]


def test_broken_code_ends(spark):
    for text in ("gql`query { user {`", "gql`query { user(`", "gql`... on`", "prisma.user.findMany({ where: {", "prisma.user.findMany(", "gql`{{{}}}}}`", "gql`query { : } a: `"):
        used(spark, text)
        used(spark, text, walks.call_fields)


def test_issues_of_walked_calls_do_not_walk_again(spark):
    """Every level and layer reads what one walk wrote down: no Python is left in the plan of the issues."""
    star = spark.createDataFrame([("Order", "total", "Float"), ("Order", "customer", "Customer"), ("Customer", "name", "String")], "model string, name string, type string")
    texts = spark.createDataFrame([(1, "prisma.order.findMany({ where: { totl: 1, customer: { is: { nme: 'x' } } } })")], "doc long, text string")
    found = grounding.models(walks.typed(walks.call_fields(texts), star), star)
    assert {(r.name, r.severity) for r in found.collect()} == {("Order.totl", "unknown"), ("Order.customer", "ok"), ("Customer.nme", "unknown")}
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_selections_walk_once_in_parts_by_rows(spark, tmp_path):
    """A small file of many customers is walked in several tasks, and once."""
    from quarry.plans import upkeep

    spark.range(45_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert upkeep._dealt(spark.read.parquet(str(tmp_path / "customer.parquet"))).rdd.getNumPartitions() == 3
    found = upkeep.lint_selections(spark, str(tmp_path))
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 45_000 * 9 + 36_000


def test_levels_of_deep_texts_are_written_down(spark):
    """Each level is a join of its own: the plan does not grow with the depth of texts."""
    text = "gql`{ user { " + "posts { author { " * 12 + "id nope { id }" + " }" * 26 + "`"
    typed = walks.typed(walks.query_fields(spark.createDataFrame([("d", text)], "doc string, text string")), fields(spark))
    assert "Join" not in typed._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.model, r.name) for r in typed.collect())
    assert got == sorted([("Query", "user"), *[("User", "posts"), ("Post", "author")] * 12, ("User", "id"), ("User", "nope")])


def test_issues_do_not_deal_uses_out_by_model(spark):
    """Most texts use the same few models: these are sent to the uses, which stay where they are."""
    uses = spark.createDataFrame([(str(i), m, n) for i in range(50) for m, n in (("User", "email"), ("User", "emaill"), ("Nothing", "x"))], "doc string, model string, name string")
    found = grounding.graphql(uses, fields(spark))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    counts = {(r["name"], r.severity, r.candidate): r["count"] for r in found.groupBy("name", "severity", "candidate").count().collect()}
    assert counts == {("User.email", "ok", "User.email"): 50, ("User.emaill", "low", "User.email"): 50, ("Nothing.x", "unknown", None): 50}
