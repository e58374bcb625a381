"""Symbols by language, what strings and comments hide, and typed receivers."""

from __future__ import annotations

import pytest

from quarry.operators import grounding
from quarry.sources import lexer

FILES = {
    "a.ts": ("""// class No { no() {} }
const s = "class Not { x() {} }", t = `function nope() { ${1} }`;
export class Shop<T> extends Base {
  private items: Item[] = [];
  constructor(x: number) { if (x) { go() } }
  async add(item: Item, n = f(1)): Promise<void> { /* } */ while (n) { n-- } }
  get size() { return "}" }
}
interface Named { name: string }
export const run = async (x: number) => { function inner() {} }
function* walk() { for (;;) { call(1) } }
""", {("Shop", "class", None, 3), ("constructor", "method", "Shop", 5), ("add", "method", "Shop", 6), ("size", "method", "Shop", 7), ("Named", "interface", None, 9), ("run", "function", None, 10), ("inner", "function", None, 10), ("walk", "function", None, 11)}),
    "B.java": ("""package x; /* class No { */
public class Bank {
  private final Map<String, Integer> m = new HashMap<>();
  public Bank(int a) { }
  @Override public String toString() { return "} class X {"; }
  static class Inner { void deep(List<String> a) throws Oops { if (a == null) { x(); } } }
}
record Point(int x) { int twice() { return 2 * x; } }
""", {("Bank", "class", None, 2), ("Bank", "method", "Bank", 4), ("toString", "method", "Bank", 5), ("Inner", "class", "Bank", 6), ("deep", "method", "Inner", 6), ("Point", "record", None, 8), ("twice", "method", "Point", 8)}),
    "c.go": ("""package c
type Server struct { addr string }
type Store interface { Get(k string) string }
func (s *Server) Start(n int) error { x := `func no() {` ; return nil }
func main() { go func() {}() }
""", {("Server", "struct", None, 2), ("Store", "interface", None, 3), ("Start", "method", "Server", 4), ("main", "function", None, 5)}),
    "d.rs": ("""/// struct No
pub struct Tree<'a> { x: &'a str }
impl<'a> Tree<'a> { pub fn new() -> Self { let c = '{'; Self { x: "fn no() {" } } fn cut(&self) {} }
impl Display for Tree<'_> { fn fmt(&self) {} }
trait Grow { fn grow(&self); }
fn free() {}
""", {("Tree", "struct", None, 2), ("new", "method", "Tree", 3), ("cut", "method", "Tree", 3), ("fmt", "method", "Tree", 4), ("Grow", "trait", None, 5), ("grow", "method", "Grow", 5), ("free", "function", None, 6)}),
    "e.rb": ("""# class No
class Cart < Base
  def add(item) # def no
    if item then x = "end" end
    items.each do |i|
      puts i
    end
  end
  def self.empty?
  end
end
def free
end
""", {("Cart", "class", None, 2), ("add", "method", "Cart", 3), ("empty?", "method", "Cart", 9), ("free", "function", None, 12)}),
    "f.py": ('''class A:
    """class No:
    def no(self): pass
    """
    def one(self): # def no2(): pass
        def inner(): pass
    async def two(self, x=")"): pass
def free(): pass
''', {("A", "class", None, 1), ("one", "method", "A", 5), ("inner", "function", None, 6), ("two", "method", "A", 7), ("free", "function", None, 8)}),
    "g.php": ("""<?php # class No {
class User { public function name() { return 'function no() {'; } }
function helper() {}
""", {("User", "class", None, 2), ("name", "method", "User", 2), ("helper", "function", None, 3)}),
    "h.kt": ("""class Car(val x: Int) { fun drive(n: Int): Unit { val s = "fun no() {" } }
object Single { fun one() = 1 }
fun Car.paint() {}
fun main() {}
""", {("Car", "class", None, 1), ("drive", "method", "Car", 1), ("Single", "object", None, 2), ("one", "method", "Single", 2), ("paint", "method", "Car", 3), ("main", "function", None, 4)}),
    "i.cs": ("""namespace My.App { public class Repo { string q = @"class No { "; public Task<int> Load(int id) { lock (x) { } return y; } } }
""", {("My.App", "namespace", None, 1), ("Repo", "class", "My.App", 1), ("Load", "method", "Repo", 1)}),
    "j.cpp": ("""class Node { int get() { return 1; } };
int Node::put(int x) { return x; }
static void helper(char *s) { if (s) { } }
class Forward;
""", {("Node", "class", None, 1), ("get", "method", "Node", 1), ("put", "method", "Node", 2), ("helper", "function", None, 3)}),
    "k.swift": ("""struct View { func body() -> Int { 1 } }
extension View { func more() {} }
func top() {}
""", {("View", "struct", None, 1), ("body", "method", "View", 1), ("View", "extension", None, 2), ("more", "method", "View", 2), ("top", "function", None, 3)}),
    "l.scala": ("""object Main { def run(x: Int) = { val s = "def no() {" } }
class Box { def open() = 1 }
""", {("Main", "object", None, 1), ("run", "method", "Main", 1), ("Box", "class", None, 2), ("open", "method", "Box", 2)}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(path, text) for path, (text, _) in FILES.items()] + [("x.ts", None), ("y.md", "class No {}"), ("noext", "class No {}"), ("z.ts", "}}}} class Z { {{{ ")]
    return lexer.symbols(spark.createDataFrame(rows, "path string, text string")).collect()


@pytest.mark.parametrize("path", FILES)
def test_symbols(found, path):
    assert {(r.name, r.kind, r.parent, r.line) for r in found if r.path == path} == FILES[path][1]


def test_signatures(found):
    said = {(r.path, r.name): r.signature for r in found}
    assert said[("a.ts", "add")] == "async add(item: Item, n = f(1)): Promise<void>" and said[("c.go", "Start")] == "func (s *Server) Start(n int) error"
    assert said[("f.py", "two")] == 'async def two(self, x=")"): pass' and [r.name for r in found if r.path == "z.ts"] == ["Z"]


def test_typed_receivers(spark, found):
    index = lexer.members(spark.createDataFrame([tuple(r) for r in found], lexer.SYMBOLS))
    edits = [
        ("1.ts", "const shop = new Shop(1)\nshop.add(x); shop.remove(x); // shop.fake()\nfunction f(s: Shop, q: Other) { s.size(); s.siz(); q.any() }\nMath.max(1); 'shop.nope()'"),
        ("2.java", "Bank b = new Bank(1); b.toString(); b.deep(); Inner i = make(); i.deep(null);"),
        ("3.go", "func f(s *Server) { s.Start(1); s.Stop() ; t := &Server{}; t.Start(2) }"),
        ("4.py", "car = Car(1)\ncar.drive(2)\ncar.driv(3)"),
    ]
    calls = lexer.member_calls(spark.createDataFrame(edits, "path string, text string"))
    got = {(r.doc, r.name): (r.severity, r.candidate) for r in grounding.members(calls, index).collect()}
    assert got == {
        ("1.ts", "Shop.add"): ("ok", "Shop.add"), ("1.ts", "Shop.remove"): ("unknown", None), ("1.ts", "Shop.size"): ("ok", "Shop.size"), ("1.ts", "Shop.siz"): ("low", "Shop.size"),
        ("2.java", "Bank.toString"): ("ok", "Bank.toString"), ("2.java", "Bank.deep"): ("low", "Inner.deep"), ("2.java", "Inner.deep"): ("ok", "Inner.deep"),
        ("3.go", "Server.Start"): ("ok", "Server.Start"), ("3.go", "Server.Stop"): got[("3.go", "Server.Stop")],
        ("4.py", "Car.drive"): ("ok", "Car.drive"), ("4.py", "Car.driv"): ("low", "Car.drive"),
    }
    assert got[("3.go", "Server.Stop")][0] != "ok"
