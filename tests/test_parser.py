from codequarry.sources import parser as P

RUST = '''use crate::worker::Task;
use std::{fmt, io::Write as W};

/// a doc with fn nothing() {}
pub fn helper(x: &str) -> Option<Task> { let s = "fn fake() {"; None }

struct Worker<T> { items: Vec<T> }

impl<T> Job for Worker<T> where T: Clone {
    fn poll(&self) -> usize {
        helper("x"); external::thing(); println!("{}", inner(1)); W::flush()
    }
}

#[test]
fn works() { helper("a"); }
'''
CSHARP = '''using System;
namespace Demo {
    [TestFixture]
    class CalculatorTests : BaseTests {
        [Test]
        public void AddsNumbers() { Helper(1); Console.WriteLine("x(y)"); }
        private static int Helper(int a) => a + 1;
        [TestCase(1)] public void Cases(int n) { if (n > 0) { Helper(n); } }
    }
}
'''
JS = '''import { it } from "vitest";
function helper(a) { return a; }
class App extends Base { run() { helper(1); this.stop(); } }
const arrow = (x) => helper(x);
describe("math", () => { it("adds", named); test.skip('it\\'s', () => { helper(2); }); it(`no ${x}`, named); });
function named() { helper(3); }
'''


def rows(language, text, path):
    out = {}
    for r in P.parse_source(path, language, text):
        out.setdefault(r["record_kind"], []).append(r)
    return out


def test_rust():
    out = rows("rust", RUST, "src/worker.rs")
    assert [(s["name"], s["kind"], s["qualified_name"]) for s in out["symbol"]] == [
        ("helper", "function", "crate::worker::helper"), ("poll", "method", "crate::worker::<Worker<T> as Job>::poll"), ("works", "function", "crate::worker::works"),
    ]
    assert [c["text"] for c in out["call"]] == ["helper", "external::thing", "println!", "std::io::Write::flush", "helper"]
    assert {c["kind"] for c in out["chunk"]} == {"function", "method", "impl_summary", "type_definition"}
    assert [(t["name"], t["framework"]) for t in out["test"]] == [("works", "rust_test")]
    assert {r["text"] for r in out["reference"] if r["kind"] == "import"} == {"use crate::worker::Task;", "use std::{fmt, io::Write as W};"}
    assert out["symbol"][0]["start_line"] == 5


def test_csharp():
    out = rows("csharp", CSHARP, "tests/CalculatorTests.cs")
    assert [s["name"] for s in out["symbol"]] == ["AddsNumbers", "Helper", "Cases"]
    assert out["symbol"][0]["qualified_name"].endswith("Demo::CalculatorTests::AddsNumbers")
    assert [(t["name"], t["framework"]) for t in out["test"]] == [("AddsNumbers", "nunit"), ("Cases", "nunit")]
    assert [c["text"] for c in out["call"]] == ["Helper", "Console.WriteLine", "Helper"]
    assert ("inheritance", "BaseTests") in {(r["kind"], r["text"]) for r in out["reference"]}


def test_javascript():
    out = rows("javascript", JS, "src/app.test.js")
    assert [s["name"] for s in out["symbol"]] == ["helper", "run", "arrow", "named"]
    assert [(t["qualified_name"], t["framework"], t["owner"]) for t in out["test"]] == [("math::adds", "vitest", "app.test::named"), ("math::it's", "vitest", None)]
    assert ("inheritance", "Base") in {(r["kind"], r["text"]) for r in out["reference"]}


def test_config_and_empty_files():
    assert [r["kind"] for r in P.parse_source("Cargo.toml", "toml", "[a]\n")] == ["file_fallback"]
    assert P.parse_source("a.yaml", "yaml", " \n") == []
    assert [r["kind"] for r in P.parse_source("a.rs", "rust", "const X: u8 = 1;\n") if r["record_kind"] == "chunk"] == ["file_fallback"]
    assert any(r["record_kind"] == "diagnostic" for r in P.parse_source("a.rs", "rust", "fn a() {"))


def test_use_aliases():
    assert P.use_aliases("a::b::{self, c as d, e::*, f}") == {"b": "a::b", "d": "a::b::c", "f": "a::b::f"}


def names(language, text):
    return [(r["name"], r["kind"]) for r in P.parse_source("src/a", language, text) if r["record_kind"] == "symbol"]


def test_signatures_and_macro_bodies_are_no_rust_functions():
    text = 'trait T { fn must(&self); fn may(&self) { x(); } }\nmacro_rules! m { ($a:ident) => { fn inner() {} }; }\nimpl A { fn a() { fn deep() {} } }\nthread_local! { fn no() {} }\nfn ok() { vec![1]; }\nextern "C" { fn ext(a: u8); }\n'
    assert names("rust", text) == [("may", "function"), ("a", "method"), ("deep", "method"), ("ok", "function")]


def test_records_and_statements_are_no_csharp_methods():
    text = 'record Person(string Name);\nclass A {\n public A(int x) { }\n async Task Go() { await Run<int>(3); return Parse(a); }\n int Sq(int a) => a * a;\n T Gen<T>(T x) where T : new() { throw new E("x"); }\n public static A operator +(A a, A b) { return a; }\n}\n'
    assert names("csharp", text) == [("A", "method"), ("Go", "method"), ("Sq", "method"), ("Gen", "method"), ("operator +", "method")]


def test_fields_and_signatures_of_typescript():
    text = "interface I { m(): void; n(a: string): number; }\nabstract class C {\n arrow = (a: number) => { go(); };\n private static h = async () => 1;\n abstract ab(): void;\n run(x) { y = () => 2; foo(); }\n get v() { return 1; }\n}\nconst f = async function named() { };\nexport const g = (x) => x;\nfunction top() { obj.cb = () => 1; call(); }\ndeclare function nope(): void;\n"
    method, function = [(n, "method") for n in ("m", "n", "arrow", "h", "ab", "run", "v")], [(n, "function") for n in ("f", "g", "top")]
    assert names("typescript", text) == method + function


def test_bytes_are_those_of_utf8():
    text = "// é ü 日本\nfn a() { \"ß\"; }\n"
    row = next(r for r in P.parse_source("src/a", "rust", text) if r["record_kind"] == "symbol")
    assert text.encode()[row["start_byte"] : row["end_byte"]].decode() == 'fn a() { "ß"; }'
