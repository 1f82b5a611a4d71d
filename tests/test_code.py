"""Code chunks and links by a table of snippets, and time that grows with the text alone."""

import time

import pytest

from tidemark.chunkers import chunker_for

#: (file, text, definitions as kind:holder.name, links as kind:name), both in order.
CASES = [
    ("a.rs", "mod m { struct S { x: u8 } fn go() { run(); } }\nfn out() {}", "module:m struct:m.S function:m.go function:out", "calls:run"),
    ("a.rs", "/* fn ghost() { /* nested */ } */ fn f<'a>(x: &'a str) -> char { '{' }\nfn g() {}", "function:f function:g", ""),
    ("a.rs", "impl<T: Fn() -> u8> Show for Vec<T> {\n    fn show(&self) { self.len(); vec![1]; parse::<u8>(x) }\n}", "impl:Vec method:Vec.show", "implements:Show calls:len calls:vec calls:parse"),
    ("a.rs", "#[derive(Debug)]\npub struct P(u8);\nenum E { A(u8), B }\ntrait T { fn need(&self); fn have(&self) { need() } }", "struct:P enum:E trait:T method:T.need method:T.have", "calls:need"),
    ("a.rs", "use a::b::{c, d as e, self};\nuse std::fmt;\nmacro_rules! m { ($x:expr) => { go($x) } }\ntype A = B;\nmod other;", "macro:m class:A module:other", "imports:c imports:d imports:fmt calls:go"),
    ("a.rs", 'fn f() { let s = r#"fn no() { " }"#; let t = "fn no2() {"; go() }\nfn g(x: [u8; 3]) -> [u8; 2] { h() }', "function:f function:g", "calls:go calls:h"),
    ("a.rs", "impl a::S { pub(crate) async unsafe fn x() {} }\nfn y(f: impl Fn(u8)) -> impl Iterator { z() }", "impl:S method:S.x function:y", "calls:z"),
    ("a.rs", "impl S { fn a(&self) { fn inner() { b() } } }", "impl:S method:S.a function:S::a.inner", "calls:b"),
    ("a.rs", "union U { a: u8 }\nconst X: u8 = make();\nfn é() { ü() }", "struct:U function:é", "calls:make calls:ü"),
    ("a.rs", "fn f() where X: Y { g(h(1)) }", "function:f", "calls:g calls:h"),
    ("A.java", "class A { /* } */ int x = make(); A() { super(); } /* c */ void m() { go(); } }", "class:A method:A.A method:A.m", "calls:make calls:go"),
    ("A.java", "package p;\nimport a.b.C;\nimport static d.E.f;\npublic final class A extends B implements I, J<K> {\n  @Override public <T> List<T> get(int[] x) throws X { return new D(y(1)); }\n}", "class:A method:A.get", "imports:C imports:f implements:B implements:I implements:J references:D calls:y"),
    ("A.java", "interface I { void a(); default int b() { return c(); } }\nenum E { RED(1), BLUE(2) { void z() {} }; E(int x) {} int v() { return w(); } }", "interface:I method:I.a method:I.b enum:E method:E.E method:E.v", "calls:c calls:w"),
    ("A.java", 'class A { String s = """\n class Ghost { " }\n """; char c = \'{\'; class B { void n() { if (x) { go(); } } } }', "class:A class:A.B method:A.B.n", "calls:go"),
    ("A.java", "record P(int x, int y) { int sum() { return x + y; } }", "class:P method:P.sum", ""),
    ("A.java", "@Anno(value = f(1)) class A { @Test(a = 1) void t() { B.c(); } int[] arr() { return null; } }", "class:A method:A.t method:A.arr", "calls:f calls:c"),
    ("A.java", "abstract class A<T extends C> { abstract T t(String s); protected A<T> u() { return this; } }", "class:A method:A.t method:A.u", "implements:C"),
    ("A.java", "class A { void f() { Runnable r = () -> { go(); }; new B() { void g() {} }; } void h() {} }", "class:A method:A.f method:A.h", "calls:go references:B"),
    ("a.go", 'package p\n\nimport (\n\t"fmt"\n\tx "a/b-c"\n)\n\nfunc (s *S) Do(x int) (int, error) {\n\treturn fmt.Sprint(x), nil\n}\n', "method:Do", "imports:fmt imports:b-c calls:Sprint"),
    ("a.go", 'import "os"\ntype S struct {\n\tx int\n}\ntype I interface {\n\tDo(x int) int\n}\ntype N int\nfunc f() *S { return &S{x: g()} }', "struct:S interface:I class:N function:f", "imports:os calls:Do references:S calls:g"),
    ("a.go", "func a(x interface{}) interface{} { return `}` + \"{\" + string('{') }\nfunc b() { c() }", "function:a function:b", "calls:string calls:c"),
    ("a.go", "type (\n\tA struct{ x int }\n\tB interface{}\n\tC = A\n)\nfunc d() { func() { e() }() }", "struct:A interface:B class:C function:d", "calls:e"),
    ("a.go", "func G[T any](x T) T { /* func no() {} */ return h[T](x) } // func no2() {", "function:G", ""),
    ("a.ts", "// ghost() fake(\nconst s = 'fake(1)' + \"}\";\nfunction a() { return b(`x ${c({d: 1})} }`) }\nfunction e() {}", "function:a function:e", "calls:b calls:c"),
    ("a.ts", "function a() { return /[{/]\\/{/.test(x) }\nfunction b() { return 1 / 2 / c() }", "function:a function:b", "calls:test calls:c"),
    ("a.ts", "type T = { a: string } | U<V>\ntype W = X;\ninterface I { a: string; go(x: number): void }\nenum E { A, B }", "class:T class:W interface:I method:I.go enum:E", ""),
    ("a.ts", "import { x } from './lib/util.js'\nimport 'side'\nconst y = require('z')\nexport class C<T> extends D.E implements I, J {\n  private n = 1\n  constructor(a: A) { super() }\n  async go(x: { a: string }): Promise<void> { this.f(new G(1)) }\n  get v() { return 1 }\n}", "class:C method:C.constructor method:C.go method:C.v", "imports:util imports:side imports:z implements:E implements:I implements:J references:A references:Promise calls:f references:G"),
    ("a.ts", "export const f = async (x: number): Promise<string> => {\n  return g(x)\n}\nconst h = x => k(x)\nconst m = function () { n() }\nlet v = 3", "function:f function:h function:m", "references:Promise calls:g calls:k calls:n"),
    ("a.ts", "class A {\n  a() { if (x) { b() } for (;;) {} }\n\n  static c<T>(y: T) { return () => { d() } }\n}\nfunction e() {}", "class:A method:A.a method:A.c function:e", "calls:b references:T calls:d"),
    ("a.js", "const a = 1\nfunction b() {}\nexport default function c() { d() }\nobj.class = 3", "function:b function:c", "calls:d"),
    ("a.jsx", "function A() { return <div className=\"x\">don't {b()}</div> }\nfunction C() { return d() }", "function:A function:C", "calls:b calls:d"),
    ("a.js", "#!/usr/bin/env node\nfunction a() { return `a${`b${c()}`}}` }\nfunction d() {}", "function:a function:d", "calls:c"),
    ("a.js", "class A { #x = 1; static { init() } *gen() { yield 1 } async *ag() {} }\nfunction* g() {}", "class:A method:A.gen method:A.ag function:g", "calls:init"),
    ("a.js", "const { a } = b()\nconst f = async function () { c() }\nconst x = y / z; const r = /'/g; const w = d('/')", "function:f", "calls:b calls:c calls:d"),
    ("a.rb", "class Foo < Bar::Baz\n  def bar(x = 1)\n    baz(1) if x\n    y.each do |z|\n      z.go\n    end\n  end\n\n  def self.make\n    Foo.new\n  end\nend\n", "class:Foo method:Foo.bar method:Foo.make", "implements:Baz calls:baz calls:each calls:go references:Foo"),
    ("a.rb", "require 'a/b'\nrequire_relative \"c\"\nmodule M\n  include Comparable\n  # def ghost\n  def ok?\n    while x do y end\n    x = if a then b else c end\n    \"def no #{d(1)}\"\n  end\nend\n", "module:M function:M.ok?", "imports:b imports:c implements:Comparable"),
    ("a.rb", "def a = b(1)\ndef c(x) = d(x)\ndef e\n  case x\n  when 1 then f(2)\n  end\nend\n", "function:a function:c function:e", "calls:b calls:d calls:f"),
    ("a.rb", "class A\n  def x\n    begin\n      go(1)\n    rescue E\n      2\n    end until done\n  end\n  def y; z(1); end\nend\nclass B; end", "class:A method:A.x method:A.y class:B", "calls:go calls:z"),
    ("a.rb", "=begin\ndef ghost\n=end\ndef a\n  s = <<~TXT\n    def no\n  TXT\n  {if: 1, class: 2}\n  return unless s\nend\ndef b; end", "function:a function:b", ""),
    ("a.rb", "class A::B\n  attr_reader :end\n  def ==(o)\n    o.class == self.class\n  end\nend\n", "class:B method:B.==", ""),
    ("p.py", "import a.b as c\nfrom d import e\nclass A(B, f.C):\n    def m(self):\n        def n():\n            return g(h(1))\n", "class:A method:A.m function:A.m.n", "imports:b imports:e implements:B implements:C calls:g calls:h"),
    ("p.py", "async def f():\n    await g()\n@dec(1)\ndef h(): pass\n", "function:f function:h", "calls:g calls:dec"),
]


@pytest.mark.parametrize("path,text,defined,links", CASES)
def test_snippets(path, text, defined, links):
    parsed = chunker_for("code")(text, path)
    held = [c for c in parsed.chunks if not (c.kind == "module" and c.symbol == path.split(".")[0])]
    separator = {"rs": "::", "rb": "#"}.get(path.split(".")[-1], ".")
    names = [f"{c.kind}:{c.heading.replace(separator, '.') + '.' if c.heading and separator != '::' else c.heading + '.' if c.heading else ''}{c.symbol}" for c in held]
    assert names == defined.split()
    assert [f"{x.kind}:{x.symbol}" for x in parsed.links] == links.split()
    raw = text.encode()
    for c in parsed.chunks:
        assert raw[c.start : c.end].decode() == c.content
        assert c.parent is None or parsed.chunks[c.parent].start <= c.start and c.end <= parsed.chunks[c.parent].end


@pytest.mark.parametrize("path,one", [("a.rs", "fn f{i}(x: &str) -> u8 {{ g(x, '{{', \"}}\") }}\n"), ("a.ts", "export function f{i}() {{ return `a${{g(1)}}` + /[{{]/.source }}\n"), ("A.java", "class C{i} {{ void m() {{ g(); }} }}\n"), ("a.rb", "def f{i}\n  g(1)\nend\n")])
def test_time_is_linear(path, one):
    took = []
    for n in (5_000, 40_000):
        text = "".join(one.format(i=i) for i in range(n))
        began = time.process_time()
        parsed = chunker_for("code")(text, path)
        took.append(time.process_time() - began)
        assert sum(x.kind == "calls" for x in parsed.links) == n
    assert took[1] < 20 * took[0]
