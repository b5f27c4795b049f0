import pytest

from graphloom.parsing.scanner import MOST_BYTES, parse


def facts(source, language="typescript"):
    found = parse(source, language)
    assert found["parseState"] == "OK", found
    return found


def symbol(found, name):
    return next(s for s in found["symbols"] if s["name"] == name)


def names(found):
    return [s["name"] for s in found["symbols"]]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ('import D from "./m";', [("./m", "D", None, [], False, "static")]),
        ('import { a, b as c } from "./m";', [("./m", None, None, ["a", "c"], False, "static")]),
        ('import D, { a } from "./m"\nconst x = 1', [("./m", "D", None, ["a"], False, "static")]),
        ('import * as ns from "./m";', [("./m", None, "ns", [], False, "static")]),
        ('import "./side";', [("./side", None, None, [], False, "static")]),
        ('import type { T } from "./m";', [("./m", None, None, ["T"], True, "static")]),
        ('import { type T, v } from "./m";', [("./m", None, None, ["v"], False, "static"), ("./m", None, None, ["T"], True, "static")]),
        ('const { a } = require("./cjs");', [("./cjs", None, None, [], False, "require")]),
        ('const m = import("./dyn");', [("./dyn", None, None, [], False, "dynamic")]),
        ('const p = "./m"; const m = import(p);', []),
        ('export { a } from "./m";', [("./m", None, None, [], False, "static")]),
    ],
)
def test_imports(source, expected):
    found = [(i["specifier"], i["default"], i["namespace"], i["named"], i["isTypeOnly"], i["syntax"]) for i in facts(source)["imports"]]
    assert found == expected


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ('export { a as b } from "./m";', [("b", False, "./m")]),
        ('export * from "./m";', [("", False, "./m")]),
        ('export * as ns from "./m";', [("ns", False, "./m")]),
        ("export default function foo() {}", [("foo", True, None)]),
        ("const h = 1; export default h;", [("h", True, None)]),
        ("export default () => {};", [("", True, None)]),
        ("class Foo {} export = Foo;", [("Foo", False, None)]),
        ("export const a = 1, b = () => 2;", [("a", False, None), ("b", False, None)]),
        ("export interface I { a(): void }\nexport type T = 1 | 2;\nexport enum E { A }", [("I", False, None), ("T", False, None), ("E", False, None)]),
        ("export function f(a: 1): 1;\nexport function f(a: any) { return a }", [("f", False, None)]),
        ("export abstract class A {}", [("A", False, None)]),
    ],
)
def test_exports(source, expected):
    assert [(e["name"], e["isDefault"], e["reExportFrom"]) for e in facts(source)["exports"]] == expected


@pytest.mark.parametrize(
    ("source", "language", "expected"),
    [
        ("function foo() {}", "typescript", [("foo", "FUNCTION")]),
        ("const foo = () => {};", "typescript", [("foo", "ARROW_FUNCTION")]),
        ("const foo = async <T,>(x: T): Promise<T> => { return x };", "typescript", [("foo", "ARROW_FUNCTION")]),
        ("const foo = function () {};", "typescript", [("foo", "ARROW_FUNCTION")]),
        ("const one = x => x + 1, two = 3", "javascript", [("one", "ARROW_FUNCTION")]),
        ("abstract class Foo { abstract bar(): void; }", "typescript", [("Foo", "CLASS"), ("bar", "METHOD")]),
        ("interface Foo { bar(): void; }", "typescript", [("Foo", "INTERFACE")]),
        ("type Foo = { a: number };\ntype Bar =\n  | 1\n  | 2", "typescript", [("Foo", "TYPE_ALIAS"), ("Bar", "TYPE_ALIAS")]),
        ("const enum Foo { A, B }", "typescript", [("Foo", "ENUM")]),
        ("function Greeting() { return <div>hi</div>; }", "tsx", [("Greeting", "REACT_COMPONENT")]),
        ("const Card = () => <Box a={1} />;", "tsx", [("Card", "REACT_COMPONENT")]),
        ("function Registry() { return { get: 1 }; }", "tsx", [("Registry", "FUNCTION")]),
        ("function useThing() { return 1; } function useful() {}", "typescript", [("useThing", "HOOK"), ("useful", "FUNCTION")]),
        ("function outer() { function inner() {} const h = () => 1; }", "typescript", [("outer", "FUNCTION")]),
        ("const api = { foo() { return 1; }, bar: () => 2, baz: function () {} };", "typescript", []),
        ("function f(a: string): string;\nfunction f(a: number): number;\nfunction f(a: any) { return a; }", "typescript", [("f", "FUNCTION")]),
        ('declare module "x" { export function legacy(): void; }\nfunction real() {}', "typescript", [("real", "FUNCTION")]),
    ],
)
def test_symbol_kinds(source, language, expected):
    assert [(s["name"], s["kind"]) for s in facts(source, language)["symbols"]] == expected


def test_class_members():
    found = facts("class Foo {\n  #hidden = 1;\n  label: string = 'x'\n  constructor(private a: number) {}\n  plain() {}\n  get x() { return 1 }\n  set x(v: number) {}\n  static async create<T>(): Promise<Foo> { return new Foo(1) }\n}")
    members = [s for s in found["symbols"] if s["parentSymbol"] == "Foo"]
    assert [s["name"] for s in members] == ["constructor", "plain", "x", "x", "create"] and {s["kind"] for s in members} == {"METHOD"}


def test_line_ranges_comments_and_decorators():
    found = facts("\n/**\n * Line one.\n * Line two.\n */\nfunction foo() {\n  return 1;\n}\n\n@Component({ a: 1 })\nclass Foo {\n  /** does it */\n  @Input()\n  bar() {}\n}\n// far\n\nfunction lone() {}")
    foo, cls, bar = symbol(found, "foo"), symbol(found, "Foo"), symbol(found, "bar")
    assert (foo["startLine"], foo["endLine"], foo["docComment"]) == (2, 8, "Line one.\nLine two.")
    assert (cls["startLine"], cls["endLine"]) == (10, 15)
    assert (bar["startLine"], bar["docComment"]) == (12, "does it")
    assert symbol(found, "lone")["docComment"] is None


def test_signatures():
    assert symbol(facts("function foo(a: number): number {\n  return a + 1;\n}"), "foo")["signature"] == "function foo(a: number): number"
    long = symbol(facts("function foo<" + ", ".join(f"T{i} extends object" for i in range(200)) + ">(): void {}"), "foo")["signature"]
    assert len(long) < 600 and long.endswith("…")


def test_complexity():
    branchy = "function b(a: number) { if (a > 0) { for (;;) { if (a && 1) { continue } } } else if (a < 0) { return -1 } return a ? 1 : 0; }"
    callback = "function c(xs: number[]) { return xs.filter(function (x) { if (x) { return true } return false }).map((x) => x ? 1 : 2) }"
    found = facts(branchy + callback + "class K {} function s() { return 1 }")
    assert symbol(found, "b")["complexity"] == 7
    assert [symbol(found, n)["complexity"] for n in "cKs"] == [1, 1, 1]


def test_calls():
    found = facts("function outer() { foo(); obj.method(); obj.nested.deep(); a.b().c(); log.i(); log.i(); function inner() { bar<string>() } inner(); new Thing(); const r = require('./m'); this.go(); s?.t?.(); new K(1).m(); xs[0].n(); } foo();")
    calls = [(c["name"], c["receiver"]) for c in symbol(found, "outer")["calls"]]
    assert calls == [("foo", None), ("method", "obj"), ("deep", "obj.nested"), ("b", "a"), ("c", None), ("i", "log"), ("bar", None), ("inner", None), ("go", "this"), ("t", "s"), ("m", "new K(1)"), ("n", "xs[0]")]


def test_heritage():
    found = facts("class Foo extends Base<T> implements IFoo, IBar {} interface I extends A, B<C> {} class M extends mixin(Base) {}")
    assert symbol(found, "Foo")["extends"] == ["Base"] and symbol(found, "Foo")["implements"] == ["IFoo", "IBar"]
    assert symbol(found, "I")["extends"] == ["A", "B"] and symbol(found, "M")["extends"] is None


def test_export_flags():
    found = facts("function a() {} export { a }; export default function b() {} function c() {} export const d = () => 1; class E {} export { E as default }")
    assert [(symbol(found, n)["isExported"], symbol(found, n)["isDefault"]) for n in "abcdE"] == [(True, False), (True, True), (False, False), (True, False), (True, True)]


def test_templates_and_regular_expressions():
    found = facts("function f() { const s = `a ${g(`b ${h()}`)} }`; return /[/}]+/.test(s) && x / y / z(); }\nfunction k() {}")
    assert names(found) == ["f", "k"] and [c["name"] for c in symbol(found, "f")["calls"]] == ["g", "h", "test", "z"]


def test_states():
    assert parse("", "typescript")["parseState"] == "OK"
    assert facts("// only\n/* comments */\n")["symbols"] == []
    broken = parse("function foo( {\n  not valid at all !!! ###\n  return 1\n", "typescript")
    assert broken["parseState"] == "FAILED" and broken["parseErrors"] > 0
    assert parse("a" * (MOST_BYTES + 1), "typescript")["parseState"] == "FAILED"
    assert parse("# hello", None)["parseState"] == "NOT_PARSED"
