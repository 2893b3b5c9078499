"""The lexer and the declarations found with it."""

import time

import pytest

from lexmill.functions import lexer
from lexmill.operators import entities as E


def found(text, language):
    return [(e["type"], e["name"], e["class_name"], e["line_start"], e["line_end"]) for e in E.brace_entities("f", text, language)][1:]


@pytest.mark.parametrize("language,text,code", [
    ("javascript", "a = /[/'\"]}/g; b = c / d / e", "a =           ; b = c / d / e"),
    ("javascript", "x(`a ${b + `c}${d}`} }`) }", "x(     b +        d     ) }"),
    ("javascript", "s = 'it\nf()", "s =    \nf()"),
    ("javascript", "return /}/.test(x) ? '}' : 1 // }", "return    .test(x) ?     : 1     "),
    ("javascript", "a[0] / 2; (b) / 3 /* } */", "a[0] / 2; (b) / 3        "),
    ("php", "<p>it's {</p><?php $a = <<<X\n it's }\n X; b(); ?> } <?= c()", None),
    ("php", "$a = \"x\n}\"; # }\n#[Attr]\nf();", "$a =   \n  ;    \n#[Attr]\nf();"),
    ("css", "a { b: \"}\" } /* { */ c {}", "a { b:     }         c {}"),
])
def test_what_is_code(language, text, code):
    got = lexer.read(text, language).code
    assert len(got) == len(text) and got.count("\n") == text.count("\n")
    if code is not None:
        assert got.split() == code.split() and all(c in (" ", "\n", t) for c, t in zip(got, text, strict=True))
    else:
        assert got.split() == ["$a", "=", ";", "b();", "c()"]


JS = """/** Top. */
export default class A extends B {
  static x = 1
  y = (a) => { return a }
  a() { return s.replace(/'/g, 1) }
  async *b(p = {}) { if (p) { go() } }
  #p() { q() }
  get c() { return `${ { d: `}` }.d } }` }
  e(): { n: number } { return 1 }
  constructor() { f() }
}
function c(x) { return x / 2 / 3 }
if (q) { var g = async x => { h() } }
const k = (a, b) => a + b
export function d() { return '}' }
new (class { m() {} })
"""


def test_javascript():
    assert found(JS, "javascript") == [("class", "A", "", 2, 11), ("method", "a", "A", 5, 5), ("method", "b", "A", 6, 6), ("method", "#p", "A", 7, 7), ("method", "c", "A", 8, 8), ("method", "e", "A", 9, 9), ("function", "c", "", 12, 12), ("arrow-function", "g", "", 13, 13), ("function", "d", "", 15, 15)]
    top = list(E.brace_entities("f", JS, "javascript"))[1]
    assert (top["docblock"], top["signature"]) == ("/** Top. */", "export default class A extends B")


PHP = """<?php
namespace App\\X;
/** Doc of C. */
abstract class C extends D {
    #[Attr]
    public function one(array $a = ['}']): string { return <<<EOT
        it's {$a} }
        EOT; }
    abstract protected function two();
    private static function &three() { $f = function () { return 1; }; return new class { }; }
}
enum Suit: string { case A = 'a'; public function label() { return "it's"; } }
$x = $y->class; Foo::class; // class Z {
function four() { return `}`; }
"""


def test_php():
    assert found(PHP, "php") == [("class", "C", "", 4, 11), ("method", "one", "C", 6, 8), ("method", "two", "C", 9, 9), ("method", "three", "C", 10, 10), ("enum", "Suit", "", 12, 12), ("method", "label", "Suit", 12, 12), ("function", "four", "", 14, 14)]
    first, *rest = list(E.brace_entities("f", PHP, "php"))[1:]
    assert first["docblock"] == "/** Doc of C. */" and first["namespace"] == "App\\X" and rest[1]["visibility"] == "protected"


def test_css_of_any_depth(spark):
    many = "@media print {" + "".join(f"a{i} {{ b: {i} }}" for i in range(100_000)) + "}"
    deep = "".join(f"@media l{i} {{ " for i in range(10)) + "x { y: z }" + " }" * 10
    rows = spark.createDataFrame([("many", many), ("deep", deep), ("none", "/* a {} */"), ("open", "a { b { c: d }")], "filename string, content string")
    got = E.css_rules(rows).groupBy("filename", "type").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("many", "css-media-query"): 1, ("many", "css-rule"): 100_000, ("deep", "css-media-query"): 10, ("deep", "css-rule"): 1, ("none", "file"): 1, ("open", "css-rule"): 1}


@pytest.mark.parametrize("language", ["javascript", "php", "css"])
@pytest.mark.parametrize("piece", ["x", "/", "'", '"', "`", "`${", "/*", "{", "}", "(", "(x", "[", "\\", "class A{", "function f(", "a(", "x(){", "const a=", "<<<A\n", "<?php ", "\n", " ", "/[", "/**", "@media {", "=>", "#"])
def test_time_grows_with_the_text(language, piece):
    text = piece * (1 << 20) if piece in ("x", " ", "\n") else piece * 20_000
    began = time.time()
    list(E.HELPERS[language]("f", "class A { " + text))
    assert time.time() - began < 10
