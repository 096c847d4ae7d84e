import ast
import warnings

import pytest

from codeloom.llm import syntax
from codeloom.llm.derivative import Grammar
from codeloom.llm.syntax import failure, language_of


def test_grammar_by_hand():
    g = Grammar("S = 'a' S? 'b' | 'c'*", "S")

    def run(tokens):
        state = g.begin()
        for i, t in enumerate(tokens):
            state = g.derive(state, t)
            if state is g.empty:
                return i
        return state.nullable

    assert run("ab") is True and run("aabb") is True and run("ccc") is True and run("") is True
    assert run("aab") is False and run("abb") == 2 and run("ba") == 0


def test_derivatives_are_shared_and_rebuilt(monkeypatch):
    g = Grammar("S = ('x' S 'y')?", "S")
    assert g.derive(g.start, "x") is g.derive(g.start, "x")
    monkeypatch.setattr("codeloom.llm.derivative.MAX_NODES", 1)
    assert g.derive(g.derive(g.begin(), "x"), "y").nullable


def test_unknown_rule():
    with pytest.raises(ValueError):
        Grammar("S = Nothing", "S")


JS = [
    "", "  // only\n/* comments */", "import a, { b as c, default as d } from 'x';\nimport * as n from \"y\"\nimport 'z'\nexport { a, b as default } from 'q'; export * as ns from 'm'; export default function () {}",
    "const f = async (a, { b = 1, ...r }, [c, , d] = []) => ({ a, [b]: 1, get x() { return 1 }, async *g() { yield* r } })",
    "let a = 1\nlet b = a\n++b\nfor (const [k, v] of Object.entries(a)) { continue }\nfor (let i = 0, j = 2; i < j; i++);\nfor await (const x of y) break",
    "class A extends (b, c) { static #p = 1; static { this.x = 2 } get = 3; async() {} static async *[x]() {} 'q'() {} #m() { return #p in this } }",
    "x = a ? b : c ? d : e; y = /[/({]+\\/x/gi.test(s) / 2; z = a / b / c; if (x) /re/.test(y)",
    "const t = `a ${b + `in ${c}` + { d: 1 }.d} } ${''} e`; tag`x`; a?.b?.[c]?.(d) ?? e; a ||= b; c **= 2; 10n ** 2n; 1_000.5e3",
    "do x++; while (x < 5) y()\nlabel: for (;;) { break label }\nswitch (a) { case 1: default: b() }\ntry { a } catch { b } finally { c }",
    "({ a, b: [c] } = d); [a, b] = [b, a]; new.target; import.meta.url; new A; new a.b.C(1)(2); delete a[b], void 0; async () => { await x }",
    "var get = 1, set = 2, of = 3, async = 4, from = 5; async = get + of; a\n(b)\n", "#!/usr/bin/env node\nlet x = '\\\n';", "a\n=> b".replace("\n", " "),
]
TS = [
    "interface A<T = unknown> extends B<T>, C { readonly x?: T; [k: string]: any\n m<U>(a: U): asserts a is string; new (): A; (x: number): string }",
    "type U<T> = T extends infer R ? keyof R | `a${string}` : { [K in keyof T as `x`]-?: T[K] }; type F = new (...a: any[]) => void; type T3 = [a: string, b?: number, ...c: x[]]",
    "enum E { A = 1, 'b', C }\ndeclare const enum G { X }\nnamespace N.M { export const a = 1 }\ndeclare module 'm' { export default a }\ndeclare global { var x: any }",
    "abstract class A<T> extends B<T> implements C, D { @Dec(1) private readonly x!: number = 1; constructor(private a: string, public b?: number) { super() } abstract f(): void; declare y: 1; static async g<T>(this: A, x: T): Promise<void> {} get z(): number { return 1 } }",
    "const a = <T,>(x: T): x is string => x as unknown as string; let b = c!.d![0]!; f<number>(1); new Map<string, number[]>([['a', [1, 2]]]); x satisfies Y; let q: typeof import('a'); import type { A } from 'b'; export type { A }; import t = require('x'); export = t",
    "function f(a: string): void;\nfunction f(a?: any) { return a! }\n@A @B() export class X {}\nlet fn: (a: number) => () => void = null\nconst y = a < b && c > d; const z = a >> 2 >>> 3 >= 1",
]
PY = [
    "", "# c\n", "def f(a, /, b: int = 1, *args, c, **k) -> x:\n    '''d'''\n    return lambda *a, b=1: (yield)\n", "async def f():\n  async with a as b, c: await d\n  async for x in y: pass\n  else:\n    pass\n",
    "match x:\n  case {'a': [1, *r], **k} if k: pass\n  case A(b, c=1) | None: pass\n  case -1 | 'a' 'b' as q: pass\nmatch = 1\ntype X[T] = list[T]\nprint(match, type)\n", "x = [i for i in a if b if c]; y = {**a, 'b': 1}; z = {1, *b}; a[1:2, ::3, ...] = b, = c\n",
    "try:\n\tpass\nexcept* (A, B) as e:\n\tpass\nfinally: pass\nwith (open(a) as b, c as d,): pass\nif (n := 1) > 0: pass\nelif x: pass\nelse: pass\n", "f'{a!r:>{w}} {{}} {b=} {c[\"d\"]}' rf'\\d{x}' 'z'; b'z'\nx: int\ny: str = 'a'; del x, y[0]; global q; assert a, b; raise A from b\n@a.b(c)\nclass C(B, metaclass=M): x = 1\n",
    "if a:\n    b = (1,\n  2)\n\n    # odd\n  # c\n    c \\\n  = 2\nx = 0xFF + 1_0j + .5e-3\n", "def g[T: int, *Ts, **P](x: T): ...\nfor x, in *a, b: pass\nwhile 1: break\nreturn_ = not a in b is not c\n",
]
PHP = [
    "", "just text", "<h1>a</h1><?php echo 1 ?> b <?= $c ?>", "<?php\nnamespace A\\B;\nuse C\\D as E, F;\nuse function G\\h;\nuse I\\{J, K as L};\nconst X = 1;\ndeclare(strict_types=1);",
    "<?php\nabstract class A extends B implements C { use T { a as protected b; } public const X = 1, Y = 2; private ?int $a = 1; public function __construct(private readonly int|string $x = 1, &...$r) {} abstract function f(): static; public static fn() { } }".replace("public static fn() { }", ""),
    "<?php\nenum S: string { case A = 'a'; const D = self::A; public function l(): string { return match(true) { $this === self::A, 1 => 'x', default => throw new E }; } }",
    "<?php $a = fn($x) => $x ?? 1; $b = function() use (&$c): int { return 1; }; [$a, 'b' => [$c]] = $d; list(, $e) = $f; $g?->h?->i(...); new class(1) extends B {}; static fn() => 1; #[A(1)] function z() {}",
    "<?php echo \"a {$b['c']} ${d} $e[0] {$f->g(\"x\")}\"; $x = <<<EOT\n it's ({ {$a}\n EOT . 'b'; $y = <<<'N'\nraw\nN; `ls`;", "<?php if ($a): elseif ($b): else: endif; foreach ($a as $k => &$v): endforeach; for (;;) { continue 2; } switch ($a) { case 1: default; } while (1): endwhile; do { } while (0);",
    "<?php (int) $a; $a instanceof B; $a <=> $b; clone $a; print 'x'; isset($a, $b); empty($c); exit; !$a = f(); $$v = 1; A::$b::c(); $o::class; try { } catch (A | B) { } finally { } goto x; x: unset($a); yield_(); global $q; static $s = 1; # c\n// d ?>",
]


@pytest.mark.parametrize("lang,texts", [("javascript", JS), ("typescript", JS + TS), ("python", PY), ("php", PHP)])
def test_valid(lang, texts):
    for t in texts:
        if lang == "python":
            ast.parse(t)
            assert syntax._parse_tokens(t, lang) is None, t
        if lang == "javascript" or lang == "typescript" or lang == "php":
            assert failure(t, lang) is None, (t, failure(t, lang), t[failure(t, lang)[1]:][:40])


BROKEN = [
    ("javascript", "let a = {\n", "truncated", None), ("javascript", "f(1;", "token", 3), ("javascript", "<<<<<<< HEAD\na()\n", "token", 0), ("javascript", "const x: number = 1", "token", 7), ("javascript", "a = 'open\n", "token", 4),
    ("javascript", "`open ${a", "truncated", None), ("javascript", "/* open", "truncated", 0), ("javascript", "}", "token", 0), ("javascript", '{ "a": 1 }', "token", 5), ("javascript", "let let2 = a b", "token", 13), ("javascript", "f() = 1", "token", 4), ("javascript", "a\x00b", "token", 1),
    ("javascript", "# Heading\n\nSome text here", "token", 0), ("javascript", "let x = \ufffd y", "token", 8), ("javascript", "enum A {}", "token", 0), ("typescript", "interface A { x: }", "token", 17), ("typescript", "<?php echo 1;", "token", 1), ("typescript", "class A { f( { }", "truncated", None),
    ("python", "def f(:\n  pass\n", "token", 6), ("python", "if a:\n", "truncated", None), ("python", "x = (1,\n", "truncated", None), ("python", "  x = 1\n", "token", None), ("python", "if a:\n    b\n  c\n", "token", None), ("python", "f() = 1\n", "token", 4), ("python", "x = 'open\ny = 1\n", "token", 4),
    ("python", "x = f'{a'\n", "token", None), ("python", "x = f'}'\n", "token", None), ("python", "'''open", "truncated", None), ("python", "a = 1\n\x00", "token", 6), ("python", "print 'x'\n", "token", 6), ("python", "try:\n  a\nb\n", "token", None),
    ("php", "<?php $a = ;", "token", 11), ("php", "<?php function f() {", "truncated", None), ("php", "<?php }", "token", 6), ("php", "<?php $a = 'open;", "truncated", None), ("php", "<?php =======\n", "token", 6), ("php", '<?php "a {$b";', None, None), ("php", "<?php class A { $x; }", "token", 16),
]


@pytest.mark.parametrize("lang,text,kind,at", BROKEN)
def test_broken(lang, text, kind, at):
    found = failure(text, lang)
    assert found is not None
    assert (kind is None or found[0] == kind) and (at is None or found[1] == at), found


def test_python_agrees_with_the_standard_parser():
    base = "\n".join(PY[2:])
    import random

    rng = random.Random(5)
    for _ in range(300):
        i = rng.randrange(len(base))
        t = base[:i] + rng.choice(["", "(", ")", ":", "'", "\n", "  ", "=", ","]) + base[i + rng.randrange(3):]
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(t)
            ok = True
        except (SyntaxError, ValueError):
            ok = False
        if ok:
            assert failure(t, "python") is None
            assert syntax._parse_tokens(t, "python") is None, t


def test_deep_nesting():
    assert failure("x = " + "[" * 3000 + "]" * 3000, "javascript") is None
    assert failure("x = " + "(" * 3000 + "1" + ")" * 2999, "javascript")[0] == "truncated"


def test_language_of():
    assert [language_of(p) for p in ("a.ts", "a/b.mjs", "x.py", "y.d.php", "no", None, "a.css", "")] == ["typescript", "javascript", "python", "php", None, None, None, None]
    assert failure(None, "python") is None and failure("(", None) is None


# Texts beside the limits of the grammars: what may not stand there, and what may.
BESIDE_BAD = [("javascript", x) for x in ("const x;", "const {a};", "let [a];", "({a = 1})", "class { }", "a ?? b || c", "a && b ?? c", "f({a = 1})")]+ [("python", x) for x in ("f(a=1, 2)\n", "def f(a=1, b): pass\n", "lambda *: 1\n", "class A(x for x in y): pass\n", "def f(*): pass\n", "def f(**k, a): pass\n", "f(**a, *b)\n", "f(**a, b)\n", "def f(/, a): pass\n")]+[('typescript', "const x: number;")]
BESIDE_GOOD = [("javascript", x) for x in ("({a = 1} = x)", "[{a = 1}, b.c = 2] = x", "for (const x of y);", "for ({a = 1} of b);", "(a ?? b) || c", "a ?? b ?? c", "export default class { }", "x = class { }", "a ?? (b && c)", "({a = 1}) => a", "async ({a = 1}, [b = 2]) => a", "let a, b = 2; var c", "\\u0061bc = 1", "[a, ...b] = c", "[...[a, b]] = c; ({...a.b} = c); ({a: b.c = 1, [d]: [e]} = f)", "a ? b ?? c : d || e", "a || b && c | d", "x = {a, b, c: {d}}", "[a[0], b.c] = d; [a.b] = [1]")]
BESIDE_GOOD += [("typescript", x) for x in ("<const>['a']", "declare const x: number;", "declare namespace A { const b: number; export let c: string }", "let x!: number;", "export abstract class A {}", "export default abstract class {}", "x = y as const", "a ?? b as any", "declare module 'm' { const q: 1 }", "const f = <T>(x: T) => x ?? 1")]
BESIDE_GOOD += [("python", x) for x in ("f(a, *b, c=1, *d, **e, f=2)\n", "f(*a, b, c=1)\n", "f(x for x in y)\n", "def f(a, b=1, /, c=2, *d, e, f=3, **g): pass\n", "def f(a, /, b, *, c): pass\n", "def f(*a): pass\n", "def f(**k,): pass\n", "lambda a, b=1, /, *c, d=1, **e: 1\n", "lambda: 1\n", "class A(B, metaclass=C, **k): pass\n", "f(a, b,)\nf(a=1,)\n", "f((x for x in y), 1)\n", "print(*a, sep='')\n", "def f(a, b,): pass\n", "f(**a, b=1, **c)\n", "f(a := 1)\n", "lambda *, a: a\n", "lambda *a, b: a\n")]
BESIDE_GOOD += [("php", x) for x in ("<?php $a ?? throw new E();", "<?php $a = $b ?? throw new E('x');", "<?php $a and print 'x';", "<?php f() or die('x');", "<?php $a = $b && $c = 5;")]


@pytest.mark.parametrize("lang,text", BESIDE_BAD)
def test_beside_the_grammar(lang, text):
    assert failure(text, lang) is not None


@pytest.mark.parametrize("lang,text", BESIDE_GOOD)
def test_inside_the_grammar(lang, text):
    assert failure(text, lang) is None
