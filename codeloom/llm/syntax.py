"""Source files that do not parse: lexers that feed the derivative parser."""

from __future__ import annotations

import re
from functools import lru_cache

from codeloom.llm import grammars as G
from codeloom.llm.derivative import Grammar

#: Language of a file by the extension of its path.
EXTENSIONS = {".ts": "typescript", ".mts": "typescript", ".js": "javascript", ".mjs": "javascript", ".py": "python", ".php": "php"}


def language_of(path: str | None) -> str | None:
    """The language that the extension names, or None."""
    return EXTENSIONS.get("." + path.rsplit(".", 1)[1]) if path and "." in path else None


@lru_cache(maxsize=None)
def grammar(lang: str) -> Grammar:
    if lang in ("javascript", "typescript"):
        return Grammar(G.ecmascript(lang == "typescript"), "Module")
    return Grammar(G.PYTHON if lang == "python" else G.PHP, "File")


_ES = re.compile(
    r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*(?:[^*]|\*(?!/))*\*/)*"
    r"(?:(?P<w>(?:[^\W\d]|\$|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})(?:[\w$\u200c\u200d]|\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})*)"
    r"|(?P<o>\{)|(?P<c>\})"
    r"|(?P<s>'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\")"
    r"|(?P<n>0[xX][\da-fA-F](?:_?[\da-fA-F])*n?(?![\w$])|0[bB][01](?:_?[01])*n?(?![\w$])|0[oO][0-7](?:_?[0-7])*n?(?![\w$])|(?:(?:0|[1-9](?:_?\d)*)n|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)(?![\w$]))"
    r"|(?P<d>/=?)|(?P<t>`)|(?P<h>\#[A-Za-z_$][\w$]*)|(?P<b>!(?!=))"
    r"|(?P<p>\.\.\.|\?\.(?!\d)|=>|===|!==|==|!=|\*\*=|\*\*|<<=|<<|<=|>=|&&=|&&|\|\|=|\|\||\?\?=|\?\?|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|[()\[\];,.<>+\-*%&|^~?:=@])"
    r"|(?P<e>\Z)|(?P<x>[\s\S]))"
)
_ES_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?:(`)|(\$\{))")
_ES_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_NEWLINE = re.compile(r"[\n\r\u2028\u2029]")
_ES_WORDS = {
    "javascript": {w: w for w in f"{G.HARD} {G.STRICT} {G.SOFT_JS}".split()},
    "typescript": {w: w for w in f"{G.HARD} {G.STRICT} {G.SOFT_TS}".split()},
}
_OPERAND_END = re.compile(r"[\w$)\]\"'`]")

Failure = tuple[str, int] | None  # ("token" or "truncated", offset)


def _open_end(text: str, at: int) -> str:
    """Whether a text that can't be read on at ``at`` just ends too early: an open comment or template."""
    return "truncated" if text.startswith(("/*", "`"), at) or at >= len(text) else "token"


def _parse_es(text: str, lang: str) -> Failure:
    g = grammar(lang)
    state, empty, derive = g.begin(), g.empty, g.derive
    words, typed = _ES_WORDS[lang], lang == "typescript"
    braces: list[bool] = []  # for each open brace, whether it stands in a template
    pos = end = 0
    if text.startswith("#!"):
        m = _NEWLINE.search(text)
        pos = m.start() if m else len(text)
    scan = _ES.match
    while True:
        m = scan(text, pos)
        kind = m.lastgroup
        at, pos = m.span(kind)
        if kind == "w":
            t = words.get(m[kind], "ID")
        elif kind == "p":
            t = m[kind]
            if t == "|":
                t = "BAR"
        elif kind == "o":
            t = "{"
            braces.append(False)
        elif kind == "c":
            t = "}"
            if braces and braces.pop():
                r = _ES_TEMPLATE.match(text, pos)
                if r is None:
                    return "truncated", at
                pos = r.end()
                t = "TPLTAIL" if r[1] else "TPLMID"
                if r[2]:
                    braces.append(True)
        elif kind == "s":
            t = "STR"
        elif kind == "n":
            t = "NUM"
        elif kind == "b":
            t = "BANG" if typed and at and at == end and _OPERAND_END.match(text, at - 1) and last not in G.HARD.split() else "!"
        elif kind == "t":
            r = _ES_TEMPLATE.match(text, pos)
            if r is None:
                return "truncated", at
            pos = r.end()
            t = "TPL" if r[1] else "TPLHEAD"
            if r[2]:
                braces.append(True)
        elif kind == "d":
            if text.startswith("/*", at):
                return "truncated", at
            t = m[kind]
        elif kind == "h":
            t = "PRIV"
        elif kind == "e":
            if state.nullable or derive(state, "ASI").nullable:
                return None
            return "truncated", at
        else:
            return _open_end(text, at), at
        after = state.d.get(t)
        if after is None:
            after = derive(state, t)
        if t in ("++", "--") and _NEWLINE.search(text, end, at):  # never postfix on a new line
            begun = derive(derive(state, "ASI"), t)
            after = after if begun is empty else begun
        if after is empty and kind == "d":
            r = _ES_REGEX.match(text, at)
            if r:
                pos, t = r.end(), "REGEX"
                after = derive(state, t)
        if after is empty and kind == "b" and t == "BANG":
            after = derive(state, "!")
        if after is empty and (t == "}" or _NEWLINE.search(text, end, at)):
            after = derive(derive(state, "ASI"), t)
            if after is empty and kind == "d" and (r := _ES_REGEX.match(text, at)):
                pos = r.end()
                after = derive(derive(state, "ASI"), "REGEX")
        if after is empty:
            return "token", at
        state, end, last = after, pos, t


_PY = re.compile(
    r"[ \t\f]*(?:(?P<w>[^\W\d]\w*(?![\w'\"]))"
    r"|(?P<f>(?:[fF][rR]?|[rR][fF])(?:'''|\"\"\"|'|\"))"
    r"|(?P<s>(?:[rR][bB]?|[bB][rR]?|[uU])?(?:'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|\"(?!\"\")(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"))"
    r"|(?P<v>[^\W\d]\w*)"
    r"|(?P<n>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?![.\d_eEjJ])|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ]))))"
    r"|(?P<k>\#[^\n\r]*)|(?P<l>\r\n|\n|\r)|(?P<j>\\(?:\r\n|\n|\r))"
    r"|(?P<p>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[()\[\]{}:;,.=+\-*/%@&|^~<>!])"
    r"|(?P<e>\Z)|(?P<x>[\s\S]))"
)
_PY_WORDS = {w: w for w in f"{G.PY_HARD} {G.PY_SOFT}".split()}
_PY_FORMAT = re.compile(r"[^{}]*(?:\{[^{}]*\}[^{}]*)*")


@lru_cache(maxsize=None)
def _f_chunks(quote: str, raw: bool) -> re.Pattern:
    """The literal stretch of an f-string up to a field or its end."""
    own = quote[0]
    plain = rf"[^\\{{}}{own}]" if len(quote) == 3 else rf"[^\\{{}}{own}\n\r]"
    inner = rf"|{own}(?!{own}{own})" if len(quote) == 3 else ""
    named = "" if raw else r"|\\N\{[^}]*\}"
    return re.compile(rf"(?:{plain}{named}|\\(?![{{}}])[\s\S]|\\(?=[{{}}])|\{{\{{|\}}\}}{inner})*(?:({quote})|(\{{))")


def _py_tokens(text: str):
    """Tokens with offsets; ``ERR`` or ``EARLY`` where reading stops."""
    pos, fresh, depth, indents = 0, True, 0, [0]
    fields: list[tuple[int, re.Pattern]] = []  # open f-string fields: depth of brackets, stretch pattern
    line_has = False
    if "\0" in text:
        yield "ERR", text.index("\0")
        return
    if text.startswith("\ufeff"):
        pos = 1
    while True:
        if fresh and not depth:
            m = re.compile(r"(?:[ \t\f]*(?:\#[^\n\r]*)?(?:\r\n|\n|\r))*([ \t\f]*)").match(text, pos)
            pos = m.end()
            rest = text[pos:pos + 1]
            if rest and rest != "#":
                width = 0
                for c in m[1]:
                    width = width + 1 if c == " " else (width // 8 + 1) * 8 if c == "\t" else 0
                if width > indents[-1]:
                    indents.append(width)
                    yield "INDENT", pos
                else:
                    while width < indents[-1]:
                        indents.pop()
                        yield "DEDENT", pos
                    if width != indents[-1]:
                        yield "ERR", pos
                        return
            fresh = False
        m = _PY.match(text, pos)
        kind = m.lastgroup
        at, pos = m.span(kind)
        if kind in "wv":
            line_has = True
            yield _PY_WORDS.get(m[kind], "ID"), at
        elif kind == "p":
            t = m[kind]
            line_has = True
            if fields and depth == fields[-1][0]:
                if t in (":", "!", "!=", ":="):
                    r = re.compile(r"!\s*[rsa]\s*(?=[:}])").match(text, at)
                    if t[0] == "!" and r:
                        pos = r.end()
                        continue
                    if t[0] == ":":
                        pos = _PY_FORMAT.match(text, at + 1).end()
                        continue
                if t == "=" and text[pos:].lstrip()[:1] in ("}", "!", ":"):
                    continue
                if t == "}":
                    _, chunk = fields.pop()
                    depth -= 1
                    yield "F}", at
                    r = chunk.match(text, pos)
                    if r is None:
                        yield "ERR", at
                        return
                    pos = r.end()
                    if r[1]:
                        yield "FEND", pos
                    else:
                        depth += 1
                        fields.append((depth, chunk))
                        yield "F{", pos
                    continue
            if t in "([{":
                depth += 1
                if depth > 200:  # the language's own limit
                    yield "ERR", at
                    return
            elif t in ")]}":
                depth = max(0, depth - 1)
            yield t, at
        elif kind == "s":
            line_has = True
            yield "STR", at
        elif kind == "f":
            line_has = True
            quote = m[kind].lstrip("fFrR")
            chunk = _f_chunks(quote, "r" in m[kind].lower())
            yield "FSTR", at
            r = chunk.match(text, pos)
            if r is None:
                yield ("EARLY" if len(quote) == 3 and text.find(quote, pos) < 0 else "ERR"), at
                return
            pos = r.end()
            if r[1]:
                yield "FEND", pos
            else:
                depth += 1
                fields.append((depth, chunk))
                yield "F{", pos
        elif kind == "n":
            line_has = True
            yield "NUM", at
        elif kind == "l":
            if not depth:
                fresh = True
                if line_has:
                    yield "NEWLINE", at
                line_has = False
        elif kind in "kj":
            if kind == "j" and pos >= len(text):
                yield "EARLY", at
                return
        elif kind == "e":
            if depth:
                return
            if line_has:
                yield "NEWLINE", at
            for _ in indents[1:]:
                yield "DEDENT", at
            return
        else:
            yield ("EARLY" if text.startswith(("'''", '"""'), at) else "ERR"), at
            return


_PHP = re.compile(
    r"(?:\s+|//(?:(?!\?>)[^\n\r])*|\#(?!\[)(?:(?!\?>)[^\n\r])*|/\*(?:[^*]|\*(?!/))*\*/)*"
    r"(?:(?P<v>\$[A-Za-z_\u0080-\U0010ffff]\w*)"
    r"|(?P<w>\\?[A-Za-z_\u0080-\U0010ffff]\w*(?:\\[A-Za-z_\u0080-\U0010ffff]\w*)*)"
    r"|(?P<s>[bB]?'(?:[^'\\]|\\[\s\S])*')|(?P<q>[\"`])"
    r"|(?P<n>0[xX][\da-fA-F](?:_?[\da-fA-F])*|0[bB][01](?:_?[01])*|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)"
    r"|(?P<h><<<[ \t]*(?P<hq>[\"']?)(?P<hn>[A-Za-z_]\w*)(?P=hq)(?:\r\n|\n|\r)(?:[\s\S]*?(?:\r\n|\n|\r))??[ \t]*(?P=hn)\b)"
    r"|(?P<k>\?>(?:\r\n|\n)?)"
    r"|(?P<a>\(\s*(?:int|integer|bool|boolean|float|double|real|string|binary|array|object|unset)\s*\))"
    r"|(?P<o>\{)|(?P<c>\})"
    r"|(?P<p>\#\[|<=>|\*\*=|\.\.\.|<<=|>>=|===|!==|\?\?=|\?->|->|=>|::|<<|>>|<=|>=|==|!=|<>|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|\.=|%=|&=|\|=|\^=|\*\*|[()\[\];,.<>+\-*/%&|^~?:=@!$\\])"
    r"|(?P<e>\Z)|(?P<x>[\s\S]))",
    re.I,
)
_PHP_WORDS = {w: w for w in f"{G.PHP_HARD} enum self from __halt_compiler".split()}
_PHP_TEXT = {q: re.compile(rf"(?:[^{q}\\{{$]|\\[\s\S]|\{{(?!\$)|\$(?!\{{))*(?:({q})|(\{{(?=\$)|\$\{{))") for q in "\"`"}
_PHP_OPEN = re.compile(r"<\?(?:php(?=\s|\Z)|=)", re.I)


def _php_tokens(text: str):
    m = _PHP_OPEN.search(text)
    if m is None:
        if text:
            yield "HTML", 0
        return
    if m.start():
        yield "HTML", 0
    yield "OPEN", m.start()
    if m[0] == "<?=":
        yield "echo", m.start()
    pos = m.end()
    braces: list[str] = []  # for each open brace, the quote of the text that it stands in, or nothing
    while True:
        m = _PHP.match(text, pos)
        kind = m.lastgroup if m.lastgroup not in ("hq", "hn") else "h"
        at, pos = m.span(kind)
        if kind == "v":
            yield "VAR", at
        elif kind == "w":
            w = m[kind]
            yield ("QNAME" if "\\" in w else _PHP_WORDS.get(w.lower(), "ID")), at
        elif kind == "p":
            yield ("EARLY" if text.startswith("/*", at) else m[kind]), at
        elif kind in "sh":
            yield "STR", at
        elif kind == "n":
            yield "NUM", at
        elif kind == "a":
            yield "CAST", at
        elif kind == "o":
            braces.append("")
            yield "{", at
        elif kind == "q" or kind == "c" and braces and braces[-1]:
            quote = m[kind] if kind == "q" else braces.pop()
            yield ("ISTR" if kind == "q" else "I}"), at
            r = _PHP_TEXT[quote].match(text, pos)
            if r is None:
                yield "EARLY", at
                return
            pos = r.end()
            if r[1]:
                yield "IEND", pos
            else:
                braces.append(quote)
                yield "I{", pos
        elif kind == "c":
            if braces:
                braces.pop()
            yield "}", at
        elif kind == "k":
            yield "CLOSE", at
            m = _PHP_OPEN.search(text, pos)
            if m is None:
                return
            if m.start() > pos:
                yield "HTMLX", pos
            if m[0] == "<?=":
                yield "echo", m.start()
            pos = m.end()
        elif kind == "e":
            return
        else:
            yield ("EARLY" if text.startswith(("/*", "'"), at) else "ERR"), at
            return


def _parse_tokens(text: str, lang: str) -> Failure:
    g = grammar(lang)
    state, empty, derive = g.begin(), g.empty, g.derive
    for t, at in (_py_tokens if lang == "python" else _php_tokens)(text):
        after = state.d.get(t)
        if after is None:
            after = derive(state, t)
        if after is empty:
            if t == "EARLY":
                return "truncated", at
            # The dedents at the very end mean that the text stops inside a block.
            return ("truncated" if at >= len(text.rstrip()) and t in ("DEDENT", "NEWLINE") else "token"), at
        state = after
    return None if state.nullable else ("truncated", len(text))


def failure(text: str | None, lang: str | None) -> Failure:
    """Where a text stops being its language: ``None`` if it parses.

    ``("token", offset)`` is the first token that can't stand where it does,
    ``("truncated", offset)`` a text that ends before it is complete. A null
    text or unknown language has nothing to parse. An empty text, blanks or
    comments alone parse.
    """
    if text is None or lang is None:
        return None
    found = _parse_es(text, lang) if lang in ("javascript", "typescript") else _parse_tokens(text, lang)
    return found
