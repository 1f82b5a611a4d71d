"""Source code: one chunk for each definition, and links for calls, implementations, imports and references.

Python is parsed by its own grammar. The other languages are read token by token, so that what stands in comments,
strings, templates, regular expressions, character literals and lifetimes is neither a brace nor a name; a stack of open
brackets tells which definition a token is in. Both are linear in the text.
"""

from __future__ import annotations

import ast
import os
import re
from functools import lru_cache

import numpy as np

from . import Chunk, Link, Parsed

LEAST_HEADER = 16
LANGUAGES = {".py": "python", ".pyi": "python", ".rs": "rust", ".ts": "script", ".tsx": "script", ".js": "script", ".jsx": "script", ".mjs": "script", ".cjs": "script", ".go": "go", ".java": "java", ".rb": "ruby"}
#: How a method's name is joined to what holds it.
SEPARATORS = {"rust": "::", "ruby": "#"}
#: What each language skips as comments and reads as literals; of several, the first that fits counts.
COMMENTS = {"rust": r"//[^\n]*", "script": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\A\#![^\n]*", "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "java": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "ruby": r"\#[^\n]*|^=begin\b.*?(?:^=end\b[^\n]*|\Z)|^__END__\b.*"}
LITERALS = {
    "rust": r"""b?r(?P<h>\#*)".*?"(?P=h)|[bc]?"(?:\\.|[^"\\])*"|b?'(?:\\(?:x..|u\{[^}]*\}|.)|[^\\'\n])'|'\w+""",
    "script": r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""",
    "go": r""""(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.|[^'\\\n])+'""",
    "java": r'''""".*?"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+\'''',
    "ruby": r"""<<[~-]?(?P<q>['"]?)(?P<doc>[A-Z_]\w*)(?P=q)[^\n]*\n.*?^[ \t]*(?P=doc)\b|%[wWiIqQ]?(?:\([^)]*\)|\[[^\]]*\]|\{[^}]*\})|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|:[A-Za-z_]\w*[?!]?|\?\w(?!\w)""",
}
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
#: After these a slash divides and a name ends; after anything else it begins a regular expression.
DIVIDES = re.compile(r"[\w$)\]}]\Z")
#: Signs after or before which a statement of a script goes on in the next line.
GOES_ON = frozenset("=> = ( [ { , . | & ? : + - * / < > && || ; ) ]".split()) - {"{", ";", ")", "]"}
NOT_OPERANDS = frozenset("return typeof case in of delete void throw new else do and or not if unless while until when puts".split())
#: Words that are no names of calls, by language.
KEYWORDS = {
    "rust": frozenset("if for while match return fn in as let mut move loop else impl dyn where pub use mod struct enum trait type const static unsafe async await self Self super crate Fn FnMut FnOnce".split()),
    "script": frozenset("if for while switch catch function return typeof await yield in of new delete void throw case else do super import export const let var class static async this extends implements instanceof public private protected abstract readonly override".split()),
    "go": frozenset("if for switch func return select go defer range chan map struct interface type var const case else package import".split()),
    "java": frozenset("if for while switch catch return throw throws new else do try super this synchronized instanceof assert case default yield static final abstract public private protected".split()),
    "ruby": frozenset("if unless while until case when then else elsif end do def class module begin rescue ensure return yield super not and or in self nil puts raise".split()),
}
#: Words of Java that stand before a call rather than before a name that is declared.
BEFORE_CALLS = frozenset("return new throw else do assert case yield instanceof in extends".split())
HOLDERS = ("class", "impl", "trait", "struct", "interface", "enum")

Token = tuple[str, str, int, int]
Definition = tuple[str, str, int, int]
Reference = tuple[str, str, int]


@lru_cache(maxsize=8)
def _pattern(language: str) -> re.Pattern:
    name = {"script": r"[A-Za-z_$\u0080-\U0010ffff][\w$]*", "ruby": r"[@$]*[A-Za-z_\u0080-\U0010ffff]\w*[?!]?(?!=[^=~>])|[@$]*[A-Za-z_]\w*"}.get(language, r"[A-Za-z_\u0080-\U0010ffff]\w*")
    return re.compile(rf"(?P<skip>{COMMENTS[language]})|(?P<lit>{LITERALS[language]})|(?P<id>{name})|(?P<num>\d[\w.]*)|(?P<nl>\n)|(?P<op>=>|->|::|\S)", re.S | re.M)


def tokens(text: str, language: str) -> list[Token]:
    """(kind, text, start, end) of names (id), literals (lit), numbers (num), signs (op) and, in Ruby, line ends (nl)."""
    pattern, out, at, n = _pattern(language), [], 0, len(text)
    templates: list[int] = []  # depths of braces at which an open template goes on
    depth = 0
    while at < n:
        if language == "rust" and text.startswith("/*", at):  # these nest
            inside = 0
            for m in re.compile(r"/\*|\*/").finditer(text, at):
                inside += 1 if m[0] == "/*" else -1
                if not inside:
                    break
            at = m.end() if not inside else n
            continue
        if language == "script" and (text[at] == "`" or (templates and text[at] == "}" and depth == templates[-1])):
            if text[at] == "}":
                templates.pop()
            m = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S).match(text, at + 1)
            end = m.end()
            if text.startswith("${", end):
                templates.append(depth)
                end += 2
            else:
                end = min(n, end + 1)
            out.append(("lit", "", at, end))
            at = end
            continue
        if text[at] == "/" and language in ("script", "ruby") and not (out and ((out[-1][0] == "lit") or (DIVIDES.search(out[-1][1]) and out[-1][1] not in NOT_OPERANDS))):
            m = REGEX.match(text, at)
            if m:
                out.append(("lit", "", at, m.end()))
                at = m.end()
                continue
        m = pattern.search(text, at)
        if not m:
            break
        kind, start = m.lastgroup if m.lastgroup in ("skip", "lit", "id", "num", "nl", "op") else "lit", m.start()
        if start > at and (text[start] in "/`}" and language in ("script", "ruby", "rust")):
            at = start  # what begins here is looked at by the rules above
            continue
        if kind == "op":
            depth += (m[0] == "{") - (m[0] == "}")
        if kind != "skip" and (kind != "nl" or language == "ruby"):
            out.append((kind, m[0], start, m.end()))
        at = m.end()
    return out


class Scopes:
    """Definitions and references, in the order of the text, and the brackets that are open."""

    def __init__(self, text: str):
        self.text, self.defined, self.refs = text, [], []
        self.open: list[int | None] = []  # for each bracket, the definition whose body it is
        self.waiting: tuple[int, int] | None = None  # a definition without its body yet, and the brackets open at its head

    def holder(self) -> str:
        """The kind of the definition whose body the innermost bracket is; nothing elsewhere."""
        return self.defined[self.open[-1]][0] if self.open and self.open[-1] is not None else ""

    def begin(self, kind: str, name: str, start: int) -> None:
        self.finish(start)
        self.waiting = (len(self.defined), len(self.open))
        self.defined.append([kind, name, start, len(self.text)])

    def finish(self, end: int) -> None:
        """The waiting definition has no body."""
        if self.waiting:
            self.defined[self.waiting[0]][3] = end
            self.waiting = None

    def opened(self, body: bool) -> None:
        if body and self.waiting and self.waiting[1] == len(self.open):
            self.open.append(self.waiting[0])
            self.waiting = None
        else:
            self.open.append(None)

    def closed(self, end: int) -> None:
        if self.waiting and len(self.open) <= self.waiting[1]:
            self.finish(end - 1)
        if self.open:
            own = self.open.pop()
            if own is not None:
                self.defined[own][3] = end


def braced(text: str, language: str) -> tuple[list[Definition], list[Reference]]:
    """(kind, name, start, end) of definitions and (kind, name, place) of references, in languages with braces."""
    keywords = KEYWORDS[language]
    toks = tokens(text, language)
    s, n = Scopes(text), len(toks)
    word = lambda k: toks[k][1] if 0 <= k < n else ""
    kind_of = lambda k: toks[k][0] if 0 <= k < n else ""
    start, fresh, i = 0, True, 0
    named: set[int] = set()  # tokens that are neither calls nor references
    lines: set[int] = set()  # definitions of a script that may end with their line

    def after(k: int, opening: str, closing: str) -> int:
        """The token behind the group that opens at k."""
        depth = 0
        while k < n:
            depth += (word(k) == opening) - (word(k) == closing)
            k += 1
            if not depth:
                break
        return k

    def past_types(k: int) -> int:
        return after(k, "<", ">") if word(k) == "<" else k

    def define(kind: str, at: int) -> None:
        if kind_of(at) == "id":
            named.add(at)
            s.begin("method" if kind == "function" and s.holder() in HOLDERS else kind, word(at), start)

    while i < n:
        kind, w, a, b = toks[i]
        newline = language in ("script", "go") and i > 0 and "\n" in text[toks[i - 1][3] : a] and word(i - 1) not in GOES_ON and w not in GOES_ON
        if newline:
            if s.waiting and s.waiting[0] in lines and len(s.open) == s.waiting[1]:
                s.finish(toks[i - 1][3])
            fresh = fresh or not s.waiting
        if language == "rust" and w == "#" and word(i + 1) in ("[", "!"):
            i = after(i + 1 + (word(i + 1) == "!"), "[", "]")
            continue
        if fresh:
            start, fresh = a, False
        if kind == "id":
            before, behind = word(i - 1), word(i + 1)
            if language == "rust":
                if w in ("fn", "struct", "enum", "union", "trait", "mod", "type") and before != "." and kind_of(i + 1) == "id":
                    define({"fn": "function", "union": "struct", "mod": "module", "type": "class"}.get(w, w), i + 1)
                elif w == "macro_rules" and behind == "!":
                    define("macro", i + 2)
                elif w == "impl" and not s.waiting and (before in ("", "}", "{", ";", "unsafe", "]", "default")):
                    k, names = past_types(i + 1), [-1]
                    while k < n and word(k) not in ("{", ";", "where"):
                        if word(k) == "for":
                            names.append(-1)
                        elif kind_of(k) == "id" and (names[-1] < 0 or word(k - 1) == "::") and word(k) not in ("dyn", "mut", "const"):
                            names[-1] = k
                        k = past_types(k) if word(k) == "<" else k + 1
                    if names[-1] >= 0:
                        define("impl", names[-1])
                        if len(names) > 1:
                            s.refs.append(("implements", word(names[0]), toks[names[0]][2]))
                        named.update(names)
                elif w == "use" and before in ("", "}", ";", "pub", ")", "{"):
                    k = i + 1
                    while k < n and word(k) != ";":
                        if kind_of(k) == "id" and word(k + 1) in (";", ",", "}", "as") and word(k - 1) != "as" and word(k) not in ("self", "_"):
                            s.refs.append(("imports", word(k), toks[k][2]))
                        k += 1
                    i = k
                    continue
            elif language == "go":
                if w == "func" and not s.open:
                    method = behind == "("
                    define("method" if method else "function", after(i + 1, "(", ")") if method else i + 1)
                elif w == "type" and not s.open:
                    group = behind == "("
                    k, end = i + 1 + group, after(i + 1, "(", ")") if group else i + 2
                    depth = 0
                    while k < end:  # each name of a group at its own level
                        if not depth and kind_of(k) == "id" and (k == i + 1 or "\n" in text[toks[k - 1][3] : toks[k][2]]):
                            j = past_brackets(toks, k + 1)
                            what = toks[j][1] if j < n else ""
                            if group:
                                last = after(j + 1, "{", "}") if what in ("struct", "interface") else j + 1
                                s.defined.append([{"struct": "struct", "interface": "interface"}.get(what, "class"), word(k), toks[k][2], toks[last - 1][3]])
                                named.add(k)
                            else:
                                define({"struct": "struct", "interface": "interface"}.get(what, "class"), k)
                                if what not in ("struct", "interface"):
                                    s.finish(line_end(text, b))
                        depth += (word(k) in "({[") - (word(k) in ")}]") if kind_of(k) == "op" else 0
                        k += 1
                elif w == "import" and not s.open:
                    k = i + 1
                    end = after(k, "(", ")") if behind == "(" else k + 1 + (kind_of(k) in ("id", "op"))
                    for j in range(k, min(end, n)):
                        if kind_of(j) == "lit":
                            s.refs.append(("imports", word(j).strip('"`').rsplit("/", 1)[-1], toks[j][2]))
                    i = end
                    fresh = True
                    continue
                elif behind == "{" and w[:1].isupper() and before not in ("struct", "interface", "type") and i not in named and s.open:
                    s.refs.append(("references", w, a))
            elif language == "java":
                if w in ("class", "interface", "enum", "record") and before != "." and kind_of(i + 1) == "id" and behind not in keywords:
                    define("class" if w == "record" else w, i + 1)
                elif w == "import" and not s.open:
                    k = i + 1
                    while k < n and word(k) != ";":
                        k += 1
                    last = k - 1
                    if kind_of(last) == "id":
                        s.refs.append(("imports", word(last), toks[last][2]))
                    i = k
                    continue
                elif behind == "(" and s.holder() in HOLDERS and not s.waiting and w not in keywords:
                    own = s.defined[s.open[-1]][1]
                    if (kind_of(i - 1) == "id" and before not in BEFORE_CALLS) or before in (">", "]") or w == own:
                        define("method", i)
            else:
                if w == "function" and (kind_of(i + 1) == "id" or behind == "*"):
                    define("function", i + 1 + (behind == "*"))
                elif w in ("class", "interface", "enum") and before != "." and kind_of(i + 1) == "id" and behind not in ("extends", "implements"):
                    define(w, i + 1)
                elif w == "type" and kind_of(i + 1) == "id" and word(past_types(i + 2)) == "=":
                    define("class", i + 1)
                    lines.add(s.waiting[0])
                elif w in ("from", "import", "require") and (kind_of(i + 1) == "lit" or (behind == "(" and kind_of(i + 2) == "lit")) and before != ".":
                    k = i + 1 + (behind == "(")
                    s.refs.append(("imports", re.sub(r"\.(?:[cm]?[jt]sx?)\Z", "", word(k)[1:-1].rsplit("/", 1)[-1]), toks[k][2]))
                    named.add(i)
                elif behind == "=" and word(i + 2) not in ("=",) and not s.waiting and w not in keywords and arrow(toks, i + 2, after, past_types):
                    define("function", i)
                    lines.add(s.waiting[0])
                elif s.holder() in ("class", "interface") and not s.waiting and w not in ("if", "for", "while", "switch", "return", "new") and word(past_types(i + 1)) == "(" and (newline or before in ("{", "}", ";", "*", "get", "set", "static", "async", "public", "private", "protected", "abstract", "override", "readonly", ")")):
                    define("method", i)
                elif before == ":" and w[:1].isupper() and behind != "(" and (word(i - 2) in (")", "?") or kind_of(i - 2) == "id"):
                    s.refs.append(("references", w, a))
            if w in ("extends", "implements") and language in ("java", "script"):
                k = i + 1
                while k < n and word(k) not in ("{", "implements", ";"):
                    if kind_of(k) == "id" and word(k - 1) in ("extends", "implements", ",") and word(k) not in keywords:
                        last = k
                        while word(last + 1) == "." and kind_of(last + 2) == "id":
                            last += 2
                        s.refs.append(("implements", word(last), toks[last][2]))
                        named.update(range(k, last + 1))
                    k = past_types(k) if word(k) == "<" else k + 1
            elif i not in named and w not in keywords and before != "@":
                call = behind
                if language == "rust" and behind == "::" and word(i + 2) == "<":
                    call = word(past_types(i + 2))
                elif language == "rust" and behind == "!" and word(i + 2) in ("(", "[", "{"):
                    call = "("
                if before == "new" and language in ("java", "script"):
                    last = i
                    while word(last + 1) == "." and kind_of(last + 2) == "id":
                        last += 2
                    s.refs.append(("references", word(last), toks[last][2]))
                    named.update(range(i, last + 1))
                elif call == "(" and not (s.holder() == "enum" and before in ("{", ",", "]") or language == "java" and kind_of(i - 1) == "id" and before not in BEFORE_CALLS):
                    s.refs.append(("calls", w, a))
        elif kind == "op":
            if w in "([{":
                head = s.defined[s.waiting[0]][0] if s.waiting else ""
                shape = before_brace(language, head, word(i - 1))
                s.opened(w == "{" and not shape or w == "(" and head == "macro")
                fresh = w == "{"
            elif w in ")]}":
                s.closed(b)
                fresh = w == "}" or fresh
            elif w == ";":
                if s.waiting and len(s.open) == s.waiting[1]:
                    s.finish(b)
                fresh = True
        i += 1
    s.finish(len(text.rstrip()))
    return [tuple(d) for d in s.defined], s.refs


def before_brace(language: str, head: str, before: str) -> bool:
    """Whether a brace behind this token opens a type or a value rather than the body of the definition of kind ``head``."""
    return language == "script" and before in (":", "|", "&", "<", ",", "=") or language == "go" and head in ("function", "method") and before in ("interface", "struct")


def line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def past_brackets(toks: list[Token], k: int) -> int:
    """Behind the type parameters of a Go type, if it has any."""
    if k + 1 < len(toks) and toks[k][1] == "[" and toks[k + 1][0] == "id":
        while k < len(toks) and toks[k][1] != "]":
            k += 1
        return k + 1
    return k + (k < len(toks) and toks[k][1] == "=")


def arrow(toks: list[Token], k: int, after, past_types) -> bool:
    """Whether a function value stands at token k of a script."""
    word = lambda j: toks[j][1] if j < len(toks) else ""
    k += word(k) == "async"
    if word(k) == "function":
        return True
    k = past_types(k)
    if word(k) != "(":
        return k < len(toks) and toks[k][0] == "id" and word(k + 1) == "=>"
    k = after(k, "(", ")")
    if word(k) == ":":
        while k < len(toks) and word(k) not in ("=>", ";", "\n", "="):
            k += 1
    return word(k) == "=>"


#: Words of Ruby that open a block wherever they stand, and those that do so only at the beginning of a statement.
OPENS, OPENS_FIRST = frozenset("class module def case begin".split()), frozenset("if unless while until for".split())


def ruby(text: str) -> tuple[list[Definition], list[Reference]]:
    """The same for Ruby, whose blocks end with ``end``."""
    toks, keywords = tokens(text, "ruby"), KEYWORDS["ruby"]
    s, n, loop = Scopes(text), len(toks), False
    word = lambda k: toks[k][1] if 0 <= k < n else ""
    kind_of = lambda k: toks[k][0] if 0 <= k < n else ""
    i = 0
    while i < n:
        kind, w, a, b = toks[i]
        before = word(i - 1)
        first = i == 0 or kind_of(i - 1) == "nl" or before in (";", "=", "(", "then", "do", "else", "|", "{", "[", ",", "&&", ">")
        if kind == "nl":
            loop = False
        elif kind == "id" and before not in (".", "::") and not (word(i + 1) == ":" and toks[i + 1][2] == b):
            if w in ("class", "module") and (kind_of(i + 1) == "id"):
                k = i + 1
                while word(k + 1) == "::" and kind_of(k + 2) == "id":
                    k += 2
                s.begin(w, word(k), a)
                s.opened(True)
                if word(k + 1) == "<" and kind_of(k + 2) == "id":
                    j = k + 2
                    while word(j + 1) == "::" and kind_of(j + 2) == "id":
                        j += 2
                    s.refs.append(("implements", word(j), toks[j][2]))
                    k = j
                i = k
            elif w == "def":
                k = i + 1
                while word(k + 1) == "." and kind_of(k + 2) in ("id", "op"):
                    k += 2
                name = word(k) + ("=" if word(k + 1) == "=" and word(k + 2) == "(" and toks[k + 1][2] == toks[k][3] else "")
                s.begin("function", name, a)
                j = k + 1 + name.endswith("=")
                depth = 0
                while j < n and (depth or kind_of(j) != "nl"):
                    depth += (word(j) == "(") - (word(j) == ")")
                    j += 1
                    if not depth:
                        break
                short = word(k + 1) == "=" and toks[k + 1][2] > toks[k][3]
                if short or word(k + 1) == "(" and word(j) == "=" and word(j + 1) != "=":
                    s.finish(line_end(text, b))  # a definition of one line
                else:
                    s.opened(True)
                i = k
            elif w == "end":
                s.closed(b)
            elif w in OPENS or (w in OPENS_FIRST and first):
                s.opened(False)
                loop = w in ("while", "until", "for")
            elif w == "do":
                if not loop:
                    s.opened(False)
                loop = False
            elif w in ("require", "require_relative") and kind_of(i + 1 + (word(i + 1) == "(")) == "lit":
                k = i + 1 + (word(i + 1) == "(")
                s.refs.append(("imports", word(k).strip("'\"").rsplit("/", 1)[-1], toks[k][2]))
                i = k
            elif w in ("include", "extend", "prepend") and word(i + 1)[:1].isupper():
                s.refs.append(("implements", word(i + 1), toks[i + 1][2]))
                i += 1
            elif word(i + 1) == "(" and toks[i + 1][2] == b and w not in keywords:
                s.refs.append(("calls", w, a))
            elif w[:1].isupper() and word(i + 1) == "." and word(i + 2) == "new":
                s.refs.append(("references", w, a))
        elif kind == "id" and w not in keywords and before == "." and w != "new":
            s.refs.append(("calls", w, a))
        i += 1
    s.finish(len(text.rstrip()))
    return [tuple(d) for d in s.defined], s.refs


def python(text: str) -> tuple[list[Definition], list[tuple[str, str, int]]]:
    tree = ast.parse(text)
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    raw = text.split("\n")
    place = lambda line, column: starts[line - 1] + len(raw[line - 1].encode()[:column].decode("utf-8", "ignore"))
    defined, refs = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            line = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            start = place(line, 0) + len(raw[line - 1]) - len(raw[line - 1].lstrip())
            defined.append(("class" if isinstance(node, ast.ClassDef) else "function", node.name, start, place(node.end_lineno, node.end_col_offset)))
            for base in getattr(node, "bases", []):
                name = base.id if isinstance(base, ast.Name) else base.attr if isinstance(base, ast.Attribute) else None
                if name:
                    refs.append(("implements", name, place(base.lineno, base.col_offset)))
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                refs.append(("calls", name, place(node.lineno, node.col_offset)))
        elif isinstance(node, ast.Import | ast.ImportFrom):
            refs += [("imports", a.name.rsplit(".", 1)[-1], place(node.lineno, node.col_offset)) for a in node.names if a.name != "*"]
    return defined, refs


def bytes_at(text: str) -> np.ndarray:
    """The byte of each character's beginning, and of the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))


def owners(spans: list[tuple[int, int, int]], places: list[int], outside: int) -> list[int]:
    """The innermost span (start, end, number) around each place; both in order. Spans are nested or apart."""
    out, stack, k = [], [], 0
    for place in places:
        while k < len(spans) and spans[k][0] <= place:
            stack.append(spans[k])
            k += 1
        while stack and stack[-1][1] <= place:
            stack.pop()
        out.append(stack[-1][2] if stack else outside)
    return out


def parse(text: str, path: str) -> Parsed:
    """Definitions as chunks, nested ones under their holders; what stands before the first as the module's chunk."""
    stem, extension = os.path.splitext(os.path.basename(path))
    language = LANGUAGES.get(extension.lower())
    if not text.strip():
        return Parsed()
    try:
        defined, refs = python(text) if language == "python" else ruby(text) if language == "ruby" else braced(text, language) if language else ([], [])
    except (SyntaxError, ValueError):
        defined, refs = [], []
    at = bytes_at(text).tolist()
    if not defined:
        return Parsed([Chunk(0, "", text, 0, at[-1], "module", stem)], [Link(0, k, n) for k, n, _ in refs])
    defined.sort(key=lambda d: (d[2], -d[3]))
    chunks: list[Chunk] = []
    head = text[: defined[0][2]]
    if head.strip() and at[defined[0][2]] > LEAST_HEADER:
        chunks.append(Chunk(0, "", head, 0, at[defined[0][2]], "module", stem))
    stack: list[tuple[int, str, int, str]] = []
    spans: list[tuple[int, int, int]] = []
    for kind, name, start, end in defined:
        while stack and start >= stack[-1][2]:
            stack.pop()
        holder = stack[-1] if stack else None
        if holder and kind == "function" and holder[3] in ("class", "impl", "trait", "struct", "interface"):
            kind = "method"
        idx = len(chunks)
        heading = SEPARATORS.get(language, ".").join(s[1] for s in stack)
        chunks.append(Chunk(idx, heading, text[start:end], at[start], at[end], kind, name, holder[0] if holder else None))
        spans.append((start, end, idx))
        stack.append((idx, name, end, kind))
    refs.sort(key=lambda r: r[2])
    held = owners(spans, [place for _, _, place in refs], chunks[0].idx)
    return Parsed(chunks, [Link(own, kind, name) for own, (kind, name, _) in zip(held, refs, strict=True)])
