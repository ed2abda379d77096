"""A tolerant parser of JavaScript modules to flat trees, for use inside an Arrow function.

It reads what the analyses need: declarations, statements, modules, classes, functions, calls, members, templates.  It
never fails: what it cannot read becomes an error with its place, and it goes on after the next token.  Every loop moves
on or stops, and the number of nodes is bounded by that of the tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

KEYWORDS = frozenset("await async break case catch class const continue debugger default delete do else export extends false finally for from function get if import in instanceof let new null of return set static super switch this throw true try typeof undefined var void while with yield".split())
_SPACE = re.compile(r"(?:\s+|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))+")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*\.?(?:[eE][+-]?[0-9]+)?n?")
_MARKS = sorted("{ } ( ) [ ] ; , ? : ~ . ... ?. => + - * / % ** ++ -- = += -= *= /= %= **= == === != !== < > <= >= << >> >>> <<= >>= >>>= & | ^ ! && || ?? &= |= ^= &&= ||= ??= @ #".split(), key=len, reverse=True)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}
_BINARY = {op: i + 1 for i, ops in enumerate(("??", "||", "&&", "|", "^", "&", "== != === !==", "< > <= >= instanceof in", "<< >> >>>", "+ -", "* / %", "**")) for op in ops.split()}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


@dataclass(slots=True)
class Token:
    kind: str  # name, keyword, number, string, template, mark, illegal, end
    text: str
    line: int
    col: int
    parts: list | None = None  # of a template: texts and token lists in turn
    raw_end: int = 0


class Tokenizer:
    def __init__(self, text: str, at: int = 0, end: int | None = None) -> None:
        self.text, self.at, self.end = text, at, len(text) if end is None else end
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def place(self, at: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.starts, at)
        return line, at - self.starts[line - 1] + 1

    def all(self, closing: str = "") -> list[Token]:
        """Tokens up to the end, or up to a closing brace of this depth; the first illegal one ends them."""
        out: list[Token] = []
        depth = 0
        while True:
            t = self.next()
            if closing and t.text == "}" and t.kind == "mark" and not depth:
                return out
            depth += (t.text == "{") - (t.text == "}") if t.kind == "mark" else 0
            out.append(t)
            if t.kind in ("end", "illegal"):
                return out

    def next(self) -> Token:
        m = _SPACE.match(self.text, self.at, self.end)
        if m:
            self.at = m.end()
        line, col = self.place(self.at)
        if self.at >= self.end:
            return Token("end", "", line, col)
        c = self.text[self.at]
        if c in "'\"":
            return self.string(c, line, col)
        if c == "`":
            return self.template(line, col)
        m = _NAME.match(self.text, self.at)
        if m:
            self.at = m.end()
            return Token("keyword" if m[0] in KEYWORDS else "name", m[0], line, col)
        m = _NUMBER.match(self.text, self.at)
        if m:
            self.at = m.end()
            t = m[0].replace("_", "")
            return Token("number", str(int(t, 0)) if t[:2].lower() in ("0x", "0b", "0o") else t, line, col)
        for mark in _MARKS:
            if self.text.startswith(mark, self.at):
                self.at += len(mark)
                return Token("mark", mark, line, col)
        self.at += 1
        return Token("illegal", c, line, col)

    def string(self, quote: str, line: int, col: int) -> Token:
        out, i = [], self.at + 1
        while i < self.end and self.text[i] not in (quote, "\n"):
            if self.text[i] == "\\" and i + 1 < self.end:
                e = self.text[i + 1]
                m = re.compile(r"x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})").match(self.text, i + 1)
                out.append(chr(int(m[1] or m[2], 16)) if m else _ESCAPES.get(e, e))
                i = m.end() if m else i + 2
            else:
                out.append(self.text[i])
                i += 1
        closed = i < self.end and self.text[i] == quote
        self.at = i + closed
        return Token("string" if closed else "illegal", "".join(out), line, col)

    def template(self, line: int, col: int) -> Token:
        parts: list = [""]
        self.at += 1
        while self.at < self.end:
            c = self.text[self.at]
            if c == "`":
                self.at += 1
                return Token("template", parts[0], line, col, parts)
            if c == "\\" and self.at + 1 < self.end:
                parts[-1] += _ESCAPES.get(self.text[self.at + 1], self.text[self.at + 1])
                self.at += 2
            elif self.text.startswith("${", self.at):
                self.at += 2
                inner = self.all("}")
                parts += [inner, ""]
                if inner and inner[-1].kind in ("end", "illegal"):
                    break
            else:
                parts[-1] += c
                self.at += 1
        return Token("illegal", "`", line, col)


def tokenize(text: str) -> list[Token]:
    return Tokenizer(text).all()


@dataclass(slots=True)
class Node:
    kind: str
    name: str = ""
    value: str = ""
    line: int = 0
    col: int = 0
    children: list = field(default_factory=list)

    def add(self, *nodes: Node | None) -> Node:
        self.children += [n for n in nodes if n is not None]
        return self


class Parser:
    #: Depth of nested expressions and statements; beyond it a part is skipped with an error.
    DEPTH = 150

    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.i, self.depth = [t for t in tokens if t.kind != "end"], 0, 0
        last = tokens[-1] if tokens else Token("end", "", 1, 1)
        self.end = Token("end", "", last.line, last.col)
        self.errors: list[str] = []

    @property
    def t(self) -> Token:
        return self.tokens[self.i] if self.i < len(self.tokens) else self.end

    def peek(self, n: int = 1) -> Token:
        return self.tokens[self.i + n] if self.i + n < len(self.tokens) else self.end

    def step(self) -> Token:
        t = self.t
        self.i += 1
        return t

    def is_(self, *texts: str) -> bool:
        return self.t.kind in ("mark", "keyword") and self.t.text in texts

    def eat(self, text: str) -> bool:
        if self.is_(text):
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            self.error(f"expected {text}")

    def error(self, what: str) -> None:
        if len(self.errors) < 100:
            self.errors.append(f"{self.t.line}:{self.t.col}: {what}, found {self.t.text or self.t.kind}")

    def node(self, kind: str, name: str = "", value: str = "") -> Node:
        return Node(kind, name, value, self.t.line, self.t.col)

    def word(self) -> str:
        return self.step().text if self.t.kind in ("name", "keyword", "string", "number") else ""

    def program(self) -> Node:
        out = self.node("Program")
        while self.t.kind != "end":
            out.add(self.guarded(self.statement))
        return out

    def guarded(self, what) -> Node | None:
        """Runs a rule; if it took no token, one is skipped."""
        at = self.i
        if self.depth >= self.DEPTH:
            self.error("nested too deeply")
            self.i += 1
            return None
        self.depth += 1
        out = what()
        self.depth -= 1
        if self.i == at:
            if self.t.kind != "end":
                self.error("unexpected")
            self.i += 1
        return out

    def block(self) -> Node:
        out = self.node("BlockStatement")
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            out.add(self.guarded(self.statement))
        self.need("}")
        return out

    def statement(self) -> Node | None:
        t = self.t
        if t.kind == "keyword":
            if t.text == "async" and self.peek().text == "function":
                self.step()
                return self.function("FunctionDeclaration")
            if t.text == "import" and self.peek().text not in ("(", "."):
                return self.import_()
            rule = getattr(self, "on_" + t.text, None)
            if rule:
                return rule()
        if self.is_("{"):
            return self.block()
        if self.eat(";"):
            return None
        if self.is_("@"):
            self.step()
            self.guarded(self.postfix)
            return None
        out = self.node("ExpressionStatement").add(self.guarded(self.expression))
        self.eat(";")
        return out

    def on_function(self) -> Node:
        return self.function("FunctionDeclaration")

    def on_class(self) -> Node:
        return self.class_("ClassDeclaration")

    def on_var(self) -> Node:
        out = self.node("VariableDeclaration", value=self.t.text)
        self.step()
        while True:
            d = self.node("VariableDeclarator")
            d.name = self.target(d)
            if self.eat("="):
                d.add(self.guarded(self.assignment))
            out.add(d)
            if not self.eat(","):
                break
        self.eat(";")
        return out

    on_let = on_const = on_var

    def target(self, into: Node) -> str:
        """A name; of a pattern the braces are skipped and its names added as patterns."""
        if self.is_("{", "["):
            for name in self.skipped():
                into.add(Node("PatternName", name, "", self.t.line, self.t.col))
            return ""
        return self.word()

    def skipped(self) -> list[str]:
        """Over balanced brackets; the names inside."""
        depth, names = 0, []
        while self.t.kind != "end":
            t = self.step()
            if t.kind == "mark":
                depth += (t.text in ("{", "[", "(")) - (t.text in ("}", "]", ")"))
            elif t.kind == "name" and self.t.text != ":":
                names.append(t.text)
            if depth <= 0:
                break
        return names

    def simple(self, kind: str, value: bool) -> Node:
        out = self.node(kind)
        self.step()
        if value and not self.is_(";", "}") and self.t.kind != "end":
            out.add(self.guarded(self.expression))
        elif self.t.kind == "name" and not value:
            out.name = self.word()
        self.eat(";")
        return out

    def on_return(self) -> Node:
        return self.simple("ReturnStatement", True)

    def on_throw(self) -> Node:
        return self.simple("ThrowStatement", True)

    def on_break(self) -> Node:
        return self.simple("BreakStatement", False)

    def on_continue(self) -> Node:
        return self.simple("ContinueStatement", False)

    def bracketed(self) -> Node | None:
        self.need("(")
        out = self.guarded(self.expression)
        self.need(")")
        return out

    def on_if(self) -> Node:
        out = self.node("IfStatement")
        self.step()
        out.add(self.bracketed(), self.guarded(self.statement))
        if self.eat("else"):
            out.add(self.guarded(self.statement))
        return out

    def on_while(self) -> Node:
        out = self.node("WhileStatement")
        self.step()
        return out.add(self.bracketed(), self.guarded(self.statement))

    def on_do(self) -> Node:
        out = self.node("DoWhileStatement")
        self.step()
        out.add(self.guarded(self.statement))
        if self.eat("while"):
            out.add(self.bracketed())
        self.eat(";")
        return out

    def on_for(self) -> Node:
        out = self.node("ForStatement")
        self.step()
        self.eat("await")
        self.need("(")
        if self.is_("var", "let", "const"):
            at = self.node("VariableDeclaration", value=self.step().text)
            d = self.node("VariableDeclarator")
            d.name = self.target(d)
            at.add(d)
            if self.eat("="):
                d.add(self.guarded(self.assignment))
            while self.eat(","):
                at.add(self.guarded(self.assignment))
            out.add(at)
        elif not self.is_(";"):
            out.add(self.guarded(self.expression))
        if self.is_("of", "in"):
            out.kind = "ForOfStatement" if self.step().text == "of" else "ForInStatement"
            out.add(self.guarded(self.expression))
        else:
            for _ in range(2):
                self.eat(";")
                if not self.is_(";", ")"):
                    out.add(self.guarded(self.expression))
        self.need(")")
        return out.add(self.guarded(self.statement))

    def on_try(self) -> Node:
        out = self.node("TryStatement")
        self.step()
        out.add(self.block())
        if self.eat("catch"):
            c = self.node("CatchClause")
            if self.eat("("):
                c.name = self.target(c)
                self.need(")")
            out.add(c.add(self.block()))
        if self.eat("finally"):
            out.add(self.block())
        return out

    def on_switch(self) -> Node:
        out = self.node("SwitchStatement")
        self.step()
        out.add(self.bracketed())
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            c = self.node("SwitchCase")
            if self.eat("case"):
                c.add(self.guarded(self.expression))
            elif not self.eat("default"):
                self.error("expected case")
                self.step()
                continue
            self.need(":")
            while not self.is_("case", "default", "}") and self.t.kind != "end":
                c.add(self.guarded(self.statement))
            out.add(c)
        self.need("}")
        return out

    def import_(self) -> Node:
        out = self.node("ImportDeclaration")
        self.step()
        if self.t.kind != "string":
            if self.t.kind in ("name", "keyword") and not self.is_("from"):
                n = self.node("ImportDefaultSpecifier", value="default")
                n.name = self.word()
                out.add(n)
                self.eat(",")
            if self.eat("*"):
                self.eat_word("as")
                n = self.node("ImportNamespaceSpecifier", value="*")
                n.name = self.word()
                out.add(n)
            if self.is_("{"):
                out.add(*self.specifiers("ImportSpecifier"))
            self.eat_word("from")
        out.value = self.word() if self.t.kind == "string" else ""
        self.eat(";")
        return out

    def eat_word(self, text: str) -> bool:
        if self.t.kind in ("name", "keyword") and self.t.text == text:
            self.i += 1
            return True
        return False

    def specifiers(self, kind: str) -> list[Node]:
        """``{a, b as c}``: value is the name before ``as``, name the one after it."""
        out = []
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            n, at = self.node(kind), self.i
            n.value = n.name = self.word()
            if self.eat_word("as"):
                n.name = self.word()
            out.append(n)
            self.eat(",")
            if self.i == at:
                self.step()
        self.need("}")
        return out

    def on_export(self) -> Node:
        out = self.node("ExportNamedDeclaration")
        self.step()
        if self.eat("*"):
            out.kind = "ExportAllDeclaration"
            out.name = self.word() if self.eat_word("as") else ""
            self.eat_word("from")
            out.value = self.word()
        elif self.eat("default"):
            out.kind = "ExportDefaultDeclaration"
            named = self.is_("function", "class") or (self.is_("async") and self.peek().text == "function")
            out.add(self.guarded(self.statement if named else self.assignment))
        elif self.is_("{"):
            out.add(*self.specifiers("ExportSpecifier"))
            if self.eat_word("from"):
                out.value = self.word()
        else:
            return out.add(self.guarded(self.statement))
        self.eat(";")
        return out

    def function(self, kind: str) -> Node:
        out = self.node(kind)
        self.need("function")
        self.eat("*")
        if self.t.kind in ("name", "keyword") and not self.is_("("):
            out.name = self.word()
        return out.add(*self.params()).add(self.block())

    def params(self) -> list[Node]:
        out = []
        self.need("(")
        while not self.is_(")") and self.t.kind != "end":
            n, at = self.node("Parameter"), self.i
            self.eat("...")
            n.name = self.target(n)
            if self.eat("="):
                n.add(self.guarded(self.assignment))
            out.append(n)
            self.eat(",")
            if self.i == at:
                self.step()
        self.need(")")
        return out

    def class_(self, kind: str) -> Node:
        out = self.node(kind)
        self.step()
        if self.t.kind == "name":
            out.name = self.word()
        if self.eat("extends"):
            out.value = self.t.text
            out.add(self.guarded(self.postfix))
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            m, at = self.node("MethodDefinition", value="method"), self.i
            while self.is_("static", "async", "get", "set") and self.peek().text not in ("(", "="):
                m.value = self.step().text
            self.eat("*")
            self.eat("#")
            if self.is_("["):
                self.skipped()
            else:
                m.name = self.word()
            if self.is_("("):
                out.add(m.add(*self.params()).add(self.block() if self.is_("{") else None))
            elif self.eat("="):
                m.kind = "PropertyDefinition"
                out.add(m.add(self.guarded(self.assignment)))
            self.eat(";")
            if self.i == at:
                self.step()
        self.need("}")
        return out

    def expression(self) -> Node | None:
        first = self.guarded(self.assignment)
        if not self.is_(","):
            return first
        out = self.node("SequenceExpression").add(first)
        while self.eat(","):
            out.add(self.guarded(self.assignment))
        return out

    def arrow_ahead(self) -> bool:
        i = 1 if self.is_("async") else 0
        t = self.peek(i) if i else self.t
        if t.kind in ("name", "keyword") and self.peek(i + 1).text == "=>":
            return True
        if t.text != "(" or t.kind != "mark":
            return False
        depth = 0
        for k in range(self.i + i, len(self.tokens)):
            x = self.tokens[k]
            if x.kind == "mark":
                depth += (x.text in ("(", "[", "{")) - (x.text in (")", "]", "}"))
                if not depth:
                    return k + 1 < len(self.tokens) and self.tokens[k + 1].text == "=>"
        return False

    def assignment(self) -> Node | None:
        if (self.is_("(", "async") or self.t.kind == "name") and self.arrow_ahead():
            out = self.node("ArrowFunctionExpression")
            self.eat("async")
            if self.is_("("):
                out.add(*self.params())
            else:
                n = self.node("Parameter")
                n.name = self.word()
                out.add(n)
            self.need("=>")
            return out.add(self.block() if self.is_("{") else self.guarded(self.assignment))
        if self.is_("yield"):
            out = self.node("YieldExpression")
            self.step()
            self.eat("*")
            return out if self.is_(")", "]", "}", ",", ";") or self.t.kind == "end" else out.add(self.guarded(self.assignment))
        left = self.binary(0)
        if self.eat("?"):
            out = Node("ConditionalExpression", "", "", self.t.line, self.t.col).add(left, self.guarded(self.assignment))
            self.need(":")
            return out.add(self.guarded(self.assignment))
        if self.t.kind == "mark" and self.t.text in _ASSIGN:
            out = self.node("AssignmentExpression", value=self.t.text)
            self.step()
            return out.add(left, self.guarded(self.assignment))
        return left

    def binary(self, least: int) -> Node | None:
        left = self.unary()
        while self.t.kind in ("mark", "keyword") and (rank := _BINARY.get(self.t.text, 0)) > least:
            out = self.node("BinaryExpression", value=self.t.text)
            right_first = self.step().text == "**"
            left = out.add(left, self.guarded(lambda r=rank - right_first: self.binary(r)))
        return left

    def unary(self) -> Node | None:
        if self.is_("!", "~", "+", "-", "++", "--", "typeof", "void", "delete", "await", "..."):
            out = self.node("UnaryExpression", value=self.t.text)
            self.step()
            return out.add(self.guarded(self.unary))
        out = self.postfix()
        if self.is_("++", "--"):
            out = self.node("UpdateExpression", value=self.step().text).add(out)
        return out

    def arguments(self) -> list[Node]:
        out = []
        self.need("(")
        while not self.is_(")") and self.t.kind != "end":
            n = self.guarded(self.assignment)
            out += [n] if n else []
            self.eat(",")
        self.need(")")
        return out

    def postfix(self) -> Node | None:
        out = self.primary()
        while out is not None:
            if self.is_("(") or (self.is_("?.") and self.peek().text == "("):
                call = Node("CallExpression", out.name, "", out.line, out.col)
                self.eat("?.")
                out = call.add(out, *self.arguments())
                call.children[0].value = call.children[0].value or "callee"
            elif self.is_(".", "?."):
                self.step()
                self.eat("#")
                if self.is_("["):
                    continue
                m = Node("MemberExpression", "", "", out.line, out.col).add(out)
                m.name = self.word()
                out = m
            elif self.is_("["):
                m = Node("MemberExpression", "", "computed", out.line, out.col).add(out)
                self.step()
                m.add(self.guarded(self.expression))
                self.need("]")
                out = m
            elif self.t.kind == "template":
                tag = f"{out.children[0].name}.{out.name}" if out.kind == "MemberExpression" and out.children and out.children[0].name else out.name
                out = Node("TaggedTemplateExpression", tag, "", out.line, out.col).add(out, self.template())
            else:
                return out
        return out

    def template(self) -> Node:
        out, parts = self.node("TemplateLiteral"), self.t.parts or [""]
        t = self.step()
        for k, p in enumerate(parts):
            if k % 2 == 0:
                out.add(Node("TemplateElement", "", p, t.line, t.col))
            else:
                inner = Parser([*p, self.end])
                inner.depth = self.depth + 1
                out.add(inner.guarded(inner.expression))
                self.errors += inner.errors
        return out

    def primary(self) -> Node | None:
        t = self.t
        if t.kind in ("number", "string"):
            n = self.node("Literal", value=t.text)
            n.name = t.kind
            self.step()
            n.name = ""
            return n
        if t.kind == "template":
            return self.template()
        if t.kind == "name":
            n = self.node("Identifier", t.text)
            self.step()
            return n
        if t.kind == "keyword":
            if t.text == "function" or (t.text == "async" and self.peek().text == "function"):
                self.eat("async")
                return self.function("FunctionExpression")
            if t.text == "class":
                return self.class_("ClassExpression")
            if t.text == "new":
                n = self.node("NewExpression")
                self.step()
                made = self.guarded(self.postfix)
                n.name = made.name if made else ""
                return n.add(made)
            if t.text == "import" and self.peek().text == "(":
                n = self.node("ImportExpression")
                self.step()
                return n.add(*self.arguments())
            if t.text in ("true", "false", "null", "undefined"):
                n = self.node("Literal", value=t.text)
                self.step()
                return n
            if t.text in ("this", "super", "import", "async", "get", "set", "of", "from", "static", "let", "await"):
                n = self.node("ThisExpression" if t.text == "this" else "Identifier", t.text)
                self.step()
                return n
            return None
        if self.is_("("):
            self.step()
            n = self.guarded(self.expression)
            self.need(")")
            return n
        if self.is_("["):
            n = self.node("ArrayExpression")
            self.step()
            while not self.is_("]") and self.t.kind != "end":
                if not self.eat(","):
                    n.add(self.guarded(self.assignment))
            self.need("]")
            return n
        if self.is_("{"):
            return self.object()
        return None

    def object(self) -> Node:
        out = self.node("ObjectExpression")
        self.need("{")
        while not self.is_("}") and self.t.kind != "end":
            p, at = self.node("Property"), self.i
            if self.eat("..."):
                p.kind = "SpreadElement"
                out.add(p.add(self.guarded(self.assignment)))
                self.eat(",")
                continue
            while self.is_("async", "get", "set") and self.peek().text not in (",", ":", "(", "}"):
                self.step()
            self.eat("*")
            if self.is_("["):
                self.skipped()
            else:
                p.name = self.word()
            if self.eat(":"):
                p.add(self.guarded(self.assignment))
            elif self.is_("("):
                p.add(*self.params()).add(self.block())
            elif self.eat("="):
                p.add(self.guarded(self.assignment))
            else:
                p.add(Node("Identifier", p.name, "", p.line, p.col))
            out.add(p)
            self.eat(",")
            if self.i == at:
                self.step()
        self.need("}")
        return out


def parse(text: str) -> tuple[list[tuple], list[str]]:
    """(rows, errors): the nodes in the order of the text as (node_id, parent_id, kind, name, value, line, col, path)."""
    tokens = tokenize(text)
    p = Parser(tokens)
    root = p.program()
    if tokens and tokens[-1].kind == "illegal":
        p.errors.append(f"{tokens[-1].line}:{tokens[-1].col}: illegal {tokens[-1].text[:20]}")
    rows: list[tuple] = []
    stack: list[tuple[Node, int | None, list[int]]] = [(root, None, [])]
    while stack:
        n, parent, path = stack.pop()
        i = len(rows)
        rows.append((i, parent, n.kind, n.name, n.value, n.line, n.col, path))
        stack += [(c, i, [*path, i]) for c in reversed(n.children)]
    return rows, p.errors
