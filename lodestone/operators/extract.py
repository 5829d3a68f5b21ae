"""Symbols and references of source files.

Two tiers: ``regex_symbols`` is made of built-in functions alone and reads lines; ``symbols``,
``references`` and ``problems`` run a tokenizer of TypeScript and JavaScript over each file and yield
symbols with spans, signatures and comments, references of all kinds, and what is read in part only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that begin a declaration, and the word that may stand before each.
DECLARING = {"function": "async", "class": "abstract", "interface": "", "type": "", "enum": "const"}
BINDING = ("const", "let", "var")


def regex_symbols(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, name, kind, line_start, is_exported, is_async) of the declarations that begin a line.

    A line is read as its leading words and what follows them: perhaps ``export``, perhaps a modifier, a
    declaring word and the name. Arrow functions of exported constants are functions, if their
    parameters are in parentheses or one letter; other exported constants are constants and other
    exported variables are variables. A declaration over several lines is not found.
    """
    lines = files.select(key, F.posexplode(F.split(content, "\n", -1)).alias("at", "line"))
    leading = F.regexp_extract("line", r"^[\w\s]*", 0)
    read = lines.select(key, "at", F.split(F.trim(F.regexp_replace(leading, r"\s+", " ")), " ").alias("words"), F.col("line").substr(F.length(leading) + 1, F.length("line")).alias("rest"))
    exported = F.get("words", F.lit(0)) == "export"
    read = read.withColumns({"is_exported": exported, "words": F.when(exported, F.slice("words", 2, F.size("words"))).otherwise(F.col("words"))})
    word = lambda k: F.get("words", F.lit(k))
    # (kind, name, modified) of whichever form fits
    none = F.lit(None).cast("struct<kind:string,name:string,modified:boolean>")
    form = lambda kind, name, modified: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), name.alias("name"), F.lit(modified).alias("modified"))
    found = none
    for declared, modifier in DECLARING.items():
        more = F.col("rest").startswith("=") & F.get("words", F.lit(2)).isNull() if declared == "type" else F.lit(True)
        found = F.when((word(0) == declared) & word(1).isNotNull() & more, form(declared, word(1), False)).otherwise(found)
        if modifier:
            found = F.when((word(0) == modifier) & (word(1) == declared) & word(2).isNotNull(), form(declared, word(2), True)).otherwise(found)
    value = F.regexp_replace(F.col("rest").substr(F.lit(2), F.length("rest")), r"^\s+", "")
    quick = value.rlike(r"^async\s")
    value = F.when(quick, F.regexp_replace(value, r"^async\s+", "")).otherwise(value)
    closing = F.when(value.startswith("("), F.instr(value, ")")).when(~value.startswith("="), F.lit(1)).otherwise(F.lit(0))
    arrow = (word(0) == "const") & F.col("rest").startswith("=") & word(2).isNull() & (closing > 0) & F.regexp_replace(value.substr(closing + 1, F.length(value)), r"^\s+", "").startswith("=>")
    bound = F.when(word(0) == "const", "constant").otherwise("variable")
    binding = F.col("is_exported") & word(0).isin(*BINDING) & word(1).isNotNull()
    found = F.coalesce(found, F.when(binding & arrow, F.struct(F.lit("function").alias("kind"), word(1).alias("name"), quick.alias("modified"))).when(binding, form(bound, word(1), False)))
    return read.withColumn("form", found).where("form is not null").select(
        key, "form.name", "form.kind", (F.col("at") + 1).cast("int").alias("line_start"), "is_exported", ((F.col("form.kind") == "function") & F.col("form.modified")).alias("is_async")
    )


_TOKEN = re.compile(
    r"(?P<space>[ \t\r\n\f\v]+)|(?P<line>//[^\n]*)|(?P<block>/\*[\s\S]*?(?:\*/|\Z))"
    r"|(?P<name>[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*)|(?P<number>\d[\w.]*)"
    r"|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<tick>`)"
    r"|(?P<mark>=>|\.\.\.|\?\.|[{}()\[\];,.:?=<>|&!+\-*/%^~@])|(?P<other>.)"
)
_KEYWORDS = frozenset("if for while switch catch return typeof instanceof in of new delete void throw else do case await yield import export default function class super this".split())
_NO_TYPE = frozenset("; const let var return if for while switch throw export class".split())
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; + - * % ~ ^ < > => return typeof case in of".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int
    inner: list[Token] = field(default_factory=list)


def tokenize(source: str) -> tuple[list[Token], list[tuple[int, int, str]]]:
    """Tokens, and block comments as (first line, last line, text). Never fails: what it doesn't know is a token of its own."""
    out: list[Token] = []
    comments: list[tuple[int, int, str]] = []
    line, start, at = 1, 0, 0

    def newlines(text: str, begin: int) -> None:
        nonlocal line, start
        if (n := text.count("\n")):
            line += n
            start = begin + text.rfind("\n") + 1

    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, text, here, column = m.lastgroup, m.group(), line, at - start
        if kind == "block":
            newlines(text, at)
            comments.append((here, line, text))
        elif kind == "tick":
            end, depth = at + 1, 0
            parts, hole = [], 0
            while end < len(source) and not (source[end] == "`" and not depth):
                if source[end] == "\\":
                    end += 1
                elif source.startswith("${", end) and not depth:
                    parts.append(source[hole or at + 1 : end])
                    depth, end = 1, end + 1
                elif depth and source[end] == "{":
                    depth += 1
                elif depth and source[end] == "}":
                    depth -= 1
                    hole = end + 1
                end += 1
            parts.append(source[hole or at + 1 : end])
            text = source[at : end + 1]
            out.append(Token("template", "*".join(parts), here, column))
            newlines(text, at)
            at = min(len(source), end + 1)
            continue
        elif kind == "mark" and text == "/" and (not out or out[-1].text in _BEFORE_REGEX):
            if (r := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(source, at)):
                text = r.group()
                out.append(Token("regex", text, here, column))
            else:
                out.append(Token("mark", text, here, column))
        elif kind in ("space", "line"):
            newlines(text, at)
        else:
            out.append(Token(kind, text, here, column))
        at += len(text)
    return out, comments


_OPEN, _CLOSE = {"{": "}", "(": ")", "[": "]"}, {"}": "{", ")": "(", "]": "["}


def matching(tokens: list[Token]) -> dict[int, int]:
    """From each opening bracket to its closing one; unclosed ones go to the end."""
    pairs, stack, waiting = {}, [], dict.fromkeys(_OPEN, 0)

    def close(i: int) -> str:
        j = stack.pop()
        pairs[j] = i
        waiting[tokens[j].text] -= 1
        return tokens[j].text

    for i, t in enumerate(tokens):
        if t.kind != "mark":
            continue
        if t.text in _OPEN:
            stack.append(i)
            waiting[t.text] += 1
        elif t.text in _CLOSE and waiting[_CLOSE[t.text]]:
            while close(i) != _CLOSE[t.text]:
                pass
    pairs.update(dict.fromkeys(stack, len(tokens) - 1))
    return pairs


def angles(tokens: list[Token], pairs: dict[int, int]) -> dict[int, int]:
    """From each ``<`` to its ``>``, where there is nothing between them that can't be in types, in one pass."""
    found, levels = {}, [[]]
    for i, t in enumerate(tokens):
        if t.text in _OPEN and i in pairs:
            levels.append([])
        elif t.text in _CLOSE:
            if len(levels) > 1:
                levels.pop()
            else:
                levels[-1].clear()
        elif t.text in _NO_TYPE or t.text in _OPEN:
            levels[-1].clear()
        elif t.text == "<":
            levels[-1].append(i)
        elif t.text == ">" and levels[-1]:
            found[levels[-1].pop()] = i
    return found


def _comment(comments: list[tuple[int, int, str]], line: int) -> str | None:
    """The nearest block comment that ends at most five lines above."""
    near = [c for c in comments if 0 < line - c[1] <= 5]
    if not near:
        return None
    lines = near[-1][2].removeprefix("/*").removesuffix("*/").lstrip("*").split("\n")
    return "\n".join(x.strip().removeprefix("*").strip() for x in lines).strip()


class File:
    """Symbols and references of one source."""

    def __init__(self, source: str) -> None:
        self.tokens, self.comments = tokenize(source)
        self.pairs = matching(self.tokens)
        self.types = angles(self.tokens, self.pairs)
        self.opened = {j: i for i, j in self.pairs.items() if self.tokens[j].text == _OPEN[self.tokens[i].text]}

    def text(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def kind(self, i: int) -> str:
        return self.tokens[i].kind if 0 <= i < len(self.tokens) else ""

    def after_types(self, i: int) -> int:
        """Past ``<...>``; ``i`` itself where what is no type comes before the end."""
        return self.types.get(i, i - 1) + 1

    def start_of(self, i: int) -> int:
        """Where the expression begins of which the name at ``i`` is the last member: ``a`` of ``a.b(c)[0].name``."""
        called = False
        while self.text(i - 1) in (".", "?."):
            i -= 2
            i -= self.text(i) == "!"
            while i in self.opened and self.text(i) in (")", "]"):
                i, called = self.opened[i], True
                if self.kind(i - 1) == "name" and self.text(i - 1) not in _KEYWORDS - {"super", "this", "import"} or self.text(i - 1) in (")", "]"):
                    i -= 1
                else:
                    break
        return i - 1 if called and self.text(i - 1) == "new" else i

    def end_of_statement(self, i: int) -> int:
        first = self.tokens[i].line if i < len(self.tokens) else 0
        while i < len(self.tokens):
            if self.text(i) in self.pairs or i in self.pairs:
                i = self.pairs[i]
            elif self.text(i) == ";" or self.text(i) in ("}", ")", "]"):
                return i if self.text(i) == ";" else i - 1
            nxt = i + 1
            if nxt < len(self.tokens) and self.tokens[nxt].line > self.tokens[i].line and self.tokens[i].line >= first and self.text(i) not in ("=", ",", "|", "&", "=>", ":", "?", "+", "(", ".", "<") and self.text(nxt) not in (".", "|", "&", "?", ":", "=", "=>", "+", "-", "*", ")", "]", "}", "?.", "<", "extends", "&&", "||", "as"):
                return i
            i += 1
        return len(self.tokens) - 1

    def signature(self, i: int) -> tuple[str | None, int]:
        """``(a, b, ...rest) => T`` of the parameters that begin at ``i``, and what comes after."""
        i = self.after_types(i)
        if self.text(i) != "(" or i not in self.pairs:
            return None, i
        end, names, k = self.pairs[i], [], i + 1
        while k < end:
            rest = ""
            stop = k
            while stop < end and self.text(stop) != ",":
                stop = self.pairs[stop] + 1 if stop in self.pairs else self.after_types(stop) if self.text(stop) == "<" and self.after_types(stop) > stop else stop + 1
            part = [x for x in range(k, stop) if not (self.kind(x) == "name" and self.text(x) in ("public", "private", "protected", "readonly") and self.kind(x + 1) == "name")]
            if part and self.text(part[0]) == "...":
                rest, part = "...", part[1:]
            default = any(self.text(x) == "=" for x in part)
            if part and self.kind(part[0]) == "name" and not default:
                names.append(rest + self.text(part[0]))
            k = stop + 1
        after, result = end + 1, ""
        if self.text(after) == ":":
            k, depth = after + 1, 0
            while k < len(self.tokens):
                t = self.text(k)
                if not depth and (t in ("{", ";", "=>", "=") and k > after + 1 or t == "}"):
                    break
                if k in self.pairs and t in ("{", "(", "["):
                    result += "object" if t == "{" else "".join(self.text(x) for x in range(k, self.pairs[k] + 1))
                    k = self.pairs[k] + 1
                    continue
                depth += (t == "<") - (t == ">")
                result += f" {t} " if t in ("|", "&") else t
                k += 1
            after = k
        return f"({', '.join(names)})" + (f" => {result}" if result else ""), after

    def symbols(self) -> Iterator[dict]:
        i, n = 0, len(self.tokens)
        while i < n:
            begin, exported, flags = i, False, set()
            while self.kind(i) == "name" and self.text(i) in ("export", "default", "declare", "abstract", "async"):
                exported |= self.text(i) == "export"
                flags.add(self.text(i))
                i += 1
            word, name = self.text(i), self.text(i + 1)
            if word == "const" and name == "enum":
                i += 1
                word, name = "enum", self.text(i + 1)
            if word == "function":
                k = i + 1 + (self.text(i + 1) == "*")
                if self.kind(k) == "name":
                    sign, k2 = self.signature(k + 1)
                    end = self.pairs.get(k2, k2) if self.text(k2) == "{" else k2
                    yield self.symbol(self.text(k), "function", begin, min(end, n - 1), exported, sign, "async" in flags)
                    i = end + 1
                    continue
            elif word in ("class", "interface", "enum") and self.kind(i + 1) == "name":
                k = i + 2
                while k < n and self.text(k) != "{":
                    k += 1
                end = self.pairs.get(k, n - 1)
                yield self.symbol(name, word, begin, end, exported)
                if word == "class":
                    yield from self.members(k + 1, end, exported)
                i = end + 1
                continue
            elif word == "type" and self.kind(i + 1) == "name" and self.text(self.after_types(i + 2)) == "=":
                end = self.end_of_statement(i)
                yield self.symbol(name, "type", begin, end, exported)
                i = end + 1
                continue
            elif word in ("const", "let", "var") and self.kind(i + 1) == "name":
                end = self.end_of_statement(i)
                if exported:
                    yield from self.variables(i, begin, end, word)
                i = end + 1
                continue
            i = self.pairs[i] + 1 if i in self.pairs else max(i, begin) + 1

    def variables(self, i: int, begin: int, end: int, word: str) -> Iterator[dict]:
        k = i + 1
        while k <= end and self.kind(k) == "name":
            name, v = self.text(k), k + 1
            while v <= end and self.text(v) not in ("=", ","):
                v = self.pairs[v] + 1 if v in self.pairs else v + 1
            function = sign = None
            quick = False
            if self.text(v) == "=":
                s = v + 1
                if self.text(s) == "async":
                    quick, s = True, s + 1
                if self.text(s) == "function":
                    function = True
                    sign, _ = self.signature(s + 1 + (self.kind(s + 1) == "name"))
                else:
                    sign, arrow = self.signature(s)
                    function = self.text(arrow) == "=>" or self.kind(s) == "name" and self.text(s + 1) == "=>"
                    if self.kind(s) == "name" and self.text(s + 1) == "=>":
                        sign = f"({self.text(s)})"
            kind = "function" if function else "constant" if word == "const" else "variable"
            yield self.symbol(name, kind, begin, end, True, sign if function else None, bool(quick and function))
            while v <= end and self.text(v) != ",":
                v = self.pairs[v] + 1 if v in self.pairs else v + 1
            k = v + 1

    def members(self, i: int, end: int, exported: bool) -> Iterator[dict]:
        while i < end:
            begin, flags = i, set()
            while self.text(i) == "@":
                i += 2
                i = self.pairs[i] + 1 if self.text(i) == "(" and i in self.pairs else i
            while self.kind(i) == "name" and self.text(i) in ("public", "private", "protected", "static", "readonly", "async", "abstract", "override", "get", "set", "declare") and self.text(i + 1) not in ("(", "=", ":", ";", "?"):
                flags.add(self.text(i))
                i += 1
            i += self.text(i) == "*"
            if self.kind(i) in ("name", "string"):
                name, k = self.text(i).strip("'\"#"), i + 1
                k += self.text(k) in ("?", "!")
                access = next((a for a in ("private", "protected", "public") if a in flags), "private" if self.text(i).startswith("#") else None)
                if self.text(k) in ("(", "<"):
                    sign, after = self.signature(k)
                    stop = self.pairs.get(after, after) if self.text(after) == "{" else after
                    yield self.symbol(name, "method", begin, min(stop, end - 1), exported, sign, "async" in flags, access)
                    i = stop + 1
                    continue
                stop = self.end_of_statement(i)
                yield self.symbol(name, "property", begin, min(stop, end - 1), exported, None, False, access)
                i = max(stop, i) + 1
                continue
            i = self.pairs[i] + 1 if i in self.pairs else max(i, begin) + 1

    def symbol(self, name: str, kind: str, begin: int, end: int, exported: bool, signature: str | None = None, quick: bool = False, access: str | None = None) -> dict:
        a, b = self.tokens[begin], self.tokens[max(begin, min(end, len(self.tokens) - 1))]
        return {"name": name, "kind": kind, "line_start": a.line, "line_end": b.line, "column_start": a.column, "column_end": b.column + len(b.text), "signature": signature, "documentation": _comment(self.comments, a.line), "is_exported": exported, "is_async": quick, "access_modifier": access}

    def references(self) -> Iterator[dict]:
        i, n = 0, len(self.tokens)
        while i < n:
            t = self.tokens[i]
            if t.kind == "name" and t.text == "import" and self.text(i - 1) != ".":
                if self.text(i + 1) == "(":
                    target = self.tokens[i + 2] if i + 2 < n else None
                    name = target.text.strip("'\"") if target and target.kind == "string" else target.text if target and target.kind == "template" else "<dynamic>"
                    yield self.reference(name, "dynamic_import", t, importSource=name)
                    i += 2
                    continue
                i = yield from self.imports(i)
                continue
            if t.kind == "name" and t.text == "export" and self.text(i + 1) in ("*", "{") or t.text == "export" and self.text(i + 1) == "type" and self.text(i + 2) in ("*", "{"):
                k = i + 1 + (self.text(i + 1) == "type")
                if self.text(k) == "*":
                    alias = self.text(k + 2) if self.text(k + 1) == "as" else None
                    src = k + (4 if alias else 2)
                    if self.kind(src) == "string":
                        source = self.text(src).strip("'\"")
                        yield self.reference(alias or "*", "export_all", t, importSource=source, **({"exportedName": alias} if alias else {}))
                        i = src + 1
                        continue
                elif k in self.pairs and self.text(self.pairs[k] + 1) == "from":
                    source = self.text(self.pairs[k] + 2).strip("'\"")
                    for name, alias, token in self.specifiers(k):
                        yield self.reference(name, "re_export", token, importSource=source, **({"exportedName": alias} if alias else {}))
                    i = self.pairs[k] + 3
                    continue
            if t.kind == "name" and t.text not in _KEYWORDS and self.text(i - 1) not in ("function", "class", "interface", "enum", "type"):
                member = self.text(i - 1) in (".", "?.")
                nxt = self.after_types(i + 1) if self.text(i + 1) == "<" else i + 1
                first = self.start_of(i)
                begin = self.tokens[first]
                called = self.text(nxt) == "(" and self.text(self.pairs.get(nxt, nxt) + 1) not in ("{", ":", "=>") or self.text(nxt) == "(" and member
                if called and self.text(first - 1) != "new":
                    yield self.reference(t.text, "call", begin, **({"isMethodCall": "true"} if member else {}))
                if member:
                    yield self.reference(t.text, "property_access", begin)
                elif self.text(i - 1) in ("extends", "implements") or self.text(i - 1) in (":", "as", "<", "|", "&") and t.text[:1].isupper() and not called:
                    k = i
                    while self.text(k + 1) == "." and self.kind(k + 2) == "name":
                        k += 2
                    yield self.reference(self.text(k), "type_reference", t)
                    i = k
            i += 1

    def specifiers(self, k: int) -> list[tuple[str, str | None, Token]]:
        out, j = [], k + 1
        while j < self.pairs[k]:
            if self.text(j) == "type" and self.kind(j + 1) == "name" and self.text(j + 1) != "as":
                j += 1
            if self.kind(j) in ("name", "string"):
                alias = self.text(j + 2) if self.text(j + 1) == "as" else None
                out.append((self.text(j), alias, self.tokens[j]))
                j += 2 if alias else 0
            j += 1
        return out

    def imports(self, i: int):
        """One row for each name that an import statement binds; the position after it."""
        first, k, rows = self.tokens[i], i + 1, []
        k += self.text(k) == "type" and self.text(k + 1) != "from"
        while k < len(self.tokens) and self.kind(k) != "string" and self.text(k) not in (";", "="):
            if self.text(k) == "{" and k in self.pairs:
                rows += [(alias or name, {"importedName": name, **({"importAlias": alias} if alias else {})}, token) for name, alias, token in self.specifiers(k)]
                k = self.pairs[k]
            elif self.text(k) == "*" and self.text(k + 1) == "as":
                rows.append((self.text(k + 2), {"importedName": "*", "isNamespaceImport": "true"}, self.tokens[k + 2]))
                k += 2
            elif self.kind(k) == "name" and self.text(k) != "from":
                rows.append((self.text(k), {"importedName": "default", "isDefaultImport": "true"}, self.tokens[k]))
            k += 1
        if self.kind(k) == "string":
            source = self.text(k).strip("'\"")
            for name, metadata, token in rows:
                yield self.reference(name, "import", token, importSource=source, **metadata)
            if not rows:
                yield self.reference(source, "import", first, importSource=source, isSideEffectImport="true")
        return k + 1

    def reference(self, name: str, kind: str, token: Token, **metadata: str) -> dict:
        return {"target_name": name, "reference_type": kind, "line_number": token.line, "column_number": token.column, "metadata": metadata}


    def problems(self) -> Iterator[dict]:
        """What a strict parser would stop at: brackets without a partner and strings without an end."""
        closed = {j for i, j in self.pairs.items() if _OPEN[self.text(i)] == self.text(j)}
        for i, t in enumerate(self.tokens):
            if t.kind == "mark" and t.text in _OPEN and (self.text(self.pairs.get(i, i)) != _OPEN[t.text]):
                yield {"line": t.line, "column": t.column, "message": f"'{t.text}' is not closed"}
            elif t.kind == "mark" and t.text in _CLOSE and i not in closed:
                yield {"line": t.line, "column": t.column, "message": f"'{t.text}' closes nothing"}
            elif t.kind == "string" and (len(t.text) < 2 or t.text[-1] != t.text[0]):
                yield {"line": t.line, "column": t.column, "message": "unterminated string"}


PROBLEMS = "path string, line int, column int, message string"
SYMBOLS = "path string, name string, kind string, line_start int, line_end int, column_start int, column_end int, signature string, documentation string, is_exported boolean, is_async boolean, access_modifier string"
REFERENCES = "path string, target_name string, reference_type string, line_number int, column_number int, metadata map<string,string>"
# The extensions that are parsed.
PARSED = r"\.(ts|tsx|js|jsx|cjs|mjs)$"


#: What one parse of a file yields, by the name of its rows.
YIELDS = {"symbols": SYMBOLS, "references": REFERENCES, "problems": PROBLEMS}


def _own(schema: str) -> str:
    return schema.removeprefix("path string, ")


def _arrow(schema: str) -> pa.StructType:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.struct([(name, kinds[kind]) for name, kind in (c.split(" ") for c in _own(schema).split(", "))])


def parsed(files: DataFrame, what: tuple[str, ...] = tuple(YIELDS)) -> DataFrame:
    """(path, kind, and a struct for each of ``what``) of (path, content): one parse for all rows of a file.

    ``kind`` names the struct that a row has; the others are null. ``rows_of`` takes them apart; stage the
    result if it is read for more than one kind.
    """
    types = {w: _arrow(YIELDS[w]) for w in what}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, kinds, values = [], [], {w: [] for w in what}
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = File(content or "")
                for w in what:
                    for row in getattr(file, w)():
                        paths.append(path)
                        kinds.append(w)
                        for other in what:
                            values[other].append({**row, "metadata": list(row["metadata"].items())} if other == w == "references" else row if other == w else None)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string()), *(pa.array(values[w], types[w]) for w in what)], ["path", "kind", *what])

    structs = ", ".join(f"{w} struct<{_own(YIELDS[w]).replace(' ', ':').replace(',:', ',')}>" for w in what)
    return files.where(F.col("path").rlike(PARSED)).select("path", "content").mapInArrow(run, f"path string, kind string, {structs}")


def rows_of(parsed: DataFrame, what: str) -> DataFrame:
    """The rows of one kind, with the columns of its schema."""
    return parsed.where(F.col("kind") == what).select("path", f"{what}.*")


def symbols(files: DataFrame) -> DataFrame:
    """Top-level symbols and class members of (path, content)."""
    return rows_of(parsed(files, ("symbols",)), "symbols")


def references(files: DataFrame) -> DataFrame:
    """Imports, exports from elsewhere, calls, property accesses and type references of (path, content)."""
    return rows_of(parsed(files, ("references",)), "references")


def problems(files: DataFrame) -> DataFrame:
    """(path, line, column, message) of files that are read in part only."""
    return rows_of(parsed(files, ("problems",)), "problems")
