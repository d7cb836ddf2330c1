"""Graphs of code in brace languages: syntax, statement order, control flow, data flow, program dependence.

One builder serves all layers. It reads tokens, finds methods with their innermost class, and parses
statements; a text without a method is one method named ``<top>``. Fragments with unbalanced braces are
read as far as they go. Builders for other languages give the same rows.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<name>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>->|::|\+\+|--|&&|\|\||[-+*/%&|^!=<>]=|.)""",
    re.S,
)
# fixed values: words of the language that are no variables
KEYWORDS = set(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import "
    "instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while "
    "true false null var record".split()
)
LAYERS = ("ast", "seq", "cfg", "dfg", "pdg")
ENTRY, EXIT = 0, 1


@dataclass
class Statement:
    kind: str
    tokens: list[tuple[str, str, int]]
    line: int
    body: list[Statement] = field(default_factory=list)
    other: list[Statement] = field(default_factory=list)
    parts: list[tuple[str, list[Statement]]] = field(default_factory=list)
    id: int = -1


@dataclass
class Method:
    cls: str
    name: str
    params: list[tuple[str, str, int]]
    line: int
    body: list[Statement]


def tokenise(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of the tokens that are no space or comment."""
    out, line = [], 1
    for m in TOKEN.finditer(text):
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), line))
        line += m.group().count("\n")
    return out


class Reader:
    """Statements from tokens; every step moves on, so reading takes time in proportion to the text."""

    def __init__(self, tokens: list[tuple[str, str, int]]):
        self.t = tokens
        self.close = self._pairs()

    def _pairs(self) -> dict[int, int]:
        """Place of the closing bracket of every opening one; the end of the text where it is missing."""
        out, stack = {}, []
        for i, (kind, s, _) in enumerate(self.t):
            if kind == "op" and s in "([{":
                stack.append((s, i))
            elif kind == "op" and s in ")]}":
                want = {")": "(", "]": "[", "}": "{"}[s]
                if stack and stack[-1][0] == want:
                    out[stack.pop()[1]] = i
        for _, i in stack:
            out[i] = len(self.t)
        return out

    def at(self, i: int) -> str:
        return self.t[i][1] if i < len(self.t) else ""

    def line(self, i: int) -> int:
        return self.t[min(i, len(self.t) - 1)][2] if self.t else 1

    def parens(self, i: int) -> tuple[list, int]:
        """Tokens within the parentheses at i and the place after them."""
        if self.at(i) != "(":
            return [], i
        j = self.close[i]
        return self.t[i + 1 : j], min(j + 1, len(self.t))

    def upto_end(self, i: int, end: int) -> int:
        """The place after the semicolon that ends a simple statement at i."""
        while i < end:
            s = self.at(i)
            if s == ";":
                return i + 1
            if s == "}":
                return max(i, 0)
            i = self.close[i] + 1 if i in self.close else i + 1
        return end

    def block(self, i: int, end: int, depth: int) -> tuple[list[Statement], int]:
        """The block or single statement at i."""
        if self.at(i) == "{":
            j = min(self.close[i], end)
            return self.many(i + 1, j, depth + 1), min(j + 1, end)
        s, j = self.one(i, end, depth + 1)
        return ([s] if s else []), j

    def many(self, i: int, end: int, depth: int) -> list[Statement]:
        out = []
        while i < end:
            s, j = self.one(i, end, depth)
            if s:
                out.append(s)
            i = max(j, i + 1)
        return out

    def one(self, i: int, end: int, depth: int) -> tuple[Statement | None, int]:
        if i >= end:
            return None, end
        w, line = self.at(i), self.line(i)
        if w in (";", "}", ")"):
            return None, i + 1
        if w == "{":
            body, j = self.block(i, end, depth)
            return Statement("block", [], line, body), j
        if w in ("if", "while", "for", "synchronized") and self.at(i + 1) == "(":
            head, j = self.parens(i + 1)
            body, j = self.block(j, end, depth)
            s = Statement(w, head, line, body)
            if w == "if" and j < end and self.at(j) == "else":
                s.other, j = self.block(j + 1, end, depth)
            return s, j
        if w == "do":
            body, j = self.block(i + 1, end, depth)
            head = []
            if self.at(j) == "while":
                head, j = self.parens(j + 1)
                j = self.upto_end(j, end)
            return Statement("do", head, line, body), j
        if w == "switch" and self.at(i + 1) == "(":
            head, j = self.parens(i + 1)
            s = Statement("switch", head, line)
            if self.at(j) == "{":
                stop = min(self.close[j], end)
                s.parts = self.cases(j + 1, stop, depth + 1)
                j = min(stop + 1, end)
            return s, j
        if w == "try":
            head, j = self.parens(i + 1)
            body, j = self.block(j, end, depth)
            s = Statement("try", head, line, body)
            while j < end and self.at(j) == "catch":
                caught, k = self.parens(j + 1)
                handler, j = self.block(k, end, depth)
                s.parts.append(("catch", [Statement("catch", caught, self.line(k - 1), handler)]))
            if j < end and self.at(j) == "finally":
                s.other, j = self.block(j + 1, end, depth)
            return s, j
        if self.t[i][0] == "name" and w not in KEYWORDS and self.at(i + 1) == ":" and self.at(i + 2) != ":":
            return self.one(i + 2, end, depth + 1)
        j = self.upto_end(i, end)
        body = [t for t in self.t[i:j] if t[1] != ";"]
        kind = w if w in ("return", "throw", "break", "continue") else "expression"
        return (Statement(kind, body[1:] if kind != "expression" else body, line) if body else None), max(j, i + 1)

    def cases(self, i: int, end: int, depth: int) -> list[tuple[str, list[Statement]]]:
        out: list[tuple[str, list[Statement]]] = []
        while i < end:
            if self.at(i) in ("case", "default"):
                j = i + 1
                while j < end and self.at(j) not in (":", "->"):
                    j = self.close[j] + 1 if j in self.close else j + 1
                label = "default" if self.at(i) == "default" else " ".join(t[1] for t in self.t[i + 1 : j])
                arrow = self.at(j) == "->"
                i, part = j + 1, []
                while i < end and self.at(i) not in ("case", "default"):
                    s, k = self.one(i, end, depth)
                    i = max(k, i + 1)
                    if s:
                        part.append(s)
                    if arrow and s:
                        part.append(Statement("break", [], s.line))
                        break
                out.append((label, part))
            else:
                i += 1
        return out


def methods(text: str) -> list[Method]:
    """Methods of a text with their innermost class; ``<top>`` if there is none."""
    r = Reader(tokenise(text))
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * len(r.t) + 1000))  # nesting is as deep as the text has it
    out: list[Method] = []
    work = [(0, len(r.t), "")]
    while work:
        i, end, cls = work.pop()
        pending = ""
        while i < end:
            w = r.at(i)
            if w in ("class", "interface", "enum", "record") and i + 1 < end and r.t[i + 1][0] == "name":
                pending = r.at(i + 1)
                i += 2
                if w == "record" and r.at(i) == "(":
                    i = r.parens(i)[1]
            elif w == "{":
                stop = min(r.close[i], end)
                work.append((i + 1, stop, pending or cls))
                pending = ""
                i = stop + 1
            elif w == "=" and not pending:
                i = r.upto_end(i, end)
            elif w == "(" and i and r.t[i - 1][0] == "name" and r.at(i - 1) not in KEYWORDS and r.at(i - 2) not in ("new", ".", "@") and not pending:
                params, j = r.parens(i)
                if r.at(j) == "throws":
                    while j < end and r.at(j) not in ("{", ";"):
                        j += 1
                if r.at(j) == "{" and j < end:
                    body, k = r.block(j, end, 0)
                    out.append(Method(cls, r.at(i - 1), params, r.line(i - 1), body))
                    i = k
                else:
                    i = max(j, i + 1)
            elif w == "(":
                i = r.parens(i)[1]
            else:
                i += 1
    if not out and r.t:
        out.append(Method("", "<top>", [], 1, r.many(0, len(r.t), 0)))
    return sorted(out, key=lambda m: (m.line, m.name))


def variables(tokens: list[tuple[str, str, int]]) -> tuple[set[str], set[str]]:
    """Variables a piece of code defines and uses."""
    defs, uses = set(), set()
    for i, (kind, w, _) in enumerate(tokens):
        if kind != "name" or w in KEYWORDS:
            continue
        after = tokens[i + 1] if i + 1 < len(tokens) else ("", "", 0)
        before = tokens[i - 1] if i else ("", "", 0)
        if after[1] in ("(", "::") or before[1] in (".", "::", "new", "@") or (after[0] == "name" and after[1] != "instanceof"):
            continue  # a call, a member, a type
        declared = before[0] == "name" and before[1] not in (KEYWORDS - {"int", "long", "double", "float", "boolean", "char", "byte", "short", "var"}) or before[1] in (">", "]")
        if after[1] == "=" or (declared and after[1] in ("", ":", ",", ")", ";")):
            defs.add(w)
        elif after[1] in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "++", "--") or before[1] in ("++", "--"):
            defs.add(w)
            uses.add(w)
        else:
            uses.add(w)
    return defs, uses


def calls(tokens: list[tuple[str, str, int]]) -> list[str]:
    return [w for i, (k, w, _) in enumerate(tokens) if k == "name" and w not in KEYWORDS and i + 1 < len(tokens) and tokens[i + 1][1] == "(" and (not i or tokens[i - 1][1] != "new")]


class Graphs:
    """Nodes and edges of one method; node 0 is the entry, node 1 the exit."""

    def __init__(self, m: Method):
        self.m = m
        self.nodes: list[Statement] = [Statement("entry", m.params, m.line, id=0), Statement("exit", [], m.line, id=1)]
        self.depth, self.parent = {0: 0, 1: 0}, {}
        self.number(m.body, 0, 1)
        self.flow_edges: set[tuple[int, int, str]] = set()
        self.reached: set[int] = {0, 1}
        for n, label in self.run(m.body, [(ENTRY, "")], None, None, []):
            self.edge(n, EXIT, label)

    def number(self, body: list[Statement], parent: int, depth: int) -> None:
        for s in body:
            s.id = len(self.nodes)
            self.nodes.append(s)
            self.parent[s.id], self.depth[s.id] = parent, depth
            self.number(s.body, s.id, depth + 1)
            for _, part in s.parts:
                self.number(part, s.id, depth + 1)
            self.number(s.other, s.id, depth + 1)

    def edge(self, a: int, b: int, label: str) -> None:
        self.flow_edges.add((a, b, label))

    def enter(self, s: Statement, ins: list) -> None:
        self.reached.add(s.id)
        for n, label in ins:
            self.edge(n, s.id, label)

    def run(self, body, ins, breaks, head, handlers):
        """Edges of a list of statements; what is left open at its end. Statements nothing leads to are left out."""
        for s in body:
            if not ins:
                break
            ins = self.step(s, ins, breaks, head, handlers)
        return ins

    def step(self, s, ins, breaks, head, handlers):
        self.enter(s, ins)
        here = [(s.id, "")]
        if s.kind == "return":
            self.edge(s.id, EXIT, "return")
            return []
        if s.kind == "throw":
            for h in handlers or [EXIT]:
                self.edge(s.id, h, "throw")
            return []
        if s.kind == "break":
            if breaks is None:
                self.edge(s.id, EXIT, "break")
            else:
                breaks.append((s.id, "break"))
            return []
        if s.kind == "continue":
            self.edge(s.id, EXIT if head is None else head, "continue")
            return []
        if s.kind in ("block", "synchronized", "catch"):
            return self.run(s.body, here, breaks, head, handlers)
        if s.kind == "if":
            out = self.run(s.body, [(s.id, "true")], breaks, head, handlers)
            return out + (self.run(s.other, [(s.id, "false")], breaks, head, handlers) if s.other else [(s.id, "false")])
        if s.kind in ("while", "for"):
            out: list = []
            for n, label in self.run(s.body, [(s.id, "true")], out, s.id, handlers):
                self.edge(n, s.id, label or "back")
            return [(s.id, "false"), *out]
        if s.kind == "do":
            # the node of a do loop is its condition at the end; the way in leads to the body first
            out = []
            if s.body:
                self.flow_edges -= {(n, s.id, label) for n, label in ins}
                for n, label in self.run(s.body, ins, out, s.id, handlers):
                    self.edge(n, s.id, label)
                self.edge(s.id, s.body[0].id, "true")
            return [(s.id, "false"), *out]
        if s.kind == "switch":
            out, fall = [], []
            for label, part in s.parts:
                fall = self.run(part, [(s.id, label), *fall], out, head, handlers)
            return out + fall + ([] if any(label == "default" for label, _ in s.parts) else [(s.id, "no case")])
        if s.kind == "try":
            catchers = [part[0] for _, part in s.parts]
            out = self.run(s.body, here, breaks, head, [c.id for c in catchers] or handlers)
            for c in catchers:
                out = out + self.step(c, [(s.id, "exception")], breaks, head, handlers)
            return self.run(s.other, out or [(s.id, "finally")], breaks, head, handlers) if s.other else out
        return here

    def data_edges(self) -> set[tuple[int, int, str]]:
        """(definition, use, variable) by reaching definitions over the control flow."""
        made, used = {}, {}
        for s in self.nodes:
            d, u = variables(s.tokens)
            if s.id == ENTRY:
                d, u = d | {w for i, (k, w, _) in enumerate(s.tokens) if k == "name" and (i + 1 == len(s.tokens) or s.tokens[i + 1][1] == ",")}, set()
            elif s.kind == "catch" and s.tokens:
                d, u = {s.tokens[-1][1]}, set()
            made[s.id], used[s.id] = d, u
        after = defaultdict(list)
        before = defaultdict(list)
        for a, b, _ in self.flow_edges:
            after[a].append(b)
            before[b].append(a)
        into: dict[int, set] = defaultdict(set)
        todo = [s.id for s in self.nodes]
        out: dict[int, set] = {}
        while todo:
            n = todo.pop()
            into[n] = set().union(*[out.get(p, set()) for p in before[n]])
            new = {(v, d) for v, d in into[n] if v not in made[n]} | {(v, n) for v in made[n]}
            if new != out.get(n):
                out[n] = new
                todo += after[n]
        return {(d, n, v) for n in used for v, d in into[n] if v in used[n]}

    def control_edges(self) -> set[tuple[int, int, str]]:
        """(condition, statement, control): what a statement's run depends on, by the structure."""
        deciding = ("if", "while", "for", "do", "switch", "try", "catch")
        out = set()
        for s in self.nodes[2:]:
            p = self.parent[s.id]
            while p and self.nodes[p].kind not in deciding:
                p = self.parent[p]
            out.add((p, s.id, "control"))
        return out

    def layer(self, kind: str) -> tuple[list[Statement], set[tuple[int, int, str]]]:
        inner = [s for s in self.nodes[2:] if s.kind != "block"]
        if kind == "ast":
            return self.nodes[:1] + self.nodes[2:], {(p, n, "child") for n, p in self.parent.items()}
        if kind == "seq":
            return inner, {(a.id, b.id, "next") for a, b in zip(inner, inner[1:])}
        if kind == "cfg":
            return [s for s in self.nodes if s.id in self.reached], self.flow_edges
        if kind == "dfg":
            e = self.data_edges()
            touched = {x for a, b, _ in e for x in (a, b)}
            return [s for s in self.nodes if s.id in touched], e
        return [s for s in self.nodes if s.id != EXIT], self.control_edges() | self.data_edges()


SCHEMA = "layer string, row string, cls string, method string, line int, id int, dst int, type string, value string, depth int"


def _rows(text: str | None, layers: tuple[str, ...]) -> Iterator[tuple]:
    for m in methods(text or ""):
        g = Graphs(m)
        name = f"{m.name}@{m.line}"
        for kind in layers:
            nodes, edges = g.layer(kind)
            for s in nodes:
                yield kind, "node", m.cls, name, s.line, s.id, None, s.kind, " ".join(t[1] for t in s.tokens), g.depth[s.id]
            for a, b, label in sorted(edges):
                yield kind, "edge", m.cls, name, None, a, b, label, None, None


def build_graphs(files: DataFrame, key: str = "file", text: str = "text", layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Nodes and edges of every method of every text, for each of ``layers``.

    A node row has id, type, value (its code), line and depth; an edge row has id
    (source), dst and type (label). ``method`` is name@line. Null and empty texts have no rows.
    """
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, {SCHEMA}"
    names = [key, *[c.split()[0] for c in SCHEMA.split(", ")]]

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for k, t in zip(part[key], part[text]):
                rows = [(k, *r) for r in _rows(t, layers)]
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("line", "id", "dst", "depth")})

    return files.select(key, text).mapInPandas(build, schema)


def build_calls(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """``key, cls, method, line, name``: one row per call of ``name`` in a method, which begins at ``line``."""
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, cls string, method string, line long, name string"

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, m.cls, m.name, m.line, c) for k, t in zip(part[key], part[text]) for m in methods(t or "") for s in Graphs(m).nodes for c in calls(s.tokens)]
            yield pd.DataFrame(rows, columns=[key, "cls", "method", "line", "name"])

    return files.select(key, text).mapInPandas(build, schema)


def build_methods(files: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """``key, cls, method, line``: one row per method that a text defines; not ``<top>``."""
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, cls string, method string, line long"

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, m.cls, m.name, m.line) for k, t in zip(part[key], part[text]) for m in methods(t or "") if m.name != "<top>"]
            yield pd.DataFrame(rows, columns=[key, "cls", "method", "line"])

    return files.select(key, text).mapInPandas(build, schema)


def method_statistics(graphs: DataFrame, key: str = "file") -> DataFrame:
    """Per method and layer: nodes, edges, kinds, deepest node, leaf share of the tree, cyclomatic number of the flow."""
    node, edge = F.col("row") == "node", F.col("row") == "edge"
    inner = graphs.where(edge & (F.col("layer") == "ast")).select(key, "cls", "method", "layer", "id").distinct().groupBy(key, "cls", "method", "layer").agg(F.count(F.lit(1)).alias("inner_"))
    out = graphs.groupBy(key, "cls", "method", "layer").agg(
        F.count_if(node).alias("n_nodes"), F.count_if(edge).alias("n_edges"), F.count_distinct(F.when(node, F.col("type"))).alias("n_kinds"), F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"),
    )
    out = out.join(inner, [key, "cls", "method", "layer"], "left")
    return out.withColumns({
        "leaf_ratio": F.when(F.col("layer") == "ast", F.try_divide(F.col("n_nodes") - F.coalesce("inner_", F.lit(0)), "n_nodes")),
        "cyclomatic": F.when(F.col("layer") == "cfg", F.col("n_edges") - F.col("n_nodes") + 2),
        "density": F.try_divide(F.col("n_edges"), "n_nodes"),
    }).drop("inner_")
