"""S-expression patterns over the syntax trees of Python files.

Python's own parser gives the tree; its nodes go by the names that tree grammars use for
Python (``function_definition`` with ``name``, ``parameters`` and ``body``, and so on; kinds not
listed below by their class name in snake case). A pattern is ``(kind field: (kind) @capture)``
with ``_`` for any kind, ``[a b]`` for alternatives, and the tests ``(#eq? @a "x")`` and
``(#match? @a "re")``. Child patterns match children in order, others may lie between.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Node:
    kind: str
    start: int
    end: int
    text: str
    children: list[tuple[str | None, Node]] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for _, c in reversed(node.children)]


# Class of Python's parser to the grammar's node kind and the fields of its children, in order.
KINDS = {
    "Module": ("module", {"body": None}), "Expr": ("expression_statement", {"value": None}), "Call": ("call", {"func": "function", "args": "arguments"}),
    "Attribute": ("attribute", {"value": "object", "attr": "attribute"}), "Name": ("identifier", {}), "Assign": ("assignment", {"targets": "left", "value": "right"}),
    "AnnAssign": ("assignment", {"target": "left", "annotation": "type", "value": "right"}), "AugAssign": ("augmented_assignment", {"target": "left", "value": "right"}),
    "ClassDef": ("class_definition", {"name": "name", "bases": "superclasses", "body": "body"}),
    "FunctionDef": ("function_definition", {"name": "name", "args": "parameters", "returns": "return_type", "body": "body"}),
    "AsyncFunctionDef": ("function_definition", {"name": "name", "args": "parameters", "returns": "return_type", "body": "body"}),
    "Import": ("import_statement", {"names": "name"}), "ImportFrom": ("import_from_statement", {"module": "module_name", "names": "name"}), "alias": ("dotted_name", {}),
    "Return": ("return_statement", {"value": None}), "If": ("if_statement", {"test": "condition", "body": "consequence", "orelse": "alternative"}),
    "For": ("for_statement", {"target": "left", "iter": "right", "body": "body"}), "While": ("while_statement", {"test": "condition", "body": "body"}),
    "With": ("with_statement", {"items": None, "body": "body"}), "Try": ("try_statement", {"body": "body", "handlers": None, "finalbody": None}), "Raise": ("raise_statement", {"exc": None}),
    "Assert": ("assert_statement", {"test": None}), "Pass": ("pass_statement", {}), "Break": ("break_statement", {}), "Continue": ("continue_statement", {}),
    "BinOp": ("binary_operator", {"left": "left", "right": "right"}), "Compare": ("comparison_operator", {"left": None, "comparators": None}), "BoolOp": ("boolean_operator", {"values": None}),
    "UnaryOp": ("unary_operator", {"operand": "argument"}), "Lambda": ("lambda", {"args": "parameters", "body": "body"}), "Await": ("await", {"value": None}), "Subscript": ("subscript", {"value": "value", "slice": "subscript"}),
    "List": ("list", {"elts": None}), "Tuple": ("tuple", {"elts": None}), "Set": ("set", {"elts": None}), "Dict": ("dictionary", {"keys": None, "values": None}), "arg": ("identifier", {}),
    "ListComp": ("list_comprehension", {"elt": "body", "generators": None}), "keyword": ("keyword_argument", {"value": "value"}),
}
#: Fields of several nodes that stand under a node of their own.
WRAPPED = {("Call", "args"): "argument_list", ("ClassDef", "bases"): "argument_list", ("FunctionDef", "args"): "parameters", ("AsyncFunctionDef", "args"): "parameters", ("Lambda", "args"): "lambda_parameters"}
CONSTANTS = {str: "string", bytes: "string", bool: None, int: "integer", float: "float", type(None): "none"}


def tree(source: str) -> Node:
    """The syntax tree of a Python source; raises SyntaxError where it does not parse."""
    lines = source.splitlines(keepends=True)

    def text_of(x: ast.AST) -> str:
        return ast.get_source_segment(source, x) or ""

    def of(x: ast.AST) -> Node:
        if isinstance(x, ast.Constant):
            kind, fields = (str(x.value).lower() if isinstance(x.value, bool) else CONSTANTS.get(type(x.value), "constant")), {}
        else:
            kind, fields = KINDS.get(type(x).__name__, (re.sub(r"(?<!^)(?=[A-Z])", "_", type(x).__name__).lower(), dict.fromkeys(x._fields)))
        if isinstance(x, ast.Module):
            node = Node(kind, 1, max(1, len(lines)), source)
        else:
            start = getattr(x, "lineno", 0)
            node = Node(kind, start, getattr(x, "end_lineno", start) or start, "")
            node.text = x.name if isinstance(x, ast.alias) else x.arg if isinstance(x, ast.arg) else text_of(x)
        for name, label in fields.items():
            value = getattr(x, name, None)
            made: list[Node] = []
            for v in value if isinstance(value, list) else [value]:
                if isinstance(v, str):
                    made.append(Node("dotted_name" if name == "module" else "identifier", node.start, node.start, v))
                elif isinstance(v, ast.arguments):
                    made += [of(a) for a in (*v.posonlyargs, *v.args, *([v.vararg] if v.vararg else []), *v.kwonlyargs, *([v.kwarg] if v.kwarg else []))]
                elif isinstance(v, ast.AST) and not isinstance(v, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)):
                    made.append(of(v))
            wrapper = WRAPPED.get((type(x).__name__, name)) or ("block" if name in ("body", "orelse", "finalbody") and isinstance(value, list) and kind != "module" else None)
            if name == "args" and isinstance(x, ast.Call):
                made += [of(k) for k in x.keywords]
            if wrapper and (made or name != "bases") and not (name in ("orelse", "finalbody") and not made):
                first, last = (made[0].start, made[-1].end) if made else (node.start, node.start)
                made = [Node(wrapper, first, last, "".join(lines[first - 1 : last]) if wrapper == "block" else ", ".join(m.text for m in made), [(None, m) for m in made])]
            node.children += [(label, m) for m in made]
        if getattr(x, "decorator_list", None):
            marks = [of(d) for d in x.decorator_list]
            outer = Node("decorated_definition", marks[0].start, node.end, "".join(lines[marks[0].start - 1 : node.end]))
            outer.children = [*((None, Node("decorator", m.start, m.end, "@" + m.text, [(None, m)])) for m in marks), ("definition", node)]
            return outer
        return node

    return of(ast.parse(source))


@dataclass
class Pattern:
    kinds: frozenset[str]
    children: list[tuple[str | None, Pattern]] = field(default_factory=list)
    captures: list[str] = field(default_factory=list)
    #: Tests on captures: (capture, other text or regex, whether it is a regex, whether it must hold).
    tests: list[tuple[str, str, bool, bool]] = field(default_factory=list)
    alternatives: list[Pattern] = field(default_factory=list)


def compiled(text: str) -> list[Pattern]:
    """The patterns of a query text; raises ValueError where it is none."""
    tokens = re.findall(r'"(?:\\.|[^"\\])*"|#[\w-]+\?|@[\w.-]+|[\w.]+:|[()\[\]]|[\w.]+|\S', re.sub(r";[^\n]*", "", text))
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take(wanted: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens) or (wanted and tokens[at] != wanted):
            raise ValueError(f"expected {wanted or 'more'} at token {at} of {text!r}")
        at += 1
        return tokens[at - 1]

    def pattern() -> Pattern:
        if peek() == "[":
            take()
            options = []
            while peek() != "]":
                options.append(pattern())
            take("]")
            made = Pattern(frozenset(), alternatives=options)
        elif tokens[at : at + 2] == ["(", "("]:  # a pattern with tests around it
            take("(")
            made = pattern()
            while peek() != ")":
                made.tests.append(test())
            take(")")
        else:
            take("(")
            kind = take()
            if not re.fullmatch(r"\w+", kind):
                raise ValueError(f"{kind!r} is no node kind")
            made = Pattern(frozenset() if kind == "_" else frozenset([kind]))
            while peek() != ")":
                if peek() == "(" and tokens[at + 1 : at + 2] and tokens[at + 1].startswith("#"):
                    made.tests.append(test())
                    continue
                label = take()[:-1] if peek().endswith(":") else None
                made.children.append((label, pattern()))
            take(")")
        while peek().startswith("@"):
            made.captures.append(take()[1:])
        return made

    def test() -> tuple[str, str, bool, bool]:
        take("(")
        name, capture, value = take(), take(), take()
        take(")")
        if name not in ("#eq?", "#not-eq?", "#match?", "#not-match?") or not capture.startswith("@") or not value.startswith('"'):
            raise ValueError(f"unsupported test {name}")
        return capture[1:], re.sub(r"\\(.)", r"\1", value[1:-1]) if "eq" in name else value[1:-1].replace("\\\\", "\\"), "match" in name, "not" not in name

    out = []
    while at < len(tokens):
        if peek() == "(" and tokens[at + 1 : at + 2] and tokens[at + 1].startswith("#") and out:
            out[-1].tests.append(test())
        else:
            out.append(pattern())
    if not out:
        raise ValueError("an empty pattern")
    return out


def _matches(p: Pattern, node: Node) -> Iterator[list[tuple[str, Node]]]:
    own = [(c, node) for c in p.captures]
    if p.alternatives:
        for option in p.alternatives:
            for found in _matches(option, node):
                yield own + found
        return
    if p.kinds and node.kind not in p.kinds:
        return

    def children(i: int, first: int) -> Iterator[list[tuple[str, Node]]]:
        if i == len(p.children):
            yield []
            return
        label, child = p.children[i]
        for k in range(first, len(node.children)):
            name, candidate = node.children[k]
            if label is None or name == label:
                for found in _matches(child, candidate):
                    for rest in children(i + 1, k + 1):
                        yield found + rest

    for found in children(0, 0):
        whole = own + found
        if all(any(c == capture for c, _ in whole) and all(bool(re.search(value, n.text) if regex else n.text == value) is holds for c, n in whole if c == capture) for capture, value, regex, holds in p.tests):
            yield whole


def captures(patterns: list[Pattern], source: str) -> Iterator[tuple[str, Node]]:
    """(capture, node) of every match, in order of the tree; matches without captures give nothing."""
    for node in tree(source).walk():
        for p in patterns:
            for found in _matches(p, node):
                yield from found
