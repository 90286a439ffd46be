"""Def-use edges of Python sources, and the model input built from them.

The index space is that of the tokenizer: every token except layout and comments, in source order.  Statements are
read in the order in which values flow: the right side of an assignment before its target, the iterable of a loop
before its variable.  State runs through the file from top to bottom: branches are not merged, loops are walked once,
and functions share one scope.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
from bisect import bisect_left

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinsift.functions.pycode import _LAYOUT
from kinsift.sources.schemas import EDGES

# Operators that define their target.
_PLAIN = frozenset(("=",))
_UPDATES = frozenset("+= -= *= /= //= %= **= &= |= ^= >>= <<=".split())
_HANDLED = (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.For, ast.AsyncFor, ast.FunctionDef, ast.AsyncFunctionDef)
_FALLBACK = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|[^\sA-Za-z_\d]")

Edge = tuple[int, str, str, list[int]]


class _Flow:
    def __init__(self, source: str):
        self.tree = ast.parse(source)
        self.items = [t for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in _LAYOUT and t.string.strip()]
        self.words = [t.string for t in self.items]
        lines = source.splitlines(keepends=True)
        # the syntax tree counts columns in bytes, the tokenizer in characters
        self.places = [(t.start[0], len(lines[t.start[0] - 1][: t.start[1]].encode())) for t in self.items]
        self.named = [t.type == tokenize.NAME and not keyword.iskeyword(t.string) for t in self.items]
        self.last: dict[str, list[int]] = {}
        self.edges: list[Edge] = []

    def begin(self, node: ast.AST) -> int:
        return bisect_left(self.places, (node.lineno, node.col_offset))

    def end(self, node: ast.AST) -> int:
        return bisect_left(self.places, (node.end_lineno, node.end_col_offset))

    def read(self, lo: int, hi: int) -> None:
        for i in range(lo, hi):
            if self.named[i]:
                self.edges.append((i, self.words[i], "comesFrom", list(self.last.get(self.words[i], ()))))

    def define(self, i: int, relation: str, sources: list[int]) -> None:
        self.edges.append((i, self.words[i], relation, sources))
        self.last[self.words[i]] = [i]

    def handled_below(self, nodes: list[ast.AST]) -> list[ast.AST]:
        """Topmost nodes with a rule of their own, in source order."""
        found, todo = [], list(nodes)
        while todo:
            node = todo.pop()
            if isinstance(node, _HANDLED):
                found.append(node)
            else:
                todo.extend(ast.iter_child_nodes(node))
        return sorted(found, key=lambda n: (n.lineno, n.col_offset))

    def walk(self, lo: int, hi: int, nodes: list[ast.AST]) -> None:
        """Tokens lo to hi from left to right; nodes below with a rule follow that."""
        for node in self.handled_below(nodes):
            self.read(lo, self.begin(node))
            self.rule(node)
            lo = self.end(node)
        self.read(lo, hi)

    def rule(self, node: ast.AST) -> None:
        if isinstance(node, (ast.For, ast.AsyncFor)):
            self.loop(node)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            self.function(node)
        else:
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            self.assign(node, targets, self.begin(node))

    def operator_after(self, i: int, hi: int) -> int:
        depth = 0
        for k in range(i, hi):
            word = self.words[k]
            depth += (word in "([{") - (word in ")]}") if len(word) == 1 else 0
            if depth == 0 and (word in _PLAIN or word in _UPDATES):
                return k
        return -1

    def assign(self, node: ast.AST, targets: list[ast.AST], lo: int) -> None:
        hi = self.end(node)
        op = self.operator_after(self.end(targets[0]), hi) if node.value is not None else -1
        if op < 0:
            self.walk(lo, hi, list(ast.iter_child_nodes(node)))
            return
        before = len(self.edges)
        if len(targets) > 1:  # a chain: the rest of it is an assignment of its own
            self.assign(node, targets[1:], op + 1)
        else:
            self.walk(op + 1, hi, [node.value])
        sources = [e[0] for e in self.edges[before:]]
        if isinstance(targets[0], ast.Name) and self.named[lo]:
            if self.words[op] in _UPDATES:
                sources = list(self.last.get(self.words[lo], ())) + sources
            self.define(lo, "computedFrom", sources)
            self.read(lo + 1, op)
        else:
            self.read(lo, op)

    def loop(self, node: ast.For) -> None:
        start, stop = self.begin(node.iter), self.end(node.iter)
        before = len(self.edges)
        self.walk(start, stop, [node.iter])
        sources = [e[0] for e in self.edges[before:]]
        at = self.begin(node.target)
        if isinstance(node.target, ast.Name):
            self.define(at, "comesFrom", sources)
        else:
            self.read(at, self.end(node.target))
        self.walk(stop, self.end(node), [*node.body, *node.orelse])

    def function(self, node: ast.FunctionDef) -> None:
        at = self.begin(node)
        name = next(i for i in range(at, len(self.words)) if self.words[i] == node.name)
        self.read(at, name + 1)
        opened = next(i for i in range(name, len(self.words)) if self.words[i] == "(")
        depth, closed = 0, opened
        for closed in range(opened, len(self.words)):
            depth += (self.words[closed] in "([{") - (self.words[closed] in ")]}") if len(self.words[closed]) == 1 else 0
            if depth == 0:
                break
        a = node.args
        bare = [*a.posonlyargs, *a.args][: len(a.posonlyargs) + len(a.args) - len(a.defaults)]
        bare += [x for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is None]
        fresh = {self.begin(x) for x in bare if x.annotation is None}
        self.read(name + 1, opened)
        for i in range(opened, closed):
            if i in fresh:
                self.define(i, "comesFrom", [])
            else:
                self.read(i, i + 1)
        self.walk(closed, self.end(node), node.body)


def extract(source: str) -> tuple[list[str], list[Edge]]:
    """Tokens and one edge (token, name, relation, source tokens) per identifier token; never raises.

    ``relation`` is ``computedFrom`` for assignment targets, else ``comesFrom``.  What does not parse has tokens by a
    simple pattern and no edges.
    """
    try:
        flow = _Flow(source)
        flow.walk(0, len(flow.words), [flow.tree])
        return flow.words, flow.edges
    except Exception:  # noqa: BLE001
        return _FALLBACK.findall(source), []


@F.udtf(returnType=EDGES.elementType)
class DataflowEdges:
    """Table function: the edges of one source."""

    def eval(self, source: str):
        if source is not None:
            yield from extract(source)[1]


@F.pandas_udf(T.StructType([T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("edges", EDGES)]))
def dataflow_udf(source: pd.Series) -> pd.DataFrame:
    rows = [([], []) if s is None else extract(s) for s in source]
    names = ("idx", "name", "relation", "sources")
    return pd.DataFrame({"tokens": [t for t, _ in rows], "edges": [[dict(zip(names, e)) for e in edges] for _, edges in rows]})


def graph_input(tokenizer, words: list[str], edges: list[Edge], code_length: int = 400, node_length: int = 110) -> dict:
    """Ids, positions, attention pairs and pooling mask of one source for a model that reads code with its data flow.

    Code sub-words come first between two markers and see each other; then one slot per kept edge, which sees itself,
    the sub-words of its token and the slots of its sources, and is seen by them.  ``attention`` lists the pairs
    (i, j), i <= j, beyond the code block.  ``tokenizer`` needs ``tokenize``, ``convert_tokens_to_ids`` and the
    attributes ``unk_token``, ``unk_token_id``, ``cls_token_id``, ``sep_token_id``.
    """
    parts = [tokenizer.tokenize(w) or [tokenizer.unk_token] for w in words]
    begin = [0]
    for p in parts:
        begin.append(begin[-1] + len(p))
    code = [x for p in parts for x in p][:code_length]
    inside = lambda i: 0 <= i < len(words) and begin[i] < len(code)
    kept = [(i, [s for s in sources if inside(s)]) for i, _, _, sources in edges if inside(i)][:node_length]
    first = len(code) + 2
    slot = {i: first + k for k, (i, _) in enumerate(kept)}
    pairs: set[tuple[int, int]] = set()
    for k, (i, sources) in enumerate(kept):
        own = first + k
        pairs.add((own, own))
        # the span may reach over the cut, as far as the row of positions goes
        pairs.update((x, own) for x in range(begin[i] + 1, begin[i + 1] + 1) if x < first + len(kept))
        pairs.update((min(own, slot[s]), max(own, slot[s])) for s in sources if s in slot)
    total = first + len(kept)
    return {
        "input_ids": [tokenizer.cls_token_id, *tokenizer.convert_tokens_to_ids(code), tokenizer.sep_token_id, *[tokenizer.unk_token_id] * len(kept)],
        "position_idx": [*range(first), *[0] * len(kept)],
        "code_block": first,
        "attention": sorted((min(p), max(p)) for p in pairs),
        "pooling": [0 < i <= len(code) for i in range(total)],
    }
