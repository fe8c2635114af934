"""Chat formatting: a template compiler, and the way back from formatted conversations.

A template is text with ``{{ expression }}``, ``{% for x in y %}``, ``{% if %}`` / ``{% elif %}`` / ``{% else %}``,
``{% set x = expression %}``, ``{% generation %}`` ... ``{% endgeneration %}`` and ``{# remarks #}``; a ``-`` inside
a mark takes the white space beside it. It is parsed into a syntax tree, constants are folded, and every node
becomes a Python closure. Sandbox: expressions see only the values given, the fields of mappings, indexes,
the operators and the filters of ``FILTERS``; there are no calls, no attributes of objects and no imports.

Closures yield their output piece by piece and read ``messages`` as they come, so a conversation of any length
is formatted in bounded memory, into parts of ``PART_CHARS`` code points or a message more. What is inside
generation marks is the loss mask, kept as spans of each part.

The ``escape`` filter makes the control strings of a template harmless inside a text, and ``unescape`` undoes it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"

#: Strings that no text may hold unescaped: those of ``DEFAULT_TEMPLATE`` and of common chat formats.
CONTROL_STRINGS = (
    TURN,
    BODY,
    END,
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|begin_of_text|>",
    "<|end_of_text|>",
    "<|start_header_id|>",
    "<|end_header_id|>",
    "<|eot_id|>",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
)

DEFAULT_TEMPLATE = (
    "{%- for m in messages -%}"
    f"{TURN}" + "{{ m.role | escape }}" + f"{BODY}"
    "{%- if m.role == 'assistant' -%}{% generation %}{{ m.text | escape }}{% endgeneration %}{%- else -%}{{ m.text | escape }}{%- endif -%}"
    f"{END}"
    "{%- endfor -%}"
)

#: A part of a formatted conversation is closed once it has so many code points.
PART_CHARS = 1 << 20

ESCAPE = "\\"
#: A backslash, or the first character of a control string; each gets a backslash: before or after it.
RISKY = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL_STRINGS)]))


def escape(text: str) -> str:
    """The text without control strings: a backslash goes after their first character, and backslashes are doubled."""
    return RISKY.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0] + ESCAPE, text)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return re.sub(r"\\(\\?)", r"\1", text)


class TemplateError(ValueError):
    """The template can't be parsed, or asks for what the sandbox has not."""


#: What expressions may apply with ``|``.
FILTERS: dict[str, Callable[..., Any]] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": len,
    "json": lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True),
    "default": lambda x, other="": other if x is None else x,
    "replace": lambda x, old, new: _text(x).replace(_text(old), _text(new)),
    "join": lambda x, mark="": _text(mark).join(map(_text, x)),
}


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else ("true" if x else "false") if isinstance(x, bool) else str(x)


# --- syntax tree -----------------------------------------------------------------------------------------------

Node = tuple  # (kind, ...): expressions and statements

TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<mark>==|!=|<=|>=|[-+*/%~<>()\[\].,|]))")
MARKS = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(?:.*?)(-?)#\}", re.DOTALL)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "/", "%"))


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            found = TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" else None

    def take(self, *wanted: str) -> str | None:
        if (got := self.peek()) in wanted:
            self.at += 1
            return got
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def whole(self) -> Node:
        node = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is too much")
        return node

    def level(self, n: int) -> Node:
        if n == len(LEVELS):
            return self.unary()
        if n == 2 and self.take("not"):
            return ("unary", "not", self.level(2))
        node = self.level(n + 1)
        while op := self.take(*LEVELS[n]):
            node = ("binary", op, node, self.level(n + 1))
        return node

    def unary(self) -> Node:
        if op := self.take("-", "not"):
            return ("unary", op, self.unary())
        node = self.atom()
        while mark := self.take(".", "[", "|"):
            if mark == "[":
                node = ("item", node, self.level(0))
                self.need("]")
                continue
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name":
                raise TemplateError(f"a name is missing after {mark!r}")
            self.at += 1
            if mark == ".":
                node = ("item", node, ("constant", name))
                continue
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name!r}")
            node = ("filter", name, node, *(self.listed(")") if self.take("(") else ()))
        return node

    def listed(self, end: str) -> list[Node]:
        nodes: list[Node] = []
        while not self.take(end):
            if nodes:
                self.need(",")
            nodes.append(self.level(0))
        return nodes

    def atom(self) -> Node:
        if self.take("("):
            node = self.level(0)
            self.need(")")
            return node
        if self.take("["):
            return ("list", *self.listed("]"))
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        self.at += 1
        if kind == "number":
            return ("constant", float(text) if "." in text else int(text))
        if kind == "string":
            return ("constant", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "name":
            return ("constant", WORDS[text]) if text in WORDS else ("name", text)
        raise TemplateError("an expression is missing")


def parse(source: str) -> Node:
    """The syntax tree: ("block", node, ...) of ("text", s), ("out", e), ("for", name, e, block), ("if", e, block, block), ("set", name, e) and ("generation", block)."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in MARKS.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        text = text.rstrip() if m[1] or m[4] or m[7] else text
        pieces.append(("text", text))
        strip, at = bool(m[3] or m[6] or m[8]), m.end()
        if m[2] is not None:
            pieces.append(("out", m[2]))
        elif m[5] is not None:
            pieces.append(("tag", m[5].strip()))
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    place = 0

    def block(*ends: str) -> tuple[Node, str]:
        nonlocal place
        nodes: list[Node] = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            if kind == "text":
                if text:
                    nodes.append(("text", text))
                continue
            if kind == "out":
                nodes.append(("out", Expression(text).whole()))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return ("block", *nodes), text
            if word == "for":
                if not (found := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
                    raise TemplateError(f"can't read {text!r}")
                nodes.append(("for", found[1], Expression(found[2]).whole(), block("endfor")[0]))
            elif word == "if":
                nodes.append(condition(rest))
            elif word == "set":
                name, mark, value = rest.partition("=")
                if not mark or not name.strip().isidentifier():
                    raise TemplateError(f"can't read {text!r}")
                nodes.append(("set", name.strip(), Expression(value).whole()))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"there is no {word!r}")
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return ("block", *nodes), ""

    def condition(rest: str) -> Node:
        test = Expression(rest).whole()
        then, end = block("elif", "else", "endif")
        if end.startswith("elif"):
            return ("if", test, then, condition(end[4:]))
        return ("if", test, then, block("endif")[0] if end == "else" else ("block",))

    return block()[0]


def fold(node: Node) -> Node:
    """The tree with constant expressions worked out, decided branches taken and neighbouring texts joined."""
    kind = node[0]
    if kind in ("constant", "name", "text"):
        return node
    parts = [fold(x) if isinstance(x, tuple) else x for x in node[1:]]
    if kind in ("unary", "binary", "item", "list", "filter") and all(x[0] == "constant" for x in parts if isinstance(x, tuple)):
        try:
            return ("constant", expression((kind, *parts))({}))
        except (TypeError, ValueError, ArithmeticError) as e:
            raise TemplateError(f"a constant can't be worked out: {e}") from e
    if kind == "out" and parts[0][0] == "constant":
        return ("text", _text(parts[0][1]))
    if kind == "if" and parts[0][0] == "constant":
        return parts[1] if parts[0][1] else parts[2]
    if kind == "block":
        flat: list[Node] = []
        for x in parts:
            for y in x[1:] if x[0] == "block" else (x,):
                if y[0] == "text" and flat and flat[-1][0] == "text":
                    flat[-1] = ("text", flat[-1][1] + y[1])
                elif y != ("text", ""):
                    flat.append(y)
        return ("block", *flat)
    return (kind, *parts)


# --- closures --------------------------------------------------------------------------------------------------

#: Numbers that a template works out stay below it.
LARGEST = 1 << 63


def _numbers(work: Callable[[Any, Any], Any]) -> Callable[[Any, Any], Any]:
    """An operator of numbers alone, so that no template formats or repeats a text by it, and of bounded results."""

    def apply(a: Any, b: Any) -> Any:
        if not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
            raise TemplateError(f"no numbers: {type(a).__name__} and {type(b).__name__}")
        try:
            out = work(a, b)
        except ArithmeticError as e:
            raise TemplateError(str(e)) from e
        if not abs(out) < LARGEST:
            raise TemplateError("a number is too large")
        return out

    return apply


OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "-": _numbers(lambda a, b: a - b),
    "*": _numbers(lambda a, b: a * b),
    "/": _numbers(lambda a, b: a / b),
    "%": _numbers(lambda a, b: a % b),
    "~": lambda a, b: _text(a) + _text(b),
}

Scope = dict[str, Any]
Marked = tuple[str, bool]  # a piece of output, and whether generated


def item(holder: Any, key: Any) -> Any:
    if isinstance(holder, dict):
        return holder.get(key)
    if isinstance(holder, (list, str)) and isinstance(key, int):
        return holder[key] if -len(holder) <= key < len(holder) else None
    if holder is None:
        return None
    raise TemplateError(f"{type(holder).__name__} has no {key!r} here")


def expression(node: Node) -> Callable[[Scope], Any]:
    kind = node[0]
    if kind == "constant":
        value = node[1]
        return lambda scope: value
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "list":
        parts = [expression(x) for x in node[1:]]
        return lambda scope: [p(scope) for p in parts]
    if kind == "item":
        holder, key = expression(node[1]), expression(node[2])
        return lambda scope: item(holder(scope), key(scope))
    if kind == "filter":
        apply, parts = FILTERS[node[1]], [expression(x) for x in node[2:]]
        return lambda scope: apply(*(p(scope) for p in parts))
    if kind == "unary":
        of = expression(node[2])
        return (lambda scope: not of(scope)) if node[1] == "not" else (lambda scope: -of(scope))
    op, left, right = node[1], expression(node[2]), expression(node[3])
    if op == "and":
        return lambda scope: left(scope) and right(scope)
    if op == "or":
        return lambda scope: left(scope) or right(scope)
    apply = OPERATORS[op]
    return lambda scope: apply(left(scope), right(scope))


def statement(node: Node) -> Callable[[Scope, bool], Iterator[Marked]]:
    kind = node[0]
    if kind == "block":
        parts = [statement(x) for x in node[1:]]

        def run_block(scope: Scope, generated: bool) -> Iterator[Marked]:
            for part in parts:
                yield from part(scope, generated)

        return run_block
    if kind == "text":
        text = node[1]
        return lambda scope, generated: iter(((text, generated),))
    if kind == "out":
        value = expression(node[1])
        return lambda scope, generated: iter(((_text(value(scope)), generated),))
    if kind == "set":
        name, value = node[1], expression(node[2])

        def run_set(scope: Scope, generated: bool) -> Iterator[Marked]:
            scope[name] = value(scope)
            return iter(())

        return run_set
    if kind == "generation":
        inside = statement(node[1])
        return lambda scope, generated: inside(scope, True)
    if kind == "if":
        test, then, other = expression(node[1]), statement(node[2]), statement(node[3])
        return lambda scope, generated: (then if test(scope) else other)(scope, generated)
    name, values, body = node[1], expression(node[2]), statement(node[3])

    def run_for(scope: Scope, generated: bool) -> Iterator[Marked]:
        rest = iter(values(scope) or ())
        if (now := next(rest, rest)) is rest:
            return
        index = 0
        while now is not rest:
            after = next(rest, rest)  # one ahead, for loop.last
            own = scope | {name: now, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": after is rest}}
            yield from body(own, generated)
            now, index = after, index + 1

    return run_for


@functools.cache
def compiled(source: str) -> Callable[[Scope, bool], Iterator[Marked]]:
    """The closure of a template: takes a scope (and False) and yields (piece, generated)."""
    return statement(fold(parse(source)))


def render(source: str, **scope: Any) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and its generated spans (start, end), neighbouring ones joined only if of one mark."""
    text, spans = [], []
    at = 0
    for piece, generated in compiled(source)(scope, False):
        if generated and piece:
            spans.append((at, at + len(piece)))
        text.append(piece)
        at += len(piece)
    return "".join(text), spans


# --- on Spark --------------------------------------------------------------------------------------------------

FORMATTED = "conv_id long, part int, formatted string, spans array<struct<start:int,stop:int>>"
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def conversations_in(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[Any, Iterator[dict[str, Any]]]]:
    """(conv_id, its rows as they come), of batches sorted by conv_id; a conversation's rows must be read before the next."""
    rows = (row for batch in batches for row in batch.select(["conv_id", *columns]).to_pylist())
    now = next(rows, None)

    def own(key: Any) -> Iterator[dict[str, Any]]:
        nonlocal now
        while now is not None and now["conv_id"] == key:
            row, now = now, next(rows, None)
            yield row

    while now is not None:
        key = now["conv_id"]
        mine = own(key)
        yield key, mine
        for _ in mine:
            pass


def format_conversations(rows: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """(conv_id, part, formatted, spans): conversations formatted, with spans of the loss mask in each part.

    ``rows`` has conv_id, turn, role and text; a message of a conversation has the fields turn, role and text.
    Parts come in order inside of a partition, all parts of a conversation in one; a part ends after the message
    that fills it. Every row is one message: rows of a turn that repeats are ordered by role and text.

    Defined cases: null texts and roles are empty; a null turn comes first; rows without conv_id are one
    conversation with a null conv_id; other columns are ignored; no rows in, no rows out.
    """
    compiled(template)  # errors show here and not in tasks
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = compiled(template)

        def parts() -> Iterator[tuple[Any, int, str, list[dict[str, int]]]]:
            for conv_id, messages in conversations_in((s for b in batches for s in steps([b], "text")), ["turn", "role", "text"]):
                part, pieces, spans, size = 0, [], [], 0
                for piece, generated in make({"messages": messages}, False):
                    if generated and piece:
                        spans.append({"start": size, "stop": size + len(piece)})
                    pieces.append(piece)
                    size += len(piece)
                    if size >= PART_CHARS:
                        yield conv_id, part, "".join(pieces), spans
                        part, pieces, spans, size = part + 1, [], [], 0
                yield conv_id, part, "".join(pieces), spans

        held, size = [], 0
        for row in parts():
            held.append(row)
            size += len(row[2])
            if size >= 4 * PART_CHARS:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)

    def batch_of(held: list) -> pa.RecordBatch:
        ids, numbers, texts, spans = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(spans, SPAN)], ["conv_id", "part", "formatted", "spans"])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


@dataclass
class Reader:
    """Reads turns back from the parts of one conversation in the default template's form."""

    rest: str = ""

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in this part."""
        whole, at = self.rest + formatted, 0
        while (end := whole.find(END, at)) >= 0:
            if not whole.startswith(TURN, at) or (middle := whole.find(BODY, at, end)) < 0:
                raise ValueError(f"no turn at {at}")
            yield unescape(whole[at + len(TURN) : middle]), unescape(whole[middle + len(BODY) : end])
            at = end + len(END)
        self.rest = whole[at:]


def read_turns(formatted: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, loss): the turns of ``format_conversations`` with the default template, read back from its output.

    Needs parts in order, as ``format_conversations`` leaves them; of a stored table, repartition by conv_id and sort first.
    """
    return formatted.mapInArrow(_digests(turns=True), "conv_id long, place long, role string, text string")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from formatted parts in order."""
    return formatted.mapInArrow(_digests(turns=False), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for conv_id, parts in conversations_in(batches, ["formatted", "spans"]):
            reader, place, said, loss, loss_chars, chars = Reader(), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
            for part in parts:
                for role, text in reader.turns(part["formatted"]):
                    if turns:
                        rows.append((conv_id, place, role, text))
                        size += len(text)
                    place += 1
                    said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in part["spans"]:
                    own = unescape(part["formatted"][span["start"] : span["stop"]])
                    loss_chars += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
                chars += len(part["formatted"])
                if turns and size >= PART_CHARS:
                    yield _rows(rows, READ)
                    rows, size = [], 0
            if reader.rest:
                raise ValueError(f"conversation {conv_id} doesn't end with a turn's end")
            if not turns:
                rows.append((conv_id, place, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                if len(rows) >= 10_000:
                    yield _rows(rows, DIGESTS)
                    rows = []
        if rows:
            yield _rows(rows, READ if turns else DIGESTS)

    return run


READ = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
