"""Chat formatting: a small sandboxed template language, compiled to closures that render conversations and mark what the assistant generates.

Syntax: text, `{{ expression | filter }}`, `{% for x in name %}..{% endfor %}`, `{% if expression %}..{% elif expression %}..{% else %}..{% endif %}`,
`{% generation %}..{% endgeneration %}`. Expressions: strings, integers, names, `a.b` (keys of records, nothing else), `==`, `!=`, `+`, `not`, `and`,
`or`, brackets. In a loop, `loop.first`, `loop.last` and `loop.index0`. A template reaches only the values it is given: there are no calls, attributes
or imports. The template is parsed to a tree, constant parts are folded, and each node becomes a closure that yields (text, generated) pieces, so a
conversation of any length is rendered as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mark turns; inside texts their first character is written as an entity.
CONTROL = re.compile(r"</?s>|\[/?INST\]")
TEMPLATE = "{% for m in messages %}{% if m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>{% else %}[INST]{{ m.role | name }}\n{{ m.text | escape }}[/INST]{% endif %}{% endfor %}"
TURN = re.compile(r"<s>|\[INST\]")


def escape(text: str) -> str:
    """Write control strings so that they are none: & as &amp; and the first character of a control string as &lt; or &#91;."""
    return CONTROL.sub(lambda m: ("&lt;" if m[0][0] == "<" else "&#91;") + m[0][1:], text.replace("&", "&amp;"))


def unescape(text: str) -> str:
    return text.replace("&lt;", "<").replace("&#91;", "[").replace("&#10;", "\n").replace("&amp;", "&")


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "name": lambda x: escape(x).replace("\n", "&#10;"), "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """A template that isn't well formed, or that asks for something outside its values."""


Node = tuple
TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|[.+|()]))")
BLOCK = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.rest = _tokens(source)[::-1]

    def take(self, *values: str) -> str | None:
        if self.rest and self.rest[-1][1] in values and self.rest[-1][0] != "text":
            return self.rest.pop()[1]
        return None

    def parse(self) -> Node:
        node = self.either()
        while self.take("|"):
            kind, name = self.rest.pop() if self.rest else ("", "")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[-1][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> Node:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.added()
        while sign := self.take("==", "!="):
            node = (sign, node, self.added())
        return node

    def added(self) -> Node:
        node = self.atom()
        while self.take("+"):
            node = ("+", node, self.atom())
        return node

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket isn't closed")
            return node
        if not self.rest:
            raise TemplateError("an expression ends too early")
        kind, value = self.rest.pop()
        if kind == "text":
            return ("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "number":
            return ("constant", int(value))
        if kind != "name":
            raise TemplateError(f"unexpected {value!r}")
        node: Node = ("name", value)
        while self.take("."):
            kind, value = self.rest.pop() if self.rest else ("", "")
            if kind != "name":
                raise TemplateError("a key must follow a dot")
            node = ("key", node, value)
        return node


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    stack: list[tuple[str, list]] = [("", [])]
    at = 0
    for m in BLOCK.finditer(source):
        stack[-1][1].append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(("print", _Expression(m[1]).parse()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            if not (x := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest)):
                raise TemplateError(f"can't read {m[2].strip()!r}")
            stack.append(("for", []))
            stack[-1][1].append((x[1], _Expression(x[2]).parse()))
        elif word == "generation":
            stack.append(("generation", []))
        elif word == "if":
            stack.append(("if", [_Expression(rest).parse()]))
            stack.append(("branch", []))
        elif word in ("elif", "else"):
            kind, body = stack.pop()
            if kind != "branch":
                raise TemplateError(f"{word} outside an if")
            stack[-1][1].extend([("all", body), ("constant", True) if word == "else" else _Expression(rest).parse()])
            stack.append(("branch", []))
        elif word == "endif":
            kind, body = stack.pop()
            if kind != "branch":
                raise TemplateError("endif outside an if")
            parts = [*stack.pop()[1], ("all", body)]
            stack[-1][1].append(("if", [(parts[k], parts[k + 1]) for k in range(0, len(parts), 2)]))
        elif word in ("endfor", "endgeneration"):
            kind, body = stack.pop()
            if "end" + kind != word:
                raise TemplateError(f"{word} closes {kind or 'nothing'}")
            stack[-1][1].append(("for", *body[0], ("all", body[1:])) if kind == "for" else ("generation", ("all", body)))
        else:
            raise TemplateError(f"no statement {word!r}")
    stack[-1][1].append(("text", source[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return ("all", stack[0][1])


def fold(node: Node) -> Node:
    """The same tree with constant parts worked out: operators and filters on constants, branches that are sure, neighbouring texts."""
    kind = node[0]
    if kind in ("==", "!=", "+", "and", "or", "not", "filter"):
        args = tuple(fold(x) if isinstance(x, tuple) else x for x in node[1:])
        if all(x[0] == "constant" for x in args if isinstance(x, tuple)):
            return ("constant", _value((kind, *args))({}))
        return (kind, *args)
    if kind == "key":
        return ("key", fold(node[1]), node[2])
    if kind == "print":
        inner = fold(node[1])
        return ("text", str(inner[1])) if inner[0] == "constant" else ("print", inner)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        branches = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "constant" and not test[1]:
                continue
            branches.append((test, fold(body)))
            if test[0] == "constant":
                break
        if branches and branches[0][0][0] == "constant":
            return branches[0][1]
        return ("if", branches) if branches else ("text", "")
    if kind == "all":
        out: list[Node] = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "all" else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("all", out)
    return node


def _value(node: Node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "constant":
        return lambda env, v=node[1]: v
    if kind == "name":

        def name(env: dict, n=node[1]) -> object:
            if n not in env:
                raise TemplateError(f"no value {n!r}")
            return env[n]

        return name
    if kind == "key":
        of = _value(node[1])

        def key(env: dict, k=node[2]) -> object:
            record = of(env)
            if type(record) is not dict or k not in record:
                raise TemplateError(f"no key {k!r}")
            return record[k]

        return key
    if kind == "filter":
        return lambda env, f=FILTERS[node[1]], of=_value(node[2]): f(str(of(env)))
    args = [_value(x) for x in node[1:]]
    a, b = args[0], args[-1]
    return {"==": lambda env: a(env) == b(env), "!=": lambda env: a(env) != b(env), "+": lambda env: str(a(env)) + str(b(env)), "and": lambda env: a(env) and b(env), "or": lambda env: a(env) or b(env), "not": lambda env: not a(env)}[kind]


Piece = tuple[str, bool]


def _closure(node: Node) -> Callable[[dict, bool], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":

        def run(env: dict, on: bool, v=node[1]) -> Iterator[Piece]:
            yield v, on
    elif kind == "print":

        def run(env: dict, on: bool, v=_value(node[1])) -> Iterator[Piece]:
            yield str(v(env)), on
    elif kind == "generation":

        def run(env: dict, on: bool, body=_closure(node[1])) -> Iterator[Piece]:
            yield from body(env, True)
    elif kind == "if":
        tests = [(_value(t), _closure(b)) for t, b in node[1]]

        def run(env: dict, on: bool) -> Iterator[Piece]:
            for test, body in tests:
                if test(env):
                    yield from body(env, on)
                    return
    elif kind == "for":
        over, body = _value(node[2]), _closure(node[3])

        def run(env: dict, on: bool, x=node[1]) -> Iterator[Piece]:
            items, k, end = iter(over(env)), 0, object()
            now = next(items, end)
            while now is not end:
                after = next(items, end)
                yield from body({**env, x: now, "loop": {"first": k == 0, "last": after is end, "index0": k}}, on)
                now, k = after, k + 1
    else:
        parts = [_closure(x) for x in node[1]]

        def run(env: dict, on: bool) -> Iterator[Piece]:
            for part in parts:
                yield from part(env, on)

    return run


def compile_template(source: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A renderer of messages ({role, text} records, in order): yields (text, generated) pieces."""
    try:
        run = _closure(fold(parse(source)))
    except RecursionError:
        raise TemplateError("nested too deeply") from None
    return lambda messages: run({"messages": messages}, False)


def _mentions(node: object, name: str) -> int:
    """How often a syntax tree asks for a value."""
    if node == ("name", name):
        return 1
    return sum(_mentions(x, name) for x in node) if isinstance(node, (tuple, list)) else 0


def render(source: str, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it that are generated."""
    out, spans, at = [], [], 0
    for text, on in compile_template(source)(messages):
        if on and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation formatted by TEMPLATE."""
    out, at = [], 0
    while at < len(formatted):
        if formatted.startswith("<s>", at):
            end = formatted.index("</s>", at)
            out.append(("assistant", unescape(formatted[at + 3 : end])))
            at = end + 4
        else:
            end = formatted.index("[/INST]", at)
            role, text = formatted[at + 6 : end].split("\n", 1)
            out.append((unescape(role), unescape(text)))
            at = end + 7
    return out


#: A conversation is rendered in segments of about so many characters, at turns' ends; most have one.
SEGMENT = 1 << 20


def _segments(rows: Iterable[dict], template: Callable, size: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Formatted segments of one conversation and their generated spans. A segment ends after a message, once the stream has reached `size`."""
    taken = 0

    def messages() -> Iterator[dict]:
        nonlocal taken
        for r in rows:
            taken += 1
            yield {"role": r["role"], "text": r["text"]}

    out, spans, at, seen = [], [], 0, 0
    for text, on in template(messages()):
        if at >= size and taken > seen:
            yield "".join(out), spans
            out, spans, at = [], [], 0
        seen = taken
        if on and text:
            spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    yield "".join(out), spans


def _conversations(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows that share a key, as streams, from batches sorted by it."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield from batch.slice(at, 512).to_pylist()

    return groupby(rows(), key=lambda r: r[key])


def _sorted(messages: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    rows = messages.select(messages[key].cast("long").alias(key), messages[turn].cast("long").alias("turn"), F.coalesce(messages[role], F.lit("")).alias("role"), F.coalesce(messages[text], F.lit("")).alias("text"))
    return rows.repartition(key).sortWithinPartitions(key, "turn", "role", "text")


def format_conversations(messages: DataFrame, template: str = TEMPLATE, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(key, segment, formatted, spans array<struct<start, end>>): conversations as training texts, spans marking what the assistant generates.

    Rows are ordered by turn, null turns first, ties by role and text; null roles and texts are empty ones; null keys are one conversation; repeated
    rows are repeated turns; other columns are dropped. A conversation goes through its task as a stream, so a hot one takes time but no memory; from
    `segment` characters on it is cut, after a turn, into several rows. Spans are code points of the segment. A template that reads `messages` more than
    once is refused (`render` takes it).
    """
    compile_template(template)  # errors show here, not in a task
    if _mentions(parse(template), "messages") > 1:
        raise TemplateError("messages are a stream, which can be read once")
    schema = f"{key} long, segment int, formatted string, spans array<struct<start:int,end:int>>"
    arrow = pa.schema([(key, pa.int64()), ("segment", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, kept, size = compile_template(template), [], 0
        for k, rows in _conversations(batches, key):
            for n, (formatted, spans) in enumerate(_segments(rows, t, segment)):
                kept.append({key: k, "segment": n, "formatted": formatted, "spans": [{"start": a, "end": b} for a, b in spans]})
                size += len(formatted)
                if len(kept) >= 1000 or size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(kept, schema=arrow)
                    kept, size = [], 0
        yield pa.RecordBatch.from_pylist(kept, schema=arrow)

    return _sorted(messages, key, turn, role, text).mapInArrow(run, schema)


def summaries(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read back from what `format_conversations` made with TEMPLATE.

    Segments of a conversation are read one after the other, and only running digests are held.
    """
    schema = f"{key} long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for k, rows in _conversations(batches, key):
            turns = chars = loss = 0
            every, masked = hashlib.sha256(), hashlib.sha256()
            for r in rows:
                for role, text in read_back(r["formatted"]):
                    turns += 1
                    every.update(f"{role}\n{text}\n".encode())
                for span in r["spans"]:
                    text = unescape(r["formatted"][span["start"] : span["end"]])
                    loss += len(text)
                    masked.update(text.encode())
                chars += len(r["formatted"])
            kept.append(dict(zip(names, (k, turns, every.hexdigest(), loss, masked.hexdigest(), chars), strict=True)))
            if len(kept) >= 1000:
                yield pa.RecordBatch.from_pylist(kept, schema=arrow)
                kept = []
        yield pa.RecordBatch.from_pylist(kept, schema=arrow)

    return formatted.mapInArrow(run, schema)
