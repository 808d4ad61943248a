"""Chat formatting by a small template compiler.

A template is text with `{{ expression }}` and the statements `{% for x in e %}`,
`{% if e %} ... {% elif e %} ... {% else %} ... {% endif %}`, `{% set x = e %}` and
`{% generation %} ... {% endgeneration %}`.  It is parsed into a syntax tree, constants are
folded, and every node becomes a Python closure.  The language is a sandbox: it knows
literals, names, item and attribute lookups in dicts and lists, `+ == != < > and or not
in ~`, and the filters given to the compiler; it has no calls, no attributes of Python
objects and no loops other than over a list, so rendering always ends.  In a loop,
`loop.index0`, `loop.index`, `loop.first`, `loop.last` and `loop.previtem` tell of the place
in the list; for the messages that is the place in the whole conversation, also where the
turns of a long one are rendered one after another.

Control strings in the texts are escaped reversibly: a backslash is doubled, and one is
put after the first character of every control string.  Text inside a generation block is
recorded as spans of the output (the loss mask).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'assistant' %}[ANS]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[INST]{{ m.role | escape_line }}\n{{ m.text | escape }}[/INST]{% endif %}"
    "{% endfor %}"
)
PIECE = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
LEX = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+<>~|.\[\](),]))")
_ESCAPABLE = re.compile("|".join(re.escape(c) for c in ("\\", *sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(\\?)", re.S)


def escape(text: str) -> str:
    return _ESCAPABLE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_line(text: str) -> str:
    """Also keeps line feeds out, as a role ends at one."""
    return escape(text.replace("\x00", "\x000").replace("\n", "\x001"))


def unescape_line(text: str) -> str:
    return unescape(text).replace("\x001", "\n").replace("\x000", "\x00")


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line}


class TemplateError(ValueError):
    pass


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Item:
    base: object
    key: object


@dataclass
class Unary:
    op: str
    a: object


@dataclass
class Binary:
    op: str
    a: object
    b: object


@dataclass
class Filtered:
    a: object
    name: str


@dataclass
class Print:
    value: object


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class If:
    arms: list  # (condition, body)


@dataclass
class Set:
    name: str
    value: object


@dataclass
class Generation:
    body: list


class Parser:
    """Expressions by precedence climbing, statements by recursive descent."""

    def __init__(self, template: str):
        self.parts = [p for p in PIECE.split(template) if p]
        self.at = 0

    def template(self) -> list:
        body, end = self.body(())
        assert end is None
        return body

    def body(self, ends: tuple[str, ...]) -> tuple[list, tuple[str, str] | None]:
        out: list = []
        while self.at < len(self.parts):
            p = self.parts[self.at]
            self.at += 1
            if p.startswith("{{"):
                out.append(Print(self.expression(p[2:-2])))
            elif p.startswith("{%"):
                word, _, rest = p[2:-2].strip().partition(" ")
                if word in ends:
                    return out, (word, rest)
                out.append(self.statement(word, rest.strip()))
            else:
                out.append(Print(Const(p)))
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return out, None

    def statement(self, word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"for {rest}")
            over = self.expression(m[2])
            return For(m[1], over, self.body(("endfor",))[0])
        if word == "if":
            arms, condition = [], self.expression(rest)
            while True:
                body, (end, more) = self.body(("elif", "else", "endif"))
                arms.append((condition, body))
                if end == "endif":
                    return If(arms)
                condition = self.expression(more) if end == "elif" else Const(True)
        if word == "set":
            name, eq, value = rest.partition("=")
            if not eq or not name.strip().isidentifier():
                raise TemplateError(f"set {rest}")
            return Set(name.strip(), self.expression(value))
        if word == "generation":
            return Generation(self.body(("endgeneration",))[0])
        raise TemplateError(f"unknown statement {word}")

    def expression(self, source: str):
        self.tokens, k = [], 0
        source = source.strip()
        while k < len(source):
            m = LEX.match(source, k)
            if not m:
                raise TemplateError(f"at {source[k:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            k = m.end()
        out = self.level(0)
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r} in {source!r}")
        return out

    LEVELS = (("or",), ("and",), ("==", "!=", "<", ">", "in"), ("+", "-", "~"))

    def peek(self) -> str | None:
        return self.tokens[0][1] if self.tokens and self.tokens[0][0] != "str" else None

    def level(self, n: int):
        if n == len(self.LEVELS):
            return self.unary()
        if n == 2 and self.peek() == "not":  # binds less than comparisons
            return Unary(self.tokens.pop(0)[1], self.level(n))
        a = self.level(n + 1)
        while self.peek() in self.LEVELS[n]:
            a = Binary(self.tokens.pop(0)[1], a, self.level(n + 1))
        return a

    def unary(self):
        if self.peek() == "-":
            return Unary(self.tokens.pop(0)[1], self.unary())
        if not self.tokens:
            raise TemplateError("expression ends early")
        kind, text = self.tokens.pop(0)
        if kind == "str":
            a = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        elif kind == "num":
            a = Const(int(text))
        elif kind == "name":
            a = Const({"true": True, "false": False, "none": None}[text]) if text in ("true", "false", "none") else Name(text)
        elif text == "(":
            a = self.level(0)
            self.expect(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while self.peek() in (".", "[", "|"):
            op = self.tokens.pop(0)[1]
            if op == "[":
                a = Item(a, self.level(0))
                self.expect("]")
            elif not self.tokens or self.tokens[0][0] != "name":
                raise TemplateError(f"a name must follow {op}")
            elif op == ".":
                a = Item(a, Const(self.tokens.pop(0)[1]))
            else:
                a = Filtered(a, self.tokens.pop(0)[1])
        return a

    def expect(self, what: str) -> None:
        if self.peek() != what:
            raise TemplateError(f"expected {what}")
        self.tokens.pop(0)


OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "~": lambda a, b: f"{a}{b}",
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "in": lambda a, b: a in b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def fold(node, filters):
    """The tree with constant operations done, constant branches chosen and neighbouring
    constant texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in (y for n in node for y in _several(fold(n, filters))):
            if out and all(isinstance(z, Print) and isinstance(z.value, Const) for z in (out[-1], x)):
                out[-1] = Print(Const(_shown(out[-1].value.value) + _shown(x.value.value)))
            else:
                out.append(x)
        return out
    if isinstance(node, Binary):
        a, b = fold(node.a, filters), fold(node.b, filters)
        if isinstance(a, Const) and isinstance(b, Const):
            try:
                return Const(OPS[node.op](a.value, b.value))
            except TypeError as e:
                raise TemplateError(str(e)) from e
        return Binary(node.op, a, b)
    if isinstance(node, Unary):
        a = fold(node.a, filters)
        return Const(_unary(node.op, a.value)) if isinstance(a, Const) else Unary(node.op, a)
    if isinstance(node, Item):
        return Item(fold(node.base, filters), fold(node.key, filters))
    if isinstance(node, Filtered):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name}")
        a = fold(node.a, filters)
        return Const(filters[node.name](_shown(a.value))) if isinstance(a, Const) else Filtered(a, node.name)
    if isinstance(node, Print):
        return Print(fold(node.value, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.over, filters), fold(node.body, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):
        arms = []
        for c, body in node.arms:
            c = fold(c, filters)
            if isinstance(c, Const) and not c.value:
                continue
            arms.append((c, fold(body, filters)))
            if isinstance(c, Const):
                break
        if arms and isinstance(arms[0][0], Const):
            return arms[0][1]
        return If(arms)
    return node


def _several(x) -> list:
    return x if isinstance(x, list) else [x]


def _shown(x) -> str:
    return "" if x is None else str(x)


def _unary(op: str, a):
    return (not a) if op == "not" else -a


@dataclass
class Output:
    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node, filters) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Item):
        base, key = _value(node.base, filters), _value(node.key, filters)

        def look(env):
            b, k = base(env), key(env)
            if isinstance(b, dict):
                return b.get(k)
            return b[k] if isinstance(b, list) and isinstance(k, int) and -len(b) <= k < len(b) else None

        return look
    if isinstance(node, Filtered):
        inner, f = _value(node.a, filters), filters[node.name]
        return lambda env: f(_shown(inner(env)))
    if isinstance(node, Unary):
        inner = _value(node.a, filters)
        return lambda env, op=node.op: _unary(op, inner(env))
    a, b = _value(node.a, filters), _value(node.b, filters)
    if node.op == "and":
        return lambda env: a(env) and b(env)
    if node.op == "or":
        return lambda env: a(env) or b(env)
    return lambda env, op=OPS[node.op]: op(a(env), b(env))


def _run(node, filters) -> Callable[[dict, Output], None]:
    if isinstance(node, list):
        steps = [_run(n, filters) for n in node]

        def body(env, out):
            for s in steps:
                s(env, out)

        return body
    if isinstance(node, Print):
        value = _value(node.value, filters)
        return lambda env, out: out.put(_shown(value(env)))
    if isinstance(node, Set):
        value = _value(node.value, filters)
        return lambda env, out, n=node.name: env.__setitem__(n, value(env))
    if isinstance(node, For):
        over, inner = _value(node.over, filters), _run(node.body, filters)

        def loop(env, out, n=node.name):
            items = over(env) or ()
            before, previous, ends = env["_place"] if items is env["messages"] else (0, None, True)
            for i, x in enumerate(items):
                k = before + i
                about = {"index0": k, "index": k + 1, "first": k == 0, "last": ends and i == len(items) - 1, "previtem": items[i - 1] if i else previous}
                inner(env | {n: x, "loop": about}, out)

        return loop
    if isinstance(node, Generation):
        inner = _run(node.body, filters)

        def marked(env, out):
            start = out.length
            inner(env, out)
            out.spans.append((start, out.length))

        return marked
    arms = [(_value(c, filters), _run(b, filters)) for c, b in node.arms]

    def choose(env, out):
        for c, b in arms:
            if c(env):
                b(env, out)
                return

    return choose


def compile_template(template: str = TEMPLATE, filters: dict[str, Callable[[str], str]] | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dicts of role and text) to the text and its loss spans.
    For messages that are part of a conversation it takes how many come before them, the
    one just before, and whether the conversation ends with them."""
    filters = FILTERS if filters is None else filters
    run = _run(fold(Parser(template).template(), filters), filters)

    def render(messages: list[dict], before: int = 0, previous: dict | None = None, ends: bool = True) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run({"messages": messages, "_place": (before, previous, ends)}, out)
        return "".join(out.parts), out.spans

    return render


_TURN = re.compile(r"\[ANS\](.*?)</s>|\[INST\]([^\n]*)\n(.*?)\[/INST\]", re.S)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in what TEMPLATE made; raises if anything else is left."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        yield ("assistant", unescape(m[1])) if m[1] is not None else (unescape_line(m[2]), unescape(m[3]))
    if at != len(text):
        raise ValueError("text after the last turn")


FORMATTED = "conv_id long, seq long, formatted string, spans array<struct<start:long,end:long>>"


def render_turns(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """FORMATTED rows: each turn of (conv_id, turn, role, text) rendered, in sorted order
    within its conversation.  seq numbers a conversation's turns from 0; spans are offsets
    within the turn's own text.  A conversation streams through one task turn by turn, so
    its length isn't bounded by memory; the template sees each turn's place in all of it.

    Null texts and roles count as empty; null conv_ids form one conversation; turns with
    equal numbers are ordered by role and text; an empty table gives an empty result."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        render = compile_template(template)
        held, seq, previous = None, 0, None  # the turn that waits to know if it is the last

        def made(ends: bool) -> tuple:
            text, spans = render([held[1]], seq, previous, ends)
            return held[0], seq, text, [{"start": a, "end": b} for a, b in spans]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["conv_id", "seq", "formatted", "spans"])
            return out.astype({"conv_id": "Int64", "seq": "int64"})

        for batch in batches:
            out = []
            for conv, role, text in zip(batch["conv_id"].astype(object), batch["role"], batch["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if held is not None:
                    same = held[0] == conv
                    out.append(made(not same))
                    seq, previous = (seq + 1, held[1]) if same else (0, None)
                held = (conv, {"role": role or "", "text": text or ""})
            yield frame(out)
        if held is not None:
            yield frame([made(True)])

    picked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInPandas(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One DIGEST row for each conversation, read back from the formatted text: turns are
    parsed from the output, and the loss text is what its spans cut out of it."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), None

        def row():
            n, all_, loss, chars, made = state
            return (current, n, all_.hexdigest(), chars, loss.hexdigest(), made)

        for batch in batches:
            out = []
            for conv, made, spans in zip(batch["conv_id"].astype(object), batch["formatted"], batch["spans"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != current:
                    if state is not None:
                        out.append(row())
                    current, state = conv, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text in parse(made):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                for s in spans:
                    text = unescape(made[s["start"] : s["end"]])
                    state[2].update(text.encode("utf-8", "replace"))
                    state[3] += len(text)
                state[4] += len(made)
            yield table_of(out)
        if state is not None:
            yield table_of([row()])

    return render_turns(turns, template).mapInPandas(run, DIGEST)


def table_of(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])
    return frame.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})


def conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id and the formatted text with BOS, assembled from its turns, for conversations
    that fit in memory; long ones are better used as the rows of render_turns."""
    parts = render_turns(turns, template)
    joined = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "formatted"))).alias("p"))
    return joined.select("conv_id", F.concat(F.lit("<s>"), F.array_join(F.transform("p", lambda x: x["formatted"]), "")).alias("formatted"))
