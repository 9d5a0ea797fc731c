"""Extraction programs: nested scopes that print.

A program is a row of arguments: scopes (-pattern, -path, -division, -group, -branch,
-block, -section, -subset, -unit), each with a position, conditions and commands, and
commands after -else for visits that fail. A program runs in one narrow stage, a record in
its own task, and gives a line of text for each record that prints anything.

Separators are queued: what -tab says is printed before the next value, not after the one
at hand, so the last value of a row has none. A scope's separators begin anew with it,
while the queued one passes on from scope to scope.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.markup import VOID, Tree, tree_of
from .scope import Selector, gathered, visits

#: Scopes from the outermost to the innermost.
SCOPES = ("pattern", "path", "division", "group", "branch", "block", "section", "subset", "unit")
TESTS = ("equals", "contains", "includes", "is-within", "starts-with", "ends-with", "is-not", "is-before", "is-after", "matches", "resembles", "is-equal-to", "differs-from", "gt", "ge", "lt", "le", "eq", "ne")
SETTINGS = ("tab", "ret", "sep", "pfx", "sfx", "plg", "elg", "def", "wrp", "enc", "pfc", "deq", "reg", "exp")
FLAGS = ("clr", "rst", "else", "cls", "slf")
ITEM = re.compile(r"-?\d+$")


@dataclass
class Command:
    name: str
    value: str = ""
    other: str = ""


@dataclass
class Scope:
    path: str
    position: str = "all"
    #: (if, unless, and, or; selector; test or ""; right side)
    conditions: list[tuple[str, str, str, str]] = field(default_factory=list)
    commands: list[Command] = field(default_factory=list)
    failure: list[Command] = field(default_factory=list)
    inner: list[Scope] = field(default_factory=list)
    before: str = ""
    after: str = ""


def slashes(text: str) -> str:
    """Control characters from their escapes."""
    return re.sub(r"\\([nrtf\\\"'])", lambda m: {"n": "\n", "r": "\r", "t": "\t", "f": "\f"}.get(m[1], m[1]), text)


def nested(tags: str) -> tuple[str, str]:
    """'A/B' as (<A><B>, </B></A>)."""
    parts = tags.split("/")
    return "".join(f"<{p}>" for p in parts), "".join(f"</{p}>" for p in reversed(parts))


def parse(arguments: list[str]) -> Scope:
    """The tree of scopes that arguments say; the first scope is -pattern."""
    top: Scope | None = None
    open_: list[tuple[int, Scope]] = []
    into: list[Command] = []
    last = "element"
    i = 0

    def take() -> str:
        nonlocal i
        if i >= len(arguments):
            raise ValueError(f"{arguments[-1]} lacks a value")
        i += 1
        return arguments[i - 1]

    while i < len(arguments):
        word = take()
        # a number or a lone dash is a value, and so is what follows a command without a dash
        option = len(word) > 1 and word[0] == "-" and not ITEM.match(word)
        name = word.lstrip("-").lower() if option else ""
        if option and name in SCOPES:
            level = SCOPES.index(name)
            scope = Scope(take())
            while open_ and open_[-1][0] >= level:
                open_.pop()
            if open_:
                open_[-1][1].inner.append(scope)
            elif top is None:
                top = scope
            else:
                raise ValueError("a program has one -pattern")
            open_.append((level, scope))
            into = scope.commands
            continue
        if top is None:
            raise ValueError("a program begins with -pattern")
        here = open_[-1][1]
        if not option:
            into.append(Command(last, word))
        elif name == "position":
            here.position = take()
        elif name == "select":
            here.position = "select"
            here.conditions.append(("if", take(), "", ""))
        elif name in ("if", "unless", "and", "or", "match", "avoid"):
            selector, test, right = take(), "", ""
            if name in ("match", "avoid"):
                # the older form tests a value inline
                selector, _, right = selector.partition(":")
                name, test = ("if" if name == "match" else "unless"), "equals" if right else ""
            if i < len(arguments) and arguments[i].startswith("-") and arguments[i][1:] in TESTS:
                test, right = take()[1:], take()
            here.conditions.append((name, selector, test, right))
        elif name == "else":
            into = here.failure
        elif name == "fwd":
            here.before = slashes(take())
        elif name == "awd":
            here.after = slashes(take())
        elif name == "pkg":
            tags = take()
            here.before, here.after = nested(tags) if tags not in ("", "-") else ("", "")
        elif name in ("att", "atr"):
            key, value = take(), take()
            if value:
                into += [Command("lbl", f' {key}="' + (slashes(value) + '"' if name == "att" else ""))]
                into += [] if name == "att" else [Command("element", value), Command("lbl", '"')]
        elif name == "tag":
            into += [Command("tab"), Command("sep"), Command("tag", "<" + slashes(take()))]
        elif name == "end":
            into.append(Command("lbl", f"</{slashes(take())}>"))
        elif name == "cls":
            into.append(Command("lbl", ">"))
        elif name == "slf":
            into.append(Command("lbl", "/>"))
        elif name == "lbl" or name in SETTINGS:
            into.append(Command(name, slashes(take())))
        elif name in FLAGS:
            into.append(Command(name))
        elif re.fullmatch(r"--?[A-Z][A-Z0-9_]*", word):
            into.append(Command("append" if word.startswith("--") else "set", word.lstrip("-"), take()))
        elif name in VALUES:
            last = name
            into.append(Command(name, take()))
        else:
            raise ValueError(f"not a command: {word}")
    if top is None:
        raise ValueError("a program begins with -pattern")
    return top


WHOLE = re.compile(r"[+-]?\d+")


def whole(text: str) -> int | None:
    return int(text) if WHOLE.fullmatch(text) else None


@lru_cache(maxsize=4096)
def parted(selector: str) -> list[str]:
    """'A,B' by its commas; those inside a range don't part."""
    return re.split(r",(?![^\[]*\])", selector)


def numbers(values: list[str]) -> list[int]:
    return [n for n in map(whole, values) if n is not None]


def escape(text: str) -> str:
    return html.escape(text, quote=False).replace('"', "&#34;").replace("'", "&#39;")


def one(f: Callable[[list[int]], int]) -> Callable[[list[str]], list[str]]:
    """A number of all whole numbers, nothing if there are none."""
    return lambda v: [str(f(n))] if (n := numbers(v)) else []


def every(f: Callable[[str], str]) -> Callable[[list[str]], list[str]]:
    return lambda v: [f(x) for x in v]


#: What commands make of a selector's values.
VALUES: dict[str, Callable[[list[str]], list[str]]] = {
    "element": lambda v: v,
    "raw": lambda v: v,
    "first": lambda v: v[:1],
    "last": lambda v: v[-1:],
    "backward": lambda v: v[::-1],
    "encode": every(escape),
    "upper": every(str.upper),
    "lower": every(str.lower),
    "chain": every(lambda x: x.replace(" ", "_")),
    "mirror": every(lambda x: x[::-1]),
    "num": lambda v: [str(len(v))],
    "len": lambda v: [str(sum(len(x.encode()) for x in v))] if v else [],
    "sum": one(sum),
    "min": one(min),
    "max": one(max),
    "avg": one(lambda n: int(sum(n) / len(n))),
    "inc": lambda v: [str(n + 1) for n in numbers(v)],
    "dec": lambda v: [str(n - 1) for n in numbers(v)],
    "replace": lambda v: v,
}


def shown(t: Tree, i: int) -> bool:
    """Elements without attributes, contents and children aren't printed."""
    return bool(t.attrs[i] or t.contents[i] or t.ends[i] > i)


def as_markup(t: Tree, at: int, style: int = 1, attributes: bool = True) -> str:
    """An element's source: 1 in one line, 2 a line for each tag, 3 and 4 indented (from one
    step, from none), 5 with a line for each attribute."""
    out: list[str] = []

    def put(i: int, depth: int) -> None:
        if not shown(t, i):
            return
        pad, end = ("  " * depth if style > 2 else ""), ("\n" if style > 1 else "")
        attrs = ""
        if attributes and t.attrs[i]:
            own = [f'{k}="{html.escape(v)}"' for k, v in t.attrs[i].items()]
            attrs = "".join(f"\n{pad} {x}" for x in own) + f"\n{pad}" if style == 5 else " " + " ".join(own)
        head = f"{pad}<{t.names[i]}{attrs}"
        if t.contents[i]:
            out.append(f"{head}>{html.escape(t.contents[i], quote=False)}</{t.names[i]}>{end}")
        elif t.ends[i] == i:
            out.append(f"{head}/>{end}")
        else:
            out.append(f"{head}>{end}")
            for c in t.children(i):
                put(c, depth + 1)
            out.append(f"{pad}</{t.names[i]}>{end}")

    put(at, 1 if style == 3 else 0)
    return "".join(out)


def as_notation(t: Tree, at: int, json: bool = False) -> str:
    """An element as text ASN.1 or, with json, as a JSON-like text. In names a leading
    underscore leaves the name out (an array in JSON), a trailing one leaves the value
    unquoted, others become spaces."""
    lines: list[str] = []

    def put(i: int, depth: int, comma: str) -> None:
        if not shown(t, i):
            return
        name, quote, pad = t.names[i], '"', "  " * depth
        array = name != "_" and name.startswith("_")
        show = name != "_" and (json or not array)
        if show and not array and name.endswith("_"):
            name, quote = name[:-1], ""
        name = name.replace("_", " ").strip()
        if t.contents[i]:
            value = t.contents[i] if json else t.contents[i].replace('"', "'")
            key = f'"{name}": ' if json else f"{name} "
            lines.append(f"{pad}{key}{quote}{value}{quote}{comma}")
            return
        key = (f'"{name}": ' if show and depth else "") if json else (f"{name} " if show else "") + ("" if depth else "::= ")
        a, b = ("[", "]") if json and array else ("{", "}")
        lines.append(f"{pad}{key}{a}")
        own = t.children(i)
        for c in own:
            put(c, depth + 1, "," if c != own[-1] else "")
        lines.append(f"{pad}{b}{comma}")

    put(at, 0, "")
    return "\n".join(lines)


def plain(x: str) -> str:
    return x.replace(",", "").replace(";", "").rstrip(".?:")


def bag(x: str) -> list[str]:
    return sorted(re.findall(r"[^\W_]+", x))


#: What a position keeps of the visits.
POSITIONS: dict[str, Callable[[list], list]] = {
    "first": lambda v: v[:1],
    "last": lambda v: v[-1:],
    "outer": lambda v: v[:1] + v[1:][-1:],
    "inner": lambda v: v[1:-1],
    "even": lambda v: v[1::2],
    "odd": lambda v: v[::2],
}
#: Tests of a value against a text, both in upper case.
TEXT_TESTS: dict[str, Callable[[str, str], bool]] = {
    "equals": lambda x, c: x == c,
    "contains": lambda x, c: c in x,
    "includes": lambda x, c: f" {c} " in f" {x} ",
    "is-within": lambda x, c: x in c,
    "starts-with": lambda x, c: x.startswith(c),
    "ends-with": lambda x, c: x.endswith(c),
    "is-not": lambda x, c: x != c,
    "is-before": lambda x, c: x.encode() < c.encode(),
    "is-after": lambda x, c: x.encode() > c.encode(),
    "matches": lambda x, c: plain(x) == plain(c),
    "resembles": lambda x, c: bag(x) == bag(c),
}


class Run:
    """One record under a program."""

    def __init__(self, text: str, void: frozenset[str]):
        self.text, self.void = text, void
        self.tree = tree_of(text, void)
        self.bare: Tree | None = None
        self.variables: dict[str, str] = {}
        self.out: list[str] = []

    def bound(self, text: str) -> int | None:
        """A number, or a variable with an offset: &A+1."""
        m = re.fullmatch(r"&(\w+)([+-]\d+)?", text)
        if not m:
            return whole(text)
        value = whole(self.variables.get(m[1], ""))
        return None if value is None else value + int(m[2] or 0)

    def cut(self, s: Selector, value: str) -> str | None:
        """The part of a value that a range selects; None if it doesn't fit."""
        if s.after or s.before:
            low = value.upper()
            begin = low.find(s.after.upper()) if s.after else 0
            if begin < 0:
                return None
            begin += len(s.after)
            end = low.find(s.before.upper(), begin) if s.before else len(value)
            return None if end < 0 else value[begin:end]
        if not (s.low or s.high):
            return value
        data = value.encode()
        low = self.bound(s.low) if s.low else 1
        high = self.bound(s.high) if s.high else len(data)
        if low is None or high is None:
            return None
        if high < 0:
            high += len(data)
        return data[low - 1 : high].decode(errors="replace") if 1 <= low <= high <= len(data) else None

    def values(self, item: str, at: int, index: int, level: int, raw: bool = False) -> list[str]:
        """What one selector gives at an element."""
        t = self.tree
        if item == "+":
            return [str(index)]
        if item == "?":
            return [t.names[at]]
        if item == "~":
            return [t.contents[at]] if t.contents[at] else []
        if item == "$":
            return [t.names[c] for c in t.children(at)]
        if item == "@":
            return list(t.attrs[at])
        if item in (".", "%"):
            return [x] if (x := as_notation(t, at, item == "%")) else []
        if item.startswith("*") and re.fullmatch(r"\*+@?", item):
            return [x] if (x := as_markup(t, at, min(item.count("*"), 5), "@" not in item)) else []
        if item.startswith("&"):
            m = re.fullmatch(r"&(\w+)(\[.*\])?", item)
            if not m or m[1] not in self.variables:
                return []
            s = Selector.parse("x" + (m[2] or ""))
            return [x] if (x := self.cut(s, self.variables[m[1]])) is not None else []
        s = Selector.parse(item)
        if s.prefix == "^":
            return [str(level)] * len(gathered(t, at, s))
        if raw and self.bare is None:
            self.bare = tree_of(self.text, self.void, raw=True)
        found = gathered(self.bare if raw else t, at, s)
        return [x for v in found if (x := self.cut(s, v)) is not None]

    def items(self, selector: str, at: int, index: int, level: int, raw: bool = False) -> list[str]:
        """'A,B' gives A's values, then B's. Commas inside a range don't part selectors."""
        return [v for part in parted(selector) for v in self.values(part, at, index, level, raw)]

    def there(self, selector: str, at: int) -> bool:
        """Is an object there, with contents or not?"""
        if selector.startswith("&"):
            return selector[1:] in self.variables
        s = Selector.parse(selector)
        if s.attr:
            return bool(gathered(self.tree, at, s))
        return gathered(self.tree, at, Selector("#", s.parent, s.name))[0] != "0"

    def test(self, condition: tuple[str, str, str, str], at: int, index: int, level: int) -> bool:
        _, selector, test, right = condition
        if not test:
            return any(map(self.there, selector.split(","), [at] * len(selector)))
        left = self.items(selector, at, index, level)
        if test in ("gt", "ge", "lt", "le", "eq", "ne"):
            other = whole(right)
            if other is None:
                found = numbers(self.items(right, at, index, level))
                if not found:
                    return False
                other = found[-1]
            f = {"gt": int.__gt__, "ge": int.__ge__, "lt": int.__lt__, "le": int.__le__, "eq": int.__eq__, "ne": int.__ne__}[test]
            return any(f(n, other) for n in numbers(left))
        if test in ("is-equal-to", "differs-from"):
            other = self.items(right, at, index, level)[-1:]
            return bool(other) and any((x.upper() == other[0].upper()) == (test == "is-equal-to") for x in left)
        c = right.upper()
        f = TEXT_TESTS[test]
        return any(f(x.upper(), c) for x in left)

    def passes(self, conditions: list[tuple[str, str, str, str]], at: int, index: int, level: int) -> bool:
        """-if with -and and -or counts hits against what is required; after -unless any hit rejects."""
        if not conditions:
            return True
        hits = [self.test(c, at, index, level) for c in conditions]
        if conditions[0][0] == "unless":
            return not any(hits)
        return sum(hits) >= 1 + sum(c[0] == "and" for c in conditions)

    def commands(self, commands: list[Command], at: int, tab: str, ret: str, index: int, level: int) -> tuple[str, str]:
        col, line, sep = "\t", "\n", "\t"
        pfx = sfx = plg = elg = default = pattern = by = last = ""
        escaped = False

        def text_of(name: str, selector: str) -> str | None:
            values = self.items(selector, at, index, level, name == "raw")
            if name in ("num",):
                values = [str(len(self.items(p, at, index, level)) if p.startswith(("&", "#", "%", "^")) else int(gathered(self.tree, at, Selector("#", q.parent, q.name))[0])) for p in selector.split(",") for q in [Selector.parse(p.lstrip("#"))]]
            elif name == "replace":
                values = [re.sub(pattern, by, v) for v in values]
            else:
                values = VALUES[name](values)
            if escaped and name != "encode":
                values = [v if re.fullmatch(r"\*+@?", selector) else escape(v) for v in values]
            if not values:
                return pfx + default + sfx if default else None
            return pfx + sep.join(values) + sfx

        for c in commands:
            if c.name in VALUES:
                text = text_of(c.name, c.value)
                if text is not None:
                    self.out += [tab, plg, text]
                    plg, last, tab, ret = "", elg, col, line
            elif c.name in ("lbl", "tag"):
                escaped = escaped or c.name == "tag"
                self.out += [tab, plg, pfx, c.value, sfx]
                plg, last, tab, ret = "", elg, col, line
            elif c.name in ("set", "append"):
                value = c.other
                if len(value) > 1 and value[0] == "(" and value[-1] == ")":
                    self.variables[c.value] = value[1:-1]
                elif not value:
                    self.variables.pop(c.value, None)
                elif (text := text_of("element", value)) is not None:
                    held = self.variables.get(c.value, "")
                    self.variables[c.value] = held + sep + plg + text if c.name == "append" and held else plg + text
                    plg, last = "", elg
            elif c.name == "tab":
                col = c.value
            elif c.name == "ret":
                line = c.value
            elif c.name == "sep":
                sep = c.value
            elif c.name == "pfx":
                pfx = c.value
            elif c.name == "pfc":
                pfx, tab = c.value, ""
            elif c.name == "sfx":
                sfx = c.value
            elif c.name == "clr":
                tab = ""
            elif c.name == "deq":
                tab = c.value
            elif c.name == "plg":
                plg = c.value
            elif c.name == "elg":
                elg = c.value
            elif c.name == "def":
                default = c.value
            elif c.name == "reg":
                pattern = c.value
            elif c.name == "exp":
                by = re.sub(r"\$\{?(\d+)\}?", r"\\\1", c.value)
            elif c.name == "rst":
                pfx = sfx = plg = elg = default = ""
                sep, escaped = "\t", False
            elif c.name == "wrp" and c.value in ("", "-"):
                pfx = sfx = plg = elg = ""
                sep, escaped = "\t", False
            elif c.name == "wrp" and "," in c.value:
                outer, _, inner = c.value.rpartition(",")
                if outer:
                    plg, elg = f"<{outer}>", f"</{outer}>"
                if inner not in ("", "-"):
                    pfx, sfx = f"<{inner}>", f"</{inner}>"
                    sep = sfx + pfx
                escaped = True
            elif c.name == "wrp":
                pfx, sfx = nested(self.variables.get(c.value[1:], "") if c.value.startswith("&") else c.value)
                sep, escaped = sfx + pfx, True
            elif c.name == "enc":
                tags = self.variables.get(c.value[1:], "") if c.value.startswith("&") else c.value
                plg, elg = nested(tags) if tags not in ("", "-") else ("", "")
        self.out.append(last)
        return tab, ret

    def scope(self, s: Scope, at: int, tab: str, ret: str, level: int, index: int | None = None) -> tuple[str, str]:
        """index: of the record, for the outermost scope."""
        held = [at] if index is not None else visits(self.tree, at, s.path)
        numbered = list(enumerate(held, 1 if index is None else index))
        if s.position in POSITIONS:
            numbered = POSITIONS[s.position](numbered)
        elif s.position not in ("all", "", "path", "select"):
            n = int(s.position)
            numbered = numbered[n - 1 : n] if n > 0 else []
        self.out.append(s.before)
        for i, v in numbered:
            depth = level + self.tree.depths[v] - self.tree.depths[at]
            if self.passes(s.conditions, v, i, depth):
                if s.commands:
                    tab, ret = self.commands(s.commands, v, tab, ret, i, depth)
                for inner in s.inner:
                    tab, ret = self.scope(inner, v, tab, ret, depth)
            elif s.failure:
                tab, ret = self.commands(s.failure, v, tab, ret, i, depth)
        self.out.append(s.after)
        return tab, ret

    def printed(self, program: Scope, index: int) -> str:
        """All output of the record; empty if there is none."""
        if not self.tree.names:
            return ""
        if program.position == "select":
            return self.text + "\n" if self.passes(program.conditions, 0, index, 1) else ""
        _, ret = self.scope(program, 0, "", "", 1, index)
        text = "".join(self.out) + ret
        return text[1:] if text.startswith("\n") else text


def run(records: DataFrame, arguments: list[str], head: str = "", tail: str = "", rec_id: str = "rec_id", text: str = "xml", html_void: bool = False) -> DataFrame:
    """(rec_id, out): what a program prints for each record, without records that print
    nothing. head and tail go around each. The index of a record in selectors is its rec_id.
    Null texts print nothing."""
    program = parse(arguments)
    void = VOID if html_void else frozenset()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                printed = Run(x, void).printed(program, r) if x else ""
                if printed:
                    ids.append(r)
                    out.append(head + printed + tail)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["rec_id", "out"])

    return records.select(F.col(rec_id).cast("long").alias("rec_id"), F.col(text).alias("xml")).mapInArrow(go, "rec_id long, out string")


def silent(records: DataFrame, arguments: list[str], rec_id: str = "rec_id", text: str = "xml") -> DataFrame:
    """(rec_id) of the records that print nothing."""
    printed = run(records, arguments, rec_id=rec_id, text=text)
    return records.select(F.col(rec_id).cast("long").alias("rec_id")).join(printed, "rec_id", "left_anti")


def document(printed: DataFrame, head: str, tail: str) -> DataFrame:
    """(part, rec_id, out): the output between a head (part 0) and a tail (part 2), without
    both if there is none."""
    body = printed.select(F.lit(1).alias("part"), "rec_id", "out")
    some = printed.limit(1)
    ends = [some.select(F.lit(n).alias("part"), F.lit(None).cast("long").alias("rec_id"), F.lit(x).alias("out")) for n, x in ((0, head), (2, tail)) if x]
    for e in ends:
        body = body.union(e)
    return body
