"""Symbols of Java, JavaScript, TypeScript and Go with their lines, by a scan over brackets.

A lexer takes strings, comments, template literals and regular expressions out of the way and
leaves names, numbers and brackets with their places.  Brackets are matched on a stack; a brace
whose head declares a class, an interface, a function or a method is a symbol whose body ends at
the matching brace.  Symbols nest: each knows the names of those around it.

The scan is one pass over a text with a stack as deep as its nesting, run by Spark on batches of
files.  A text that stops inside a body ends its open symbols at its last line; unmatched closing
brackets are passed over.  Null and empty texts, and other languages, have no symbols.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOL = "array<struct<kind:string,name:string,line_start:int,line_end:int,hierarchy:array<string>,content:string>>"
LANGUAGES = ("java", "javascript", "typescript", "go")

#: Words that head a block but name no method.
CONTROL = frozenset("if for while switch catch synchronized try with function return new".split())
#: What joins a line to the one before where line ends can end statements.
JOINING = frozenset([*"{.,)]?:=&|+-*/<>;", "extends", "implements"])
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new await yield".split())

_NAME = re.compile(r"[^\W\d][\w$]*|[$#@][\w$]+")
_NUMBER = re.compile(r"\d[\w.]*")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_STRING = {q: re.compile(rf"{q}(?:\\[\s\S]|[^{q}\\\n])*(?:{q}|\\?(?=\n)|\\?\Z)") for q in "\"'"}


class Token(NamedTuple):
    text: str
    at: int


class Symbol(NamedTuple):
    kind: str
    name: str
    start: int
    end: int
    around: tuple[str, ...]


def _template_end(text: str, at: int) -> int:
    """The place after a template literal; what stands in its ``${ }`` may hold literals again."""
    open_, k = [-1], at + 1  # -1 for a literal, the number of open braces for a ``${ }``
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 1
        elif open_[-1] < 0:
            if c == "`":
                open_.pop()
                if not open_:
                    return k + 1
            elif text.startswith("${", k):
                open_.append(1)
                k += 1
        elif c == "`":
            open_.append(-1)
        elif c in "\"'":
            k = _STRING[c].match(text, k).end() - 1
        elif c in "{}":
            open_[-1] += 1 if c == "{" else -1
            if not open_[-1]:
                open_.pop()
        k += 1
    return len(text)


def tokens(text: str, language: str) -> Iterator[Token]:
    """Names, numbers and single signs outside of strings and comments; line ends too where they can end a statement."""
    k, last, script = 0, "", language in ("javascript", "typescript")
    while k < len(text):
        c = text[k]
        if c.isspace():
            if c == "\n" and language != "java" and last:
                yield Token(c, k)
            k += 1
            continue
        if text.startswith("//", k):
            end = text.find("\n", k)
            k = len(text) if end < 0 else end
            continue
        if text.startswith("/*", k):
            end = text.find("*/", k + 2)
            k = len(text) if end < 0 else end + 2
            continue
        if text.startswith('"""', k) and language == "java":
            end = text.find('"""', k + 3)
            k, last = (len(text) if end < 0 else end + 3), '"'
            continue
        if c in "\"'":
            k, last = _STRING[c].match(text, k).end(), c
            continue
        if c == "`" and language != "java":
            end = text.find("`", k + 1)
            k, last = (_template_end(text, k) if script else len(text) if end < 0 else end + 1), c
            continue
        if c == "/" and script and (not last or last in BEFORE_REGEX or last in "(,=:[!&|?{};+-*%<>~^") and (m := _REGEX.match(text, k)):
            k, last = m.end(), "/"
            continue
        found = _NAME.match(text, k) or _NUMBER.match(text, k)
        word = found[0] if found else c
        yield Token(word, k)
        k, last = k + len(word), word


def _is_name(word: str) -> bool:
    return bool(_NAME.fullmatch(word)) and not word.startswith("@")


def _without_groups(head: list[Token]) -> tuple[list[Token], list[int]]:
    """The head without what stands in round and square brackets, and after which of its tokens a round group came."""
    out, groups, depth = [], [], 0
    for t in head:
        if t.text in "([":
            if not depth and t.text == "(":
                groups.append(len(out))
            depth += 1
        elif t.text in ")]":
            depth = max(0, depth - 1)
        elif not depth:
            out.append(t)
    return out, groups


def declared(head: list[Token], language: str, within: str | None) -> tuple[str, str, int] | None:
    """(kind, name, start) of what a block's head declares; ``within`` is the kind of the block around it."""
    plain, groups = _without_groups(head)
    words = [t.text for t in plain]
    start = next((t.at for t in head), 0)
    if language == "go":
        if words[:1] == ["type"] and len(words) > 2 and words[-1] in ("struct", "interface"):
            return ("interface" if words[-1] == "interface" else "class"), words[1], start
        if words[:1] == ["func"] and groups:
            name = next((w for w in words[1:] if _is_name(w)), None)
            named_first = name is not None and groups and (groups[0] >= 2 or len(groups) > 1)
            return ("function", name, start) if named_first else None
        return None
    for k, word in enumerate(words):
        kind = {"class": "class", "interface": "interface", "enum": "class", "record": "class"}.get(word)
        if kind == "class" and word in ("enum", "record") and language == "javascript":
            continue
        if kind and k + 1 < len(words) and _is_name(words[k + 1]) and words[k + 1] not in ("extends", "implements") and (k == 0 or words[k - 1] not in (".", "=", "new")):
            return kind, words[k + 1], start
        if word == "function" and language != "java":
            name = next((w for w in words[k + 1 : k + 3] if _is_name(w)), None)
            return ("function", name, start) if name else None
    if within in ("class", "interface") and groups and "=" not in words:
        at = groups[0]
        while at > 0 and words[at - 1] == "@":
            at -= 1
        name = words[at - 1] if 0 < at <= len(words) else None
        if name and _is_name(name) and name not in CONTROL and (at < 2 or words[at - 2] != "."):
            return "function", name, start
    return None


def _head(recent: list[Token]) -> list[Token]:
    """The tokens of a declaration without the annotations before it and their arguments."""
    k = 0
    while k < len(recent) and recent[k].text.startswith("@"):
        k += 1
        while k + 1 < len(recent) and recent[k].text == ".":
            k += 2
        if k < len(recent) and recent[k].text == "(":
            depth = 0
            while k < len(recent):
                depth += {"(": 1, ")": -1}.get(recent[k].text, 0)
                k += 1
                if not depth:
                    break
    return recent[k:]


def _goes_on(last: str, language: str, recent: list[Token]) -> bool:
    """Whether a brace after ``last`` opens a type or a value inside a head, which goes on after it."""
    if language == "go":
        return last in ("struct", "interface") and recent[0].text != "type"
    return language != "java" and last in ("<", ":", ",", "|", "&", "(", "[")


def symbols(text: str | None, language: str | None) -> list[Symbol]:
    """All symbols in the order of their starts; the places are those of the first and after the last character."""
    if not text or language not in LANGUAGES:
        return []
    out, stack, recent, depth, broken = [], [], [], 0, False
    for t in tokens(text, language):
        if t.text == "\n":
            broken = True
            continue
        if broken and not depth and t.text not in JOINING:
            recent = []
        broken = False
        if t.text == "{":
            inside = depth > 0 or (bool(recent) and _goes_on(recent[-1].text, language, recent))
            within = "block" if stack and not stack[-1][0] else stack[-1][0].kind if stack else None
            found = None if inside else declared(_head(recent), language, within)
            symbol = Symbol(*found, len(text), tuple(s[0].name for s in stack if s[0])) if found else None
            if symbol:
                out.append(symbol)
            stack.append((symbol, len(out) - 1, depth, [*recent, t] if inside else []))
            recent, depth = [], 0
        elif t.text == "}":
            if stack:
                symbol, k, depth, recent = stack.pop()
                if symbol:
                    out[k] = symbol._replace(end=t.at + 1)
        elif t.text == ";" and not depth:
            recent = []
        else:
            depth = max(0, depth + {"(": 1, ")": -1}.get(t.text, 0))
            recent.append(t)
    return out


def _rows(texts: pd.Series, languages: pd.Series) -> pd.Series:
    out = []
    for text, language in zip(texts, languages, strict=True):
        found = symbols(text, language)
        breaks = [k for k, c in enumerate(text) if c == "\n"] if found else []
        line = lambda at, b=breaks: 1 + bisect.bisect_left(b, at)
        out.append([{"kind": s.kind, "name": s.name, "line_start": line(s.start), "line_end": line(s.end - 1), "hierarchy": [*s.around, s.name], "content": text[s.start : s.end]} for s in found])
    return pd.Series(out)


def symbol_list(text: Column, language: Column) -> Column:
    """The symbols of a text as an array of structs."""
    return F.pandas_udf(_rows, SYMBOL)(text, language)


def symbol_rows(files: DataFrame, key: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """One row for each symbol of files (keys, language, text): kind, name, lines, hierarchy and content, with ``symbol_idx``."""
    found = files.filter(F.col("language").isin(*LANGUAGES)).select(*key, "language", symbol_list(F.col("text"), F.col("language")).alias("symbols"))
    return found.select(*key, "language", F.posexplode("symbols").alias("symbol_idx", "s")).select(*key, "language", "symbol_idx", "s.*")
