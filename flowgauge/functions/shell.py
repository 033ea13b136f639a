"""Shell lines as simple commands, what they are for, and whether they run a check.

One pattern describes the grammar: words with their quoted parts, redirections with their targets, what parts commands,
and the beginnings of here-documents, whose bodies are taken out first. A quote that is never closed is a character like
any other. Each simple command is written again with one blank between words (and BLANK for a blank inside a word), so
that one more pattern can take off what runs another command, and the fixed patterns can be matched at its program's name.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from flowgauge.functions import fixed

#: Stands for a blank inside a word.
BLANK = "\u00b7"
_HERE = re.compile(r"(?P<begin><<-?[ \t]*(?P<quote>['\"]?)(?P<mark>[A-Za-z_]\w*)(?P=quote)[^\n]*\n)(?:.*?\n)??[ \t]*(?P=mark)[ \t]*(?=\n|$)", re.DOTALL)
_WORD = r"(?:'[^']*'|\"(?:[^\"\\]|\\.)*\"|\\.|[^\s;&|()<>'\"\\]|['\"\\])+"
_TOKEN = re.compile(rf"(?P<turn>\d*[<>]+[&|]?[ \t]*(?:{_WORD})?)|(?P<part>[;&|()\n]+)|(?P<word>{_WORD})", re.DOTALL)
_PIECE = re.compile(r"'(?P<plain>[^']*)'|\"(?P<soft>(?:[^\"\\]|\\.)*)\"|\\(?P<one>.)|(?P<bare>[^'\"\\]+|['\"\\])", re.DOTALL)
_DRIVE = re.compile(r"(?<!\w)([A-Za-z]:)((?:\\[^\s'\"\\]*)+)")
_NAMED = r"[A-Za-z_]\w*=\S*"
_FOLDER = r"(?:\S*/)?"
_RUNS = "|".join(map(re.escape, fixed.PREFIXES))
_PAIRS = "|".join(fixed.RUNNERS)
_LEAD = re.compile(rf"(?:{_NAMED} +)*(?:{_FOLDER}(?:(?:{_RUNS})(?: +(?:-\S*|{_NAMED}))*|timeout(?: +-\S+)* +\S+|{_PAIRS})(?: +|$))*")
_PROGRAM = re.compile(r"^(?:\S*[/\\])?(?P<name>\S+?)(?:\.(?i:exe))?(?= |$)")
_MODULE = re.compile(r"^python3? +-m +(?=\S)")
_CHANGE, _VALIDATE, _ADHOC, _EXPLORE = map(re.compile, (fixed.CHANGE, fixed.VALIDATE, fixed.ADHOC_RUN, fixed.EXPLORE))


def _plain(word: str) -> str:
    """A word without its quotes; inside soft quotes a backslash guards quotes and itself alone."""
    pieces = []
    for m in _PIECE.finditer(word):
        soft = m["soft"]
        pieces.append(re.sub(r"\\([\"\\$`])", r"\1", soft) if soft is not None else m["plain"] or m["one"] or m["bare"] or "")
    return re.sub(r"\s", BLANK, "".join(pieces))


def commands(line: str | None) -> list[str]:
    """The simple commands of a line, each from its program's name on."""
    text = _DRIVE.sub(lambda m: m[1] + m[2].replace("\\", "/"), _HERE.sub(lambda m: m["begin"], line or ""))
    found: list[list[str]] = [[]]
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "part":
            found.append([])
        elif m.lastgroup == "word":
            found[-1].append(_plain(m["word"]))
    bare = (_LEAD.sub("", " ".join(words), count=1) for words in found)
    return [_PROGRAM.sub(lambda m: m["name"], c) for c in bare if c]


@lru_cache(maxsize=1 << 14)
def _judge(line: str | None) -> tuple[str, bool]:
    """What a line is for (a change anywhere in it, or else a check, or else what its first command looks at), and whether
    any of its commands is a named check; moving to a folder counts for nothing."""
    all_ = commands(line)
    inner = [_MODULE.sub("", c) for c in all_]
    check = any(map(_VALIDATE.match, all_ + inner))
    acts = [(c, i) for c, i in zip(all_, inner) if c.partition(" ")[0] != "cd"]
    if not acts:
        return "other", check
    if any(_CHANGE.match(i) for _, i in acts):
        return "change", check
    if any(p.match(x) for pair in acts for x in pair for p in (_VALIDATE, _ADHOC)):
        return "validate", check
    return "explore" if _EXPLORE.match(acts[0][0]) else "other", check


@pandas_udf(T.ArrayType(T.StringType()))
def simple_commands(line: pd.Series) -> pd.Series:
    """The simple commands of a shell line, each from its program's name on."""
    return line.map(commands)


@pandas_udf(T.StringType())
def shell_intent(line: pd.Series) -> pd.Series:
    """change, validate, explore or other."""
    return line.map(lambda x: _judge(x)[0])


@pandas_udf(T.BooleanType())
def runs_check(line: pd.Series) -> pd.Series:
    """Whether any simple command of the line runs a named check tool, whatever else the line does."""
    return line.map(lambda x: _judge(x)[1])
