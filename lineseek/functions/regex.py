"""Regular expressions: accept Python spelling, run on the JVM.

``rlike`` keeps regex search inside the scan stage. The two dialects agree on
nearly everything; the differences that change answers are mapped here.
"""

from __future__ import annotations

import re
import unicodedata

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Inline flags that make java.util.regex behave like Python's re
# on str: U = Unicode classes, d = only \n ends a line; i/u = ignore case.
BASE_FLAGS = "(?Ud)"
FOLD_FLAGS = "(?Udiu)"

_TOKEN = re.compile(
    r"""(?P<code>\\U[0-9a-fA-F]{8}|\\N\{[^}]*\}|\\0[0-7]{0,2}|\\[0-3][0-7]{2})  # a character by number or name
      | (?P<esc>\\.)              # another escaped character
      | (?P<flags>\(\?[a-zA-Z]*[aLu][a-zA-Z]*(?P<flagend>[:)]))  # flags that Java spells otherwise
      | (?P<def>\(\?P<(?P<name>\w+)>)   # named group
      | (?P<ref>\(\?P=(?P<back>\w+)\))  # named back reference
      | (?P<low>\{,(?P<max>\d+)\})      # open lower bound
      | (?P<any>.)""",
    re.VERBOSE | re.DOTALL,
)


def _character(token: str) -> str:
    """The escape of one character, given by number or name, in Java's spelling."""
    if token[1] == "U":
        code = int(token[2:], 16)
    elif token[1] == "N":
        code = ord(unicodedata.lookup(token[3:-1]))
    else:
        code = int(token[1:], 8)
    return f"\\x{{{code:X}}}"


def to_jvm(pattern: str, ignore_case: bool = False) -> str:
    """Spell a Python pattern for ``rlike``. Class escapes keep their case."""
    ascii_only = re.match(r"\(\?[a-zA-Z]*a[a-zA-Z]*\)", pattern) is not None
    names: dict[str, str] = {}

    def group(name: str) -> str:
        return names.setdefault(name, f"g{len(names)}x{re.sub('[^A-Za-z0-9]', '', name)}")

    out, in_class, class_start = [], False, -1
    for tok in _TOKEN.finditer(pattern):
        text = tok.group()
        if tok["flags"] and in_class:
            out.append("".join("\\" + c if c in "[]&" else c for c in text))
        elif tok["code"]:
            out.append(_character(text))
        elif tok["esc"]:
            if text == r"\v":  # one character in Python, any vertical space in Java
                text = r"\x0B"
            elif in_class and text == r"\b":
                text = r"\x08"
            elif in_class and text[1] in "1234567":
                text = _character(text)
            out.append(r"\z" if text == r"\Z" and not in_class else text)
        elif in_class:
            first = tok.start() == class_start or (
                tok.start() == class_start + 1 and pattern[class_start] == "^"
            )
            if text == "]" and not first:
                in_class = False
                out.append(text)
            else:
                # Java reads [ and && inside a class as set operators
                out.append("".join("\\" + c if c in "[]&" else c for c in text))
        elif tok["flags"]:
            kept = re.sub("[auL]", "", text[2:-1])
            off = "-U" if "a" in text and tok["flagend"] == ":" else ""
            out.append(f"(?{kept}{off}{tok['flagend']}" if kept or off or tok["flagend"] == ":" else "")
        elif text == "[":
            in_class, class_start = True, tok.end()
            out.append(text)
        elif tok["def"]:
            out.append(f"(?<{group(tok['name'])}>")
        elif tok["ref"]:
            out.append(f"\\k<{group(tok['back'])}>")
        elif tok["low"]:
            out.append(f"{{0,{tok['max']}}}")
        else:
            out.append(text)
    flags = FOLD_FLAGS if ignore_case else BASE_FLAGS
    if ascii_only:
        flags = flags.replace("U", "").replace("u", "")
    return flags + "".join(out)


def is_valid(pattern: str) -> bool:
    """Does the pattern compile by Python's rules, and has it a form on the JVM?

    Conditional groups have none and count as invalid.
    """
    try:
        re.compile(pattern)
        to_jvm(pattern)
    except (re.error, OverflowError, RecursionError, KeyError, ValueError):
        return False
    return re.search(r"(?<!\\)(?:\\\\)*\(\?\(", pattern) is None


def runs_on_jvm(spark: SparkSession, translated: str) -> bool:
    """Asks the JVM's own compiler; one bad pattern must not end a scan that serves many."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(translated)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def quoted(literal: str) -> str:
    """A pattern matching exactly this text."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"
