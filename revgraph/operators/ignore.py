"""Ignore rules: parsed on the driver (a rule file is small), evaluated as one expression.

A rule is the word a line begins with. `!` negates, a final slash restricts to directories, any other slash makes the rule see the whole path
instead of the name. The last rule that matches decides; where none does, the answer is null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from revgraph.functions.text import file_name


@dataclass(frozen=True)
class Rule:
    pattern: str
    negative: bool = False
    directory: bool = False
    full_path: bool = False
    wildcard: bool = False
    everything: bool = False


def parse_line(line: str) -> Rule | None:
    found = re.match(r"\s*(\S*)", line)
    word = found[1] if found else ""
    if not word or word[0] == "#":
        return None
    if line.strip() in ("*", "."):
        return Rule("", everything=True)
    negative = word[0] == "!"
    word = word[negative:]
    directory = len(word) > 1 and word.endswith("/")
    slashes = word.count("/")
    pattern = word[:-1] if directory else word
    pattern = pattern[1:] if pattern.startswith("/") else pattern
    if not pattern:
        return None
    return Rule(pattern, negative, directory, slashes > directory, "*" in pattern or "?" in pattern)


def parse(text: str) -> list[Rule]:
    return [rule for line in text.split("\n") if (rule := parse_line(line))]


def glob_regex(pattern: str, by_name: bool) -> str:
    """by_name: stars don't cross slashes, but a double star stands for any directories."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if by_name and pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            inner = pattern[k + 1 : end]
            out, k = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, k = out + {"*": "[^/]*" if by_name else ".*", "?": "[^/]" if by_name else "."}.get(c, re.escape(c)), k + 1
    return f"(?s)^{out}$"


def wildcard(text: Column, pattern: str, by_name: bool = True, fold: bool = False) -> Column:
    return text.rlike(("(?iu)" if fold else "") + glob_regex(pattern, by_name))


def ignored(path: Column, is_dir: Column, rules: list[Rule]) -> Column:
    """true, false or null."""

    def hit(rule: Rule) -> Column:
        if rule.everything:
            return F.lit(True)
        text = path if rule.full_path else file_name(path)
        match = text == rule.pattern
        if rule.wildcard:
            match = match | F.when(is_dir, wildcard(text, rule.pattern)).otherwise(wildcard(text, rule.pattern, by_name=False))
        return match & is_dir if rule.directory else match

    if not rules:
        return F.lit(None).cast("boolean")
    chain = reduce(lambda e, r: e.when(hit(r), not r.negative), reversed(rules), F.when(path == "", F.lit(None).cast("boolean")))
    return chain
