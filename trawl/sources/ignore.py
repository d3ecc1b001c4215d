"""Lines of ignore files, as git reads them."""

from __future__ import annotations

import re
from dataclasses import dataclass


def expression(glob: str) -> str:
    """A regular expression for a glob: ``*`` and ``?`` stay within a folder, ``**`` between slashes does not."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        if glob.startswith("**/", at) and (at == 0 or glob[at - 1] == "/"):
            out.append("(?:.*/)?")
            at += 3
        elif glob[at:] == "**" and at and glob[at - 1] == "/":
            out.append(".+")
            at += 2
        elif c == "*":
            out.append("[^/]*")
            at += 1
        elif c == "?":
            out.append("[^/]")
            at += 1
        elif c == "[" and (end := glob.find("]", at + 2)) > 0:
            body = glob[at + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            at = end + 1
        else:
            at += c == "\\" and at + 1 < len(glob)
            out.append(re.escape(glob[at]))
            at += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    """One line: where it holds (a folder, relative, with its slash), what it matches, and what it means."""

    base: str
    pattern: re.Pattern
    back: bool
    folders: bool


def parse(text: str, base: str = "") -> list[Rule]:
    """The rules of an ignore file in the folder ``base`` (relative, empty or with a slash at its end)."""
    found = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+\Z", "", line)
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        line = line[back:]
        folders, line = line.endswith("/"), line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = expression(line.lstrip("/"))
        found.append(Rule(base, re.compile(body if anchored else f"(?:.*/)?{body}"), back, folders))
    return found


def is_ignored(path: str, folder: bool, rules: list[Rule]) -> bool:
    """Whether a path is ignored; of the rules that match, the last one counts. A folder's members have to be asked only if it is not."""
    for rule in reversed(rules):
        if path.startswith(rule.base) and (folder or not rule.folders) and rule.pattern.fullmatch(path[len(rule.base) :]):
            return not rule.back
    return False
