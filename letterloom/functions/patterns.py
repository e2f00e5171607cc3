"""Regular expressions of the search: which are taken, and what every match of one must hold.

Taken are letters and signs, ``.``, classes such as ``[a-z]`` and ``[^0-9]``, groups, ``|``, the quantifiers ``* + ? {m,n}``,
``\\d \\w \\s`` and their opposites, signs after a backslash, and ``^`` and ``$`` at the ends, which change nothing.
"""

from __future__ import annotations

import re

MOST_REPEATS = 1000
_CLASS = re.compile(r"\[\^?(?:\\[dDwWsS\W_]|[^\[\]\\&^](?:-[^\[\]\\&^])?|(?<=.)\^)+\]")
_RANGE = re.compile(r"([^\[\]\\&^])-([^\[\]\\&^])")
_COUNT = re.compile(r"\{(\d+)(,(\d*))?\}")


def read_pattern(pattern: str) -> tuple[str | None, list[str]]:
    """Why a pattern is not taken (None if it is), and the literal runs that every matching word holds: ``^`` starts the
    run that a word starts with, ``$`` ends the one it ends with."""
    held: list[str | None] = ["^"]  # None parts two runs
    depth = at = 0
    # whether an atom stands before, and whether it is a letter of a run
    atom = letter = either = False
    end = len(pattern) - 1 if pattern.endswith("$") and not pattern.endswith("\\$") else len(pattern)
    if pattern.startswith("^"):
        at = 1
    while at < end:
        c, step = pattern[at], 1
        if c in "*+?{":
            count = _COUNT.match(pattern, at) if c == "{" else None
            if c == "{" and not count:
                return f"a brace at {at} is no count", []
            if not atom:
                return f"nothing to repeat at {at}", []
            least = int(count[1]) if count else int(c == "+")
            if count:
                step = len(count[0])
                most = int(count[3]) if count[3] else least
                if not least <= most <= MOST_REPEATS:
                    return f"a count of {least} to {most} at {at}", []
            if at + step < end and pattern[at + step] in "?+":
                step += 1
            if letter and not least:
                held.pop()
            held.append(None)
            atom = letter = False
        elif c == "|":
            either = either or not depth
            atom = letter = False
        elif c == "(":
            if pattern[at + 1 : at + 2] == "?" and pattern[at + 1 : at + 3] != "?:":
                return f"a group of an unknown kind at {at}", []
            step = 3 if pattern[at + 1 : at + 3] == "?:" else 1
            depth += 1
            held.append(None)
            atom = letter = False
        elif c == ")":
            if not depth:
                return f"a bracket closes nothing at {at}", []
            depth -= 1
            held.append(None)
            atom, letter = True, False
        elif c == "[":
            found = _CLASS.match(pattern, at)
            if not found or "-\\" in found[0] or any(a > b for a, b in _RANGE.findall(found[0])):
                return f"a class is wrong at {at}", []
            step = len(found[0])
            held.append(None)
            atom, letter = True, False
        elif c == "\\":
            sign = pattern[at + 1 : min(at + 2, end)]
            if not sign or (sign not in "dDwWsS" and (sign.isalnum() or ord(sign) > 127)):
                return f"nothing known follows the backslash at {at}", []
            step = 2
            held.append(None)
            atom, letter = True, False
        elif c in "^$]}":
            return f"{c} stands alone at {at}", []
        else:
            letter = not depth and c.isalnum()
            held.append(c if letter else None)
            atom = True
        at += step
    if depth:
        return "a bracket is not closed", []
    if either:
        return None, []
    runs: list[str] = [""]
    for c in [*held, "$"]:
        if c is None:
            runs.append("")
        else:
            runs[-1] += c
    return None, [r for r in runs if r]
