"""Rule patterns are written in Python's regex dialect; Spark runs Java's."""

from __future__ import annotations

import re

from tripline.functions.text import FLAGS

# Separators that Python's \s takes as white space and Java's does not.
_MORE_SPACE = r"\x1c-\x1f"

_TOKEN = re.compile(
    r"""
      \\(?P<escape>[\s\S])                     # an escaped character
    | \(\?P<(?P<name>\w+)>                     # a named group
    | \(\?P=(?P<backref>\w+)\)                 # a reference to one
    | (?P<conditional>\(\?\(\w+\))             # (?(group)yes|no)
    | \(\?(?P<flags>[aiLmsux]+)(?P<scope>[):-])  # inline flags
    | \{,(?P<upto>\d+)\}
    | (?P<other>[\s\S])
    """,
    re.VERBOSE,
)


def java_pattern(pattern: str) -> str:
    """The same pattern for ``rlike``; forms Java lacks raise ValueError."""
    out, in_class, class_start = [FLAGS], False, False
    for token in _TOKEN.finditer(pattern):
        text = token.group(0)
        if in_class:
            text, in_class = _inside_class(token, text, class_start)
            class_start = class_start and text == "^"
        elif token["escape"]:
            text = _escape(token["escape"])
        elif token["name"]:
            text = f"(?<{_group(token['name'])}>"
        elif token["backref"]:
            text = rf"\k<{_group(token['backref'])}>"
        elif token["conditional"]:
            raise ValueError(f"conditional groups are not supported: {pattern!r}")
        elif token["flags"]:
            text = _flags(token["flags"], token["scope"], pattern)
        elif token["upto"]:
            text = f"{{0,{token['upto']}}}"
        elif text == "[":
            in_class = class_start = True
        out.append(text)
    return "".join(out)


def _inside_class(token: re.Match, text: str, class_start: bool) -> tuple[str, bool]:
    if token["escape"]:
        return (rf"\s{_MORE_SPACE}" if text == r"\s" else text), True
    if len(text) > 1:  # a group-like token is plain characters here
        return re.sub(r"([\[\]&])", r"\\\1", text), True
    if text == "]" and not class_start:
        return text, False
    # Java gives '[' and '&&' a meaning inside classes; Python does not.
    return (f"\\{text}" if text in "[]&" else text), True


def _escape(char: str) -> str:
    return {
        "s": rf"[\s{_MORE_SPACE}]",
        "S": rf"[^\s{_MORE_SPACE}]",
        "Z": r"\z",
    }.get(char, f"\\{char}")


def _flags(flags: str, scope: str, pattern: str) -> str:
    if set(flags) & {"a", "L"}:
        raise ValueError(f"byte and ASCII matching are not supported: {pattern!r}")
    kept = flags.replace("u", "")
    if not kept:
        return "(?:" if scope == ":" else ("(?-" if scope == "-" else "")
    return f"(?{kept}{scope}"


def _group(name: str) -> str:
    # Java group names take no underscore.
    return "g" + name.encode("utf-8").hex()
