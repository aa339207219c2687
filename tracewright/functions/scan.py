"""Lexical layer: tokens with exact spans, statement splitting, comments, identifier folding.

Offsets are code points, half open.  One master pattern recognises every
lexical form of the supported dialects, so all callers agree on what is quoted.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_LEX = re.compile(
    r"""(?P<ws>\s+)
      |(?P<line>--[^\n]*)
      |(?P<block>/\*)
      |(?P<dollar>\$(?P<tag>[A-Za-z_]\w*|)\$.*?\$(?P=tag)\$)
      |(?P<string>(?:[NnEeBbXxRr]|[Uu]&)?'(?:[^'\\]|''|\\.)*(?:'|\Z))
      |(?P<quoted>"(?:[^"]|"")*(?:"|\Z)|`(?:[^`]|``)*(?:`|\Z)|\[(?=[A-Za-z_][^\]]*\])(?:[^\]]|\]\])*\])
      |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      |(?P<name>[^\W\d][\w$\#]*|[@\#]+\w+)
      |(?P<op>->>|->|\#>>|\#>|@>|<@|\?\||\?&|!~\*|!~|~\*|//|\*\*|:=|=>|::|\|\||<=>|<>|!=|<=|>=|\(\+\)|[^\s])""",
    re.X | re.S,
)
_NEST = re.compile(r"/\*|\*/")


class Token(NamedTuple):
    kind: str  # name quoted string number op comment
    text: str
    start: int
    end: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokens(sql: str, comments: bool = False) -> list[Token]:
    """Tokens of ``sql``; block comments nest; an unclosed quote or comment runs to the end."""
    out, at, after = [], 0, ""
    while at < len(sql):
        m = _LEX.match(sql, at)
        kind, end = m.lastgroup if m.lastgroup != "tag" else "dollar", m.end()
        if kind == "block":
            depth, end = 1, len(sql)
            for x in _NEST.finditer(sql, m.end()):
                depth += 1 if x[0] == "/*" else -1
                if not depth:
                    end = x.end()
                    break
        if kind == "quoted" and sql[at] == "[" and (after in ("name", "quoted") or sql[at - 1 : at] in "])"):
            kind, end = "op", at + 1  # an index, as in a[b]
        if kind in ("line", "block"):
            if comments:
                out.append(Token("comment", sql[at:end], at, end))
        elif kind != "ws":
            out.append(Token({"dollar": "string"}.get(kind, kind), sql[at:end], at, end))
            after = kind if not (kind == "name" and sql[at:end].upper() in ("SELECT", "AS", "FROM", "JOIN", "BY", "ON", "WHERE", "AND", "OR", "INTO", "UPDATE", "TABLE", "SET", "DISTINCT")) else ""
        at = end
    return out


def split_statements(sql: str) -> list[tuple[int, int, str]]:
    """``(start, end, text)`` of each statement between top-level semicolons; blank and comment-only ones are dropped."""
    out, first, last = [], None, 0
    for t in [*tokens(sql), Token("op", ";", len(sql), len(sql))]:
        if t.kind == "op" and t.text == ";":
            if first is not None:
                out.append((first, last, sql[first:last]))
            first = None
        else:
            first, last = t.start if first is None else first, t.end
    return out


def first_comment(sql: str) -> tuple[int, int] | None:
    """Span of the first comment outside quotes."""
    return next(((t.start, t.end) for t in tokens(sql, True) if t.kind == "comment"), None)


def bare(name: str) -> str:
    """An identifier without its quotes; case is kept."""
    if len(name) > 1 and name[0] in "\"`[" and name[-1] == {"[": "]"}.get(name[0], name[0]):
        close = name[-1]
        return name[1:-1].replace(close * 2, close)
    return name


def fold(name: str) -> str:
    """The canonical form: each dotted segment unquoted and lower-cased."""
    return ".".join(bare(x).lower() for x in name.split("."))


def line_column(sql: str, offset: int) -> tuple[int, int]:
    """1-based line and column of an offset."""
    return sql.count("\n", 0, offset) + 1, offset - (sql.rfind("\n", 0, offset) + 1) + 1
