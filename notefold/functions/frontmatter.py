"""Front matter: reading it as data, and setting keys of it without touching other lines.

Lines, not a parsed document, are what an update works on: a key's own lines
are replaced, and comments, order, quotes and nested values of other keys stay
as they are.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

_KEY = re.compile(r"""^(?P<key>"[^"]*"|'[^']*'|[^\s#\-\[\]{}&*!|>%@`"'][^:#]*?)\s*:(?=\s|$)(?P<rest>.*)$""")
_COMMENT = re.compile(r"\s#.*$")
_PLAIN = re.compile(r"^[^\W_][^\n\r\t]*$|^[^\W_]$")
_OTHER_TYPE = re.compile(r"(?i)^(true|false|yes|no|on|off|y|n|null|~|[-+.]?[0-9][0-9_.,:eExXa-fA-F+-]*|\.inf|\.nan|\d{4}-\d\d?-\d\d?.*)$")


def divided(text: str) -> tuple[list[str] | None, str]:
    """Lines of the front matter (None without any) and what follows its closing line."""
    rows = re.split(r"(?<=\n)", text.replace("\r\n", "\n"))
    if text.startswith("---"):
        for k in range(1, len(rows)):
            if rows[k].strip() == "---":
                return [r.rstrip("\n") for r in rows[1:k]], "".join(rows[k + 1 :])
    return None, text


def scalar(value: object) -> str:
    """A value on one line, quoted only where it would read as something else."""
    if value is None or isinstance(value, (bool, int, float)):
        return json.dumps(value)
    s = str(value)
    if _PLAIN.match(s) and s == s.strip() and ": " not in s and " #" not in s and not s.endswith(":") and not _OTHER_TYPE.match(s):
        return s
    return json.dumps(s, ensure_ascii=False) if re.search(r"[\x00-\x1f\x7f\x85\u2028\u2029]", s) else "'" + s.replace("'", "''") + "'"


def rendered(key: str, value: object, comment: str = "") -> list[str]:
    if isinstance(value, (list, tuple)):
        return [f"{key}:{comment}", *(f"  - {scalar(x)}" for x in value)] if value else [f"{key}: []{comment}"]
    return [f"{key}: {scalar(value)}{comment}"]


def _blocks(rows: list[str]) -> list[tuple[str | None, list[str]]]:
    """(key, lines) in order; comments and blank lines between keys have no key. Raises ValueError where lines are no mapping."""
    out: list[tuple[str | None, list[str]]] = []
    for row in rows:
        m = _KEY.match(row)
        if m:
            out.append((m["key"].strip("\"'"), [row]))
        elif row[:1] in (" ", "\t") or row.startswith("- ") or row == "-":
            loose = []
            while out and out[-1][0] is None:
                loose = out.pop()[1] + loose
            if not out:
                if row.strip() and not row.lstrip().startswith("#"):
                    raise ValueError("front matter is not a mapping")
                out.append((None, [*loose, row]))
            else:
                out[-1][1].extend([*loose, row])
        elif not row.strip() or row.startswith("#"):
            out.append((None, [row]))
        else:
            raise ValueError("front matter is not a mapping")
    return out


def flow_scalar(value: object) -> str:
    """A value within a flow mapping, where commas and brackets need quotes too."""
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(flow_scalar, value)) + "]"
    own = scalar(value)
    return "'" + own.replace("'", "''") + "'" if own[:1] not in "'\"" and isinstance(value, str) and re.search(r"[,\[\]{}:#]", own) else own


def _space(s: str, at: int) -> int:
    """Where the next thing that is neither white space nor a comment begins."""
    while at < len(s) and (s[at].isspace() or s[at] == "#" and (at == 0 or s[at - 1].isspace())):
        at = at + 1 if s[at] != "#" else (s.find("\n", at) + 1 or len(s))
    return at


def _node(s: str, at: int) -> int:
    """Where the node that begins at a place of a flow collection ends."""
    if at < len(s) and s[at] in "&!":  # an anchor or a tag stands before its node
        return _node(s, _space(s, re.compile(r"[^\s,\[\]{}]*").match(s, at).end()))
    if s[at : at + 1] in ("'", '"'):
        m = re.compile(r"'(?:[^']|'')*'" if s[at] == "'" else r'"(?:[^"\\]|\\.)*"', re.S).match(s, at)
        if not m:
            raise ValueError("a quote of the front matter is not closed")
        return m.end()
    if s[at : at + 1] in ("[", "{"):
        return _collection(s, at)[1]
    return at + len(re.compile(r"(?:[^\s,\[\]{}:#]|:(?![\s,\[\]{}]|$)|(?<!\s)#|[ \t\n]+(?=[^\s,\[\]{}#:]))*", re.S).match(s, at)[0])


def _collection(s: str, at: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Entries of the flow collection that begins at a place, as (key, its end, value, its end), and where it ends; without a value its places are the key's end."""
    close, entries = {"[": "]", "{": "}"}[s[at]], []
    at = _space(s, at + 1)
    while at < len(s) and s[at] != close:
        key, end = at, _node(s, at)
        at = _space(s, end)
        value = last = end
        if s[at : at + 1] == ":":
            value = _space(s, at + 1)
            last = _node(s, value)
            value, at = (value, _space(s, last)) if last > value else (at + 1, value)
            last = max(last, value)
        elif end == key:
            raise ValueError("the front matter's flow mapping has an empty entry")
        entries.append((key, end, value, last))
        if s[at : at + 1] == ",":
            at = _space(s, at + 1)
        elif s[at : at + 1] != close:
            raise ValueError("the front matter's flow mapping is broken")
    if at >= len(s):
        raise ValueError("the front matter's flow mapping is not closed")
    return entries, at + 1


def _flow_updated(s: str, updates: dict, new: list[str]) -> str:
    """A front matter that is one flow mapping with values of keys replaced where they stand, and new keys before its end."""
    at = _space(s, 0)
    entries, end = _collection(s, at)
    if _space(s, end) < len(s):
        raise ValueError("something follows the front matter's flow mapping")
    names = [s[a:b].strip("\"'") for a, b, *_ in entries]
    added = [f"{k}: {flow_scalar(updates[k])}" for k in new if k not in names]
    out, upto = [], 0
    for name, (_, key_end, value, last) in zip(names, entries, strict=True):
        if name in updates:
            bare = value == key_end  # a key alone
            out += [s[upto:value], (": " if bare else "" if s[value - 1].isspace() else " ") + flow_scalar(updates[name])]
            upto = last
    tail = max((e[3] for e in entries), default=at + 1)
    if added:
        out += [s[upto:tail], ", " * bool(entries) + ", ".join(added)]
        upto = tail
    return "".join(out) + s[upto:]


def updated(text: str, updates: dict, order: list[str]) -> str:
    """Text with the keys of updates set: missing ones are added by order, then the rest; other lines stay.

    A front matter that is one flow mapping stays one, comments and all.
    """
    rows, body = divided(text)
    whole = "\n".join(rows or [])
    if whole[_space(whole, 0) :].startswith("{"):
        new = [k for k in order if k in updates] + [k for k in updates if k not in order]
        return f"---\n{_flow_updated(whole, updates, new)}\n---" + (body if body.startswith("\n") else "\n" + body)
    blocks = _blocks(rows or [])
    have = {k for k, _ in blocks}
    new = [k for k in order if k in updates and k not in have]
    new += [k for k in updates if k not in have and k not in new]
    out: list[str] = []
    for key, own in blocks:
        if key in updates:
            value, found = updates[key], None if isinstance(updates[key], (list, tuple)) else _COMMENT.search(own[0])
            out += rendered(_KEY.match(own[0])["key"], value, found[0] if found and len(own) == 1 and not re.search(r"""["'].*#.*["']""", own[0]) else "")
        else:
            out += own
    for key in new:
        out += rendered(key, updates[key])
    head = "---\n" + "".join(f"{r}\n" for r in out) + "---"
    return head + (body if rows is not None and body.startswith("\n") else "\n" + body)


#: A front matter with its closing line; blanks are those that str.strip takes.
_BLANK = r"[\t\x0B\f\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]*"
_HEAD = rf"(?s)\A---.*?\n{_BLANK}---{_BLANK}(?:\n|\z)"


def head(text: Column) -> Column:
    """The front matter of a text with its closing line, as divided finds it; empty without any. Bodies need not go to Python."""
    return F.regexp_extract(text, _HEAD, 0)


def update_frontmatter(text: Column, updates: Column, order: tuple[str, ...] = ("summary", "tags", "concepts", "related")) -> Column:
    """text with the fields of the struct updates set in its front matter; null where that is no mapping. Null fields are left alone."""

    @arrow_udf("string")
    def run(heads: pa.Array, values: pa.Array) -> pa.Array:
        out = []
        for t, v in zip(heads.to_pylist(), values.to_pylist(), strict=True):
            try:
                out.append(None if t is None else updated(t, {k: x for k, x in json.loads(v).items() if x is not None}, list(order)).removesuffix("\n"))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    own = head(text)
    rest = F.replace(F.substr(text, F.char_length(own) + 1), F.lit("\r\n"), F.lit("\n"))
    body = F.when(own == "", F.concat(F.lit("\n"), text)).when(F.startswith(rest, F.lit("\n")), rest).otherwise(F.concat(F.lit("\n"), rest))
    return F.concat(run(own, F.to_json(updates)), body)


def parse_frontmatter(text: Column) -> Column:
    """Front matter as JSON, '{}' without any or if it is no mapping; null where it is not valid YAML."""

    @arrow_udf("string")
    def run(heads: pa.Array) -> pa.Array:
        import yaml  # not among the engine's requirements: only this function needs it

        out = []
        for t in heads.to_pylist():
            rows, _ = divided(t or "")
            try:
                data = yaml.safe_load("\n".join(rows)) if rows else None
                data = {str(k): v for k, v in data.items()} if isinstance(data, dict) else {}
                out.append(json.dumps(data, default=str, ensure_ascii=False))
            except yaml.YAMLError:
                out.append(None)
        return pa.array(out, pa.string())

    return run(head(text))
