"""Filter texts of saved presets, as plain conditions."""

from __future__ import annotations

import re

# The forms that a preset's filter builder writes, after an optional ``~`` and a column in back quotes. Texts
# stand between single quotes; their end is the quote before the form's own ending.
_COLUMN = re.compile(r"\s*(~?)\s*`([^`]+)`")
_FORMS = [
    ("isna", re.compile(r"\.isna\(\)")),
    ("notna", re.compile(r"\.notna\(\)")),
    ("contains", re.compile(r"\.str\.contains\('(.*?)'\s*,\s*na=False\)", re.S)),
    ("startswith", re.compile(r"\.str\.startswith\('(.*?)'\)", re.S)),
    ("endswith", re.compile(r"\.str\.endswith\('(.*?)'\)", re.S)),
    ("in", re.compile(r"\.isin\(\[(.*?)\]\)", re.S)),
    ("compare", re.compile(r"\s*(==|!=|>=|<=|>|<)\s*('.*?'(?=\s*$|\s+(?:and|or)\s+~?\s*`)|[^\s'`]+)", re.S)),
]
_JOIN = re.compile(r"\s+(and|or)\s+")
_ITEM = re.compile(r"\s*(?:'([^']*)'|([^,']+?))\s*(?:,|$)")
_NEGATED = {"contains": "not contains", "in": "not in"}


def _plain(text: str):
    """A quoted text without its quotes, or a bare number as it is written."""
    if text.startswith("'"):
        return text[1:-1]
    try:
        float(text)
    except ValueError:
        raise ValueError(f"neither a number nor a quoted text: {text!r}") from None
    return int(text) if re.fullmatch(r"[+-]?\d+", text) else text


def _items(text: str) -> list:
    found, at = [], 0
    while at < len(text):
        item = _ITEM.match(text, at)
        if not item:
            raise ValueError(f"not a list of values: {text!r}")
        found.append(item[1] if item[1] is not None else _plain(item[2]))
        at = item.end()
    return found


def _condition(text: str, at: int) -> tuple[dict, int]:
    column = _COLUMN.match(text, at)
    for name, form in _FORMS if column else ():
        found = form.match(text, column.end())
        if not found or (column[1] and name not in _NEGATED):
            continue
        op = _NEGATED[name] if column[1] else name
        if name == "compare":
            return {"col": column[2], "op": found[1], "value": _plain(found[2])}, found.end()
        if name == "in":
            return {"col": column[2], "op": op, "value": _items(found[1])}, found.end()
        value = found[1] if found.re.groups else None
        return {"col": column[2], "op": op, "value": value}, found.end()
    raise ValueError(f"a filter that no preset writes: {text[at:].strip()!r}")


def preset_filter(text: str) -> dict | None:
    """The condition of a preset's filter text, in the form that ``condition_from`` takes.

    The fifteen forms of the builder are known, joined by ``and`` and ``or`` (``and`` binds closer). Each keeps the null rules of its
    condition: ``!=``, negated lists and negated texts keep rows without a value. Any other text is an error.
    """
    text = text.strip()
    if not text:
        return None
    groups: list[list[dict]] = [[]]
    at = 0
    while True:
        condition, at = _condition(text, at)
        groups[-1].append(condition)
        if at == len(text):
            break
        join = _JOIN.match(text, at)
        if not join:
            raise ValueError(f"a filter that no preset writes: {text[at:].strip()!r}")
        if join[1] == "or":
            groups.append([])
        at = join.end()
    joined = [own[0] if len(own) == 1 else {"all": own} for own in groups]
    return joined[0] if len(joined) == 1 else {"any": joined}
