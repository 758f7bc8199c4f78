"""INSERTs that leave sequence-bound columns to be filled."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from keyspan.plans.catalog import VSchema
from keyspan.plans.planner import table_name
from keyspan.plans.sql import Parsed, SqlError, Statement, Write, parse

INTERNAL = "XX000"


def omitted(tree: Statement, vschema: VSchema) -> list[tuple[str, str]]:
    """(column, sequence) pairs that an INSERT with a column list and VALUES rows leaves out."""
    if not isinstance(tree, Write) or tree.verb != "insert" or not tree.columns or not row_count(tree):
        return []
    table = vschema.get(table_name(tree.table))
    return [(c, s) for c, s in table.sequences if c not in tree.columns] if table and table.key is not None else []


def row_count(tree: Statement) -> int:
    """VALUES rows of an INSERT; 0 for anything else."""
    if not isinstance(tree, Write) or tree.verb != "insert" or tree.query is None:
        return 0
    return len(tree.query.values or ())


def _closing(text: str, at: int) -> int:
    """Position of the parenthesis that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/|[()]", re.S).finditer(text, at):
        depth += {"(": 1, ")": -1}.get(m[0], 0)
        if not depth:
            return m.start()
    raise SqlError(INTERNAL, "unclosed parenthesis")


def insert_rows(parsed: Parsed | SqlError) -> int:
    """VALUES rows of a text that is one INSERT with a column list; anything else is an error."""
    if isinstance(parsed, SqlError):
        raise parsed
    tree = parsed.trees[0]
    rows = row_count(tree) if len(parsed.trees) == 1 else 0
    if not rows or not tree.columns:
        raise SqlError(INTERNAL, "not a single INSERT with a column list and VALUES rows")
    return rows


def rewrite_insert(text: str, ids: Mapping[str, Sequence[int]], rows_of: Callable[[str], int] | None = None) -> str:
    """The INSERT with columns added, one id for each VALUES row; the rest of the text stays as it is.

    rows_of: insert_rows of a text, from whoever reads many.
    """
    rows = rows_of(text) if rows_of else insert_rows(parse(text))
    for column, values in ids.items():
        if len(values) != rows:
            raise SqlError(INTERNAL, f"{len(values)} ids of {column} for {rows} rows")
    quoted = [c if re.fullmatch(r"[a-z_][a-z0-9_]*", c) else '"' + c.replace('"', '""') + '"' for c in ids]
    open_ = text.index("(")
    close = _closing(text, open_)
    out = [text[:close], "".join(f", {c}" for c in quoted)]
    last, at = close, re.compile(r"\bvalues\b", re.I).search(text, close).end()
    for row in range(rows):
        open_ = text.index("(", at)
        close = _closing(text, open_)
        out += [text[last:close], "".join(f", {int(values[row])}" for values in ids.values())]
        last = at = close
    return "".join(out) + text[last:]
