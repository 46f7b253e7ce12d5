"""Results as text tables."""

from __future__ import annotations

from collections.abc import Iterable


def cell(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else f"{x:.6g}"
    return str(x)


def render(names: list[str], rows: Iterable[tuple]) -> str:
    """A bordered table, numbers to the right."""
    rows = list(rows)
    shown = [[cell(x) for x in row] for row in rows]
    widths = [max([len(n), *(len(r[i]) for r in shown)]) for i, n in enumerate(names)]
    numbers = [any(r[i] is not None for r in rows) and all(isinstance(r[i], (int, float)) and not isinstance(r[i], bool) for r in rows if r[i] is not None) for i in range(len(names))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"

    def line(cells: list[str], right: list[bool]) -> str:
        return "|" + "|".join(f" {c:>{w}} " if r else f" {c:<{w}} " for c, w, r in zip(cells, widths, right)) + "|"

    return "\n".join([rule, line(names, [False] * len(names)), rule, *[line(r, numbers) for r in shown], rule])


def footer(n: int, ms: float, scanned: int | None = None) -> str:
    return f"{n} row{'s' * (n != 1)} ({ms:.1f} ms)" + (f" [scanned: {scanned}]" if scanned is not None else "")
