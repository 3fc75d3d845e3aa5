"""Text reports of the command line."""

from __future__ import annotations

from collections.abc import Sequence

from tallow.engine import Availability
from tallow.model import Interval

_UNITS = ("KB", "MB", "GB", "TB")


def human_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    v = float(n)
    for unit in _UNITS:
        v /= 1024
        if v < 1024 or unit == _UNITS[-1]:
            return f"{v:.1f} {unit}"
    raise AssertionError("unreachable")


def plural(n: int, word: str) -> str:
    if n == 1:
        return f"1 {word}"
    if word.endswith("y") and word[-2:-1] not in "aeiou":
        return f"{n} {word[:-1]}ies"
    return f"{n} {word}s"


def progress_bar(done: int, total: int, width: int = 24) -> str:
    full = width * done // total if total else width
    return f"[{'=' * full}{' ' * (width - full)}] {100 * done // total if total else 100:3d}% {done:{len(str(total))}d}/{total}"


def availability(symbol: str, interval: Interval, a: Availability, show_all: bool = False) -> str:
    lines = [f"{symbol} {interval} spot", ""]
    spans = (("monthly", a.monthly, a.monthly_gaps), ("daily", a.daily, a.daily_gaps))
    for name, have, gaps in spans:
        if have:
            lines.append(f"{name + ' archives':16s}  {len(have)}  {have[0]:%Y-%m-%d} .. {have[-1]:%Y-%m-%d}" + (f"  {len(gaps)} missing" if gaps else ""))
    if a.through:
        lines.append(f"archives through     {a.through:%Y-%m-%d}")
    if show_all:
        for _, have, gaps in spans:
            lines += ["", *(f"{t:%Y-%m-%d}" + ("  MISSING" if gap else "") for t, gap in sorted([(t, False) for t in have] + [(t, True) for t in gaps]))] if have else []
    return "\n".join(lines) + "\n"


def usage(root: str, rows: dict[str, tuple[int, int]], prunable: Sequence[int] = ()) -> str:
    """rows: file class -> (files, bytes); prunable: sizes of the archives that pruning would delete."""
    if not rows:
        return f"{root}\n\nempty\n"
    shown = [(k, *rows[k]) for k in ("archives", "sidecars", "parquet", "other") if k in rows]
    shown.append(("total", sum(r[1] for r in shown), sum(r[2] for r in shown)))
    wide = max(len(str(r[1])) for r in shown)
    out = f"{root}\n\n" + "".join(f"{name:>10s}  {n:{wide}d}  {human_bytes(size)}\n" for name, n, size in shown)
    if prunable:
        out += f"\n{human_bytes(sum(prunable))} in {plural(len(prunable), 'archive')} can be freed by prune\n"
    elif "archives" in rows:
        out += "\nnothing to prune: every archive is still needed\n"
    return out
