"""Command-line options: `-name value` or `-alias value`; unknown and repeated names are errors."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Option:
    name: str
    alias: str
    help: str
    default: str | None = None


def split_list(text: str, separator: str = ",") -> list[str]:
    """Trimmed elements of a list; [] for ''."""
    return [x.strip() for x in text.split(separator)] if text.strip() else []


def truth(text: str | None) -> bool:
    """True for what begins with t, T or 1."""
    return bool(text) and text[0] in "tT1"


class Options:
    def __init__(self, program: str, options: list[Option]) -> None:
        self.program, self.options = program, options
        self.by_name = {n: o for o in options for n in (o.name, o.alias) if n}

    def usage(self) -> str:
        rows = [f"usage: {self.program} [options]"]
        for o in self.options:
            names = f"-{o.alias}, -{o.name}" if o.alias else f"-{o.name}"
            rows.append(f"  {names:<32} {o.help}" + (f" (default {o.default})" if o.default is not None else ""))
        return "\n".join(rows)

    def parse(self, args: list[str]) -> dict[str, str | None]:
        values: dict[str, str | None] = {o.name: o.default for o in self.options}
        seen: set[str] = set()
        i = 0
        while i < len(args):
            if not args[i].startswith("-"):
                raise ValueError(f"unexpected argument {args[i]}")
            o = self.by_name.get(args[i].lstrip("-"))
            if o is None:
                raise ValueError(f"unknown option {args[i]}")
            if o.name in seen:
                raise ValueError(f"option {args[i]} is given twice")
            seen.add(o.name)
            if i + 1 < len(args) and not args[i + 1].startswith("-"):
                values[o.name] = args[i + 1]
                i += 2
            else:
                values[o.name] = "true"
                i += 1
        return values
