"""Problem 3: load the valid lines of delimited files and separate the others with the reason.

A `Layout` names the fields of a line; from it come, for each order k,

* one anchored pattern for the whole line, which a valid line matches, and
* prefix patterns that take in one field more each time, at three levels: fields whose quotes are sound, fields of the
  right structure, fields with valid content.

A line that fails meets the prefix patterns level by level and field by field; the first that it does not match gives both
the reason (the level) and the broken field.  All patterns are Java regular expressions with possessive quantifiers,
so they never backtrack into a field and need neither stack nor quadratic time for long lines.

Everything runs in the JVM in staged projections, without a shuffle: trimming, the whole-line patterns and the split of
valid lines are generated code; only failing lines reach the many prefix patterns, which are evaluated outside of it because
they would pass the limits of compiled methods.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL_ORDERS = 5  # orders up to this get constant patterns, higher ones a pattern built per row

_BAD = r"\p{Cc}\x{FFFD}"
_WORD = rf"[^ \t{_BAD}]++"
_UNSIGNED = r"(?:\d++(?:\.\d*+)?|\.\d++)(?:[eE][+-]?\d++)?"
DECIMAL = rf"[+-]?{_UNSIGNED}"
NOT_POSITIVE = rf"(?:-{_UNSIGNED}|\+?(?:0++(?:\.0*+)?|\.0++)(?:[eE][+-]?\d++)?)"


def at_most(limit: int) -> str:
    """Pattern of the digit strings, leading zeros allowed, whose value is at most limit."""
    digits = str(limit)
    shorter = rf"\d{{1,{len(digits) - 1}}}" if len(digits) > 1 else ""
    same = [
        digits[:i] + (rf"[0-{int(d) - 1}]" if d != "1" else "0") + rf"\d{{{len(digits) - i - 1}}}"
        for i, d in enumerate(digits)
        if d != "0"
    ]
    return rf"0*+(?:{'|'.join([*same, digits, *filter(None, [shorter]), '(?<=0)'])})(?!\d)"


COUNT = at_most(2**63 - 1)


@dataclass(frozen=True)
class Part:
    """A field: pattern of its valid content and of what only has the right structure.  {k} and {j} are k and k - 1."""

    name: str
    valid: str
    shape: str


@dataclass(frozen=True)
class Layout:
    """Fields in order; optional: the last one may be missing; quoting: pattern of a field whose quotes are sound;
    header: whether line 1 is a header."""

    name: str
    parts: tuple[Part, ...]
    separator: str
    optional: bool = False
    quoting: str | None = None
    header: bool = False

    def _join(self, contents: list[str]) -> str:
        if not self.optional:
            return rf"\A{self.separator.join(contents)}\z"
        return rf"\A{self.separator.join(contents[:-1])}(?:{self.separator}{contents[-1]})?\z"

    def whole(self) -> str:
        return self._join([f"({p.valid})" for p in self.parts])

    def prefixes(self) -> list[tuple[str, str, str]]:
        """(reason, field, pattern) in the order in which a failing line meets them."""
        out = []
        if self.quoting:
            for i, p in enumerate(self.parts):
                more = rf"(?:{self.separator}{self.quoting}){{0,{i}}}+(?={self.separator}|\z)"
                out.append(("quoting", p.name, rf"\A{self.quoting}{more}".replace("{0,0}+", "{0}")))
            out.append(("quoting", self.parts[-1].name, rf"\A{self.quoting}(?:{self.separator}{self.quoting})*+\z"))
        for reason, contents in (("columns", [p.shape for p in self.parts]), ("value", [p.valid for p in self.parts])):
            for i, p in enumerate(self.parts[:-1]):
                out.append((reason, p.name, rf"\A{self.separator.join(contents[: i + 1])}(?={self.separator}|\z)"))
            out.append((reason, self.parts[-1].name, self._join(contents)))
        return out


def _quoted(pattern: str) -> str:
    return rf'(?:"{pattern}"|{pattern})'


_ANY = r'(?:"(?:[^"]++|"")*+"|[^",]*+)'
_QUOTED_WORD, _OPEN_WORD = rf'(?:[^" \t{_BAD}]|"")++', rf'[^", \t{_BAD}]++'

LAYOUTS = {
    "counts": Layout(
        "counts",
        (
            Part("ngram", rf"{_WORD}(?:[ \t]++{_WORD}){{{{j}}}}", r"[^ \t]++(?:[ \t]++[^ \t]++){{j}}"),
            Part("cnt", COUNT, r"[^ \t]++"),
        ),
        r"[ \t]++",
    ),
    "arpa": Layout(
        "arpa",
        (
            Part("log10prob", NOT_POSITIVE, r"[^\t]*+"),
            Part("ngram", rf" *+{_WORD}(?: ++{_WORD}){{{{j}}}} *+", r" *+[^ \t]++(?: ++[^ \t]++){{j}} *+"),
            Part("log10bow", DECIMAL, r"[^\t]*+"),
        ),
        r"\t",
        optional=True,
    ),
    "csv": Layout(
        "csv",
        (
            Part("ord", _quoted("0*+{{k}}"), _ANY),
            Part(
                "ngram",
                rf'(?:" *+{_QUOTED_WORD}(?: ++{_QUOTED_WORD}){{{{j}}}} *+"| *+{_OPEN_WORD}(?: ++{_OPEN_WORD}){{{{j}}}} *+)',
                r'(?:"[ \t]*+(?:[^" \t]|"")++(?:[ \t]++(?:[^" \t]|"")++){{j}}[ \t]*+"'
                r'|[ \t]*+[^", \t]++(?:[ \t]++[^", \t]++){{j}}[ \t]*+)',
            ),
            Part("log10prob", _quoted(NOT_POSITIVE), _ANY),
            Part("log10bow", _quoted(f"(?:{DECIMAL})?"), _ANY),
            Part("cnt", _quoted(COUNT), _ANY),
        ),
        ",",
        quoting=_ANY,
        header=True,
    ),
}


def _outside(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), evaluated outside generated code."""
    return F.transform(F.array(value), body)[0]


def _matches(line: Column, pattern: str, order: Column) -> Column:
    """Whether line matches the pattern for its order; false where the order is null or below 1."""
    if "{{" not in pattern:
        return line.rlike(pattern)
    fill: Callable[[int], str] = lambda k: pattern.replace("{{j}}", "{%d}" % (k - 1)).replace("{{k}}", str(k))
    out = F.when(order == 1, line.rlike(fill(1)))
    for k in range(2, LITERAL_ORDERS + 1):
        out = out.when(order == k, line.rlike(fill(k)))
    text = F.replace(F.lit(pattern), F.lit("{{k}}"), order.cast("string"))
    text = F.replace(text, F.lit("{{j}}"), F.concat(F.lit("{"), (order - 1).cast("string"), F.lit("}")))
    return F.coalesce(out.when(order > LITERAL_ORDERS, F.rlike(line, text)), F.lit(False))


_CUT = "\x00"  # a control character, which no valid line holds


def _fields(line: Column, layout: Layout) -> Column:
    """Contents of the fields of a valid line, without their quotes; the order needs no checking any more.

    One replacement cuts the line into all fields."""
    pattern = layout.whole().replace("{{j}}", "{0,}").replace("{{k}}", r"\d++")
    cut = _CUT.join(f"${i + 1}" for i in range(len(layout.parts)))
    fields = F.split(F.regexp_replace(line, pattern, cut), _CUT)
    if layout.quoting is None:
        return fields
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(fields, lambda f: F.when(f.startswith('"'), inner(f)).otherwise(f))


_NAMES = ("ngram", "cnt", "log10prob", "log10bow")
# digits enough, or an exponent large enough, to pass the range of a double
_LARGE = r"[0-9.][eE]\+?0*+[0-9]{3}|[0-9]{300}"


def parse_lines(
    lines: DataFrame,
    keep: list[str],
    raw: str = "raw",
    layout: str = "fmt",
    order: str = "ord",
    line_no: str = "line_no",
    layouts: dict[str, Layout] = LAYOUTS,
) -> DataFrame:
    """One row for each line: `keep`, status, reason, field, ngram, cnt, log10prob, log10bow.

    status is `skipped` (null or blank line, comment, header), `loaded` or `failed`.  reason is the first that applies:
    `quoting`, `columns` or `value`; field is the first field from the left that breaks it (the last one where fields are
    left over).  Blanks and carriage returns at the end of a line do not count.  A line of an unknown or null layout fails
    with `value` in field `layout`; one whose order is null or below 1 fails with `columns` unless its quotes are broken.  A
    number beyond the range of a double is not finite and fails with `value` and a null field.  Repeated lines are rows of
    their own.
    """
    headers = [n for n, x in layouts.items() if x.header]
    none = F.lit(None).cast("string")
    line, kind, k = F.col("__line"), F.col("__layout"), F.col("__k")

    def by_layout(make: Callable[[Layout], Column], default: Column) -> Column:
        out = F
        for name, x in layouts.items():
            out = out.when(kind == name, make(x))
        return out.otherwise(default)

    def values(x: Layout) -> Column:
        fields, at = _fields(line, x), {p.name: i for i, p in enumerate(x.parts)}
        return F.transform(F.array(fields), lambda f: F.struct(*[
            (F.nullif(F.get(f, F.lit(at[n])), F.lit("")) if n in at else none).alias(n) for n in _NAMES
        ]))[0]

    empty = F.struct(*[none.alias(n) for n in _NAMES])
    rows = lines.select(
        *keep,
        F.rtrim(F.col(raw), F.lit(" \r")).alias("__line"),
        F.col(layout).alias("__layout"),
        F.col(order).cast("int").alias("__k"),
        F.col(line_no).cast("bigint").alias("__no"),
    )
    blank = F.ltrim(line, F.lit(" \t")) == ""
    skipped = line.isNull() | blank | line.startswith("#")
    if headers:
        skipped |= kind.isin(headers) & (F.col("__no") == 1)
    rows = rows.withColumn("__skipped", F.coalesce(skipped, F.lit(False)))
    rows = rows.withColumn("__fits", ~F.col("__skipped") & by_layout(lambda x: _matches(line, x.whole(), k), F.lit(False)))
    got = F.col("__got")
    finite = F.lit(True)
    for n in ("log10prob", "log10bow"):
        finite &= F.coalesce(F.abs(got[n].try_cast("double")) < F.lit(float("inf")), F.lit(True))
    large = F.col("__fits") & line.rlike(_LARGE)
    rows = rows.withColumn("__got", F.when(large, by_layout(values, empty))).withColumn("__finite", got.isNull() | finite).drop("__got")

    status = F.when(F.col("__skipped"), F.lit("skipped"))
    status = status.when(F.col("__fits") & F.col("__finite"), F.lit("loaded")).otherwise(F.lit("failed"))
    rows = rows.withColumn("status", status)
    # the place of the first prefix pattern that a failing line doesn't match
    steps = {name: x.prefixes() for name, x in layouts.items()}

    def broken(r: Column) -> Column:
        out = F
        for name in layouts:
            first = F
            for i, (_, _, pattern) in enumerate(steps[name]):
                first = first.when(~_matches(r["line"], pattern, r["k"]), F.lit(i))
            out = out.when(r["layout"] == name, first.otherwise(F.lit(-1)))
        return out.otherwise(F.lit(-2))

    failed = F.col("status") == "failed"
    row = F.struct(line.alias("line"), kind.alias("layout"), k.alias("k"))
    rows = rows.withColumn("__step", F.when(failed, _outside(row, broken)))
    step = F.col("__step")

    def named(place: int, at_end: Column, unknown: Column) -> Column:
        """Reason (0) or field (1) of the step."""
        known = by_layout(lambda x: F.get(F.array(*[F.lit(s[place]) for s in x.prefixes()]), step), none)
        return F.when(step == -1, at_end).when(step == -2, unknown).otherwise(known)

    rows = rows.withColumn("__got", F.when(F.col("status") == "loaded", by_layout(values, empty)))
    words = F.array_join(F.filter(F.split(got["ngram"], r"[ \t]+"), lambda w: w != ""), " ")
    return rows.select(
        *keep,
        "status",
        named(0, F.lit("value"), F.lit("value")).alias("reason"),
        named(1, none, F.lit("layout")).alias("field"),
        words.alias("ngram"),
        *[got[n].cast("bigint" if n == "cnt" else "double").alias(n) for n in _NAMES[1:]],
    )
