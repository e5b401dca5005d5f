"""SQL building blocks (DuckDB dialect) that mirror the language-model operators."""

from __future__ import annotations

WORDS = r"list_filter(regexp_split_to_array({line}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')"
BOUNDED = (
    "list_concat(['</s>'], list_transform("
    + WORDS
    + ", lambda x: CASE WHEN x = '<s>' THEN '</s>' ELSE x END), ['</s>'])"
)


def tokens(source: str = "documents", keep: str = "doc_id", where: str = "true") -> str:
    """CTE body: (keep, line_no, w)."""
    return f"""
    SELECT {keep}, line_no, {BOUNDED.format(line="line")} AS w FROM (
      SELECT {keep}, unnest(lines) AS line, unnest(range(len(lines))) AS line_no
      FROM (SELECT {keep}, string_split(text, chr(10)) AS lines FROM {source} WHERE text IS NOT NULL AND ({where}))
    ) WHERE NOT (starts_with(line, '<DOC ') OR line = '</DOC>')"""


def occurrences(order: int, tok: str = "tok", keep: str = "") -> str:
    keep = keep + ", " if keep else ""
    return " UNION ALL ".join(
        f"SELECT {keep}{o} AS ord, unnest(list_transform(range({max(2, o)}, len(w) + 1), lambda i: array_to_string(w[i-{o - 1}:i], ' '))) AS ngram FROM {tok}"
        for o in range(1, order + 1)
    )


KEYS = """CASE WHEN ord = 1 THEN '' ELSE array_to_string(string_split(ngram, ' ')[1:ord - 1], ' ') END AS hist,
      CASE WHEN ord = 1 THEN '' ELSE array_to_string(string_split(ngram, ' ')[2:ord], ' ') END AS suffix,
      string_split(ngram, ' ')[-1] AS word"""


def counts(order: int, name: str = "c", tok_body: str | None = None, prefix: str = "") -> str:
    """CTEs <prefix>tok, <prefix>occ and name(ord, ngram, cnt, hist, suffix, word)."""
    return f"""{prefix}tok AS ({tok_body or tokens()}),
  {prefix}occ AS ({occurrences(order, prefix + "tok")}),
  {name} AS (SELECT *, {KEYS} FROM (SELECT CAST(ord AS INTEGER) AS ord, ngram, count(*) AS cnt FROM {prefix}occ GROUP BY ord, ngram))"""


def effective(order: int, c: str = "c", name: str = "e") -> str:
    return f"""{name} AS (
    SELECT {c}.*, CASE WHEN {c}.ord < {order} THEN coalesce(k.n, {c}.cnt) ELSE {c}.cnt END AS eff
    FROM {c} LEFT JOIN (SELECT ord - 1 AS ord, suffix AS ngram, count(*) AS n FROM {c} WHERE cnt > 0 GROUP BY 1, 2) k
      ON {c}.ord = k.ord AND {c}.ngram = k.ngram)"""


def discounts(number: int, e: str = "e", name: str = "d") -> str:
    n = ", ".join(f"CAST(count(*) FILTER (eff = {i}) AS DOUBLE) AS n{i}" for i in range(1, max(number, 1) + 2))
    each = ", ".join(
        f"CASE WHEN n{i} = 0 THEN {i} ELSE least(greatest({i} - {i + 1} * y * n{i + 1} / n{i}, 0), {i}) END AS d{i}"
        for i in range(1, number + 1)
    )
    return f"""{name} AS (
    SELECT ord, y, {each} FROM (
      SELECT *, CASE WHEN n1 = 0 AND n2 = 0 THEN 1.0 ELSE n1 / (n1 + 2 * n2) END AS y
      FROM (SELECT ord, {n} FROM {e} GROUP BY ord)))"""


def _case(number: int, eff: str) -> str:
    whens = " ".join(f"WHEN {eff} = {i} THEN d.d{i}" for i in range(1, number))
    return f"CASE WHEN {eff} <= 0 THEN 0 {whens} ELSE d.d{number} END"


def kneser_ney(order: int, number: int, closed: bool = False, e: str = "e", d: str = "d", p: str = "", weight: str = "") -> str:
    """CTEs <p>h(ord, hist, tot, bow), <p>p1 .. <p>pN and <p>lm(ord, ngram, hist, suffix, word, prob, bow).

    weight: name of a column of e; then all sums are weighted."""
    w = f"* {e}.{weight}" if weight else ""
    one = f"{e}.{weight}" if weight else "1"
    n = ", ".join(
        f"sum(CASE WHEN eff {'=' if i < number else '>='} {i} THEN {one} ELSE 0 END) AS n{i}" for i in range(1, number + 1)
    )
    total = " + ".join(f"d.d{i} * s.n{i}" for i in range(1, number + 1))
    out = f"""{p}h AS (
    SELECT s.ord, hist, tot, CASE WHEN tot > 0 THEN ({total}) / tot ELSE 1.0 END AS bow
    FROM (SELECT ord, hist, CAST(sum(eff {w}) AS DOUBLE) AS tot, {n} FROM {e} GROUP BY ord, hist) s JOIN {d} d USING (ord))"""
    uni = "ord = 1" if closed else "ord = 1 AND cnt > 0"
    for o in range(1, order + 1):
        seen = f"(CASE WHEN {e}.eff > 0 AND h.tot > 0 THEN ({e}.eff - {_case(number, e + '.eff')}) {w} / h.tot ELSE 0 END)"
        lower = f"(SELECT 1.0 / count(*) FROM {e} WHERE {uni})" if o == 1 else "coalesce(l.prob, 0)"
        prob = f"{seen} + {lower} * h.bow"
        if o == 1 and not closed:
            prob = f"CASE WHEN {e}.eff = 0 THEN 0 ELSE {prob} END"
        join = "" if o == 1 else f"LEFT JOIN {p}p{o - 1} l ON {e}.suffix = l.ngram"
        out += f""",
  {p}p{o} AS (
    SELECT {e}.ord, {e}.ngram, {e}.hist, {e}.suffix, {e}.word, {prob} AS prob
    FROM {e} JOIN {d} d ON {e}.ord = d.ord JOIN {p}h h ON {e}.ord = h.ord AND {e}.hist = h.hist {join} WHERE {e}.ord = {o})"""
    union = " UNION ALL ".join(f"SELECT * FROM {p}p{o}" for o in range(1, order + 1))
    return (
        out
        + f""",
  {p}lm AS (
    SELECT a.*, b.bow FROM ({union}) a LEFT JOIN {p}h b ON b.ord = a.ord + 1 AND b.hist = a.ngram)"""
    )


def log10(p: str) -> str:
    return f"round(CASE WHEN {p} > 0 THEN log10({p}) ELSE -99 END, 6) + 0.0"
