"""Registered queries of the general data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import malformed, skew
from ..session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed.parse_lines(spread(_table(spark, sf_dir, "model_lines")), ["line_id", "model_id", "ord"])


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its status and reason."""
    return _lines(spark, sf_dir).select("line_id", "model_id", "ord", "status", "reason")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).where("status = 'failed'").select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of the lines that load."""
    lines = _lines(spark, sf_dir).where("status = 'loaded'")
    return lines.select("line_id", "model_id", "ord", "ngram", "cnt", "log10prob", "log10bow")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing lines by file and reason."""
    lines = _lines(spark, sf_dir).where("status = 'failed'")
    return lines.groupBy("model_id", "reason").agg(F.count(F.lit(1)).alias("n_lines"))


def p3_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing lines by reason and broken field."""
    lines = _lines(spark, sf_dir).where("status = 'failed'")
    return lines.groupBy("reason", "field").agg(F.count(F.lit(1)).alias("n_lines"))


_DECIMAL = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_NO_CONTROL = r"[^\x{0000}-\x{001F}\x{007F}-\x{009F}\x{FFFD}]*"

_JUDGED = f"""
WITH line AS (
  SELECT line_id, model_id, fmt, ord, line_no, rtrim(raw, ' ' || chr(13)) AS s FROM model_lines WHERE raw IS NOT NULL
), kept AS (
  SELECT * FROM line
  WHERE trim(s, ' ' || chr(9)) <> '' AND NOT starts_with(s, '#') AND NOT (fmt = 'csv' AND line_no = 1)
), plain AS (
  SELECT line_id, model_id, fmt, ord, s,
    regexp_full_match(s, '("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS quotes_ok,
    CASE fmt
      WHEN 'counts' THEN regexp_split_to_array(s, '[ \\t]+')
      WHEN 'arpa' THEN string_split(s, chr(9))
      ELSE list_transform(regexp_extract_all(',' || s, ',("([^"]|"")*"|[^",]*)', 1), lambda f:
        CASE WHEN starts_with(f, '"') THEN replace(f[2:length(f) - 1], '""', '"') ELSE f END)
    END AS f
  FROM kept
), field AS (
  SELECT *,
    CASE fmt WHEN 'counts' THEN array_to_string(f[1:len(f) - 1], ' ') ELSE f[2] END AS ngram,
    CASE fmt WHEN 'counts' THEN f[len(f)] WHEN 'csv' THEN f[5] END AS cnt,
    CASE fmt WHEN 'arpa' THEN f[1] WHEN 'csv' THEN f[3] END AS prob,
    CASE fmt WHEN 'arpa' THEN f[3] WHEN 'csv' THEN nullif(f[4], '') END AS bow,
    CASE fmt WHEN 'counts' THEN len(f) = ord + 1 WHEN 'arpa' THEN len(f) IN (2, 3) ELSE len(f) = 5 END AS fields_ok
  FROM plain
), judged AS (
  SELECT line_id, model_id, ord, ngram, cnt, prob, bow,
    CASE
      WHEN fmt = 'csv' AND NOT quotes_ok THEN 'quoting'
      WHEN NOT fields_ok OR len(list_filter(regexp_split_to_array(ngram, '[ \\t]+'), lambda w: w <> '')) <> ord THEN 'columns'
      WHEN NOT regexp_full_match(ngram, '{_NO_CONTROL}')
        OR (cnt IS NOT NULL AND NOT (regexp_full_match(cnt, '[0-9]+')
            AND coalesce(try_cast(ltrim('0' || cnt, '0') || '' AS HUGEINT), CASE WHEN ltrim(cnt, '0') = '' THEN 0 END) < 9223372036854775808))
        OR (prob IS NOT NULL AND NOT (regexp_full_match(prob, '{_DECIMAL}') AND coalesce(try_cast(prob AS DOUBLE) <= 0, false)))
        OR (bow IS NOT NULL AND NOT (regexp_full_match(bow, '{_DECIMAL}') AND coalesce(isfinite(try_cast(bow AS DOUBLE)), false)))
        OR (fmt = 'csv' AND coalesce(try_cast(f[1] AS BIGINT) <> ord, true))
      THEN 'value'
    END AS reason
  FROM field
)
"""
P3_FOUND = f"{_JUDGED} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL"
P3_REASONS = f"{_JUDGED} SELECT model_id, reason, count(*) AS n_lines FROM judged WHERE reason IS NOT NULL GROUP BY ALL"
P3_LINES = f"""{_JUDGED}
SELECT l.line_id, l.model_id, l.ord, j.reason,
  CASE WHEN j.line_id IS NULL THEN 'skipped' WHEN j.reason IS NULL THEN 'loaded' ELSE 'failed' END AS status
FROM model_lines l LEFT JOIN judged j ON j.line_id = l.line_id
"""
P3_LOADED = f"""{_JUDGED}
SELECT line_id, model_id, ord, array_to_string(list_filter(regexp_split_to_array(ngram, '[ \\t]+'), lambda w: w <> ''), ' ') AS ngram,
  CAST(cnt AS BIGINT) AS cnt, CAST(prob AS DOUBLE) AS log10prob, CAST(bow AS DOUBLE) AS log10bow
FROM judged WHERE reason IS NULL
"""


def p6_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, followers and total count of every history."""
    return skew.history_statistics(_table(spark, sf_dir, "ngram_counts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "ngram_counts")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return skew.history_statistics(rows).where(skew.share_of("n_rows", 0.02, total)).select("hist")


P6_HISTORIES = """
WITH one AS (
  SELECT hist, word, segment_id, count(*) AS n, max(coalesce(cnt, 0)) AS cnt FROM ngram_counts
  WHERE hist IS NOT NULL GROUP BY hist, word, segment_id
)
SELECT hist, CAST(sum(n) AS BIGINT) AS n_rows, CAST(count(DISTINCT word) AS BIGINT) AS n_followers,
  CAST(sum(cnt) AS BIGINT) AS total
FROM one GROUP BY hist
"""
P6_FOUND = """
SELECT hist FROM ngram_counts WHERE hist IS NOT NULL GROUP BY hist
HAVING count(*) > 0.02 * (SELECT count(*) FROM ngram_counts)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_lines, p3_found, p3_loaded, p3_reasons, p3_fields, p6_histories, p6_found)}


def oracle_sql() -> dict[str, str]:
    p3 = {"p3_lines": P3_LINES, "p3_found": P3_FOUND, "p3_loaded": P3_LOADED, "p3_reasons": P3_REASONS}
    return p3 | {"p6_histories": P6_HISTORIES, "p6_found": P6_FOUND}
