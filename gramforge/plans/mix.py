"""Registered queries of features, evaluation, merging and interpolation."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import evaluate as E
from ..operators import features as X
from ..operators import interpolate as I
from ..operators import model as M
from ..operators import smoothing as S
from ..operators import text as T
from ..session import at_once, checkpoint
from . import lm_sql as Q
from .lm import ITEMS, MODEL, ORDER, _kn, _model, counted, kn, log10, table, tokens

TOPIC_LENGTH = 6  # stand-in for topic states: words of at least so many characters are topic words


def _rounded(f: DataFrame) -> DataFrame:
    return f.select("ord", "ngram", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.document_frequency(tokens(spark, sf_dir), ORDER))


def doc_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(X.document_entropy(tokens(spark, sf_dir), ORDER))


def _eff_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    eff = C.effective_counts(counted(spark, sf_dir), ORDER)
    return eff.select("ord", "ngram", F.col("eff").cast("double").alias("value"))


def feature_function(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return _rounded(X.feature(f"{text}:effcounts", ORDER, lambda loader, source: _eff_feature(spark, sf_dir)))


def topic_prob(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    t = tokens(spark, sf_dir)
    state = F.transform("w", lambda x: F.when(F.length(x) >= TOPIC_LENGTH, 1).otherwise(2))
    return _rounded(X.topic_share(t.withColumn("s", state), ORDER, kind=kind))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.token_rows(table(spark, sf_dir, "eval_items"), ["item_id"])


def _needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, ngram) that the evaluation texts can look up."""
    return C.count_ngrams(_items(spark, sf_dir), ORDER).select("ord", "ngram")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the model that the evaluation texts need."""
    return checkpoint(S.kneser_ney(counted(spark, sf_dir), ORDER, 3, needed=_needed(spark, sf_dir)))


def eval_match_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of the evaluation texts are matched: by context length and matched order."""
    m = _masked(spark, sf_dir)
    seen, _ = E.contexts(_items(spark, sf_dir), m, ORDER, ["item_id"])
    return E.longest_match(seen, m).groupBy("ctx", "ord").agg(F.sum("cnt").alias("n"))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and back-off of every distinct context of the evaluation texts."""
    m = _masked(spark, sf_dir)
    seen, _ = E.contexts(_items(spark, sf_dir), m, ORDER, ["item_id"])
    s = E.longest_match(seen, m)
    return s.select("ctx", "ngram", "cnt", "ord", log10(F.col("prob")).alias("log10prob"), (F.round("ln_bow", 6) + 0.0).alias("ln_bow"))


def _perplexity(p: DataFrame) -> DataFrame:
    return p.select("n_words", "n_oov", "n_zero", F.round("entropy", 6).alias("entropy"), F.round("perplexity", 3).alias("perplexity"))


def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _masked(spark, sf_dir)
    return _perplexity(E.perplexity(_items(spark, sf_dir), m, ORDER, ["item_id"]))


def closed_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity by the closed-vocabulary model: many OOV words reset the context."""
    from .lm import closed_vocab_counts

    m = checkpoint(S.kneser_ney(closed_vocab_counts(spark, sf_dir), ORDER, 3, closed=True, needed=_needed(spark, sf_dir)))
    return _perplexity(E.perplexity(_items(spark, sf_dir), m, ORDER, ["item_id"]))


# component models: English messages and all others


def _parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    english = F.coalesce(F.col("lang"), F.lit("")) == "en"
    return at_once(*[lambda w=w: checkpoint(C.count_ngrams(tokens(spark, sf_dir, w), ORDER)) for w in (english, ~english)])


def _components(spark: SparkSession, sf_dir: str) -> tuple[list[DataFrame], list[DataFrame]]:
    parts = _parts(spark, sf_dir)
    return parts, at_once(*[lambda c=c: checkpoint(S.kneser_ney(c, ORDER, 3)) for c in parts])


def lm_merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merged_keys(_parts(spark, sf_dir))


def lm_refill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both components over the merged keys, missing probabilities filled from back-off."""
    _, models = _components(spark, sf_dir)
    rows = M.refill(checkpoint(M.stacked(models)), ORDER)
    out = [
        rows[o].select("ord", "ngram", log10(F.element_at("p", 1)).alias("p1"), log10(F.element_at("p", 2)).alias("p2"))
        for o in rows
    ]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _li(spark: SparkSession, sf_dir: str, needed: DataFrame | None = None) -> DataFrame:
    _, models = _components(spark, sf_dir)
    return I.interpolate(models, ORDER, I.Mixture([[0.4]], [[[], []]], [[], []]), needed=needed)


def realigned_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English component smoothed again over the n-grams of both components."""
    parts = _parts(spark, sf_dir)
    c = checkpoint(M.realign(parts[0], M.merged_keys(parts)))
    return _model(S.kneser_ney(c, ORDER, 3))


def masked_cm_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count merging of only what the evaluation texts need: the probabilities of their n-grams."""
    parts, models = _components(spark, sf_dir)
    fs = I.count_merging_features([C.keyed(C.effective_counts(c, ORDER)) for c in parts])
    needed = checkpoint(_needed(spark, sf_dir))
    m = I.interpolate(models, ORDER, I.default_mixture(2, ORDER, fs), I.NO_COUNT, needed)
    return _model(m).join(needed, ["ord", "ngram"], "left_semi")


def masked_vocab_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity where only words of at least four characters are in the vocabulary."""
    m = _masked(spark, sf_dir)
    words = m.where("ord = 1").select(F.col("ngram").alias("word")).where(F.length("word") >= 4)
    return _perplexity(E.perplexity(_items(spark, sf_dir), m, ORDER, ["item_id"], vocab=words))


def li_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(_li(spark, sf_dir))


def cm_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, models = _components(spark, sf_dir)
    eff = [C.keyed(C.effective_counts(c, ORDER)) for c in parts]
    return _model(I.interpolate(models, ORDER, I.default_mixture(2, ORDER, I.count_merging_features(eff)), I.NO_COUNT))


def gli_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature, ln(1 + total effective count of the history), with coefficients 0.7 and 0.5 and biases by order."""
    parts, models = _components(spark, sf_dir)
    fs = []
    for c in parts:
        eff = C.effective_counts(c, ORDER).select("ord", "ngram", F.col("eff").cast("double").alias("value"))
        fs.append([X.FUNCTIONS["log1p"](X.FUNCTIONS["sumhist"](eff))])
    mixture = I.Mixture([[0.1], [0.2], [0.3]], [[[0.7], [0.5]]], fs)
    return _model(I.interpolate(models, ORDER, mixture))


def interp_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity by the linear interpolation, of which only the needed rows are mixed."""
    m = checkpoint(_li(spark, sf_dir, _needed(spark, sf_dir)))
    return _perplexity(E.perplexity(_items(spark, sf_dir), m, ORDER, ["item_id"]))


def loaded_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered models: of repeated deliveries the last, then per n-gram the mean probability over the models."""
    rows = table(spark, sf_dir, "lm_entries")
    last = rows.groupBy("model_id", "ord", "ngram").agg(
        F.max_by(F.struct("prob", "bow"), F.struct(F.coalesce("loaded_at", F.lit("1970-01-01").cast("timestamp")), "entry_id")).alias("v")
    )
    return last.groupBy("ord", "ngram").agg(
        F.count(F.lit(1)).alias("n_models"), (F.round(F.avg("v.prob"), 12) + F.lit(0.0)).alias("prob")
    )


_FUNCTIONS = {
    "feat_log": "log", "feat_log1p": "log1p", "feat_pow2": "pow2", "feat_pow3": "pow3", "feat_norm": "norm",
    "feat_sumhist": "sumhist", "feat_log_sumhist": "log:sumhist",
}
_TOPICS = {"topic_prob_hist": "hist", "topic_prob_word": "word", "topic_prob_wordtopic": "wordtopic"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        **{n: partial(feature_function, text=t) for n, t in _FUNCTIONS.items()},
        **{n: partial(topic_prob, kind=k) for n, k in _TOPICS.items()},
    }
    made = (
        doc_freq, doc_entropy, eval_match_orders, eval_scores, perplexity, closed_perplexity, lm_merge_keys, lm_refill,
        li_model, cm_model, gli_model, interp_perplexity, loaded_merge, realigned_model, masked_cm_model, masked_vocab_perplexity,
    )
    return out | {f.__name__: f for f in made}


# -- SQL ---------------------------------------------------------------------------------------------------------------


def matching(model: str = "lm", order: int = ORDER, vocab: str = "ord = 1") -> str:
    """CTEs ctx(ctx, ngram, cnt), hit(ctx, ngram, cnt, ord, prob, ln_bow) and oov over the evaluation texts."""
    return f"""it AS ({ITEMS}), pos AS (
    SELECT item_id, line_no, i - 1 AS i, w[i] AS word, w[greatest(i - {order - 1}, 1):i] AS l
    FROM (SELECT item_id, line_no, w, unnest(range(2, len(w) + 1)) AS i FROM it)),
  known AS (SELECT pos.*, u.ngram IS NULL AS oov FROM pos LEFT JOIN (SELECT ngram FROM {model} WHERE {vocab} AND ord = 1) u ON u.ngram = pos.word),
  len AS (SELECT *, least({order}, i - coalesce(max(CASE WHEN oov THEN i END) OVER (
      PARTITION BY item_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS ctx FROM known),
  oov AS (SELECT * FROM len WHERE oov),
  ctx AS (SELECT ctx, array_to_string(l[len(l) - ctx + 1:len(l)], ' ') AS ngram, count(*) AS cnt FROM len WHERE NOT oov GROUP BY 1, 2),
  try AS (SELECT ctx, ngram, cnt, o, array_to_string(w[ctx - o + 1:ctx], ' ') AS gram, array_to_string(w[ctx - o + 1:ctx - 1], ' ') AS h
    FROM (SELECT *, string_split(ngram, ' ') AS w, unnest(range(1, ctx + 1)) AS o FROM ctx)),
  tried AS (SELECT t.*, g.prob, CASE WHEN o > 1 THEN b.bow END AS bow, max(CASE WHEN g.prob IS NOT NULL THEN o END) OVER (PARTITION BY t.ctx, t.ngram) AS best
    FROM try t LEFT JOIN {model} g ON g.ord = t.o AND g.ngram = t.gram LEFT JOIN {model} b ON b.ord = t.o - 1 AND b.ngram = t.h),
  hit AS (SELECT ctx, ngram, any_value(cnt) AS cnt, any_value(best) AS ord, max(CASE WHEN o = best THEN prob END) AS prob,
      max(CASE WHEN o = best THEN gram END) AS gram, coalesce(sum(CASE WHEN o > best THEN ln(bow) END), 0) AS ln_bow FROM tried GROUP BY ctx, ngram)"""


PERPLEXITY = """SELECT n_words, (SELECT count(*) FROM oov) AS n_oov, n_zero, round(-t / (n_words - n_zero), 6) AS entropy,
  round(exp(-t / (n_words - n_zero)), 3) AS perplexity FROM (
    SELECT CAST(sum(cnt) AS BIGINT) AS n_words, count(DISTINCT CASE WHEN prob = 0 THEN gram END) AS n_zero,
      sum(cnt * (CASE WHEN prob > 0 THEN ln(prob) ELSE 0 END + ln_bow)) AS t FROM hit)"""


def _component(p: str, where: str) -> str:
    tok = Q.tokens(where=where)
    return (
        f"{Q.counts(ORDER, p + 'c', tok, p)}, {Q.effective(ORDER, p + 'c', p + 'e')}, {Q.discounts(3, p + 'e', p + 'd')}, "
        f"{Q.kneser_ney(ORDER, 3, e=p + 'e', d=p + 'd', p=p)}"
    )


COMPONENTS = _component("a", "coalesce(lang, '') = 'en'") + ", " + _component("b", "coalesce(lang, '') <> 'en'")


def refilled() -> str:
    """CTEs r1 .. r3 (ord, ngram, hist, suffix, word, p1, p2, b1, b2)."""
    out = f"""keys AS (SELECT ord, ngram FROM ac UNION SELECT ord, ngram FROM bc),
  st AS (SELECT k.ord, k.ngram, coalesce(x.prob, 0) AS p1, coalesce(y.prob, 0) AS p2, coalesce(x.bow, 1) AS b1, coalesce(y.bow, 1) AS b2
    FROM keys k LEFT JOIN alm x USING (ord, ngram) LEFT JOIN blm y USING (ord, ngram)),
  sk AS (SELECT *, {Q.KEYS} FROM st),
  r1 AS (SELECT * FROM sk WHERE ord = 1)"""
    for o in range(2, ORDER + 1):
        fill = ", ".join(
            f"CASE WHEN s.p{i} = 0 THEN coalesce(l.p{i}, 0) * coalesce(h.b{i}, 1) ELSE s.p{i} END AS p{i}" for i in (1, 2)
        )
        out += f""",
  r{o} AS (SELECT s.* REPLACE ({fill}) FROM sk s LEFT JOIN r{o - 1} l ON s.suffix = l.ngram LEFT JOIN r{o - 1} h ON s.hist = h.ngram WHERE s.ord = {o})"""
    return out


def mixed(weights: list[str], extra: str = "") -> str:
    """CTEs m1 .. m3 and lm of the interpolated model.  weights: SQL of the log weights of both models, by order."""
    out = []
    for o in range(1, ORDER + 1):
        w1, w2 = (x.format(o=o) for x in weights)
        out.append(f"""m{o} AS (
    SELECT ord, ngram, hist, suffix, word, (exp(l1 - greatest(l1, l2)) * p1 + exp(l2 - greatest(l1, l2)) * p2) / (exp(l1 - greatest(l1, l2)) + exp(l2 - greatest(l1, l2))) AS prob
    FROM (SELECT r.*, {w1} AS l1, {w2} AS l2 FROM r{o} r {extra.format(o=o, h=o - 1)}))""")
        if o > 1:
            out.append(f"""g{o} AS (
    SELECT {o - 1} AS ord, m.hist AS ngram, CASE WHEN 1 - sum(coalesce(l.prob, 0)) > 1e-9
      THEN greatest((1 - sum(m.prob)) / (1 - sum(coalesce(l.prob, 0))), 0) ELSE 0 END AS bow
    FROM m{o} m LEFT JOIN m{o - 1} l ON m.suffix = l.ngram GROUP BY m.hist)""")
    union = " UNION ALL ".join(f"SELECT * FROM m{o}" for o in range(1, ORDER + 1))
    bows = " UNION ALL ".join(f"SELECT * FROM g{o}" for o in range(2, ORDER + 1))
    return ", ".join(out) + f", lm AS (SELECT a.*, b.bow FROM ({union}) a LEFT JOIN ({bows}) b USING (ord, ngram))"


_TOTALS = "ta AS (SELECT ord, hist, sum(eff) AS t FROM ae GROUP BY ord, hist), tb AS (SELECT ord, hist, sum(eff) AS t FROM be GROUP BY ord, hist)"
_JOIN = "LEFT JOIN ta ON ta.ord = {o} AND ta.hist = r.hist LEFT JOIN tb ON tb.ord = {o} AND tb.hist = r.hist"


def oracle_sql() -> dict[str, str]:
    eff = f"WITH {Q.counts(ORDER)}, {Q.effective(ORDER)}"
    value = "round({}, 6) + 0.0 AS value"
    each = {
        "feat_log": "ln(eff + 1e-99)", "feat_log1p": "ln(eff + 1.0)", "feat_pow2": "CAST(eff AS DOUBLE) * eff",
        "feat_pow3": "CAST(eff AS DOUBLE) * eff * eff", "feat_norm": "eff / CAST(max(eff) OVER (PARTITION BY ord) AS DOUBLE)",
    }
    out = {n: f"{eff} SELECT ord, ngram, {value.format(x)} FROM e" for n, x in each.items()}
    hist_sum = "SELECT ord - 1 AS ord, hist AS ngram, {} FROM e GROUP BY ord, hist"
    out["feat_sumhist"] = f"{eff} {hist_sum.format(value.format('CAST(sum(eff) AS DOUBLE)'))}"
    out["feat_log_sumhist"] = f"{eff} {hist_sum.format(value.format('ln(CAST(sum(eff) AS DOUBLE) + 1e-99)'))}"
    by_doc = f"WITH tok AS ({Q.tokens()}), occ AS ({Q.occurrences(ORDER, keep='doc_id')}), n AS (SELECT count(DISTINCT doc_id) AS n FROM tok)"
    out["doc_freq"] = f"""{by_doc} SELECT ord, ngram, round(count(DISTINCT doc_id) / CAST((SELECT n FROM n) AS DOUBLE), 6) + 0.0 AS value
      FROM occ GROUP BY ord, ngram"""
    out["doc_entropy"] = f"""{by_doc}, c AS (SELECT ord, ngram, doc_id, CAST(count(*) AS DOUBLE) AS c FROM occ GROUP BY ord, ngram, doc_id)
      SELECT ord, ngram, round((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(CAST((SELECT n FROM n) AS DOUBLE)), 6) + 0.0 AS value
      FROM c GROUP BY ord, ngram"""
    topics = " UNION ALL ".join(
        f"""SELECT {o} AS ord, unnest(list_transform(range({max(2, o)}, len(w) + 1), lambda i: {{'g': w[i-{o - 1}:i]}}), recursive := true) AS g FROM tok"""
        for o in range(1, ORDER + 1)
    )
    top = f"WITH tok AS ({Q.tokens()}), occ AS (SELECT ord, array_to_string(g, ' ') AS ngram, g FROM ({topics}))"
    out["topic_prob_hist"] = f"""{top} SELECT ord, ngram, round(avg(CASE WHEN len(list_filter(g, lambda x: length(x) >= {TOPIC_LENGTH})) > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value
      FROM occ GROUP BY ord, ngram"""
    out["topic_prob_word"] = f"{top} SELECT ord, ngram, round(avg(CASE WHEN length(g[-1]) >= {TOPIC_LENGTH} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value FROM occ GROUP BY ord, ngram"
    out["topic_prob_wordtopic"] = f"""{top} SELECT ord - 1 AS ord, CASE WHEN ord = 1 THEN '' ELSE array_to_string(g[1:ord - 1], ' ') END AS ngram,
      round(avg(CASE WHEN length(g[-1]) >= {TOPIC_LENGTH} THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value FROM occ GROUP BY 1, 2"""
    out["eval_match_orders"] = f"{_kn()}, {matching()} SELECT ctx, ord, CAST(sum(cnt) AS BIGINT) AS n FROM hit GROUP BY ctx, ord"
    out["eval_scores"] = f"{_kn()}, {matching()} SELECT ctx, ngram, cnt, ord, {Q.log10('prob')} AS log10prob, round(ln_bow, 6) + 0.0 AS ln_bow FROM hit"
    out["perplexity"] = f"{_kn()}, {matching()} {PERPLEXITY}"
    from .lm import _closed

    out["closed_perplexity"] = f"{_kn(counts=_closed(), closed=True)}, {matching()} {PERPLEXITY}"
    out["lm_merge_keys"] = f"WITH {COMPONENTS} SELECT ord, ngram FROM ac UNION SELECT ord, ngram FROM bc"
    p12 = f"SELECT ord, ngram, {Q.log10('p1')} AS p1, {Q.log10('p2')} AS p2 FROM"
    out["lm_refill"] = f"WITH {COMPONENTS}, {refilled()} {p12} r1 UNION ALL {p12} r2 UNION ALL {p12} r3"
    base = f"WITH {COMPONENTS}, {refilled()}"
    out["li_model"] = f"{base}, {mixed(['0.0', '0.4'])} {MODEL}"
    out["interp_perplexity"] = f"{base}, {mixed(['0.0', '0.4'])}, {matching()} {PERPLEXITY}"
    cm = ["ln(coalesce(ta.t, 0) + 1e-99)", "ln(coalesce(tb.t, 0) + 1e-99)"]
    out["cm_model"] = f"{base}, {_TOTALS}, {mixed(cm, _JOIN)} {MODEL}"
    gli = ["0.7 * ln(1.0 + coalesce(ta.t, 0))", "{o} * 0.1 + 0.5 * ln(1.0 + coalesce(tb.t, 0))"]
    out["gli_model"] = f"{base}, {_TOTALS}, {mixed(gli, _JOIN)} {MODEL}"
    keys = "keys AS (SELECT ord, ngram FROM ac UNION SELECT ord, ngram FROM bc)"
    tok = Q.tokens(where="coalesce(lang, '') = 'en'"), Q.tokens(where="coalesce(lang, '') <> 'en'")
    realigned = f"""{Q.counts(ORDER, 'ac', tok[0], 'a')}, {Q.counts(ORDER, 'bc', tok[1], 'b')}, {keys},
      c AS (SELECT *, {Q.KEYS} FROM (SELECT k.ord, k.ngram, coalesce(x.cnt, 0) AS cnt FROM keys k LEFT JOIN ac x USING (ord, ngram)))"""
    out["realigned_model"] = f"{_kn(counts=realigned)} {MODEL}"
    out["masked_cm_model"] = f"""{base}, {_TOTALS}, {mixed(cm, _JOIN)}, {Q.counts(ORDER, "need", ITEMS, "n")}
      SELECT m.* FROM ({MODEL}) m SEMI JOIN need USING (ord, ngram)"""
    out["masked_vocab_perplexity"] = f"{_kn()}, {matching(vocab='length(ngram) >= 4')} {PERPLEXITY}"
    out["loaded_merge"] = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY model_id, ord, ngram
        ORDER BY coalesce(loaded_at, TIMESTAMPTZ '1970-01-01 00:00:00+00') DESC, entry_id DESC) AS r FROM lm_entries)
      SELECT ord, ngram, count(*) AS n_models, round(avg(prob), 12) + 0.0 AS prob FROM l WHERE r = 1 GROUP BY ord, ngram"""
    return out
