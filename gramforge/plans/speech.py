"""Registered queries of lattices, tuning, files and vector functions."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import counts as C
from ..operators import features as X
from ..operators import interpolate as I
from ..operators import lattice as L
from ..operators import smoothing as S
from ..operators import text as T
from ..operators import tune
from ..session import checkpoint, checkpoint_dir
from ..sources import files
from ..streaming import counts as stream
from . import lm_sql as Q
from .lm import ITEMS, MODEL, ORDER, SHOWN, _kn, _model, counted, kn, log10, table, tokens

LATTICE_ORDER = 2


# Every line of an evaluation text with two words or more is a lattice: a chain of its words (base weight 1), and beside
# every third word an alternative, the line's next word (the first after the last), with base weight 0.5 and a node of its
# own that leads on to the following word.  Node 2i is reached by word i, node 2i - 1 by the alternative of word i.


def _lattice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.token_rows(table(spark, sf_dir, "eval_items"), ["item_id"]).where(F.size("w") >= 4)
    tag = F.concat(F.col("item_id").cast("string"), F.lit("-"), F.col("line_no").cast("string"))
    return t.select(tag.alias("tag"), F.slice("w", 2, F.size("w") - 2).alias("words"))


def lattice_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lattice_lines(spark, sf_dir).select("tag", F.size("words").alias("n"), F.posexplode("words").alias("p", "word"), "words")
    i = F.col("p") + 1
    arc = lambda slot, src, dst, word, w: F.struct(
        (4 * i - slot).cast("int").alias("arc"), src.cast("int").alias("src"), dst.cast("int").alias("dst"),
        word.alias("word"), F.lit(w).alias("base_w"),
    )
    none = F.array().cast("array<struct<arc:int,src:int,dst:int,word:string,base_w:double>>")
    third = i % 3 == 0
    other = F.element_at("words", F.when(i < F.col("n"), i + 1).otherwise(1).cast("int"))
    after = F.when(i < F.col("n"), F.array(arc(1, 2 * i - 1, 2 * (i + 1), F.element_at("words", F.least(i + 1, F.col("n")).cast("int")), 1.0)))
    end = F.lit(T.BOUNDARY)
    arcs = F.concat(
        F.array(arc(3, 2 * (i - 1), 2 * i, F.col("word"), 1.0)),
        F.when(third, F.array(arc(2, 2 * (i - 1), 2 * i - 1, other, 0.5))).otherwise(none),
        F.when(third, F.coalesce(after, F.array(arc(1, 2 * i - 1, 2 * i + 1, end, 0.0)))).otherwise(none),
        F.when(i == F.col("n"), F.array(arc(0, 2 * i, 2 * i + 1, end, 0.0))).otherwise(none),
    )
    return rows.select("tag", F.explode(arcs).alias("a")).select("tag", "a.*")


def _lattice_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the documents and the evaluation texts, so that lattices have no unknown word."""
    items = T.token_rows(table(spark, sf_dir, "eval_items"), ["item_id"]).select("w")
    return C.count_ngrams(tokens(spark, sf_dir).select("w").unionByName(items), LATTICE_ORDER)


def _rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattices rescored by the rows of the model that they need."""
    arcs = checkpoint(lattice_arcs(spark, sf_dir))
    needed = checkpoint(L.needed_ngrams(arcs, LATTICE_ORDER))
    m = checkpoint(S.kneser_ney(_lattice_counts(spark, sf_dir), LATTICE_ORDER, 3, needed=needed))
    return L.rescore(arcs, m, LATTICE_ORDER)


def _utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.utterances(_rescored(spark, sf_dir), _lattice_lines(spark, sf_dir))


def lattice_rescore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rescored(spark, sf_dir).select("tag", "src", "dst", "word", (F.round("weight", 6) + 0.0).alias("weight"))


def lattice_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utterances(spark, sf_dir).select("tag", F.round("best_score", 5).alias("best_score"))


def _five(c: str) -> Column:
    return (F.round(c, 5) + F.lit(0.0)).alias(c)


def lattice_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best words and cost, errors, oracle errors and cost, and margin of each lattice."""
    u = _utterances(spark, sf_dir)
    return u.select(
        "tag", _five("best_score"), F.array_join("words", " ").alias("words"), "n_ref", "n_errors", "oracle_errors",
        _five("oracle_score"), _five("margin"),
    )


def lattice_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines `tag<TAB>confidence`."""
    return files.confidence_lines(_utterances(spark, sf_dir))


def lattice_error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines `tag<TAB>words<TAB>errors`."""
    return files.word_error_lines(_utterances(spark, sf_dir)).select("value")


def lattice_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WER, oracle WER and mean margin of all lattices."""
    u = L.word_error_rate(_utterances(spark, sf_dir))
    return u.select("n_lattices", _five("wer"), _five("oracle_wer"), _five("margin"))


def lattice_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.arc_posteriors(_rescored(spark, sf_dir)).select("tag", "arc", _five("posterior"))


def lattice_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.round("position", 9) + F.lit(0.0)  # places are often small fractions: five digits would fall on ties
    return L.arc_positions(_rescored(spark, sf_dir)).select("tag", "arc", position.alias("position"))


def lattice_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.n_best(_rescored(spark, sf_dir), 3).select("tag", "rank", _five("score"))


def lattice_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.transcripts(_utterances(spark, sf_dir)).select("value")


def lattice_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattices in their text form and parsed again."""

    def text(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tag": [g["tag"].iloc[0]], "text": [L.format_fst(g.sort_values(["src", "dst", "arc"]))]})

    texts = lattice_arcs(spark, sf_dir).groupBy("tag").applyInPandas(text, "tag string, text string")
    return L.parse_lattices(texts).select("tag", "src", "dst", "word", "base_w")


def lattice_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiled lattices, read again."""
    name = _scratch(spark) + "/arcs"
    files.compile_lattices(lattice_arcs(spark, sf_dir), name)
    return files.read_table(spark, name)


def _result(spark: SparkSession, kind: str, m: tune.Minimum, before: float) -> DataFrame:
    """The value at the default parameters, whether tuning improved it, and whether it stayed finite."""
    row = (kind, round(float(before), 5) + 0.0, bool(m.value <= before + 1e-12), len(m.x))
    return spark.createDataFrame([row], "kind string, before double, no_worse boolean, n_params int")


def _dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.token_rows(table(spark, sf_dir, "eval_items").where("purpose = 'opt-perp'"), ["item_id"])


def tuned_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of the tuning texts before discounts are tuned on them by Powell and by L-BFGS, and whether that helped."""
    c = checkpoint(counted(spark, sf_dir))
    s = tune.kneser_ney_statistics(c, tune.held_out_contexts(c, _dev(spark, sf_dir), ORDER, ["item_id"]), ORDER, 3)
    before = s.entropy(s.default)
    a, b = (_result(spark, t, tune.tune_perplexity(s, t), before) for t in ("Powell", "LBFGS"))
    return a.unionByName(b)


def tuned_feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for discounts and the weight of one feature, ln(1 + effective count)."""
    c = checkpoint(counted(spark, sf_dir, 2))
    f = checkpoint(C.effective_counts(c, 2).select("ord", "ngram", F.array(F.log1p("eff")).alias("f")))
    s = tune.weighted_statistics(c, tune.held_out_contexts(c, _dev(spark, sf_dir), 2, ["item_id"]), 2, 1, f, 1)
    return _result(spark, "LBFGS", tune.tune_perplexity(s, "LBFGS"), s.entropy(s.default))


def tuned_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the biases of linear interpolation and of count merging of two component models."""
    from .mix import _components

    parts, models = _components(spark, sf_dir)
    looked = checkpoint(tune.mixture_contexts(models, _dev(spark, sf_dir), ORDER, ["item_id"]))
    li = tune.mixture_statistics(models, looked, ORDER)
    fs = I.count_merging_features([C.keyed(C.effective_counts(c, ORDER)) for c in parts])
    cm = tune.mixture_statistics(models, looked, ORDER, I.default_mixture(2, ORDER, fs), I.NO_COUNT)
    a, b = (_result(spark, k, s.tune("LBFGS"), s.entropy(s.default)) for k, s in (("LI", li), ("CM", cm)))
    return a.unionByName(b)


def tuned_lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WER and negative margin before discounts are tuned for them, and whether that helped."""
    c = checkpoint(_lattice_counts(spark, sf_dir))
    o = tune.LatticeObjective(c, checkpoint(lattice_arcs(spark, sf_dir)), _lattice_lines(spark, sf_dir), LATTICE_ORDER, 1)
    wer, margin = o.word_error_rate(o.s.default), o.negative_margin(o.s.default)
    a = _result(spark, "wer", o.tune("wer", "Powell"), wer)
    return a.unionByName(_result(spark, "margin", o.tune("margin", "Powell"), margin))


# -- files -------------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    """A new folder's URI within the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def counts_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as a table and read again."""
    name = _scratch(spark) + "/counts"
    files.write_counts(counted(spark, sf_dir), name, binary=True)
    return files.read_table(spark, name).select("ord", "ngram", "cnt")


def counts_text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts written as compressed text and read again."""
    name = _scratch(spark) + "/counts.gz"
    files.write_counts(counted(spark, sf_dir), name)
    return files.counts(spark, name, ORDER).select("ord", "ngram", "cnt")


def vocab_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _scratch(spark) + "/vocab"
    files.write_vocab(counted(spark, sf_dir, 1), name)
    return files.vocab(spark, name).select("word")


def model_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model written as a table, recognised and read again."""
    name = _scratch(spark) + "/model"
    files.write_model(kn(spark, sf_dir), name, ORDER, binary=True)
    return _model(files.read_model(spark, name, ORDER))


def features_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln(1 + effective count) written as a feature file and read again for all n-grams."""
    name = _scratch(spark) + "/features"
    c = checkpoint(counted(spark, sf_dir))
    f = C.effective_counts(c, ORDER).select("ord", "ngram", F.log1p("eff").alias("value"))
    files.write_features(f, name)
    aligned = X.align(files.features(spark, name), c.select("ord", "ngram"))
    return aligned.select("ord", "ngram", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def params_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts of order 2 written as parameters and read again."""
    name = _scratch(spark) + "/params"
    d = S.discounts(C.effective_counts(counted(spark, sf_dir), ORDER), 3).where("ord = 2").first()["d"]
    files.write_params(d, name)
    return spark.createDataFrame([(i + 1, round(x, 9)) for i, x in enumerate(files.read_params(name, 3))], "i int, d double")


def _item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation texts (240, fixed) in the order of their ids."""
    return table(spark, sf_dir, "eval_items").where("text is not null").select("item_id", "text")


def documents_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation texts as documents of one corpus file, read again: document frequencies."""
    name = _scratch(spark) + "/corpus"
    items = _item_lines(spark, sf_dir).orderBy("item_id").coalesce(1)
    marked = F.concat(F.lit("<DOC "), F.col("item_id").cast("string"), F.lit(">\n"), F.col("text"), F.lit("\n</DOC>"))
    items.select(marked.alias("value")).write.text(name)
    f = X.document_frequency(files.documents(spark, name), 2)
    return f.select("ord", "ngram", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def topics_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation texts as lines of words, states and topics, read again: shares of topic words (state 1)."""
    name = _scratch(spark) + "/topics"
    t = T.token_rows(table(spark, sf_dir, "eval_items"), ["item_id"]).where(F.size("w") > 2)
    words = t.select("item_id", "line_no", F.posexplode(F.slice("w", 2, F.size("w") - 1)).alias("i", "word"))
    state = F.when(F.col("word") == T.BOUNDARY, 0).when(F.length("word") >= 6, 1).otherwise(2)
    lines = words.orderBy("item_id", "line_no", "i").coalesce(1)
    lines.select(F.concat_ws("\t", "word", state.cast("string"), F.lit("0")).alias("value")).write.text(name)
    f = X.topic_share(files.hmm_lda(spark, name), 2, kind="word")
    return f.select("ord", "ngram", (F.round("value", 6) + F.lit(0.0)).alias("value"))


def arpa_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model as ARPA lines."""
    return files.arpa_lines(kn(spark, sf_dir), ORDER)[0].where("part = 1 and sub >= 0").select("ord", "value")


def counts_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.counts_lines(counted(spark, sf_dir))[0].select("ord", "value")


def arpa_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model written as an ARPA file in parts and read again: rows, and the largest difference of log10 values."""
    m = checkpoint(kn(spark, sf_dir))
    folder = _scratch(spark) + "/lm"
    rows, sort = files.arpa_lines(m, ORDER)
    rows.orderBy(*sort).select("value").write.text(folder)
    again = files.arpa(spark, folder, ORDER)
    a = m.select("ord", "ngram", F.col("prob").alias("p"), F.coalesce("bow", F.lit(1.0)).alias("b"))
    b = again.select("ord", "ngram", F.col("prob").alias("q"), F.coalesce("bow", F.lit(1.0)).alias("c"))
    d = lambda x, y: F.abs(log10(F.col(x)) - log10(F.col(y)))
    return a.join(b, ["ord", "ngram"], "full").groupBy("ord").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("p").isNull() | F.col("q").isNull()).alias("n_alone"),
        (F.max(d("p", "q")) < 2e-6).alias("probs_agree"),
        (F.max(d("b", "c")) < 2e-6).alias("bows_agree"),
    )


def vector_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reductions and element-wise functions over the count vector of each order."""
    c = table(spark, sf_dir, "ngram_counts").withColumn("x", F.coalesce(F.col("cnt"), F.lit(0)).cast("double"))
    x = F.col("x")
    return c.groupBy("ord").agg(
        V.any_true(x > 100).alias("any_large"),
        V.all_true(x >= 0).alias("all_positive"),
        V.dot(x, x).alias("dot"),
        F.sum(x).alias("total"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.sum(F.greatest(x, F.lit(3.0)) - F.least(x, F.lit(5.0))).alias("between"),
        F.round(F.sum(F.when(V.is_finite(F.log10(x + 1)), F.sqrt(x))), 4).alias("roots"),
        F.sum(V.condition(x > 2, x * 2, -x)).alias("conditional"),
        F.sum(F.floor(x / 2).cast("int")).alias("halves"),
    )


def vector_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped histogram of counts."""
    return V.bin_clipped_count(table(spark, sf_dir, "ngram_counts"), "cnt", 10)


def vector_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked group sums looked up again by key, with a default."""
    c = table(spark, sf_dir, "ngram_counts")
    w = V.bin_weight(c.where("corpus is not null"), "corpus", "cnt", F.col("ord") == 1)
    names = table(spark, sf_dir, "corpora").select("corpus")
    return V.lookup(names, w, "corpus", "total", -1)


def vector_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each corpus."""
    return V.bin_count(table(spark, sf_dir, "ngram_counts").where("corpus is not null"), "corpus")


def vector_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpora's numbers of lines, with the numbers of their rows assigned where they have any."""
    n = vector_counts(spark, sf_dir).withColumnRenamed("n", "n_lines")
    return V.index_assign(table(spark, sf_dir, "corpora").select("corpus", "n_lines"), n, "corpus", "n_lines")


def streamed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n-gram counts of the documents read as a stream, kept per micro-batch and added up."""
    docs = spark.readStream.schema(table(spark, sf_dir, "documents").schema).option("maxFilesPerTrigger", 8)
    folder = _scratch(spark)
    path = f"{sf_dir}/documents.parquet"
    docs = docs.parquet(path if os.path.isdir(path) else f"{sf_dir}/documents.parque[t]")
    stream.merge_counts(docs, 2, f"{folder}/counts", f"{folder}/state").awaitTermination()
    return stream.total_counts(spark.read.parquet(f"{folder}/counts"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        lattice_arcs, lattice_rescore, lattice_best_score, lattice_utterances, lattice_wer, lattice_posteriors,
        lattice_positions, lattice_n_best, lattice_transcripts, lattice_confidence, lattice_error_lines,
        lattice_text_round_trip, lattice_table_round_trip, tuned_discounts, tuned_feature_weights, tuned_mixture,
        tuned_lattices, counts_table_round_trip, counts_text_round_trip, vocab_round_trip, model_table_round_trip,
        features_round_trip, params_round_trip, documents_round_trip, topics_round_trip, arpa_lines,
        counts_lines, arpa_round_trip, vector_reductions, vector_bins, vector_weights, vector_counts,
        vector_assigned, streamed_counts,
    )
    return {f.__name__: f for f in made}


_LINES = f"""it AS ({ITEMS}), ll AS (SELECT item_id || '-' || line_no AS tag, w[2:len(w) - 1] AS words FROM it WHERE len(w) >= 4),
  ps AS (SELECT tag, words, len(words) AS n, unnest(range(1, len(words) + 1)) AS i FROM ll),
  arcs AS (
    SELECT tag, 4 * i - 3 AS arc, 2 * (i - 1) AS src, 2 * i AS dst, words[i] AS word, CAST(1.0 AS DOUBLE) AS base_w FROM ps
    UNION ALL SELECT tag, 4 * i - 2, 2 * (i - 1), 2 * i - 1, words[CASE WHEN i < n THEN i + 1 ELSE 1 END], 0.5 FROM ps WHERE i % 3 = 0
    UNION ALL SELECT tag, 4 * i - 1, 2 * i - 1, CASE WHEN i < n THEN 2 * (i + 1) ELSE 2 * i + 1 END, CASE WHEN i < n THEN words[i + 1] ELSE '</s>' END,
      CASE WHEN i < n THEN 1.0 ELSE 0.0 END FROM ps WHERE i % 3 = 0
    UNION ALL SELECT tag, 4 * i, 2 * i, 2 * i + 1, '</s>', 0.0 FROM ps WHERE i = n)"""
_BOTH = f"SELECT w FROM ({Q.tokens()}) UNION ALL SELECT w FROM ({ITEMS})"


def _weighed(number: int) -> str:
    """CTEs up to rs, the arcs with their weights by a bigram model with so many discounts."""
    return f"""WITH {Q.counts(2, tok_body=_BOTH)}, {Q.effective(2)}, {Q.discounts(number)}, {Q.kneser_ney(2, number)}, {_LINES},
  hx AS (SELECT DISTINCT tag, dst AS node, word AS h FROM arcs UNION SELECT DISTINCT tag, 0, '</s>' FROM arcs),
  rs AS (SELECT a.tag, a.arc, a.src, a.dst, a.word, base_w - CASE WHEN b.prob IS NOT NULL THEN ln(b.prob) ELSE ln(u.prob) + coalesce(ln(h.bow), 0) END AS weight
    FROM arcs a JOIN hx ON hx.tag = a.tag AND hx.node = a.src
    LEFT JOIN lm b ON b.ord = 2 AND b.ngram = hx.h || ' ' || a.word LEFT JOIN lm u ON u.ord = 1 AND u.ngram = a.word
    LEFT JOIN lm h ON h.ord = 1 AND h.ngram = hx.h)"""


_WEIGHED = _weighed(3)


def _add(a: str, b: str) -> str:
    """ln(exp(a) + exp(b)), where b may be null."""
    return f"CASE WHEN {b} IS NULL THEN {a} ELSE greatest({a}, {b}) + ln(1 + exp(-abs(({a}) - ({b})))) END"


def _steps(number: int = 3) -> str:
    """CTEs up to st: of each word's place the weights of its arc, the alternative's, the arc after that, and the last one."""
    return (
        _weighed(number).replace("WITH ", "WITH RECURSIVE ", 1)
        + """,
  st AS (SELECT ps.tag, ps.n, ps.i, any_value(ps.words) AS words, max(CASE WHEN arc = 4 * ps.i - 3 THEN weight END) AS main,
      max(CASE WHEN arc = 4 * ps.i - 2 THEN weight END) AS alt, max(CASE WHEN arc = 4 * ps.i - 2 THEN word END) AS alt_word,
      max(CASE WHEN arc = 4 * ps.i - 1 THEN weight END) AS nxt, max(CASE WHEN arc = 4 * ps.i THEN weight END) AS fin
    FROM ps JOIN rs ON rs.tag = ps.tag AND (rs.arc + 3) // 4 = ps.i GROUP BY ps.tag, ps.n, ps.i)"""
    )


# f and s: ln of the summed weights up to a word's node and its alternative's node, x and xs the expected steps to them;
# b, bs, y, ys the same from there to the end.
_SUMS = f"""{_steps()},
  fw AS (SELECT tag, n, i, -main AS f, CAST(NULL AS DOUBLE) AS s, CAST(1 AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS xs, nxt FROM st WHERE i = 1
    UNION ALL
    SELECT tag, n, i, f, s, exp(a - f) * (x + 1) + coalesce(exp(c - f) * (xs + 1), 0), CASE WHEN s IS NOT NULL THEN x + 1 END, nxt
    FROM (SELECT st.tag, st.n, st.i, w.f - st.main AS a, w.s - w.nxt AS c, {_add("w.f - st.main", "w.s - w.nxt")} AS f,
        w.f - st.alt AS s, w.x, w.xs, st.nxt FROM fw w JOIN st ON st.tag = w.tag AND st.i = w.i + 1)),
  bk AS (SELECT tag, n, i, -fin AS b, -nxt AS bs, CAST(1 AS DOUBLE) AS y, CASE WHEN nxt IS NOT NULL THEN CAST(1 AS DOUBLE) END AS ys FROM st WHERE i = n
    UNION ALL
    SELECT tag, n, i, b, old - nxt, exp(a - b) * (y + 1) + coalesce(exp(c - b) * (ys + 1), 0), CASE WHEN nxt IS NOT NULL THEN y + 1 END
    FROM (SELECT w.tag, w.n, w.i - 1 AS i, w.b AS old, w.b - cur.main AS a, w.bs - cur.alt AS c, {_add("w.b - cur.main", "w.bs - cur.alt")} AS b, w.y, w.ys, prev.nxt
      FROM bk w JOIN st cur ON cur.tag = w.tag AND cur.i = w.i LEFT JOIN st prev ON prev.tag = w.tag AND prev.i = w.i - 1 WHERE w.i >= 1)),
  every AS (SELECT st.*, coalesce(p.f, 0) AS f0, fw.f, fw.s, fw.x, fw.xs, bk.b, bk.bs, bk.y, bk.ys, coalesce(o.b, 0) AS b1, coalesce(o.y, 0) AS y1, coalesce(fo.x, 0) AS x1, z.b AS z
    FROM st JOIN fw USING (tag, i) JOIN bk ON bk.tag = st.tag AND bk.i = st.i LEFT JOIN fw p ON p.tag = st.tag AND p.i = st.i - 1
    LEFT JOIN bk o ON o.tag = st.tag AND o.i = st.i + 1 LEFT JOIN fw fo ON fo.tag = st.tag AND fo.i = st.i + 1 JOIN bk z ON z.tag = st.tag AND z.i = 0)"""


def _arcs(main: str, alt: str, after: str, last: str, name: str, digits: int = 5) -> str:
    """Rows (tag, arc, name) of the four kinds of arcs."""
    each = ((3, main, "true"), (2, alt, "alt IS NOT NULL"), (1, after, "nxt IS NOT NULL"), (0, last, "fin IS NOT NULL"))
    return " UNION ALL ".join(f"SELECT tag, CAST(4 * i - {k} AS INTEGER) AS arc, round({x}, {digits}) + 0.0 AS {name} FROM every WHERE {w}" for k, x, w in each)


def _best(number: int = 3) -> str:
    """CTEs up to ut: best cost and words, cost of the best path without errors, and errors, of each lattice."""
    return f"""{_steps(number)},
  vi AS (SELECT tag, n, words, i, main AS best, [words[1]] AS hyp, CAST(NULL AS DOUBLE) AS side, CAST([] AS VARCHAR[]) AS side_hyp, main AS right_, CAST(NULL AS DOUBLE) AS side_right, nxt, fin
      FROM st WHERE i = 1
    UNION ALL
    SELECT st.tag, st.n, st.words, st.i, least(w.best + st.main, coalesce(w.side + w.nxt, 1e18)),
      CASE WHEN coalesce(w.side + w.nxt, 1e18) < w.best + st.main THEN list_append(w.side_hyp, st.words[st.i]) ELSE list_append(w.hyp, st.words[st.i]) END,
      w.best + st.alt, list_append(w.hyp, st.alt_word), least(w.right_ + st.main, coalesce(w.side_right + w.nxt, 1e18)),
      CASE WHEN st.alt_word = st.words[st.i] THEN w.right_ + st.alt END, st.nxt, st.fin
    FROM vi w JOIN st ON st.tag = w.tag AND st.i = w.i + 1),
  en AS (SELECT tag, words, least(best + fin, coalesce(side + nxt, 1e18)) AS best_score, least(right_ + fin, coalesce(side_right + nxt, 1e18)) AS oracle_score,
      list_filter(CASE WHEN coalesce(side + nxt, 1e18) < best + fin THEN side_hyp ELSE hyp END, lambda x: NOT starts_with(x, '<')) AS hyp
    FROM vi WHERE i = n),
  ed AS (SELECT tag, hyp, words AS ref, 0 AS k, range(0, len(words) + 1) AS row_ FROM en
    UNION ALL
    SELECT tag, hyp, ref, k + 1, list_reduce(list_prepend([k + 1], list_transform(range(1, len(ref) + 1), lambda j: [least(row_[j + 1] + 1, row_[j] + CASE WHEN hyp[k + 1] = ref[j] THEN 0 ELSE 1 END)])),
      lambda a, c: list_append(a, least(c[1], a[-1] + 1))) FROM ed WHERE k < len(hyp)),
  ut AS (SELECT en.*, CAST(ed.row_[-1] AS INTEGER) AS n_errors FROM en JOIN ed ON ed.tag = en.tag AND ed.k = len(en.hyp))"""


_DEV = Q.tokens("eval_items", "item_id", "purpose = 'opt-perp'")


def _tuned(sql: str, rows: list[tuple[str, int]]) -> str:
    """Rows of a tuning query whose entropy before tuning is that of sql."""
    values = ", ".join(f"('{k}', {n})" for k, n in rows)
    return f"SELECT k AS kind, round(entropy, 5) AS before, true AS no_worse, n AS n_params FROM ({sql.replace(ITEMS, _DEV)}), (VALUES {values}) AS v(k, n)"


def oracle_sql() -> dict[str, str]:
    c = Q.counts(ORDER)
    from .mix import COMPONENTS, PERPLEXITY, _JOIN, _TOTALS, matching, mixed, refilled

    base = f"WITH {COMPONENTS}, {refilled()}"
    cm = ["ln(coalesce(ta.t, 0) + 1e-99)", "ln(coalesce(tb.t, 0) + 1e-99)"]
    li_before = f"{base}, {mixed(['0.0', '0.0'])}, {matching()} {PERPLEXITY}"
    cm_before = f"{base}, {_TOTALS}, {mixed(cm, _JOIN)}, {matching()} {PERPLEXITY}"
    low = f"{_kn(2, 1)}, {matching(order=2)} {PERPLEXITY}"
    wer = "round(100.0 * sum(n_errors) / sum(len(words)), 5) + 0.0"
    e = Q.effective(ORDER)
    grams = " UNION ALL ".join(
        f"SELECT {o} AS ord, unnest(list_transform(range(2, len(w) + 1), lambda i: {{'g': w[i-{o - 1}:i]}}), recursive := true) AS g FROM tok WHERE len(w) > 2"
        for o in (1, 2)
    )
    top = f"WITH tok AS ({ITEMS}), occ AS (SELECT ord, array_to_string(g, ' ') AS ngram, g FROM ({grams}))"
    lb = "printf('%.6f', log10(bow))"
    body = f"""(CASE WHEN prob > 0 THEN printf('%.6f', log10(prob)) ELSE '-99' END) || chr(9) || (CASE WHEN ngram = '</s>' THEN ngram ELSE {SHOWN} END)
      || (CASE WHEN ngram <> '</s>' AND ord < {ORDER} AND bow IS NOT NULL AND bow <> 1 THEN chr(9) || {lb} ELSE '' END)"""
    x = "CAST(coalesce(cnt, 0) AS DOUBLE)"
    return {
        "lattice_arcs": f"WITH {_LINES} SELECT tag, arc, src, dst, word, base_w FROM arcs",
        "lattice_rescore": f"{_WEIGHED} SELECT tag, src, dst, word, round(weight, 6) + 0.0 AS weight FROM rs",
        "lattice_best_score": f"""{_WEIGHED.replace('WITH ', 'WITH RECURSIVE ', 1)}, m AS MATERIALIZED (
            SELECT ll.tag, len(words) AS n, i, max(CASE WHEN src = 2 * (i - 1) AND dst = 2 * i THEN weight END) AS main,
              max(CASE WHEN src = 2 * (i - 1) AND dst = 2 * i - 1 THEN weight END) AS alt,
              max(CASE WHEN src = 2 * i - 1 THEN weight END) AS alt_next, max(CASE WHEN src = 2 * i AND dst = 2 * i + 1 AND word = '</s>' THEN weight END) AS fin
            FROM ll JOIN (SELECT *, CASE WHEN src % 2 = 1 THEN (src + 1) // 2 WHEN word = '</s>' AND dst = src + 1 AND dst % 2 = 1
              AND NOT EXISTS (SELECT 1 FROM rs z WHERE z.tag = rs.tag AND z.src = rs.dst) THEN src // 2 ELSE src // 2 + 1 END AS i FROM rs) r ON r.tag = ll.tag
            GROUP BY ll.tag, words, i),
          walk AS (
            SELECT tag, n, i, main AS best, alt AS side, alt_next, fin FROM m WHERE i = 1
            UNION ALL
            SELECT m.tag, m.n, m.i, least(w.best + m.main, coalesce(w.side + w.alt_next, 1e18)), w.best + m.alt, m.alt_next, m.fin
            FROM walk w JOIN m ON m.tag = w.tag AND m.i = w.i + 1)
          SELECT tag, round(least(best + fin, coalesce(side + alt_next, 1e18)), 5) AS best_score FROM walk WHERE i = n""",
        "lattice_utterances": f"""{_best()} SELECT tag, round(best_score, 5) AS best_score, array_to_string(hyp, ' ') AS words, CAST(len(words) AS INTEGER) AS n_ref, n_errors,
          0 AS oracle_errors, round(oracle_score, 5) AS oracle_score, round(best_score - oracle_score, 5) + 0.0 AS margin FROM ut""",
        "lattice_wer": f"""{_best()} SELECT count(*) AS n_lattices, {wer} AS wer, CAST(0 AS DOUBLE) AS oracle_wer, round(avg(best_score - oracle_score), 5) + 0.0 AS margin FROM ut""",
        "lattice_error_lines": f"{_best()} SELECT tag || chr(9) || len(words) || chr(9) || n_errors AS value FROM ut",
        "lattice_transcripts": f"{_best()} SELECT array_to_string(hyp, ' ') || ' (' || tag || ')' AS value FROM ut",
        "lattice_posteriors": f"""{_SUMS} {_arcs('exp(f0 - main + b - z)', 'exp(f0 - alt + bs - z)', 'exp(s - nxt + b1 - z)', 'exp(f - fin - z)', 'posterior')}""",
        "lattice_positions": f"""{_SUMS} {_arcs('x / (x + y)', 'xs / (xs + ys)', 'CASE WHEN i < n THEN x1 / (x1 + y1) ELSE 1 END', '1.0', 'position', 9)}""",
        "lattice_n_best": f"""{_steps()},
          nb AS (SELECT tag, n, i, [main] AS a, CAST(NULL AS DOUBLE[]) AS c, nxt, fin FROM st WHERE i = 1
            UNION ALL
            SELECT st.tag, st.n, st.i, list_sort(list_concat(list_transform(w.a, lambda x: x + st.main), coalesce(list_transform(w.c, lambda x: x + w.nxt), [])))[1:3],
              CASE WHEN st.alt IS NOT NULL THEN list_transform(w.a, lambda x: x + st.alt) END, st.nxt, st.fin
            FROM nb w JOIN st ON st.tag = w.tag AND st.i = w.i + 1),
          top AS (SELECT tag, list_sort(list_concat(list_transform(a, lambda x: x + fin), coalesce(list_transform(c, lambda x: x + nxt), [])))[1:3] AS l FROM nb WHERE i = n)
          SELECT tag, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS rank, round(unnest(l), 5) AS score FROM top""",
        "lattice_text_round_trip": f"WITH {_LINES} SELECT tag, src, dst, word, base_w FROM arcs",
        "lattice_table_round_trip": f"WITH {_LINES} SELECT tag, arc, src, dst, word, base_w FROM arcs",
        "tuned_discounts": _tuned(f"{_kn()}, {matching()} {PERPLEXITY}", [("Powell", 9), ("LBFGS", 9)]),
        "tuned_feature_weights": _tuned(low, [("LBFGS", 3)]),
        "tuned_mixture": f"{_tuned(li_before, [('LI', 1)])} UNION ALL {_tuned(cm_before, [('CM', 1)])}",
        "tuned_lattices": f"""{_best(1)} SELECT 'wer' AS kind, {wer} AS before, true AS no_worse, 2 AS n_params FROM ut
          UNION ALL SELECT 'margin', round(-avg(best_score - oracle_score), 5) + 0.0, true, 2 FROM ut""",
        "counts_table_round_trip": f"WITH {c} SELECT ord, ngram, cnt FROM c",
        "counts_text_round_trip": f"WITH {c} SELECT ord, ngram, cnt FROM c",
        "vocab_round_trip": f"WITH {Q.counts(1)} SELECT ngram AS word FROM c",
        "model_table_round_trip": f"{_kn()} {MODEL}",
        "features_round_trip": f"WITH {c}, {e} SELECT ord, ngram, round(ln(1.0 + eff), 6) + 0.0 AS value FROM e",
        "params_round_trip": f"WITH {c}, {e}, {Q.discounts(3)} SELECT CAST(i AS INTEGER) AS i, round(x, 9) AS d FROM (SELECT unnest([1, 2, 3]) AS i, unnest([d1, d2, d3]) AS x FROM d WHERE ord = 2)",
        "documents_round_trip": f"""WITH tok AS ({ITEMS}), occ AS ({Q.occurrences(2, keep='item_id')})
          SELECT ord, ngram, round(count(DISTINCT item_id) / CAST((SELECT count(*) FROM eval_items WHERE text IS NOT NULL) AS DOUBLE), 6) + 0.0 AS value FROM occ GROUP BY ord, ngram""",
        "topics_round_trip": f"{top} SELECT ord, ngram, round(avg(CASE WHEN g[-1] <> '</s>' AND length(g[-1]) >= 6 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS value FROM occ GROUP BY ord, ngram",
        "arpa_lines": f"""{_kn()} SELECT ord, {body} AS value FROM lm
          UNION ALL SELECT 1, '-99' || chr(9) || '<s>' || chr(9) || {lb} FROM lm WHERE ord = 1 AND ngram = '</s>'""",
        "counts_lines": f"WITH {c} SELECT ord, {SHOWN} || chr(9) || cnt AS value FROM c",
        "arpa_round_trip": f"WITH {c} SELECT ord, count(*) AS n, 0 AS n_alone, true AS probs_agree, true AS bows_agree FROM c GROUP BY ord",
        "vector_reductions": f"""SELECT ord, bool_or({x} > 100) AS any_large, bool_and({x} >= 0) AS all_positive, sum({x} * {x}) AS dot,
          sum({x}) AS total, min({x}) AS least, max({x}) AS most, sum(greatest({x}, 3.0) - least({x}, 5.0)) AS "between",
          round(sum(sqrt({x})), 4) AS roots, sum(CASE WHEN {x} > 2 THEN {x} * 2 ELSE -{x} END) AS conditional,
          CAST(sum(CAST(floor({x} / 2) AS INTEGER)) AS BIGINT) AS halves FROM ngram_counts GROUP BY ord""",
        "vector_bins": "SELECT cnt, count(*) AS n FROM ngram_counts WHERE cnt BETWEEN 0 AND 9 GROUP BY cnt",
        "vector_weights": """SELECT c.corpus, coalesce(CAST(t.total AS BIGINT), -1) AS total FROM corpora c LEFT JOIN (
          SELECT corpus, sum(CASE WHEN ord = 1 THEN cnt ELSE 0 END) AS total FROM ngram_counts WHERE corpus IS NOT NULL GROUP BY corpus) t USING (corpus)""",
        "vector_counts": "SELECT corpus, count(*) AS n FROM ngram_counts WHERE corpus IS NOT NULL GROUP BY corpus",
        "vector_assigned": """SELECT c.corpus, coalesce(t.n, c.n_lines) AS n_lines FROM corpora c
          LEFT JOIN (SELECT corpus, count(*) AS n FROM ngram_counts WHERE corpus IS NOT NULL GROUP BY corpus) t USING (corpus)""",
        "streamed_counts": f"WITH {Q.counts(2)} SELECT ord, ngram, cnt FROM c",
    }
