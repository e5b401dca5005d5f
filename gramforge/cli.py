"""`python -m gramforge.cli estimate|evaluate|interpolate [options]`."""

from __future__ import annotations

import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import counts as C
from .operators.smoothing import smoothing_list
from .options import Option, Options, split_list, truth
from .sources import files

log = logging.getLogger("gramforge")

_COMMON = [Option("verbose", "verb", "level of messages", "1"), Option("help", "h", "this text")]
_ORDER = Option("order", "o", "longest n-gram", "3")
_TUNE = [
    Option("params", "p", "parameters to begin with"),
    Option("opt-alg", "oa", "Powell, LBFGS or LBFGSB", "Powell"),
    Option("opt-perp", "op", "text to tune perplexity on"),
    Option("opt-wer", "ow", "lattices to tune word error rate on"),
    Option("opt-margin", "om", "lattices to tune margin on"),
]
_EVAL = [
    Option("eval-perp", "ep", "texts to compute perplexity of"),
    Option("eval-wer", "ew", "lattices to compute word error rate of"),
    Option("eval-margin", "em", "lattices to compute margin of"),
]
ESTIMATE = Options("estimate", [
    _ORDER,
    Option("vocab", "v", "vocabulary file: only its words count"),
    Option("unk", "u", "read other words as <unk>", "false"),
    Option("text", "t", "texts"),
    Option("counts", "c", "counts files"),
    Option("smoothing", "s", "ML, FixKN, FixModKN, FixKN#, KN, ModKN, KN#", "ModKN"),
    Option("weight-features", "wf", "features that weigh n-grams"),
    *_TUNE,
    Option("write-binary", "wb", "write tables instead of text", "false"),
    Option("write-params", "wp", "file for the parameters"),
    Option("write-vocab", "wv", "file for the vocabulary"),
    Option("write-counts", "wc", "file for the counts"),
    Option("write-eff-counts", "wec", "file for the effective counts"),
    Option("write-left-counts", "wlc", "file for the left-branching counts"),
    Option("write-right-counts", "wrc", "file for the right-branching counts"),
    Option("write-lm", "wl", "file for the model"),
    *_EVAL, *_COMMON,
])
EVALUATE = Options("evaluate", [
    _ORDER,
    Option("lm", "l", "model"),
    Option("vocab", "v", "keep n-grams of these words only"),
    Option("compile-lattices", "cl", "list of lattices to turn into tables"),
    Option("write-binary", "wb", "write tables instead of text", "false"),
    Option("write-vocab", "wv", "file for the vocabulary"),
    Option("write-lm", "wl", "file for the model"),
    *_EVAL, *_COMMON,
])
INTERPOLATE = Options("interpolate", [
    _ORDER,
    Option("lm", "l", "models"),
    Option("text", "t", "texts, one model of each"),
    Option("counts", "c", "counts files, one model of each"),
    Option("vocab", "v", "vocabulary file: only its words count"),
    Option("unk", "u", "read other words as <unk>", "false"),
    Option("smoothing", "s", "smoothing of each model, separated by ;", "ModKN"),
    Option("weight-features", "wf", "features that weigh n-grams, of each model, separated by ;"),
    Option("interpolation", "i", "LI, CM or GLI", "LI"),
    Option("interpolation-features", "if", "features of each model, separated by ;"),
    Option("tie-param-order", "tpo", "one set of parameters for all orders", "true"),
    Option("tie-param-lm", "tpl", "one set of coefficients for all models", "false"),
    *[o if o.name != "opt-alg" else Option("opt-alg", "oa", "Powell, LBFGS or LBFGSB", "LBFGS") for o in _TUNE],
    Option("write-binary", "wb", "write tables instead of text", "false"),
    Option("write-params", "wp", "file for the parameters"),
    Option("write-vocab", "wv", "file for the vocabulary"),
    Option("write-lm", "wl", "file for the model"),
    *_EVAL, *_COMMON,
])


def _session() -> SparkSession:
    active = SparkSession.getActiveSession()
    builder = SparkSession.builder.appName("gramforge").config("spark.sql.session.timeZone", "UTC")
    return active or builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()


def _evaluations(spark: SparkSession, model, order: int, o: dict) -> None:
    for name in split_list(o["eval-perp"] or ""):
        print(f"perplexity\t{name}\t{api.perplexity(spark, model, order, name):.3f}")
    for what, key, form in (("margin", "eval-margin", "{:.3f}"), ("wer", "eval-wer", "{:.2f}%")):
        for name in split_list(o[key] or ""):
            print(f"{what}\t{name}\t" + form.format(api.evaluate_lattices(spark, model, order, name)[what]))


def estimate(o: dict) -> None:
    spark, order = _session(), int(o["order"])
    smoothing_list(o["smoothing"], order)
    e = api.estimate(spark, order, o["text"], o["counts"], o["vocab"], truth(o["unk"]), o["smoothing"], o["weight-features"])
    if o["params"]:
        e.with_params(files.read_params(o["params"], e.n_params))
    if o["opt-perp"]:
        best = e.tune_perplexity(files.corpus(spark, o["opt-perp"]), o["opt-alg"])
        log.info("entropy %f after %d evaluations", best.value, best.evaluations)
    for what in ("margin", "wer"):
        if o[f"opt-{what}"]:
            best = e.tune_lattices(*api.load_lattices(spark, o[f"opt-{what}"]), what, o["opt-alg"])
            log.info("%s %f after %d evaluations", what, best.value, best.evaluations)
    binary = truth(o["write-binary"])
    if o["write-params"]:
        files.write_params([] if e.params is None else list(e.params), o["write-params"])
    if o["write-vocab"]:
        files.write_vocab(e.counts, o["write-vocab"])
    if o["write-counts"]:
        files.write_counts(e.counts, o["write-counts"], binary=binary)
    if o["write-eff-counts"]:
        files.write_counts(e.effective(), o["write-eff-counts"], "eff", binary)
    for side in ("left", "right"):
        if o[f"write-{side}-counts"]:
            files.write_counts(C.branching(e.counts, order, side), o[f"write-{side}-counts"], "n")
    if o["write-lm"]:
        files.write_model(e.model(), o["write-lm"], order, binary)
    if any(o[k] for k in ("eval-perp", "eval-wer", "eval-margin")):
        _evaluations(spark, e.model(), order, o)


def evaluate(o: dict) -> None:
    spark = _session()
    if not o["lm"]:
        raise ValueError("evaluate needs a model")
    model, order = api.load_model(spark, o["lm"], int(o["order"]))
    if o["vocab"]:
        words = files.vocab(spark, o["vocab"])
        keep = C.close_vocabulary(model.select("ord", "ngram", F.lit(1).alias("cnt")), words).select("ord", "ngram")
        model = model.join(keep, ["ord", "ngram"], "left_semi")
    if o["compile-lattices"]:
        print(api.compile_lattices(spark, o["compile-lattices"]))
    _evaluations(spark, model, order, o)
    if o["write-vocab"]:
        files.write_vocab(model, o["write-vocab"])
    if o["write-lm"]:
        files.write_model(model, o["write-lm"], order, truth(o["write-binary"]))


def interpolate(o: dict) -> None:
    spark, order = _session(), int(o["order"])
    m = api.interpolate(
        spark, order, split_list(o["lm"] or ""), split_list(o["text"] or ""), split_list(o["counts"] or ""),
        split_list(o["smoothing"], ";"), o["interpolation"], split_list(o["interpolation-features"] or "", ";"),
        truth(o["tie-param-order"]), truth(o["tie-param-lm"]), o["vocab"], truth(o["unk"]), split_list(o["weight-features"] or "", ";"),
    )
    if o["params"]:
        m.with_params(files.read_params(o["params"], len(m.params())))
    if o["opt-perp"]:
        best = m.tune_perplexity(files.corpus(spark, o["opt-perp"]), o["opt-alg"])
        log.info("entropy %f after %d evaluations", best.value, best.evaluations)
    for what in ("margin", "wer"):
        if o[f"opt-{what}"]:
            best = m.tune_lattices(*api.load_lattices(spark, o[f"opt-{what}"]), what, o["opt-alg"])
            log.info("%s %f after %d evaluations", what, best.value, best.evaluations)
    if o["write-params"]:
        files.write_params(m.params(), o["write-params"])
    if o["write-vocab"]:
        files.write_vocab(m.model(), o["write-vocab"])
    if o["write-lm"]:
        files.write_model(m.model(), o["write-lm"], order, truth(o["write-binary"]))
    _evaluations(spark, m.model(), order, o)


PROGRAMS = {"estimate": (ESTIMATE, estimate), "evaluate": (EVALUATE, evaluate), "interpolate": (INTERPOLATE, interpolate)}


def main(args: list[str]) -> int:
    if not args or args[0] not in PROGRAMS:
        print("usage: python -m gramforge.cli " + "|".join(PROGRAMS), file=sys.stderr)
        return 2
    options, run = PROGRAMS[args[0]]
    try:
        o = options.parse(args[1:])
    except ValueError as e:
        print(f"{e}\n{options.usage()}", file=sys.stderr)
        return 2
    if truth(o["help"]):
        print(options.usage())
        return 0
    levels = (logging.WARNING, logging.INFO, logging.DEBUG)
    logging.basicConfig(level=levels[min(2, max(0, int(o["verbose"] or 1)))], format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    run(o)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
