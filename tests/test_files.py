"""Files: every format written and read again; the command line from end to end."""

from __future__ import annotations

import bz2
import gzip
import zipfile

import numpy as np
import pytest

from gramforge import api, cli
from gramforge.operators import counts as C
from gramforge.operators import smoothing as S
from gramforge.operators import text as T
from gramforge.operators import tune
from gramforge.operators.optimize import Minimum
from gramforge.options import Option, Options, split_list, truth
from gramforge.sources import files
from gramforge.streaming import counts as stream

TEXT = "a b c d\nc d e\nd e\na b e e\nb c d e\n"
OTHER = "x b c\nc d x\nb b\n"
FST = "#FSTBasic MinPlus\nI 0\nT 0 1 a a 1\nT 0 2 d d 0.5\nT 1 3 b b\nT 2 4 e e\nF 3\nF 4\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text(TEXT)
    (tmp_path / "b.txt").write_text(OTHER)
    (tmp_path / "v.txt").write_text("# words\na\nb\nc\n\nd\n")
    (tmp_path / "docs").write_text("<DOC 1>\na b c\n</DOC>\n<DOC 2>\nb c\n</DOC>\n")
    (tmp_path / "u1").write_text(FST)
    (tmp_path / "u2").write_text(FST)
    (tmp_path / "lattices").write_text("# list\nu1 u1 a b\nu2 u2 d <tag> e e\n")
    return tmp_path


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_compressed_text(spark, folder):
    (folder / "z.gz").write_bytes(gzip.compress(TEXT.encode()))
    (folder / "z.bz2").write_bytes(bz2.compress(TEXT.encode()))
    with zipfile.ZipFile(folder / "z.zip", "w") as z:
        z.writestr("t", TEXT)
    want = rows(files.lines(spark, f"{folder}/a.txt"), "value")
    assert len(want) == 5
    for kind in ("gz", "bz2", "zip"):
        assert rows(files.lines(spark, f"{folder}/z.{kind}"), "value") == want
    assert len(rows(files.lines(spark, f"{folder}/a.txt, {folder}/z.zip"), "value")) == 10
    (folder / "long.txt").write_text("w" * 200_000 + " b")
    assert files.corpus(spark, f"{folder}/long.txt").first().w[1] == "w" * 200_000


def test_counts_round_trip(spark, folder):
    c = api.load_counts(spark, 3, text=f"{folder}/a.txt")
    for binary in (False, True):
        name = f"{folder}/counts{binary}"
        files.write_counts(c, name, binary=binary)
        again = api.load_counts(spark, 3, counts=name)
        assert rows(again, "ord", "ngram", "cnt") == rows(c, "ord", "ngram", "cnt")
    both = api.load_counts(spark, 3, text=f"{folder}/a.txt", counts=f"{folder}/countsFalse")
    assert rows(both, "cnt")[-1][0] == 2 * rows(c, "cnt")[-1][0]
    (folder / "odd").write_text("# c\n\n\t6\na b 2\na b 3\na b c d 9\n")
    got = {(r.ord, r.ngram): r.cnt for r in files.counts(spark, f"{folder}/odd", 3).collect()}
    assert got == {(2, "a b"): 5, (1, "a"): 0, (1, "b"): 0}
    (folder / "odd").write_text("a b 2\nbad count\n")
    with pytest.raises(Exception, match="bad count"):
        files.counts(spark, f"{folder}/odd", 3).collect()


@pytest.mark.parametrize("ending", ["gz", "bz2", "zip"])
def test_compressed_files(spark, folder, ending):
    c = api.load_counts(spark, 3, text=f"{folder}/a.txt")
    files.write_counts(c, f"{folder}/c.{ending}")
    with open(f"{folder}/c.{ending}", "rb") as f:
        assert f.read(2) in (b"\x1f\x8b", b"BZ", b"PK")
    assert rows(files.counts(spark, f"{folder}/c.{ending}", 3), "ord", "ngram", "cnt") == rows(c, "ord", "ngram", "cnt")
    docs = spark.createDataFrame([("<DOC 1>",), ("a b",), ("</DOC>",), ("c",), ("</DOC>",)], "value string").coalesce(1)
    files.write_lines(docs, f"{folder}/docs.{ending}")
    assert len({r.doc_id for r in files.documents(spark, f"{folder}/docs.{ending}").collect()}) == 2


@pytest.mark.parametrize("text, message", [
    ("\\data\\\nngram 1=2\n\n\\1-grams:\n-1\ta\n\n\\end\\\n", "header says 2"),
    ("\\data\\\nngram 1=1\n\n\\1-grams:\n-x\ta\n\n\\end\\\n", "bad line"),
    ("\\data\\\nngram 1=1\n\n\\1-grams:\n-1\ta\tx\n\n\\end\\\n", "bad line"),
    ("\\data\\\nngram 1=1\n\n\\1-grams:\n-1\ta\n-2 b\n\n\\end\\\n", "bad line"),
])
def test_broken_models_fail(spark, folder, text, message):
    (folder / "broken.lm").write_text(text)
    with pytest.raises(Exception, match=message):
        files.arpa(spark, f"{folder}/broken.lm").collect()


def test_feature_sink_with_order_0(spark, folder):
    f = spark.createDataFrame([(0, "", 0.5), (1, "a", 1.0), (2, "a b", 2.0)], "ord int, ngram string, value double")
    files.write_features(f, f"{folder}/features")
    assert (folder / "features").read_text() == "\t0.500000\na\t1.000000\na b\t2.000000\n"
    assert rows(files.features(spark, f"{folder}/features"), "ord", "ngram", "value") == rows(f, "ord", "ngram", "value")


def test_lattices_of_equal_names(spark, folder):
    for name, word in (("a", "x"), ("b+ c", "y")):
        (folder / name).mkdir()
        (folder / name / "utt.fst").write_text(f"#FSTBasic MinPlus\nI 0\nT 0 1 {word} {word} 1\nF 1 0\n")
    (folder / "b+ c").rename(folder / "b+c")
    (folder / "same").write_text(f"t1 a/utt.fst x\nt2 {folder}/b+c/utt.fst y\nt3 a/utt.fst z\n")
    arcs, refs = files.lattice_list(spark, f"{folder}/same")
    assert {(r.tag, r.word) for r in arcs.where("arc = 0").collect()} == {("t1", "x"), ("t2", "y"), ("t3", "x")}
    assert arcs.count() == 6 and refs.count() == 3

def test_model_round_trip(spark, folder):
    c = api.load_counts(spark, 3, text=f"{folder}/a.txt")
    m = S.kneser_ney(c, 3).persist()
    for binary in (False, True):
        name = f"{folder}/lm{binary}"
        files.write_model(m, name, 3, binary)
        again = {r.ngram: (r.prob, r.bow) for r in files.read_model(spark, name).collect()}
        assert len(again) == m.count()
        for r in m.collect():
            p, b = again[r.ngram]
            assert p == pytest.approx(r.prob, rel=1e-5) and (1.0 if b is None else b) == pytest.approx(1.0 if r.bow is None else r.bow, rel=1e-5)
        cut = files.read_model(spark, name, 2)
        assert {r.ord for r in cut.collect()} == {1, 2} and all(r.bow is None for r in cut.where("ord = 2").collect())
    closed = C.close_vocabulary(c, files.vocab(spark, f"{folder}/v.txt"))
    files.write_vocab(closed, f"{folder}/words")
    assert (folder / "words").read_text().split() == ["</s>", "a", "b", "c", "d"]


def test_features_params_and_topics(spark, folder):
    (folder / "f").write_text("# f\na b 1.5\na b 2.5\n0.25\n")
    got = [(r.ord, r.ngram, r.value) for r in files.features(spark, f"{folder}/f").orderBy("line").collect()]
    assert got == [(2, "a b", 1.5), (2, "a b", 2.5), (0, "", 0.25)]
    files.write_features(files.features(spark, f"{folder}/f").where("value = 2.5"), f"{folder}/g")
    assert (folder / "g").read_text() == "a b\t2.500000\n"
    files.write_params([0.5, 1.0], f"{folder}/p")
    assert files.read_params(f"{folder}/p", 2) == [0.5, 1.0]
    with pytest.raises(ValueError):
        files.read_params(f"{folder}/p", 3)
    (folder / "h").write_text("# w\na\t1\t3\nb\t2\t0\n</s>\t2\t0\nc\t1\t1\n")
    got = [(r.w, r.s) for r in files.hmm_lda(spark, f"{folder}/h").orderBy("line_no").collect()]
    assert got == [(["</s>", "a", "b", "</s>"], [0, 1, 2, 2]), (["</s>", "c", "</s>"], [0, 1, 0])]
    (folder / "bad").write_text("a\t1\n")
    with pytest.raises(Exception, match="bad line"):
        files.hmm_lda(spark, f"{folder}/bad").collect()
    (folder / "d").write_text("<DOC 1>\na b\n</DOC>\n<DOC 2>\nc\n</DOC>\n")
    assert len({r.doc_id for r in files.documents(spark, f"{folder}/d").collect()}) == 2


def test_lattice_files(spark, folder):
    arcs, refs = api.load_lattices(spark, f"{folder}/lattices")
    assert arcs.count() == 12 and {r.tag: r.words for r in refs.collect()} == {"u1": ["a", "b"], "u2": ["d", "e", "e"]}
    files.write_lattices(arcs, f"{folder}/out")
    assert (folder / "out" / "u1").read_text().startswith("#FSTBasic MinPlus\nI 0\nT 0 1 a a 1\n")
    u = spark.createDataFrame([("u1", ["a", "b"], 2, 0, 0.5), ("u2", ["d"], 3, 2, 0.25)], "tag string, words array<string>, n_ref int, n_errors int, confidence double")
    files.write_transcripts(u, f"{folder}/t")
    files.write_confidence(u, f"{folder}/c")
    files.write_word_errors(u, f"{folder}/w")
    assert (folder / "t").read_text() == "a b (u1)\nd (u2)\n" and (folder / "c").read_text() == "u1\t0.500000\nu2\t0.250000\n"
    assert (folder / "w").read_text() == "u1\t2\t0\nu2\t3\t2\n"
    compiled = api.compile_lattices(spark, f"{folder}/lattices")
    assert rows(api.load_lattices(spark, compiled)[0], "tag", "arc", "word") == rows(arcs, "tag", "arc", "word")


def test_options():
    o = Options("x", [Option("order", "o", "n", "3"), Option("unk", "u", "b", "false"), Option("text", "t", "f")])
    assert o.parse(["-o", "2", "-u", "-text", "a,b"]) == {"order": "2", "unk": "true", "text": "a,b"}
    for bad in (["-zz"], ["-o", "1", "-order", "2"], ["word"]):
        with pytest.raises(ValueError):
            o.parse(bad)
    assert split_list(" a , b") == ["a", "b"] and split_list("") == [] and truth("True") and truth("1") and not truth("no")
    assert "-o, -order" in o.usage()


def run(*args):
    assert cli.main([str(a) for a in args]) == 0


def test_command_line(spark, folder, capsys):
    run("estimate", "-t", folder / "a.txt", "-wl", folder / "a.lm", "-wp", folder / "p", "-op", folder / "b.txt", "-ep", f"{folder}/a.txt,{folder}/b.txt")
    tuned = [float(x.split("\t")[2]) for x in capsys.readouterr().out.splitlines()]
    run("estimate", "-t", folder / "a.txt", "-ep", folder / "b.txt")
    plain = float(capsys.readouterr().out.split("\t")[2])
    assert len(tuned) == 2 and tuned[1] <= plain + 1e-3
    run("estimate", "-t", folder / "a.txt", "-p", folder / "p", "-ep", folder / "b.txt")
    assert float(capsys.readouterr().out.split("\t")[2]) == pytest.approx(tuned[1], abs=2e-3)
    run("estimate", "-t", folder / "b.txt", "-wl", folder / "b.lm", "-wb", "-s", "FixKN")
    run("evaluate", "-l", folder / "a.lm", "-ep", folder / "a.txt", "-o", 2, "-wl", folder / "cut.lm", "-wv", folder / "cut.v", "-ew", folder / "lattices", "-em", folder / "lattices")
    out = capsys.readouterr().out.splitlines()
    assert [x.split("\t")[0] for x in out] == ["perplexity", "margin", "wer"]
    assert "ngram 3" not in (folder / "cut.lm").read_text() and "\na\n" in (folder / "cut.v").read_text()
    for kind in ("LI", "CM"):
        tuned = ["-op", folder / "b.txt", "-oa", "Powell", "-tpo", "f"]
        run("interpolate", "-t", f"{folder}/a.txt,{folder}/b.txt", "-i", kind, "-ep", folder / "b.txt", "-wl", folder / f"{kind}.lm", *tuned)
        assert capsys.readouterr().out.startswith("perplexity")
    for what in ("-om", "-ow"):
        run("interpolate", "-t", f"{folder}/a.txt,{folder}/b.txt", "-o", 2, what, folder / "lattices", "-wp", folder / "tuned", "-oa", "Powell")
        assert len(files.read_params(f"{folder}/tuned")) == 1
    run("interpolate", "-o", 2, "-t", f"{folder}/a.txt,{folder}/b.txt", "-v", folder / "v.txt", "-u", "-wf", f"log1p:freq:{folder}/docs", "-wl", folder / "unk.lm")
    assert "<unk>" in (folder / "unk.lm").read_text()
    run("interpolate", "-l", f"{folder}/a.lm,{folder}/b.lm", "-op", folder / "b.txt", "-wp", folder / "q")
    assert len(files.read_params(f"{folder}/q")) == 1
    run("estimate", "-o", 2, "-t", folder / "a.txt", "-v", folder / "v.txt", "-u", "-s", "ML", "-wl", folder / "ml.lm")
    assert "<unk>" in (folder / "ml.lm").read_text()
    run("estimate", "-o", 2, "-t", folder / "a.txt", "-s", "FixKN,ML", "-wl", folder / "mixed.lm")
    run("interpolate", "-o", 2, "-t", f"{folder}/a.txt,{folder}/b.txt", "-i", "GLI", "-if", f"log1p:sumhist:freq:{folder}/docs", "-tpl", "-wp", folder / "g")
    assert len(files.read_params(f"{folder}/g")) == 2
    run("estimate", "-o", 2, "-t", folder / "a.txt", "-s", "KN", "-ow", folder / "lattices", "-om", folder / "lattices", "-ew", folder / "lattices")
    assert cli.main(["estimate", "-nonsense", "1"]) == 2 and cli.main([]) == 2
    run("evaluate", "-h")


def test_interpolation_tuned_on_lattices(spark, folder, monkeypatch):
    values = []

    def better_of_two(technique, f, x0):
        values.append([f(np.array([b])) for b in (0.0, 3.0)])
        k = int(np.argmin(values[-1]))
        return Minimum(np.array([3.0 * k]), values[-1][k], 1, 2)

    monkeypatch.setattr(tune, "minimise", better_of_two)
    texts = f"{folder}/a.txt,{folder}/b.txt"
    m = api.interpolate(spark, 2, text=texts.split(","))
    run("interpolate", "-o", 2, "-t", texts, "-om", folder / "lattices", "-ow", folder / "lattices", "-wp", folder / "q")
    for what, sign, got in zip(("margin", "wer"), (-1, 1), values, strict=True):
        for b, value in zip((0.0, 3.0), got, strict=True):
            m.with_params([b])
            assert sign * value == pytest.approx(api.evaluate_lattices(spark, m.model(), 2, f"{folder}/lattices")[what])
    assert values[0][0] != values[0][1]
    assert files.read_params(f"{folder}/q") == [3.0 * int(np.argmin(values[1]))]


def test_weighted_by_a_feature_file(spark, folder):
    (folder / "w").write_text("b c 1\nc d 2\n")
    e = api.estimate(spark, 2, text=f"{folder}/a.txt", weight_features=f"log1p:{folder}/w", weights=[0.4])
    p = {r.ngram: r.prob for r in e.model().collect()}
    q = {r.ngram: r.prob for r in api.estimate(spark, 2, text=f"{folder}/a.txt").model().collect()}
    assert p.keys() == q.keys() and p["b c"] != q["b c"]


def test_stream(spark, folder):
    schema = "text string"
    source = folder / "in"
    for i, t in enumerate(["a b\nc", "a b a", "c"]):
        spark.createDataFrame([(t,)], schema).write.parquet(f"{source}/{i}")
    stream_in = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    stream.merge_counts(stream_in, 2, f"{folder}/counts", f"{folder}/state").awaitTermination()
    got = rows(stream.total_counts(spark.read.parquet(f"{folder}/counts")), "ord", "ngram", "cnt")
    want = C.count_ngrams(T.token_rows(spark.read.parquet(f"{source}/*"), []), 2)
    assert got == rows(want, "ord", "ngram", "cnt")
    q = stream.stream_counts(stream_in, 1).writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("running"), "ngram", "cnt") == rows(want.where("ord = 1"), "ngram", "cnt")


def test_components_smoothed_again(spark, folder):
    """Tuned components are smoothed again over the mixture's n-grams; large tuning sets are evaluated by jobs."""
    from gramforge.operators import tune

    m = api.interpolate(spark, 2, text=[f"{folder}/a.txt", f"{folder}/b.txt"], smoothing=["FixKN"])
    dev = files.corpus(spark, f"{folder}/b.txt")
    plain = {r.ngram: r.prob for r in m.model().collect()}
    m.smooth_again([np.array([0.9, 0.9]), None])
    assert m.model().count() == len(plain) and any(abs(r.prob - plain[r.ngram]) > 1e-6 for r in m.model().collect())
    m.tune_components(dev, "LBFGS")
    near = m.tune_perplexity(dev, "LBFGS").value
    most, tune.MAX_CONTEXTS = tune.MAX_CONTEXTS, 2
    try:
        m.with_params([0.0])
        assert m.tune_perplexity(dev, "LBFGS").value == pytest.approx(near, abs=1e-4)
        e = api.estimate(spark, 2, f"{folder}/a.txt", smoothing="KN")
        far = e.tune_perplexity(dev, "LBFGS").value
    finally:
        tune.MAX_CONTEXTS = most
    assert api.estimate(spark, 2, f"{folder}/a.txt", smoothing="KN").tune_perplexity(dev, "LBFGS").value == pytest.approx(far, abs=1e-4)
