"""The published three-line corpus: counts, effective and branching counts and models in both vocabularies."""

from __future__ import annotations

import pytest

from gramforge import cli

CORPUS = "a b c d\nc d e\nd e\n"
VOCAB = "a\nb\nc\n"

# Expected files of the two cases.
WC_A = """<s>\t3
a\t1
b\t1
c\t2
d\t3
e\t2
<s> a\t1
<s> c\t1
<s> d\t1
a b\t1
b c\t1
c d\t2
d </s>\t1
d e\t2
e </s>\t2
<s> a b\t1
<s> c d\t1
<s> d e\t1
a b c\t1
b c d\t1
c d </s>\t1
c d e\t1
d e </s>\t2
"""
WC_B = "<s>\t3\na\t1\nb\t1\nc\t2\n<s> a\t1\n<s> c\t1\na b\t1\nb c\t1\n<s> a b\t1\na b c\t1\n"
WEC_A = (
    WC_A.replace("<s>\t3", "<s>\t2").replace("\nd\t3", "\nd\t2").replace("\ne\t2", "\ne\t1").replace("\ne </s>\t2", "\ne </s>\t1", 1)
)
WLC_A = "\t6\n<s>\t2\na\t1\nb\t1\nc\t2\nd\t2\ne\t1\n<s> a\t0\n<s> c\t0\n<s> d\t0\na b\t1\nb c\t1\nc d\t2\nd </s>\t1\nd e\t2\ne </s>\t1\n"
WLC_B = "\t4\n<s>\t0\na\t1\nb\t1\nc\t2\n<s> a\t0\n<s> c\t0\na b\t1\nb c\t1\n"
WRC_A = "\t6\n<s>\t3\na\t1\nb\t1\nc\t1\nd\t2\ne\t1\n<s> a\t1\n<s> c\t1\n<s> d\t1\na b\t1\nb c\t1\nc d\t2\nd </s>\t0\nd e\t1\ne </s>\t0\n"
WRC_B = "\t4\n<s>\t2\na\t1\nb\t1\nc\t0\n<s> a\t1\n<s> c\t0\na b\t1\nb c\t0\n"
WL_A = """
\\data\\
ngram 1=7
ngram 2=9
ngram 3=8

\\1-grams:
-0.887296\t</s>
-99\t<s>\t-0.196295
-0.691001\ta\t-0.196295
-0.691001\tb\t-0.196295
-0.887296\tc
-0.887296\td\t-0.056116
-0.691001\te\t-0.196295

\\2-grams:
-0.600600\t<s> a\t-0.109144
-0.691001\t<s> c\t-0.109144
-0.691001\t<s> d\t-0.109144
-0.306919\ta b\t-0.109144
-0.350541\tb c\t-0.109144
-0.887296\tc d\t-0.109144
-0.628694\td </s>
-0.747117\td e
-0.350541\te </s>

\\3-grams:
-0.217618\t<s> a b
-0.490737\t<s> c d
-0.441947\t<s> d e
-0.244727\ta b c
-0.490737\tb c d
-0.531669\tc d </s>
-0.601465\tc d e
-0.350541\td e </s>

\\end\\
"""
WL_B = """
\\data\\
ngram 1=5
ngram 2=4
ngram 3=2

\\1-grams:
-0.793946\t</s>
-99\t<s>\t0.000000
-0.634245\ta
-0.634245\tb
-0.425969\tc

\\2-grams:
-0.634245\t<s> a
-0.425969\t<s> c
-0.634245\ta b
-0.425969\tb c

\\3-grams:
-0.634245\t<s> a b
-0.425969\ta b c

\\end\\
"""
CASES = {
    "a": ([], {"wc": WC_A, "wec": WEC_A, "wlc": WLC_A, "wrc": WRC_A, "wl": WL_A}),
    "b": (["-v", "{dir}/small.vocab"], {"wc": WC_B, "wec": WC_B, "wlc": WLC_B, "wrc": WRC_B, "wl": WL_B}),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_files(spark, tmp_path, case):
    (tmp_path / "small.txt").write_text(CORPUS)
    (tmp_path / "small.vocab").write_text(VOCAB)
    extra, expected = CASES[case]
    args = ["estimate", "-t", f"{tmp_path}/small.txt", *[x.format(dir=tmp_path) for x in extra]]
    for name in expected:
        args += [f"-{name}", f"{tmp_path}/{name}.out"]
    assert cli.main(args) == 0
    for name, text in expected.items():
        assert (tmp_path / f"{name}.out").read_text() == text, name
