"""Text files of language models as DataFrames, and back.

Readers take paths or comma lists; gz and bz2 are decompressed by the scan, zip archives by `binaryFile`.  Writers make a
folder of ordered part files, so that no task holds a whole model; `single` then joins the parts into one file.  The
binary forms of tables are Parquet.
"""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import zipfile
from collections.abc import Iterator
from functools import reduce
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import text as T
from ..operators.lattice import ARCS, format_fst, parse_lattices


def paths(names: str | list[str]) -> list[str]:
    """Paths of a comma list."""
    return [x.strip() for x in names.split(",") if x.strip()] if isinstance(names, str) else list(names)


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, data in zip(batch["path"], batch["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for name in z.namelist():
                    text = z.read(name).decode("utf-8", "replace")
                    yield pd.DataFrame({"f": f"{path}#{name}", "value": text.removesuffix("\n").split("\n")})


def named_lines(spark: SparkSession, names: str | list[str]) -> DataFrame:
    """(f, value): the lines of text files, plain or compressed (gz, bz2, zip), with their file.  Lines have no limit."""
    names = paths(names)
    plain = [n for n in names if not n.endswith(".zip")]
    zipped = [n for n in names if n.endswith(".zip")]
    parts = []
    if plain:
        parts.append(spark.read.text(plain, lineSep="\n").select(F.col("_metadata.file_path").alias("f"), "value"))
    if zipped:
        parts.append(spark.read.format("binaryFile").load(zipped).select("path", "content").mapInPandas(_unzip, "f string, value string"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "f string, value string")


def lines(spark: SparkSession, names: str | list[str]) -> DataFrame:
    """(value): the lines of text files."""
    return named_lines(spark, names).select("value")


def _bad(what: str, line: Column) -> Column:
    """Fails with the line."""
    return F.raise_error(F.concat(F.lit(f"{what}: "), line))


def _clean(rows: DataFrame) -> DataFrame:
    """Lines without comments and blank lines."""
    v = F.col("value")
    return rows.where(v.isNotNull() & ~v.startswith("#") & (F.regexp_replace(v, T.SPACE, "") != ""))


def corpus(spark: SparkSession, names: str | list[str]) -> DataFrame:
    """(line_no, w): bounded words of the sentences of corpus files; line_no is unique, not consecutive."""
    rows = lines(spark, names).where(~T.is_marker(F.col("value")))
    return rows.select(F.monotonically_increasing_id().alias("line_no"), T.bounded(F.col("value")).alias("w"))


def _ends_before(rows: DataFrame, ends: Column) -> DataFrame:
    """rows (with n, a monotonically increasing id) with __ends: how many earlier rows satisfy `ends`.

    A running sum within each input partition plus the totals of the partitions before it, so no task sees the whole
    file; the only global order is that of one row per partition."""
    part = F.shiftright("n", 33)
    rows = rows.withColumns({"__p": part, "__e": F.coalesce(ends.cast("int"), F.lit(0))})
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("__p").agg(F.sum("__e").alias("__t"))
    totals = totals.select("__p", F.coalesce(F.sum("__t").over(earlier(Window.orderBy("__p"))), F.lit(0)).alias("__before"))
    within = F.coalesce(F.sum("__e").over(earlier(Window.partitionBy("__p").orderBy("n"))), F.lit(0))
    rows = rows.withColumn("__within", within).join(totals, "__p")
    return rows.withColumn("__ends", F.col("__within") + F.col("__before")).drop("__p", "__e", "__within", "__before")


def documents(spark: SparkSession, names: str | list[str]) -> DataFrame:
    """(doc_id, line_no, w): sentences of corpus files whose documents end with `</DOC>` lines; none crosses files."""
    rows = named_lines(spark, names).withColumn("n", F.monotonically_increasing_id())
    rows = _ends_before(rows, F.col("value") == "</DOC>").where(~T.is_marker(F.col("value")))
    return rows.select(F.concat_ws("#", "f", F.col("__ends").cast("string")).alias("doc_id"), F.col("n").alias("line_no"), T.bounded(F.col("value")).alias("w"))


def _internal(words: Column) -> Column:
    return F.transform(words, lambda x: F.when(x == T.START, F.lit(T.BOUNDARY)).otherwise(x))


def vocab(spark: SparkSession, names: str | list[str]) -> DataFrame:
    """(word) of vocabulary files."""
    return T.vocabulary(lines(spark, names))


def counts(spark: SparkSession, names: str | list[str], order: int | None = None) -> DataFrame:
    """(ord, ngram, cnt) of counts files: equal n-grams add up, longer ones than the order are left out, prefixes and
    suffixes that are missing come in with count 0.  Order-0 lines hold no n-gram and are skipped.  A line whose last word
    is no integer fails."""
    w = T.words(F.col("value"))
    number = F.element_at(w, -1).try_cast("bigint")
    rows = _clean(lines(spark, names)).select(
        F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("w"),
        F.coalesce(number, _bad("bad count", F.col("value")).cast("bigint")).alias("cnt"),
    )
    rows = rows.where(F.size("w") > 0)
    if order is not None:
        rows = rows.where(F.size("w") <= order)
    rows = rows.select(F.size("w").alias("ord"), F.array_join(_internal(F.col("w")), " ").alias("ngram"), "cnt")
    return C.add_missing(rows.groupBy("ord", "ngram").agg(F.sum("cnt").alias("cnt")))


def features(spark: SparkSession, names: str | list[str]) -> DataFrame:
    """(ord, ngram, value, line) of feature files; a line without words gives the order-0 value.  A bad number fails."""
    w = T.words(F.col("value"))
    rows = _clean(lines(spark, names)).select(F.monotonically_increasing_id().alias("line"), w.alias("w"), "value")
    words = F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0)))
    return rows.select(
        F.size(words).alias("ord"), F.array_join(_internal(words), " ").alias("ngram"),
        F.coalesce(F.element_at("w", -1).try_cast("double"), _bad("bad value", F.col("value")).cast("double")).alias("value"), "line",
    )


def hmm_lda(spark: SparkSession, names: str | list[str]) -> DataFrame:
    """(line_no, w, s): sentences of word-state-topic lines with the states of their words.

    A sentence ends with its boundary word; a bad line fails."""
    parts = F.split("value", "\t")
    bad = F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))).cast("int")
    n = lines(spark, names).where(~F.col("value").startswith("#")).withColumn("n", F.monotonically_increasing_id())
    rows = n.select(
        "n", F.get(parts, 0).alias("word"), F.when(F.size(parts) == 3, F.get(parts, 1).cast("int")).otherwise(bad).alias("state")
    )
    rows = _ends_before(rows, F.col("word").isin(T.BOUNDARY, T.START)).withColumnRenamed("__ends", "line_no")
    inner = rows.groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("n", "word", "state"))).alias("t"))
    w = F.transform("t", lambda x: x["word"])
    s = F.transform("t", lambda x: x["state"])
    closed = F.element_at(w, -1).isin(T.BOUNDARY, T.START)
    w = F.concat(F.array(F.lit(T.BOUNDARY)), _internal(w), F.when(closed, F.array().cast("array<string>")).otherwise(F.array(F.lit(T.BOUNDARY))))
    s = F.concat(F.array(F.lit(0)), s, F.when(closed, F.array().cast("array<int>")).otherwise(F.array(F.lit(0))))
    return inner.select("line_no", w.alias("w"), s.alias("s"))


def arpa(spark: SparkSession, names: str | list[str], order: int | None = None, check: bool = True) -> DataFrame:
    """Model (ord, ngram, hist, suffix, word, prob, bow) of ARPA files.

    A line's number of words is its order, so no line needs its section and files may be split anywhere.  Log
    probabilities of -99 and less are 0; the `<s>` line gives the back-off weight of the boundary.  A line with a bad number
    or without words fails; with check, so do files whose entries are not as many as their headers say."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    text = lines(spark, names)
    v = F.col("value")
    if check:
        header = F.regexp_extract(v, r"^ngram\s+(\d+)\s*=\s*(\d+)\s*$", 1), F.regexp_extract(v, r"^ngram\s+(\d+)\s*=\s*(\d+)\s*$", 2)
        entry = F.size(T.words(F.get(parts, 1)))
        of = F.when(v.contains("\t"), F.struct(entry.alias("ord"), F.lit(None).cast("bigint").alias("said")))
        of = of.when(v.startswith("ngram"), F.struct(header[0].try_cast("int").alias("ord"), header[1].try_cast("bigint").alias("said")))
        found = text.select(of.alias("x")).where("x is not null").groupBy("x.ord").agg(
            F.count_if(F.col("x.said").isNull()).alias("n"), F.sum("x.said").alias("said")
        )
        for r in found.orderBy("ord").collect():  # one row for each order
            if r["said"] is not None and r["said"] != r["n"]:
                raise ValueError(f"order {r['ord']} has {r['n']} n-grams, but the header says {r['said']}")
    lp, lb, w = F.get(parts, 0).try_cast("double"), F.get(parts, 2).try_cast("double"), T.words(F.get(parts, 1))
    looks = v.contains("\t") | v.rlike(r"^\s*[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?(?:\s|$)")
    wrong = lp.isNull() | (F.size(w) < 1) | (F.size(parts) > 3) | (F.get(parts, 2).isNotNull() & lb.isNull())
    rows = text.where(looks).select(
        F.when(wrong, _bad("bad line", v).cast("double")).otherwise(lp).alias("lp"), w.alias("w"), lb.alias("lb")
    )
    if order is not None:
        rows = rows.where(F.size("w") <= order)
    start = (F.size("w") == 1) & (F.get("w", 0) == T.START)
    rows = rows.select(
        F.size("w").alias("ord"),
        F.array_join(_internal(F.col("w")), " ").alias("ngram"),
        F.when(~start, F.when(F.col("lp") <= -99, 0.0).otherwise(F.pow(F.lit(10.0), "lp"))).alias("prob"),
        F.pow(F.lit(10.0), "lb").alias("bow"),
    )
    m = rows.groupBy("ord", "ngram").agg(F.coalesce(F.max("prob"), F.lit(0.0)).alias("prob"), F.max("bow").alias("bow"))
    m = C.keyed(m)
    if order is not None:
        m = m.withColumn("bow", F.when(F.col("ord") < order, F.col("bow")))
    return m.select("ord", "ngram", "hist", "suffix", "word", "prob", "bow")


def lattice_list(spark: SparkSession, name: str) -> tuple[DataFrame, DataFrame]:
    """Arcs and references (tag, words) of a list of lattices, one line `tag file transcript...` each."""
    base = os.path.dirname(name)
    listed = _clean(lines(spark, name)).select(T.words(F.col("value")).alias("w"))
    file = F.get("w", 1)
    path = F.when(file.startswith("/") | file.contains("://"), file).otherwise(F.concat(F.lit(f"{base}/" if base else ""), file))
    listed = listed.select(F.get("w", 0).alias("tag"), path.alias("path"), F.slice("w", 3, F.size("w")).alias("words"))
    # a scan's files are named on the driver, as for every file source
    found = list(dict.fromkeys(r["path"] for r in listed.select("path").toLocalIterator()))
    if not found:
        text = spark.createDataFrame([], "p string, text string")
    else:
        text = spark.read.text(found, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("text"))
    here = "" if os.path.isabs(base) or "://" in base else os.getcwd() + "/"
    bare = lambda p: F.regexp_replace(F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"(/\.)?/+", "/")
    whole = F.when(F.col("path").startswith("/") | F.col("path").contains("://"), F.col("path")).otherwise(F.concat(F.lit(here), F.col("path")))
    decoded = F.url_decode(F.replace("p", F.lit("+"), F.lit("%2B")))
    named = text.withColumn("bare", bare(decoded)).join(listed.select("tag", bare(whole).alias("bare")), "bare")
    arcs = parse_lattices(named.select("tag", "text"))
    refs = listed.select("tag", F.filter("words", lambda x: ~x.startswith("<")).alias("words"))
    return arcs, refs


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Binary counts, models, vocabularies or lattices."""
    return spark.read.parquet(name)


def is_table(name: str) -> bool:
    """Whether a path, local or of any file system that Spark reads, is a Parquet table."""
    spark = SparkSession.getActiveSession()
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(path).isDirectory():
        return any(x.getPath().getName().endswith(".parquet") for x in fs.listStatus(path))
    return path.getName().endswith(".parquet")


# -- sinks -------------------------------------------------------------------------------------------------------------


def has_scheme(name: str) -> bool:
    """Whether a path names its file system, so that it isn't for local calls."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", name) is not None


_CODECS = {".gz": "gzip", ".bz2": "bzip2"}


def write_lines(rows: DataFrame, name: str, sort: list[Column] | None = None, single: bool = True) -> None:
    """Writes column value as text, in the order of sort; to a folder of parts where `single` is false or the path is not
    a local one.

    A name that ends with gz or bz2 is compressed by the tasks that write the parts: compressed files may follow each other
    in one file.  zip is for single local files."""
    ending = os.path.splitext(name)[1]
    single = single and not has_scheme(name)
    if ending == ".zip" and not single:
        raise ValueError("zip archives can only be written as single local files")
    rows = rows.orderBy(*sort) if sort else rows
    part = name + ".parts" if single else name
    rows.select("value").write.mode("overwrite").text(part, compression=_CODECS.get(ending, "none"))
    if not single:
        return
    parts = [os.path.join(part, p) for p in sorted(os.listdir(part)) if p.startswith("part-")]
    if ending == ".zip":
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z, z.open(os.path.basename(name)[:-4], "w", force_zip64=True) as out:
            _append(parts, out)
    else:
        with open(name, "wb") as out:
            _append(parts, out)
    shutil.rmtree(part)


def _append(parts: list[str], out: BinaryIO) -> None:
    for p in parts:
        with open(p, "rb") as f:
            shutil.copyfileobj(f, out)


def counts_lines(rows: DataFrame, value: str = "cnt") -> tuple[DataFrame, list[Column]]:
    """Lines `w1 ... wk<TAB>count` and their order.  An order-0 row gives a line with the count alone."""
    shown = F.when(F.col("ord") == 0, F.lit("")).otherwise(C.shown())
    text = F.concat(shown, F.lit("\t"), F.col(value).cast("string"))
    return rows.select("ord", "ngram", text.alias("value")), C.export_order()


def write_counts(rows: DataFrame, name: str, value: str = "cnt", binary: bool = False) -> None:
    if binary:
        rows.write.mode("overwrite").parquet(name)
    else:
        write_lines(*[(x := counts_lines(rows, value))[0], name], sort=x[1])


def arpa_lines(model: DataFrame, order: int) -> tuple[DataFrame, list[Column]]:
    """Lines of an ARPA file and their order; an empty order is left out."""
    lp = F.when(F.col("prob") > 0, F.format_string("%.6f", F.log10("prob"))).otherwise(F.lit("-99"))
    lb = F.when(F.col("bow") > 0, F.format_string("%.6f", F.log10("bow"))).otherwise(F.lit("-99"))
    has_bow = F.col("bow").isNotNull() & (F.col("bow") != 1.0) & (F.col("ord") < order)
    boundary = F.col("ngram") == T.BOUNDARY
    body = F.concat(lp, F.lit("\t"), F.when(boundary, F.lit(T.BOUNDARY)).otherwise(C.shown()), F.when(has_bow & ~boundary, F.concat(F.lit("\t"), lb)).otherwise(""))
    start = F.concat(F.lit("-99\t<s>\t"), F.when(F.col("bow").isNull(), F.lit("0.000000")).otherwise(lb)) if order > 1 else F.lit("-99\t<s>")
    rank = C.export_order()[1]
    entry = lambda sub, text: F.struct(F.lit(sub).alias("sub"), text.alias("value"))
    rows = model.select(
        F.lit(1).alias("part"), "ord", rank.alias("rank"),
        F.explode(F.when(boundary, F.array(entry(0, body), entry(1, start))).otherwise(F.array(entry(0, body)))).alias("e"),
    ).select("part", "ord", "rank", "e.sub", "e.value")
    n = model.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("n", F.col("n") + F.when(F.col("ord") == 1, 1).otherwise(0))
    empty = F.array().cast("array<string>")
    head = n.select(F.lit(0).alias("part"), "ord", empty.alias("rank"), F.lit(2).alias("sub"), F.format_string("ngram %d=%d", "ord", "n").alias("value"))
    section = n.select(
        F.lit(1).alias("part"), "ord", empty.alias("rank"),
        F.explode(F.array(entry(-2, F.lit("")), entry(-1, F.format_string("\\%d-grams:", "ord")))).alias("e"),
    ).select("part", "ord", "rank", "e.sub", "e.value")
    frame = model.sparkSession.createDataFrame(
        [(0, 0, [], 0, ""), (0, 0, [], 1, "\\data\\"), (2, 0, [], 0, ""), (2, 0, [], 1, "\\end\\")],
        "part int, ord int, rank array<string>, sub int, value string",
    )
    return frame.unionByName(head).unionByName(section).unionByName(rows), [F.col(c) for c in ("part", "ord", "rank", "sub")]


def write_arpa(model: DataFrame, name: str, order: int) -> None:
    rows, sort = arpa_lines(model, order)
    write_lines(rows, name, sort=sort)


def write_model(model: DataFrame, name: str, order: int, binary: bool = False) -> None:
    model.write.mode("overwrite").parquet(name) if binary else write_arpa(model, name, order)


def read_model(spark: SparkSession, name: str, order: int | None = None) -> DataFrame:
    """ARPA file or binary model, cut to the order."""
    if is_table(name):
        from ..operators.model import truncate

        m = read_table(spark, name)
        return truncate(m, order) if order else m
    return arpa(spark, name, order)


def write_vocab(model: DataFrame, name: str) -> None:
    rows = model.where("ord = 1").select("ord", "ngram", F.when(F.col("ngram") == T.BOUNDARY, T.BOUNDARY).otherwise(C.shown()).alias("value"))
    write_lines(rows, name, sort=C.export_order())


def write_features(rows: DataFrame, name: str) -> None:
    """Lines `w1 ... wk<TAB>value`; the order-0 value, if there is one, comes first in a line without words."""
    shown = F.when(F.col("ord") == 0, F.lit("")).otherwise(C.shown())
    text = F.concat(shown, F.lit("\t"), F.format_string("%f", F.col("value")))
    write_lines(rows.select("ord", "ngram", text.alias("value")), name, sort=C.export_order())


def write_params(params: list[float], name: str) -> None:
    """One JSON object; to a folder with one part where the path names its file system."""
    text = json.dumps({"header": "Param", "values": [float(x) for x in params]})
    if has_scheme(name):
        rows = SparkSession.getActiveSession().createDataFrame([(text,)], "value string")
        rows.coalesce(1).write.mode("overwrite").text(name)
        return
    with open(name, "w") as f:
        f.write(text)


def read_params(name: str, length: int | None = None) -> list[float]:
    if has_scheme(name):
        data = json.loads(SparkSession.getActiveSession().read.text(name).first()[0])
    else:
        with open(name) as f:
            data = json.load(f)
    if data.get("header") != "Param":
        raise ValueError("not a parameter file")
    if length is not None and len(data["values"]) != length:
        raise ValueError(f"expected {length} parameters, found {len(data['values'])}")
    return data["values"]


def write_lattices(arcs: DataFrame, folder: str) -> None:
    """Text form: one file `<tag>` per lattice.  Written by the tasks; folder must be shared."""
    os.makedirs(folder, exist_ok=True)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        tag = g["tag"].iloc[0]
        with open(os.path.join(folder, tag), "w") as f:
            f.write(format_fst(g.sort_values(["src", "dst", "arc"])))
        return pd.DataFrame({"tag": [tag]})

    arcs.groupBy("tag").applyInPandas(run, "tag string").count()


def compile_lattices(arcs: DataFrame, name: str) -> None:
    """Binary form of arcs."""
    arcs.select(*[c.split()[0] for c in ARCS.split(", ")]).write.mode("overwrite").parquet(name)


def write_transcripts(u: DataFrame, name: str) -> None:
    from ..operators.lattice import transcripts

    write_lines(transcripts(u), name, sort=[F.col("tag")])


def confidence_lines(u: DataFrame) -> DataFrame:
    """(tag, value) of lines `tag<TAB>confidence`."""
    return u.select("tag", F.format_string("%s\t%f", "tag", "confidence").alias("value"))


def word_error_lines(u: DataFrame) -> DataFrame:
    """(tag, value) of lines `tag<TAB>words<TAB>errors`."""
    return u.select("tag", F.format_string("%s\t%d\t%d", "tag", "n_ref", "n_errors").alias("value"))


def write_confidence(u: DataFrame, name: str) -> None:
    write_lines(confidence_lines(u), name, sort=[F.col("tag")])


def write_word_errors(u: DataFrame, name: str) -> None:
    write_lines(word_error_lines(u), name, sort=[F.col("tag")])
