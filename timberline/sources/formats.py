"""Annotated TSV, ARFF, LibSVM and stochastic-forest files, read to and written from DataFrames.

Headers are small and parsed by the driver; bodies stay distributed. Lines keep their order through a line number.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..operators.transform import cat_codes, encode_num, impute, parse_cat, parse_num
from ..session import cut


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, _i of a text file or a folder of them; _i is in the order of files and lines."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", at.alias("_i"))


def read_afm(spark: SparkSession, path: str) -> DataFrame:
    """case label and typed feature columns, from either orientation: a second header cell with a type prefix means cases in rows."""
    lines = _lines(spark, path)
    return parse_afm(lines, lines.orderBy("_i").first()[0])


def parse_afm(lines: DataFrame, header: str) -> DataFrame:
    """The same of ``lines`` (value), of which one is the ``header``."""
    head = header.split("\t")
    cells = lines.filter((F.col("value") != header) & (F.col("value") != "")).select(F.split("value", "\t").alias("c"))
    if re.match("[NCB]:", head[1] if len(head) > 1 else ""):
        names, label = head[1:], "case"
        raw = cells.select(F.get("c", F.lit(0)).alias("case"), *[F.get("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    else:
        pairs = cells.select(F.col("c")[0].alias("name"), F.posexplode(F.slice("c", 2, len(head) - 1)).alias("at", "cell"))
        names = [r["name"] for r in pairs.filter("at = 0").select("name").collect()]  # one row for each feature
        labels = F.array(*map(F.lit, head[1:]))
        raw = pairs.groupBy("at").pivot("name", names).agg(F.first("cell")).orderBy("at").withColumn("case", F.get(labels, F.col("at"))).drop("at")
        label = "case"
    kind = lambda n: parse_num(f"`{n}`") if n.startswith("N:") else parse_cat(f"`{n}`")
    return raw.select(F.col(f"`{label}`").alias("case"), *[kind(n).alias(n) for n in names])


def afm_lines(df: DataFrame, case: str, by_feature: bool = False) -> DataFrame:
    """at, line of an annotated TSV of ``df``; missing is NA. ``by_feature``: a row for each feature."""
    names = [c for c in df.columns if c != case]
    cell = lambda n: F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("NA"))
    if not by_feature:
        head = df.sparkSession.createDataFrame([(0, "\t".join([".", *names]))], "at long, line string")
        at = ranked(df, [case], name="_at")
        return head.unionByName(at.select((F.col("_at") + 1).alias("at"), F.concat_ws("\t", F.col(case).cast("string"), *map(cell, names)).alias("line")))
    pairs = F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(n).alias("name"), cell(n).alias("cell")) for i, n in enumerate(names)], F.struct(F.lit(0).alias("at"), F.lit(".").alias("name"), F.col(case).cast("string").alias("cell")))
    rows = df.select(F.col(case).alias("_case"), F.explode(pairs).alias("p")).groupBy("p.at", "p.name").agg(F.array_sort(F.collect_list(F.struct("_case", "p.cell"))).alias("cells"))
    return rows.select(F.col("at").cast("long").alias("at"), F.concat_ws("\t", "name", F.array_join(F.col("cells.cell"), "\t")).alias("line"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    head = []
    # a line for each attribute
    marked = [r["value"] for r in _lines(spark, path).filter(F.col("value").rlike(r"^\s*@")).orderBy("_i").collect()]
    for line in marked:
        if m := re.match(r"\s*@attribute\s+('[^']*'|\"[^\"]*\"|\S+)\s+(.*)", line, re.I):
            head.append((m[1].strip("'\""), m[2].strip().lower()))
    if not any(re.match(r"\s*@data", line, re.I) for line in marked):
        raise ValueError("no @data line")
    body = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(@|%|$)"))
    cells = body.select(F.from_csv("value", ", ".join(f"`{n}` string" for n, _ in head), {"ignoreLeadingWhiteSpace": "true", "quote": "'"}).alias("r")).select("r.*")
    kind = lambda n, t: parse_num(f"`{n}`") if t in ("numeric", "real", "integer") else parse_cat(f"`{n}`")
    return cells.select(*[kind(n, t).alias(n) for n, t in head])


def arff_lines(df: DataFrame, relation: str) -> DataFrame:
    """part, line: the header as part 0 to k, data lines as part k + 1; missing is ?."""
    fixed, top = [(0, f"@relation {relation}")], None
    for i, (name, kind) in enumerate(df.dtypes, 1):
        if kind == "string":  # the list of values is one line of the file
            values = df.select(F.col(f"`{name}`").alias("v")).filter("v is not null").distinct().agg(F.array_join(F.array_sort(F.collect_list("v")), ",").alias("all"))
            line = values.select(F.lit(i).alias("part"), F.concat(F.lit(f"@attribute {name} {{"), "all", F.lit("}")).alias("line"))
            top = line if top is None else top.unionByName(line)
        else:
            fixed.append((i, f"@attribute {name} numeric"))
    rest = df.sparkSession.createDataFrame([*fixed, (len(df.dtypes) + 1, "@data")], "part int, line string")
    top = rest if top is None else rest.unionByName(top)
    return top.unionByName(df.select(F.lit(len(df.dtypes) + 2).alias("part"), F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in df.columns]).alias("line")))


def read_libsvm(spark: SparkSession, path: str) -> DataFrame:
    """line, target, feature, num: long format; absent features are 0 and have no row."""
    numbered = ranked(_lines(spark, path).filter("trim(value) <> ''"), ["_i"], name="case_id")
    rows = numbered.select("case_id", F.split(F.trim("value"), r"\s+").alias("t"))
    pairs = rows.select("case_id", F.col("t")[0].alias("target"), F.explode_outer(F.expr("slice(t, 2, size(t))")).alias("p"))
    return pairs.select("case_id", "target", F.split("p", ":")[0].alias("feature"), F.expr("try_cast(split(p, ':')[1] as double)").alias("num"))


def libsvm_lines(df: DataFrame, target: str) -> DataFrame:
    """line: the target and the non-zero features with 1-based numbers; ``df`` is numeric but for the target."""
    names = [c for c in df.columns if c != target]
    parts = [F.when(F.col(f"`{c}`") != 0, F.concat(F.lit(f"{i}:"), F.col(f"`{c}`").cast("string"))) for i, c in enumerate(names, 1)]
    return df.select(F.concat_ws(" ", F.col(target).cast("string"), *parts).alias("line"))


def libsvm_table(df: DataFrame, target: str, numeric: Sequence[str], categorical: Sequence[str], order: str) -> DataFrame:
    """line: as libsvm_lines, of a table with missing values and categories: means and modes for what is missing, categories as
    codes or 0/1 columns, a text target as its code by first occurrence. The lists of categories come to the driver."""
    full = impute(df, numeric, categorical, order)
    kinds = dict(df.dtypes)
    if kinds[target] == "string":
        codes = cat_codes(df, target, order).withColumnRenamed(target, "_of")
        full = full.join(codes, F.col(target) == F.col("_of")).withColumn(target, F.col("code")).drop("_of", "code")
    for c in categorical:
        full = encode_num(full, c, [r[0] for r in df.filter(F.col(c).isNotNull()).select(c).distinct().orderBy(c).collect()])
    return libsvm_lines(full.drop(order) if order != target else full, target)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each archive's first member, some thousands at a time."""
    for b in batches:
        for content in b.column(0).to_pylist():
            with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as member:
                lines = io.TextIOWrapper(member, encoding="utf-8")
                while part := list(itertools.islice(lines, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array([x.rstrip("\r\n") for x in part], pa.string())], names=["value"])


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix: .arff, .libsvm, else annotated TSV; a zip's first member is annotated TSV, unpacked where it is read."""
    if path.endswith(".zip"):
        lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_members, "value string")
        return parse_afm(lines, lines.first()[0])
    return read_arff(spark, path) if path.endswith(".arff") else read_libsvm(spark, path) if path.endswith(".libsvm") else read_afm(spark, path)


def save(df: DataFrame, path: str, case: str = "case", target: str | None = None) -> None:
    """``df`` (case and features) in the format of the suffix: .arff, .libsvm (then of numbers, with ``target``) or annotated TSV."""
    if path.endswith(".arff"):
        lines = arff_lines(df.drop(case), "data").orderBy("part")
    elif path.endswith(".libsvm"):
        lines = libsvm_lines(df.drop(case), target)
    else:
        lines = afm_lines(df, case).orderBy("at")
    lines.select("line").write.mode("overwrite").text(path)


def tsv_lines(df: DataFrame) -> DataFrame:
    """line: the columns as text, missing is NA; how predictions, votes, importances and counters are written."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NA")) for c in df.columns]).alias("line"))


def read_sf(spark: SparkSession, path: str) -> DataFrame:
    """forest, tree, path, feature, threshold, left, pred, weight, target, intercept of a stochastic-forest file."""
    rows = _lines(spark, path).filter("trim(value) <> ''")
    key = lambda k: F.nullif(F.regexp_extract("value", rf'{k}=(?:"([^"]*)"|([^,]*))', 1), F.lit(""))
    both = lambda k: F.coalesce(key(k), F.nullif(F.regexp_extract("value", rf"(?:^|,){k}=([^,\"]+)", 1), F.lit("")))
    tree_line, forest_line = F.col("value").startswith("TREE="), F.col("value").startswith("FOREST=")
    # what the last line of a kind says is carried on: inside ranges of lines, then from one range to the next (one row for each)
    said = {"weight": F.when(tree_line, F.coalesce(both("WEIGHT").cast("double"), F.lit(1.0))), "target": F.when(tree_line | forest_line, both("TARGET")), "intercept": F.when(forest_line, both("INTERCEPT").cast("double"))}
    rows = cut(rows.withColumns({**said, "_f": forest_line.cast("long"), "_t": tree_line.cast("long")}).repartitionByRange("_i").withColumn("_part", F.spark_partition_id()))
    ends = rows.groupBy("_part").agg(F.sum("_f").alias("_f"), F.sum("_t").alias("_t"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_i"))).alias(c) for c in said])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_part").alias("_own"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_b{c}") for c in ("_f", "_t")], *[F.last(c, True).over(before).alias(f"_b_{c}") for c in said])
    upto = Window.partitionBy("_part").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(ends, F.col("_part") == F.col("_own")).select("value", (F.sum("_f").over(upto) + F.col("_b_f")).alias("forest"), (F.sum("_t").over(upto) + F.col("_b_t") - 1).alias("tree"), *[F.coalesce(F.last(c, True).over(upto), f"_b_{c}").alias(c) for c in said])
    rows = rows.withColumn("intercept", F.coalesce("intercept", F.lit(0.0)))
    nodes = rows.filter(F.col("value").startswith("NODE="))
    numeric = both("SPLITTERTYPE") == "NUMERICAL"
    return nodes.select("forest", F.col("tree").cast("int").alias("tree"), both("NODE").alias("path"), both("SPLITTER").alias("feature"), F.when(numeric, both("LVALUES").cast("double")).alias("threshold"), F.when(~numeric, F.split(both("LVALUES"), ":")).alias("left"), both("PRED").alias("pred"), "weight", "target", "intercept")


def sf_lines(nodes: DataFrame, target: str, intercept: float = 0.0) -> DataFrame:
    """tree, at, line of a stochastic-forest file: trees in order, nodes in preorder with the M child last."""
    n_trees = nodes.agg(F.max("tree")).first()[0] or 0
    top = nodes.sparkSession.createDataFrame([(-1, "", f'FOREST=RF,TARGET="{target}",NTREES={n_trees + 1},INTERCEPT={intercept}')], "tree int, at string, line string")
    at = F.translate("path", "*LRM", "0123")
    trees = nodes.filter("path = '*'").select("tree", F.lit("").alias("at"), F.concat(F.lit("TREE="), F.col("tree"), F.lit(f',TARGET="{target}",WEIGHT='), F.col("weight").cast("string")).alias("line"))
    split = F.when(F.col("feature").isNull(), "").when(F.col("threshold").isNotNull(), F.concat(F.lit(',SPLITTER="'), "feature", F.lit('",SPLITTERTYPE=NUMERICAL,LVALUES='), F.col("threshold").cast("string"))).otherwise(F.concat(F.lit(',SPLITTER="'), "feature", F.lit('",SPLITTERTYPE=CATEGORICAL,LVALUES="'), F.array_join("left", ":"), F.lit('"')))
    body = nodes.select("tree", at.alias("at"), F.concat(F.lit("NODE="), "path", F.lit(',PRED="'), F.coalesce("pred", F.lit("")), F.lit('"'), split).alias("line"))
    return top.unionByName(trees).unionByName(body)


def tree_arrays(nodes: list[dict], tree: int) -> list[dict]:
    """A tree as preorder records with child positions, -1 for leaves."""
    by_path = {n["path"]: n for n in nodes if n["tree"] == tree}
    out: list[dict] = []

    def walk(path: str) -> int:
        n, at = by_path[path], len(out)
        out.append({"feature": n["feature"], "threshold": n["threshold"], "pred": n["pred"], "left_child": -1, "right_child": -1})
        if n["feature"] is not None:
            for side, key in (("L", "left_child"), ("R", "right_child")):
                if path + side in by_path:
                    out[at][key] = walk(path + side)
        return at

    if "*" in by_path:
        walk("*")
    return out
