"""The command lines end to end on a small table: train, score, proximity, folds, convert."""

import zipfile

import numpy as np
from pyspark.sql import functions as F

from timberline import cli
from timberline.operators import targets
from timberline.sources import formats


def lines(spark, path):
    return [r["value"].split("\t") for r in spark.read.text(str(path)).collect()]


def test_commands(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        a, c = float(rng.integers(0, 20)), "rgb"[i % 3]
        rows.append(f"case{i}\t{a if i % 11 else 'NA'}\t{c}\t{rng.normal():.3f}\t{'yes' if (a > 9) != (c == 'r') else 'no'}")
    data = tmp_path / "d.afm"
    data.write_text("\n".join([".\tN:a\tC:c\tN:noise\tC:y", *rows]) + "\n")
    model, imp, oob, out, votes = (str(tmp_path / x) for x in ("m.sf", "imp.tsv", "oob.tsv", "p.tsv", "v.tsv"))
    (tmp_path / "black.txt").write_text("N:noise\nN:nothing\n")
    f = cli.main(["train", str(data), "--target", "C:y", "--trees", "5", "--m-try", "2", "--leaf", "1", "--balance", "--blacklist", str(tmp_path / "black.txt"), "--model", model, "--importance", imp, "--oob", oob, "--cost", '{"yes": 1.5, "no": 1}', "--test"], spark)
    assert {r["feature"] for r in f.nodes.filter("feature is not null").collect()} == {"N:a", "C:c"}
    assert {r[0] for r in lines(spark, imp)} == {"N:a", "C:c"} and len(lines(spark, oob)) == 90
    cli.main(["score", str(data), model, "--out", out, "--votes", votes], spark)
    scored = lines(spark, out)
    assert len(scored) == 90 and sum(r[1] == r[2] for r in scored) > 55
    assert f.predict(cli.table(spark, str(data), "C:y")[0]).count() == sum(r[1] != "NA" for r in scored) == len(lines(spark, votes))
    groups = cli.main(["proximity", str(data), model, "--members", str(tmp_path / "mem"), "--branches", str(tmp_path / "br")], spark)
    assert groups.agg(F.sum(F.when(F.col("leaves_a") == F.col("leaves_b"), F.col("cases_a")))).first()[0] == len(lines(spark, tmp_path / "mem"))
    assert {r[1] for r in lines(spark, tmp_path / "br")} <= {"N:a", "C:c"}
    cli.main(["folds", str(data), str(tmp_path / "f"), "--target", "C:y", "--folds", "3", "--stratify"], spark)
    parts = [formats.load(spark, str(tmp_path / "f" / f"{p}_{i}.afm")).count() for i in range(3) for p in ("train", "test")]
    assert all(a == 2 * b for a, b in zip(parts[::2], parts[1::2], strict=True)) and sum(parts[1::2]) >= 85
    cli.main(["convert", str(data), str(tmp_path / "d.arff")], spark)
    assert formats.load(spark, str(tmp_path / "d.arff")).count() == 90
    cli.main(["convert", str(data), str(tmp_path / "anon.afm"), "--target", "C:y", "--anonymous"], spark)
    assert formats.load(spark, str(tmp_path / "anon.afm")).columns == ["case", "C:0", "N:1", "N:2", "C:3"]
    hidden = formats.load(spark, str(tmp_path / "anon.afm")).collect()
    assert {r["case"] for r in hidden} == {str(i) for i in range(90)} and {r["C:3"] for r in hidden} == {"0", "1", "2"}


def test_archives_and_long_rows(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "d.zip", "w") as z:
        z.writestr("d.afm", ".\tN:a\tC:b\n1\t2.5\tx\n2\tNA\ty\n")
    assert sorted(map(tuple, formats.load(spark, str(tmp_path / "d.zip")).collect())) == [("1", 2.5, "x"), ("2", None, "y")]
    (tmp_path / "d.libsvm").write_text("1 " + " ".join(f"{i}:1" for i in range(1, 1001)) + "\n2 7:1\n")
    got = formats.load(spark, str(tmp_path / "d.libsvm"))
    assert got.count() == 1001 and {r["case_id"] for r in got.select("case_id").distinct().collect()} == {0, 1}


def test_costs_of_missing_classes_are_zero():
    assert targets.class_costs('{"b": 2, "z": 9}', ("a", "b")) == (0.0, 2.0)
