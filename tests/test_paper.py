"""The bodies and frames of LaTeX tables, line by line."""

import pytest

from quillon.operators import paper

SEEDS = [1, 2]


@pytest.fixture(scope="module")
def order(spark):
    return spark.createDataFrame([("A", "plain", 0, 0, "No_gate"), ("B", "plain", 0, 1, "50 % gate"), ("C", "wide", 1, 2, "x"), ("D", "wide", 1, 3, "y")], "arm string, family string, block int, pos int, label string")


def body(lines):
    return [r.line for r in lines.orderBy("block", "pos").collect()]


def test_results_and_classes(spark, order):
    summary = spark.createDataFrame([("A", 2, 0.9541, 0.0026, 49.136, 17.2), ("B", 1, 0.5, None, 52.0, 1.005), ("C", 2, None, None, None, None)], "arm string, n_seeds int, acc_mean double, acc_std double, params_m double, gflops double")
    assert body(paper.results(summary, order, ["acc"])) == ["A & No\\_gate & 2 & $95.41 \\pm 0.26$ & 49.14M / 17.20 \\\\", "B & 50 \\% gate & 1 & $50.00$ & 52.00M / 1.01 \\\\", "C & x & 2 & -- & -- \\\\", "D & y & 0 & -- & -- \\\\"]
    rows = spark.createDataFrame([("A", "Rust", 0.9, 0.01), ("B", "Rust", 0.8, None), ("A", "a_b", 1.0, 0.0)], "arm string, class_name string, mean double, std double")
    assert body(paper.by_class(rows, ["A", "B"], ["a_b", "Rust", "none"])) == ["a\\_b & $100.00 \\pm 0.00$ & -- \\\\", "Rust & $90.00 \\pm 1.00$ & $80.00$ \\\\", "none & -- & -- \\\\"]


def test_intervals(spark):
    rows = spark.createDataFrame([("B", "A", 1, 0.012, -0.001, 0.02), ("B", "A", 2, -0.004, -0.01, 0.0), ("D", "C", 1, 0.5, 0.25, 0.75), ("B", "A", 9, 9.0, 9.0, 9.0)], "a string, b string, seed int, delta double, ci_low double, ci_high double")
    contrasts = spark.createDataFrame([("B", "A", "plain", 0, 0), ("D", "C", "wide", 1, 1), ("X", "Y", "wide", 1, 2)], "a string, b string, family string, block int, pos int")
    assert body(paper.intervals(rows, contrasts, SEEDS)) == ["plain & B $-$ A & $+1.20$ $[-0.10, +2.00]$ & $-0.40$ $[-1.00, +0.00]$ & $+0.40$ & 1/2 \\\\", "wide & D $-$ C & $+50.00$ $[+25.00, +75.00]$ & -- & $+50.00$ & 1/2 \\\\", "wide & X $-$ Y & -- & -- & -- & -- \\\\"]
    assert sorted(map(tuple, paper.excluding_zero(rows).collect())) == [("B", "A", 9), ("D", "C", 1)]


def test_complexity_and_confusions(spark, order):
    models = spark.createDataFrame([("A", 49.5, 17.0), ("B", 50.7345, 17.456), ("C", 1.0, 1.0), ("D", 0.999, 2.0)], "arm string, params_m double, gflops double")
    assert body(paper.complexity(models, order, {"plain": "A", "wide": "C"})) == ["A & No\\_gate & 49.50 & -- & 17.00 \\\\", "B & 50 \\% gate & 50.73 & 1{,}234{,}500 & 17.46 \\\\", "C & x & 1.00 & -- & 1.00 \\\\", "D & y & 1.00 & -1{,}000 & 2.00 \\\\"]
    counts = spark.createDataFrame([("A", 1, 3, 4), ("A", 2, 0, 1), ("C", 1, 2, 2)], "arm string, seed int, there int, back int")
    assert body(paper.confusions(counts, order)) == ["A & 3 & 5 & 8 \\\\", "B & -- & -- & -- \\\\", "C & 2 & 2 & 4 \\\\", "D & -- & -- & -- \\\\"]


def test_consensus(spark):
    rows = [("t/a_1.jpg", 1, "Rust", "Blight", True, ""), ("t/a_1.jpg", 2, "Rust", "Blight", True, "Blight"), ("t/b.jpg", 1, "Rust", "Blight", True, "Ambiguous"), ("t/b.jpg", 2, "Rust", "Spot", True, None), ("t/c.jpg", 1, "Rust", "Spot", True, None), ("t/d.jpg", 1, "Rust", "Spot", True, "Rust"), ("t/d.jpg", 2, "Rust", "Spot", False, None), ("t/e.jpg", 1, "Rust", "Spot", True, None), ("t/e.jpg", 2, "Rust", "Spot", True, None)]
    got = body(paper.consensus(spark.createDataFrame(rows, "image_id string, seed int, true_label string, wrong_label string, unanimous boolean, verdict string"), SEEDS))
    assert got == ["\\texttt{a\\_1.jpg} & Rust & Blight & yes & Suspected mislabel \\\\", "\\texttt{b.jpg} & Rust & mixed & no & Ambiguous \\\\", "\\texttt{d.jpg} & Rust & mixed & no & check \\\\", "\\texttt{e.jpg} & Rust & Spot & yes & -- \\\\"]


def test_stress_grouped_and_settings(spark, order):
    runs = spark.createDataFrame([("A", 1, 0.9, 0.5), ("A", 2, 0.8, 0.7), ("C", 1, 0.7, 0.1)], "arm string, seed int, clean double, worst double")
    assert body(paper.stress(runs, order, ["clean", "worst"])) == ["A & 2 & $85.00 \\pm 7.07$ & $60.00 \\pm 14.14$ \\\\", "B & 0 & -- & -- \\\\", "C & 1 & $70.00$ & $10.00$ \\\\", "D & 0 & -- & -- \\\\"]
    rows = spark.createDataFrame([("A", "blur", 0.5), ("A", "blur", 0.7), ("B", "blur", 0.6004), ("A", "hue", 0.2), ("B", "hue", 0.3), ("C", "blur", 0.1), ("D", "hue", 0.1)], "arm string, group string, value double")
    assert body(paper.grouped(rows, order, ["hue", "blur"])) == ["A & 20.0 & \\textbf{60.0} \\\\", "B & \\textbf{30.0} & \\textbf{60.0} \\\\", "C & -- & \\textbf{10.0} \\\\", "D & \\textbf{10.0} & -- \\\\"]
    configs = spark.createDataFrame([("plain", "r1", "epochs", "100"), ("plain", "r2", "epochs", "100"), ("wide", "r3", "epochs", "50"), ("wide", "r4", "epochs", "60"), ("plain", "r1", "opt", "Adam_W")], "family string, run string, key string, value string")
    assert body(paper.settings(configs, ["plain", "wide"], {"opt": "Optimiser", "epochs": "Epochs", "lr": "Rate"})) == ["Optimiser & Adam\\_W & -- \\\\", "Epochs & 100 & differs \\\\", "Rate & -- & -- \\\\"]
    from pyspark.sql import functions as F

    assert spark.range(1).select(paper.power_of_ten(F.lit(5e-4))).first()[0] == "$5\\times10^{-4}$"


def test_frame(spark):
    lines = spark.createDataFrame([(1, 0, "c \\\\"), (0, 1, "b \\\\"), (0, 0, "a \\\\")], "block int, pos int, line string")
    text = paper.framed(lines, paper.Frame("All of it.", "tab:x", "lc", ("Arm", "Share"), wide=True, scaled=True))
    assert text.splitlines() == ["\\begin{table*}[t]", "\\centering", "\\caption{All of it.}", "\\label{tab:x}", "\\resizebox{\\textwidth}{!}{%", "\\begin{tabular}{lc}", "\\toprule", "\\textbf{Arm} & \\textbf{Share} \\\\", "\\midrule", "a \\\\", "b \\\\", "\\midrule", "c \\\\", "\\bottomrule", "\\end{tabular}%", "}", "\\end{table*}"]
    with pytest.raises(ValueError):
        paper.framed(lines, paper.Frame("", "", "l", ("a",)), most=2)
