import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import code
from corpusloom.operators import cells as K
from corpusloom.operators import dedup as D
from corpusloom.plans import generated, pipelines
from corpusloom.sources import records, work

CELLS = "nb_index long, cell_index int, repo string, path string, cell_type string, source string"


def test_code_tags_blacklist_and_repos(spark):
    rows = [(1, 0, "r", "a", "markdown", "use `x`"), (1, 1, "r", "a", "code", "x"), (2, 0, "r", "b", "markdown", "plain"), (2, 1, "q", "c", "code", "`no`")]
    cells = spark.createDataFrame(rows, CELLS)
    assert {(r["nb_index"], r["cell_index"]) for r in K.with_code_tags(cells).collect()} == {(1, 0), (1, 1)}
    assert K.without_sources(cells, ["x", "plain"]).count() == 2 and K.without_sources(cells, []).count() == 4
    assert {tuple(r) for r in K.repos_with_cells(cells).collect()} == {("r", 3, 2), ("q", 1, 1)}


def test_python_kernels_and_made_cells(spark):
    rows = [(("python3", "python"),), (("ir", "R"),), (None,), (("python2", "python"),)]
    df = spark.createDataFrame(rows, "k struct<name:string,language:string>")
    got = df.select(K.is_python_notebook(F.col("k")), K.is_python_notebook(F.col("k"), 3)).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (False, False), (True, False)]
    r = spark.range(1).select(K.make_cell(F.lit("code"), F.array(F.lit("a"), F.lit("b"))).alias("c")).first()["c"]
    assert (r["cell_type"], r["source"], r["execution_count"], r["outputs"]) == ("code", "a\nb", None, [])


def test_any_test_below(spark):
    df = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, False)], "nb_index long, cell_index int, test boolean")
    out = K.test_outcomes(df, F.col("test"), F.lit(True), F.lit(False), ["nb_index"], ["cell_index"])
    assert [r["any_test_below"] for r in out.orderBy("cell_index").collect()] == [True, False, False]


def test_distinct_values_of_arrays(spark):
    df = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x", "y"]), ("a", ["xy"]), ("b", None)], "g string, v array<string>")
    assert {tuple(r) for r in D.distinct_values(df, ["g"], "v").collect()} == {("a", 2), ("b", 1)}


def test_plain_tokens_of_pieces(spark):
    df = spark.createDataFrame([("    return 'x'  # why",), ("s = '''",), (None,)], "s string").coalesce(1)
    assert [r[0] for r in df.select(code.plain_tokens(F.col("s"))).collect()] == [["INDENT", "return", "'jupyter_string'"], None, None]


def test_split_size_and_notebook_files(spark, tmp_path):
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "t.txt").write_text("line\n" * 50_000)
    with records.split_size(spark, "64k"):
        assert spark.read.text(str(tmp_path / "t.txt")).rdd.getNumPartitions() >= 3
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == held
    cell = {"cell_type": "code", "source": "x", "execution_count": 1, "outputs": []}
    (tmp_path / "n.jsonl").write_text("\n".join(json.dumps({"cells": [cell], "metadata": {"nb_index": i, "repo": "r", "path": "p"}}) for i in range(3)))
    records.dump_notebooks(records.read_records(spark, str(tmp_path / "n.jsonl"), records.NOTEBOOK), str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("nb_*.ipynb"))
    assert [f.name for f in files] == [f"nb_{i}.ipynb" for i in range(3)] and all(json.loads(f.read_text())["cells"][0]["source"] == "x" for f in files)


def test_context_holds_words_and_analysis(spark, tmp_path):
    cell = lambda kind, source, **more: {"cell_type": kind, "source": source, "execution_count": 1, "outputs": []} | more
    test = {"nbgrader": {"grade": True, "solution": False}}
    cells = [cell("code", "def f(): pass"), cell("code", "%time\nz()"), cell("code", "assert f()", metadata=test), cell("markdown", "use `f` now"), cell("code", "y = f(1)")]
    (tmp_path / "n.jsonl").write_text(json.dumps({"cells": cells, "metadata": {"nb_index": 1, "repo": "r", "path": "p"}}))
    r = pipelines.train(records.read_records(spark, str(tmp_path / "n.jsonl"), records.NOTEBOOK)).collect()
    assert len(r) == 1 and r[0]["nl"] == "use `f` now" and r[0]["nl_tokens"] == ["use", "CTAG", "f", "CTAG", "now"]
    context = r[0]["context"]
    assert [c["distance_target"] for c in context] == [1, 3, 4]  # the test at 2 is no context
    assert context[0]["nl"] == r[0]["nl_tokens"] and context[0]["code"] is None and context[1]["code"] is None
    assert context[2]["code"]["api_sequence_declared"] == ["def", "f", "f"] and context[2]["code"]["api_sequence"] == [code.NO_CALLS]


def test_train_analyses_code_once(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text(json.dumps({"cells": [], "metadata": {"nb_index": 1}}))
    plan = pipelines.train(records.read_records(spark, str(tmp_path / "n.jsonl"), records.NOTEBOOK))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 2 * plan.count("== Initial Plan ==") + 2 and plan.count("FileScan json") <= 2


def test_combined(spark):
    a, b = (spark.createDataFrame([(i, "x")], f"nb_index long, {c} string") for i, c in ((1, "nl"), (2, "code")))
    out = pipelines.combined({"train": a, "exercise": b}, ["nl", "code"], ["nb_index"])
    assert {(r["kind"], r["nl"], r["code"]) for r in out.collect()} == {("train", "x", None), ("exercise", None, "x")}


def test_generated_pipelines_against_plain_python(spark, tmp_path):
    rows = [(c, t, role, text) for c in range(8) for t, (role, text) in enumerate([("user", "a" * (c % 2 + 3)), ("assistant", "b" * (c + 1)), ("user", ""), ("assistant", "b")])]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    train = generated.train(spark, str(tmp_path)).collect()
    assert len(train) == 2  # codes of 8 lengths, then texts of 2
    got = generated.exercise(spark, str(tmp_path)).collect()
    assert got and {r["status"] for r in got} <= {"success", "only 1 solution", "only from 1 repo"}
    for r in got:
        assert r["n_repos"] >= 2 if r["status"] == "success" else True
    graded = generated.graded(spark, str(tmp_path)).collect()
    assert {r["status"] for r in graded} <= {"success", "no autograder tests or none passed", "only boiler", "no boilerplate", "only 1 solution", "empty extracted tokens"}
    assert all(r["extracted"].startswith("answer = compute(") and r["template_tokens"] == "" for r in graded if r["status"] == "success")


def test_work_folder(spark):
    assert work.work_dir(spark) != work.work_dir(spark)
    table = work.WorkTable(spark.range(3))
    assert table.df.count() == 3
    table.drop()


def test_copies_are_one_class(spark):
    rows = [("g", i, ["x", "y", "z"]) for i in range(6)] + [("g", 10, ["z", "y", "x", "w"]), ("g", 11, ["q", None, ""]), ("h", 12, ["x", "y", "z"]), ("h", 13, None)]
    df = spark.createDataFrame(rows, "k string, id long, items array<string>").repartition(3)
    members, pairs = D.similar_classes(df, ["k"], "id", "items")
    assert {tuple(r) for r in members.select("k", "id", "class", "n").collect()} == {*(("g", i, 0, 3) for i in range(6)), ("g", 10, 10, 4), ("g", 11, 11, 1), ("h", 12, 12, 3)}
    assert [tuple(r) for r in pairs.collect()] == [("g", 0, 10, 3, 4)]
    want = {("g", i, j, 3, 3) for i in range(6) for j in range(i + 1, 6)} | {("g", i, 10, 3, 4) for i in range(6)}
    assert {tuple(r) for r in D.similar_pairs(df, ["k"], "id", "items").collect()} == want


def brute_links(rows):
    """id -> (class, n, links of the class) by comparing all sets; a null group keeps its classes and has no links."""
    sets = {i: (g, frozenset(x for x in items or [] if x)) for g, i, items in rows}
    classes = {}
    for i in sorted(sets):
        if sets[i][1]:
            classes.setdefault(sets[i], i)
    similar = lambda a, b: a != b and a[0] == b[0] and a[0] is not None and 2 * len(a[1] & b[1]) >= len(a[1] | b[1])
    links = {k: sum(similar(k, other) for other in classes) for k in classes}
    return {i: (classes[k], len(k[1]), links[k]) for i, k in sets.items() if k[1]}


@pytest.mark.parametrize("pairing", [D.similar_kinds, D.banded_kinds])
def test_links_against_brute_force(spark, pairing):
    """Pairs at a share of exactly one half, many sets that differ in one item of their own, chains, copies, a null group."""
    r = random.Random(3)
    sets = [[f"a{i // 2}", f"b{i // 2}", f"own{i}"] for i in range(800)] + [["c1", "c2", f"x{i}"] for i in range(60)] + [["c1"], ["c1", "c2"], ["c2", None, ""], [], None]
    sets += [[f"r{r.randint(0, 25)}" for _ in range(r.randint(1, 7))] for _ in range(150)] + [["c1", "c2", "x1"]] * 3
    rows = [(g, i, s) for i, (g, s) in enumerate([("g", s) for s in sets] + [("h", s) for s in sets[800:900]] + [(None, ["c1", "c2"]), (None, ["c1", "c2"]), (None, ["c1"])])]
    df = spark.createDataFrame(rows, "k string, id long, items array<string>").repartition(3)
    assert {x["id"]: (x["class"], x["n"], x["n_links"]) for x in D.linked_classes(df, ["k"], "id", "items", pairing=pairing).collect()} == brute_links(rows)


def test_sets_with_the_same_links_cost_no_pairs(spark):
    df = spark.createDataFrame([("g", i, ["c1", "c2", f"x{i}"]) for i in range(50)] + [("g", i, ["c1", f"y{i}"]) for i in range(50, 100)], "k string, id long, items array<string>")
    members, sets = D.set_classes(df, ["k"], "id", "items")
    classes, kinds = D.kinds_of(sets, ["k"], 50)
    assert sorted(tuple(x) for x in kinds.select("kind", "n", "m").collect()) == [(0, 3, 50), (50, 2, 50)] and classes.count() == 100
    assert [tuple(x) for x in D.similar_kinds(kinds, ["k"]).collect()] == [("g", 0, 0, 2, 4)]
    assert len(D.similar_pairs(df, ["k"], "id", "items").collect()) == 50 * 49 // 2


def test_nothing_that_grows_is_broadcast(spark, tmp_path):
    """Work tables of few bytes in files may hold many rows: their joins are merged, not sent through the driver."""
    rows = [(c, t, ("user", "assistant")[t % 2], "a" * (c % 4 + 1)) for c in range(12) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = generated.exercise_split(spark, str(tmp_path))
    assert out.count() > 0
    pairs = pipelines.D.solution_pairs(spark.createDataFrame([("r", "solution", ["a", "b"]), ("r", "hw", ["a"])], "repo string, path string, items array<string>"))
    assert [tuple(r) for r in pairs.collect()] == [("r", "solution", "hw")]
    for df in (out, pairs, generated.exercise(spark, str(tmp_path))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
