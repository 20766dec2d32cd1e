"""The graded pipeline on hand-made notebooks: instructor answers, keys, templates by checksum, context."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import code as C
from corpusloom.operators import cells as K
from corpusloom.operators import dedup as D
from corpusloom.operators import grading as G
from corpusloom.plans import pipelines
from corpusloom.sources import records

EMPTY = "# YOUR CODE HERE\nraise NotImplementedError()"
CHECK = {"nbgrader": {"grade": True, "solution": False, "locked": True, "grade_id": "t", "points": 1.0, "checksum": "x"}}


def cell(kind, source, **more):
    return {"cell_type": kind, "source": source, "execution_count": 1, "outputs": []} | more


def mark(name, checksum=None):
    held = {"grade": False, "solution": True, "locked": False, "grade_id": name}
    return {"nbgrader": held | ({"checksum": checksum} if checksum else {})}


def released(text, name):
    return hashlib.md5(f"{text}codeFalseTrueFalse{name}".encode()).hexdigest()


def run(spark, tmp_path, books, **more):
    path = tmp_path / "nbs"
    path.mkdir()
    nbs = [{"cells": cells, "metadata": {"nb_index": i, "repo": "r", "path": f"p{i}", "kernelspec": {"name": "python3", "language": "python"}}} for i, cells in enumerate(books)]
    (path / "a.jsonl").write_text("\n".join(map(json.dumps, nbs)))
    return pipelines.graded(records.read_records(spark, str(path), records.NOTEBOOK), **more).collect()


def answer_books(answer, n=2):
    return [[cell("markdown", "do it"), cell("code", answer, metadata=mark("a", "c")), cell("code", "assert f()", metadata=CHECK)] for _ in range(n)]


def test_an_instructor_span_that_starts_deeper_than_it_ends(spark, tmp_path):
    source = "def f(x):\n    if x:\n        ### BEGIN SOLUTION\n        x = 'a'\n    return x\n    ### END SOLUTION\n"
    r = run(spark, tmp_path, answer_books(source))[0]
    assert r["status"] == "success" and r["target"]["source"] == source.rstrip("\n")
    assert " ".join(r["extracted_tokens"]) == "NEWLINE INDENT x = 'jupyter_string' NEWLINE return x"
    assert " ".join(r["template_tokens"]) == "def f ( x ) : NEWLINE INDENT if x : NEWLINE"


def test_an_instructor_span_of_comments_only_is_dropped(spark, tmp_path):
    r = run(spark, tmp_path, answer_books("x = 1\n# BEGIN SOLUTION\n# nothing here\n# END SOLUTION\n"))[0]
    assert (r["status"], r["extracted_tokens"], r["context"]) == ("empty extracted tokens", ["NEWLINE"], None)


@pytest.mark.parametrize(("sources", "want"), [
    (["x = 1\n# BEGIN SOLUTION\ny = 2\n# END SOLUTION", "z = 1"], "only 1 solution"), (["# BEGIN SOLUTION\n\n# END SOLUTION\nx = 1"] * 2, "no span"), (["# END SOLUTION\nx = 1\n# BEGIN SOLUTION"] * 2, "no span"),
])
def test_instructor_answers_that_give_nothing(spark, tmp_path, sources, want):
    books = [[cell("markdown", "do it"), cell("code", s, metadata=mark("a", "c"))] for s in sources]
    assert [r["status"] for r in run(spark, tmp_path, books)] == [want]


def test_questions_are_keyed_by_words_within_the_context(spark, tmp_path):
    """Text five above the target, an empty markdown cell near it: the text's words and distance are the key."""
    book = lambda text: [cell("markdown", text), cell("code", "a = 1"), cell("code", "b = 1"), cell("markdown", ""), cell("code", "c = 1"), cell("code", "k = 2", metadata=mark("a")), cell("code", "assert k", metadata=CHECK)]
    got = run(spark, tmp_path, [book("**One** task"), book("One   task"), book("another task")])
    assert sorted((r["question"], r["n_solutions"]) for r in got) == [("One task\x015\x01dummy-checksum", 2), ("another task\x015\x01dummy-checksum", 1)]
    near = [[*book("text")[:3], *[cell("code", f"m{i} = 1") for i in range(3)], *book("text")[3:]]]
    (tmp_path / "far").mkdir()
    assert run(spark, tmp_path / "far", near, context_len=5)[0]["question"] == "\x010\x01dummy-checksum"


def test_records_carry_context_nearest_first(spark, tmp_path):
    book = [cell("markdown", "first `x`"), cell("code", "import numpy as np\nnp.ones(3)"), cell("raw", "y = 1"), cell("code", ""), cell("code", "assert old", metadata=CHECK), cell("markdown", "do it"), cell("code", EMPTY, metadata=mark("a", released(EMPTY, "a"))), cell("code", "assert k", metadata=CHECK)]
    solved = [*book[:6], cell("code", "import re\nk = 2", metadata=mark("a", released(EMPTY, "a"))), book[7]]
    r = next(r for r in run(spark, tmp_path, [book, solved]) if r["n_solutions"])
    assert (r["status"], r["num_cells_above"], r["imports"], r["template_tokens"]) == ("success", 6, ["numpy", "np", "re"], [])
    assert [(c["distance_target"], c["cell_type"], c["nl"]) for c in r["context"]] == [(1, "markdown", ["do", "it"]), (4, "raw", None), (5, "code", None), (6, "markdown", ["first", "CTAG", "x", "CTAG"])]
    assert r["context"][2]["code"]["api_sequence"] == ["ones"] and r["context"][1]["code"]["code_tokens_clean"] == ["y", "=", "1"]


def test_templates_by_checksum_over_a_grid(spark):
    """More templates and marks than one cell of the grid holds; some were released with the checksum asked for."""
    texts = [f"t{i} = 0\nraise NotImplementedError()" for i in range(37)]
    schema = "question string, cell_type string, nbgrader " + records.GRADING
    asked = [(f"q{i}", "code", (False, True, False, f"g{i}", None, released(texts[i % 37], f"g{i}") if i % 5 else f"none{i}")) for i in range(60)] + [("null", "code", None)]
    have = [(t, True, (False, True, False, "own", None, released(t, f"g{i}") if i < 9 else "other")) for i, t in enumerate(texts)] + [("k = 1", False, None)]
    marks = spark.createDataFrame(asked, schema)
    templates = spark.createDataFrame(have, "source string, is_boilerplate boolean, nbgrader " + records.GRADING)
    found = G.boilerplates_by_checksum(marks, templates, block=8)
    assert {r["question"]: r["released"] for r in found.collect()} == {f"q{i}": texts[i % 37] if i % 5 else None for i in range(60)} | {"null": None}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_context_and_imports_of_a_long_notebook(spark):
    n = 20_000
    kind = F.when(F.col("id") % 10 == 0, "markdown").otherwise("code")
    cells = spark.range(n).select(F.lit(1).alias("nb_index"), F.col("id").cast("int").alias("cell_index"), kind.alias("cell_type"), F.when(kind == "code", F.concat(F.lit("import m"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).otherwise("text").alias("source"))
    some = K.import_places(cells).where(F.col("cell_index").isin(5, 19_999))
    got = {r["cell_index"]: r["imports"] for r in K.sliced_imports(some, K.cell_imports(cells)).collect()}
    assert got[5] == ["mb", "mc", "md", "me", "mf"] and len(got[19_999]) == 18_000
    at = K.sliced_context(some.select("nb_index", "cell_index"), K.notebook_context(cells, {"source": "source"}), 11_111)
    assert {r["cell_index"]: (len(r["context"]), r["context"][0]["distance_target"], r["context"][-1]["distance_target"]) for r in at.collect()} == {5: (5, 1, 5), 19_999: (11_111, 1, 11_111)}
    assert K.last_markdown(cells).where("cell_index = 19999").first()["above"]["cell_index"] == 19_990


def test_running_imports_of_every_cell(spark):
    rows = [(1, 0, "code", "import a"), (1, 1, "markdown", "import b"), (1, 2, "code", "x = 1\nfrom c import d"), (2, 0, "code", "y")]
    cells = spark.createDataFrame(rows, "nb_index long, cell_index int, cell_type string, source string")
    assert {(r["nb_index"], r["cell_index"]): r["imports"] for r in K.running_imports(cells).collect()} == {(1, 0): ["a"], (1, 1): ["a"], (1, 2): ["a", "d"], (2, 0): []}


def test_stretches_of_tokens_are_laid_out_as_whole_code_is(spark):
    source = "def f(x):\n    # hi\n    return 'a'\n\n\ny = f'{x}'\n"
    rows = spark.createDataFrame([(source,), ("# only\n",)], "s string").select(C.analyze(F.col("s")).alias("c"), "s")
    got = rows.select(C.laid_out(C.typed_tokens(F.col("c")))).collect()
    assert got[0][0] == C.clean(C.tokens_of(source)) and got[1][0] is None


@pytest.mark.parametrize("n", [1, 7, 200, 1000])
def test_an_exact_split(spark, n):
    rows = spark.range(n).select("id", F.array((F.col("id") % max(1, n // 2)).cast("string"), F.lit(None).cast("string")).alias("tokens"))
    part = {r["id"]: r["part"] for r in D.split_exactly(rows, ["id"], "tokens").collect()}
    order = sorted(range(n), key=lambda i: hashlib.md5(f"0:{i}".encode()).hexdigest())
    test = set(order[: -(-n * 55 // 100)])
    held = {i % max(1, n // 2) for i in order if i not in test}
    assert part == {i: "test" if i in test and i % max(1, n // 2) not in held else "dev" for i in range(n)}


def test_an_exact_split_of_nothing_and_of_repeated_ids(spark):
    none = spark.createDataFrame([], "id long, key string")
    assert D.split_exactly(none, ["id"], "key").count() == 0
    same = spark.createDataFrame([(1, None), (1, None), (1, None)], "id long, key string")
    assert [r["part"] for r in D.split_exactly(same, ["id"], "key").collect()] == ["test"] * 3


def test_the_kth_smallest(spark):
    for numbers in ([5], [3, 3, 3], [0, 1 << 59, (1 << 59) + 1, (1 << 60) - 1], list(range(0, 5000, 7))):
        frame = spark.createDataFrame([(x,) for x in numbers], "h long")
        for k in {1, len(numbers), (len(numbers) + 1) // 2}:
            assert D.kth_smallest(frame, k) == sorted(numbers)[k - 1]
