import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import solutions as S
from corpusloom.operators import cells as K
from corpusloom.operators import dedup as D
from corpusloom.plans import pipelines, queries
from corpusloom.sources import records
from corpusloom.streaming import first_records


def cell(kind, source, **more):
    return {"cell_type": kind, "source": source, "execution_count": 1, "outputs": []} | more


def notebooks(spark, tmp_path, nbs):
    path = tmp_path / "nbs"
    path.mkdir()
    (path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in nbs))
    return records.read_records(spark, str(path), records.NOTEBOOK)


def nb(i, cells, repo="r", path=None):
    return {"cells": cells, "metadata": {"nb_index": i, "repo": repo, "path": path or f"p{i}.ipynb", "kernelspec": {"name": "python3", "language": "python"}}, "nbformat": 4, "nbformat_minor": 2}


def test_train(spark, tmp_path):
    data = notebooks(spark, tmp_path, [
        nb(1, [cell("markdown", "load"), cell("code", "x = 1"), cell("code", "y = 2"), cell("markdown", "plot"), cell("code", "%time\nplt.plot(x)")]),
        nb(2, [cell("code", "a = 1"), cell("markdown", "b"), cell("code", "b = 1")]),
        nb(3, [cell("markdown", "ok"), cell("code", "c = 1"), cell("markdown", "é"), cell("code", "d = 1")]),
        nb(4, [cell("markdown", "é"), cell("markdown", "ok"), cell("code", "d = 1")]),
        nb(5, [cell("markdown", "other"), cell("code", "x = 1")]),
    ])
    rows = pipelines.train(data).collect()
    assert sorted((r["nb_index"], r["cell_index"], r["nl"]) for r in rows) == [(1, 1, "load"), (1, 4, "plot"), (2, 2, "b"), (4, 2, "ok")]
    plot = next(r for r in rows if r["cell_index"] == 4)
    assert [c["distance_target"] for c in plot["context"]] == [1, 2, 3, 4] and plot["code"]["api_sequence"] == ["plot"]


@pytest.mark.parametrize(("tests", "want"), [
    ([(3, [])], (True, False)), ([(3, [{"output_type": "error"}])], (False, True)), ([(0, [])], (False, False)), ([(None, [])], (True, False)), ([(3, []), (3, [{"output_type": "error"}])], (True, True)), ([], (None, False)),
])
def test_outcomes(spark, tests, want):
    rows = [(1, 0, False, 1, [])] + [(1, i + 1, True, n, o) for i, (n, o) in enumerate(tests)]
    df = spark.createDataFrame(rows, "nb_index long, cell_index int, test boolean, n long, outputs array<struct<output_type:string>>")
    out = K.test_outcomes(df, F.col("test"), K.cell_passed(F.col("n"), F.col("outputs")), F.size("outputs") > 0, ["nb_index"], ["cell_index"])
    r = out.where("cell_index = 0").first()
    assert (r["test_below_passed"], r["from_output_nb"]) == want


def test_graded(spark, tmp_path):
    mark = {"grade": False, "solution": True, "locked": False, "grade_id": "kurt", "checksum": "cfd442c159853a8ab697d8e98dbecdd1"}
    check = {"grade": True, "solution": False, "locked": True, "grade_id": "kurt_t", "points": 1.0, "checksum": "x"}
    book = lambda i, answer: nb(i, [cell("markdown", "do it"), cell("code", answer, metadata={"nbgrader": mark}), cell("code", "assert k()", metadata={"nbgrader": check})])
    data = notebooks(spark, tmp_path, [book(1, "def k():\n    return []"), book(2, "def k():\n    return [2, -0.5]"), book(3, "def k():\n    return [3]")])
    r = pipelines.graded(data).collect()
    assert len(r) == 1 and r[0]["status"] == "success" and r[0]["extracted"].strip() == "return [2, -0.5]"
    assert pipelines.outcomes(pipelines.graded(data)).collect()[0]["n"] == 1


def test_graded_finds_the_template_of_another_question_by_checksum(spark, tmp_path):
    empty = "# YOUR CODE HERE\nraise NotImplementedError()"
    released = lambda name: hashlib.md5(f"{empty}codeFalseTrueFalse{name}".encode()).hexdigest()
    mark = lambda name: {"nbgrader": {"grade": False, "solution": True, "locked": False, "grade_id": name, "checksum": released(name)}}
    check = {"nbgrader": {"grade": True, "solution": False, "locked": True, "grade_id": "t", "points": 1.0, "checksum": "x"}}
    book = lambda i, text, answer, name: nb(i, [cell("markdown", text), cell("code", answer, metadata=mark(name)), cell("code", "assert k()", metadata=check)])
    data = notebooks(spark, tmp_path, [book(1, "first", empty, "a"), book(2, "second", "k = 2", "b")])
    got = {r["n_solutions"]: r for r in pipelines.graded(data).collect()}
    assert got[0]["status"] == "only boiler" and (got[1]["status"], got[1]["template"], got[1]["extracted"], got[1]["template_tokens"]) == ("success", empty, "k = 2", [])


def test_trivial_templates(spark):
    rows = [(t,) for t in (["NEWLINE", *S.TRIVIAL_TOKENS], S.TRIVIAL_TOKENS, ["x", *S.TRIVIAL_TOKENS], [*S.TRIVIAL_TOKENS, "NEWLINE"], ["NEWLINE"], [])]
    assert [r[0] for r in spark.createDataFrame(rows, "t array<string>").coalesce(1).select(S.is_trivial(F.col("t"))).collect()] == [True, True, False, False, False, False]


def test_exercise(spark, tmp_path):
    same = [cell("markdown", "the first"), None, cell("markdown", "and the second"), cell("markdown", "to the end")]
    book = lambda i, repo, path, code: nb(i, [c or cell("code", code) for c in same], repo, path)
    nbs = [book(0, r, p, c) for r in ("r1", "r2") for p, c in (("hw_solution.ipynb", "s = 1"), ("hw.ipynb", "b = 0"))]
    out = pipelines.exercise(notebooks(spark, tmp_path, nbs)).collect()
    assert [(r["status"], r["target"], r["boilerplate"], r["n_repos"]) for r in out] == [("success", "s = 1", "b = 0", 2)]


def test_cells_under_one_heading_are_questions_of_their_own(spark, tmp_path):
    book = lambda repo, path, a, b: nb(0, [cell("markdown", "the first and the last"), cell("code", a), cell("code", b), *(cell("markdown", f"and the {x} to the end") for x in "abc")], repo, path)
    nbs = [book(r, p, *c) for r in ("r1", "r2") for p, c in (("hw_solution.ipynb", ("s = 1", "t = [2]")), ("hw.ipynb", ("b = 0", "b = 1")))]
    out = pipelines.exercise(notebooks(spark, tmp_path, nbs)).collect()
    assert sorted((r["status"], r["target"], r["boilerplate"]) for r in out) == [("success", "s = 1", "b = 0"), ("success", "t = [2]", "b = 1")]


def test_graded_cells_without_checksum_under_one_heading(spark, tmp_path):
    mark = {"nbgrader": {"grade": False, "solution": True, "locked": False, "grade_id": "a"}}
    data = notebooks(spark, tmp_path, [nb(1, [cell("markdown", "do both"), cell("code", "k = 1", metadata=mark), cell("code", "m = 2", metadata=mark)])])
    assert [r["n_solutions"] for r in pipelines.graded(data).collect()] == [1, 1]


def test_leaks_of_short_passages(spark, tmp_path):
    spark.createDataFrame([(1, "secret word"), (2, "alone"), (3, "not there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "a secret word, standalone"), (2, "nothing"), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, queries.benchmark_leaks(spark, str(tmp_path)).collect())) == [(1, 1), (1, 2)]


def test_dedup_and_split(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, ["a"]), (3, []), (4, None), (5, ["b"])], "id long, code array<string>")
    assert [r["id"] for r in D.first_by(df, F.col("code"), ["id"]).orderBy("id").collect()] == [1, 5]
    rows = spark.range(200).select(F.col("id"), (F.col("id") % 60).cast("string").alias("key"))
    parts = D.split_without_leaks(rows, "id", "key")
    a, b = (parts.where(F.col("part") == p).select("key").distinct() for p in ("dev", "test"))
    assert a.intersect(b).count() == 0 and parts.count() == 200


def test_similarity(spark):
    rows = [(i, [f"x{j}" for j in range(i % 7, i % 7 + 6)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, items array<string>").withColumn("g", F.lit(1))
    got = {(r["a"], r["b"]) for r in D.similar_pairs(df, ["g"], "id", "items").collect()}
    sets = {i: set(x) for i, x in rows}
    assert got == {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    same = {(a, b) for a, b in got if sets[a] == sets[b]}
    assert same <= {(r["a"], r["b"]) for r in D.lsh_candidates(df, ["g"], "id", "items").collect()}


def test_sources(spark, tmp_path):
    path = tmp_path / "crawl"
    path.mkdir()
    contents = json.dumps(nb(None, [cell("code", "x")]))
    (path / "a.jsonl").write_text("\n".join([json.dumps({"contents": contents, "repo": "r", "path": "p"}), json.dumps({"contents": "not json", "repo": "r", "path": "q"}), '{"contents": "nbgrader"}']))
    out = records.decode_crawl(records.read_lines(spark, str(path), "nbgrader"))
    assert [(r["metadata"]["repo"], r["cells"][0]["source"]) for r in out.collect()] == [("r", "x")]
    assert records.count_lines(spark, str(path)) == 3
    records.write_records(out, str(tmp_path / "out"), single="all.jsonl")
    assert [f.name for f in (tmp_path / "out").glob("[!._]*")] == ["all.jsonl"]
    assert records.read_records(spark, str(tmp_path / "out"), records.NOTEBOOK).count() == 1


def test_stream(spark, tmp_path):
    spark.range(6).select((F.col("id") % 3).alias("k"), F.current_timestamp().alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    q = first_records(stream, ["k"], "ts", "1 hour").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 3
