"""Notebooks from JSON as people write it, files by name, runs, diffs and MinHash classes."""

import difflib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import solutions
from corpusloom.operators import cells as K
from corpusloom.operators import dedup as D
from corpusloom.sources import named_files, records


def decoded(spark, *texts):
    return records.decode_notebooks(spark.createDataFrame([(t,) for t in texts], "value string"))


@pytest.mark.parametrize(("cell", "want"), [
    ({"cell_type": "code", "source": ["a\n", "b"], "execution_count": None, "metadata": []}, ("code", "a\nb", None, 0, None)),
    ({"source": "x", "execution_count": 3, "outputs": [{"output_type": "error", "text": [1]}], "metadata": {"nbgrader": {"grade": True, "points": 2}}}, ("", "x", 3, 1, True)),
    ({"cell_type": "markdown"}, ("markdown", "", 0, 0, None)), ({"source": None, "outputs": "none", "metadata": "m", "execution_count": "bad"}, ("", "", None, 0, None)), ("no cell", ("", "", 0, 0, None)),
    ({"source": [], "attachments": {"deep": [{}]}, "level": 2}, ("", "", 0, 0, None)), ({"source": 0}, ("", "", 0, 0, None)), ({"source": "0", "metadata": {"nbgrader": []}}, ("", "0", 0, 0, None)),
])
def test_cells_of_any_kind(spark, cell, want):
    books = decoded(spark, json.dumps({"cells": ["first", cell], "metadata": {"nb_index": 4, "repo": "r", "kernelspec": {"name": "python3", "language": "python"}}}))
    r = K.explode_cells(books).where("cell_index = 1").first()
    assert (r["cell_type"], r["source"], r["execution_count"], len(r["outputs"]), r["nbgrader"]["grade"] if r["nbgrader"] else None) == want
    assert (r["nb_index"], r["repo"], r["path"]) == (4, "r", None) and K.python_notebooks(books).count() == 1


def test_lines_without_a_notebook_and_old_notebooks(spark):
    old = json.dumps({"worksheets": [{"cells": [{"source": "a"}]}, {"cells": [{"source": "b"}]}], "metadata": []})
    books = decoded(spark, "not json", "[1]", None, '{"cells": {}}', "{}", old, '{"cells": []}')
    assert sorted([c["source"] for c in r["cells"]] for r in records.all_cells(books).collect()) == [[], ["a", "b"]]


def test_named_files_replace_a_folder_as_a_whole(spark, tmp_path):
    path = tmp_path / "out"
    names = [f"n{i}.txt" for i in range(2500)]
    frame = spark.createDataFrame([(n, n * 2) for n in names], "name string, value string").repartition(5)
    named_files.write_named(frame, str(path), len(names))
    found = list(path.glob("*/*.txt"))
    assert len(list(path.glob("[!_]*"))) == 3 and sorted(f.name for f in found) == sorted(names) and all(f.read_text() == f.name * 2 for f in found)
    named_files.write_named(spark.createDataFrame([("one", None)], "name string, value string"), f"file:{path}")
    assert sorted(f.name for f in path.iterdir()) == ["_SUCCESS", "one"] and (path / "one").read_text() == ""
    records.write_records(spark.range(3), str(tmp_path / "lines"), single="three.jsonl")
    assert sorted((tmp_path / "lines" / "three.jsonl").read_text().splitlines()) == [f'{{"id":{i}}}' for i in range(3)]
    bad = spark.createDataFrame([(f"g{i}", "x") for i in range(50)] + [("../up", "x")], "name string, value string").repartition(3)
    with pytest.raises(Exception, match="file's name"):
        named_files.write_named(bad, str(path))
    assert sorted(f.name for f in tmp_path.iterdir()) == ["lines", "out"] and (path / "one").exists()
    with pytest.raises(Exception, match="already"):
        frame.write.format("named_files").mode("append").save(str(path))


def test_a_task_that_runs_again_leaves_no_second_file(tmp_path):
    writer = named_files.NamedFilesWriter({"path": str(tmp_path / "out")}, True)
    rows = [{"name": f"f{i}", "value": str(i)} for i in range(5)]

    def lost():
        yield from rows[:3]
        raise RuntimeError("the executor is gone")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    done = [writer.write(iter(rows)), writer.write(iter(rows))]  # and a second attempt ran beside the first
    assert not (tmp_path / "out").exists()
    writer.commit(done[:1])
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["_SUCCESS", *(f"f{i}" for i in range(5))] and len(list(tmp_path.iterdir())) == 1


def test_runs_of_equal_flags(spark):
    flags = [None, None, "a", "a", "b", None, "a"]
    rows = spark.createDataFrame([(k, i, f) for k in (1, 2) for i, f in enumerate(flags)], "k long, i long, f string")
    got = K.runs(rows, ["k"], ["i"], F.col("f")).orderBy("k", "i").collect()
    assert [r["run"] for r in got] == [1, 1, 2, 2, 3, 4, 5] * 2


def one_run(template, solution):
    """The rule in plain Python."""
    kept = []
    for line in difflib.Differ().compare(template.splitlines(), solution.splitlines()):
        bare, body = line.strip("+ "), line[2:].strip()
        if line[0] == "+" and bare.strip() and not bare.startswith(('"""', "#")) and "import " not in bare:
            kept.append((True, line[2:]))
        elif line[0] == " " and body and not body.startswith(("?", "#", "raise")):
            kept.append((False, line[2:]))
    runs = [[b for _, b in g] for added, g in itertools.groupby(kept, key=lambda x: x[0]) if added]
    return "\n".join(runs[0]) if len(runs) == 1 else ""


def test_added_lines_by_spark_are_those_of_plain_python(spark):
    r = random.Random(2)
    lines = ["x = 1", "  y = 2", "# c", "", "   ", "raise E", "import a", "from b import c", "+ plus", "++", '"""doc"""', "\tz", "return q", "? what", "x = 11", "+# odd", "\x0c", "  + t", "ü"]
    rows = []
    for _ in range(600):
        a = [r.choice(lines) for _ in range(r.randint(0, 6))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.choice(lines))
        rows.append(("\n".join(a), "\n".join(b[1:] if r.random() < 0.3 else b)))
    rows += [(solutions.EMPTY_TEMPLATE, "all\nof it"), (None, "x"), ("x", None)]
    got = solutions.with_target(spark.createDataFrame(rows, "t string, s string"), F.col("t"), F.col("s"), "added").collect()
    assert [x["added"] for x in got] == [None if a is None or b is None else b if a == solutions.EMPTY_TEMPLATE else one_run(a, b) for a, b in rows]


@pytest.mark.parametrize("bucket", [1, 4, 1000])
def test_minhash_classes_find_the_similar_sets(spark, bucket):
    """Copies, a chain of near copies, one item in every set, sets without items; also where all buckets count as large."""
    r = random.Random(7)
    sets = [[f"x{j}" for j in range(i % 7, i % 7 + 9)] + ["common"] for i in range(30)] + [[f"r{r.randint(0, 99)}" for _ in range(6)] + ["common"] for _ in range(60)] + [[], None, [None, ""]]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, items array<string>").withColumn("g", F.lit("g"))
    members, pairs = D.lsh_classes(frame, ["g"], "id", "items", bucket=bucket)
    exact_members, exact = D.similar_classes(frame, ["g"], "id", "items")
    assert sorted(map(tuple, members.collect())) == sorted(map(tuple, exact_members.collect()))
    got, want = set(map(tuple, pairs.collect())), set(map(tuple, exact.collect()))
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 5


def test_notebooks_encoded_and_decoded_again(spark, tmp_path):
    cells = [{"cell_type": "code", "source": 'a = "ü\\n"\n', "execution_count": 3, "outputs": [{"output_type": "error"}], "metadata": {"nbgrader": {"grade": True, "points": 1.5, "grade_id": "g"}}}, {"cell_type": "markdown", "source": "", "outputs": []}]
    books = decoded(spark, json.dumps({"cells": cells, "metadata": {"nb_index": 1, "repo": "r", "path": "p"}, "nbformat": 4}))
    again = records.decode_notebooks(records.encode_notebooks(books))
    assert again.schema == books.schema and again.collect() == books.collect()
    path = tmp_path / "lines"
    path.mkdir()
    for name in ("a.jsonl", "b.jsonl", "c.txt"):
        (path / name).write_text(records.encode_notebooks(books).first()["value"])
    assert records.read_records(spark, str(path), records.NOTEBOOK, "*.jsonl").count() == 2
    assert records.read_records(spark, str(path), records.NOTEBOOK, first=1).count() == 1
    out = str(tmp_path / "out")
    for rows in (books.union(books), books):  # what stood there is replaced
        records.write_records(rows, out)
    assert records.count_lines(spark, out) == 1


def test_strictly_valid_cells(spark):
    rows = spark.createDataFrame([("a", "code"), ("", "code"), ("a", ""), ("a", None)], "source string, cell_type string")
    assert [(r[0], r[1]) for r in rows.select(F.coalesce(K.is_valid(), F.lit(False)), F.coalesce(K.is_strictly_valid(), F.lit(False))).collect()] == [(True, True), (False, False), (True, False), (False, False)]


def test_records_one_after_the_other(spark):
    rows = spark.range(0, 100, 1, 7)
    assert [r["id"] for r in records.iterate_records(rows)] == list(range(100))
    assert len(list(records.iterate_records(rows, 12))) == 12
