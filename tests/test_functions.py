import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import code, language, slices, solutions
from corpusloom.functions import text as X
from corpusloom.operators import grading
from corpusloom.plans import queries


@pytest.mark.parametrize(("source", "want"), [
    ("k = 1; k = 2; m = k", "loc0 = 1\nloc1 = 2\nloc1 = loc1"),
    ("sq = [v for v in vs]", "loc0 = [v for loc1 in vs]"),
    ("(p, (q, r)) = t", "loc0, (loc1, loc2) = t"),
    ("*head, tail = t", "*loc0, loc1 = t"),
    ("d[i] = [h for h in d if h]", "d[i] = [h for loc0 in d if loc0]"),
    ("def outer(a):\n    def inner(b):\n        return a + b\n    return inner", "def method_name(arg0):\n\n    def method_name(arg1):\n        return arg0 + arg1\n    return inner"),
    ("total = f(b'raw', 'text')", "loc0 = f(b'raw', 'jupyter_string')"),
])
def test_normalized(source, want):
    assert code.normalized(source) == want


def test_tokens():
    t = code.tokens_of("df = pd.read_csv('a.csv')\nprint(len(df), np.sum(df))\n")
    assert code.api_calls(t) == ["read_csv", "sum"]
    assert " ".join(code.clean(t, comments=True)) == "df = pd . read_csv ( 'jupyter_string' ) NEWLINE print ( len ( df ) , np . sum ( df ) )"
    t = code.tokens_of('def f(a):\n    """doc x"""\n    # hi\n    return g(a)\n')
    assert code.api_calls(t) == ["g"] and code.api_calls(t, True) == ["def", "f", "f", "g"]
    assert " ".join(code.clean(t, comments=True)) == "def f ( a ) : NEWLINE INDENT 'jupyter_string' NEWLINE # hi NEWLINE return g ( a )"
    assert code.comments_of(t) == (["#", "hi", "COMMENTSEP"], ["docstring", "doc", "x", "docstring"])
    assert [x for x, k in code.tokens_of("y = f'{a}' + rf'''b\n{c}'''") if k == "STRING"] == ["f'{a}'", "rf'''b\n{c}'''"]


def test_analysis_keeps_whole_code_and_normalises_one_function():
    r = code.analyze_one("import os  # why\ndef f(a):\n    \"\"\"doc\"\"\"\n    return g('x', a)\ndef h(): pass\n")
    assert r["code_tokens"][:5] == ["import", "os", "# why", "\n", "def"] and r["code_tokens"].count("def") == 2 == r["code_tokens_clean"].count("def")
    assert " ".join(r["code_tokens_clean"]).startswith("import os NEWLINE") and "# why" not in r["code_tokens_clean"]
    assert " ".join(r["code_tokens_partial_normalized_trunc"]) == "def f ( a ) : NEWLINE INDENT return g ( 'jupyter_string' , a )"
    assert " ".join(r["code_tokens_normalized_trunc"]) == "def method_name ( arg0 ) : NEWLINE INDENT return g ( 'jupyter_string' , arg0 )"
    assert (r["api_sequence"], r["api_sequence_declared"]) == (["g"], ["def", "f", "f", "g", "def", "h", "h"])
    only = code.analyze_one("import os")
    assert only["code_tokens_normalized"] is None and only["api_sequence"] == [] and only["code_tokens_clean"] == ["import", "os"]
    assert code.analyze_one("x = 1")["api_sequence"] == [code.NO_CALLS]


def test_analysis_of_bad_code():
    assert code.analyze_one("print 'x'")["parses"] is False and code.analyze_one(None) is None
    assert code.free_names("import a\ndef f(x):\n    return x + y + a.b") == {"y"}
    assert code.without_last_expression("x = 1\nx.y[0]") == "x = 1"
    assert code.first_lines(["a", "NEWLINE"] * 20) == ["a", "NEWLINE"] * 9 + ["a"]


@pytest.mark.parametrize(("template", "answer", "want"), [
    ("def k():\n    return []", "def k():\n    return [2, -0.5]", "    return [2, -0.5]"),
    ("def k():\n    return []", "import math\ndef k():\n    return [2]", "    return [2]"),
    ("a = 1\nb = 2\nc = 3", "a = 10\nb = 2\nc = 30", ""),
    ("a = 1\n", "a = 1\n# done\n", None),
    ("# YOUR CODE HERE\nraise NotImplementedError()\nprint(x)", "x = 4\nprint(x)", "x = 4"),
])
def test_added_lines(spark, template, answer, want):
    frame = spark.createDataFrame([(template, answer)], "t string, a string").withColumn("d", solutions.diffs(F.col("t"), F.col("a")))
    assert frame.select(solutions.single_run(solutions.telling_lines(F.col("d")))).first()[0] == want


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text(spark):
    lit = F.lit
    assert one(spark, X.strip_magics(lit("%matplotlib inline\nx = 1\n"))) == "x = 1"
    assert one(spark, X.print_calls(lit("print x"))) == "print(x)"
    assert one(spark, X.print_calls(lit("  print 'a print b'"))) == "  print('a print(b')"
    assert one(spark, X.import_tokens(lit("from importlib import x"))) == ["importlib", "x"]
    assert one(spark, X.import_tokens(lit("import numpy as np, os2"))) == ["numpy", "np", "os"]
    assert one(spark, X.lines(lit("a\r\nb\n\n"))) == ["a", "b", ""]
    assert one(spark, X.unwrap_tags(lit("<b>x</b> <i>y</i>"), "b")) == "x <i>y</i>"
    assert one(spark, X.solution_span(F.array(lit("# BEGIN SOLUTION"), lit("a"), lit("# END SOLUTION")))) == ["a"]


@pytest.mark.parametrize(("source", "grade", "solution", "grade_id", "points", "want"), [
    ("# YOUR CODE HERE\nraise NotImplementedError()", False, True, "sq", None, "dd19e0c5f89cd0be3f8bd69b2e2b54ff"),
    ("assert sq(3) == 9", True, False, "sq_t", 2.0, "2c7f5e013605997789cbfd489c55dd8a"),
    ("def k():\n    return []", False, True, "kurt", None, "cfd442c159853a8ab697d8e98dbecdd1"),
])
def test_checksum(spark, source, grade, solution, grade_id, points, want):
    args = (F.lit(source), F.lit("code"), F.lit(grade), F.lit(solution), F.lit(False), F.lit(grade_id), F.lit(points).cast("double"))
    assert one(spark, X.cell_checksum(*args)) == want


@pytest.mark.parametrize(("present", "has_s", "s", "has_g", "g", "want"), [
    (True, True, True, True, False, "autograded code"), (True, True, True, True, True, "manual graded code"), (True, True, False, True, True, "autograder tests"), (True, False, None, True, True, "autograder tests"),
    (True, True, None, True, True, "read only"), (True, True, False, True, False, "read only"), (True, True, True, False, None, "no nbgrader"), (False, False, None, False, None, "no nbgrader"),
])
def test_grading_type(spark, present, has_s, s, has_g, g, want):
    b = lambda x: F.lit(x).cast("boolean")
    assert one(spark, grading.grading_type(b(present), b(has_s), b(s), b(has_g), b(g))) == want


def test_language():
    assert [language.guess(x) for x in ("the cat and the dog", "le chat et la souris", "", None, "der Hund und die Katze")] == ["English", "French", "un", "failed", "German"]
    assert language.tokens("# Load `x`\n**bold** isn't") == ["Load", "CTAG", "x", "CTAG", "bold", "isn't"]


@pytest.mark.parametrize("source", ["x = 1\n", "def f(a, *b):\n    # hi\n    if a:\n        return f'{a!r}' + \"b\"\n    return [*b]\n", "for i in range(3):\n    print(i, end='')\n\n\nclass A:\n    pass\n"])
def test_untokenized_code_has_the_same_tokens(source):
    tokens = [t for t in code.tokens_of(source) if t[1] not in ("NL", "COMMENT")]
    again = [t for t in code.tokens_of(code.untokenized(code.tokens_of(source))) if t[1] not in ("NL", "COMMENT")]
    squeezed = lambda ts: [(text.strip() if kind in ("INDENT", "NEWLINE") else text, kind) for text, kind in ts]
    assert squeezed(again) == squeezed(tokens)


def test_results_are_made_for_few_rows_at_a_time():
    calls = []
    made = slices.results(lambda x, y: calls.append(x) or [x] * y, pa.list_(pa.int64()), iter([(pa.array(range(1000)), pa.array([2] * 1000)), (pa.array([], pa.int64()),) * 2]))
    assert len(next(made)) == slices.ROWS == len(calls)
    assert sum(map(len, made)) == 1000 - slices.ROWS and calls == [*range(1000)]


def test_analysis_kept_by_shape_is_that_of_the_code_itself():
    bodies = ["x = {0}  # {1}\n", "def f(a):\n    {0}\n    # {1}\n    b = {0} {0}\n    return g(a, b)", "print(f'{{x}}' {0})", "x = b'y' + {0}", "import os\nclass A:\n\t{0}\n\tx = {0}", "x = (", "# {1}", "if x:\n  y({0})\n\n\n# {1}\nz({0})", "def f():\n    {0}", "x = {0}\r\ny = x", "match x:\n    case {0}:\n        pass", "'\\x'", "x = \\\n  {0}"]
    texts = ["'a'", '"b"', "'''c\nd'''", "'\\n'", "r'e'", "''", "'\\N{nothing}'", "u'h'", "f'{a}'"]
    kept = {}
    for body in bodies:
        for i, text in enumerate(texts):
            source = body.format(text, f"remark {i}")
            assert code.analyze_one(source, kept) == code.analyze_one(source), source
    assert 5 < len(kept) < len(bodies) * len(texts) / 3  # comments and plain strings share an entry


def test_code_of_one_small_file_is_analysed_by_many_tasks(spark, tmp_path):
    spark.createDataFrame([(i, f"name {i}", "Brand#1") for i in range(50)], "p_partkey long, p_name string, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    out = queries.code_records(spark, str(tmp_path))
    assert out.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism and out.count() == 50
    assert {r["comments"] for r in out.collect()} == {f"# name {i} COMMENTSEP" for i in range(50)}
