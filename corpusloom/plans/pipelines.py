"""The dataset pipelines.  Code is analysed once a cell; what several branches read then stands in a work table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code as C
from ..functions import solutions as S
from ..functions import text as X
from ..functions.language import detect_language, nl_tokens
from ..operators import cells as K
from ..operators import dedup as D
from ..operators import grading as G
from ..sources.work import WorkTable, merging

KEPT_LOGIC = ("1 function", "pure logic", "boilerplate")


def analyzed(cells: DataFrame) -> DataFrame:
    """Code cells with their analysis in column `code`."""
    return cells.where(K.is_code()).withColumn("code", C.analyze(F.col("source")))


def of_kept_logic(cells: DataFrame, least: int = 0, most: int = 15) -> DataFrame:
    boilerplate = F.col("is_boilerplate") if "is_boilerplate" in cells.columns else F.lit(False)
    kind = C.logic_type(boilerplate, F.col("code.api_sequence"), F.col("code.code_tokens"), least, most)
    return cells.withColumn("logic_type", kind).where(F.col("logic_type").isin(*KEPT_LOGIC))


def train(notebooks: DataFrame, context_len: int = 12, max_tokens: int = 120) -> DataFrame:
    """Records of code directly below markdown, deduplicated on code and then on the words of the nearest markdown.

    Every cell is analysed once, before the windows: targets, context and imports all
    read that.  A context cell is markdown with its words, or code with its analysis,
    null where it holds magics; cells with autograder tests are no context.
    """
    cells = K.explode_cells(notebooks)
    fixed = F.when(K.is_code(), X.strip_magics(F.col("source"))).otherwise(F.col("source"))
    told = cells.withColumn("fixed", fixed).withColumn("nl_tokens", nl_tokens(F.when(K.is_markdown() & K.is_valid(), F.col("source"))))
    told = told.withColumn("code", C.analyze(F.when(K.is_code() & K.is_valid(), F.col("fixed"))))
    ended = lambda c: F.regexp_replace(c, r"\n+$", "")
    bare = K.is_code() & (ended("source") == ended("fixed"))
    told = told.withColumns({"context_nl": F.col("nl_tokens"), "context_code": F.when(bare, F.col("code")), "is_context": G.grading_of(F.col("nbgrader")) != "autograder tests"})
    fields = {"cell_type": "cell_type", "nl": "context_nl", "nl_original": "source", "code": "context_code"}
    context = K.import_places(K.nearest_markdown(K.nearest_markdown(K.with_context(told, context_len, fields, F.col("is_context")), context_len), context_len, "nl_tokens", "context_nl"))
    targets = of_kept_logic(K.train_cells(context).where("code.parses"))
    sized = targets.where((F.size("code.code_tokens") > 0) & (F.size("code.code_tokens_clean") <= max_tokens))
    records = sized.withColumn("source", F.col("fixed")).drop("fixed", "context_nl", "context_code", "is_context")
    once = D.first_by(records, F.col("code.code_tokens"), ["nb_index", "cell_index"])
    return K.sliced_imports(D.first_by(once, F.col("nl_tokens"), ["nb_index", "cell_index"]), K.notebook_imports(notebooks))


#: Fields of a context cell: markdown has its words and text, other cells their analysis.
CONTEXT = {"cell_type": "cell_type", "nl": "nl", "nl_original": "nl_original", "code": "code"}


def with_records(chosen: DataFrame, cells: DataFrame, context_len: int) -> DataFrame:
    """Rows (nb_index, cell_index, ...) with context, num_cells_above and imports of their notebooks; only the cells of these notebooks are analysed."""
    own = cells.join(merging(chosen.select("nb_index").distinct()), "nb_index", "left_semi")
    counts = K.import_places(own).select("nb_index", "cell_index", "n_imports")
    prose = F.when(K.is_markdown(), F.col("source"))
    told = own.withColumns({"nl": nl_tokens(prose), "nl_original": prose, "code": C.analyze(F.when(~K.is_markdown() & K.is_valid(), F.col("source")))})
    contexts = K.notebook_context(told, CONTEXT, K.is_markdown() | (G.grading_of(F.col("nbgrader")) != "autograder tests"))
    return K.sliced_imports(K.sliced_context(chosen, contexts, context_len).join(merging(counts), ["nb_index", "cell_index"]), K.cell_imports(own))


def graded(notebooks: DataFrame, max_nl_distance: int = 3, max_tokens: int = 120, context_len: int = 1200) -> DataFrame:
    """One recovered solution for each graded question, or the reason why there is none (column status).

    A question is told by the words of the nearest markdown that isn't empty, at most
    context_len above, its distance, and the checksum; markdown, be it empty, must lie
    at most max_nl_distance above.
    """
    cells = WorkTable(G.mark_cells(K.explode_cells(notebooks))).df
    test = F.col("grading") == "autograder tests"
    seen = K.test_outcomes(cells, test, K.cell_passed(F.col("execution_count"), F.col("outputs")), F.size("outputs") > 0, ["nb_index"], ["cell_index"])
    seen = K.last_markdown(K.markdown_within(seen, max_nl_distance))
    own = seen.where(F.col("nbgrader").isNotNull() & K.is_code() & (F.col("grading") == "autograded code") & F.col("has_markdown"))
    own = near_text(own.withColumn("source", X.print_calls(X.strip_magics(F.col("source")))), context_len)
    checksum = F.coalesce("nbgrader.checksum", F.lit("dummy-checksum"))
    rows = of_kept_logic(analyzed(own).where(F.col("code.parses") | F.col("is_boilerplate"))).where(F.size("code.code_tokens") > 0)
    rows = WorkTable(rows.withColumn("question", F.concat_ws("\x01", F.array_join(F.coalesce("nl_tokens", F.array().cast("array<string>")), " "), "nl_distance", checksum)))
    chosen = WorkTable(choose_solution(rows.df, max_tokens)).df  # analysed once, read several times
    picked = chosen.where("status = 'success'").select("question", "target.nb_index", "target.cell_index")
    records = with_records(picked, cells, context_len).select("question", "context", "num_cells_above", "imports")
    return chosen.join(merging(records), "question", "left")


def near_text(rows: DataFrame, context_len: int) -> DataFrame:
    """Text, words and distance of the markdown of last_markdown(), where it is at most context_len away; distance 0 without one."""
    far = F.col("cell_index") - F.col("above.cell_index")
    near = F.coalesce(far <= context_len, F.lit(False))
    told = rows.withColumns({"nl": F.when(near, F.col("above.source")), "nl_distance": F.when(near, far).otherwise(0)}).drop("above")
    return told.withColumn("nl_tokens", nl_tokens(F.col("nl")))


def choose_solution(rows: DataFrame, max_tokens: int = 120) -> DataFrame:
    """A target for each question, its template and what was added to it.

    If a solution holds the marks of an instructor's answer, the question's target is
    the code that most rows share of those with something between the marks; that is what
    is extracted, in the tokens of the whole cell, and the other tokens are the template.
    Else it is the last passed row with outputs, else the first passed; its template is
    that of the question's own rows or else found by checksum among all, and what is
    extracted are the lines added to it.
    """
    placed = rows.withColumn("pos", F.struct("nb_index", "cell_index"))
    solution, passed = ~F.col("is_boilerplate"), ~F.col("is_boilerplate") & F.coalesce("test_below_passed", F.lit(False))
    late, one = passed & F.col("from_output_nb"), F.struct(target_of().alias("target"), F.struct("nbgrader", "cell_type").alias("mark"))
    groups = placed.groupBy("question").agg(  # all of it is added up before the shuffle, however many rows a question has
        F.count_if(solution).alias("n_solutions"), F.coalesce(F.max(solution & F.col("is_instructor_answer")), F.lit(False)).alias("instructor"),
        F.coalesce(F.max_by(one, F.when(late, F.col("pos"))), F.min_by(one, F.when(passed & ~F.col("from_output_nb"), F.col("pos")))).alias("chosen"), F.min_by(F.when(~solution, F.col("source")), F.when(~solution, F.col("pos"))).alias("template"),
    ).select("question", "n_solutions", "instructor", "template", F.col("chosen.target").alias("student"), F.col("chosen.mark").alias("mark"))
    lacking = groups.where(F.col("template").isNull() & F.col("mark").isNotNull() & ~F.col("instructor")).select("question", "mark.nbgrader", "mark.cell_type")
    released = G.boilerplates_by_checksum(lacking, rows).select("question", "released")
    groups = groups.join(merging(released), "question", "left").withColumn("template", F.coalesce("template", "released"))
    own = groups.join(merging(instructor_answers(placed.where(solution))), "question", "left").withColumn("target", F.when(F.col("instructor"), F.col("answer")).otherwise(F.col("student")))
    own = S.with_target(own, F.when(~F.col("instructor"), F.col("template")), F.col("target.source"), "added")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    typed = C.typed_tokens(F.col("target.code"))
    texts = F.transform(typed, lambda t: t["text"])
    begin, end = X.solution_marks(texts)
    inside = F.slice(typed, begin + 1, F.greatest(end - begin - 1, F.lit(0)))
    outside = F.concat(F.slice(typed, F.lit(1), begin), F.slice(typed, F.greatest(end, F.lit(1)), F.size(typed) - end + 1))
    marked = F.col("instructor") & F.col("target").isNotNull()
    own = own.withColumns({"extracted": F.when(F.col("instructor"), F.col("span")).otherwise(F.col("added")), "added_tokens": C.plain_tokens(F.col("added")), "plain_template": C.plain_tokens(F.when(~F.col("instructor"), F.col("template")))})
    trivial = F.when(S.is_trivial(F.col("plain_template")), F.array().cast("array<string>")).otherwise(F.col("plain_template"))
    own = own.withColumns({"extracted_tokens": F.when(marked, C.laid_out(inside)).otherwise(F.col("added_tokens")), "template_tokens": F.when(marked, C.laid_out(outside)).otherwise(trivial)})
    found = (
        F.when(F.col("n_solutions") == 0, "only boiler")
        .when(F.col("instructor"), F.when(F.coalesce("span_rows", F.lit(0)) >= 2, "success").when(F.col("span_rows") == 1, "only 1 solution").otherwise("no span"))
        .when(F.col("target").isNull(), "no autograder tests or none passed").when(F.col("template").isNull(), "no boilerplate").when(blank(F.col("added")), "multiple insertion points")
        .when(F.col("extracted_tokens").isNull() | F.col("template_tokens").isNull(), "not tokenizable autograded").otherwise("success")
    )
    long = F.size("extracted_tokens") > max_tokens
    status = F.when(found != "success", found).when(F.size("target.code.code_tokens_clean") <= 0, "empty target cell tokens").when(F.size(F.filter("extracted_tokens", lambda x: x != "NEWLINE")) == 0, "empty extracted tokens").when(long, "longer than the token limit").otherwise(found)
    return own.withColumn("status", status).select("question", "status", "target", "template", "template_tokens", "extracted", "extracted_tokens", "n_solutions")


def target_of() -> Column:
    """What a record says of the cell that was chosen."""
    return F.struct("source", "nb_index", "cell_index", "path", "repo", "code", "nl", "nl_tokens")


def instructor_answers(solutions: DataFrame) -> DataFrame:
    """For each question, the code that most rows share of those with something between the solution marks: its first row (answer), how many rows (span_rows), and the text between the marks (span)."""
    between = X.solution_span(F.col("code.code_tokens"))
    filled = solutions.where(F.coalesce(F.exists(between, lambda t: F.regexp_replace(t, r"\s+", "") != ""), F.lit(False)))
    most = D.majority(filled, ["question"], "source", "path", "pos", least=1).select("question", F.col("n").alias("span_rows"), F.col("first").alias("pos"))
    inner = F.array_join(X.solution_span(X.lines(F.col("source"))), "\n")
    return most.join(merging(filled.select("question", "pos", target_of().alias("answer"), inner.alias("span"))), ["question", "pos"]).drop("pos")


def exercise(notebooks: DataFrame, max_tokens: int = 120, percent: int = 50, context_len: int = 11111) -> DataFrame:
    """Problems whose solutions differ from a similar notebook of the same repo, chosen by majority; status says why a group has none."""
    nbs = K.python_notebooks(notebooks)
    name = F.to_json(F.struct("metadata.repo", "metadata.path"))  # what tells notebooks apart here
    cells = WorkTable(K.explode_cells(nbs.withColumn("metadata", F.col("metadata").withField("nb_index", name)))).df
    prose = cells.where(K.is_markdown()).groupBy("nb_index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_index", "source"))), lambda x: x["source"]), " ").alias("prose"))
    english = K.in_languages(prose.withColumn("language", detect_language(F.col("prose"))), F.col("language")).select("nb_index")
    cells = WorkTable(cells.join(merging(english), "nb_index")).df
    items = cells.where("source <> ''").groupBy("repo", "path").agg(F.collect_set("source").alias("items"))
    pairs = D.solution_pairs(items, percent)
    keyed = cells.withColumn("nb", F.struct("repo", "path"))
    both = pairs.select(F.struct("repo", F.col("solution_path").alias("path")).alias("a"), F.struct("repo", F.col("submission_path").alias("path")).alias("b"))
    changed = D.positional_diff(both, keyed)
    above = K.last_markdown(cells).select(F.struct("repo", "path").alias("a"), "cell_index", "above", "nb_index")
    rows = changed.join(merging(above), ["a", "cell_index"]).select(F.col("a.repo").alias("repo"), F.col("a.path").alias("path"), F.col("b.path").alias("boilerplate_path"), "nb_index", "cell_index", "above", F.col("source_a").alias("source"), F.col("source_b").alias("boilerplate"))
    told = near_text(rows, context_len).withColumn("code", C.analyze(F.col("source"))).where(F.col("code.parses") & (F.size("code.code_tokens") > 0))
    words = lambda c: F.nullif(F.array_join(c, " "), F.lit(""))
    rows = WorkTable(of_kept_logic(told).withColumn("group", F.concat_ws("\x01", F.coalesce(words("nl_tokens"), words("code.comments"), F.lit("yo")), "nl_distance"))).df
    chosen = WorkTable(vote(rows, max_tokens)).df
    picked = chosen.where("status = 'success'").select("group", "nb_index", "cell_index")
    return chosen.join(merging(with_records(picked, cells, context_len).select("group", "context", "num_cells_above", "imports")), "group", "left")


def vote(rows: DataFrame, max_tokens: int = 120) -> DataFrame:
    """The code and the template that most rows of a group share; two rows of two repos must agree."""
    placed = rows.withColumn("pos", F.struct("repo", "path", "cell_index", "boilerplate_path"))
    codes = D.majority(placed, ["group"], "source", "repo", "pos", least=1).withColumnsRenamed({"n": "n_code", "n_sources": "n_repos", "first": "first_code"})
    templates = D.majority(placed, ["group"], "boilerplate", "repo", "pos", least=1).select("group", "boilerplate", F.col("n").alias("n_template"))
    chosen = placed.select("group", F.col("pos").alias("first_code"), "repo", "path", "nb_index", "cell_index", "code", "nl", "nl_tokens")
    out = codes.join(merging(templates), "group").join(merging(chosen), ["group", "first_code"]).withColumn("template_tokens", C.plain_tokens(F.col("boilerplate")))
    tokens = F.filter("template_tokens", lambda t: ~t.isin("NEWLINE", "INDENT"))
    status = (
        F.when((F.col("n_code") < 2) | (F.col("n_template") < 2), "only 1 solution").when(F.col("n_repos") < 2, "only from 1 repo").when(F.coalesce(F.size("code.code_tokens"), F.lit(0)) == 0, "empty target cell tokens")
        .when((F.trim("boilerplate") != "") & F.col("template_tokens").isNull(), "boiler tokenization failed").when(F.size(tokens) > 10, "boilerplate longer than 10 toks")
        .when(F.size("code.code_tokens_clean") > max_tokens + 5, "longer than the token limit").otherwise("success")
    )
    return out.select("group", status.alias("status"), "repo", "path", "nb_index", "cell_index", "nl", "nl_tokens", F.col("source").alias("target"), "boilerplate", "code", "n_code", "n_repos")


def combined(parts: dict[str, DataFrame], fields: list[str], ids: list[str]) -> DataFrame:
    """The pipelines' outputs (by kind) as one dataset in a fixed pseudo-random order; a field that a part lacks is null there."""
    have = [d.select(F.lit(kind).alias("kind"), *[c for c in (*ids, *fields) if c in d.columns]) for kind, d in parts.items()]
    return D.shuffled_union(have, ["kind", *ids])


#: Fields of the final dataset's records.
RECORD = ["nb_index", "cell_index", "repo", "path", "nl_tokens", "code", "context", "num_cells_above", "imports", "extracted_tokens", "template_tokens"]


def graded_records(results: DataFrame) -> DataFrame:
    """The successes of graded() as records, their id the question."""
    own = [F.col("target")[c].alias(c) for c in ("nb_index", "cell_index", "repo", "path", "nl_tokens", "code")]
    return results.where("status = 'success'").select(F.col("question").alias("id"), *own, "context", "num_cells_above", "imports", "extracted_tokens", "template_tokens")


def exercise_records(results: DataFrame) -> DataFrame:
    """The successes of exercise() as records, their id the group."""
    return results.where("status = 'success'").select(F.col("group").alias("id"), *[c for c in RECORD if c in results.columns])


def dev_and_test(records: DataFrame, test_percent: int = 55) -> DataFrame:
    """Adds part; no code of test occurs in dev.  The records are written once, as every step of the split reads them."""
    held = WorkTable(records.withColumn("_tokens", F.col("code.code_tokens"))).df
    return D.split_exactly(held, ["id"], "_tokens", test_percent).drop("_tokens")


def final_dataset(graded_split: DataFrame, exercise_split: DataFrame, trained: DataFrame) -> dict[str, DataFrame]:
    """dev, test and train, each in a fixed pseudo-random order; ids of different pipelines are told apart by kind."""
    text = lambda d: d.withColumn("nb_index", F.col("nb_index").cast("string"))
    of = lambda part: combined({"graded": text(graded_split.where(F.col("part") == part)), "exercise": text(exercise_split.where(F.col("part") == part))}, RECORD, ["id"])
    train_records = text(trained.withColumn("id", F.concat_ws(":", "nb_index", "cell_index")))
    return {"dev": of("dev"), "test": of("test"), "train": combined({"train": train_records}, RECORD, ["id"])}


def outcomes(results: DataFrame, most: int = 11) -> DataFrame:
    return D.top_frequencies(results, "status", most)
