"""Registered queries over the driver's tables, each whole, and the SQL that gives the same rows.

conversations stand for notebooks: conv_id the notebook, turn the cell, user markdown,
assistant code, system raw.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cells as K
from ..operators import dedup as D
from ..operators import grading as G
from . import generated

KINDS = {"user": "markdown", "assistant": "code", "system": "raw"}


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def chats(s: SparkSession, d: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return table(s, d, "conversations").select(F.col("conv_id").alias("nb_index"), F.col("turn").cast("long").alias("cell_index"), F.coalesce(F.element_at(kind, F.col("role")), F.lit("")).alias("cell_type"), F.coalesce("text", F.lit("")).alias("source"))


def first_line(c: str = "text"):  # noqa: ANN201
    return F.substring_index(F.coalesce(c, F.lit("")), "\n", 1)


def train_records(s: SparkSession, d: str) -> DataFrame:
    """Train pipeline on chats: code below markdown, veto, nearest text, context size, dedup on code."""
    cells = chats(s, d)
    side = K.with_context(K.nearest_markdown(cells, 12), 12, ["cell_type", "source"]).select("nb_index", "cell_index", "nl", "num_cells_above", F.size("context").cast("long").alias("n_context"))
    once = D.first_by(K.train_cells(cells), F.col("source"), ["nb_index", "cell_index"])
    return once.join(side, ["nb_index", "cell_index"]).select("nb_index", "cell_index", "source", "nl", "num_cells_above", "n_context")


def grading_decision(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    flag = lambda n: F.when(F.pmod(F.floor(F.col("event_id") / n), F.lit(3)) == 1, True).when(F.pmod(F.floor(F.col("event_id") / n), F.lit(3)) == 2, False)
    has = lambda n: F.pmod(F.floor(F.col("event_id") / n), F.lit(2)) == 0
    return e.select("event_id", G.grading_type(F.col("event_id") % 7 != 0, has(5), flag(1), has(11), flag(3)).alias("grading"))


def nearest_test(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    test = F.col("event_type").isin("error", "signup")
    out = K.test_outcomes(e, test, F.col("event_type") == "signup", F.col("value") > 50, ["user_id"], ["ts", "event_id"])
    return out.select("event_id", F.col("test_below_passed").alias("passed"), F.col("from_output_nb").alias("from_output"))


def any_test(s: SparkSession, d: str) -> DataFrame:
    test = F.col("event_type") == "signup"
    return K.test_outcomes(table(s, d, "events"), test, test, F.col("value") > 50, ["user_id"], ["ts", "event_id"]).select("event_id", "any_test_below")


def imports_so_far(s: SparkSession, d: str) -> DataFrame:
    """Chats whose code cells import a module named by the turn's length."""
    source = F.when(K.is_code(), F.concat(F.lit("import a"), F.translate((F.length("source") % 10).cast("string"), "0123456789", "abcdefghij"))).otherwise(F.col("source"))
    return K.running_imports(chats(s, d).withColumn("source", source)).select("nb_index", "cell_index", F.array_join("imports", ",").alias("imports"))


def exercise_grading(s: SparkSession, d: str) -> DataFrame:
    flag = lambda n: F.when(F.pmod(F.floor(F.col("event_id") / n), F.lit(3)) == 1, True).when(F.pmod(F.floor(F.col("event_id") / n), F.lit(3)) == 2, False)
    return table(s, d, "events").select("event_id", G.exercise_grading_type(F.col("event_id") % 7 != 0, flag(1), flag(3)).alias("grading"))


def code_tags(s: SparkSession, d: str) -> DataFrame:
    """Chats in which some markdown holds inline code: the first word, where a text's length is divisible by 5."""
    marked = F.when(K.is_markdown() & (F.length("source") % 5 == 0), F.lit("say `this` then")).otherwise(F.replace(F.replace("source", F.lit("`"), F.lit("'")), F.lit("~"), F.lit("-")))
    return K.with_code_tags(chats(s, d).withColumn("source", marked)).select("nb_index", "cell_index", "cell_type")


def near_dup_pairs(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("lang", "doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("items"))
    return D.similar_pairs(docs, ["lang"], "doc_id", "items").select("lang", "a", "b", F.col("n_shared").cast("long").alias("n_shared"), F.col("n_union").cast("long").alias("n_union"))


def linked_classes(s: SparkSession, d: str, pairing: Callable) -> DataFrame:
    """Each document's class of equal line sets, and how many other classes that one is similar to."""
    docs = table(s, d, "documents").select("lang", "doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("items"))
    out = D.linked_classes(docs, ["lang"], "doc_id", "items", pairing=pairing)
    return out.select("lang", F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("n").cast("long").alias("n_lines"), "n_links")


def positional(s: SparkSession, d: str) -> DataFrame:
    """Every conversation n against n + 1."""
    c = chats(s, d).withColumnRenamed("nb_index", "nb")
    ids = c.select("nb").distinct()
    pairs = ids.select(F.col("nb").alias("a"), (F.col("nb") + 1).alias("b"))
    return D.positional_diff(pairs, c)


def benchmark_leaks(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage: found by a key of it, confirmed by substring.

    A passage of ten words or more has an inner run of eight that stands whole in any
    document that holds it, one of three to nine words a longest inner word: both are keys
    of one join, for which documents are split once.  One or two words may lie inside longer
    ones; these passages are met by their first characters, and only if there are any.
    """
    run = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 7), lambda i: F.xxhash64(F.slice(c, i, 8)))
    word = lambda c: F.xxhash64(F.lit("word"), c)
    items = table(s, d, "benchmark").where("text <> ''").select("item_id", F.col("text").alias("passage"), X.words(F.col("text")).alias("w")).where("size(w) > 0")
    docs = table(s, d, "documents").where("text <> ''").select("doc_id", "text")
    words = docs.select("doc_id", X.words(F.col("text")).alias("w"))
    runs = F.when(F.size("w") >= 8, run("w")).otherwise(F.array().cast("array<bigint>"))
    keys = words.select("doc_id", F.explode(F.array_union(runs, F.transform("w", word))).alias("key"))
    longest = F.aggregate(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    of_item = F.when(F.size("w") >= 10, F.xxhash64(F.slice("w", 2, 8))).otherwise(word(longest))
    likely = keys.join(items.where("size(w) > 2").select("item_id", of_item.alias("key")), "key").select("doc_id", "item_id")
    short = items.where("size(w) < 3").select("item_id", "passage")
    least = short.agg(F.min(F.length("passage"))).first()[0]
    if least:
        n = min(least, 4)
        pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), lambda i: F.substr("text", i, F.lit(n))))
        some = docs.where(F.length("text") >= n).select("doc_id", F.explode(pieces).alias("key"))
        likely = likely.unionByName(some.join(short.select("item_id", F.substring("passage", 1, n).alias("key")), "key").select("doc_id", "item_id"))
    found = likely.distinct().join(items.select("item_id", "passage"), "item_id").withColumnRenamed("doc_id", "at")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("at"))).where(F.contains("text", F.col("passage"))).select("doc_id", "item_id").distinct()


def benchmark_anti(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").join(benchmark_leaks(s, d).select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "lang", "source")


def checksums(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")
    grade, solution, locked = (F.pmod(F.floor(F.col("doc_id") / n), F.lit(2)) == 0 for n in (1, 2, 4))
    return docs.select("doc_id", X.cell_checksum(F.col("text"), F.lit("code"), grade, solution, locked, F.col("source"), F.lit(2.0)).alias("checksum"))


def spans(s: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("# BEGIN SOLUTION\n"), F.coalesce("text", F.lit("")), F.lit("\n# END SOLUTION\nprint()"))
    return table(s, d, "documents").select("doc_id", F.array_join(X.solution_span(F.split(marked, "\n", -1)), "\n").alias("span"))


def rewrites(s: SparkSession, d: str) -> DataFrame:
    dressed = F.concat(F.lit("%magic on\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n  %x\nprint y\n"))
    return table(s, d, "documents").select("doc_id", F.md5(X.print_calls(X.strip_magics(dressed)).cast("binary")).alias("rewritten"))


def imports(s: SparkSession, d: str) -> DataFrame:
    source = F.concat(F.lit("import "), F.col("p_name"), F.lit(" as x\ny = 1\nfrom "), F.col("p_brand"), F.lit(" import z"))
    return table(s, d, "part").select("p_partkey", F.array_join(X.import_tokens(source), ",").alias("tokens"))


def code_records(s: SparkSession, d: str) -> DataFrame:
    """Analysis of generated code cells, one a part; dealt to four tasks a core, however few files hold the table."""
    from ..functions.code import analyze

    source = F.concat(F.lit("import pandas as pd\ndef f(a):\n    # "), F.col("p_name"), F.lit("\n    return pd.read_csv('"), F.col("p_brand"), F.lit("', a)\n"))
    parts = table(s, d, "part").select("p_partkey", "p_name", "p_brand").repartition(4 * s.sparkContext.defaultParallelism)
    out = parts.select("p_partkey", analyze(source).alias("c"))
    return out.select("p_partkey", F.array_join("c.api_sequence", ",").alias("api"), F.array_join("c.comments", " ").alias("comments"), F.array_join("c.code_tokens_clean", " ").alias("clean"))


def added_lines(s: SparkSession, d: str) -> DataFrame:
    """What documents of ten lines at most, as solutions, add to a template: two lines in one run, or in two runs where the id is odd."""
    from ..functions.solutions import with_target

    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^a-zA-Z \n]", "x")
    lines = F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("k"), F.btrim(x)))
    rows = table(s, d, "documents").select("doc_id", F.transform(lines, lambda x, i: F.concat(x, i)).alias("lines")).where(F.size("lines").between(1, 10))
    solved = F.when(F.col("doc_id") % 2 == 0, F.concat(F.array(F.lit("new = 1"), F.lit("# remark"), F.lit("new = 2")), F.col("lines"))).otherwise(F.concat(F.array(F.lit("new = 1")), F.col("lines"), F.array(F.lit("new = 2"))))
    return with_target(rows, F.array_join("lines", "\n"), F.array_join(solved, "\n"), "added").select("doc_id", "added")


def detected_languages(s: SparkSession, d: str) -> DataFrame:
    """For each language that documents are labelled with, whether the model agrees on 95 % of its texts at least."""
    from ..functions.language import detect_language

    names = F.create_map(*[F.lit(x) for kv in (("en", "English"), ("fr", "French"), ("de", "German"), ("es", "Spanish")) for x in kv])
    told = table(s, d, "documents").where("text is not null").select("lang", (detect_language(F.col("text")) == F.element_at(names, F.col("lang"))).alias("same"))
    return told.groupBy("lang").agg(F.count("*").alias("n_docs"), (F.avg(F.col("same").cast("int")) >= 0.95).alias("agrees"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda s, d: table(s, d, "documents")
    return {
        "train_records": train_records,
        "scan_filter_lang": lambda s, d: K.in_languages(docs(s, d), F.col("lang"), ("en", "un")).select("doc_id", "source", F.length("text").cast("long").alias("n")),
        "raw_substring_filter": lambda s, d: docs(s, d).where(~F.contains("text", F.lit("the"))).select("doc_id", "lang"),
        "json_metadata_project": lambda s, d: table(s, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.absent"), F.lit("")).alias("absent")),
        "markdown_ratio": lambda s, d: K.markdown_ratio(chats(s, d), 0.3),
        "code_after_markdown": lambda s, d: K.code_after_markdown(chats(s, d)),
        "ascii_veto": lambda s, d: K.ascii_only(chats(s, d)),
        "md_within_k": lambda s, d: K.markdown_within(chats(s, d), 3).select("nb_index", "cell_index", "has_markdown"),
        "nearest_markdown": lambda s, d: K.nearest_markdown(chats(s, d), 5).select("nb_index", "cell_index", "nl"),
        "nearest_following_test": nearest_test,
        "context_window": lambda s, d: K.exploded_context(chats(s, d), chats(s, d).where(K.is_code()).select("nb_index", "cell_index"), 12).select("nb_index", "cell_index", "distance_target", "context_type", "context_source"),
        "label_frequencies_topk": lambda s, d: D.top_frequencies(table(s, d, "events"), "event_type"),
        "exact_dedup_first": lambda s, d: D.first_by(docs(s, d), F.col("text"), ["doc_id"]).select("doc_id", "lang", "source"),
        "chained_dedup": lambda s, d: D.first_by(D.first_by(docs(s, d), F.col("text"), ["doc_id"]).withColumn("line", first_line()), F.col("line"), ["doc_id"]).select("doc_id", "line"),
        "majority_by_group": lambda s, d: D.majority(docs(s, d).withColumn("line", first_line()), ["line"], "text", "source", "doc_id").select("line", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n", "n_sources", "first"),
        "near_dup_pairs": near_dup_pairs,
        "near_dup_classes": lambda s, d: linked_classes(s, d, D.similar_kinds),
        "lsh_dup_classes": lambda s, d: linked_classes(s, d, D.banded_kinds),
        "positional_diff": positional,
        "split_leak_guard": lambda s, d: D.split_without_leaks(docs(s, d), "doc_id", "text").select("doc_id", "part"),
        "benchmark_leaks": benchmark_leaks,
        "benchmark_anti_join": benchmark_anti,
        "union_seeded_shuffle": lambda s, d: D.shuffled_union([docs(s, d).select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text"), table(s, d, "benchmark").select(F.lit("b").alias("kind"), F.col("item_id").alias("id"), "text")], ["kind", "id"]).select("kind", "id", "shuffle_key"),
        "grading_decision": grading_decision,
        "cell_checksum": checksums,
        "strip_and_print_rewrite": rewrites,
        "import_tokens": imports,
        "html_strip_tokens": lambda s, d: table(s, d, "pages").select("page_id", F.array_join(X.html_tokens(F.coalesce("html", F.lit(""))), " ").alias("tokens")),
        "token_limit": lambda s, d: docs(s, d).select("doc_id", F.size(X.words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words")).where("n_words between 1 and 120"),
        "solution_span": spans,
        "record_urls": lambda s, d: table(s, d, "pages").select("page_id", X.record_url("https://example.org/", F.concat(F.lit("a b "), F.col("url"))).alias("link")),
        "join_star": lambda s, d: table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")),
        "code_analysis": code_records,
        "train_pipeline": generated.train,
        "graded_pipeline": generated.graded,
        "exercise_pipeline": generated.exercise,
        "graded_split": generated.graded_split,
        "exercise_split": generated.exercise_split,
        "final_dataset": generated.final_dataset,
        "detected_languages": detected_languages,
        "split_exactly": lambda s, d: D.split_exactly(docs(s, d), ["doc_id"], "text").select("doc_id", "part"),
        "decoded_notebooks": generated.decoded,
        "event_runs": lambda s, d: K.runs(table(s, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type")).select("event_id", F.col("run").cast("long").alias("run")),
        "added_lines": added_lines,
        "any_test_below": any_test,
        "repos_with_cells": lambda s, d: K.repos_with_cells(chats(s, d).withColumns({"repo": F.col("nb_index") % 7, "path": F.col("nb_index")})),
        "distinct_codes": lambda s, d: D.distinct_values(docs(s, d), ["source"], "text"),
        "running_imports": imports_so_far,
        "exercise_grading": exercise_grading,
        "with_code_tags": code_tags,
    }


CHATS = "(SELECT conv_id AS nb_index, turn::BIGINT AS cell_index, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' WHEN 'system' THEN 'raw' ELSE '' END AS cell_type, coalesce(text, '') AS source FROM conversations)"
BY = "PARTITION BY nb_index ORDER BY cell_index"
WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
LINE = "split_part(coalesce(text, ''), chr(10), 1)"
FIRST = "SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS nth FROM documents WHERE text <> ''"
LEAKS = "SELECT DISTINCT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> '' AND d.text <> '' AND len(regexp_extract_all(b.text, '[^\\x20\\x09-\\x0D]+')) > 0"


TEMPLATE = "('# YOUR CODE HERE' || chr(10) || 'raise NotImplementedError()')"

CLASSES = """WITH s AS (SELECT lang, doc_id, list_sort(list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''))) AS items FROM documents),
            k AS (SELECT lang, doc_id, items, min(doc_id) OVER (PARTITION BY lang, items) AS class_id FROM s WHERE len(items) > 0), f AS (SELECT lang, class_id, len(items) AS n, unnest(items) AS item FROM k WHERE doc_id = class_id),
            p AS (SELECT a.lang, a.class_id AS a, b.class_id AS b FROM f a JOIN f b ON a.lang = b.lang AND a.item = b.item AND a.class_id <> b.class_id GROUP BY 1, 2, 3 HAVING 100 * count(*) >= 50 * (any_value(a.n) + any_value(b.n) - count(*))),
            l AS (SELECT lang, a, count(*) AS n_links FROM p GROUP BY 1, 2) SELECT k.lang, doc_id, class_id, len(items)::BIGINT AS n_lines, coalesce(n_links, 0)::BIGINT AS n_links FROM k LEFT JOIN l ON k.lang = l.lang AND k.class_id = l.a"""
GRADED = f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
    c AS (SELECT *, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN CASE k WHEN 0 THEN 'code' ELSE 'test' END ELSE 'raw' END AS kind FROM t, range(2) r(k) WHERE k = 0 OR role = 'assistant'),
    p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i FROM c),
    w AS (SELECT *, last_value(CASE WHEN kind = 'markdown' THEN 'task ' || (n % 50) END IGNORE NULLS) OVER near AS nl, i - last_value(CASE WHEN kind = 'markdown' THEN i END IGNORE NULLS) OVER near AS distance,
        count(*) FILTER (kind <> 'test' AND (kind <> 'raw' OR text <> '')) OVER (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 1200 PRECEDING AND 1 PRECEDING) AS above
        FROM p WINDOW near AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
    q AS (SELECT *, nl || chr(1) || distance || chr(1) || md5({TEMPLATE} || 'codeFalseTrueFalseq' || (n % 50)) AS question, conv_id % 3 = 0 AS boiler, conv_id % 5 <> 1 AND turn % 4 <> 0 AS passed, n % 50 % 10 AS form,
        CASE WHEN n % 50 % 10 = 8 THEN -1 ELSE n % 7 END AS answer, conv_id * 1000000 + i AS spot FROM w WHERE kind = 'code' AND nl IS NOT NULL),
    v AS (SELECT question, answer, count(*) AS n, min(spot) AS first, arg_min(above, spot) AS above FROM q WHERE NOT boiler AND form IN (7, 8) GROUP BY 1, 2),
    b AS (SELECT question, arg_max(answer, (n, -first)) AS best, max(n) AS n, arg_max(above, (n, -first)) AS above FROM v GROUP BY 1),
    g AS (SELECT question, any_value(form) AS form, count(*) FILTER (NOT boiler) AS n_solutions, max(boiler) AS has_template, first(answer ORDER BY spot) FILTER (NOT boiler AND passed) AS answer, first(above ORDER BY spot) FILTER (NOT boiler AND passed) AS above FROM q GROUP BY question),
    o AS (SELECT g.question, form, n_solutions, b.question IS NOT NULL AS marked, best, b.n AS n_best, coalesce(b.above, g.above) AS above, answer, has_template OR (b.question IS NULL AND answer IS NOT NULL AND (SELECT max(boiler) FROM q)) AS released FROM g LEFT JOIN b ON g.question = b.question),
    s AS (SELECT *, CASE WHEN n_solutions = 0 THEN 'only boiler' WHEN marked THEN CASE WHEN n_best < 2 THEN 'only 1 solution' WHEN form = 8 THEN 'empty extracted tokens' ELSE 'success' END
        WHEN answer IS NULL THEN 'no autograder tests or none passed' WHEN NOT released THEN 'no boilerplate' ELSE 'success' END AS status FROM o)
    SELECT question, status, CASE WHEN released THEN {TEMPLATE} END AS template, n_solutions, CASE WHEN status = 'success' THEN above ELSE 0 END AS n_context, marked || ':' || coalesce(best, answer) AS code,
    CASE WHEN marked THEN CASE form WHEN 8 THEN '# none' ELSE 'answer = compute(' || best || ')' END WHEN released AND answer IS NOT NULL THEN 'answer = compute(' || answer || ')' END AS extracted,
    CASE WHEN marked THEN CASE form WHEN 8 THEN 'NEWLINE' ELSE 'NEWLINE answer = compute ( ' || best || ' )' END WHEN released AND answer IS NOT NULL THEN 'answer = compute ( ' || answer || ' )' END AS extracted_tokens,
    CASE WHEN marked THEN 'x = 1 NEWLINE' WHEN released THEN '' END AS template_tokens FROM s"""
EXERCISE = """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
            c AS (SELECT conv_id, turn, k, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE 'raw' END AS kind,
            CASE role WHEN 'user' THEN 'this is the task for ' || (n % 20) || CASE k WHEN 1 THEN ' and that is all of it' ELSE '' END WHEN 'assistant' THEN 'best = search(' || (n % 3) || ')' ELSE text END AS source FROM t, range(2) r(k) WHERE k = 0 OR role = 'user'),
            p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) - 1 AS i FROM c),
            s AS (SELECT conv_id, count(DISTINCT source) FILTER (kind <> 'code' AND source <> '') AS shared, count(DISTINCT source) FILTER (kind = 'code') AS answers FROM p GROUP BY conv_id HAVING count(*) FILTER (kind = 'markdown') > 0),
            w AS (SELECT *, last_value(CASE WHEN kind = 'markdown' THEN source END IGNORE NULLS) OVER above AS nl, i - last_value(CASE WHEN kind = 'markdown' THEN i END IGNORE NULLS) OVER above AS distance FROM p WINDOW above AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            r AS (SELECT coalesce(nl, 'yo') || chr(1) || coalesce(distance, 0) AS grp, 'r' || conv_id AS repo, i, source FROM w JOIN s USING (conv_id) WHERE kind = 'code' AND 100 * shared >= 50 * (shared + answers)),
            o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY repo, i) AS pos, count(*) OVER (PARTITION BY grp) AS n_all FROM r),
            v AS (SELECT grp, source, count(*) AS n_code, count(DISTINCT repo) AS n_repos, min(pos) AS first, any_value(n_all) AS n_all FROM o GROUP BY grp, source),
            b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n_code DESC, first) AS nth FROM v)
            SELECT grp AS "group", CASE WHEN n_code < 2 OR n_all < 2 THEN 'only 1 solution' WHEN n_repos < 2 THEN 'only from 1 repo' ELSE 'success' END AS status, source AS target, '' AS boilerplate, n_code, n_repos FROM b WHERE nth = 1"""
TRAIN = rf"""WITH c AS (SELECT conv_id AS nb_index, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS cell_index, CASE role WHEN 'user' THEN 'markdown' WHEN 'assistant' THEN 'code' ELSE 'raw' END AS cell_type, coalesce(text, '') AS t FROM conversations),
            n AS (SELECT *, CASE WHEN cell_type = 'markdown' AND t <> '' THEN 'about ' || md5(t) || CASE WHEN regexp_matches(t, '[^\x00-\x7F]') THEN ' é' ELSE '' END ELSE t END AS source FROM c),
            w AS (SELECT *, lag(cell_type) OVER ({BY}) AS above, lag(source) OVER ({BY}) AS above_source, last_value(CASE WHEN cell_type = 'markdown' AND source <> '' THEN source END IGNORE NULLS) OVER ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS nl,
            count(*) FILTER (source <> '') OVER ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n_context, count(*) FILTER (cell_type = 'code' AND source <> '') OVER ({BY}) AS n_imports FROM n),
            v AS (SELECT *, max(coalesce(cell_type = 'code' AND above = 'markdown' AND regexp_matches(above_source, '[^\x00-\x7F]'), false)) OVER (PARTITION BY nb_index) AS veto FROM w),
            a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY nb_index, cell_index) AS nth FROM v WHERE cell_type = 'code' AND above = 'markdown' AND NOT veto AND source <> ''),
            b AS (SELECT *, row_number() OVER (PARTITION BY nl ORDER BY nb_index, cell_index) AS mth FROM a WHERE nth = 1 AND nl IS NOT NULL)
            SELECT nb_index, cell_index::BIGINT AS cell_index, nl, n_context::BIGINT AS n_context, n_imports::BIGINT AS n_imports, 'run,show' AS api, 17::BIGINT AS n_tokens FROM b WHERE mth = 1"""


def parts(results: str, of: str, code: str) -> str:
    """The exact split of a pipeline's successes."""
    return f"""WITH r AS (SELECT {of} AS id, {code} AS code, row_number() OVER (ORDER BY md5('0:' || {of})) <= ceil(count(*) OVER () * 0.55) AS test FROM ({results}) WHERE status = 'success')
        SELECT id, CASE WHEN test AND NOT EXISTS (SELECT 1 FROM r x WHERE NOT x.test AND x.code = r.code) THEN 'test' ELSE 'dev' END AS part FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "train_records": rf"""WITH c AS (SELECT *, lag(cell_type) OVER w AS above, lag(source) OVER w AS above_source,
            last_value(CASE WHEN cell_type = 'markdown' AND source <> '' THEN source END IGNORE NULLS) OVER ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS nl,
            count(*) FILTER (source <> '') OVER ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS n_context FROM {CHATS} WINDOW w AS ({BY})),
            v AS (SELECT *, max(coalesce(cell_type = 'code' AND above = 'markdown' AND regexp_matches(above_source, '[^\x00-\x7F]'), false)) OVER (PARTITION BY nb_index) AS veto FROM c),
            k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY nb_index, cell_index) AS nth FROM v WHERE cell_type = 'code' AND above = 'markdown' AND NOT veto AND source <> '')
            SELECT nb_index, cell_index, source, nl, cell_index AS num_cells_above, n_context::BIGINT AS n_context FROM k WHERE nth = 1""",
        "scan_filter_lang": "SELECT doc_id, source, length(text)::BIGINT AS n FROM documents WHERE lang IN ('en', 'un')",
        "raw_substring_filter": "SELECT doc_id, lang FROM documents WHERE NOT contains(text, 'the')",
        "json_metadata_project": "SELECT event_id, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k, coalesce(json_extract_string(props, '$.absent'), '') AS absent FROM events",
        "markdown_ratio": f"SELECT nb_index, avg((cell_type = 'markdown')::INT) AS ratio, count(*) AS n_cells, count(*) FILTER (cell_type = 'code') AS n_code, count(*) FILTER (cell_type = 'markdown') AS n_markdown FROM {CHATS} GROUP BY nb_index HAVING avg((cell_type = 'markdown')::INT) >= 0.3",
        "code_after_markdown": f"SELECT nb_index, cell_index, cell_type, source FROM (SELECT *, lag(cell_type) OVER ({BY}) AS above FROM {CHATS}) WHERE cell_type = 'code' AND above = 'markdown'",
        "ascii_veto": rf"WITH c AS (SELECT *, lead(cell_type) OVER ({BY}) AS below FROM {CHATS}), v AS (SELECT *, max(coalesce(cell_type = 'markdown' AND below = 'code' AND regexp_matches(source, '[^\x00-\x7F]'), false)) OVER (PARTITION BY nb_index) AS veto FROM c) SELECT nb_index, cell_index, cell_type, source FROM v WHERE NOT veto",
        "md_within_k": f"SELECT nb_index, cell_index, coalesce(max(cell_type = 'markdown') OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), false) AS has_markdown FROM {CHATS}",
        "nearest_markdown": f"SELECT nb_index, cell_index, last_value(CASE WHEN cell_type = 'markdown' AND source <> '' THEN source END IGNORE NULLS) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS nl FROM {CHATS}",
        "nearest_following_test": """SELECT event_id, first_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type = 'signup' END IGNORE NULLS) OVER w AS passed, coalesce(max(event_type IN ('error', 'signup') AND value > 50) OVER w, false) AS from_output
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)""",
        "context_window": f"SELECT t.nb_index, t.cell_index, t.cell_index - c.cell_index AS distance_target, c.cell_type AS context_type, c.source AS context_source FROM {CHATS} t JOIN {CHATS} c ON t.nb_index = c.nb_index AND t.cell_index - c.cell_index BETWEEN 1 AND 12 WHERE t.cell_type = 'code' AND c.source <> ''",
        "label_frequencies_topk": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 50",
        "exact_dedup_first": f"SELECT doc_id, lang, source FROM ({FIRST}) WHERE nth = 1",
        "chained_dedup": f"WITH a AS (SELECT doc_id, {LINE} AS line FROM ({FIRST}) WHERE nth = 1), b AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id) AS nth FROM a WHERE line <> '') SELECT doc_id, line FROM b WHERE nth = 1",
        "majority_by_group": f"WITH c AS (SELECT {LINE} AS line, text, count(*) AS n, count(DISTINCT source) AS n_sources, min(doc_id) AS first FROM documents GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY n DESC, first) AS nth FROM c) SELECT line, md5(text) AS text_md5, n, n_sources, first FROM r WHERE nth = 1 AND n >= 2",
        "near_dup_pairs": """WITH s AS (SELECT lang, doc_id, list_distinct(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '')) AS items FROM documents), f AS (SELECT lang, doc_id, len(items) AS n, unnest(items) AS item FROM s),
            p AS (SELECT a.lang, a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared, any_value(a.n) + any_value(b.n) - count(*) AS n_union FROM f a JOIN f b ON a.lang = b.lang AND a.item = b.item AND a.doc_id < b.doc_id GROUP BY 1, 2, 3) SELECT lang, a, b, n_shared::BIGINT AS n_shared, n_union::BIGINT AS n_union FROM p WHERE 100 * n_shared >= 50 * n_union""",
        "near_dup_classes": CLASSES,
        "lsh_dup_classes": CLASSES,
        "positional_diff": f"""WITH c AS (SELECT * FROM {CHATS}), n AS (SELECT nb_index, count(*) AS size FROM c GROUP BY 1) SELECT x.nb_index AS a, y.nb_index AS b, x.cell_index, x.source AS source_a, y.source AS source_b FROM c x JOIN c y ON y.nb_index = x.nb_index + 1 AND x.cell_index = y.cell_index
            JOIN n p ON p.nb_index = x.nb_index JOIN n q ON q.nb_index = y.nb_index AND p.size = q.size WHERE x.cell_type = 'code' AND x.source <> y.source""",
        "split_leak_guard": "WITH d AS (SELECT doc_id, text, CASE WHEN ('0x' || substr(md5('0:' || doc_id), 1, 6))::BIGINT % 100 < 55 THEN 'test' ELSE 'dev' END AS drawn FROM documents) SELECT doc_id, CASE WHEN drawn = 'test' AND NOT EXISTS (SELECT 1 FROM d e WHERE e.drawn = 'dev' AND e.text IS NOT DISTINCT FROM d.text) THEN 'test' ELSE 'dev' END AS part FROM d",
        "benchmark_leaks": LEAKS,
        "benchmark_anti_join": f"SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({LEAKS}))",
        "union_seeded_shuffle": "SELECT kind, id, md5('42:' || kind || ':' || id) AS shuffle_key FROM (SELECT 'd' AS kind, doc_id AS id FROM documents UNION ALL SELECT 'b', item_id FROM benchmark)",
        "grading_decision": """WITH f AS (SELECT event_id, event_id % 7 <> 0 AS p, (event_id // 5) % 2 = 0 AS hs, CASE event_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS s, (event_id // 11) % 2 = 0 AS hg, CASE (event_id // 3) % 3 WHEN 1 THEN true WHEN 2 THEN false END AS g FROM events)
            SELECT event_id, CASE WHEN NOT p THEN 'no nbgrader' WHEN NOT hs AND coalesce(g, false) THEN 'autograder tests' WHEN hs AND hg THEN CASE WHEN s AND NOT g THEN 'autograded code' WHEN s AND g THEN 'manual graded code' WHEN NOT s AND g THEN 'autograder tests' ELSE 'read only' END ELSE 'no nbgrader' END AS grading FROM f""",
        "cell_checksum": """WITH f AS (SELECT doc_id, coalesce(text, '') AS t, source, doc_id % 2 = 0 AS g, (doc_id // 2) % 2 = 0 AS s, (doc_id // 4) % 2 = 0 AS l FROM documents), b AS (SELECT *, CASE WHEN s THEN false WHEN g THEN true ELSE l END AS locked FROM f)
            SELECT doc_id, md5(t || 'code' || CASE WHEN g THEN 'True' ELSE 'False' END || CASE WHEN s THEN 'True' ELSE 'False' END || CASE WHEN locked THEN 'True' ELSE 'False' END || source || CASE WHEN g THEN '2.0' ELSE '' END) AS checksum FROM b""",
        "strip_and_print_rewrite": r"""WITH l AS (SELECT doc_id, string_split('%magic on' || chr(10) || replace(coalesce(text, ''), chr(13), '') || chr(10) || '  %x' || chr(10) || 'print y', chr(10)) AS lines FROM documents),
            k AS (SELECT doc_id, list_filter(lines, lambda x: NOT starts_with(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '%')) AS lines FROM l), j AS (SELECT doc_id, array_to_string(lines, chr(10)) AS t FROM k)
            SELECT doc_id, md5(array_to_string(list_transform(string_split(t, chr(10)), lambda x: CASE WHEN starts_with(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), 'print ') THEN replace(x, 'print ', 'print(') || ')' ELSE x END), chr(10))) AS rewritten FROM j""",
        "import_tokens": "SELECT p_partkey, array_to_string(list_filter(list_concat(string_split_regex('import ' || p_name || ' as x', '[^a-zA-Z_]'), ['z']), lambda t: t NOT IN ('import', 'as', '')), ',') AS tokens FROM part",
        "html_strip_tokens": r"SELECT page_id, array_to_string(" + WORDS.format(r"regexp_replace(replace(replace(coalesce(html, ''), '<code>', ' CTAG '), '</code>', ' CTAG '), '<[^\n]*?>', '', 'g')") + ", ' ') AS tokens FROM pages",
        "token_limit": f"SELECT doc_id, len({WORDS.format('coalesce(text, chr(32))')})::BIGINT AS n_words FROM documents WHERE len({WORDS.format('coalesce(text, chr(32))')}) BETWEEN 1 AND 120",
        "solution_span": """WITH l AS (SELECT doc_id, string_split('# BEGIN SOLUTION' || chr(10) || coalesce(text, '') || chr(10) || '# END SOLUTION' || chr(10) || 'print()', chr(10)) AS k FROM documents) SELECT doc_id, array_to_string(k[2:list_position(list_transform(k, lambda x: contains(x, 'END SOLUTION')), true) - 1], chr(10)) AS span FROM l""",
        "record_urls": "SELECT page_id, replace('https://example.org/a b ' || url, ' ', '%20') AS link FROM pages",
        "code_analysis": """SELECT p_partkey, 'read_csv' AS api, array_to_string(list_filter(string_split_regex('# ' || p_name, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') || ' COMMENTSEP' AS comments,
            'import pandas as pd NEWLINE NEWLINE def f ( a ) : NEWLINE INDENT return pd . read_csv ( ''jupyter_string'' , a )' AS clean FROM part""",
        "graded_pipeline": f"SELECT * EXCLUDE (code) FROM ({GRADED})",
        "exercise_pipeline": EXERCISE,
        "train_pipeline": TRAIN,
        "graded_split": parts(GRADED, "question", "code"),
        "exercise_split": parts(EXERCISE, '"group"', "target"),
        "final_dataset": f"""SELECT part, kind, id, md5('42:' || kind || ':' || id) AS shuffle_key FROM (SELECT part, 'graded' AS kind, id FROM ({parts(GRADED, "question", "code")}) UNION ALL
            SELECT part, 'exercise', id FROM ({parts(EXERCISE, '"group"', "target")}) UNION ALL SELECT 'train', 'train', nb_index || ':' || cell_index FROM ({TRAIN}))""",
        "decoded_notebooks": """WITH t AS (SELECT conv_id, turn % 5 AS k, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
            SELECT conv_id AS nb_index, i AS cell_index, CASE k WHEN 0 THEN 'code' WHEN 1 THEN 'markdown' WHEN 3 THEN 'code' ELSE '' END AS cell_type, md5(CASE WHEN k < 3 THEN text ELSE '' END) AS source_md5,
            CASE k WHEN 0 THEN -1 WHEN 2 THEN 7 ELSE 0 END::BIGINT AS count_or_null, (k = 2)::BIGINT AS n_outputs, k = 2 AS graded FROM t""",
        "event_runs": """WITH e AS (SELECT event_id, user_id, ts, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1, true)::INT AS begins FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
            SELECT event_id, sum(begins) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM e""",
        "added_lines": r"""WITH l AS (SELECT doc_id, len(list_filter(string_split(regexp_replace(coalesce(text, ''), '[^a-zA-Z \n]', 'x', 'g'), chr(10)), lambda x: trim(x, ' ') <> '')) AS n FROM documents)
            SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'new = 1' || chr(10) || 'new = 2' ELSE '' END AS added FROM l WHERE n BETWEEN 1 AND 10""",
        "detected_languages": "SELECT lang, count(*) AS n_docs, true AS agrees FROM documents WHERE text IS NOT NULL GROUP BY lang",
        "split_exactly": """WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY md5('0:' || doc_id)) <= ceil(count(*) OVER () * 0.55) AS test FROM documents)
            SELECT doc_id, CASE WHEN test AND NOT EXISTS (SELECT 1 FROM d e WHERE NOT e.test AND e.text IS NOT DISTINCT FROM d.text) THEN 'test' ELSE 'dev' END AS part FROM d""",
        "any_test_below": "SELECT event_id, coalesce(max(event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS any_test_below FROM events",
        "repos_with_cells": f"SELECT nb_index % 7 AS repo, count(*) AS n_cells, count(DISTINCT nb_index) AS n_notebooks FROM {CHATS} GROUP BY 1",
        "distinct_codes": "SELECT source, count(DISTINCT text) + max((text IS NULL)::INT) AS n_distinct FROM documents GROUP BY source",
        "running_imports": f"SELECT nb_index, cell_index, coalesce(string_agg(CASE WHEN cell_type = 'code' THEN 'a' || chr((97 + length(source) % 10)::INT) END, ',') OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS imports FROM {CHATS}",
        "exercise_grading": """WITH f AS (SELECT event_id, event_id % 7 <> 0 AS p, CASE event_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS s, CASE (event_id // 3) % 3 WHEN 1 THEN true WHEN 2 THEN false END AS g FROM events)
            SELECT event_id, CASE WHEN NOT p THEN 'unknown' WHEN s AND NOT g THEN 'autograded code' WHEN s AND g THEN 'manual graded code' WHEN NOT s AND g THEN 'autograder tests' ELSE 'unknown' END AS grading FROM f""",
        "with_code_tags": f"SELECT nb_index, cell_index, cell_type FROM {CHATS} WHERE nb_index IN (SELECT nb_index FROM {CHATS} WHERE cell_type = 'markdown' AND length(source) % 5 = 0)",
        "join_star": "SELECT c_mktsegment, l_returnflag, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    }
