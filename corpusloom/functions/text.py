"""Native text columns.  Lines end in \\n, \\r\\n or \\r; a final line end adds no line.  Space means ASCII white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"


def lines(source: Column) -> Column:
    """The lines of a text, none for an empty one."""
    body = F.regexp_replace(source, r"(\r\n|\r|\n)\z", "")
    return F.when(source == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\r|\n", -1))


def lstripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACES}+", "")


def strip_magics(source: Column) -> Column:
    """Without lines whose first visible character is %; a final line end is lost."""
    return F.array_join(F.filter(lines(source), lambda x: ~F.startswith(lstripped(x), F.lit("%"))), "\n")


def print_calls(source: Column) -> Column:
    """Lines that begin with the print statement become calls; every `print ` in such a line opens one, and one bracket closes it."""
    fixed = lambda x: F.when(F.startswith(lstripped(x), F.lit("print ")), F.concat(F.replace(x, F.lit("print "), F.lit("print(")), F.lit(")"))).otherwise(x)
    return F.array_join(F.transform(lines(source), fixed), "\n")


def words(text: Column) -> Column:
    """Runs of characters other than space."""
    return F.filter(F.split(text, f"{SPACES}+", -1), lambda x: x != "")


def import_tokens(source: Column) -> Column:
    """Names on import lines, from the first `import` of the line on; digits separate names."""
    line = lambda x: F.startswith(lstripped(x), F.lit("import ")) | (F.startswith(lstripped(x), F.lit("from ")) & F.contains(x, F.lit("import")))
    names = lambda x: F.filter(F.split(F.substr(x, F.position(F.lit("import"), x)), "[^a-zA-Z_]"), lambda t: ~t.isin("import", "as", ""))
    return F.flatten(F.transform(F.filter(lines(source), line), names))


def python_bool(flag: Column) -> Column:
    return F.when(flag, "True").otherwise("False")


def cell_checksum(source: Column, cell_type: Column, grade: Column, solution: Column, locked: Column, grade_id: Column, points: Column) -> Column:
    """md5 of a cell's source and grading marks; points count for graded cells only, as Python spells a float."""
    g, s = F.coalesce(grade, F.lit(False)), F.coalesce(solution, F.lit(False))
    held = F.when(s, F.lit(False)).when(g, F.lit(True)).otherwise(F.coalesce(locked, F.lit(False)))
    marks = F.when(g, F.coalesce(points, F.lit(0.0)).cast("string")).otherwise("")
    return F.md5(F.concat(source, cell_type, python_bool(g), python_bool(s), python_bool(held), F.coalesce(grade_id, F.lit("")), marks).cast("binary"))


def solution_marks(tokens: Column) -> tuple[Column, Column]:
    """Places, from 1, of the first token that holds BEGIN SOLUTION and of the first that holds END SOLUTION; 0 without one."""
    place = lambda mark: F.coalesce(F.array_position(F.transform(tokens, lambda x: F.contains(x, F.lit(mark))), True), F.lit(0)).cast("int")
    return place("BEGIN SOLUTION"), place("END SOLUTION")


def solution_span(tokens: Column) -> Column:
    """Tokens between the first that holds BEGIN SOLUTION and the first that holds END SOLUTION; null without both in order."""
    begin, end = solution_marks(tokens)
    return F.when((begin > 0) & (end > begin), F.slice(tokens, begin + 1, end - begin - 1))


def around_solution(tokens: Column) -> Column:
    """What solution_span() leaves, the marks included."""
    begin, end = solution_marks(tokens)
    return F.when((begin > 0) & (end > begin), F.concat(F.slice(tokens, F.lit(1), begin), F.slice(tokens, end, F.size(tokens) - end + 1)))


def html_tokens(html: Column) -> Column:
    """Words of rendered markdown: code tags become CTAG, other tags within a line go."""
    marked = F.replace(F.replace(html, F.lit("<code>"), F.lit(" CTAG ")), F.lit("</code>"), F.lit(" CTAG "))
    return words(F.regexp_replace(marked, "<[^\\n]*?>", ""))


def unwrap_tags(html: Column, tag: str) -> Column:
    """Text with one kind of tag taken off what it holds."""
    return F.regexp_replace(html, f"</?{tag}(?:\\s[^>]*)?>", "")


def record_url(prefix: str, path: Column) -> Column:
    return F.replace(F.concat(F.lit(prefix), path), F.lit(" "), F.lit("%20"))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")
