"""Python code analysis in one Arrow UDF: parsing, tokens, API calls, comments and normalised forms.

Code that doesn't parse or tokenize gives nulls.  Only the standard library's ast and
tokenize are used, so results follow the running Python's grammar: f-strings are put
together again as one STRING token, and statements are spelt by ast.unparse.
"""

from __future__ import annotations

import ast
import builtins
import io
import keyword
import tokenize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .slices import by_value

# Names that count as built in besides the running Python's own.
OLD_BUILTINS = {"xrange", "reduce", "unicode", "file", "reload"}
BUILTINS = frozenset(dir(builtins)) | frozenset(keyword.kwlist) | OLD_BUILTINS
# What normalised code puts in place of strings, functions, arguments and locals.
STRING, FUNCTION, ARGUMENT, LOCAL = "jupyter_string", "method_name", "arg", "loc"
LINES = 10
NO_CALLS = "NO_API_SEQUENCE"

RESULT = "parses boolean, code_tokens array<string>, token_types array<string>, code_tokens_clean array<string>, code_tokens_normalized array<string>, code_tokens_normalized_trunc array<string>, code_tokens_partial_normalized_trunc array<string>, comments array<string>, docstring array<string>, api_sequence array<string>, api_sequence_declared array<string>"

Token = tuple[str, str]
#: How many codes' spelt() a task keeps.
KEPT = 4096


def tokens_of(code: str, name_words: bool = True) -> list[Token]:
    """(token, type) pairs.  With name_words, a keyword or built-in is its own type, any other name is NAME."""
    out: list[Token] = []
    if code and not code.endswith("\n"):
        code += "\n"
    depth, opened = 0, (0, 0)
    rows = code.splitlines(keepends=True)
    for t in tokenize.generate_tokens(io.StringIO(code).readline):
        kind = tokenize.tok_name[t.type]
        if kind.endswith("STRING_START") and kind != "STRING":
            depth, opened = depth + 1, t.start if not depth else opened
            continue
        if depth:
            if kind.endswith("STRING_END"):
                depth -= 1
                if not depth:
                    out.append((between(rows, opened, t.end), "STRING"))
            continue
        if kind in ("ENCODING", "ENDMARKER"):
            continue
        if kind == "NAME":
            out.append((t.string, t.string if name_words and t.string in BUILTINS else "NAME"))
        else:
            out.append((t.string, t.string if kind == "OP" else kind))
    return out


def untokenized(tokens: list[Token]) -> str:
    """Code that has these tokens; blanks between them are not those of the code they came from."""
    named = {name: number for number, name in tokenize.tok_name.items()}
    number = lambda text, kind: named[kind] if kind in named else tokenize.NAME if text.isidentifier() else tokenize.OP
    return tokenize.untokenize([(number(text, kind), text) for text, kind in tokens])


def between(rows: list[str], start: tuple[int, int], end: tuple[int, int]) -> str:
    """Source text from one (row, column) to another."""
    if start[0] == end[0]:
        return rows[start[0] - 1][start[1] : end[1]]
    return "".join([rows[start[0] - 1][start[1] :], *rows[start[0] : end[0] - 1], rows[end[0] - 1][: end[1]]])


def parses(code: str) -> bool:
    try:
        ast.parse(code)
        tokens_of(code)
    except Exception:  # noqa: BLE001 - anything the parser raises means no
        return False
    return True


def api_calls(tokens: list[Token], declarations: bool = False) -> list[str]:
    """Names called, in order.  A built-in counts only as a method; a declared name doesn't count, or with declarations gives `def` and itself twice."""
    out: list[str] = []
    bare = [t for t, _ in tokens]
    for i, (name, kind) in enumerate(tokens[:-1]):
        if bare[i + 1] != "(" or not (kind == "NAME" or name == kind and name.isidentifier()):
            continue
        before = bare[i - 1] if i else ""
        if before in ("def", "class"):
            if declarations and before == "def":
                out += ["def", name, name]
        elif name not in BUILTINS or before == ".":
            out.append(name)
    return out


def identifiers(tokens: list[Token]) -> list[str]:
    return [t for t, kind in tokens if kind == "NAME"]


def comments_of(tokens: list[Token]) -> tuple[list[str], list[str]]:
    """(words of the comments, COMMENTSEP after each; words of the last docstring)."""
    comments: list[str] = []
    docstring: list[str] = []
    for i, (text, kind) in enumerate(tokens):
        if kind == "COMMENT":
            comments += [*text.split(), "COMMENTSEP"]
        elif kind == "STRING" and i and tokens[i - 1][1] == "INDENT":
            docstring = text.replace('"""', " docstring ").replace("'''", " docstring ").split()
    return comments, docstring


def clean(tokens: list[Token], comments: bool = False, strings: bool = True) -> list[str]:
    """Token texts with layout spelt out: NEWLINE, INDENT, no DEDENT, one trailing NEWLINE off; comments kept or dropped, strings made alike."""
    out = []
    for text, kind in tokens:
        if kind == "DEDENT" or (kind == "COMMENT" and not comments):
            continue
        if kind == "INDENT":
            out.append("INDENT")
        elif kind == "STRING" and strings:
            out.append(f"'{STRING}'")
        elif text in ("\n", "\r\n") or kind in ("NEWLINE", "NL"):
            out.append("NEWLINE")
        else:
            out.append(text)
    if not out:
        raise ValueError("no tokens")
    return out[:-1] if out[-1] == "NEWLINE" else out


def first_lines(tokens: list[str], most: int = LINES) -> list[str]:
    """What stands before the most-th NEWLINE."""
    seen = 0
    for i, t in enumerate(tokens):
        seen += t == "NEWLINE"
        if seen == most:
            return tokens[:i]
    return tokens


def single_function(tree: ast.Module) -> ast.Module:
    """The first top-level function without its docstring; without a function, everything but plain imports."""
    for node in tree.body:
        if isinstance(node, ast.FunctionDef):
            first = node.body[0]
            if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
                node.body = node.body[1:] or [ast.Pass()]
            return ast.Module([node], [])
    return ast.Module([x for x in tree.body if not isinstance(x, ast.Import)], [])


class AlikeStrings(ast.NodeTransformer):
    """Every string constant becomes the same one."""

    def visit_Constant(self, node: ast.Constant) -> ast.AST:
        return ast.copy_location(ast.Constant(STRING), node) if isinstance(node.value, str) else node

    def visit_JoinedStr(self, node: ast.JoinedStr) -> ast.AST:
        return node


class AlikeNames(AlikeStrings):
    """Also functions, their arguments and assigned names become numbered ones.

    A name's number is that of names known when it was last assigned, so assigning a
    name again may give it another's number.
    """

    def __init__(self) -> None:
        self.arguments: dict[str, str] = {}
        self.locals: dict[str, str] = {}
        self.assigning = 0

    def visit_FunctionDef(self, node: ast.FunctionDef) -> ast.AST:
        node.name = FUNCTION
        for a in node.args.args:
            self.arguments[a.arg] = a.arg = f"{ARGUMENT}{len(self.arguments)}"
        return self.generic_visit(node)

    def visit_Assign(self, node: ast.Assign) -> ast.AST:
        self.assigning += 1
        out = self.generic_visit(node)
        self.assigning -= 1
        return out

    def visit_Name(self, node: ast.Name) -> ast.AST:
        if self.assigning and isinstance(node.ctx, ast.Store):  # targets of any depth, and loops inside the value
            self.locals[node.id] = f"{LOCAL}{len(self.locals)}"
        name = self.arguments.get(node.id) or self.locals.get(node.id) or node.id
        return ast.copy_location(ast.Name(name, node.ctx), node)


def normalized(code: str, names: bool = True) -> str:
    """Code with strings, and with `names` also names, made alike."""
    tree = (AlikeNames if names else AlikeStrings)().visit(ast.parse(code))
    return ast.unparse(ast.fix_missing_locations(tree))


def without_last_expression(code: str) -> str:
    """Code without a trailing line that only shows a name, an attribute or an item."""
    tree = ast.parse(code)

    def shows(x: ast.expr) -> bool:
        return isinstance(x, ast.Name) or (isinstance(x, (ast.Attribute, ast.Subscript)) and shows(x.value))

    if tree.body and isinstance(tree.body[-1], ast.Expr) and shows(tree.body[-1].value):
        tree.body = tree.body[:-1]
    return ast.unparse(tree)


def stored_and_loaded(code: str) -> tuple[set[str], set[str]]:
    """(names that the code binds, names that it reads)."""
    stored, loaded = set(), set()
    for node in ast.walk(ast.parse(code)):
        if isinstance(node, ast.Name):
            (loaded if isinstance(node.ctx, ast.Load) else stored).add(node.id)
        elif isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            stored.add(node.name)
        elif isinstance(node, ast.arg):
            stored.add(node.arg)
        elif isinstance(node, ast.alias):
            stored.add((node.asname or node.name).split(".")[0])
        elif isinstance(node, ast.ExceptHandler) and node.name:
            stored.add(node.name)
    return stored, loaded


def free_names(code: str) -> set[str]:
    stored, loaded = stored_and_loaded(code)
    return loaded - stored


def shape(code: str, tokens: list[Token]) -> tuple | None:
    """What spelt() depends on: the tokens without comments and with all strings alike; null where a string's own text may count."""
    out = []
    for text, kind in tokens:
        if kind == "STRING":
            if text[0] not in "'\"" or "\\" in text:  # prefixes and escapes
                return None
            out.append("''")
        elif kind in LAYOUT:
            out.append(LAYOUT[kind])
        elif kind not in ("COMMENT", "NL"):
            out.append(text)
    return None if "\0" in code else tuple(out)


#: Stand for tokens whose text doesn't matter.
LAYOUT = {"NEWLINE": "\n", "INDENT": "\t", "DEDENT": "\b"}


def spelt(code: str) -> tuple:
    """(code_tokens_clean, code_tokens_normalized, code_tokens_normalized_trunc, code_tokens_partial_normalized_trunc) of code that parses."""
    tree = ast.parse(code)
    whole = clean(tokens_of(ast.unparse(tree)))
    body = ast.unparse(single_function(tree))
    own, alike = tokens_of(body), tokens_of(normalized(body))
    return (
        whole, [t for t, _ in alike] or None,
        first_lines(clean(alike, comments=True, strings=False)) if alike else None, first_lines(clean(own, comments=True)) if own else None,
    )


def analyze_one(code: str | None, kept: dict | None = None) -> dict | None:
    """All fields of RESULT; parses alone where anything fails.

    code_tokens are those of the code as it stands, code_tokens_clean those of the
    whole code spelt anew; the normalised ones leave imports out and keep one function.
    Code is spelt once for all that differs in comments and plain strings only: `kept`
    holds what was.
    """
    if code is None:
        return None
    try:
        tokens = tokens_of(code)
        comments, docstring = comments_of(tokens)
        key = None if kept is None else shape(code, tokens)
        if key is None or key not in kept:
            forms = spelt(code)
            if key is not None:
                if len(kept) >= KEPT:
                    kept.clear()
                kept[key] = forms
        else:
            forms = kept[key]
        whole, alike, trunc, partial = forms
        named = lambda x: x or ([NO_CALLS] if alike else [])
        return {
            "parses": True, "code_tokens": [t for t, _ in tokens], "token_types": [k for _, k in tokens], "code_tokens_clean": whole, "code_tokens_normalized": alike,
            "code_tokens_normalized_trunc": trunc, "code_tokens_partial_normalized_trunc": partial,
            "comments": comments, "docstring": docstring, "api_sequence": named(api_calls(tokens)), "api_sequence_declared": named(api_calls(tokens, True)),
        }
    except Exception:  # noqa: BLE001 - code that can't be analysed has no fields
        return {"parses": parses(code)}


#: RESULT in Arrow.
ARROW = pa.struct([(f.split()[0], pa.bool_() if f.endswith("boolean") else pa.list_(pa.string())) for f in RESULT.split(", ")])


def analyze(code: Column) -> Column:
    """Struct RESULT, computed once a row: the UDF is marked as not deterministic so that no projection repeats it; null fields for null."""
    kept: dict = {}
    return by_value(lambda x: analyze_one(x, kept) or {}, RESULT, ARROW, code, once=True)


def plain_tokens(code: Column) -> Column:
    """Tokens of code that need not parse, strings made alike and comments dropped; null where it can't be tokenized."""

    def one(x: str | None) -> list[str] | None:
        try:
            return None if x is None else clean(tokens_of(x))
        except Exception:  # noqa: BLE001 - whatever the tokenizer raises
            return None

    return by_value(one, "array<string>", pa.list_(pa.string()), code, once=True)


def typed_tokens(code: Column) -> Column:
    """The token stream of analyze() as one array of (text, kind), so that a stretch of it keeps its kinds."""
    return F.transform(F.arrays_zip(code["code_tokens"].alias("text"), code["token_types"].alias("kind")), lambda t: F.struct(t["text"].alias("text"), t["kind"].alias("kind")))


def laid_out(tokens: Column) -> Column:
    """clean() of a stretch of typed_tokens(), comments dropped and strings alike; empty where nothing is left."""
    kept = F.filter(tokens, lambda t: ~t["kind"].isin("DEDENT", "COMMENT"))
    spelt = F.transform(kept, lambda t: F.when(t["kind"] == "INDENT", "INDENT").when(t["kind"] == "STRING", f"'{STRING}'").when(t["kind"].isin("NEWLINE", "NL") | t["text"].isin("\n", "\r\n"), "NEWLINE").otherwise(t["text"]))
    return F.when(F.get(spelt, F.size(spelt) - 1) == "NEWLINE", F.slice(spelt, 1, F.greatest(F.size(spelt) - 1, F.lit(0)))).otherwise(spelt)


def logic_type(boilerplate: Column, api_sequence: Column, tokens: Column, least: int = 0, most: int = 15) -> Column:
    """What kind of code a cell is; the length of its API sequence is judged before its definitions."""
    n = F.size(F.filter(api_sequence, lambda x: x != NO_CALLS))
    defs = F.size(F.filter(tokens, lambda x: x == "def"))
    return (
        F.when(F.coalesce(boilerplate, F.lit(False)), "boilerplate").when(n > most, f"api seq longer than {most}").when(n < least, f"api seq shorter than {least}")
        .when(F.array_contains(tokens, "class"), "class").when(defs > 1, "more than 1 function").when(defs == 1, "1 function").otherwise("pure logic")
    )
