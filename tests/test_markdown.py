"""Cases after the rules of CommonMark, in words of their own."""

import pytest

from corpusloom.functions import language
from corpusloom.functions.markdown import render


def flat(text):
    return render(text).replace("\n", "")


@pytest.mark.parametrize(("text", "want"), [
    # blocks
    ("    x = 1\n    y = 2", "<pre><code>x = 1y = 2</code></pre>"), ("a\n    still a", "<p>astill a</p>"), ("\tx\n\n\ty\n\nz", "<pre><code>xy</code></pre><p>z</p>"),
    ("```python\na < b\n```\nafter", "<pre><code>a &lt; b</code></pre><p>after</p>"), ("~~~~\n```\n~~~\n~~~~", "<pre><code>```~~~</code></pre>"), ("```\nnever closed", "<pre><code>never closed</code></pre>"), ("``` a`b", "<p>``` a`b</p>"),
    ("# one #\n## two\n#not", "<h1>one</h1><h2>two</h2><p>#not</p>"), ("head\n===\nsub\n---", "<h1>head</h1><h2>sub</h2>"), ("* * *\n___", "<hr /><hr />"), ("####### seven", "<p>####### seven</p>"),
    ("> quoted\nlazily\n\nout", "<blockquote><p>quotedlazily</p></blockquote><p>out</p>"), (">     code", "<blockquote><pre><code>code</code></pre></blockquote>"),
    ("- one\n- two\n  - deep\n- three", "<ul><li>one</li><li>two<ul><li>deep</li></ul></li><li>three</li></ul>"), ("3. a\n4. b", "<ol><li>a</li><li>b</li></ol>"), ("- a\n\n- b", "<ul><li><p>a</p></li><li><p>b</p></li></ul>"),
    ("- a\n\n      code", "<ul><li><p>a</p><pre><code>code</code></pre></li></ul>"), ("- a\n+ b", "<ul><li>a</li></ul><ul><li>b</li></ul>"), ("text\n2. no list", "<p>text2. no list</p>"), ("text\n- list", "<p>text</p><ul><li>list</li></ul>"),
    ("a | b\n--|--\n`x` | y \\| z", "<table><th>a</th> <th>b</th> <td><code>x</code></td> <td>y | z</td> </table>"), ("a | b\n--|--|--", "<p>a | b--|--|--</p>"),
    ("<div>\n*raw*\n</div>\n\n*not*", "<div>*raw*</div><p><em>not</em></p>"), ("[ref]: /url\n\nsee [ref] and [other]", "<p>see <a>ref</a> and [other]</p>"), ("", ""), ("\n \n", ""),
    # inline
    ("`a` ``b ` c`` `` ` `` `open", "<p><code>a</code> <code>b ` c</code> <code>`</code> `open</p>"), ("`` no", "<p>`` no</p>"), (r"\*no\* \a", r"<p>*no* \a</p>"), ("`\\`", "<p><code>\\</code></p>"),
    ("*a* _b_ **c** __d__", "<p><em>a</em> <em>b</em> <strong>c</strong> <strong>d</strong></p>"), ("***both***", "<p><em><strong>both</strong></em></p>"), ("**a *b* c**", "<p><strong>a <em>b</em> c</strong></p>"),
    ("snake_case_name and 2*3*4", "<p>snake_case_name and 2<em>3</em>4</p>"), ("a * b * c", "<p>a * b * c</p>"), ("**open", "<p>**open</p>"), ("*a **b*", "<p>*a *<em>b</em></p>"), ("*a**b*", "<p><em>a**b</em></p>"), ("**a*", "<p>*<em>a</em></p>"), ("*a**", "<p><em>a</em>*</p>"),
    ("*(**x**)*", "<p><em>(<strong>x</strong>)</em></p>"), ("*a `*` b*", "<p><em>a <code>*</code> b</em></p>"), ("_(b)_.", "<p><em>(b)</em>.</p>"),
    ("[a *b*](/x \"t\") ![pic](y.png)", "<p><a>a <em>b</em></a> <a>pic</a></p>"), ("[not](a b c)", "<p>[not](a b c)</p>"), ("*[a*](x)", "<p>*<a>a*</a></p>"), ("[x](f(1))", "<p><a>x</a></p>"),
    ("<https://a.org> <b>c</b> 1 < 2 & &amp; &#65;", "<p><a>https://a.org</a> <b>c</b> 1 &lt; 2 &amp; &amp; &#65;</p>"), ("a<br>b", "<p>a<br>b</p>"),
])
def test_rendered(text, want):
    assert flat(text) == want


def test_words_of_blocks():
    text = "# Load `x`\n\n    a = 1\n\n1. *Read* the file\n   with `pd`\n\n| a | b |\n|---|---|\n| 1 | don't |"
    assert language.tokens(text) == ["Load", "CTAG", "x", "CTAG", "CTAG", "a", "=", "1", "CTAG", "Read", "the", "file", "with", "CTAG", "pd", "CTAG", "a", "b", "1", "don't"]


def test_hostile_texts_end():
    for text in ("[" * 20_000, "*a " * 20_000, "> " * 3000 + "x", "- " * 3000 + "x", "`" * 5000 + " " + "` `` " * 5000, "_*" * 10_000, "<" * 20_000, "[a](" * 5000, "a|b\n" * 3000):
        assert render(text)
