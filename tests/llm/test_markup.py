import pytest

from strandline.llm import markup as mk

PLAIN = [
    'Traceback: File "<stdin>", line 44, in <module>',
    "It holds while tier < worker and worker > 0, so tier <= limit is safe.",
    "Arrows like -> and => and <- appear in logs, as does <unknown>.",
    "Q&A with the R&D team; a & b are bit masks, a && b is logical.",
    "The check reads retry == hub || retry != None, 3 * 4 * 5 = 60.",
    "A placeholder such as {{ contract_outline }} is filled in by the template.",
    "The signature is Map<String, List<Tracer>> and the default is Optional<Adapter>.",
    r"On Windows the file is C:\temp\new\embedding.txt and the regex is \d+\s*allocator.",
    "Pass *args and **kwargs through; __init__ and __shard__ stay untouched.",
    "In the shell, if [[ -n $HOME && -f billing/index.py ]] then the hook runs.",
    "See it (see [2] and ticket[quota])",
    "The plan costs $5 a month, $50 a year, see ticket #3948.",
    "Run it with --merge=<file> or MERGE_DOCSTRING=1.",
    "Steps:\n- one\n- two\n1. three\n* four",
    "", "   ", None,
]
KIND = {
    "html": ["<p>a</p>", "a<br>b", "x &amp; y", "it&#39;s", "<!-- TODO -->", "<pre><code># x\n**y** [[z]]\n</code></pre>", '<B>b</B> <span style="x">y</span>', "<script>var a = '[[b]]';</script>"],
    "markdown": ["# Head", "Head\n====\n\ntext", "a **b** c", "an *em* word", "[a](b.md)", "![a](b.png)", "[a][ref]\n\n[ref]: x.md", "|a|b|\n|---|---|\n|1|2|", "> said", "- [x] done", "a `b` c", r"write `\section{x}` or `[[y]]`", "```html\n<div>&amp;</div>\n```", "~~~\n# x\n[[y]]\n~~~", "~~gone~~", "  ## padded\r\n"],
    "wiki": ["== Head ==", "see [[Page|label]]", "'''bold''' and ''em''", "{{Note|text}}", "{{Infobox x\n| a = b\n}}", '{| class="x"\n|-\n| a || b\n|}', "#REDIRECT [[X]]", "[[Category:Y]]"],
    "latex": [r"\section{A} b", r"as \emph{x}", "\\begin{itemize}\n\\item a\n\\end{itemize}", r"$\lambda_{i} \geq 0$", r"$$\sum_k w_k$$", r"\(x^2\)", r"\[ x \]", "\\begin{verbatim}\n# a\n<b>\n[[c]]\n\\end{verbatim}", r"a\footnote{b}"],
}


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert mk.parse(text)[0] == []


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, ts in KIND.items() for t in ts])
def test_kinds(kind, text):
    assert mk.parse(text)[0] == [kind]
    for plain in PLAIN[:13]:
        assert mk.parse(f"{plain}\n\n{text}\n\n{plain}")[0] == [kind], plain


def test_structure_is_kept():
    text = mk.parse("<h2>Top</h2><ul><li>one</li><li>two</li></ul><pre>x &lt; y</pre><table><tr><td>a</td><td>b</td></tr></table>")[1]
    assert "## Top" in text and "- one" in text and "```\nx < y\n```" in text and "| a | b" in text
    assert mk.parse("== Top ==\n'''b''' [[P|l]]")[1] == "## Top\nb l"
    assert mk.parse(r"\subsection{Top} a \emph{b} \(x^2\)")[1] == "## Top\n a b $x^2$"
    assert mk.parse("Top\n===\n\n> **q** [l](u)\n\n```py\na * b * c\n```")[1] == "# Top\n\nq l\n\n```\na * b * c\n```"


NAV = "<div><nav>" + "".join(f"<span>Link {i}</span> " for i in range(12)) + "{}</nav></div>"
BODY = "".join(f"<p>This is a sentence of the article, long enough to be read; it has commas, and ends here, after which another begins that says as little, but says it at length. {i}</p>" for i in range(8))


def cleaned(spark, *texts):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")
    return {r["id"]: r for r in mk.clean(df, "id", "text").collect()}


def test_tag_path_ratios_drop_boilerplate(spark):
    got = cleaned(spark, NAV.format("") + "<div><article>" + BODY + "</article></div>", *[f"<p>Another sentence that is about as long as those above, and no less dull. {i}</p>" for i in range(5)], "<div><nav><a>Home</a></nav></div><p>A <b>b</b> c.</p>")
    assert "Link 5" not in got["0"].text and "a sentence of the article" in got["0"].text
    # Short documents are judged by what the paths hold elsewhere.
    assert "Home" not in got["6"].text and "A b c." in got["6"].text
    assert "Link" in mk.parse("<div><span>Link</span></div>")[1]


def test_kinds_of_nodes_that_are_left_out(spark):
    r = cleaned(spark, NAV.format("<span>[[Q|r]]</span> <span>**b** x</span><span>\\emph{y}</span>") + "<div><article>" + BODY + "</article></div>")["0"]
    assert r.kinds == list(mk.KINDS) and "Link" not in r.text and "[[" not in r.text


@pytest.mark.parametrize("depth", [1, 4, 50, 3000])
def test_any_depth(depth):
    assert mk.parse("a " + "{{A|" * depth + "x" + "}}" * depth + " b") == (["wiki"], "a x b")
    assert mk.parse("a " + "\\textbf{" * depth + "x" + "}" * depth + " b") == (["latex"], "a x b")
    assert mk.parse("a $x^2$ " + "\\frac{" * depth + "x" + "}{y}" * depth + " b")[1].endswith("x" + "}{y}" * depth + "$ b")


def test_templates():
    assert mk.parse("{{Note|a|k=b {{C|d = e}} f}} g")[1] == "a b e f g"
    assert mk.parse("{{A|{x} }} and {{A|y}}")[1] == "{{A|{x} }} and y"
    assert mk.parse("{{ no_template }} {{A|y")[0] == []


def test_formulas_outside_dollars_are_kept():
    assert mk.parse(r"We need \alpha \leq \beta for this bound.") == (["latex"], r"We need $\alpha \leq \beta$ for this bound.")
    assert mk.parse(r"\section{A} It is \frac{1}{\sqrt{n}} + \sum_{i} x_i, see \cite{knuth} and Section~\ref{sec:b}.")[1] == "# A\n It is $\\frac{1}{\\sqrt{n}} + \\sum_{i}$ x_i, see [knuth] and Section sec:b."


def test_every_character_of_the_text_stays():
    private = "".join(map(chr, range(0xE000, 0xE010)))
    assert mk.parse(f"a {private} `b` c")[1] == f"a {private} `b` c"
    assert mk.parse("a \ue0000; `b`")[1] == "a \ue0000; `b`"


@pytest.mark.parametrize("bit", ["<pre>", "<code x>", "<!--", "<!DOCTYPE ", "$$ a ", "\\[", "\\( a", "`a ``", "``` ", "\\verb|", "<nowiki>", "{{A|", "{{", "}}", "\\textbf{", "\\frac{", "\\alpha_{", "[[", "$a ", "<a \"", "**", "''", "~~", "<div>", "</div>"])
def test_openers_without_end_take_linear_time(bit):
    import time

    def took(n):
        t = time.process_time()
        mk.parse("x " + bit * n)
        return time.process_time() - t

    took(100)
    assert took(16_000) < 8 * 4 * max(took(4_000), 0.02)


def test_table(spark):
    df = spark.createDataFrame([("a", "<b>x</b>", "m"), ("a", "<b>x</b>", "m"), ("b", None, "m"), (None, "# h", "m"), ("c", "x" * 200_000 + "\n" + "<" * 5000 + "*" * 3000 + "`" * 3000 + "{{" * 2000 + "$" * 999, "m")], "id string, text string, markup string")
    got = sorted(((r.id, r.markup) for r in mk.kinds(df, "id", "text").collect()), key=str)
    assert ("a", "html") in got and (None, "markdown") in got and not any(i == "b" for i, _ in got)
    assert mk.clean(df, "id", "text").count() == 4 and mk.clean(df.where("false"), "id", "text").count() == 0
