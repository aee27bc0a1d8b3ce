"""Markup of several kinds in text: which kinds there are, and the text without them.

One pass over a text takes out what is code or a formula (nothing inside counts for another kind), then reads HTML, wiki, LaTeX
and Markdown from what is left. Clean text keeps structure in one plain notation: ``#`` headings, ``-`` and numbered items, fenced
code, ``$`` formulas, cells between bars.

HTML content is chosen by tag-path ratios: text length and punctuation are summed for each path of block tags over all documents, so that
short documents are judged like long ones; the ratios are smoothed along each document, fused, and nodes of paths under a threshold are
left out, unless they are headings, items, cells or code. A node is all text between two block tags; inline tags only cut it into
the parts that are counted, so that no word is lost for being bold, and a row of links is not taken for a sentence. The kinds are those of the whole
text, nodes left out included.

Every step is one pass: openers without an end are looked for once for each kind of end, and templates, commands and braces are
nested by a stack, to any depth.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import spread

KINDS = ("html", "markdown", "wiki", "latex")
#: Names of HTML elements; other words between angle brackets are placeholders or types.
TAGS = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main mark meta meter nav nobr noscript object ol "
    "optgroup option p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time "
    "title tr track tt u ul var video wbr"
).split()
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul h1 h2 h3 h4 h5 h6 title".split())
KEPT = frozenset("h1 h2 h3 h4 h5 h6 li dt dd td th pre code title caption summary".split())
#: Elements that ordinary words between angle brackets may mean as well; they count only with attributes or a closing tag.
DOUBTFUL = frozenset("area base button canvas caption center cite code data del details dialog form frame head header input ins label legend link main map mark meta object option output param picture progress section select source style summary table template time title track var video".split())
_NAME = "|".join(sorted(TAGS, key=len, reverse=True))
TAG = re.compile(rf"<(/?)({_NAME})(\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?\s*(/?)>", re.I)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
COMMENT = r"<!--.*?(?:-->|\Z)|<!DOCTYPE[^>]*>"
FORMULA_SIGN = re.compile(r"[\\^{}=]|_\w|^[A-Za-z]$")

#: What begins something that is taken out first; where several begin at one place the first named counts. See _taken() for how each ends.
OPEN = re.compile(
    r"(?P<fence>^[ \t]{0,3}(?P<marks>`{3,}|~{3,})[^\n]*\n)"
    r"|(?P<element><(?P<el>pre|code|script|style|samp|kbd|textarea|nowiki|syntaxhighlight|source)\b[^<>]*>)"
    r"|(?P<comment><!--)|(?P<doctype><!DOCTYPE)"
    r"|(?P<block>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|alltt|equation\*?|align\*?|gather\*?|multline\*?|displaymath|math|eqnarray\*?)\})"
    r"|(?P<verb>\\verb\*?(?P<bar>[|!+]))"
    r"|(?P<code>(?<!`)(?P<ticks>`{1,2})(?!`))"
    r"|(?P<display>\$\$|\\\[)|(?P<round>\\\()|(?P<dollar>(?<![\w\\$])\$(?=[^\s$]))",
    re.M | re.I,
)
CODE_ENVIRONMENT = re.compile(r"verbatim|lstlisting|minted|alltt", re.I)
WIKI_ELEMENTS = ("nowiki", "syntaxhighlight", "source")
DOLLAR_END = re.compile(r"(?<=[^\s\\])\$(?![\d\w])")
#: Stands for what was taken out. A lone surrogate is in no text that is UTF-8, so it can't be mistaken for the text's own.
HOLD = "\ud800"

MARKDOWN = {
    "atx": re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M),
    "setext": re.compile(r"^[ \t]{0,3}(?![|>*+#{\-=])(\S[^\n|]*)\n[ \t]{0,3}(={3,}|-{3,})[ \t]*$", re.M),
    "rule": re.compile(r"^[ \t]{0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M),
    "quote": re.compile(r"^[ \t]{0,3}>[ \t]?(?=[^\s>=])", re.M),
    "task": re.compile(r"^([ \t]*)[-*+][ \t]+\[[ xX]\][ \t]+", re.M),
    "image": re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]+\)"),
    "link": re.compile(r"(?<![\w!\]\\])\[([^\[\]\n]+)\]\((?:[^()\s]|\([^()\s]*\))+(?:[ \t]+\"[^\"\n]*\")?\)"),
    "reference": re.compile(r"(?<![\w!\]\[\\])\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"),
    "definition": re.compile(r"^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+(?:[ \t]+\"[^\"\n]*\")?", re.M),
    "auto": re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>"),
    "strong": re.compile(r"(?<![\w*\\(])\*\*(?=[^\s*])([^*\n]*[^\s*])\*\*(?!\*)"),
    "strong_": re.compile(r"(?<!\w)__(?=[^\s_])([^_\n]* [^_\n]*[^\s_])__(?!\w)"),
    "em": re.compile(r"(?<![\w*\\(/])\*(?=[^\s*])([^*\n]*[^\s*])\*(?![\w*])"),
    "strike": re.compile(r"(?<![~\w])~~(?=[^\s~])([^~\n]*[^\s~])~~(?!~)"),
}
WIKI = {
    "heading": re.compile(r"^[ \t]{0,3}(={2,6})[ \t]*([^=\n][^\n]*?[^=\n]|[^=\s])[ \t]*\1[ \t]*$", re.M),
    "link": re.compile(r"\[\[(?![\s\-!$])([^\[\]\n]+)\]\]"),
    "strong": re.compile(r"'''(?=[^\s'])([^\n]*?[^\s'])'''"),
    "em": re.compile(r"(?<!')''(?=[^\s'])([^'\n]*[^\s'])''(?!')"),
    "template": re.compile(r"\{\{(?=[^\s{}|])([A-Z#:][^{}]*|[^{}|\n]+\|[^{}]*)\}\}"),
    "table": re.compile(r"^[ \t]*\{\|", re.M),
    "directive": re.compile(r"^[ \t]*#REDIRECT\b:?|__(?:NO|FORCE)?TOC__|__NOEDITSECTION__", re.M | re.I),
}
#: LaTeX commands that stand for signs of formulas, and those that build formulas of their arguments.
MATH_SIGNS = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Phi Psi Omega "
    "leq geq neq le ge ne approx equiv sim propto sum prod int infty cdot times div pm mp in notin subset subseteq cup cap to rightarrow leftarrow Rightarrow mapsto forall exists partial nabla"
).split()
MATH_BUILDERS = "frac dfrac tfrac binom sqrt mathbb mathcal mathrm mathbf mathit mathsf hat bar vec tilde overline underline operatorname".split()
_SIGN = "|".join(sorted(MATH_SIGNS, key=len, reverse=True))
LATEX = {
    "command": re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{"),
    "bare": re.compile(
        r"(?<![\w:\\/.])\\(item|par|noindent|maketitle|tableofcontents|centering|hline|newpage|clearpage|bigskip|medskip|smallskip|ldots|dots|LaTeX|TeX|appendix|footnotesize|small|large|bfseries|itshape|toprule|midrule|bottomrule"
        r"|alpha|beta|gamma|delta|epsilon|lambda|mu|sigma|theta|omega|pi|leq|geq|sum|int|infty|cdot|times|in|to)(?![A-Za-z\\])"
    ),
    "environment": re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}"),
}
MATH = re.compile(rf"(?<![\w:\\/.])\\(?:(?:{_SIGN})(?![A-Za-z\\])|(?:{'|'.join(MATH_BUILDERS)})\*?(?=[\[{{]))")
#: Within a formula another command may follow at once or after blanks.
MATH_NEXT = re.compile(rf"[ \t]*(?:[=<>+\-*/,][ \t]*)?\\(?:(?:{_SIGN})(?![A-Za-z\\])|(?:{'|'.join(MATH_BUILDERS)})\*?(?=[\[{{]))")
BRACE = re.compile(r"\\[{}\\]|[{}]")
GROUP = re.compile(r"\\[{}\\]|(?P<command>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{)|[{}]")
TEMPLATE_MARK = re.compile(r"\{\{(?!\{)|\}\}")
#: What a text must hold for a pattern to match at all; looking for that costs little.
NEEDED = {
    "atx": "#", "setext": ("===", "---"), "rule": "--", "quote": ">", "task": "] ", "image": "![", "link": "](", "reference": "][", "definition": "]:", "auto": "<",
    "strong": "**", "strong_": "__", "em": "*", "strike": "~~",
}
TAKEN_SIGN = re.compile(r"[`<\\$]|~~~")
#: Block tags of a path that are told apart, counted from the text: the names being a fixed list, there are at most about 100,000 such paths.
PATH_TAGS = 3
#: A node is content if its fused ratio reaches this part of the mean of all, or if it is this long by itself.
CONTENT_SHARE, LONG_TEXT = 0.1, 80
PUNCTUATION = frozenset(".,;:!?。，；：")


class PathRatios:
    """What is known of each path of block tags: mean length and mean count of punctuation of the parts of its nodes, over all documents."""

    def __init__(self, sums: dict[str, tuple[int, int, int]]):
        """``sums``: for each path the number of parts, their characters and their punctuation marks."""
        self.mean = {p: (chars / n, marks / n) for p, (n, chars, marks) in sums.items() if n}
        fused = [(x * (1.0 + m), sums[p][1]) for p, (x, m) in self.mean.items()]
        total = sum(n for _, n in fused)
        # The geometric mean, each path by its characters: very long paths must not lift the threshold over everything else, nor many short ones lower it.
        self.threshold = CONTENT_SHARE * float(np.exp(sum(n * np.log(f + 1e-9) for f, n in fused) / total)) if total else 0.0

    def content(self, nodes: list[tuple[str, list[str]]]) -> np.ndarray:
        """Which nodes (path, parts) of one document are content.

        Both ratios are smoothed along the document by a Gaussian of half a node's width and multiplied.
        """
        if not nodes:
            return np.ones(0, bool)
        length, marks = (np.array([self.mean.get(p, (max(map(len, t), default=0), 0.0))[i] for p, t in nodes]) for i in (0, 1))
        kernel = np.exp(-2.0 * np.arange(-2, 3) ** 2)
        kernel /= kernel.sum()
        smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")
        return (smooth(length) * (1.0 + smooth(marks)) >= self.threshold) | (np.array([max(map(len, t), default=0) for _, t in nodes]) >= LONG_TEXT)


def unnest_templates(s: str) -> tuple[str, bool]:
    """The text with each wiki template replaced by its arguments, and whether there was one; innermost first, in one pass.

    A template begins with a name in capitals, ``#`` or ``:``, or has a bar after its name; anything else in double braces is left.
    """
    # A level holds pieces: text of its own, or (as lists) what an inner template came to.
    levels: list[list] = [[]]
    found, at = False, 0
    for m in TEMPLATE_MARK.finditer(s):
        levels[-1].append(s[at : m.start()])
        at = m.end()
        if m[0] == "{{":
            levels.append([])
        elif len(levels) == 1:
            levels[-1].append("}}")
        else:
            level = levels.pop()
            args = _arguments(level)
            if args is None:
                levels[-1] += ["{{", level, "}}"]
            else:
                found = True
                levels[-1].append(args)
    while len(levels) > 1:
        rest = levels.pop()
        levels[-1] += ["{{", rest]
    levels[0].append(s[at:])
    return ("".join(_flat(levels[0])), True) if found else (s, False)


def _arguments(level: list) -> list | None:
    """What the arguments of a template come to, between blanks; None if the pieces are no template's."""
    own = [x for x in level if isinstance(x, str)]
    head = own[0] if own else ""
    if not head or head[0].isspace() or head[0] in "{}|" or any("{" in x or "}" in x for x in own):
        return None
    name = head.split("|", 1)[0]
    if not (head[0] in "#:" or "A" <= head[0] <= "Z") and ("\n" in name or not any("|" in x for x in own) or ("|" not in head and any("\n" in x.split("|", 1)[0] for x in own))):
        return None
    args: list[list] = [[]]
    for x in level:
        if not isinstance(x, str):
            args[-1].append(x)
            continue
        first, *more = x.split("|")
        args[-1].append(first)
        args += [[y] for y in more]
    out: list = []
    for arg in args[1:]:
        for i, x in enumerate(arg):
            if isinstance(x, str) and "=" in x:
                arg = [x.split("=", 1)[1], *arg[i + 1 :]]
                break
        if isinstance(arg[0], str):
            arg[0] = arg[0].lstrip()
        if isinstance(arg[-1], str):
            arg[-1] = arg[-1].rstrip()
        out += [" ", *arg] if out else arg
    return out


def _flat(pieces: list) -> Iterator[str]:
    stack = [iter(pieces)]
    while stack:
        for x in stack[-1]:
            if isinstance(x, str):
                yield x
            else:
                stack.append(iter(x))
                break
        else:
            stack.pop()


def unwrap_commands(s: str) -> str:
    """The text with ``\\command{...}`` replaced by what is between the braces, to any depth; groups right behind follow after a blank.

    Braces of no command stay, and so does a command that never ends.
    """
    out: list[str] = []
    stack: list[tuple[int, bool]] = []  # place of the opener in out, whether a command's
    at, ended = 0, -1
    for m in GROUP.finditer(s):
        out.append(s[at : m.start()])
        if m["command"] or m[0] == "{":
            more = m[0] == "{" and ended == m.start()
            out.append(" " if more else m[0])
            stack.append((len(out) - 1, bool(m["command"]) or more))
        elif m[0] == "}" and stack:
            i, command = stack.pop()
            if command:
                out[i] = "" if out[i] != " " else " "
                ended = m.end()
            else:
                out.append("}")
        else:
            out.append(m[0])
        at = m.end()
    for i, command in stack:
        if command and out[i] == " ":
            out[i] = "{"
    return "".join(out) + s[at:]


class Parsed:
    """The kinds of markup in a text, and its clean text; without ``ratios`` all its nodes are content."""

    def __init__(self, content: str | None, ratios: PathRatios | None = None):
        self.kinds: set[str] = set()
        self.held: list[str] = []
        self.ratios = ratios
        #: Path and parts of each node of text between block tags.
        self.nodes: list[tuple[str, list[str]]] = []
        self.text = ""
        if not content or not content.strip():
            return
        s = content.replace("\r\n", "\n").replace("\r", "\n")
        if TAKEN_SIGN.search(s):
            s = self._taken(s)
        whole, s = self._html(s)
        # The kinds are those of the whole text; what is read again without the nodes left out gives the clean text only.
        clean = self._rest(whole)
        if s != whole:
            kinds = set(self.kinds)
            clean = self._rest(s)
            self.kinds = kinds
        s = clean
        # What was taken out may itself hold such marks of earlier ones.
        for i, h in enumerate(self.held):
            if HOLD in h:
                self.held[i] = self._put_back(h)
        s = self._put_back(s)
        s = re.sub(r"[ \t]+$", "", s, flags=re.M)
        self.text = re.sub(r"\n{3,}", "\n\n", s).strip()

    def _put_back(self, s: str) -> str:
        return re.sub(HOLD + r"(\d+);", lambda m: self.held[int(m[1])], s)

    def _rest(self, s: str) -> str:
        return self._markdown(self._latex(self._wiki(s)))

    def _hold(self, clean: str) -> str:
        self.held.append(clean)
        return f"{HOLD}{len(self.held) - 1};"

    def _taken(self, s: str) -> str:
        """The text without code, comments and formulas, which are held. An opener whose end is not found is text."""
        out: list[str] = []
        missing: dict[str, int] = {}  # kinds of ends, and the place from which there is none
        at = 0

        def end(kind: str, pattern: re.Pattern, a: int, b: int | None = None) -> re.Match | None:
            if missing.get(kind, len(s) + 1) <= a:
                return None
            m = pattern.search(s, a, len(s) if b is None else b)
            if m is None and b is None:
                missing[kind] = a
            return m

        def in_line(kind: str, pattern: re.Pattern, a: int) -> re.Match | None:
            # The lack of an end holds to the end of the line only.
            known = missing.get(kind)
            if known is not None and known <= a and "\n" not in s[known:a]:
                return None
            stop = s.find("\n", a)
            m = pattern.search(s, a, len(s) if stop < 0 else stop)
            if m is None:
                missing[kind] = a
            return m

        while m := OPEN.search(s, at):
            held: str | None = None
            a = z = m.end()
            if m["fence"]:
                e = end("fence" + m["marks"], _fence_end(m["marks"]), a)
                held, z = "\n```\n" + s[a : e.start() if e else len(s)].rstrip("\n") + "\n```\n", e.end() if e else len(s)
                self.kinds.add("markdown")
            elif m["element"]:
                el = m["el"].lower()
                if e := end(el, _element_end(el), a):
                    z = e.end()
                    self.kinds.add("wiki" if el in WIKI_ELEMENTS else "html")
                    held = self._code(el, s[a : e.start()])
            elif m["comment"]:
                e = s.find("-->", a)
                z = e + 3 if e >= 0 else len(s)
                self.kinds.add("html")
                held = ""
            elif m["doctype"]:
                e = end("doctype", _DOCTYPE_END, a)
                if e:
                    z = e.end()
                    self.kinds.add("html")
                    held = ""
            elif m["block"]:
                e = end(m["env"], _environment_end(m["env"]), a)
                body, z = s[a : e.start() if e else len(s)], e.end() if e else len(s)
                self.kinds.add("latex")
                held = "\n```\n" + body.strip("\n") + "\n```\n" if CODE_ENVIRONMENT.match(m["env"]) else f"\n$$\n{_LABEL.sub('', body).strip()}\n$$\n"
            elif m["verb"]:
                if e := in_line(m["bar"], _BARS[m["bar"]], a):
                    z = e.end()
                    self.kinds.add("latex")
                    held = f"`{s[a : e.start()]}`"
            elif m["code"]:
                if e := in_line(m["ticks"], _TICKS[len(m["ticks"])], a):
                    z = e.end()
                    self.kinds.add("markdown")
                    held = f"`{s[a : e.start()].strip()}`"
            elif m["display"]:
                e = end(m["display"], _DISPLAY[m["display"]], a + 1)
                if e:
                    z = e.end()
                    self.kinds.add("latex")
                    held = f"\n$$\n{_LABEL.sub('', s[a : e.start()]).strip()}\n$$\n"
            elif m["round"]:
                e = in_line("\\(", _ROUND_END, a + 1)
                if e:
                    z = e.end()
                    self.kinds.add("latex")
                    held = f"${_LABEL.sub('', s[a : e.start()]).strip()}$"
            else:
                # The formula ends at the next dollar of the line or not at all.
                e = s.find("$", a)
                if e >= 0 and "\n" not in s[a:e] and DOLLAR_END.match(s, e):
                    if FORMULA_SIGN.search(s[a:e]):
                        self.kinds.add("latex")
                        held = f"${_LABEL.sub('', s[a:e]).strip()}$"
                    z = e + 1
            if held is None:  # no end, or no formula: text
                z = max(z, m.start() + 1) if m["dollar"] and z > a else m.start() + 1
                out.append(s[at:z])
            else:
                out += [s[at : m.start()], self._hold(held) if held else " "]
            at = z
        return "".join(out) + s[at:]

    def _code(self, el: str, body: str) -> str:
        """What the element's content becomes; "" for nothing."""
        if el in ("script", "style"):
            return ""
        if el in WIKI_ELEMENTS:
            return body
        code = html.unescape(re.sub(r"</?(?:code|span|b|i|em|strong)\b[^<>]*>", "", body, flags=re.I))
        return "\n```\n" + code.strip("\n") + "\n```\n" if el in ("pre", "textarea") or "\n" in code else f"`{code}`"

    def _html(self, s: str) -> tuple[str, str]:
        """The text without tags: all of it, and what tag-path ratios leave of it."""
        closing = {m[2].lower() for m in TAG.finditer(s) if m[1]}
        real = lambda m: bool(m[1] or m[3] or m[4] or m[2].lower() not in DOUBTFUL or m[2].lower() in closing)
        tags = [m for m in TAG.finditer(s) if real(m)]
        entity = any(html.unescape(e) != e for e in ENTITY.findall(s))
        if not tags and not entity:
            return s, s
        self.kinds.add("html")
        pieces: list[tuple[str, int, bool]] = []  # text or mark, number of its node (-1: none), whether always kept
        stack: list[str] = []
        blocks = 0  # changes with every block tag; texts between two of them are one node
        known = -1
        lists: list[int] = []
        at = 0
        for m in [*tags, None]:
            text = html.unescape(s[at : m.start() if m else len(s)])
            if text:
                always = not stack or any(t in KEPT for t in stack) or HOLD in text or not text.strip()
                if blocks != known:
                    known = blocks
                    self.nodes.append(("/".join([t for t in stack if t in BLOCK][-PATH_TAGS:]), []))
                if text.strip():
                    self.nodes[-1][1].append(text.strip())
                pieces.append((text, len(self.nodes) - 1, always))
            if m is None:
                break
            at = m.end()
            name, close = m[2].lower(), bool(m[1])
            blocks += name in BLOCK
            if not close:
                if name[0] == "h" and name[1:].isdigit():
                    pieces.append(("\n\n" + self._hold("#" * int(name[1:]) + " "), -1, True))
                elif name in ("ul", "ol"):
                    lists.append(1 if name == "ol" else 0)
                    pieces.append(("\n", -1, True))
                elif name == "li":
                    if lists and lists[-1]:
                        pieces.append((f"\n{'  ' * (len(lists) - 1)}{lists[-1]}. ", -1, True))
                        lists[-1] += 1
                    else:
                        pieces.append((f"\n{'  ' * max(0, len(lists) - 1)}- ", -1, True))
                elif name in ("td", "th"):
                    pieces.append((" | ", -1, True))
                elif name == "img" and (alt := re.search(r"alt\s*=\s*[\"']([^\"']*)", m[3] or "", re.I)):
                    pieces.append((alt[1], -1, True))
                elif name == "br":
                    pieces.append(("\n", -1, True))
                elif name in BLOCK:
                    pieces.append(("\n" if name in ("tr", "dt", "dd") else "\n\n", -1, True))
                if name not in VOID and not m[4]:
                    stack.append(name)
            else:
                if name in stack:
                    while stack.pop() != name:
                        pass
                if name in ("ul", "ol") and lists:
                    lists.pop()
                if name in BLOCK:
                    pieces.append(("\n" if name in ("li", "tr", "dt", "dd") else "\n\n", -1, True))
        whole = "".join(t for t, _, _ in pieces)
        if self.ratios is None:
            return whole, whole
        content = self.ratios.content(self.nodes)
        return whole, "".join(t for t, i, always in pieces if always or i < 0 or content[i])

    def _wiki(self, s: str) -> str:
        before = s
        if not any(x in s for x in ("==", "[[", "''", "{{", "{|", "#", "__")):
            return s
        if WIKI["directive"].search(s):
            s = WIKI["directive"].sub("", s)
            self.kinds.add("wiki")
        if "{{" in s:
            s, _ = unnest_templates(s)
        if WIKI["table"].search(s):
            self.kinds.add("wiki")
            s = re.sub(r"^[ \t]*(?:\{\|[^\n]*|\|\}|\|-[^\n]*)$", "", s, flags=re.M)
            s = re.sub(r"^[ \t]*[|!][ \t]?(?=\S)", "| ", s, flags=re.M)
            s = re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", " | ", s)
        s = WIKI["heading"].sub(lambda m: self._hold("#" * len(m[1]) + " ") + m[2], s)
        s = WIKI["link"].sub(lambda m: m[1].rsplit("|", 1)[-1] if not m[1].lower().startswith("category:") else "", s)
        s = WIKI["strong"].sub(r"\1", s)
        s = WIKI["em"].sub(r"\1", s)
        if s != before:
            self.kinds.add("wiki")
        return s

    def _latex(self, s: str) -> str:
        if "\\" not in s or not any(p.search(s) for p in LATEX.values()):
            return s
        self.kinds.add("latex")
        level = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5, "title": 1}
        s = re.sub(r"\\(part|chapter|(?:sub)*section|paragraph|subparagraph|title)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", lambda m: "\n" + self._hold("#" * level[m[1]] + " ") + m[2] + "\n", s)
        s = re.sub(r"\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: "- " + (m[1] + " " if m[1] else ""), s)
        s = re.sub(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\{[^{}]*\}|\[[^\]]*\])*", "", s)
        s = re.sub(r"\\(?:label|usepackage|documentclass|input|include|bibliography(?:style)?)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", "", s)
        s = re.sub(r"~(?=\\(?:eq|page)?ref\b|~?\\cite)", " ", s)
        s = re.sub(r"\\cite[tp]?\*?(?:\[[^\]\n]*\])*\{([^{}]*)\}", r"[\1]", s)
        s = unwrap_commands(self._formulas(s))
        s = LATEX["bare"].sub("", s)
        s = re.sub(r"[ \t]*\\\\[ \t]*$", "", s, flags=re.M)
        return re.sub(r"\\([_&%#${}])", r"\1", s)

    def _formulas(self, s: str) -> str:
        """The text with formulas outside dollars held: runs of commands of mathematics with their arguments, indices and exponents."""
        if not MATH.search(s):
            return s
        closing: dict[int, int] = {}
        opened: list[int] = []
        for m in BRACE.finditer(s):
            if m[0] == "{":
                opened.append(m.start())
            elif m[0] == "}" and opened:
                closing[opened.pop()] = m.end()

        def arguments(i: int) -> int:
            while i < len(s):
                if s[i] == "[" and (e := s.find("]", i, i + 40)) > 0 and s.startswith("{", e + 1):
                    i = e + 1
                elif s[i] == "{" and i in closing:
                    i = closing[i]
                elif s[i] in "_^" and i + 1 < len(s) and s[i + 1] == "{" and i + 1 in closing:
                    i = closing[i + 1]
                elif s[i] in "_^" and i + 1 < len(s) and s[i + 1].isalnum():
                    i += 2
                else:
                    break
            return i

        out: list[str] = []
        at = 0
        while m := MATH.search(s, at):
            z = arguments(m.end())
            while n := MATH_NEXT.match(s, z):
                z = arguments(n.end())
            out += [s[at : m.start()], self._hold(f"${s[m.start() : z]}$")]
            at = z
        return "".join(out) + s[at:]

    def _markdown(self, s: str) -> str:
        found = False

        def sub(name: str, to, s: str) -> str:
            nonlocal found
            need = NEEDED[name]
            if need not in s if isinstance(need, str) else not any(x in s for x in need):
                return s
            out, n = MARKDOWN[name].subn(to, s)
            found |= n > 0
            return out

        # Headings of other kinds are held, so that every ``#`` line here is Markdown's own.
        s = sub("atx", lambda m: m[1] + " " + m[2], s)
        s = sub("setext", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], s)
        s = sub("rule", "", s)
        s = sub("quote", "", s)
        s = sub("task", r"\1- ", s)
        s = sub("image", r"\1", s)
        s = sub("link", r"\1", s)
        s = sub("reference", r"\1", s)
        s = sub("definition", "", s)
        s = sub("auto", r"\1", s)
        for name in ("strong", "strong_", "em", "strike"):
            s = sub(name, r"\1", s)
        s = re.sub(r"^[ \t]*(?:\*[ \t]*){3,}$", "", s, flags=re.M)
        if found:
            self.kinds.add("markdown")
        return s


@functools.lru_cache(maxsize=512)
def _fence_end(marks: str) -> re.Pattern:
    return re.compile(rf"^[ \t]{{0,3}}{marks}[`~]*[ \t]*$", re.M)


@functools.lru_cache(maxsize=64)
def _element_end(el: str) -> re.Pattern:
    return re.compile(rf"</{el}\s*>", re.I)


@functools.lru_cache(maxsize=64)
def _environment_end(env: str) -> re.Pattern:
    return re.compile(rf"\\end\{{{re.escape(env)}\}}", re.I)


_DOCTYPE_END, _ROUND_END, _LABEL = re.compile(">"), re.compile(r"\\\)"), re.compile(r"\\label\{[^}]*\}")
_BARS = {c: re.compile(re.escape(c)) for c in "|!+"}
_TICKS = {n: re.compile(rf"(?<=[^`\n])`{{{n}}}(?!`)") for n in (1, 2)}
_DISPLAY = {"$$": re.compile(r"\$\$"), "\\[": re.compile(r"\\\]")}


def parse(content: str | None, ratios: PathRatios | None = None) -> tuple[list[str], str]:
    """Kinds of markup in order of KINDS, and clean text; none and "" for null and blank content."""
    p = Parsed(content, ratios)
    return [k for k in KINDS if k in p.kinds], p.text


def path_ratios(docs: DataFrame, text_col: str) -> PathRatios:
    """The ratios of all paths in all documents; rows that are repeated count as often as they are there.

    Sums for each path are added up before they are shuffled. What reaches the driver is one row for each path of at most ``PATH_TAGS`` block
    tags of a fixed list, whatever the number of documents.
    """

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums: dict[str, list[int]] = {}
            for t in pdf["text"]:
                for p, parts in Parsed(t).nodes:
                    s = sums.setdefault(p, [0, 0, 0])
                    s[0] += len(parts)
                    s[1] += sum(map(len, parts))
                    s[2] += sum(c in PUNCTUATION for x in parts for c in x)
            yield pd.DataFrame([(p, *s) for p, s in sums.items()], columns=["path", "n", "chars", "marks"])

    tagged = docs.select(F.col(text_col).alias("text")).where(F.col("text").rlike(r"<[/A-Za-z]"))
    each = spread(tagged).mapInPandas(paths, "path string, n long, chars long, marks long").groupBy("path").agg(*[F.sum(c).alias(c) for c in ("n", "chars", "marks")])
    return PathRatios({r["path"]: (r["n"], r["chars"], r["marks"]) for r in each.collect()})


def clean(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, kinds, text``: the kinds of markup found in each row's content and its clean text; rows that agree in all three are one.

    Null and blank content has no kinds and empty text. Other columns are not read. Content is read twice where it holds tags, once for the
    ratios of all paths and once for the text, and never shuffled; what is shuffled to make rows distinct is the result.
    """
    return _read(docs, id_col, text_col, path_ratios(docs, text_col)).distinct()


def _read(docs: DataFrame, id_col: str, text_col: str, ratios: PathRatios | None) -> DataFrame:
    @F.pandas_udf("struct<kinds array<string>, text string>")
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t, ratios) for t in texts], columns=["kinds", "text"])

    # Named as not deterministic, so that no filter on its result is pushed below the exchange, where it would be run a second time.
    return spread(docs.select(id_col, text_col)).select(id_col, read.asNondeterministic()(text_col).alias("__p")).select(id_col, "__p.kinds", "__p.text")


def kinds(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col, markup``: one row for each item and kind of markup in its content."""
    return _read(docs, id_col, text_col, None).select(id_col, F.explode("kinds").alias("markup")).distinct()
