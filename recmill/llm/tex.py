"""Reading typeset articles: the words of a whole source, and the prose that a reader of the article sees.

Handles LaTeX and plain TeX sources, any line ending, own macros that stand for words, and sources whose
macro files, includes or document end are missing. Works on whole texts.
"""

from __future__ import annotations

import re
import unicodedata

_ARG = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_DEF = re.compile(r"\\(?:newcommand|renewcommand|providecommand|def|gdef|edef|DeclareRobustCommand)\*?[ \t]*\{?[ \t]*\\([A-Za-z@]+)[ \t]*\}?[ \t]*((?:\[[^\]\n]*\]|#\d)*)[ \t]*\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")
_BODY = re.compile(r"\\[A-Za-z@]+[ \t]*|\\.|[{}~]")
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_LINE = re.compile(r"\r\n?")
_ACCENT = re.compile(r"\\(?:['`^\"~=.]|[uvHcdbrk](?![A-Za-z]))[ \t]*\{?[ \t]*\\?([A-Za-z])\}?")

# commands whose argument is not part of the running text
_SILENT = r"cite[a-z]*|ref|eqref|pageref|autoref|cref|label|input|include|subfile|bibliography|bibliographystyle|usepackage|documentclass|documentstyle|includegraphics|vspace|hspace|thanks|url|index|pagestyle|setcounter|setlength"
_OPTS = r"\*?[ \t]*(?:\[[^\]]*\][ \t]*)*"
_MATH = r"\$\$.*?\$\$|\$(?:[^$\\]|\\.)*\$|\\\[.*?\\\]|\\\(.*?\\\)"

# ---- the words of a whole source -------------------------------------------------------------------

_BREAK = re.compile(r"(?<=[^\W\d_])(?:\\-|-)[ \t]*\n[ \t]*(?:%+[ \t]*)?(?=[^\W\d_])|\\[-/]")
_NOISE = re.compile(rf"\\(?:{_SILENT}){_OPTS}{_ARG}|\\footnote{_OPTS}\{{[^{{}}]{{0,80}}\}}|\\(?:begin|end)[ \t]*\{{[^{{}}]*\}}(?:\[[^\]\n]*\])?|{_MATH}", re.S)
_COMMAND = re.compile(r"\\([A-Za-z@]+)\*?(?:[ \t]*\{\})?")
_WORD = re.compile("[a-z0-9]+")
# in other scripts than Latin an ideograph or kana is a word, and letters and digits make runs
_ANY_WORD = re.compile("[\u3040-\u30ff\u3400-\u9fff]|[^\\W_\u3040-\u30ff\u3400-\u9fff]+")


def macros(text: str) -> dict[str, str]:
    """The words that a source's own parameterless macros stand for."""
    if "\\def" not in text and "command" not in text and "\\gdef" not in text:
        return {}
    out = {}
    for m in _DEF.finditer(text):
        if not m[2]:
            body = m[3]
            for _ in range(2):  # a macro may use one that was defined before it
                body = re.sub(r"\\([A-Za-z@]+)", lambda x: out.get(x[1], x[0]), body)
            out.setdefault(m[1], _BODY.sub(" ", body).strip())
    return out


def source_words(text: str) -> list[str]:
    """All words of a source in order, comments and switched-off parts included, lower-case, without accents.

    Line-break hyphens, ligatures, widths and invisible characters are undone, own macros expanded;
    citations, references, formulas and short footnotes are left out.
    """
    own = macros(text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    if "\r" in text:
        text = _LINE.sub("\n", text)
    text = _BREAK.sub("", text)
    text = _ACCENT.sub(r"\1", text)
    text = _NOISE.sub(" ", text)
    text = _COMMAND.sub(lambda m: f" {own[m[1]]} " if m[1] in own else " ", text).lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return _ANY_WORD.findall(text)
    return _WORD.findall(text)


# ---- the prose a reader sees -------------------------------------------------------------------------

_COMMENT = re.compile(r"(?<!\\)%[^\n]*(?:\n[ \t]*|\Z)")
_OFF = re.compile(r"\\iffalse(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\Z)|\\begin[ \t]*\{(comment|verbatim|lstlisting|filecontents)\*?\}.*?(?:\\end[ \t]*\{\1\*?\}|\Z)", re.S)
_SWITCH = re.compile(r"\\newif[ \t]*\\if([A-Za-z]+)")
_START = re.compile(r"\\begin[ \t]*\{document\}")
_STOP = re.compile(r"\\end[ \t]*\{document\}|\\bye(?![A-Za-z])|\\end(?![A-Za-z]|[ \t]*\{)")
_APART = re.compile(
    rf"\\begin[ \t]*\{{(equation|align|alignat|gather|multline|eqnarray|displaymath|math|flalign|split|array|matrix|figure|table|tabular|tabularx|longtable|wrapfigure|algorithm|algorithmic|tikzpicture|picture|thebibliography|keywords)\*?\}}.*?(?:\\end[ \t]*\{{\1\*?\}}|\Z)"
    rf"|{_MATH}|\\(?:{_SILENT}|footnote|footnotetext|caption){_OPTS}(?:{_ARG})",
    re.S,
)
_HEADING = re.compile(rf"\\(?:(?:sub)*section|chapter|part|(?:sub)?paragraph|title|author|date|affiliation|address|email|centerline|centerline|pacs|keywords){_OPTS}{_ARG}|\\beginsection[^\n]*(?:\n(?![ \t]*\n)[^\n]+)*|\\magnification[^\n]*|\\(?:maketitle|tableofcontents|newpage|clearpage|item(?:\[[^\]]*\])?|par)(?![A-Za-z])|\\(?:begin|end)[ \t]*\{{[^{{}}]*\}}(?:\[[^\]\n]*\])?|\n[ \t]*\n")
_TIE = re.compile(r"\.(?=~|\\ |\\,)")
_SPACE = re.compile(r"\\[ ,;:!\n]|~|\\\\")
_CHARS = re.compile(r"[{}]|``|''|\\[-/]|\\(?=[%&#_$])")
_SENTENCE = re.compile(r"(?<![ (.~][A-Za-z])[.!?]+['\")\]]*(?=\s|\Z)|\n\n")
_LETTERS = re.compile(r"[^\W\d_]+")


def prose_sentences(text: str) -> list[str]:
    """The sentences of abstract, paragraphs, lists and quotations, as they read when typeset.

    Preamble, headings, formulas, citations, captions, footnotes, comments, switched-off parts and the
    bibliography are left out. Every sentence has a word.
    """
    if "\r" in text:
        text = _LINE.sub("\n", text)
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    text = _COMMENT.sub("", text)
    for name in {m[1] for m in _SWITCH.finditer(text)}:  # own switches that are never turned on
        if not re.search(rf"\\{name}true(?![A-Za-z])", text):
            text = re.sub(rf"(?<!\\newif)(?<!\\newif )\\if{name}(?![A-Za-z]).*?(?:\\fi(?![A-Za-z])|\\else(?![A-Za-z])|\Z)", "", text, flags=re.S)
    text = _OFF.sub("", text)
    own = macros(text)
    start = _START.search(text)
    if start:
        text = text[start.end() :]
    stop = _STOP.search(text)
    if stop:
        text = text[: stop.start()]
    text = _DEF.sub("\n\n", text)
    text = _TIE.sub("", text)
    text = _APART.sub(" ", text)
    text = _HEADING.sub("\n\n", text)
    text = _ACCENT.sub(r"\1", text)
    text = _CHARS.sub("", _SPACE.sub(" ", text))
    text = _COMMAND.sub(lambda m: own.get(m[1], "") + " ", text)
    return [s for s in _SENTENCE.split(text) if s and _LETTERS.search(s)]
