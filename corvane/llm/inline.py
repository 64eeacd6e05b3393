"""Text as a reader sees it: inline markup of HTML, Markdown, wikis and LaTeX taken out."""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|td|th|tr|table|h[1-6]|pre|blockquote|dd|dt|dl|hr)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\[\]\n]*\])")
_NOTE = re.compile(r"\[\^[^\[\]\n]{1,40}\]")
_WIKI_LINK = re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]")
_EXTERNAL = re.compile(r"\[[a-z]+://[^\s\[\]]+ ([^\[\]\n]+)\]")
_CONF_LINK = re.compile(r"\[([^\[\]|\n]+)\|[^\[\]\n]+\]")
_MONO = re.compile(r"\{\{([^{}|\n]*)\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_MACRO = re.compile(r"\{[a-z]+(?::[^{}\n]*)?\}")
_HIDDEN = re.compile(r"\\(?:label|ref|eqref|pageref|cite[a-z]*|index|begin|end|usepackage|documentclass|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
_HREF = re.compile(r"\\href\{[^{}\n]*\}")
_COMMAND = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?")


def strip_inline(text: str) -> str:
    """``text`` without tags, comments, link targets, footnote marks, templates, macros and
    commands; entities are decoded. Emphasis marks are no words and stay. What a mark encloses is
    kept, so a run of words goes through it."""
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", _COMMENT.sub("", text)))
    if "&" in text:
        text = html.unescape(text)
    if "[" in text:
        text = _MD_LINK.sub(r"\1", _NOTE.sub("", _WIKI_LINK.sub(r"\1", text)))
        text = _CONF_LINK.sub(r"\1", _EXTERNAL.sub(r"\1", text))
    if "{" in text:
        text = _HIDDEN.sub("", text) if "\\" in text else text
        text = _HREF.sub("", text) if "\\href" in text else text
        text = _MACRO.sub("", _TEMPLATE.sub("", _MONO.sub(r"\1", text)))
    if "\\" in text:
        text = _COMMAND.sub("", text)
    return text
