"""Comment and string lexing as column expressions.

Both lexers are regular languages, so that one leftmost-first alternation cuts a text into
comments, strings and plain stretches; the tokens are then rewritten by kind and joined.
There are two of them because they test in different orders: the scanner looks for comments
before quotes and for line comments first, the stripper for quotes first and for block
comments before line comments.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.languages import LANGUAGES, Language, pick

# \x01 stands for a comment or string, \x02 for a newline that an escape swallows, \x03 for
# the end of a token that began on an earlier line.
_STRINGS = "|".join(rf"{q}(?:\\[\s\S]|[^{q}\\])*+(?:{q}|\\?\z)" for q in "\"'`")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once; within the functions of arrays an expression is
    evaluated wherever and as often as it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block(x: Language) -> str | None:
    return x.block and rf"{re.escape(x.block[0])}[\s\S]*?(?:{re.escape(x.block[1])}|\z)"


def _plain(x: Language, more: str = "") -> str:
    """Stretches in which no token can start, then any single character."""
    starts = "".join(dict.fromkeys("\"'`" + (x.line or "")[:1] + (x.block[0][:1] if x.block else "") + more))
    return rf"[^{re.escape(starts)}]++|[\s\S]"


def scanner_pattern(x: Language) -> str:
    return "|".join(p for p in (x.line and re.escape(x.line) + r"[^\n]*+", _block(x), _STRINGS, _plain(x)) if p)


def _tokens(content: Column, ext: Column, pattern, default: str, languages: Sequence[Language]) -> Column:
    clean = F.regexp_replace(content, "[\x01\x02\x03]", "")
    rx = F.coalesce(pick(ext, pattern, languages), F.lit(default))
    return F.regexp_extract_all(clean, rx, F.lit(0))


def scanner_tokens(content: Column, ext: Column, languages: Sequence[Language] = LANGUAGES) -> Column:
    """Tokens of a text; for unknown languages only strings are recognised."""
    return _tokens(content, ext, scanner_pattern, _STRINGS + r"|[^\"'`]++|[\s\S]", languages)


def _starts(token: Column, prefix: Column) -> Column:
    return F.coalesce(token.startswith(prefix), F.lit(False))


def _quoted(token: Column) -> Column:
    return token.substr(1, 1).isin('"', "'", "`")


def _rewritten(tokens: Column, line: Column, block: Column, comment, quoted) -> Column:
    # of strings and comments few span lines, and only these take regular expressions
    def by_kind(t: Column) -> Column:
        short = ~t.contains("\n")
        is_block, is_quoted = _starts(t, block), _quoted(t)
        return F.when(_starts(t, line) | (is_block & short), F.lit("\x01")).when(is_quoted & short, quoted(t, True)).when(is_block, comment(t)).when(is_quoted, quoted(t, False)).otherwise(t)

    return F.array_join(F.transform(tokens, by_kind), "")


def _newlines(t: Column) -> Column:
    return F.regexp_replace(t, r"[^\n]++", "")


def _unescaped(t: Column) -> Column:
    return F.regexp_replace(t, r"\\[\s\S]", "\x02")


def masked_text(tokens: Column, line: Column, block: Column) -> Column:
    """Comments and strings blanked out: what indentation is measured on."""

    def blank(x: Column) -> Column:
        lines = _newlines(x)
        return F.concat(F.lit("\x01"), lines, F.when((lines != "") & ~x.endswith("\n"), "\x03").otherwise(""))

    return _rewritten(tokens, line, block, blank, lambda t, short: F.lit("\x01") if short else let(_unescaped(t), blank))


def code_text(tokens: Column, line: Column, block: Column) -> Column:
    """Comments removed, strings kept."""

    def kept(t: Column, short: bool) -> Column:
        if short:
            return t
        joined = F.regexp_replace(t, r"\\\n", "\\\\\\\\\x02")
        return F.concat(joined, F.when(joined.contains("\n"), "\x03").otherwise(""))

    text = _rewritten(tokens, line, block, lambda t: F.concat(F.lit("\x01"), _newlines(t)), kept)
    return F.regexp_replace(text, "\x03[ \t]*|\x01", "")


def raw_text(tokens: Column, line: Column, block: Column) -> Column:
    """The text itself, with the ends of tokens that span lines marked: what imports are
    looked for in."""

    def marked(t: Column) -> Column:
        return F.concat(t, F.when(t.contains("\n"), "\x03").otherwise(""))

    def by_kind(t: Column) -> Column:
        plain = ~t.contains("\n") | _starts(t, line) | ~(_starts(t, block) | _quoted(t))
        return F.when(plain, t).when(_starts(t, block), marked(t)).otherwise(marked(F.regexp_replace(t, r"\\\n", "\\\\\\\\\x02")))

    return F.array_join(F.transform(tokens, by_kind), "")


_JSX = r"\{\s*/\*[\s\S]*?(?:\*/(?:\s*\})?|\z)"
_DOCS = r"///[^\n]*+|//![^\n]*+|/\*\*(?!/)[\s\S]*?(?:\*/|\z)"


def strip_pattern(x: Language, jsx: bool, keep_docs: bool, swallow: bool = False) -> str:
    opener = _JSX if jsx else None
    docs = _DOCS if keep_docs and x.line == "//" else None
    block = _block(x)
    if swallow and block:
        block = rf"{re.escape(x.block[0])}[\s\S]*?(?:{re.escape(x.block[1])}(?:\s*\}})?|\z)"
    parts = (_STRINGS, opener, docs, block, x.line and re.escape(x.line) + r"[^\n]*+", _plain(x, "{" if jsx else ""))
    return "|".join(p for p in parts if p)


def strip_comments(content: Column, ext: Column, aggressive: bool, literal: bool = False, languages: Sequence[Language] = LANGUAGES) -> Column:
    """Text without comments, white space normalised; unknown languages stay as they are.

    Documentation comments (/**, ///, //!) stay unless aggressive. literal reproduces the
    plain reading of that test, by which no // or /* comment is removed unless aggressive,
    and in jsx and tsx takes the closing brace after any removed block comment with it, not
    only after one in braces."""
    jsx = ext.isin("jsx", "tsx")

    def pattern(with_jsx: bool):
        def of(x: Language) -> str:
            if literal and not aggressive and x.line == "//":
                return "|".join([_STRINGS, *[_JSX] * with_jsx, r"[^\"'`{]++|[\s\S]"])
            return strip_pattern(x, with_jsx, not aggressive, literal and with_jsx)

        return of

    clean = F.regexp_replace(content, "[\x01\x02\x03]", "")
    rx = F.when(jsx, pick(ext, pattern(True), languages)).otherwise(pick(ext, pattern(False), languages))
    line, block = pick(ext, lambda x: x.line, languages), pick(ext, lambda x: x.block and x.block[0], languages)
    tokens = F.regexp_extract_all(clean, rx, F.lit(0))
    c_like = line == "//"

    def by_kind(t: Column) -> Column:
        docs = F.lit(False) if aggressive else c_like & (F.lit(literal) | t.rlike(r"^(///|//!|/\*\*(?!/))"))
        comment = (_starts(t, block) | _starts(t, line)) & ~docs
        jsx_comment = jsx & t.rlike(r"^\{\s*/\*")
        # what is taken with a comment up to its brace has no newlines to keep
        inner = lambda start: _newlines(F.regexp_extract(t, start + r"(/\*[\s\S]*?(?:\*/|\z))", 1))
        removed = F.when(jsx & _starts(t, block), inner("^")).otherwise(_newlines(t)) if literal else _newlines(t)
        return F.when(jsx_comment, inner(r"^\{\s*")).when(_quoted(t), t).when(comment, removed).otherwise(t)

    stripped = normalize_whitespace(F.array_join(F.transform(tokens, by_kind), ""))
    return F.when(pick(ext, lambda x: True, languages).isNotNull(), stripped).otherwise(content)


def normalize_whitespace(text: Column) -> Column:
    """Lines trimmed on the right, runs of blank lines reduced to one, outer blanks removed."""
    right = F.regexp_replace(text, r"(?U)[\s&&[^\n]]++(?=\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(right, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+\z", "")
