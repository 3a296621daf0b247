"""The languages: comment delimiters, import keywords, extensions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...]
    line: str | None
    block: tuple[str, str] | None
    imports: tuple[str, ...]
    indent: int = 4


_C = ("/*", "*/")
# The whole dimension.
LANGUAGES = [
    Language("Rust", ("rs",), "//", _C, ("use", "mod", "extern crate")),
    Language("Python", ("py",), "#", ('"""', '"""'), ("import", "from")),
    Language("JavaScript", ("js", "mjs", "cjs", "jsx"), "//", _C, ("import", "require(")),
    Language("TypeScript", ("ts", "tsx"), "//", _C, ("import", "require(")),
    Language("Java", ("java",), "//", _C, ("import", "package")),
    Language("C#", ("cs",), "//", _C, ("using", "namespace")),
    Language("GDScript", ("gd",), "#", None, ("extends", "class_name", "preload", "load")),
    Language("Lua", ("lua",), "--", ("--[[", "]]"), ("require",)),
    Language("Go", ("go",), "//", _C, ("import",)),
    Language("PHP", ("php",), "//", _C, ("use", "require", "include", "namespace")),
    Language("C/C++", ("c", "cpp", "h", "hpp", "cc", "cxx", "hh", "hxx"), "//", _C, ("#include",)),
]
# Extensions whose settings are those of another one.
SETTINGS_OF = {"mjs": "js", "cjs": "js", "tsx": "ts", "c": "cpp", "h": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hh": "cpp", "hxx": "cpp"}



def supported(languages: Sequence[Language] = LANGUAGES) -> list[str]:
    """The extensions of the languages, sorted."""
    return sorted(e for x in languages for e in x.extensions)


SUPPORTED = supported()


def catalog(spark: SparkSession, languages: Sequence[Language] = LANGUAGES) -> DataFrame:
    """(name, ext, line_comment, block_open, block_close, import_keywords, indent_size), one
    row per extension. Another language is one more entry in languages, which the scanner,
    the stripper and the reports take, too."""
    rows = [(x.name, e, x.line, x.block and x.block[0], x.block and x.block[1], list(x.imports), x.indent) for x in languages for e in x.extensions]
    return spark.createDataFrame(rows, "name string, ext string, line_comment string, block_open string, block_close string, import_keywords array<string>, indent_size int")


def pick(ext: Column, value, languages: Sequence[Language] = LANGUAGES) -> Column:
    """A literal per language: value(language), null for extensions without one."""
    out = None
    for x in languages:
        v = value(x)
        lit = F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        out = F.when(ext.isin(*x.extensions), lit) if out is None else out.when(ext.isin(*x.extensions), lit)
    return F.lit(None) if out is None else out


def settings_extension(ext: Column) -> Column:
    """The extension under which settings for ext are looked up."""
    out = None
    for a, b in SETTINGS_OF.items():
        out = F.when(ext == a, b) if out is None else out.when(ext == a, b)
    return out.otherwise(ext)
