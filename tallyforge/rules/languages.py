"""Language rules: how files are named, and how strings, comments and branches look.

Each language belongs to a family that fixes its comment and string syntax. From these the regular
expressions of the line counter are built once, on the driver, into a table of fixed size (one row
per file-name key) that is safe to broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Stands for a removed string or comment in the marked text; a control character no source text has.
MARK = "\x01"


@dataclass(frozen=True)
class Syntax:
    """Comment, string and branch syntax shared by a family of languages."""

    line: tuple[str, ...] = ()
    block: tuple[str, str] | None = None
    quotes: str = ""
    raw: tuple[str, ...] = ()
    docstrings: bool = False
    branches: tuple[str, ...] = ()


@dataclass(frozen=True)
class Language:
    """One language; ``signs`` speak for it among several that share a file extension."""

    name: str
    syntax: Syntax
    keys: tuple[str, ...]
    signs: dict[str, int] = field(default_factory=dict)
    interpreters: tuple[str, ...] = field(default=())


# Branch tokens counted as complexity, by family.
_C_BRANCHES = (
    "for ", "for(", "if ", "if(", "switch ", "switch(", "while ", "while(", "else ", "|| ", "&& ", "!= ", "== ",
)
_GO_BRANCHES = ("go ", "for ", "if ", "switch ", "select ", "else ", "|| ", "&& ", "!= ", "== ")
_PY_BRANCHES = ("for ", "while ", "if ", "elif ", "else ", "else:", "or ", "and ", "!= ", "== ")
_SH_BRANCHES = ("for ", "while ", "until ", "if ", "elif ", "else ", "case ", "|| ", "&& ", "!= ", "== ")
_RB_BRANCHES = ("for ", "while ", "until ", "if ", "elsif ", "else ", "unless ", "when ", "|| ", "&& ", "!= ", "== ")
_SQL_BRANCHES = ("case ", "when ", "else ", "and ", "or ")
_LUA_BRANCHES = ("for ", "while ", "repeat ", "if ", "elseif ", "else ", "or ", "and ", "~= ", "== ")
_ML_BRANCHES = ("if ", "else ", "case ", "match ", "when ", "|| ", "&& ")

# Syntax families.
_C = Syntax(("//",), ("/*", "*/"), "\"'", branches=_C_BRANCHES)
_C_DOUBLE = Syntax(("//",), ("/*", "*/"), '"', branches=_C_BRANCHES)
_C_TICK = Syntax(("//",), ("/*", "*/"), "\"'", raw=("`",), branches=_C_BRANCHES)
_GO = Syntax(("//",), ("/*", "*/"), "\"'", raw=("`",), branches=_GO_BRANCHES)
_PHP = Syntax(("//", "#"), ("/*", "*/"), "\"'", branches=_C_BRANCHES)
_PY = Syntax(("#",), None, "\"'", raw=('"""', "'''"), docstrings=True, branches=_PY_BRANCHES)
_SH = Syntax(("#",), None, "\"'", branches=_SH_BRANCHES)
_RB = Syntax(("#",), ("=begin", "=end"), "\"'", branches=_RB_BRANCHES)
_SQL = Syntax(("--",), ("/*", "*/"), "'", branches=_SQL_BRANCHES)
_LUA = Syntax(("--",), ("--[[", "]]"), "\"'", branches=_LUA_BRANCHES)
_HASKELL = Syntax(("--",), ("{-", "-}"), '"', branches=_ML_BRANCHES)
_OCAML = Syntax((), ("(*", "*)"), '"', branches=_ML_BRANCHES)
_LISP = Syntax((";",), None, '"', branches=("(if ", "(when ", "(cond ", "(or ", "(and "))
_ERLANG = Syntax(("%",), None, "\"'", branches=("case ", "if ", "receive ", "when ", "orelse ", "andalso "))
_MATLAB = Syntax(("%",), ("%{", "%}"), "'", branches=("for ", "while ", "if ", "elseif ", "else ", "switch ", "|| ", "&& "))
_R = Syntax(("#",), None, "\"'", branches=("for ", "for(", "while ", "if ", "if(", "else ", "|| ", "&& ", "!= ", "== "))
_HASH = Syntax(("#",), None, "\"'")
_SEMI = Syntax((";", "#"), None, '"')
_MARKUP = Syntax((), ("<!--", "-->"))
_CSS = Syntax((), ("/*", "*/"), "\"'")
_SCSS = Syntax(("//",), ("/*", "*/"), "\"'")
_PLAIN = Syntax()
_JSON = Syntax((), None, '"')
_HCL = Syntax(("#", "//"), ("/*", "*/"), '"')

_POWERSHELL = Syntax(("#",), ("<#", "#>"), "\"'", branches=("for ", "foreach ", "while ", "if ", "if(", "elseif ", "else ", "switch "))
_BATCH = Syntax(("REM ", "rem ", "::"), None, '"', branches=("if ", "IF ", "for ", "FOR "))
_BASIC = Syntax(("'",), None, '"', branches=("For ", "While ", "If ", "ElseIf ", "Else ", "Select "))
_OCAML_SLASH = Syntax(("//",), ("(*", "*)"), '"', branches=_ML_BRANCHES)
_ZIG = Syntax(("//",), None, '"', branches=("for ", "while ", "if ", "else ", "switch ", "or ", "and ", "!= ", "== "))
_ASSEMBLY = Syntax((";", "#"), None, '"')
_FORTRAN = Syntax(("!",), None, "\"'", branches=("do ", "if ", "else ", "select ", "where "))
_PASCAL = Syntax(("//",), ("{", "}"), "'", branches=("for ", "while ", "if ", "else ", "case ", "repeat "))
_ADA = Syntax(("--",), None, '"', branches=("for ", "while ", "if ", "elsif ", "else ", "case ", "or ", "and "))
_NIX = Syntax(("#",), ("/*", "*/"), '"', branches=("if ", "else ", "|| ", "&& ", "!= ", "== "))
_VIM = Syntax(('"',), None, "'", branches=("for ", "while ", "if ", "elseif ", "else "))
_PHP_LIKE = Syntax(("//", "#"), ("/*", "*/"), "\"'")
_TEX = Syntax(("%",))
_PROLOG = Syntax(("%",), ("/*", "*/"), "\"'", branches=("-> ", "; "))

# Texts that speak for a language, with their weights, where an extension leads to several. A documented choice of this package.
_CPP_SIGNS = {"class ": 1, "namespace ": 2, "template<": 2, "template <": 2, "using ": 1, "public:": 1, "private:": 1, "std::": 2, "virtual ": 1, "constexpr ": 1, "#include <iostream>": 2}
_OBJECTIVE_SIGNS = {"#import": 2, "@interface": 3, "@implementation": 3, "@end": 1, "@property": 2, "@protocol": 2, "NSString": 1}
_MATLAB_SIGNS = {"function ": 1, "end\n": 1, "disp(": 1, "zeros(": 1, "fprintf(": 1, "%%": 1}
_PERL_SIGNS = {"use strict": 2, "my $": 2, "my @": 2, "sub ": 1, "@_": 1, "$_": 1, "=~": 1, "package ": 1}
_PROLOG_SIGNS = {":- ": 3, ":-\n": 2, "?- ": 2, "\\+": 1, "atom(": 1, "assertz(": 2, "findall(": 2}
_R_SIGNS = {"<- ": 2, "function(": 1, "library(": 2, "data.frame": 2, "c(": 1, "%>%": 2}
_REBOL_SIGNS = {"REBOL [": 4, "Rebol [": 4, "func [": 2, "print [": 1, "either ": 1}
_TYPESCRIPT_SIGNS = {"import ": 1, "export ": 1, "interface ": 1, ": string": 1, ": number": 1, "=> ": 1, "const ": 1}
_TRANSLATION_SIGNS = {"<!DOCTYPE TS": 5, "<TS ": 3, "<context>": 2, "<translation": 2}

# Languages and the file-name keys that lead to them. A key that starts with a dot is
# an extension, any other a whole file name. Of several languages with one key, a script goes to the one whose interpreter it names, any other
# file to the one whose signs weigh most; the first listed wins ties.
LANGUAGES: list[Language] = [
    Language("Go", _GO, (".go",)),
    Language("Python", _PY, (".py", ".pyw", ".pyi"), interpreters=("python",)),
    Language("JavaScript", _C_TICK, (".js", ".mjs", ".cjs"), interpreters=("node",)),
    Language("JSX", _C_TICK, (".jsx",)),
    Language("TypeScript", _C_TICK, (".ts", ".tsx", ".mts", ".cts"), _TYPESCRIPT_SIGNS),
    Language("Qt Translation", _MARKUP, (".ts",), _TRANSLATION_SIGNS),
    Language("TypeScript Typings", _C_TICK, (".d.ts",)),
    Language("Java", _C, (".java",)),
    Language("Kotlin", _C, (".kt", ".kts")),
    Language("Scala", _C, (".scala", ".sc")),
    Language("Groovy", _C, (".groovy", ".grt", "jenkinsfile")),
    Language("Gradle", _C, (".gradle",)),
    Language("C", _C, (".c", ".ec")),
    Language("C Header", _C, (".h",)),
    Language("C++ Header", _C, (".h", ".hh", ".hpp", ".hxx"), _CPP_SIGNS),
    Language("C++", _C, (".cc", ".cpp", ".cxx", ".c++")),
    Language("C#", _C, (".cs",)),
    Language("MATLAB", _MATLAB, (".m",), _MATLAB_SIGNS),
    Language("Objective C", _C, (".m", ".mm", ".h"), _OBJECTIVE_SIGNS),
    Language("Swift", _C_DOUBLE, (".swift",)),
    Language("Rust", _C_DOUBLE, (".rs",)),
    Language("Dart", _C, (".dart",)),
    Language("PHP", _PHP, (".php", ".phtml"), interpreters=("php",)),
    Language("Ruby", _RB, (".rb", "rakefile", "gemfile"), interpreters=("ruby",)),
    Language("Perl", _SH, (".pl", ".pm"), _PERL_SIGNS, interpreters=("perl",)),
    Language("Prolog", _PROLOG, (".pl", ".prolog"), _PROLOG_SIGNS, interpreters=("swipl",)),
    Language("Shell", _SH, (".sh",), interpreters=("sh", "dash", "ksh", "zsh")),
    Language("BASH", _SH, (".bash", ".bashrc"), interpreters=("bash",)),
    Language("Lua", _LUA, (".lua",), interpreters=("lua",)),
    Language("R", _R, (".r",), _R_SIGNS, interpreters=("Rscript",)),
    Language("Rebol", _SEMI, (".r", ".reb"), _REBOL_SIGNS),
    Language("Julia", _R, (".jl",)),
    Language("Elixir", _HASH, (".ex", ".exs"), interpreters=("elixir",)),
    Language("Erlang", _ERLANG, (".erl", ".hrl")),
    Language("Haskell", _HASKELL, (".hs",)),
    Language("OCaml", _OCAML, (".ml", ".mli")),
    Language("Clojure", _LISP, (".clj", ".cljs", ".cljc")),
    Language("Emacs Lisp", _LISP, (".el",)),
    Language("SQL", _SQL, (".sql", ".ddl")),
    Language("Protocol Buffers", _C_DOUBLE, (".proto",)),
    Language("GraphQL", _HASH, (".graphql", ".gql")),
    Language("Terraform", _HCL, (".tf", ".tfvars")),
    Language("Dockerfile", _HASH, ("dockerfile", ".dockerfile")),
    Language("Makefile", _HASH, ("makefile", "gnumakefile", ".mk", ".mak")),
    Language("CMake", _HASH, ("cmakelists.txt", ".cmake")),
    Language("YAML", _HASH, (".yml", ".yaml")),
    Language("TOML", _HASH, (".toml",)),
    Language("INI", _SEMI, (".ini",)),
    Language("Properties File", _HASH, (".properties",)),
    Language("JSON", _JSON, (".json",)),
    Language("XML", _MARKUP, (".xml", ".xsd", ".xsl")),
    Language("HTML", _MARKUP, (".html", ".htm")),
    Language("Vue", _MARKUP, (".vue",)),
    Language("SVG", _MARKUP, (".svg",)),
    Language("Markdown", _PLAIN, (".md", ".markdown")),
    Language("Plain Text", _PLAIN, (".txt",)),
    Language("CSS", _CSS, (".css",)),
    Language("Sass", _SCSS, (".scss", ".sass")),
    Language("LESS", _SCSS, (".less",)),
    Language("Powershell", _POWERSHELL, (".ps1", ".psm1", ".psd1")),
    Language("Batch", _BATCH, (".bat", ".cmd")),
    Language("Visual Basic", _BASIC, (".vb", ".vbs")),
    Language("F#", _OCAML_SLASH, (".fs", ".fsi", ".fsx")),
    Language("Zig", _ZIG, (".zig",)),
    Language("Solidity", _C, (".sol",)),
    Language("Assembly", _ASSEMBLY, (".s", ".asm")),
    Language("FORTRAN Modern", _FORTRAN, (".f90", ".f95", ".f03", ".f08")),
    Language("Pascal", _PASCAL, (".pas", ".dpr")),
    Language("Ada", _ADA, (".ada", ".adb", ".ads")),
    Language("D", _C, (".d",)),
    Language("Nim", _HASH, (".nim",)),
    Language("Nix", _NIX, (".nix",)),
    Language("Crystal", _RB, (".cr",)),
    Language("VHDL", _ADA, (".vhd", ".vhdl")),
    Language("SystemVerilog", _C, (".sv", ".svh")),
    Language("Verilog", _C, (".v", ".vh")),
    Language("TCL", _HASH, (".tcl",), interpreters=("tclsh",)),
    Language("Vim Script", _VIM, (".vim", ".vimrc")),
    Language("Scheme", _LISP, (".scm", ".ss")),
    Language("Racket", _LISP, (".rkt",)),
    Language("Lisp", _LISP, (".lisp", ".lsp")),
    Language("Fish", _SH, (".fish",), interpreters=("fish",)),
    Language("AWK", _SH, (".awk",), interpreters=("awk", "gawk")),
    Language("Thrift", _PHP_LIKE, (".thrift",)),
    Language("Bazel", _PY, (".bzl", "build.bazel", "workspace")),
    Language("Puppet", _HASH, (".pp",)),
    Language("HCL", _HCL, (".hcl",)),
    Language("XAML", _MARKUP, (".xaml",)),
    Language("MSBuild", _MARKUP, (".csproj", ".vbproj", ".fsproj", ".props", ".targets")),
    Language("Svelte", _MARKUP, (".svelte",)),
    Language("Handlebars", _MARKUP, (".hbs", ".handlebars")),
    Language("LaTeX", _TEX, (".tex",)),
    Language("ReStructuredText", _PLAIN, (".rst",)),
    Language("AsciiDoc", _PLAIN, (".adoc", ".asciidoc")),
    Language("Jupyter", _JSON, (".ipynb",)),
    Language("CSV", _PLAIN, (".csv",)),
    Language("CoffeeScript", _HASH, (".coffee",)),
    Language("Elm", _HASKELL, (".elm",)),
    Language("PureScript", _HASKELL, (".purs",)),
    Language("Cuda", _C, (".cu", ".cuh")),
    Language("GLSL", _C, (".glsl", ".vert", ".frag")),
]

# Whole file names that are keys, and extensions of two parts.
NAME_KEYS = sorted({k for lang in LANGUAGES for k in lang.keys if not k.startswith(".")})
LONG_EXTENSIONS = sorted({k for lang in LANGUAGES for k in lang.keys if k.count(".") == 2})

# Syntaxes by number: the rule table names one, and the line counter has its patterns as literals, so
# that each is compiled once per task however files of several languages alternate.
SYNTAXES = list(dict.fromkeys(lang.syntax for lang in LANGUAGES))

LANGUAGE_RULE_SCHEMA = pa.schema(
    [
        ("key", pa.string()),
        (
            "candidates",
            pa.list_(pa.struct([
                ("language", pa.string()), ("syntax", pa.int32()), ("interpreters", pa.list_(pa.string())),
                ("signs", pa.list_(pa.struct([("sign", pa.string()), ("weight", pa.int32())]))),
            ])),
        ),
    ]
)


def _spanning(open_: str, close: str) -> str:
    """A comment from its open to its close mark; the group captures one line break if it has any."""
    opened, closed = re.escape(open_), rf"(?:{re.escape(close)}|\z)"
    return rf"{opened}(?:[^\n]*?{closed}|[^\n]*(\n)[\s\S]*?{closed})"


def _character_class(characters: set[str]) -> str:
    return "[" + "".join("\\" + c for c in sorted(characters - {"\t"}) if not c.isalpha()) + "".join(
        c for c in sorted(characters) if c.isalpha() or c == "\t"
    ) + "]"


def token_rule(syntax: Syntax) -> tuple[str | None, str | None, int]:
    """Pattern of all strings and comments, what each is replaced by, and the group of raw strings.

    A string leaves its quote, so that its line still counts as code. A comment leaves nothing, and
    one line break if it spans lines. The first mark in the text wins, so a comment mark inside a
    string is no comment. No group is repeated, so the matcher needs no deep stack on long lines.
    """
    alternatives: list[str] = []
    groups = 0
    raw_group = 0
    kept: list[int] = []

    def add(pattern: str) -> None:
        nonlocal groups
        alternatives.append(pattern)
        groups += 1
        kept.append(groups)

    if syntax.docstrings:
        for mark in syntax.raw:
            add(r"^[ \t]*+" + _spanning(mark, mark))
    if syntax.block and syntax.block[0].startswith(tuple(syntax.line) or ("\0",)):
        add(_spanning(*syntax.block))
    if syntax.raw:
        groups += 1
        raw_group = groups
        add("(({0})[\\s\\S]*?(?:\\{1}|\\z))".format("|".join(re.escape(m) for m in syntax.raw), groups + 1))
    if syntax.quotes:
        add("([{0}])[^\\n]*?\\{1}".format(re.escape(syntax.quotes), groups + 1))
    if syntax.block and not syntax.block[0].startswith(tuple(syntax.line) or ("\0",)):
        add(_spanning(*syntax.block))
    for mark in syntax.line:
        alternatives.append(re.escape(mark) + r"[^\n]*+")
    if not alternatives:
        return None, None, 0
    # The look-ahead rejects most places of a text by one character.
    starts = {mark[0] for mark in [*syntax.line, *syntax.raw, *syntax.quotes, *(syntax.block or ())[:1]]}
    indented = r"|^[ \t]" if syntax.docstrings else ""
    return f"(?dm)(?={_character_class(starts)}{indented})(?:" + "|".join(alternatives) + ")", MARK + "".join(f"${g}" for g in kept) + MARK, raw_group


def branch_rule(syntax: Syntax) -> str | None:
    """Pattern of the white space before a branch token; tokens start a word, and white space is what most places of a text are rejected by."""
    if not syntax.branches:
        return None
    starts = _character_class({b[0] for b in syntax.branches})
    return rf"\s(?={starts})(?=" + "|".join(re.escape(b) for b in syntax.branches) + ")"


def _candidates() -> dict[str, list[dict]]:
    by_key: dict[str, list[dict]] = {}
    for lang in LANGUAGES:
        row = {
            "language": lang.name, "syntax": SYNTAXES.index(lang.syntax), "interpreters": list(lang.interpreters),
            "signs": [{"sign": sign, "weight": weight} for sign, weight in lang.signs.items()],
        }
        for key in [*lang.keys, *(f"#!{i}" for i in lang.interpreters)]:
            by_key.setdefault(key, []).append(row)
    return dict(sorted(by_key.items()))


def language_rules(spark: SparkSession) -> DataFrame:
    """Rule table: one row per file-name key with its candidate languages in order of the list."""
    rules = _candidates()
    table = pa.table([list(rules), list(rules.values())], schema=LANGUAGE_RULE_SCHEMA)
    return spark.createDataFrame(table)
