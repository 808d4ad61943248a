"""Definitions, imports and call tokens of source lines, by rules of each language.

A rule names a keyword and a kind; the name is the identifier that follows the keyword's
first whole-word occurrence, after an argument list that touches the keyword and after type
parameters, however deep their brackets nest and however long the line is.  All rules are
column expressions: each keyword of a line is looked for once, and one expression over the
array of what was found serves the rules of all languages, which keeps the compiled code of
a stage small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import BLANK, lines

#: Languages by lower-case file extension.
LANGUAGES = {
    "rust": ("rs",),
    "tsjs": ("ts", "tsx", "js", "jsx", "mjs", "cjs"),
    "python": ("py",),
    "go": ("go",),
    "javalike": ("java", "cs", "kt", "scala"),
}

#: Words that are never names of definitions.
NOT_NAMES = (
    "if", "else", "for", "while", "loop", "match", "case", "return", "new", "typeof", "let", "var",
    "const", "fn", "func", "def", "class", "struct", "enum", "trait", "impl", "use", "mod", "pub",
    "import", "from", "export", "self", "this", "super", "true", "false", "null", "nil", "none",
    "async", "await", "static", "final", "void", "int", "uint", "float", "bool", "string", "error",
    "result", "some", "ok", "err", "throw", "catch", "try", "switch", "break", "continue", "type",
)

#: Words that may come before a method's return type.
MODIFIERS = (
    "public", "private", "protected", "static", "final", "abstract", "override",
    "virtual", "async", "synchronized", "native", "sealed", "internal", "extern",
)

#: language: (keyword, kind, texts the line must hold all of, texts it must hold one of), in order.
RULES: dict[str, tuple[tuple[str, str, tuple[str, ...], tuple[str, ...]], ...]] = {
    "rust": (("fn", "func", (), ()), ("struct", "struct", (), ()), ("enum", "enum", (), ()), ("trait", "trait", (), ()), ("type", "type", ("=",), ()), ("impl", "impl", (), ())),
    "tsjs": (
        ("function", "func", (), ()), ("class", "class", (), ()), ("interface", "interface", (), ()), ("enum", "enum", (), ()),
        ("type", "type", ("=",), ()), ("const", "func", ("=",), ("=>", "function")),
    ),
    "python": (("def", "func", (), ()), ("class", "class", (), ())),
    "go": (("func", "func", (), ()), ("type", "struct", ("struct",), ()), ("type", "interface", ("interface",), ())),
    "javalike": (("class", "class", (), ()), ("interface", "interface", (), ()), ("enum", "enum", (), ())),
}

def language(path: Column) -> Column:
    """The language of a file by its extension; a name that begins with its only dot has
    none."""
    base = F.element_at(F.split(path, "/", -1), -1)
    ext = F.lower(F.regexp_extract(base, r"(?s)^.+\.([^.]*)$", 1))
    out = None
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(*exts), name) if out is None else out.when(ext.isin(*exts), name)
    return out.otherwise("plain")


def after_word(line: Column, word: str) -> Column:
    """What follows the first whole-word occurrence; empty if there is none."""
    return F.regexp_extract(line, rf"(?s)(?<![A-Za-z0-9_]){word}(?![A-Za-z0-9_])(.*)", 1)


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def after_brackets(text: Column, opening: str, closing: str) -> Column:
    """The text after the bracketed part that it begins with, or all of it where it begins
    with none; null where the brackets don't close.

    Piece i between closing brackets ends the part if as many have been opened so far as
    i + 1.  Only brackets are counted, so a line costs what it has of them."""
    pieces = F.split(text, "\\" + closing, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("opened"), F.lit(-1).alias("end"))

    def count(state: Column, piece: Column) -> Column:
        opened = state["opened"] + F.char_length(piece) - F.char_length(F.replace(piece, F.lit(opening), F.lit("")))
        done = F.when(state["end"] >= 0, state["end"]).when(opened == state["at"] + 1, state["at"]).otherwise(-1)
        return F.struct((state["at"] + 1).alias("at"), opened.alias("opened"), done.alias("end"))

    def rest(parts: Column) -> Column:
        # The last piece has no closing bracket after it.
        end = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), start, count, lambda state: state["end"])
        return bound(end, lambda e: F.when(e >= 0, F.array_join(F.slice(parts, e + 2, F.size(parts)), closing)))

    return F.when(text.startswith(opening), bound(pieces, rest)).otherwise(text)


def name_in(rest: Column) -> Column:
    """The identifier that what follows a keyword gives, or null."""
    inner = bound(after_brackets(rest, "(", ")"), lambda t: after_brackets(F.ltrim(t, F.lit(" \t")), "<", ">"))
    name = bound(inner, lambda t: F.regexp_extract(t, r"^[ \t]*([A-Za-z_][A-Za-z0-9_]*)", 1))
    return F.when(name != "", name)


def _holds(line: Column, every: tuple[str, ...], some: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for x in every:
        out = out & F.contains(line, F.lit(x))
    if some:
        one = F.lit(False)
        for x in some:
            one = one | F.contains(line, F.lit(x))
        out = out & one
    return out


def _method(line: Column) -> Column:
    """name of `modifier... type name(`, for the Java-like languages."""
    tokens = F.filter(F.split(line, r"(?U)\s+", -1), lambda t: t != "")
    first = F.array_position(F.transform(tokens, lambda t: ~t.isin(*MODIFIERS)), True)
    name = F.element_at(F.split(F.get(tokens, first.cast("int")), r"\(", -1), 1)
    fits = F.contains(line, F.lit("(")) & (first >= 2) & name.rlike(r"^[\p{IsAlphabetic}\p{N}_]+$") & (F.octet_length(name) >= 2) & ~name.isin(*NOT_NAMES)
    return F.when(fits, name)


def definition(lang: Column, line: Column) -> Column:
    """struct<name, kind> of the first rule that gives a name, or null."""
    found = None
    for name, rules in RULES.items():
        tries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.when(_holds(line, every, some), after_word(line, word)).alias("rest")) for word, kind, every, some in rules])
        found = F.when(lang == name, tries) if found is None else found.when(lang == name, tries)

    def named(t: Column) -> Column:
        kind = F.when((lang == "go") & (t["kind"] == "func") & F.ltrim(t["rest"]).startswith("("), "method").otherwise(t["kind"])
        return F.struct(F.when(t["rest"] != "", name_in(t["rest"])).alias("name"), kind.alias("kind"))

    first = F.get(F.filter(F.transform(F.filter(found, lambda t: t["rest"] != ""), named), lambda d: d["name"].isNotNull()), F.lit(0))
    java = F.when(lang == "javalike", bound(_method(line), lambda n: F.when(n.isNotNull(), F.struct(n.alias("name"), F.lit("method").alias("kind")))))
    fits = lambda d: (F.octet_length(d["name"]) >= 2) & ~d["name"].isin(*NOT_NAMES)
    return F.get(F.filter(F.array(F.coalesce(first, java)), fits), F.lit(0))


def source_lines(files: DataFrame) -> DataFrame:
    """file_id, rel, lang, line, text of each non-blank line of files in a known language."""
    known = files.withColumn("lang", language(F.col("rel"))).filter("lang != 'plain'")
    each = known.select("file_id", "rel", "lang", F.posexplode(lines(F.col("content"))).alias("at", "text"))
    return each.filter(~F.col("text").rlike(BLANK)).select("file_id", "rel", "lang", (F.col("at") + 1).alias("line"), "text")


#: Lines without one of these hold no definition.
KEYWORDS = sorted({word for rules in RULES.values() for word, *_ in rules})
MAYBE = rf"(?<![A-Za-z0-9_])(?:{'|'.join((*KEYWORDS, *MODIFIERS))})(?![A-Za-z0-9_])"


def definitions(source: DataFrame) -> DataFrame:
    """file_id, line, name, kind, at most one for each line."""
    likely = source.filter(F.col("text").rlike(MAYBE)).select("file_id", "line", "lang", F.regexp_replace("text", r"(?U)^\s+", "").alias("text"))
    # An outer explode, as from another one a filter that repeats the whole rule is derived.
    d = F.explode_outer(F.array(definition(F.col("lang"), F.col("text")))).alias("d")
    return likely.select("file_id", "line", d).filter("d IS NOT NULL").select("file_id", "line", "d.name", "d.kind")


CALL = r"([A-Za-z_][A-Za-z0-9_]*)[ \t]*\("


def call_tokens(source: DataFrame) -> DataFrame:
    """file_id, line, name of each identifier before an opening parenthesis."""
    names = F.filter(F.regexp_extract_all("text", F.lit(CALL), 1), lambda n: F.octet_length(n) >= 2)
    return source.select("file_id", "line", F.explode(names).alias("name"))


def quoted(text: Column) -> Column:
    """What is in the first pair of equal quotes (or runs to the end); null if empty."""
    q = F.regexp_extract(text, r"(?s)^[^'\"`]*+(?:'([^']*+)|\"([^\"]*+)|`([^`]*+))", 0)
    return bound(F.regexp_extract(q, r"(?s)['\"`](.*)", 1), lambda t: F.when(t != "", t))


def import_spec(lang: Column, text: Column) -> Column:
    """The module that a line imports, or null."""
    tail = lambda line, pattern: bound(F.regexp_extract(line, pattern, 1), lambda t: F.when(t != "", t))
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), ";++$", ""))

    def by_language(line: Column) -> Column:
        tsjs = F.coalesce(quoted(after_word(line, "from")), F.when(line.startswith("import ") | F.contains(line, F.lit("require(")), quoted(line)))
        path = bare(F.regexp_replace(tail(line, r"(?s)^(?:pub )?use (.*)$"), r"(?s)\{.*$", ""))
        crate = bound(path, lambda p: F.when(p.startswith("crate::"), F.replace(F.regexp_replace(F.substring(p, F.lit(8), F.char_length(p)), "(?:::)++$", ""), F.lit("::"), F.lit("/"))))
        module = F.element_at(F.split(bare(tail(line, r"(?s)^(?:pub )?mod (.*)$")), " ", -1), 1)
        rust = F.when(line.rlike(r"^(?:pub )?use "), crate).otherwise(module)
        first = tail(line, r"(?sU)^from \s*+(\S++)")
        several = F.trim(F.element_at(F.split(tail(line, r"(?s)^import (.*)$"), ",", -1), 1))
        python = F.when(line.startswith("from "), first).otherwise(several)
        go = F.when(line.startswith("import ") | line.startswith('"'), quoted(line))
        java = F.trim(F.regexp_replace(tail(line, r"(?s)^import (.*)$"), ";++$", ""))
        return F.when(lang == "tsjs", tsjs).when(lang == "rust", rust).when(lang == "python", python).when(lang == "go", go).when(lang == "javalike", java)

    return bound(F.regexp_replace(text, r"(?U)^\s++|\s+$", ""), by_language)


#: Lines without one of these import nothing.
IMPORTING = r'from|import|require\(|use |mod |"'


def imports(source: DataFrame) -> DataFrame:
    """file_id, rel, line, spec of each importing line."""
    likely = source.filter(F.col("text").rlike(IMPORTING))
    spec = F.explode_outer(F.array(import_spec(F.col("lang"), F.col("text")))).alias("spec")
    return likely.select("file_id", "rel", "line", spec).filter("spec IS NOT NULL")
