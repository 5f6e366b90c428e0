"""Column functions on source text. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters Python's str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Suffixes with a known language, as used when a file is analysed.
PYTHON_SUFFIXES = (".py",)
JAVASCRIPT_SUFFIXES = (".js", ".jsx", ".mjs")

# The language/extension dimension.
LANGUAGE_EXTENSIONS = {
    "python": ".py",
    "javascript": ".js",
    "typescript": ".ts",
    "java": ".java",
    "go": ".go",
    "rust": ".rs",
    "cpp": ".cpp",
    "c": ".c",
}

CHARS_PER_TOKEN = 4

_BLANK_REST = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in PY_WHITESPACE if c != "\n") + "]*+"


def py_strip(text: Column) -> Column:
    """Text without leading and trailing Unicode whitespace."""
    return F.btrim(text, F.lit(PY_WHITESPACE))


def stripped_length(text: Column) -> Column:
    """Code points left after stripping; null text counts as empty."""
    return F.char_length(py_strip(F.coalesce(text, F.lit(""))))


def content_hash(text: Column) -> Column:
    """MD5 hex digest of the UTF-8 bytes."""
    return F.md5(text)


def token_estimate(text: Column) -> Column:
    """Rough token count: four code points make a token."""
    return F.floor(F.char_length(text) / CHARS_PER_TOKEN).cast("int")


def truncate_tokens(text: Column, max_length: int = 512) -> Column:
    """Cut text whose token estimate is above ``max_length``; shorter text is untouched."""
    return F.when(
        token_estimate(text) > max_length,
        F.substring(text, 1, max_length * CHARS_PER_TOKEN),
    ).otherwise(text)


def strip_prompt(generated: Column, prompt: Column) -> Column:
    """Generated text after as many characters as the prompt has."""
    return F.substring(generated, F.char_length(prompt) + 1, F.char_length(generated))


def truncate_next_def(text: Column) -> Column:
    """Text up to the next top-level ``def`` or ``class``; one on the first line does not count."""
    return F.split(text, "\n(?=def |class )", 2)[0]


def display_cut(text: Column) -> Column:
    """Text through the first blank line after the first line, that blank line included."""
    head = F.regexp_extract(text, r"\A[\s\S]*?\n" + _BLANK_REST + r"(?=\n|\z)", 0)
    return F.when(head == "", text).otherwise(head)


def function_name(prompt: Column) -> Column:
    """Name in the first ``def name(``; ``candidate`` when there is none."""
    found = F.regexp_extract(prompt, r"(?U)def[\s\x1c-\x1f]+(\w+)[\s\x1c-\x1f]*\(", 1)
    return F.when(found == "", F.lit("candidate")).otherwise(found)


def assemble_program(
    completion: Column,
    test: Column,
    prompt: Column | None = None,
    entry_point: Column | None = None,
) -> Column:
    """Completion, blank line, test.

    With ``prompt`` the completion is put back behind its prompt, so the function header is part
    of the program; with ``entry_point`` a call of the benchmark's ``check`` is appended.
    """
    head = completion if prompt is None else F.concat(prompt, completion)
    program = F.concat(head, F.lit("\n\n"), test)
    if entry_point is None:
        return program
    return F.concat(program, F.lit("\n\ncheck("), entry_point, F.lit(")\n"))


def total_lines(text: Column) -> Column:
    """Newline count plus one, so an empty file has one line."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def file_suffix(path: Column) -> Column:
    """Last suffix of the last path part, dot included; a leading dot makes no suffix."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def language_of(path: Column) -> Column:
    """Language by lower-cased suffix; null when it is not supported."""
    suffix = F.lower(file_suffix(path))
    return F.when(suffix.isin(*PYTHON_SUFFIXES), F.lit("python")).when(
        suffix.isin(*JAVASCRIPT_SUFFIXES), F.lit("javascript")
    )


def extension_language(suffix: Column) -> Column:
    """Language for one of the eight known extensions; null otherwise."""
    pairs = [F.lit(v) for lang, ext in LANGUAGE_EXTENSIONS.items() for v in (ext, lang)]
    return F.try_element_at(F.create_map(*pairs), suffix)


def decode_source(content: Column) -> Column:
    """UTF-8 text with all line ends as newline; null when the bytes are not UTF-8."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
    return F.regexp_replace(text, "\r\n?", "\n")
