"""Text helpers as Column expressions.

All of them are plain Catalyst expressions, with no Python.  The regexes are written for Java: ``(?d)`` makes ``.``,
``^`` and ``$`` know only ``\\n`` as a line end, ``\\z`` is the true end of the text, and the possessive quantifiers
keep the passes linear.  A pattern that is tried at every character starts with something cheap (``^`` or a literal),
since a class of many characters or a look-behind in that place costs more than all the rest; trimming goes through
``btrim``, which touches the ends only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that Python's str.strip() and str.isspace() know.
PY_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The white space that JavaScript's trim() and \s know.
JS_SPACE = (
    "\t\n\x0b\x0c\r \xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same two sets, and Python's line ends, as bodies of Java character classes.
PY_SPACE_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PY_BREAK_CLASS = r"\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029"
PY_BLANK_CLASS = r"\t\x1F \xA0\u1680\u2000-\u200a\u202f\u205f\u3000"  # space that does not end a line
JS_SPACE_CLASS = r"\t\n\x0B\f\r \xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
JS_BLANK_CLASS = r"\t\x0B\f\r \xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"  # all but \n
# A "word" character as Python's \w sees it.
PY_WORD_CLASS = r"[\p{L}\p{N}_]"

# The terminal escape sequences to remove, in order of application.
ANSI_PATTERNS = {
    "py": [r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"],
    "js": [
        r"\x1B\[[0-9;]*m",
        r"\x1B\[([0-9]{1,2}(;[0-9]{1,2})*)?[m|K]",
        r"[\x1B\x9B][\[()#;?]*(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-ORZcf-nqry=><]",
    ],
}

# The characters a sequence can start with.
ANSI_STARTS = {"py": "\x1b", "js": "\x1b\x9b"}

# Status marks of the per-file summary lines.
STATUS_ICONS = {
    "emoji": ("✅", "❌", "⚠️"),
    "text": ("[PASS]", "[FAIL]", "[FAILED_TO_RUN]"),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times in ``body``, also from inside lambdas.

    Catalyst re-evaluates an outer expression for every element when a lambda refers to it; going through a
    one-element array makes it a bound variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_strip(c: Column | str) -> Column:
    """Python's ``strip()``: Unicode white space and the separators U+001C-U+001F."""
    return F.btrim(col(c), F.lit(PY_SPACE))


def js_trim(c: Column | str) -> Column:
    """JavaScript's ``trim()``."""
    return F.btrim(col(c), F.lit(JS_SPACE))


def py_dedent(c: Column | str) -> Column:
    """Remove the common leading white space of all non-blank lines; blank lines become empty."""

    def margin(margins: Column) -> Column:
        # The common prefix of all margins is that of the smallest and the largest one.
        ends = F.concat(F.array_min(margins), F.lit("\n"), F.array_max(margins))
        # No margins at all (only blank lines) gives NULL: nothing to remove then.
        return F.coalesce(F.regexp_extract(ends, r"\A([ \t]*)[ \t]*\n\1", 1), F.lit(""))

    def cut(text: Column) -> Column:
        margins = F.regexp_extract_all(text, F.lit(r"(?md)^([ \t]*+)[^\n]"), F.lit(1))
        return let(
            let(margins, margin),
            lambda m: F.when(m == "", text).otherwise(
                F.regexp_replace(text, F.concat(F.lit("(?md)^"), m), F.lit(""))
            ),
        )

    return let(F.regexp_replace(col(c), r"(?md)^[ \t]++$", ""), cut)


def holds_any(text: Column, marks: str) -> Column:
    """Whether any of the characters is in the text.  This is a plain search, much cheaper than a regex class."""
    found = F.contains(text, F.lit(marks[0]))
    for mark in marks[1:]:
        found = found | F.contains(text, F.lit(mark))
    return found


def py_indent(c: Column | str, width: int) -> Column:
    """Put ``width`` spaces before every line that holds more than white space."""
    filled = rf"(?=[{PY_BLANK_CLASS}]*+[^{PY_BLANK_CLASS}{PY_BREAK_CLASS}])"
    pad = " " * width

    def indent(text: Column) -> Column:
        # Java's own line ends first, then those that only Python has.
        out = F.regexp_replace(text, rf"(?m)^{filled}", pad)
        other = F.regexp_replace(out, rf"[\x0B\f\x1C-\x1E]{filled}", f"$0{pad}")
        return F.when(holds_any(text, "\x0b\x0c\x1c\x1d\x1e"), other).otherwise(out)

    return let(col(c), indent)


def py_lines(c: Column | str) -> Column:
    """``"\\n".join(text.splitlines())``: every line end becomes ``\\n``, one at the very end is dropped."""
    ends = rf"(?:\r\n|[{PY_BREAK_CLASS}])"

    def lines(text: Column) -> Column:
        mixed = F.regexp_replace(F.regexp_replace(text, rf"{ends}\z", ""), ends, "\n")
        plain = F.when(
            F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)
        ).otherwise(text)
        return F.when(holds_any(text, "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"), mixed).otherwise(plain)

    return let(col(c), lines)


def strip_ansi(c: Column | str, flavor: str = "py") -> Column:
    """Remove terminal escape sequences (``flavor`` is ``py`` or ``js``); texts without any are passed through."""

    def strip(text: Column) -> Column:
        out = text
        for pattern in ANSI_PATTERNS[flavor]:
            out = F.regexp_replace(out, pattern, "")
        return F.when(holds_any(text, ANSI_STARTS[flavor]), out).otherwise(text)

    return let(col(c), strip)


def drop_lines(c: Column | str, prefix_regex: str) -> Column:
    """Delete the lines that start with ``prefix_regex``; the other lines keep their line ends."""
    return F.regexp_replace(col(c), rf"(?md)^(?:{prefix_regex}).*+(?:\n|\z)", "")


def report_lines(c: Column | str, shade: str | None = None) -> Column:
    """Trim every line, remove its escape sequences, and put exactly one space after a leading check mark.

    With ``shade`` the only marks to remove are that character.
    """
    blank = JS_BLANK_CLASS
    trimmed = F.array_join(F.transform(F.split(col(c), "\n", -1), js_trim), "\n")
    clean = strip_ansi(trimmed, "js") if shade is None else F.replace(trimmed, F.lit(shade), F.lit(""))
    return F.regexp_replace(clean, rf"(?md)^✓[{blank}]*+((?:.*[^{blank}\n])?)[{blank}]*$", "✓ $1")


def entry_class(c: Column | str) -> Column:
    """The part of an entry point before its first colon."""
    return F.substring_index(col(c), ":", 1)


def null_if_blank(c: Column | str) -> Column:
    """Stripped text, NULL where nothing is left."""
    return F.nullif(py_strip(c), F.lit(""))


def base_name(c: Column | str) -> Column:
    return F.substring_index(col(c), "/", -1)


def file_stem(c: Column | str, flavor: str = "python") -> Column:
    """File name without its extension, by the rule of each language's runner.

    ``java`` text before the first ``.java``; ``python`` without the last extension (a leading dot is part of the
    name); ``js`` without the first ``.js``; ``dir`` and ``cmake`` text before the first dot; ``cpp`` without a final
    ``.cpp``.
    """
    name = base_name(c)
    if flavor == "java":
        return F.substring_index(name, ".java", 1)
    if flavor == "python":
        return F.regexp_replace(name, r"(?s)\A(\.*[^.].*)\.[^.]*\z", "$1")
    if flavor == "js":
        return F.regexp_replace(name, r"(?s)\A(.*?)\.js", "$1")
    if flavor in ("dir", "cmake"):
        return F.substring_index(name, ".", 1)
    if flavor == "cpp":
        return F.regexp_replace(name, r"\.cpp\z", "")
    raise ValueError(f"unknown file name flavor {flavor!r}")


def pad_end(c: Column | str, width: int) -> Column:
    """Pad with spaces to ``width`` UTF-16 units; longer values stay whole (``rpad`` would cut them)."""
    value = col(c)
    units = (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int")
    return F.concat(value, F.repeat(F.lit(" "), F.greatest(F.lit(width) - units, F.lit(0))))


def pct2(c: Column | str) -> Column:
    """Two decimals and a percent sign, rounded on the exact binary value (``format_string`` rounds its decimal
    form half up instead)."""
    return F.concat(F.call_function("format_number", col(c), F.lit("0.00")), F.lit("%"))


def ratio_pct(part: Column | str, total: Column | str) -> Column:
    """``part / total * 100`` as DOUBLE, 0 where there is no total."""
    whole = col(total).cast("double")
    return F.when(whole > 0, col(part).cast("double") / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def status_icon(c: Column | str, style: str = "emoji") -> Column:
    passed, failed, other = STATUS_ICONS[style]
    status = col(c)
    return F.when(status == "PASSED", passed).when(status == "FAILED", failed).otherwise(other)
