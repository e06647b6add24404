"""Lists of string literals as Python writes them, read without Python.

The text is cut into tokens by one regex whose loops are possessive, so it is linear and does not recurse.  One fold over
the tokens' kinds, with a stack of open brackets, settles whether they are a list or tuple of strings and at which depth its
commas stand.  What is left is plain array work: the tokens between those commas are one item, and the escapes of each
token are put in their places piece by piece.
"""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from codetrials.functions.text import let

NUL = "\x00"  # is in no source text, so it can part tokens
DEEPEST = 200  # open brackets that Python's tokenizer takes

_PREFIX = "[rRuU]?+"
_STRINGS = [
    _PREFIX + r"'''(?:[^\\']|\\.|'(?!''))*+'''",
    _PREFIX + r'"""(?:[^\\"]|\\.|"(?!""))*+"""',
    _PREFIX + r"'(?!'')(?:[^\\'\n]|\\.)*+'",
    _PREFIX + r'"(?!"")(?:[^\\"\n]|\\.)*+"',
]
#: A string, a bracket or comma, blanks, a form feed, a joined line, a comment, a line end, or anything else.
TOKEN = "(?s)" + "|".join([*_STRINGS, r"[\[\](),]", r"[ \t]++", r"\f", r"\\\n", r"#[^\n]*+", r"\n", "."])
#: What an escape may be, longest first; a piece without a backslash is as it stands.
PIECE = r"(?s)[^\\]++|\\(?:[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)"
#: The escapes of one character, and what each stands for.
ESCAPES, MEANT = "\\'\"abfnrtv", "\\'\"\a\b\f\n\r\t\v"


def _kind(token: Column) -> Column:
    """One letter for a token: itself for a bracket or comma, S a string, B blanks, F a form feed, J a joined line, C a
    comment, N a line end, X anything else."""
    return (
        F.when(token.rlike(r"\A[rRuU]?(?s:'.*'|\".*\")\z") & (F.length(token) > 1), "S")
        .when(token.isin("[", "]", "(", ")", ","), token)
        .when(token == "\n", "N")
        .when(token == "\f", "F")
        .when(token == "\\\n", "J")
        .when(token.rlike(r"\A[ \t]+\z"), "B")
        .when(F.startswith(token, F.lit("#")), "C")
        .otherwise("X")
    )


def _core(kinds: Column) -> Column:
    """The depth at which the items of the list or tuple stand, -1 if the tokens are none of strings.

    Brackets outside that depth are parentheses around the whole, those inside it are parentheses around an item.
    """
    state = {
        "open": F.lit(""),  # the brackets that are open
        "last": F.lit("^"),  # the last token that counts
        "core": F.lit(-1),
        "done": F.lit(False),  # the list or tuple has been closed
        # where in its line, at depth 0: before the expression ^ at the start, B after blanks; > inside; after the
        # expression's line $ at the start, b after blanks, # after a comment
        "line": F.lit("^"),
        "joined": F.lit(False),  # the last token is a joined line
        "good": F.lit(True),
    }

    def step(s: Column, k: Column) -> Column:
        depth, last, core, done = F.length(s["open"]), s["last"], s["core"], s["done"]
        top = F.substring(s["open"], -1, 1)
        start = last.isin("^", "(", "[", ",")
        opens_list, opens, comma = k == "[", k == "(", k == ","
        closes_list, closes = k == "]", k == ")"
        counts = k.isin("S", "[", "]", "(", ")", ",")
        empty = closes & (last == "(")
        fits = (
            F.when(k == "S", (start | (last == "S")) & ~done)
            .when(opens, start & ~done & (depth < DEEPEST))
            .when(opens_list, last.isin("^", "(") & (core < 0) & ~done & (depth < DEEPEST))
            .when(comma, last.isin("S", ")") & ~done & ((core < 0) | (core == depth)))
            .when(closes_list, (top == "[") & (core == depth))
            .when(closes, (top == "(") & (~empty | ((core < 0) & ~done)) & ((last != ",") | (core == depth)))
            .otherwise(k != "X")
        )
        # at depth 0 an expression is one line, and begins where the line begins
        outside = depth == 0
        at = s["line"]
        fits = fits & ~(outside & counts & at.isin("B", "$", "b", "#"))
        line = (
            F.when(~outside | counts, F.lit(">"))
            .when(k == "N", F.when(last == "^", "^").otherwise("$"))
            .when((k == "B") & at.isin("^", "$"), F.when(at == "^", "B").otherwise("b"))
            .when((k == "F") & at.isin("B", "b"), F.when(at == "B", "^").otherwise("$"))
            .when((k == "C") & at.isin("$", "b"), "#")
            .when((k == "J") & (at == "^"), ">")
            .otherwise(at)
        )
        return F.struct(
            F.when(opens | opens_list, F.concat(s["open"], k))
            .when(closes | closes_list, F.substring(s["open"], F.lit(1), depth - 1))
            .otherwise(s["open"])
            .alias("open"),
            F.when(counts, k).otherwise(last).alias("last"),
            F.when(opens_list, depth + 1).when(empty | (comma & (core < 0)), depth).otherwise(core).alias("core"),
            (done | closes_list | empty | (closes & (core == depth))).alias("done"),
            line.alias("line"),
            (k == "J").alias("joined"),
            (s["good"] & fits).alias("good"),
        )

    def end(s: Column) -> Column:
        whole = s["good"] & (s["open"] == "") & ~s["joined"] & (s["line"] != "b") & (s["done"] | (s["core"] == 0))
        return F.when(whole, s["core"]).otherwise(-1)

    return F.aggregate(kinds, F.struct(*[v.alias(k) for k, v in state.items()]), step, end)


def _character(code: Column) -> Column:
    """The character of a hexadecimal code point; NULL beyond Unicode and for a surrogate, which UTF-8 cannot hold."""
    padded = F.lpad(code, 8, "0")
    good = (padded <= "0010ffff") & ~padded.between("0000d800", "0000dfff")
    return F.when(good, F.decode(F.unhex(padded), "UTF-32"))


def _unescaped(body: Column) -> Column:
    """The text of a string literal; NULL for a broken escape.  An escape that Python does not know is kept as written,
    and one by name is not read (NULL)."""

    def piece(p: Column) -> Column:
        mark = F.substring(p, 2, 1)
        digits = F.lower(F.substring(p, F.lit(3), F.length(p)))
        octal = F.lower(F.conv(F.substring(p, F.lit(2), F.length(p)), 8, 16))
        return (
            F.when(~F.startswith(p, F.lit("\\")), p)
            .when(mark.rlike("[0-7]"), _character(octal))
            .when(mark.isin("x", "u", "U"), F.when(F.length(p) > 2, _character(digits)))
            .when(mark == "N", F.lit(None).cast("string"))
            .when(mark == "\n", "")
            .when(F.contains(F.lit(ESCAPES), mark), F.translate(mark, ESCAPES, MEANT))
            .otherwise(p)
        )

    def whole(pieces: Column) -> Column:
        return F.when(~F.exists(pieces, lambda p: p.isNull()), F.array_join(pieces, ""))

    escaped = let(F.transform(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0)), piece), whole)
    return F.when(F.contains(body, F.lit("\\")), escaped).otherwise(body)


def _string(token: Column) -> Column:
    """The value of one string token."""

    def read(t: Column) -> Column:
        raw = F.lower(F.substring(t, 1, 1)) == "r"
        quoted = F.when(F.substring(t, 1, 1).rlike("[rRuU]"), F.substring(t, F.lit(2), F.length(t))).otherwise(t)

        def body(q: Column) -> Column:
            triple = F.startswith(q, F.lit("'''")) | F.startswith(q, F.lit('"""'))
            width = F.when(triple & (F.length(q) > 5), 3).otherwise(1)
            return F.substring(q, width + 1, F.length(q) - 2 * width)

        return let(let(quoted, body), lambda b: F.when(raw, b).otherwise(_unescaped(b)))

    return let(token, read)


_made: dict[tuple[object, str], Column] = {}


def string_list(text: Column | str) -> Column:
    """``ARRAY<STRING>`` of a Python list or tuple of string literals, NULL for any other text.

    As ``ast.literal_eval`` reads it, with comments, joined literals, raw and triple-quoted strings, parentheses and
    tuples without them; but for escapes by name (``\\N{...}``), which give NULL.  The expression is a large one: of a
    column given by its name it is made once.
    """
    if not isinstance(text, str):
        return _string_list(text)
    key = (SparkContext._active_spark_context, text)
    if key not in _made:
        _made[key] = _string_list(F.col(text))
    return _made[key]


def _string_list(text: Column) -> Column:
    def parsed(tokens: Column) -> Column:
        def listed(both: Column) -> Column:
            kinds, core = both["kinds"], both["core"]
            marked = F.zip_with(
                tokens, kinds, lambda t, k: F.when(k == ",", F.lit(NUL + ",")).when(k == "S", F.concat(F.lit(NUL + "S"), t)).otherwise("")
            )
            items = F.split(F.array_join(marked, ""), NUL + ",", -1)
            strings = F.transform(items, lambda item: F.transform(F.slice(F.split(item, NUL + "S", -1), 2, 1 << 30), _string))
            # a trailing comma, and an empty list, leave an item without strings
            filled = F.filter(strings, lambda s: F.size(s) > 0)
            bad = F.exists(filled, lambda s: F.exists(s, lambda x: x.isNull()))
            return F.when((core >= 0) & ~bad, F.transform(filled, lambda s: F.array_join(s, "")))

        kinds = F.transform(tokens, _kind)
        return let(let(kinds, lambda k: F.struct(k.alias("kinds"), _core(k).alias("core"))), listed)

    source = F.regexp_replace(F.ltrim(text, F.lit(" \t")), r"\r\n?", "\n")
    tokens = let(source, lambda s: F.when(~F.contains(s, F.lit(NUL)), F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))))
    return let(tokens, parsed)
