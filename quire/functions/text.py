"""Column expressions over statement text: cleaning, variable normalisation, names, paths.

All are built-in Spark expressions (whole-stage codegen, no Python in the hot path).
Regexes follow Python ``re`` semantics where the statement tooling relied on them:
``(?s)`` for DOTALL, ``(?U)`` for Unicode ``\\w``/``\\s``, and ``\\z`` for end of text
(Java's ``$`` also matches before a final newline).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.terms import let

# ---------------------------------------------------------------------------
# Fixed values (must equal the statement tooling's for equal results)
# ---------------------------------------------------------------------------
# Prompt and generation markers, in the order they appear in a prompt.
SYMBOLS_MARK = "###symbols\n"
TYPE_MARK = "::::"
DEFS_MARK = "\n###defs\n"
OUTPUT_MARK = "\n###output\n"
SEP_MARK = "\n\n"
EOS_MARK = "###end"
# End mark of a generated statement in the older parse format.
GEN_EOS_MARK = "{EOS}"
# Command kinds of theorem statements.
THEOREM_KINDS = ["theorem", "lemma"]
# Command kinds of definitions.
DEFINITION_KINDS = [
    "definition", "fun", "primrec", "primcorec", "datatype", "codatatype", "function",
    "typedecl", "typedef", "type_synonym", "record", "inductive", "coinductive",
    "abbreviation", "class", "inductive_set", "consts",
]
# Statement patterns, tried in this order; {cmd} is the command alternation.
# Theorem names (X2): a quoted statement has no name; otherwise group 3.
THEOREM_PATTERNS = [
    r'{cmd}\s*"(.*)"',
    r"{cmd}\s+(\(.*\)\s+)?([\w']+)\s*(\[.*\])?:(.*)",
]
# Definition names (X3): group 3 of the first four, group 1 of the last.
DEFINITION_PATTERNS = [
    r"{cmd}\s+(\(.*\)\s+)?([\w']+)\s*(\[.*\])?:",
    r"{cmd}\s+(\(.*\)\s+)?([\w']+)\s*(\[.*\])?where",
    r"{cmd}\s+(\(.*\)\s+)?([\w']+)\s*(\[.*\])?=",
    r"{cmd}\s+(\(.*\)\s+)?([\w']+)\s*(\[.*\])?::",
    r"datatype\s+'a\s+([\w']+)",
]
# Split of a statement into name and body (X4): named form, then plain form.
LEMMA_PATTERNS = [
    r"lemma (\S+)?\s*(\[\S*\])?:(.*)",
    r"lemma\s*(.*)",
]
# Same for generated text that must end with the generation mark.
GENERATED_PATTERNS = [
    r"lemma (\S+)?\s*(\[\S*\])?:(.*)(\{EOS\})",
    r"lemma\s*(.*)(\{EOS\})",
]
# A body in quotes: starts with a quote and has another on its first line.
QUOTED_BODY = '^"[^\n]*"'
# ---------------------------------------------------------------------------

# Python's str whitespace: Java's Unicode \s plus the separators \x1c-\x1f
_WS_CLASS = r"[\s\x1c-\x1f]"
_WS = r"(?U)" + _WS_CLASS + "+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing (Unicode) whitespace."""
    return F.regexp_replace(_col(c), r"(?U)^" + _WS_CLASS + r"+|" + _WS_CLASS + r"+\z", "")


def py_split_ws(c) -> Column:
    """Python ``str.split()``: whitespace runs as separator, no empty tokens."""
    return F.filter(F.split(py_strip(c), _WS), lambda t: t != F.lit(""))


def cut_eos(c, *, mark: str = EOS_MARK) -> Column:
    """Text before the first end mark (whole text when there is none)."""
    return F.substring_index(_col(c), mark, 1)


def clean_term(c) -> Column:
    """Cut at the end mark; ``?`` -> `` ?``; ``( ?`` -> ``(?``; strip;
    two backslashes -> one; whitespace runs -> one space."""
    x = cut_eos(c)
    x = F.replace(x, F.lit("?"), F.lit(" ?"))
    x = F.replace(x, F.lit("( ?"), F.lit("(?"))
    x = py_strip(x)
    x = F.replace(x, F.lit("\\\\"), F.lit("\\"))
    return F.regexp_replace(x, _WS, " ")


def clean_prediction(c) -> Column:
    """First line of a generated text, then E2."""
    return clean_term(F.substring_index(_col(c), "\n", 1))


def normalize_vars(c) -> Column:
    """E2, pad brackets, split on whitespace, rename every token starting with
    ``?`` to ``?x1, ?x2, ...`` by first occurrence, join with one space.

    ``?x,`` and ``?x`` are different tokens, as in the original.
    """
    x = clean_term(c)
    x = F.replace(x, F.lit("("), F.lit(" ( "))
    x = F.replace(x, F.lit(")"), F.lit(" ) "))
    x = F.replace(x, F.lit("?"), F.lit(" ?"))

    def renamed(toks):
        variables = F.array_distinct(F.filter(toks, lambda t: t.startswith("?")))
        return let(variables, lambda vs: F.transform(
            toks,
            lambda t: F.when(t.startswith("?"), F.concat(F.lit("?x"), F.array_position(vs, t).cast("string")))
            .otherwise(t),
        ))

    return F.array_join(let(py_split_ws(x), renamed), " ")


# --- statement names -------------------------------------------------------

_FLAGS = "(?sU)"  # DOTALL, and Unicode \w / \s as in Python 3 str patterns
_THM_CMD = "(" + "|".join(THEOREM_KINDS) + ")"
_DEF_CMD = "(" + "|".join(DEFINITION_KINDS) + ")"


def _pat(p: str, cmd: str = "") -> str:
    return _FLAGS + p.replace("{cmd}", cmd)


def theorem_name(c) -> Column:
    """Name of a theorem statement, else NULL.

    First pattern that hits wins: ``kw "..."`` -> NULL; ``kw (loc)? name [attrs]? : body``
    -> name; anything else -> NULL.  The bracket groups are greedy, so
    ``lemma (in c) foo: "f (x) y: z"`` gives ``y``.
    """
    s = _col(c)
    quoted, named = (_pat(p, _THM_CMD) for p in THEOREM_PATTERNS)
    return (
        F.when(s.rlike(quoted), F.lit(None).cast("string"))
        .when(s.rlike(named), F.regexp_extract(s, named, 3))
        .otherwise(F.lit(None).cast("string"))
    )


def definition_name(c) -> Column:
    """Name of a definition.

    Patterns ``:``, ``where``, ``=``, ``::`` after ``kw (loc)? name [attrs]?`` in that
    order, then ``datatype 'a name``; else the second word without outer quotes.
    ``definition foo :: nat`` hits ``:`` first.  A one-word input gives NULL.
    """
    s = _col(c)
    *heads, datatype = (_pat(p, _DEF_CMD) for p in DEFINITION_PATTERNS)
    tries = [F.nullif(F.regexp_extract(s, p, 3), F.lit("")) for p in heads]
    tries.append(F.nullif(F.regexp_extract(s, datatype, 1), F.lit("")))
    second = F.try_element_at(py_split_ws(s), F.lit(2))
    fallback = F.regexp_replace(second, r'^"+|"+\z', "")
    return F.coalesce(*tries, fallback)


def _unquote_body(body: Column) -> Column:
    """Strip, then drop first and last character when the body starts with a quote
    and has another quote on its first line (the test is not anchored at the end)."""
    b = py_strip(body)
    return F.when(b.rlike(QUOTED_BODY), F.substring(b, F.lit(2), F.length(b) - 2)).otherwise(b)


def _name_and_body(s: Column, patterns: list[str], need: Column | None = None) -> Column:
    named, plain = (_pat(p) for p in patterns)
    ok = need if need is not None else F.lit(True)
    name = F.when(ok & s.rlike(named), F.nullif(F.regexp_extract(s, named, 1), F.lit("")))
    body = (
        F.when(~ok, F.lit(None).cast("string"))
        .when(s.rlike(named), _unquote_body(F.regexp_extract(s, named, 3)))
        .when(s.rlike(plain), _unquote_body(F.regexp_extract(s, plain, 1)))
    )
    return F.struct(name.alias("name"), body.alias("body"))


def split_lemma(c) -> Column:
    """Statement -> struct(name, body).  Name is ``\\S+`` (``foo[simp]:`` gives
    ``foo[simp]``); unnamed statements give name NULL; non-lemmas give NULLs."""
    return _name_and_body(_col(c), LEMMA_PATTERNS)


def parse_generated(c) -> Column:
    """As X4 but the text must carry the ``{EOS}`` mark (else both NULL); the
    body ends at the last mark."""
    s = _col(c)
    return _name_and_body(s, GENERATED_PATTERNS, s.contains(GEN_EOS_MARK))


# --- keys, paths and names ---------------------------------------------------

def qualified_def_key(theory, name) -> Column:
    """``theory.name``; a theory path with ``/`` contributes its second segment."""
    t = _col(theory)
    thy = F.when(t.contains("/"), F.split(t, "/").getItem(1)).otherwise(t)
    return F.concat(thy, F.lit("."), _col(name))


def short_theorem_name(c) -> Column:
    """Last dotted segment, cut at the first ``(``."""
    return F.substring_index(F.substring_index(_col(c), ".", -1), "(", 1)


def project_path(c) -> Column:
    """All but the last ``/`` segment; unchanged without ``/``."""
    return F.regexp_replace(_col(c), r"/[^/]*\z", "")


def path_dir(c) -> Column:
    """X9 (dir): empty without ``/``."""
    x = _col(c)
    return F.when(x.contains("/"), project_path(x)).otherwise(F.lit(""))


def path_base(c) -> Column:
    """X9 (base): last ``/`` segment."""
    return F.substring_index(_col(c), "/", -1)


def import_name(c) -> Column:
    """``HOL[-dir parts joined by -].base``."""
    d = path_dir(c)
    session = F.concat_ws("-", F.lit("HOL"), F.nullif(F.replace(d, F.lit("/"), F.lit("-")), F.lit("")))
    return F.concat(session, F.lit("."), path_base(c))


def safe_name(c) -> Column:
    """X11: runs of non-word characters -> ``_``, outer ``_`` removed."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)\W+", "_"), r"^_+|_+\z", "")


def one_line(c) -> Column:
    """Newlines -> spaces."""
    return F.replace(_col(c), F.lit("\n"), F.lit(" "))


def run_id(model, dataset, config, label=None) -> Column:
    """``{dataset}-{config}-{model}[-{label}]`` with the last ``/`` segment of
    each name; an empty label is left out."""
    lab = F.nullif(_col(label), F.lit("")) if label is not None else F.lit(None).cast("string")
    return F.concat_ws(
        "-", F.substring_index(_col(dataset), "/", -1), _col(config), F.substring_index(_col(model), "/", -1), lab
    )
