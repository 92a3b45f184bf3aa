"""SQL text for the DuckDB oracle: the same computations written as plain SQL.

These builders only assemble query strings; DuckDB runs them on the driver's parquet
views.  Each mirrors one column expression of ``quire.functions`` (regexes in RE2
syntax, lambdas as DuckDB list lambdas).
"""

from __future__ import annotations

from quire.functions import terms as TM
from quire.functions import text as T


def let(value_sql: str, name: str, body_sql: str) -> str:
    """Bind ``name`` to a value inside an expression (one-element list trick)."""
    return f"list_transform([{value_sql}], lambda {name}: {body_sql})[1]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{RE_S}+|{RE_S}+$', '', 'g')"


def clean_term(x: str) -> str:
    s = f"split_part({x}, '###end', 1)"
    s = f"replace({s}, '?', ' ?')"
    s = f"replace({s}, '( ?', '(?')"
    s = strip(s)
    s = f"replace({s}, '\\\\', '\\')"
    return f"regexp_replace({s}, '{RE_S}+', ' ', 'g')"


def split_ws(x: str) -> str:
    return f"list_filter(string_split_regex({strip(x)}, '{RE_S}+'), lambda t: t <> '')"


def normalize_vars(x: str) -> str:
    s = clean_term(x)
    s = f"replace(replace(replace({s}, '(', ' ( '), ')', ' ) '), '?', ' ?')"
    body = (
        "array_to_string(list_transform(toks, lambda t: CASE WHEN starts_with(t, '?') THEN '?x' || "
        "CAST(len(list_filter(list_slice(toks, 1, list_position(toks, t)), "
        "lambda y, j: starts_with(y, '?') AND list_position(toks, y) = j)) AS VARCHAR) ELSE t END), ' ')"
    )
    return let(split_ws(s), "toks", body)


def hamming(a: str, b: str) -> str:
    return (
        f"coalesce(list_sum(list_transform(range(1, greatest(length({a}), length({b})) + 1), "
        f"lambda i: CASE WHEN substr({a}, i, 1) = substr({b}, i, 1) THEN 0 ELSE 1 END)), 0)"
    )


def _cnt(s: str, ch: str) -> str:
    return f"(length({s}) - length(replace({s}, {ch}, '')))"


def jaccard(a: str, b: str) -> str:
    alphabet = f"list_distinct(string_split({a}, '') || string_split({b}, ''))"
    inter = f"coalesce(list_sum(list_transform(alph, lambda ch: least({_cnt(a, 'ch')}, {_cnt(b, 'ch')}))), 0)"
    union = f"coalesce(list_sum(list_transform(alph, lambda ch: greatest({_cnt(a, 'ch')}, {_cnt(b, 'ch')}))), 0)"
    body = f"CASE WHEN {union} = 0 THEN 1.0 ELSE CAST({inter} AS DOUBLE) / CAST({union} AS DOUBLE) END"
    return let(alphabet, "alph", body)


def part_examples_cte() -> str:
    return (
        "ex AS (SELECT p_partkey AS row_id, "
        "lower(p_type) || '/' || replace(p_brand, '#', '_') AS theory_file, "
        "replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) AS lemma_name, "
        "p_name AS template, "
        "p_type || ' (?' || replace(p_name, ' ', ' ?') || ') = ?' || split_part(p_name, ' ', 1) AS lemma_object "
        "FROM part)"
    )


def part_predictions_cte(task: str = "template", name: str = "pred") -> str:
    from quire.plans.driver import PREDICTION_OFFSETS

    vals = ", ".join(f"('{s}', {slot}, {o})" for s, slot, o in PREDICTION_OFFSETS)
    if task == "template":
        text = "'  ' || b.p_name || '  ###end ' || b.p_type"
    else:
        text = ("replace(b.p_type || ' (?' || replace(b.p_name, ' ', ' ?') || ') = ?' || "
                "split_part(b.p_name, ' ', 1), '?', '?v') || '###end'")
    return (
        f"{name} AS (SELECT a.p_partkey AS row_id, o.strategy, list({text} ORDER BY o.slot) AS candidates "
        f"FROM part a JOIN (VALUES {vals}) o(strategy, slot, off) ON TRUE "
        f"JOIN part b ON b.p_partkey = a.p_partkey + o.off GROUP BY a.p_partkey, o.strategy)"
    )


# --- regex classes matching Java's (?U) \s, \S and \w in RE2 syntax ----------
RE_S = "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{85}\\pZ]"
RE_NS = "[^\\t\\n\\x0B\\f\\r\\x1c-\\x1f\\x{85}\\pZ]"
RE_WCHARS = "\\pL\\p{Nl}\\p{Nd}\\pM\\p{Pc}"
RE_NAME = "([" + RE_WCHARS + "'']+)"  # '' is a quote inside a SQL literal
THM_CMD = "(" + "|".join(T.THEOREM_KINDS) + ")"
DEF_CMD = "(" + "|".join(T.DEFINITION_KINDS) + ")"


def ustrip(x: str) -> str:
    return f"regexp_replace({x}, '^{RE_S}+|{RE_S}+$', '', 'g')"


def usplit_ws(x: str) -> str:
    return f"list_filter(string_split_regex({ustrip(x)}, '{RE_S}+'), lambda t: t <> '')"


def theorem_name(x: str) -> str:
    quoted = f"(?s){THM_CMD}{RE_S}*\"(.*)\""
    named = f"(?s){THM_CMD}{RE_S}+(\\(.*\\){RE_S}+)?{RE_NAME}{RE_S}*(\\[.*\\])?:(.*)"
    return (f"CASE WHEN regexp_matches({x}, '{quoted}') THEN NULL "
            f"WHEN regexp_matches({x}, '{named}') THEN regexp_extract({x}, '{named}', 3) END")


def definition_name(x: str) -> str:
    head = f"(?s){DEF_CMD}{RE_S}+(\\(.*\\){RE_S}+)?{RE_NAME}{RE_S}*(\\[.*\\])?"
    tries = [f"nullif(regexp_extract({x}, '{head}{end}', 3), '')" for end in (":", "where", "=", "::")]
    tries.append(f"nullif(regexp_extract({x}, '(?s)datatype{RE_S}+''a{RE_S}+{RE_NAME}', 1), '')")
    tries.append(f"regexp_replace({usplit_ws(x)}[2], '^\"+|\"+$', '', 'g')")
    return "coalesce(" + ", ".join(tries) + ")"


def unquote_body(b: str) -> str:
    s = ustrip(b)
    return f"CASE WHEN regexp_matches({s}, '^\"[^\\n]*\"') THEN substr({s}, 2, length({s}) - 2) ELSE {s} END"


def split_lemma(x: str) -> tuple[str, str]:
    named = f"(?s)lemma ({RE_NS}+)?{RE_S}*(\\[{RE_NS}*\\])?:(.*)"
    plain = f"(?s)lemma{RE_S}*(.*)"
    name = f"CASE WHEN regexp_matches({x}, '{named}') THEN nullif(regexp_extract({x}, '{named}', 1), '') END"
    body = (f"CASE WHEN regexp_matches({x}, '{named}') THEN {unquote_body(f'regexp_extract({x}, {chr(39)}{named}{chr(39)}, 3)')} "
            f"WHEN regexp_matches({x}, '{plain}') THEN {unquote_body(f'regexp_extract({x}, {chr(39)}{plain}{chr(39)}, 1)')} END")
    return name, body


def parse_generated(x: str) -> tuple[str, str]:
    named = f"(?s)lemma ({RE_NS}+)?{RE_S}*(\\[{RE_NS}*\\])?:(.*)(\\{{EOS\\}})"
    plain = f"(?s)lemma{RE_S}*(.*)(\\{{EOS\\}})"
    has = f"contains({x}, '{{EOS}}')"
    name = f"CASE WHEN {has} AND regexp_matches({x}, '{named}') THEN nullif(regexp_extract({x}, '{named}', 1), '') END"
    body = (f"CASE WHEN NOT {has} THEN NULL "
            f"WHEN regexp_matches({x}, '{named}') THEN {unquote_body(f'regexp_extract({x}, {chr(39)}{named}{chr(39)}, 3)')} "
            f"WHEN regexp_matches({x}, '{plain}') THEN {unquote_body(f'regexp_extract({x}, {chr(39)}{plain}{chr(39)}, 1)')} END")
    return name, body


def spans_cte(src: str, keep: list[str], name: str = "st", own: str | None = None) -> str:
    """The spans that X1 cuts from the texts of ``src`` (columns ``keep`` and text): a fold over the
    lexemes.  ``own``: a list column of further commands."""
    from quire.operators.statements import CLOSE_CARTOUCHE, COMMANDS, LEXEME, OPEN_CARTOUCHE

    def one_of(x: str, values) -> str:
        return f"{x} IN ({', '.join(chr(39) + v + chr(39) for v in values)})"

    cols = ", ".join(keep)
    lexeme = LEXEME.replace("'", "''")
    word = "ltrim(substr(x.t, 2), ' ' || chr(9))"
    command = one_of(word, COMMANDS) + (f" OR coalesce(list_contains({own}, {word}), false)" if own else "")
    o, c = one_of("x.t", OPEN_CARTOUCHE), one_of("x.t", CLOSE_CARTOUCHE)
    enters = f"CASE WHEN {one_of('x.t', [chr(34), chr(92) + chr(34)])} THEN 1 WHEN {one_of('x.t', ['`', chr(92) + '`'])} THEN 2 WHEN x.t = '(*' THEN 3 WHEN {o} THEN 4 WHEN x.t = '{{*' THEN 5 ELSE 0 END"
    closes = f"CASE s.mode WHEN 1 THEN x.t = chr(34) WHEN 2 THEN x.t = '`' WHEN 3 THEN x.t = '*)' WHEN 4 THEN {c} WHEN 5 THEN x.t = '*}}' END"
    nests = f"CASE s.mode WHEN 3 THEN x.t = '(*' WHEN 4 THEN {o} ELSE false END"
    start = "{'mode': 0, 'depth': 0, 'i': 0::BIGINT, 't': '', 'cuts': []::BIGINT[]}"
    step = (f"{{'mode': CASE WHEN s.mode = 0 THEN {enters} WHEN {closes} AND s.depth = 1 THEN 0 ELSE s.mode END, "
            f"'depth': CASE WHEN s.mode = 0 THEN CASE WHEN ({enters}) = 0 THEN 0 ELSE 1 END WHEN {closes} THEN s.depth - 1 WHEN {nests} THEN s.depth + 1 ELSE s.depth END, "
            f"'i': x.i, 't': '', 'cuts': CASE WHEN s.mode = 0 AND starts_with(x.t, chr(10)) AND ({command}) THEN list_append(s.cuts, x.i) ELSE s.cuts END}}")
    cells = "list_transform(lex, lambda t, i: {'mode': 0, 'depth': 0, 'i': CAST(i AS BIGINT), 't': t, 'cuts': []::BIGINT[]})"
    kind = "CASE WHEN list_contains(cuts, a) THEN ltrim(substr(lex[a], 2), ' ' || chr(9)) END"
    keep_own = f", {own}" if own else ""
    return (
        f"{name}_lex AS (SELECT {cols}{keep_own}, regexp_extract_all(chr(10) || text, '{lexeme}') AS lex FROM {src} WHERE text <> ''), "
        f"{name}_cut AS (SELECT {cols}, lex, list_reduce({cells}, lambda s, x: {step}, {start}).cuts AS cuts FROM {name}_lex), "
        f"{name}_begin AS (SELECT *, CASE WHEN cuts[1] = 1 THEN cuts ELSE [1] || cuts END AS b FROM {name}_cut), "
        f"{name}_span AS (SELECT *, unnest(range(1, len(b) + 1)) AS k FROM {name}_begin), "
        f"{name} AS (SELECT {cols}, CAST(k - 1 AS INTEGER) AS pos, {kind} AS kind, "
        f"substr(array_to_string(lex[a:z - 1], ''), 2) || CASE WHEN z <= len(lex) THEN chr(10) ELSE '' END AS stmt "
        f"FROM (SELECT *, b[k] AS a, coalesce(b[k + 1], len(lex) + 1) AS z FROM {name}_span))"
    )


def statements_cte(name: str = "st") -> str:
    """The statements X1 cuts from the theory text built out of `documents`."""
    w = "regexp_extract(l, '^([^ ]*)', 1)"
    rest = f"substr(l, length({w}) + 2)"
    cmd = (f"CASE (k - 1) % 5 WHEN 0 THEN 'lemma ' || {w} || ': \"' || {rest} || '\"' "
           f"WHEN 1 THEN 'theorem \"' || l || '\"' "
           f"WHEN 2 THEN 'definition ' || {w} || ' where \"' || {rest} || '\"' "
           f"WHEN 3 THEN 'fun ' || {w} || ' :: \"' || {rest} || '\"' "
           f"ELSE 'text \\<open>' || l || '\\<close>' END")
    return (
        f"{name}_thy AS (SELECT source || '/T' || CAST(doc_id AS VARCHAR) AS theory_file, source AS session, doc_id AS block, "
        f"array_to_string(list_transform(string_split(text, chr(10)), lambda l, k: {cmd}), chr(10)) AS text FROM documents), "
        + spans_cte(f"{name}_thy", ["theory_file", "session", "block"], name)
    )


def last_block_cte(src: str = "st", name: str = "lb", key: str = "theory_file") -> str:
    return (f"{name} AS (SELECT {src}.* FROM {src} JOIN (SELECT {key}, max(block) AS block FROM {src} "
            f"GROUP BY {key}) m USING ({key}, block))")


# --- terms (token lists of structs) -------------------------------------------

def tk(kind: str, name: str = "NULL", typ: str = "NULL") -> str:
    return f"{{'kind': '{kind}', 'name': CAST({name} AS VARCHAR), 'type': CAST({typ} AS VARCHAR)}}"


def keep_const(n: str) -> str:
    return "(" + " OR ".join(f"starts_with({n}, '{p}')" for p in TM.KEEP_PREFIXES) + ")"


def part_terms_cte(name: str = "pt") -> str:
    app = tk("app")
    c1 = tk("const", "'Part.' || w1", "'nat => nat'")
    t2 = "CASE ar WHEN 0 THEN 'nat' WHEN 1 THEN 'nat => nat' ELSE 'nat => nat => nat' END"
    t2 = t2.replace("CASE ar ", "CASE WHEN ar = 1 AND k = 9 THEN '((nat => nat) => nat) => nat' ELSE CASE ar ") + " END"
    c2 = tk("const", "'Part.' || CASE WHEN k = 5 THEN w1 ELSE w2 END", t2)
    x = f"CASE WHEN m = 0 THEN {tk('bound', chr(39) + '0' + chr(39), chr(39) + 'nat' + chr(39))} ELSE {tk('var', chr(39) + 'x' + chr(39), chr(39) + 'nat' + chr(39))} END"
    y = tk("var", "'y'", "'nat'")
    eq = tk("const", "CASE WHEN m = 2 THEN 'Pure.eq' ELSE 'HOL.eq' END", "'nat => nat => bool'")
    rhs = (f"CASE WHEN p_partkey % 8 = 3 THEN [{tk('const', chr(39) + 'HOL.undefined' + chr(39), chr(39) + 'nat' + chr(39))}] "
           f"WHEN ar = 0 THEN [{c2}] WHEN ar = 1 THEN [{app}, {c2}, {x}] ELSE [{app}, {app}, {c2}, {x}, {y}] END")
    undef = tk("const", "'HOL.undefined'", "'nat'")
    body = f"[{app}, {app}, {eq}, {app}, {c1}, CASE WHEN k = 13 THEN {undef} ELSE {x} END] || {rhs}"
    tp = tk("const", "'HOL.Trueprop'", "'bool => prop'")
    prefix = (f"CASE WHEN m = 0 THEN [{app}, {tp}, {app}, {tk('const', chr(39) + 'HOL.All' + chr(39), chr(39) + '(nat => bool) => bool' + chr(39))}, "
              f"{tk('abs', chr(39) + 'x' + chr(39), chr(39) + 'nat' + chr(39))}] WHEN m = 2 THEN [] WHEN k = 7 THEN [{app}, {app}, "
              f"{tk('const', chr(39) + 'Pure.imp' + chr(39), chr(39) + 'prop => prop => prop' + chr(39))}, {app}, {tp}, "
              f"{tk('var', chr(39) + 'p' + chr(39), chr(39) + 'bool' + chr(39))}, {app}, {tp}] ELSE [{app}, {tp}] END")
    nm = ("p_brand || '.' || replace(p_name, ' ', '_') || '_' || CAST(p_partkey AS VARCHAR) || "
          "CASE WHEN p_partkey % 13 = 0 THEN '_def' ELSE '' END")
    return (f"{name} AS (SELECT p_partkey AS term_id, {nm} AS name, ({prefix}) || ({body}) AS tokens FROM "
            f"(SELECT *, split_part(p_name, ' ', 1) AS w1, regexp_extract(p_name, '[^ ]*$') AS w2, "
            f"p_size % 3 AS ar, p_partkey % 4 AS m, p_partkey % 16 AS k FROM part))")


def _rank(keys: str, k: str) -> str:
    return (f"len(list_filter(list_slice({keys}, 1, list_position({keys}, {k})), "
            f"lambda y, j: y IS NOT NULL AND list_position({keys}, y) = j))")


def _nabs(ts: str, i: str) -> str:
    return f"len(list_filter(list_slice({ts}, 1, {i} - 1), lambda q: q.kind = 'abs'))"


def abstract(ts: str, poly: bool = False) -> str:
    hole = f"(t.kind = 'const' AND NOT {keep_const('t.name')})"
    hkey = "t.name" if poly else "concat_ws('::', t.name, t.type)"
    hk = f"list_transform(ts, lambda t: CASE WHEN {hole} THEN {hkey} END)"
    vk = "list_transform(ts, lambda t: CASE WHEN t.kind = 'var' THEN concat_ws('::', t.name, t.type) END)"
    body = (f"list_transform(ts, lambda t, i: CASE "
            f"WHEN {hole} THEN {tk('var', chr(39) + '?H' + chr(39) + ' || CAST(' + _rank('hk', 'hk[i]') + ' AS VARCHAR)', 't.type')} "
            f"WHEN t.kind = 'var' THEN {tk('free', chr(39) + 'x_' + chr(39) + ' || CAST(' + _rank('vk', 'vk[i]') + ' AS VARCHAR)', 't.type')} "
            f"WHEN t.kind = 'abs' THEN {tk('abs', chr(39) + 'y_' + chr(39) + ' || CAST(' + _nabs('ts', 'i') + ' AS VARCHAR)', 't.type')} "
            f"ELSE t END)")
    return let(ts, "ts", let(hk, "hk", let(vk, "vk", body)))


def canon(ts: str, kind: str = "var", typed: bool = True) -> str:
    k = f"list_transform(ts, lambda t: CASE WHEN t.kind = '{kind}' THEN concat_ws('::', t.name, t.type) END)"
    body = (f"list_transform(ts, lambda t, i: CASE "
            f"WHEN t.kind = '{kind}' THEN {tk('free', chr(39) + 'x_' + chr(39) + ' || CAST(' + _rank('ck', 'ck[i]') + ' AS VARCHAR)', 't.type')} "
            f"WHEN t.kind = 'abs' THEN {tk('abs', chr(39) + 'y_' + chr(39) + ' || CAST(' + _nabs('ts', 'i') + ' AS VARCHAR)', 't.type')} "
            f"ELSE t END)")
    out = let(ts, "ts", let(k, "ck", body))
    if not typed:
        out = f"list_transform({out}, lambda t: {{'kind': t.kind, 'name': t.name, 'type': CAST(NULL AS VARCHAR)}})"
    return out


def render(ts: str) -> str:
    return (f"array_to_string(list_transform({ts}, lambda t: CASE t.kind WHEN 'app' THEN '$' "
            f"WHEN 'abs' THEN '%' || t.name || '.' WHEN 'bound' THEN 'B' || t.name ELSE t.name END), ' ')")


def types_of(ts: str) -> str:
    return f"array_to_string(list_transform({ts}, lambda t: coalesce(t.type, '-')), ',')"


def strip_trueprop(ts: str) -> str:
    return (f"CASE WHEN len({ts}) >= 2 AND {ts}[1].kind = 'app' AND {ts}[2].kind = 'const' AND {ts}[2].name = 'HOL.Trueprop' "
            f"THEN list_slice({ts}, 3, len({ts})) ELSE {ts} END")


def arity(typ: str) -> str:
    """Arrows left after bracketed parts are taken out, innermost first (the stand-ins nest at most twice)."""
    t = typ
    for _ in range(3):
        t = f"regexp_replace({t}, '\\([^()]*\\)', 'T', 'g')"
    return f"CAST((length({t}) - length(replace({t}, '=>', ''))) / 2 AS INTEGER)"


def holes(tpl: str) -> str:
    """Distinct holes by first occurrence, with the type and arity met there."""
    hs = f"list_filter({tpl}, lambda t: t.kind = 'var' AND starts_with(t.name, '?H'))"
    names = "list_transform(hs, lambda t: t.name)"
    firsts = "list_filter(hs, lambda p, j: list_position(nm, p.name) = j)"
    body = f"list_transform({firsts}, lambda p: {{'hole': p.name, 'type': p.type, 'arity': {arity('p.type')}}})"
    return let(hs, "hs", let(names, "nm", body))


def well_typed(tpl: str) -> str:
    hs = f"list_filter({tpl}, lambda t: t.kind = 'var' AND starts_with(t.name, '?H'))"
    return f"len(list_distinct(list_transform({hs}, lambda t: t.name))) = len(list_distinct(list_transform({hs}, lambda t: t.name || ' ' || t.type)))"


def outside_abs(ts: str) -> str:
    """For every token (1-based i): not covered by an abs node j < i whose running
    balance has not dropped below zero."""
    return (f"list_transform({ts}, lambda t, i: NOT coalesce(list_bool_or(list_transform(range(1, i), lambda j: "
            f"{ts}[j].kind = 'abs' AND list_min(list_transform(range(j, i), lambda mm: list_sum(list_transform("
            f"list_slice({ts}, j, mm), lambda q: CASE q.kind WHEN 'app' THEN 1 WHEN 'abs' THEN 0 ELSE -1 END)))) >= 0)), false))")


def leaf_constants(ts: str) -> str:
    z = f"list_zip({ts}, {outside_abs(ts)})"
    return (f"list_transform(list_filter({z}, lambda e: e[1].kind = 'const' AND e[2] AND e[1].name <> '_type_constraint_'), "
            f"lambda e: e[1].name)")
