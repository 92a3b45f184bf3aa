"""The outer syntax against a plain scanner of characters; commands of theories' own."""

import random
import re

import pytest

from quire.operators import statements as ST

LINE = re.compile(r"[ \t]*([A-Za-z0-9_']*)")
ATOMS = ["\n", "\n", "\nlemma", "\n  by", "\nlemmax", " ", '"', '"', "`", '\\"', "\\\\", "\\", "(*", "*)", "(*)", "*", "(", "{*", "*}", "‹", "›", "\\<open>", "\\<close>", "x", "lemma", "é", "\n\tfun'"]


def spans(text: str, commands) -> list[str]:
    """The spans of a text, character by character."""
    cuts, stack, depth, i = [0], None, 0, 0

    def word(at):
        return LINE.match(text, at)

    while i < len(text):
        two = text[i : i + 2]
        opening = text.startswith("\\<open>", i) or text[i] == "‹"
        closing = text.startswith("\\<close>", i) or text[i] == "›"
        size = 7 if text.startswith("\\<open>", i) else 8 if text.startswith("\\<close>", i) else 2 if two in ("(*", "*)", "{*", "*}", '\\"', "\\\\", "\\`") else 1
        if stack is None:
            if text[i] == "\n":
                m = word(i + 1)
                if m[1] in commands:
                    cuts.append(i + 1)
                size = m.end() - i
            elif two in ('\\"', "\\`"):
                stack = two[1]
            elif text[i] in '"`':
                stack = text[i]
            elif two in ("(*", "{*"):
                stack, depth = two, 1
            elif opening:
                stack, depth = "‹", 1
        elif stack in '"`':
            stack = None if text[i] == stack and size == 1 else stack
        elif stack == "{*":
            stack = None if two == "*}" else stack
        elif stack == "(*":
            depth += (two == "(*") - (two == "*)")
        else:
            depth += opening - closing
        if stack in ("(*", "‹") and depth == 0:
            stack = None
        i += size
    return [text[a:b] for a, b in zip(cuts, cuts[1:] + [len(text)])]


@pytest.mark.parametrize("chunk", [256, 2])
def test_random_nesting_equals_the_plain_scanner(spark, monkeypatch, chunk):
    monkeypatch.setattr(ST, "_CUTS", chunk)
    rnd = random.Random(chunk)
    texts = ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(1, 60))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in ST.split_statements(df).collect():
        got.setdefault(r["id"], []).append((r["pos"], r["kind"], r["stmt"]))
    for i, text in enumerate(texts):
        rows = sorted(got[i], key=lambda r: r[0])
        assert [r[2] for r in rows] == spans(text, ST.COMMANDS), text
        assert [r[0] for r in rows] == list(range(len(rows)))
        for n, (_, kind, stmt) in enumerate(rows):
            first = LINE.match(stmt)[1]
            assert kind == (first if first in ST.COMMANDS else None) and (kind or n == 0)


def test_nested_delimiters(spark):
    text = ('(* lemma\nlemma (* deep\nlemma *)\nlemma *)\nlemma a: "x\nlemma \\"\nlemma"\n'
            "text \\<open>\nlemma ‹\nlemma› \"\nlemma\\<close>\nfun `\nfun \\`\nfun`\nML {* (*\nlemma *}\nby simp\n\"\nlemma not closed")
    th = spark.createDataFrame([("T", text), ("E", ""), ("N", None)], "theory_file string, text string")
    rows = ST.split_statements(th).orderBy("pos").collect()
    assert [r["kind"] for r in rows] == [None, "lemma", "text", "fun", "ML", "by"]
    assert "".join(r["stmt"] for r in rows) == text


def test_own_commands_reach_importing_theories(spark):
    head = "theory {n}\n  imports {i}\n  keywords {k}\nbegin\n"
    body = "alpha one\nbeta two\ngamma three\nminor four\nquasi five\n"
    rows = [
        ("s/A", head.format(n="A", i="Main", k='"alpha" :: thy_decl') + body),
        ("s/B", head.format(n="B", i='"../s/A" C', k='"beta" "beta2" :: thy_goal and "minor" and "quasi" :: quasi_command') + body),
        ("s/C", "theory C imports HOL.B begin\n" + body),  # imports in a circle end
        ("s/D", "(* theory X keywords \"gamma\" :: diag begin *) theory D imports \"S.A\" begin\n" + body),
        ("s/E", body),  # no header
    ]
    th = spark.createDataFrame(rows, "theory_file string, text string")
    kinds = {}
    for r in ST.split_with_own_commands(th).orderBy("theory_file", "pos").collect():
        kinds.setdefault(r["theory_file"], []).append(r["kind"])
    own = lambda t: [k for k in kinds[t] if k in ("alpha", "beta", "gamma", "minor", "quasi")]
    assert [own(t) for t, _ in rows] == [["alpha"], ["alpha", "beta"], ["alpha", "beta"], ["alpha"], []]
    headers = {r["name"]: r for r in ST.theory_headers(th).collect()}
    assert headers["B"]["imports"] == ["A", "C"] and headers["B"]["commands"] == ["beta", "beta2"]
    assert headers["D"]["commands"] == []
