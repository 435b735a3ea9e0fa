"""Scans of LaTeX, math spans, MathML and model output against stated behaviour and slow ways."""

from __future__ import annotations

import random

import pytest

from quireframe.functions import latex, markup, mathml, mathspan
from quireframe.operators import assembly

@pytest.mark.parametrize(
    ("text", "bodies"),
    [
        ("a $x$ b", ["x"]), ("$$x$$", ["x"]), ("$$ $$", [" "]), ("$$$$", [""]), ("$$x$y$$", ["x$y"]), (r"\[x\] \(y\)", ["x", "y"]), (r"\[x", []), (r"\$5 and $x$", ["x"]), ("$5 and $6", ["5 and "]), ("$a\nb$", []), (r"$a\$", []),
        ("$a$$", []), ("$$a$", []), ("$$ a", []), ("$ $", [" "]), (r"\(a\] b\)", [r"a\] b"]), ("$$a\nb$$ $c$", ["a\nb", "c"]), ("x$", []), ("", []), ("$a$b$c$", ["a", "c"]),
    ],
)
def test_math_spans(text, bodies):
    assert [s.body for s in mathspan.spans(text)] == bodies


def test_math_spans_tile_the_text():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(["$", "$", "$$", "\\", "\\[", "\\]", "\\(", "\\)", "a", " ", "\n"]) for _ in range(rng.randrange(14)))
        found = mathspan.spans(text)
        assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))
        assert all(text[s.start : s.end] in (f"${s.body}$", f"$${s.body}$$", f"\\[{s.body}\\]", f"\\({s.body}\\)") for s in found)
        assert mathspan.replaced(text, lambda s, text=text: text[s.start : s.end]) == text


@pytest.mark.parametrize(
    ("text", "codes"),
    [
        (r"\frac{1}{2}", []), (r"\frac{}{2}", ["EMPTY_FRACTION_OPERAND"]), (r"\dfrac {1} { }", ["EMPTY_FRACTION_OPERAND"]), (r"\frac{a^{2}}{}", []), (r"\sqrt[3]{ }", ["EMPTY_RADICAND"]), ("a_{}", ["EMPTY_SCRIPT_OPERAND"]),
        ("v_{平均}", ["UNICODE_TEXT_IN_SCRIPT"]), (r"v_{\text{平均}}", []), (r"v_{\text 平}", []), (r"\left\{ a \right.", []), (r"\{a", []), ("{a", ["UNMATCHED_DELIMITER"]), ("}{", ["UNMATCHED_DELIMITER"]), (r"\begin{m} a", ["UNMATCHED_ENVIRONMENT"]), ("a\x01", ["CONTROL_CHARACTER"]),
    ],
)
def test_latex_faults(text, codes):
    assert [c for c, found in latex.faults(text).items() if found] == codes


def test_repeats_equal_trying_all_places():
    rng = random.Random(7)
    for _ in range(300):
        unit = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 70)))
        text = "".join(rng.choice("ab") for _ in range(rng.randrange(20))) + unit * rng.randrange(1, 7) + "c" * rng.randrange(5)
        slow = any(text[i : i + n] * 5 == text[i : i + 5 * n] for n in range(8, 65) for i in range(len(text) - 5 * n + 1))
        assert latex.repeats(text) == slow, text


def test_marks_only():
    for text in ("( )", "·•", r"\cdot", r"^\circ", r"\circ", r"\bullet\quad\dots", "，。"):
        assert latex.marks_only(text), text
    for text in ("", "x", r"\cdot\cdot", r"\bullet\quad", "1."):
        assert not latex.marks_only(text), text


def test_structural_verdicts():
    wrap = lambda x: f'<m:math xmlns:m="m">{x}</m:math>'
    v = mathml.verdict
    assert v(wrap("<m:mfrac><m:mi>a</m:mi><m:mi>b</m:mi></m:mfrac>"), r"\frac{a}{b}") == ("VALID", [])
    assert v(wrap("<m:mfrac><m:mi>a</m:mi></m:mfrac>"), None) == ("SUSPICIOUS", ["EMPTY_DENOMINATOR", "EMPTY_REQUIRED_OPERAND", "INCOMPLETE_STRUCTURE"])
    assert v("<math", None)[0] == v(wrap("<m:mrow/>"), None)[0] == v(None, None)[0] == v(None, "{a")[0] == v(None, r"\begin{a}x")[0] == "INVALID"
    assert v(wrap("<m:mo>,</m:mo>"), None) == ("NON_FORMULA_CONTENT", ["PUNCTUATION_FRAGMENT"])
    assert v(wrap("<m:mi>力</m:mi>"), None) == ("SUSPICIOUS", ["TEXT_ONLY_FRAGMENT"]) and v(wrap("<m:mi>力</m:mi>"), None, referenced=False)[0] == "NON_FORMULA_CONTENT"
    assert v(None, "(", "omml") == ("NON_FORMULA_CONTENT", ["PUNCTUATION_FRAGMENT"]) and v(None, "$$ $$") == ("SUSPICIOUS", ["EMPTY_LATEX"])
    assert mathml.semantically_empty(wrap("<m:mrow><m:mi> </m:mi></m:mrow>")) and not mathml.semantically_empty(wrap("<m:mspace/>")) and not mathml.semantically_empty("<math")


def test_model_output_is_cleaned():
    assert markup.without_math("a $x$ b \\[y\\]") == ("a  b ", 2)
    assert markup.unwrapped("cost $5 and $6, \\(x\\), $a_1$, $$y$$") == ("cost $5 and $6, x, a_1, y", 3)
    assert markup.unwrapped("$sin x$") == ("sin x", 1) and markup.unwrapped(None) == (None, 0)
    assert markup.bare_formula("```latex\n\\[ $x$ \\]\n```") == "x" and markup.bare_formula("$a$ and $b$") == "$a$ and $b$" and markup.bare_formula("\\[ x") == "\\[ x"
    assert markup.is_markdown("two words") and markup.is_markdown("$x$") and markup.is_markdown("x 速度") and not markup.is_markdown(r"\text{two words} + \frac{a}{b}")
    assert markup.document_id("a:b  c.", "f" * 64) == "a_b_c__ffffffffffff" and markup.document_id("con", "0" * 64).startswith("document_con__") and markup.document_id(" ..", "0" * 64).startswith("document__")
    assert markup.canonical({"b": 1, "a": [1, "é"]}) == '{"a":[1,"é"],"b":1}'


def test_duplicate_text_depends_on_what_is_retained(spark):
    rows = [(1, "a", 1, "w x y z", 0, 0, 100, 100), (1, "b", 2, "x y", 10, 10, 50, 50), (1, "c", 3, "y", 10, 10, 20, 20), (1, "d", 4, "q", 10, 10, 20, 20), (2, "e", 1, "y", 10, 10, 20, 20), (1, "f", 5, "", 1, 1, 2, 2), (1, "g", 6, "x y", 60, 10, 140, 50)]
    df = spark.createDataFrame(rows, "page long, region string, ord int, text string, x0 long, y0 long, x1 long, y1 long")
    assert {tuple(r) for r in assembly.duplicate_text(df).collect()} == {("b", "a"), ("c", "a")}


def test_scores_go_to_their_answers(spark):
    rows = [
        (1, 1, "text", "Question (5分)", 0, 0, 100, 10), (1, 2, "formula", "$$\nx\n$$", 40, 0, 90, 10), (1, 3, "formula", "$$\ny\n$$", 0, 20, 50, 30), (1, 4, "formula_number", "（3 分）", 60, 20, 90, 30),
        (1, 5, "text", "far", 0, 40, 50, 50), (1, 6, "formula_number", "(2分)", 60, 80, 90, 90),
    ]
    df = spark.createDataFrame(rows, "page long, ord int, label string, content string, x0 long, y0 long, x1 long, y1 long")
    got = [r["content"] for r in assembly.score_rows(df).orderBy("ord").collect()]
    assert got == ["Question $x$ (5分)", "", "$y$ （3 分）", "", "far", "(2分)"]


def test_lexical_keys(spark):
    rows = [(r"v = 5 ~\mathrm{m/s}", r"v=5\unit{m/s}"), (r"f^{\prime}", "f'"), ("{a}_{b}", "a_b"), (r"\text{kg}", r"\unit{kg}"), ("{ab}", "{ab}")]
    df = spark.createDataFrame(rows, "a string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", assembly.lexical(df.a)).collect())


def test_frozen_subsets_are_disjoint_and_locked(spark):
    rows = [(i, f"s{i % 5}", f"l{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, source string, lang string")
    from quireframe.operators import stats

    a = stats.frozen(df, key="id", dims=["source", "lang"], counts=(20, 10)).collect()
    b = stats.frozen(df.repartition(5), key="id", dims=["source", "lang"], counts=(20, 10)).collect()
    assert len(a) == 30 and len({r["id"] for r in a}) == 30 and sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert {(r["subset"]) for r in a} == {1, 2} and len({r["lock"] for r in a}) == 1
    other = stats.frozen(df.where("id <> " + str(a[0]["id"])), key="id", dims=["source", "lang"], counts=(20, 10)).first()["lock"]
    assert other != a[0]["lock"]
