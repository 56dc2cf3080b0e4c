"""Code or prose: scores in hundredths and the class of an input, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sextant.functions.text import fold, let

# Phrases and words that the scores look for.
STARTERS = (
    "write ", "create ", "generate ", "make ", "build ", "implement ", "add ", "define ", "show ", "give ", "help ", "how ", "what ",
    "can you ", "please ", "i need ", "i want ", "could you ", "design ", "develop ", "construct ", "produce ", "compose ",
    "explain ", "describe ", "convert ", "transform ", "translate ",
)
KEYWORDS = (
    "def ", "class ", "function ", "func ", "fn ", "pub ", "private ", "const ", "let ", "var ", "int ", "void ", "struct ", "enum ",
    "import ", "from ", "include ", "using ", "package ", "module ", "if ", "else ", "elif ", "for ", "while ", "switch ", "match ",
    "return ", "yield ", "async ", "await ", "try ", "catch ", "throw ", "public ", "protected ", "static ", "final ", "abstract ",
    "interface ", "trait ", "impl ", "type ", "typedef ", "namespace ", "template ", "typename ", "auto ", "register ",
    "extern ", "inline ", "virtual ", "override ", "new ", "delete ",
)
STRONG = (
    "#!/", "#include", "#define", "#pragma", "#ifdef", "#ifndef", "->", "=>", "::", "<<", ">>", "&&", "||", "++", "--", "+=", "-=", "*=", "/=",
    "==", "!=", "<=", ">=", "[]", "{}", "()", "/**", "/*", "*/", "//", "std::", "self.", "this.", "super.", "lambda", "@property",
    "@staticmethod", "@classmethod", "console.log", "System.out", "fmt.Print",
)
CONVERSATIONAL = (
    " the ", " a ", " an ", " that ", " which ", " this ", " with ", " from ", " into ", " onto ", " about ", " please ", " thanks ",
    " would ", " could ", " should ", " me ", " my ", " your ", " our ", " their ",
)
QUESTIONS = ("how to", "what is", "how do", "can i")


def _phrases(phrases: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, phrases))


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    return F.exists(_phrases(phrases), lambda p: F.contains(text, p))


def _hits(text: Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases the text has; a loop over a constant array, as unrolled it would be too long to compile."""
    return F.size(F.filter(_phrases(phrases), lambda p: F.contains(text, p)))


def _starts(text: Column) -> Column:
    return F.exists(_phrases(STARTERS), lambda p: F.startswith(text, p))


def _count(text: Column, chars: str) -> Column:
    """How many of the characters the text has."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _if(cond: Column, points: int) -> Column:
    return F.when(cond, points).otherwise(0)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\x0B\f\r]+", "")


def _code(t: Column, low: Column) -> Column:
    score = _if(_any(t, STRONG), 40) + 20 * F.least(_hits(low, KEYWORDS), F.lit(2))
    score += _if(_count(t, "()") >= 2, 15) + _if(_count(t, "{}") >= 2, 20) + _if(t.contains(";"), 15) + _if(_count(t, "=+-*/%") >= 2, 10)
    score += _if(t.contains("    ") | t.contains("\t"), 10) + _if(_count(t, "\n") >= 2, 10)
    return F.least(score, F.lit(100))


def _ratio_points(text: Column) -> Column:
    """20 under 5 % of special bytes against letters, digits and blanks, 10 under 10 %."""

    def points(plain: Column) -> Column:
        special = F.octet_length(text) - plain - _count(text, "\n\r\t")
        return F.when(plain == 0, 0).when(20 * special < plain, 20).when(10 * special < plain, 10).otherwise(0)

    return let(F.length(F.regexp_replace(text, r"[^A-Za-z0-9 ]", "")), points)


def _prose(t: Column, low: Column) -> Column:
    """(prose, seventy): the score, and whether it is a 70 made of 50 + 10 + 10, which lies above 0.7 in single precision, as 50 + 20 does not."""
    question = t.endswith("?") | _any(low, QUESTIONS)
    capital = t.rlike(r"^[A-Z]") & (_count(t, " ") >= 3)
    parts = F.struct(_starts(low).alias("starts"), F.least(_hits(low, CONVERSATIONAL), F.lit(3)).alias("talk"), _ratio_points(t).alias("ratio"), capital.alias("capital"), question.alias("question"))

    def total(p: Column) -> Column:
        score = F.least(_if(p["starts"], 50) + _if(p["question"], 25) + 10 * p["talk"] + p["ratio"] + _if(p["capital"], 10), F.lit(100))
        tens = _if(p["talk"] == 1, 1) + _if(p["ratio"] == 10, 1) + _if(p["capital"], 1)
        return F.struct(score.alias("prose"), (p["starts"] & (score == 70) & (tens == 2)).alias("seventy"))

    return let(parts, total)


def assess(text: Column) -> Column:
    """(class, code_score, nl_score) of an input: EMPTY, AMBIGUOUS, CODE or NATURAL_LANG, and the scores in hundredths up to 100. Each part is computed once."""

    def of(t: Column, code: Column, p: Column) -> Column:
        prose = p["prose"]
        natural = ((prose > 50) & (code < 30)) | (prose > 70) | p["seventy"]
        kind = F.when(t == "", "EMPTY").when(F.octet_length(t) < 3, "AMBIGUOUS").when(t.startswith("#!"), "CODE").when(code > 60, "CODE").when(natural, "NATURAL_LANG").otherwise("AMBIGUOUS")
        return F.struct(kind.alias("class"), code.alias("code_score"), prose.alias("nl_score"))

    return let(trimmed(text), lambda t: let(fold(t), lambda low: let(_code(t, low), lambda code: let(_prose(t, low), lambda p: of(t, code, p)))))


def code_points(text: Column) -> Column:
    """Code score of a trimmed text, in hundredths up to 100."""
    return let(text, lambda t: let(fold(t), lambda low: _code(t, low)))


def prose_points(text: Column) -> Column:
    """Natural-language score of a trimmed text, in hundredths up to 100."""
    return let(text, lambda t: let(fold(t), lambda low: _prose(t, low)))["prose"]


def classify(text: Column) -> Column:
    """EMPTY, AMBIGUOUS, CODE or NATURAL_LANG."""
    return assess(text)["class"]


def confidence(text: Column) -> Column:
    """Distance of the two scores of a trimmed text."""
    return let(assess(text), lambda a: F.abs(a["code_score"] - a["nl_score"]) / 100.0)


def is_code(text: Column) -> Column:
    return classify(text).isin("CODE", "AMBIGUOUS")


def is_natural_language(text: Column) -> Column:
    return classify(text) == "NATURAL_LANG"


def has_code_syntax(text: Column) -> Column:
    return code_points(text) > 30
