"""Text functions as column expressions: tokenizers, trigrams, checksums, formatting. Case and classes are ASCII only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_TOKEN, MAX_TOKEN = 2, 64
#: Capitals that begin a sub-token within a word: after a small letter, or after a letter or digit if a small one follows.
CAMEL = r"[A-Z](?:(?<=[a-z].)|(?<=[A-Za-z0-9].)(?=[a-z]))"
#: Anything but letters and digits, which are listed one by one: Java looks single characters up in a table, but tests ranges one after the other, many times slower.
OTHER = f"[^{UPPER}{LOWER}0123456789]+"
SPACE = r"[ \t\n\x0B\f\r]+"
#: Stands for what divides a white-space word into sub-tokens.
CUT = "\x01"
#: String literals, // and # comments with the newline that ends them.
_NOT_CODE = r"""(?s)(?<!\\)(["'])(?:.*?(?<!\\)\1|.*\z)|//[^\n]*\n?|#[^\n]*\n?"""

# The optional stop words for code search.
CODE_STOP_WORDS = [
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were",
    "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall",
    "can", "var", "let", "const", "new", "this", "self", "true", "false", "null", "nil", "none", "void", "int", "string", "bool", "float",
    "double", "if", "it", "so", "no", "up", "go",
]


def fold(text: Column) -> Column:
    """A-Z to a-z, everything else as it is; ``lower`` does that many times faster for texts without other capitals."""
    return F.when(text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, F.lower), lambda t: F.length(t).between(MIN_TOKEN, MAX_TOKEN))  # parts are ASCII


def tokenize(text: Column, stop_words: list[str] | None = None) -> Column:
    """Sub-tokens of 2 to 64 characters, split at punctuation, underscores and camel-case borders, folded."""
    tokens = _kept(F.split(F.regexp_replace(text, CAMEL, " $0"), OTHER, -1))
    return F.filter(tokens, lambda t: ~t.isin(stop_words)) if stop_words else tokens


def unique_terms(text: Column) -> Column:
    return F.array_distinct(tokenize(text))


def words(text: Column) -> Column:
    """White-space words, with ``CUT`` for whatever divides them into sub-tokens."""
    inner = F.regexp_replace(F.regexp_replace(text, CAMEL, CUT + "$0"), OTHER.replace("]", r" \t\n\x0B\f\r]"), CUT)
    return F.split(F.btrim(inner, F.lit(" \t\n\x0b\f\r")), SPACE, -1)


def tokenize_with_positions(text: Column) -> Column:
    """Structs (term, pos); pos counts white-space words, and the sub-tokens of a word share it."""

    def of_word(word: Column, i: Column) -> Column:
        token = lambda t: F.struct(F.lower(t).alias("term"), i.alias("pos"))
        return F.when(word.contains(CUT), F.transform(F.split(word, CUT, -1), token)).otherwise(F.array(token(word)))

    return F.filter(F.flatten(F.transform(words(text), of_word)), lambda t: F.length(t["term"]).between(MIN_TOKEN, MAX_TOKEN))


def code_text(code: Column) -> Column:
    """Code without literals and comments; what stood on either side of them is joined."""
    return F.regexp_replace(code, _NOT_CODE, "")


def tokenize_code(code: Column) -> Column:
    """Sub-tokens of code, in order; their places in the array are their positions."""
    return tokenize(code_text(code))


def camel_split(text: Column) -> Column:
    return F.split(text, r"(?<=[a-z])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])", -1)


def snake_split(text: Column) -> Column:
    return F.filter(F.split(text, "_", -1), lambda x: x != "")


def punctuation_split(text: Column) -> Column:
    return F.filter(F.split(text, "[^A-Za-z0-9_]+", -1), lambda x: x != "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once even where ``use`` needs it for every element of an array."""
    return F.get(F.transform(F.array(value), use), 0)


def trigrams(text: Column, pad: bool = True) -> Column:
    """Distinct byte trigrams of the folded text, as six hex digits each; padded texts get $$ on both sides."""
    body = fold(text)
    digits = F.hex(F.encode(F.concat(F.lit("$$"), body, F.lit("$$")) if pad else body, "UTF-8"))

    def grams(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        # Every third byte from each of three starts: splitting is linear where cutting at each offset would not be.
        cut = [F.regexp_extract_all(F.substring(h, 2 * k + 1, 1 << 30), F.lit(".{6}"), F.lit(0)) for k in range(3)]
        return F.when(n >= 3, F.array_distinct(F.concat(*cut))).otherwise(F.array().cast("array<string>"))

    return let(digits, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def checksum(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, unsigned, as long."""
    return F.crc32(text.cast("binary"))


class Crc32:
    """CRC-32 of data that comes in parts."""

    def __init__(self) -> None:
        self.value = 0

    def update(self, data: bytes | str) -> int:
        import zlib

        self.value = zlib.crc32(data.encode() if isinstance(data, str) else data, self.value)
        return self.value


def checksum_of_parts(parts: Column) -> Column:
    """CRC-32 of the parts of a text, one after the other."""
    return checksum(F.array_join(parts, ""))


def truncate(text: Column, n: int) -> Column:
    """At most n characters; longer texts end in three dots where n is over 3."""
    if n <= 3:
        return F.substring(text, 1, n)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def parse_id(text: Column) -> Column:
    """The positive whole number that the text is, else null."""
    n = F.when(text.rlike(r"^[0-9]{1,19}$"), text.try_cast("bigint"))
    return F.when(n > 0, n)


def format_size(size: Column) -> Column:
    """Bytes as B to TB in steps of 1024, with one decimal; a half is rounded to the even digit, as the exact binary value of the quotient asks."""
    out = F.lit(None).cast("string")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        bits = 10 * k
        tenths = size.cast("long") * 10
        low = tenths.bitwiseAND(F.lit((1 << bits) - 1))
        whole, half = F.shiftright(tenths, bits), (1 << bits) // 2
        up = (low > half) | (low == half) & (whole % 2 == 1) if k else F.lit(False)
        whole = whole + F.when(up, 1).otherwise(0)
        text = F.concat(F.floor(whole / 10).cast("string"), F.lit("."), (whole % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size < (1 << (bits + 10)), text).otherwise(out) if k < 4 else text
    return out


def extract_family(model: Column) -> Column:
    """A model's family: without its tag, and without a last part that is a version."""
    return F.regexp_replace(F.substring_index(model, ":", 1), r"-(?:[0-9][^-]*|latest)$", "")


# Names that mark a model as one for code.
CODE_MODELS = ("codellama", "starcoder", "codegemma", "codestral", "deepseek-coder", "deepseek-v2.5", "granite-code", "stable-code", "coder", "-code", "code-")
RECOMMENDED_CODE_MODELS = ("codellama:7b-instruct", "deepseek-coder:6.7b", "qwen2.5-coder:7b", "codellama:13b-instruct", "starcoder2:7b", "codegemma:7b")


def is_code_model(model: Column) -> Column:
    found = F.lit(False)
    for name in CODE_MODELS:
        found = found | fold(model).contains(name)
    return found
