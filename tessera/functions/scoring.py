"""Answer scoring as Column expressions; arrays of texts are handled without UDFs.

Two functions stay outside Catalyst because they run a parser: symbolic
equality, by an optional library or by ``functions.algebra``, and
Python-literal evaluation (see ``operators.convert``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import algebra

# Words that count for a choice near them.
CHOICE_KEYWORDS = ("答案", "选择", "正确", "是", "对", "answer", "correct", "choose", "select", "right", "认为", "应该", "觉得", "think", "believe", "should")
CHOICE = r"(?<![A-Z])([A-Z])(?=[.,?!:;]|$)"
AFTER_CHOICE = "。.!！,，"
ANSWER = r"(?s)<answer>(.*?)</answer>"
_TRIM = r"(?U)^\s+|\s+$"


def let(x: Column, f) -> Column:
    """f(x) with x computed once: the expression does not grow with the uses of x."""
    return F.get(F.transform(F.array(x), f), 0)


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, _TRIM, "")


def extract_choice(text: Column) -> Column:
    """The letter that the text chooses, NULL without one; among several the best-scored, first seen on ties."""
    return let(F.regexp_replace(F.upper(text), r"(?U)\s+", " "), lambda t: let(F.regexp_extract_all(t, F.lit(CHOICE), F.lit(1)), lambda found: _best_choice(t, found)))


def _best_choice(t: Column, found: Column) -> Column:
    seen = F.array_distinct(found)

    def score(c: Column) -> Column:
        return let(F.position(c, t) - 1, lambda pos: at(pos))

    def at(pos: Column) -> Column:
        start = F.greatest(pos - 20, F.lit(0))
        around = F.substring(t, start + 1, F.least(F.length(t), pos + 20) - start)
        return let(around, lambda a: near(pos, a))

    def near(pos: Column, around: Column) -> Column:
        words = F.lit(0)
        for w in CHOICE_KEYWORDS:
            words = words + around.contains(w.upper()).cast("int")
        late = F.when(pos > F.length(t) * 0.7, 2).otherwise(0)
        after = F.substring(t, pos + 2, F.lit(1))
        mark = F.when((after != "") & F.lit(AFTER_CHOICE).contains(after), 1).otherwise(0)
        return words + late + mark

    ranked = F.transform(seen, lambda c, i: F.struct((-score(c)).alias("s"), i.alias("i"), c.alias("c")))
    return F.when(F.size(found) == 1, F.get(found, 0)).when(F.size(found) > 1, F.array_min(ranked)["c"])


def _tagged(text: Column, pattern: str = ANSWER) -> Column:
    """Stripped first ``<answer>`` content, else the whole text stripped."""
    return let(text, lambda t: strip(F.when(F.regexp_like(t, F.lit(pattern)), F.regexp_extract(t, pattern, 1)).otherwise(t)))


def mcq(content: Column, gold: Column) -> Column:
    return F.coalesce((extract_choice(_tagged(content)) == let(gold, lambda g: F.coalesce(extract_choice(g), strip(g)))).cast("double"), F.lit(0.0))


def yes_no(content: Column, gold: Column) -> Column:
    word = lambda x: F.regexp_extract(x, "(yes|no)", 1)
    return (word(_tagged(F.lower(content))) == word(_tagged(F.lower(gold), "<answer>(.*?)</answer>"))).cast("double")


def clean_text(text: Column) -> Column:
    """Last ``<answer>`` content if any, line breaks as spaces (dropped after white space), stripped, without final dots, lower-cased."""
    t = let(text, lambda x: F.coalesce(F.try_element_at(F.regexp_extract_all(x, F.lit(ANSWER), F.lit(1)), F.lit(-1)), x))
    for char in ("\n", "\r"):
        t = F.regexp_replace(t, rf"(?U)(?<=\s){char}", "")
        t = F.regexp_replace(t, rf"(?U)(?<!\s){char}", " ")
    return F.lower(F.regexp_replace(strip(t), r"\.+$", ""))


def to_number(text: Column) -> Column:
    """A float literal (digits may be grouped by single underscores), else NULL."""
    literal = r"(?i)^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)\s*$"
    return let(text, lambda t: F.when(F.regexp_like(t, F.lit(literal)), F.replace(strip(t), F.lit("_"), F.lit("")).try_cast("double")))


def numeric(content: Column, gold: Column) -> Column:
    """Equality as floats; NULL where one is no number."""
    return let(F.struct(to_number(clean_text(content)).alias("a"), to_number(clean_text(gold)).alias("b")), lambda v: _same_number(v["a"], v["b"]))


def _same_number(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.isnan(a) | F.isnan(b), 0.0).otherwise((a == b).cast("double")))


def indel_ratio(a: Column, b: Column) -> Column:
    """Indel similarity 2 LCS / (len + len), 1 for two empty texts."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), lambda v: F.when(v["a"] == v["b"], 1.0).otherwise(_lcs_ratio(v["a"], v["b"])))


#: Bits of a table row that one number holds, so that sums stay positive.
_BITS = 62
_ONES = (1 << _BITS) - 1


def _lcs_ratio(xs: Column, ys: Column) -> Column:
    """By a bit-parallel fold: a row of the LCS table is one bit a character of ``xs``, zero where the row grows."""
    words = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BITS).cast("int"))
    doubled = lambda acc, bit: acc * 2 + bit
    hits = lambda c, w: F.aggregate(F.reverse(F.transform(F.slice(xs, w * _BITS + 1, F.lit(_BITS)), lambda x: (x == c).cast("long"))), F.lit(0).cast("long"), doubled)
    places = F.map_from_entries(F.transform(F.array_distinct(xs), lambda c: F.struct(c.alias("c"), F.transform(words, lambda w: hits(c, w)).alias("bits"))))
    none = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def word(acc: Column, p: Column) -> Column:
        total = p["row"] + p["row"].bitwiseAND(p["bits"]) + acc["carry"]
        new = total.bitwiseAND(F.lit(_ONES)).bitwiseOR(p["row"].bitwiseAND(F.bitwise_not(p["bits"])))
        return F.struct(F.shiftright(total, _BITS).alias("carry"), F.array_append(acc["out"], new).alias("out"))

    def grow(row: Column, bits: Column) -> Column:
        pairs = F.zip_with(row, bits, lambda r, b: F.struct(r.alias("row"), b.alias("bits")))
        return F.when(bits.isNull(), row).otherwise(F.aggregate(pairs, none, word, lambda acc: acc["out"]))

    first = F.transform(words, lambda _: F.lit(_ONES))
    zeros = lambda row: F.aggregate(row, F.lit(0), lambda n, w: n + _BITS - F.bit_count(w))
    lcs = let(places, lambda m: F.aggregate(ys, first, lambda row, y: grow(row, F.try_element_at(m, y)), zeros))
    both = F.size(xs) + F.size(ys)
    return F.when(both == 0, 1.0).when((F.size(xs) == 0) | (F.size(ys) == 0), 0.0).otherwise(2.0 * lcs / both)


_MARKS = {"box": (r"\\boxed\{(.*?)}", "\\boxed{"), "answer_tags": ("<answer>(.*?)</answer>", "<answer>")}


def _answers(content: Column, gold: Column, regex_type: str, last: bool, unique: bool, score) -> Column:
    """score(answer, gold answer); 0 unless exactly one mark is there, where asked."""
    pattern, mark = _MARKS[regex_type]
    pattern += r"(?U:\s{0,3})(?-m:\n?\z|\z)" if last else ""
    answer = strip(F.coalesce(F.try_element_at(F.regexp_extract_all(content, F.lit(f"(?s){pattern}"), F.lit(1)), F.lit(-1)), content))
    truth = strip(F.when(F.regexp_like(gold, F.lit(pattern)), F.regexp_extract(gold, pattern, 1)).otherwise(gold))
    out = let(F.struct(answer.alias("a"), truth.alias("g")), lambda v: score(v["a"], v["g"]))
    once = F.size(F.split(content, rf"\Q{mark}\E", -1)) == 2
    return F.when(once, out).otherwise(0.0) if unique else out


def default_accuracy(content: Column, gold: Column, regex_type: str = "box", unique: bool = True, last: bool = True, verified: Column | None = None) -> Column:
    """Symbolic equality where given; else numbers exactly, choices by letter, other texts by similarity."""

    def score(answer: Column, truth: Column) -> Column:
        similar = let(F.struct(clean_text(answer).alias("a"), clean_text(truth).alias("g")), lambda v: indel_ratio(v["a"], v["g"]))
        choice = lambda: extract_choice(truth)
        return (
            F.when(F.regexp_like(truth, F.lit(r"(?U)\d")), F.coalesce(numeric(answer, truth), similar))
            .when(choice().isNotNull(), F.coalesce((extract_choice(answer) == choice()).cast("double"), F.lit(0.0)))
            .otherwise(similar)
        )

    def scored(answer: Column, truth: Column) -> Column:
        return score(answer, truth) if verified is None else F.when(F.coalesce(verified, F.lit(False)), 1.0).otherwise(score(answer, truth))

    return _answers(content, gold, regex_type, last, unique, scored)


def string_match(content: Column, gold: Column, match_type: str, preprocess: str | None = None, regex_type: str = "box", unique: bool = True, last: bool = False) -> Column:

    def score(answer: Column, truth: Column) -> Column:
        if preprocess == "lowercase":
            answer, truth = F.lower(answer), F.lower(truth)
        if match_type == "exact_match":
            return (clean_text(answer) == clean_text(truth)).cast("double")
        if match_type == "levenshtein_similarity":
            return let(F.struct(clean_text(answer).alias("a"), clean_text(truth).alias("g")), lambda v: indel_ratio(v["a"], v["g"]))
        return F.lit(0.0)

    return _answers(content, gold, regex_type, last, unique, score)


def accuracy(content: Column, golds: Column, method: Column, cutoff: float = 0.0, match_type: str = "exact_match", preprocess: str | None = None, verified: Column | None = None) -> Column:
    """Best score over the gold answers by the row's method; scores under the cutoff are 0.

    ``verified`` is a column of the rows that holds their ``symbolic_verdicts``,
    one for each gold answer.
    """

    def one(gold: Column, i: Column) -> Column:
        same = None if verified is None else F.get(verified, i)
        by_method = (
            F.when(method == "mcq", mcq(content, gold))
            .when(method == "yes_no", yes_no(content, gold))
            .when(method == "math", math_score(clean_text(content), clean_text(gold), same))
            .when(method == "string_matching", string_match(content, gold, match_type, preprocess))
            .otherwise(default_accuracy(content, gold, verified=same))
        )
        return let(by_method, lambda v: F.when(v >= cutoff, v).otherwise(0.0))

    return F.array_max(F.transform(golds, one))


def format_reward(content: Column) -> Column:
    return F.regexp_like(content, F.lit(r"(?s)\A<think>.*?</think>(?U:\s*)<answer>.*?</answer>\z")).cast("double")


def format_only_answer(content: Column) -> Column:
    return F.regexp_like(content, F.lit(r"(?s)\A.*<answer>(.*?)</answer>(?U:\s{0,2})\n?\z")).cast("double")


def format_rec(content: Column) -> Column:
    """Whether the answer holds a JSON-like list of four integers."""
    return F.regexp_like(content, F.lit(r"(?s)<answer>.*?\{.*\[\d+,\s*\d+,\s*\d+,\s*\d+\].*\}.*?</answer>")).cast("double")


def iou_rec(content: Column, gold: Column, threshold: float = 0.5) -> Column:
    """1 where the first box of the answer overlaps the gold box by more than the threshold, pixels inclusive."""
    inside = F.regexp_extract(content, ANSWER, 1)
    nums = F.transform(F.split(F.regexp_extract(inside, r"\[(\d+,\s*\d+,\s*\d+,\s*\d+)\]", 1), r",\s*"), lambda s: s.try_cast("int"))
    p = [F.get(nums, i) for i in range(4)]
    g = [gold[c] for c in ("x1", "y1", "x2", "y2")]
    left, top = F.greatest(p[0], g[0]), F.greatest(p[1], g[1])
    right, bottom = F.least(p[2] - 1, g[2] - 1), F.least(p[3] - 1, g[3] - 1)
    inter = F.when((left < right) & (top < bottom), (right - left + 1) * (bottom - top + 1)).otherwise(0)
    union = (p[2] - p[0]) * (p[3] - p[1]) + (g[2] - g[0]) * (g[3] - g[1]) - inter
    return F.coalesce((F.try_divide(inter, union) > threshold).cast("double"), F.lit(0.0))


# Mathematics -------------------------------------------------------------


def last_boxed(text: Column) -> Column:
    r"""The last ``\boxed{...}`` or ``\fbox{...}`` with balanced braces, or the ``\boxed x`` form up to ``$``; else NULL."""
    spaced = F.concat(F.lit("\\boxed "), F.substring_index(F.element_at(F.split(text, r"\\boxed ", -1), -1), "$", 1))

    def from_mark(mark: str) -> Column:
        tail = F.element_at(F.split(text, rf"\Q{mark}\E", -1), -1)
        chars = F.filter(F.split(tail, ""), lambda c: c != "")
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

        def step(s: Column, c: Column) -> Column:
            depth = s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
            closed = (s["end"] == 0) & (c == "}") & (depth == 0)
            return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when(closed, s["at"] + 1).otherwise(s["end"]).alias("end"))

        end = F.aggregate(chars, start, step, lambda s: s["end"])
        return F.when(end > 0, F.concat(F.lit(mark), F.substring(tail, F.lit(1), end)))

    return F.when(text.contains("\\boxed "), spaced).when(text.contains("\\boxed"), from_mark("\\boxed")).when(text.contains("\\fbox"), from_mark("\\fbox"))


def unboxed(text: Column) -> Column:
    r"""Content of a ``\boxed{...}`` or ``\boxed x`` text; NULL for other texts."""
    return F.when(text.startswith("\\boxed "), F.substring(text, F.lit(8), F.length(text))).when(text.startswith("\\boxed{") & text.endswith("}"), F.substring(text, F.lit(8), F.length(text) - 8))


def strip_latex(text: Column) -> Column:
    """Normal form of a LaTeX answer; NULL where the original normaliser fails (text after a unit, a bare final command)."""
    lit, r = F.lit, F.replace
    s = text
    for old, new in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        s = r(s, lit(old), lit(new))
    s = let(s, lambda x: F.when(F.size(F.split(x, r"\\text\{ ", -1)) <= 2, F.substring_index(x, "\\text{ ", 1)))
    for old, new in (("\\%", ""), (" .", " 0."), ("{.", "{0.")):
        s = r(s, lit(old), lit(new))
    s = F.regexp_replace(s, r"^\.", "0.")
    s = let(s, lambda x: F.when((F.size(F.split(x, "=", -1)) == 2) & (F.position(lit("="), x) <= 3), F.substring_index(x, "=", -1)).otherwise(x))
    s = let(s, lambda x: F.when(~x.endswith("\\sqrt"), F.regexp_replace(x, r"(?s)\\sqrt([^{])", r"\\sqrt{$1}")))
    return let(r(s, lit(" "), lit("")), _strip_fracs)


def _strip_fracs(s: Column) -> Column:
    lit = F.lit
    # Every part behind a \frac needs two characters, or the text stays as it is.
    short = F.exists(F.slice(F.split(s, r"\\frac", -1), 2, 1_000_000), lambda p: (F.length(p) < 2) & ~p.startswith("{"))
    fixed = F.regexp_replace(s, r"(?s)\\frac([^{\\]|\\(?!frac))([^{\\]|\\(?!frac))", r"\\frac{$1}{$2}")
    fixed = F.regexp_replace(fixed, r"(?s)\\frac([^{\\]|\\(?!frac))\{", r"\\frac{$1}{")
    s = F.when(s.endswith("\\frac"), lit(None).cast("string")).when(short, s).otherwise(fixed)
    return let(s, lambda x: F.when(x == "0.5", "\\frac{1}{2}").otherwise(F.regexp_replace(x, r"^(0|-?[1-9]\d*)/(0|-?[1-9]\d*)$", r"\\frac{$1}{$2}")))


def is_equiv(a: Column, b: Column) -> Column:
    """Equality of normal forms; of the texts themselves where one has none. Two NULLs are equal."""
    same = let(F.struct(strip_latex(a).alias("x"), strip_latex(b).alias("y")), lambda v: F.when(v["x"].isNull() | v["y"].isNull(), a == b).otherwise(v["x"] == v["y"]))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(same)


def math_score(answer: Column, gold: Column, verified: Column | None = None) -> Column:
    """1 for equal texts, symbolically equal ones where given, or equal normal forms of the last boxed answer."""
    inner = let(answer, lambda a: let(last_boxed(a), lambda box: F.when(box.isNull(), a).otherwise(unboxed(box))))
    same = (answer == gold) | F.coalesce(let(inner, lambda x: is_equiv(x, gold) & x.isNotNull()), F.lit(False))
    return (same if verified is None else same | F.coalesce(verified, F.lit(False))).cast("double")


def paren_to_box(text: Column) -> Column:
    r"""A closing ``(X)`` of one character as ``\boxed{X}``."""
    return F.regexp_replace(text, r"\(([A-Za-z0-9{,3}])\)$", r"\\boxed{$1}")


def iou_reward(boxes: Column, gold: Column, how: str = "last") -> Column:
    """First, last or mean IoU of a conversation's boxes with the gold box, 0 without boxes."""
    from tessera.functions import geometry as G

    if how not in ("first", "last", "mean"):
        raise ValueError(f"unknown aggregate: {how}")
    ious = F.transform(boxes, lambda b: G.overlap(b, gold)["iou"])
    if how == "mean":
        out = F.aggregate(ious, F.lit(0.0), lambda s, x: s + x) / F.size(ious)
    else:
        out = F.element_at(ious, 1 if how == "first" else -1)
    return F.when(F.size(boxes) > 0, out).otherwise(0.0)


def symbolic_verdicts(answer: Column, golds: Column) -> Column:
    """Symbolic equality with each gold answer: by the optional verifier library, or by identity testing where it is not installed. NULL is "not verified"."""
    import importlib.util

    if importlib.util.find_spec("math_verify") is None:
        return algebra.verdicts(answer, golds)

    @F.pandas_udf("array<boolean>")
    def verify(a: pd.Series, b: pd.Series) -> pd.Series:
        from math_verify import parse
        from math_verify import verify as same

        def one(x, y):
            try:
                return bool(float(same(parse(x), parse(y))) > 0)
            except Exception:
                return False

        return pd.Series([[one(x, y) for y in ys] if ys is not None else None for x, ys in zip(a, b)])

    return verify(answer, golds)


def symbolic_equal(answer: Column, gold: Column) -> Column:
    """Symbolic equality with one gold answer; NULL where not verified."""
    return F.get(symbolic_verdicts(answer, F.array(gold)), 0)
