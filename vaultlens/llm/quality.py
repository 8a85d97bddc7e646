"""Quality rules: a threshold table compiled into one projection of built-in expressions.

Measures of a text are whole numbers, so every rule is a comparison of two integer products and both engines that
run it agree exactly. Rows are judged one by one: no shuffle, no state, any number of partitions.

Defined results: a null, empty or blank text has no words and is rejected; repeated rows are judged alike; an empty
table gives an empty table; extra columns pass through, and helper names avoid theirs. Stop words count whatever the
case of their ASCII letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultlens.llm.common import SPACE_CHARS, ascii_lower, fresh, let, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "the of and to a in is that for it was on are as with by be this from or at an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al".split(),
}
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


@dataclass(frozen=True)
class Rule:
    """Rejects where a * measure <op> b * per, in whole numbers; per None stands for 1."""

    name: str
    measure: str
    a: int
    op: str
    b: int
    per: str | None = None

    def rejects(self, of) -> Column:
        left, right = F.lit(self.a) * of(self.measure), F.lit(self.b) * (of(self.per) if self.per else F.lit(1))
        return left < right if self.op == "<" else left > right

    def sql(self) -> str:
        return f"{self.a} * {self.measure} {self.op} {self.b} * {self.per or 1}"


#: The two rules that the base verdict holds.
BASE_RULES = (Rule("too_short", "n_words", 1, "<", 50), Rule("repetitive", "n_repeat_words", 100, ">", 50, "n_words"))
#: Production thresholds.
RULES = (
    Rule("short_words", "word_chars", 1, "<", 2, "n_words"),
    Rule("long_words", "word_chars", 1, ">", 15, "n_words"),
    Rule("symbols", "n_symbols", 10, ">", 1, "n_words"),
    Rule("few_stop_words", "n_stop_words", 100, "<", 8, "n_words"),
    Rule("repeated_lines", "n_dup_lines", 10, ">", 4, "n_lines"),
)


def _repeat_words(ws: Column, width: int = 3) -> Column:
    """Words that lie in windows of `width` words which occur twice or more in ws, first occurrences included.

    Windows are known by a 64-bit hash within their own text. Sorted by hash, repeated ones are neighbours; sorted
    by place, each repeated window adds min(width, distance to the next one) words.
    """

    def body(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(width)]).alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            again = F.filter(s, lambda x, k: F.coalesce((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            places = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(places, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width)))), F.lit(0), lambda acc, x: acc + x))

        return F.when(n <= width, F.lit(0)).otherwise(let(F.sort_array(grams), covered))

    return let(ws, body)


def _of_text(t: Column, w: Column, lines: Column) -> dict[str, Column]:
    """The measures of a text, its words and its lines that hold a word."""
    stop = sorted({x for ws in STOP_WORDS.values() for x in ws})
    out = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(t, SPACE_CHARS, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(w),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(w, lambda x: ascii_lower(F.rtrim(x, F.lit(".,"))).isin(stop))),
    }
    return {k: v.cast("long") for k, v in out.items()}


def _text(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _lines(t: Column) -> Column:
    return F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with the measures of its text; the names they got."""
    names = dict(zip(("_w", "_l", *MEASURES), fresh(df, "_w", "_l", *MEASURES), strict=True))
    df = df.withColumns({names["_w"]: words(F.col(text)), names["_l"]: _lines(_text(text))})
    out = _of_text(_text(text), F.col(names["_w"]), F.col(names["_l"]))
    return df.withColumns({names[k]: v for k, v in out.items()}).drop(names["_w"], names["_l"]), names


def judged(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """df with its measures, base_failed, kept, and the names of the rules that reject a row."""
    df, names = measured(df, text)

    def of(m: str) -> Column:
        return F.col(names[m])

    failed = F.lit(False)
    for r in base:
        failed = failed | r.rejects(of)
    rejects = F.filter(F.array(*[F.when(r.rejects(of), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    f, r, k = fresh(df, "base_failed", "rejected_by", "kept")
    df = df.withColumns({f: failed, r: rejects})
    return df.withColumns({k: F.size(F.col(r)) == 0})


def _rejected(text: str, rules: tuple[Rule, ...]) -> Column:
    """Whether a rule rejects a text, as one expression: words, lines and measures are bound once, so a filter on it that
    the optimiser moves takes nothing apart."""
    used = {m for r in rules for m in (r.measure, r.per) if m}

    def verdict(w: Column, lines: Column) -> Column:
        own = F.struct(*[v.alias(k) for k, v in _of_text(_text(text), w, lines).items() if k in used])
        return let(own, lambda m: reduce(lambda x, y: x | y, [r.rejects(lambda k: m[k]) for r in rules], F.lit(False)))

    return let(words(F.col(text)), lambda w: let(_lines(_text(text)), lambda lines: verdict(w, lines)))


def quality_filter(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows of df that no rule rejects, with df's own columns."""
    return df.where(~_rejected(text, (*base, *rules)))


def rejections(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """rule, n: how many rows each rule rejects; a row that several reject counts for each."""
    out = judged(df, text, rules, base)
    by = out.columns[-2]
    return out.select(F.explode(F.col(f"`{by}`")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
