"""Column functions on messages, diffs and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, patterns and limits that results depend on.
STOP_WORDS = "the a an and or of to in is are be this that for with on it as at by from".split()
BUG_WORDS = (
    "bug fix fixed fixes fixing error errors fail failure failing crash npe null leak leaks race deadlock hang "
    "regression exception corrupt overflow underflow infinite wrong incorrect broken issue defect fault invalid "
    "unexpected missing mismatch unsafe concurrency concurrent synchronization thread threading memory boundary"
).split()
ACTION_WORDS = (
    "add added remove removed delete deleted refactor refactored rename renamed move moved update updated "
    "revert reverted cleanup optimize simplify replace introduce implement support handle improve change"
).split()
CAMEL = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]{2,}|[A-Z]{2,}"
ERROR_TYPE = r"\b([A-Z][A-Za-z0-9]*(?:Exception|Error))\b"
CODE_NAME = r"[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|\w+_\w+|\w+\.\w+"
MENTIONED_CODE = r"[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*|\w+_\w+"
WORD = "[A-Za-z]{2,}"
NOISE = r"tokenset|^mk_|^_+|_?\d{2,}$|^[a-z]$|\d{3,}|^[0-9a-f]{6,}$"
KINDS = ("code", "bug", "action", "error", "nl")
HEAD_TOKENS = 4000
INTENTS = {
    "fix": ["fix", "bug", "issue", "error", "fault", "defect", "npe", "crash", "fail", "correct", "resolve", "patch", "wrong", "broken"],
    "feat": ["add", "feature", "implement", "introduce", "support", "new", "allow", "enable", "provide"],
    "refactor": ["refactor", "cleanup", "clean up", "simplify", "rename", "reorganize", "restructure", "tidy", "inline", "extract", "deprecat"],
    "test": ["test", "junit", "assert", "testcase", "coverage", "spec"],
    "docs": ["doc", "documentation", "javadoc", "readme", "comment", "license"],
    "perf": ["perf", "performance", "optimi", "speed", "faster", "cache", "latency"],
    "revert": ["revert", "rollback", "roll back", "undo", "back out"],
}
SMALL_WORDS = ["minor", "small", "trivial", "typo", "tiny", "simple", "cosmetic", "nit", "quick", "slight", "little"]


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def is_noise(term: Column) -> Column:
    return (F.length(term) > 30) | term.rlike(NOISE)


def camel_words(c: Column) -> Column:
    """Lower-cased parts of an identifier of at least two letters."""
    return F.filter(F.transform(_all(c, CAMEL), lambda w: F.lower(w)), lambda w: F.length(w) > 1)


def kind_of_word(w: Column) -> Column:
    return F.when(w.isin(BUG_WORDS), "bug").when(w.isin(ACTION_WORDS), "action").otherwise("nl")


def words(c: Column, stop: list[str] = STOP_WORDS) -> Column:
    """Typed words (kind, term) in order, without stop words and noise."""
    kept = F.filter(_all(F.lower(c), WORD), lambda w: ~w.isin(stop) & ~is_noise(w))
    return F.transform(kept, lambda w: F.struct(kind_of_word(w).alias("kind"), w.alias("term")))


def code_terms(c: Column) -> Column:
    """Typed terms of identifiers: error types, then each code name followed by its parts."""
    errors = F.transform(F.filter(F.transform(_all(c, ERROR_TYPE, 1), lambda w: F.lower(w)), lambda w: ~is_noise(w)), lambda w: F.struct(F.lit("error").alias("kind"), w.alias("term")))

    def parts(name: Column) -> Column:
        own = F.filter(F.array(F.struct(F.lit("code").alias("kind"), F.lower(name).alias("term"))), lambda s: ~is_noise(s["term"]))
        sub = F.transform(F.filter(camel_words(name), lambda w: ~is_noise(w)), lambda w: F.struct(F.lit("nl").alias("kind"), w.alias("term")))
        return F.concat(own, sub)

    return F.concat(errors, F.flatten(F.transform(_all(c, CODE_NAME), parts)))


def typed_tokens(c: Column, code: bool = True) -> Column:
    """Typed tokens of a text: identifiers first (``code``), then words. Null gives none."""
    return F.concat(code_terms(c), words(c)) if code else words(c)


def diff_lines(diff: Column, sign: str) -> Column:
    """Lines a diff adds (+) or removes (-), without their sign, joined by line feeds."""
    mark = sign * 3
    lines = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith(sign) & ~x.startswith(mark))
    return F.array_join(F.transform(lines, lambda x: F.substring(x, 2, 2**31 - 1)), "\n")


def diff_paths(diff: Column) -> Column:
    """Paths in the file headers of a diff, in order."""
    heads = F.filter(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith("+++") | x.startswith("---"))
    return F.filter(F.transform(heads, lambda x: F.regexp_extract(x, r"[ab]/(.+)$", 1)), lambda p: p != "")


def commit_tokens(message: Column, diff: Column, head: int = HEAD_TOKENS) -> Column:
    """(source, kind, term): tokens of message (m), added (a) and removed lines (r), the first ``head`` of them."""
    tag = lambda s: lambda t: F.struct(F.lit(s).alias("source"), t["kind"].alias("kind"), t["term"].alias("term"))
    parts = [F.transform(typed_tokens(x), tag(s)) for s, x in (("m", message), ("a", diff_lines(diff, "+")), ("r", diff_lines(diff, "-")))]
    return F.slice(F.concat(*parts), 1, head)


def count_of(text: Column, word: str) -> Column:
    """Occurrences of ``word`` in ``text`` that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def intent(message: Column) -> Column:
    """The intent with most keyword hits, of equal ones the first declared; other without a hit."""
    m = F.lower(F.coalesce(message, F.lit("")))
    hits = {k: sum((count_of(m, w) for w in ws[1:]), count_of(m, ws[0])) for k, ws in INTENTS.items()}
    best = F.array_max(F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, n) in enumerate(hits.items())]))
    return F.when(best["n"] > 0, best["k"]).otherwise("other")


def claims_small(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit(False)
    for w in SMALL_WORDS:
        out = out | m.contains(w)
    return out


def line_and_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """Line (from 1) and column (from 0) of a character offset."""
    before = F.substring(text, F.lit(1), offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(F.substring_index(before, "\n", -1))


def short_name(c: Column, length: int = 26) -> Column:
    """A name without lone surrogates, cut to ``length``."""
    return F.substring(F.regexp_replace(c, r"[\uD800-\uDFFF]", ""), 1, length)


def encode_ids(tokens: Column, vocabulary: Column, length: int) -> Column:
    """Numbers of the first ``length`` tokens, 1 for unknown ones, filled up with 0."""
    ids = F.transform(F.slice(tokens, 1, length), lambda t: F.coalesce(F.try_element_at(vocabulary, t), F.lit(1)))
    return F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length)
