"""Quality rules by weak supervision.

Each rule looks at a document's statistics and votes good, votes bad or abstains.  The votes of all documents are
counted by pattern (at most 3 ** rules patterns, whatever the input's size), and expectation-maximisation over the pattern counts fits a
mixture of one class of good documents and a class for each kind of bad ones (KINDS).  In each class every rule has its own chance of a bad
vote among the votes it gives; these accuracies are estimated from how the rules agree, from weak starts and PRIOR votes.
An abstention tells nothing.  A document is kept if the posterior probability of the good class is at least one half and it passes the two
hard limits (``base_failed``): one bad vote of a rule that condemns good documents too is outvoted, one of a sharp rule is not.

Defined cases: a null text has no words; empty and word-less texts fail the word limit; repeated rows are judged
each on their own and equally; a very long text is judged like any other; without documents the model is its start; an empty table gives an
empty result; input columns of any name are left alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import GRAPH, Block, Words, attach, cut, documents, free_name, mix64, per_doc_sum

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: The kind of bad document that each rule is made for; only the start of the fit uses it.
KINDS = {
    "words": "stub",
    "word_length": "signs",
    "symbols": "signs",
    "letters": "signs",
    "letter_share": "signs",
    "dup_lines": "repetition",
    "repeats": "repetition",
    "case": "layout",
    "endings": "layout",
    "line_words": "layout",
}
#: Chances of a bad vote at the start: of any rule on good documents, of a rule on its own kind, and on other kinds.
START = (0.05, 0.6, 0.15)
#: Votes that the start weighs in each class and rule.
PRIOR = 20.0
#: Fixed values of the contract: the symbol characters.
SYMBOLS = b"#*$%&|<>"

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " n_lines bigint, n_letters bigint, n_upper bigint, n_ended bigint, n_alpha_words bigint, n_alpha_chars bigint"
)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False  # continuation bytes of UTF-8
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = _LETTER[0xC3:] = True
_LETTER_HEAD = _LETTER & _HEAD
_END = np.zeros(256, bool)
_END[list(b".!?:;")] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _sum_in(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=total[1:], dtype=np.int32)
    return total


def _equal_to_earlier(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is there an equal earlier one; is there any equal other one."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    earlier, other = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order[1:][same]] = True
    other[order[1:][same]] = other[order[:-1][same]] = True
    return earlier, other


def statistics(block: Block) -> list[np.ndarray]:
    """The statistics in FIELDS, one array each, over a block of whole texts."""
    data, bounds = block.data, block.bounds
    words = Words(block, GRAPH)
    n_words = words.counts()
    heads = _sum_in(_HEAD & GRAPH, data)
    letters = _sum_in(_LETTER, data)
    upper = _sum_in(_UPPER, data)
    symbols = _sum_in(_SYMBOL, data)
    at = lambda total: np.diff(total[bounds]).astype(np.int64)

    h, doc = words.hashes(), words.doc().astype(np.uint64)
    flag = np.zeros(len(h), bool)
    if len(h) > 2:
        triple = mix64(h[:-2] + h[1:-1] * np.uint64(0xD6E8FEB86659FD93) + h[2:] * np.uint64(0xA0761D6478BD642F) + doc[:-2] * np.uint64(0xE7037ED1A0B428DB))
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, again = _equal_to_earlier(triple[inside])
        hit = inside[again]
        flag[hit] = flag[hit + 1] = flag[hit + 2] = True
    repeated = per_doc_sum(flag, words.first)
    alpha = letters[words.ends] > letters[words.starts] if len(words) else np.zeros(0, bool)

    lines = Words(block, _LINE)
    n_lines = np.zeros(len(block), np.int64)
    dup, ended = n_lines.copy(), n_lines.copy()
    if len(lines):
        has_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
        key = mix64(lines.hashes(11) + lines.doc().astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        earlier, _ = _equal_to_earlier(key)
        n_lines, dup = per_doc_sum(has_word, lines.first), per_doc_sum(earlier & has_word, lines.first)
        ended = per_doc_sum(_END[data[lines.ends - 1]] & has_word, lines.first)
    return [n_words, at(heads), at(symbols), dup, repeated, n_lines, at(letters), at(upper), ended, per_doc_sum(alpha, words.first), at(_sum_in(_LETTER_HEAD, data))]


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules(s: Column) -> dict[str, Column]:
    """The rules by name: 1 good, -1 bad, 0 abstains.  ``s`` is the struct of statistics."""
    n = s["n_words"].cast("double")
    per_word = lambda x: F.when(n > 0, s[x] / n).otherwise(0.0)
    per_line = lambda x: F.when(s["n_lines"] > 0, s[x] / s["n_lines"]).otherwise(0.0)
    shout = F.when(s["n_letters"] > 0, s["n_upper"] / s["n_letters"]).otherwise(0.0)
    share = F.when(s["word_chars"] > 0, s["n_alpha_chars"] / s["word_chars"]).otherwise(0.0)
    length = per_word("word_chars")
    per_line_words = F.when(s["n_lines"] > 0, n / s["n_lines"]).otherwise(0.0)
    return {
        "words": _vote(n >= 2 * MIN_WORDS, n < MIN_WORDS),
        "word_length": _vote(length.between(4, 7.5), (length < 3) | (length > 10)),
        "symbols": _vote(per_word("n_symbols") == 0, per_word("n_symbols") > 0.02),
        "letters": _vote(per_word("n_alpha_words") > 0.95, per_word("n_alpha_words") < 0.8),
        "letter_share": _vote(share > 0.93, share < 0.85),
        "dup_lines": _vote(per_line("n_dup_lines") == 0, per_line("n_dup_lines") > 0.1),
        "repeats": _vote(per_word("n_repeat_words") < 0.05, per_word("n_repeat_words") > 0.2),
        "case": _vote(shout < 0.1, shout > 0.2),
        "endings": _vote(per_line("n_ended") > 0.7, per_line("n_ended") < 0.3),
        "line_words": _vote(per_line_words.between(8, 120), (per_line_words < 4) | (per_line_words > 400)),
    }


def starts(n_rules: int) -> np.ndarray:
    """Chances of a bad vote by class (the good one first) and rule, before any document is seen."""
    own = np.array(list(KINDS.values())[:n_rules])
    good, right, other = START
    return np.array([np.full(n_rules, good), *(np.where(own == k, right, other) for k in dict.fromkeys(KINDS.values()))])


def _votes(patterns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where each pattern's rules vote bad, and where good: a row a pattern."""
    votes = np.array([[int(x) for x in p] for p in patterns])
    return (votes == 0).astype(float), (votes == 2).astype(float)


def _classes(bad: np.ndarray, good: np.ndarray, shares: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """The probability of each class given the votes: a row a class, a column a pattern."""
    logs = np.log(shares)[:, None] + np.log(chance) @ bad.T + np.log(1 - chance) @ good.T
    weight = np.exp(logs - logs.max(0))
    return weight / weight.sum(0)


def fit(patterns: list[tuple[str, int]], n_rules: int, rounds: int = 1000) -> dict:
    """Shares of the classes and each rule's chance of a bad vote in each, from counts of vote patterns (0 bad, 1 abstains, 2 good)."""
    start = starts(n_rules)
    chance, shares = start, np.array([0.5] + [0.5 / (len(start) - 1)] * (len(start) - 1))
    if patterns:
        bad, good = _votes([p for p, _ in patterns])
        count = np.array([c for _, c in patterns], float)
        for _ in range(rounds):
            weight = count * _classes(bad, good, shares, chance)
            b, g = weight @ bad, weight @ good
            new = (b + PRIOR * start) / (b + g + PRIOR)
            shares = (weight.sum(1) + 1) / (count.sum() + len(start))
            done = np.abs(new - chance).max() < 1e-9
            chance = new
            if done:
                break
    return {"share": float(shares[0]), "shares": shares.tolist(), "chance": chance.tolist()}


def posterior(patterns: list[str], model: dict) -> list[float]:
    """Each vote pattern's probability that a document with it is good."""
    return _classes(*_votes(patterns), np.array(model["shares"]), np.array(model["chance"]))[0].tolist() if patterns else []


def _pattern(s: Column) -> Column:
    return F.concat(*[(v + 1).cast("string") for v in rules(s).values()])


def _qualities(s: Column, seen: DataFrame) -> DataFrame:
    """(pattern, quality) of every vote pattern among a frame's statistics: at most 3 ** rules rows."""
    counts = seen.groupBy(_pattern(s).alias("p")).agg(F.count("*").alias("n")).collect()
    patterns = sorted((r.p, r.n) for r in counts)
    names = [p for p, _ in patterns]
    rows = list(zip(names, posterior(names, fit(patterns, len(KINDS))), strict=True))
    return seen.sparkSession.createDataFrame(rows, "pattern string, quality double")


def _judged(found: DataFrame, name: str, qualities: DataFrame) -> DataFrame:
    """The struct of statistics becomes the contract's fields, base_failed, each rule's vote, quality (the posterior) and kept.

    The posterior is looked up by the pattern in the broadcast table: written out as an expression of the votes it is too
    large for generated code.
    """
    s = F.col(name)
    pattern, quality = free_name(found, "quality_pattern"), free_name(found, "quality_posterior")
    table = F.broadcast(qualities.toDF(pattern, quality))
    placed = found.withColumn(pattern, _pattern(s)).join(table, pattern)
    good = F.col(quality)
    failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
    parts = [s[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    votes = [v.alias(f"vote_{k}") for k, v in rules(s).items()]
    verdict = F.struct(*parts, failed.alias("base_failed"), *votes, good.alias("quality"), (~failed & (good >= 0.5)).alias("kept"))
    return placed.select(*[F.col(f"`{c}`") for c in found.columns if c != name], verdict.alias(name))


def score(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Every row with one struct column: the statistics, base_failed, each rule's vote, quality (the posterior) and kept.

    Two passes over the texts: one counts vote patterns, one scores.  Texts are never shuffled or written.
    """
    seen, name = attach(df.select(text), FIELDS, statistics, text)
    qualities = _qualities(F.col(name), seen)
    every, name = attach(df, FIELDS, statistics, text, name="quality_found")
    return _judged(every, name, qualities), name


def judge(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Every row without its text, with the same struct column; one pass over the texts, whose statistics are written out."""
    found, name = attach(df, FIELDS, statistics, text, name="quality_found")
    found = cut(found.select(*[F.col(f"`{c}`") for c in df.columns if c != text], F.col(name)))
    return _judged(found, name, _qualities(F.col(name), found)), name


def quality_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that the rules keep, with their columns unchanged."""
    found, name = score(df, text)
    return found.where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in df.columns])


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics and verdict of every document."""
    found, name = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", f"{name}.*")
