"""Quality rules as a short-circuit cascade, ordered by what a rule rejects for what it costs.

Every text is measured once (words, symbols, repeated lines and windows). The rules are timed on a bounded sample,
where all of them run on each text; the cascade then takes, again and again, the rule that rejects most of the texts
still left per second of work. On the whole table a text leaves the cascade at the first rule that rejects it.
The order decides how much work is done, never the verdict.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagewell.llm.shared import aside, batch

#: Texts expected in the sample that orders the rules.
SAMPLE = 2_000
WINDOW = 8
SYMBOLS = list(b"#*$%&|<>")
CAPITAL, LETTER = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}")


class Measures:
    """A text as bytes and what is counted of it; words are runs of other characters than ``[\\x20\\x09-\\x0D]``."""

    def __init__(self, data: bytes):
        self.data = data
        self.words = data.split()
        self.n_words = len(self.words)
        self.bytes = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
        blank = int(self.bytes[9:14].sum() + self.bytes[32])
        # Code points are the bytes that do not continue one.
        self.word_chars = len(data) - int(self.bytes[128:192].sum()) - blank
        self.n_symbols = int(self.bytes[SYMBOLS].sum())
        self.lines = [line for line in data.split(b"\n") if not line.isspace() and line]
        self.n_lines = len(self.lines)
        self.n_dup_lines = self.n_lines - len(set(self.lines))
        numbers: dict[bytes, int] = {}
        self.ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in self.words), np.int64, self.n_words)
        self.n_repeat_words = repeated_words(self.ids, WINDOW)

    @cached_property
    def text(self) -> str:
        return self.data.decode("utf-8", "replace")

    @property
    def base_failed(self) -> bool:
        return self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


def repeated_words(ids: np.ndarray, window: int) -> int:
    """How many words lie in a window of ``window`` words that occurs twice or more.

    ``window`` is a power of two: windows are numbered from pairs of half as long ones, so equal numbers are equal words.
    """
    names, width = ids, 1
    if len(ids) < window or len(np.unique(ids)) == len(ids):
        return 0
    while width < window:
        pairs = names[:-width] * (int(names.max()) + 1) + names[width:]
        _, names = np.unique(pairs, return_inverse=True)
        width *= 2
    starts = np.flatnonzero(np.bincount(names)[names] > 1)
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(marks[:-1])))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measures], bool]


def _capitals(m: Measures) -> bool:
    return 10 * len(CAPITAL.findall(m.text)) > 4 * len(LETTER.findall(m.text))


def _letterless(m: Measures) -> bool:
    return 10 * sum(1 for w in m.words if not LETTER.search(w.decode("utf-8", "replace"))) > 4 * m.n_words


def _one_word(m: Measures) -> bool:
    return 5 * int(np.bincount(m.ids).max(initial=0)) > m.n_words


def _one_pair(m: Measures) -> bool:
    pairs = Counter(zip(m.words, m.words[1:], strict=False))
    return 10 * max(pairs.values(), default=0) > m.n_words


def _ellipses(m: Measures) -> bool:
    return 10 * sum(1 for line in m.lines if line.rstrip().endswith((b"...", "…".encode()))) > 3 * m.n_lines


def _bullets(m: Measures) -> bool:
    return 10 * sum(1 for line in m.lines if line.lstrip().startswith((b"-", b"*", "•".encode()))) > 9 * m.n_lines


#: Whole-number thresholds, so that any engine comes to the same verdicts.
RULES = (
    Rule("letterless_words", _letterless),
    Rule("one_pair", _one_pair),
    Rule("capitals", _capitals),
    Rule("one_word", _one_word),
    Rule("ellipsis_lines", _ellipses),
    Rule("bullet_lines", _bullets),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 3 * m.n_lines),
    Rule("digits", lambda m: 5 * int(m.bytes[48:58].sum()) > m.word_chars),
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("short_words", lambda m: m.word_chars < 2 * m.n_words),
    Rule("long_words", lambda m: m.word_chars > 15 * m.n_words),
)


@dataclass(frozen=True)
class Estimate:
    """What the sample says of a rule: seconds a text, and the share of the texts reaching it that it rejects."""

    rule: str
    seconds: float
    rejected: float


def order_rules(outcomes: Sequence[tuple[int, int]], seconds: Sequence[float], names: Sequence[str]) -> list[Estimate]:
    """Order by rejection per cost. ``outcomes``: pairs of a bit set of the rules that reject and a number of texts."""
    left, open_, chosen = list(outcomes), set(range(len(names))), []
    while open_:
        total = sum(n for _, n in left)
        share = {r: sum(n for mask, n in left if mask >> r & 1) / total if total else 0.0 for r in open_}
        best = min(open_, key=lambda r: (-share[r] / max(seconds[r], 1e-9), seconds[r], r))
        chosen.append(Estimate(names[best], seconds[best], share[best]))
        open_.remove(best)
        left = [(mask, n) for mask, n in left if not mask >> best & 1]
    return chosen


def _data(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")


def plan(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> list[Estimate]:
    """The order of the rules for this table, from about ``sample`` of its texts that pass the base measures.

    Without a text to learn from, the rules keep their order.
    """
    n = docs.count()
    some = docs.sample(min(1.0, sample / n), seed=13) if n > sample else docs
    out = pa.schema([("mask", pa.int64()), ("n", pa.int64()), ("nanos", pa.list_(pa.int64()))])

    def try_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for part in batches:
            for value in part.column(0):
                measures = Measures(value.as_py())
                if measures.base_failed:
                    continue
                mask, nanos = 0, []
                for bit, rule in enumerate(rules):
                    measures.__dict__.pop("text", None)    # each rule pays for what it needs
                    start = time.perf_counter_ns()
                    mask |= int(bool(rule.rejects(measures))) << bit
                    nanos.append(time.perf_counter_ns() - start)
                held = found.setdefault(mask, [0, [0] * len(rules)])
                held[0] += 1
                held[1] = [a + b for a, b in zip(held[1], nanos, strict=True)]
        yield batch(out, {"mask": list(found), "n": [h[0] for h in found.values()], "nanos": [h[1] for h in found.values()]})

    rows = some.select(_data(docs, text_col).alias("data")).mapInArrow(try_all, "mask long, n long, nanos array<long>").groupBy("mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.get("nanos", F.lit(r))).alias(f"r{r}") for r in range(len(rules))]).collect()
    tried = sum(r["n"] for r in rows)
    seconds = [sum(row[f"r{r}"] for row in rows) / tried / 1e9 if tried else 0.0 for r in range(len(rules))]
    return order_rules([(r["mask"], r["n"]) for r in rows], seconds, [rule.name for rule in rules])


VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, rejected_by string, rules_run int")


def verdicts(
    docs: DataFrame, order: Sequence[Estimate], id_col: str = "doc_id", text_col: str = "text",
    rules: Sequence[Rule] = RULES,
) -> DataFrame:
    """Every row's id, base measures and verdict, with the rule that rejected it and how many rules ran.

    Null and empty texts have no words, so they fail the base. Texts that fail it run no rule: ``rejected_by`` is ``base``.
    Rows are judged one by one, also repeated ones, and no other column is read; an empty table gives no rows.
    """
    by_name = {rule.name: rule for rule in rules}
    cascade = [by_name[e.rule] for e in order]
    out = pa.schema([
        ("doc_id", pa.int64()), *((name, pa.int64()) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string()), ("rules_run", pa.int32())])

    def judge(data: bytes) -> tuple:
        m = Measures(data)
        reason, run = ("base" if m.base_failed else None), 0
        while reason is None and run < len(cascade):
            run += 1
            if cascade[run - 1].rejects(m):
                reason = cascade[run - 1].name
        return (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed, reason is None,
                reason, run)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            judged = list(zip(*(judge(value.as_py()) for value in part.column(1)), strict=True)) or [[]] * (len(out) - 1)
            yield batch(out, dict(zip(out.names, [part.column(0), *judged], strict=True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _data(docs, text_col).alias("data")).mapInArrow(
        run, f"doc_id long, {VERDICT}")


def keep(docs: DataFrame, order: Sequence[Estimate], text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that no rule rejects; decided in the row, without a join."""
    by_name = {rule.name: rule for rule in rules}
    cascade = [by_name[e.rule] for e in order]
    names = list(docs.columns)
    plain = aside(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            at = part.schema.get_field_index(text_col)
            stay = []
            for value in part.column(at):
                m = Measures((value.as_py() or "").encode("utf-8", "replace"))
                stay.append(not m.base_failed and not any(rule.rejects(m) for rule in cascade))
            yield part.filter(pa.array(stay, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
