"""Quality rules: decision lists learned by sequential covering from labelled statistics.

Every text is reduced to counts. A bounded sample of labelled rows is split into a growing
and a pruning part. A rule for the rejected class starts empty, takes the threshold test
with the best information gain until it is pure on the growing part, and then loses tests
from its end as long as that helps on the pruning part. Rows it covers leave, and the next
rule is grown on the rest, until a rule is not precise enough to be worth having. The list
becomes one ordered conditional expression over the counts.

Defined results: a null text has no words and fails the base rules; empty and very long
texts are counted whole; a null doc_id is kept as it is; rows repeated exactly are judged
alike; without labels of both classes the list is empty and the base rules decide alone; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediacat.llm.words import grouped, mix64, window_hashes

# Production parameters of the base rules and of the learner.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SAMPLE = 20_000  # labelled rows at most; the smallest hashes of doc_id
MAX_RULES = 16
MAX_TESTS = 4
CUTS = 64  # thresholds tried for a feature
MIN_PRECISION = 0.95  # on the pruning part
MIN_COVER = 3  # rejected rows a rule covers at least there

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_chars", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct",
]

# The symbols that the base statistics count.
SYMBOLS = "#*$%&|<>"


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars.encode(), np.uint8)] = True
    return table


_SYMBOL = _class(SYMBOLS)
_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _class("0123456789")
_MARK = _class("!?.,;:")


def _dup_lines(data: bytes) -> int:
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of each text of a column."""
    out: dict[str, list[np.ndarray]] = {c: [] for c in COUNTS}
    for _, _, w in grouped(column):
        at = w.offsets

        def per_text(flags, at=at):
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[at[1:]] - sums[at[:-1]]

        char = (w.data & 0xC0) != 0x80
        out["n_words"].append(w.n_words)
        out["n_chars"].append(per_text(char))
        out["word_chars"].append(per_text(char & w.word))
        out["n_lines"].append(per_text(w.data == 10) + 1)
        for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_marks", _MARK)):
            out[name].append(per_text(table[w.data]))
        body = w.data.tobytes()
        out["n_dup_lines"].append(np.array([_dup_lines(body[a:b]) for a, b in zip(at[:-1], at[1:])], np.int64))
        hashes, text = w.hashes(), w.text_of()
        salt = mix64(text.astype(np.uint64))
        distinct = np.zeros(len(at) - 1, np.int64)
        if len(hashes):
            _, first = np.unique(hashes ^ salt, return_index=True)
            distinct = np.bincount(text[first], minlength=len(at) - 1)
        out["n_distinct"].append(distinct)
        out["n_repeat_words"].append(_repeated(hashes, text, salt, len(at) - 1))
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}


def _repeated(hashes, text, salt, n_texts) -> np.ndarray:
    """Words inside windows that their text has twice or more."""
    spans = window_hashes(hashes, WINDOW)
    inside = np.flatnonzero(text[: len(spans)] == text[WINDOW - 1 : WINDOW - 1 + len(spans)])
    if not len(inside):
        return np.zeros(n_texts, np.int64)
    key = spans[inside] ^ salt[inside]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    starts = inside[again]
    edge = np.zeros(len(hashes) + WINDOW + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.cumsum(edge)[: len(hashes)] > 0
    return np.bincount(text[covered], minlength=n_texts)


def with_counts(docs: DataFrame, text: str = "text", prefix: str = "__") -> DataFrame:
    """``docs`` with one column per statistic, named with ``prefix``; rows stay where they are."""
    names = docs.columns
    added = [prefix + c for c in COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_texts(batch.column(text))
            arrays = list(batch.columns) + [pa.array(counts[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(arrays, [*names, *added])

    schema = docs.select(*names).schema
    for c in added:
        schema = schema.add(c, "long")
    return docs.mapInArrow(run, schema)


def features(prefix: str = "__") -> dict[str, Column]:
    """What rules test: counts and shares of counts, as columns."""

    def c(name):
        return F.col(prefix + name).cast("double")

    words, chars = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_chars"), F.lit(1.0))
    return {
        "words": c("n_words"),
        "word_length": c("word_chars") / words,
        "symbols_per_word": c("n_symbols") / words,
        "dup_line_share": c("n_dup_lines") / c("n_lines"),
        "repeat_share": c("n_repeat_words") / words,
        "words_per_line": c("n_words") / c("n_lines"),
        "upper_share": c("n_upper") / chars,
        "digit_share": c("n_digits") / chars,
        "marks_per_word": c("n_marks") / words,
        "distinct_share": c("n_distinct") / words,
    }


def base_failed(prefix: str = "__") -> Column:
    words = F.col(f"{prefix}n_words")
    return (words < MIN_WORDS) | (F.col(f"{prefix}n_repeat_words") * 100 > words * MAX_REPEAT_PERCENT)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] >= self.cut if self.above else data[self.feature] <= self.cut

    def column(self, known: dict[str, Column]) -> Column:
        return known[self.feature] >= F.lit(self.cut) if self.above else known[self.feature] <= F.lit(self.cut)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.cut:g}"


Rule = tuple[Test, ...]


def _covers(rule: Rule, data: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for test in rule:
        hit &= test.holds(data)
    return hit


def _grow(data: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the test of highest information gain until only rejected rows are covered."""
    rule: list[Test] = []
    hit = np.ones(len(bad), bool)
    while len(rule) < MAX_TESTS and (hit & ~bad).any():
        p0, n0 = int((hit & bad).sum()), int((hit & ~bad).sum())
        if not p0:
            break
        before, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for name in sorted(data):
            values, marks = data[name][hit], bad[hit]
            order = np.argsort(values, kind="stable")
            values, marks = values[order], marks[order]
            ends = np.flatnonzero(np.diff(values))  # a cut lies between two different values
            if not len(ends):
                continue
            ends = np.unique(ends[np.linspace(0, len(ends) - 1, min(CUTS, len(ends))).astype(int)])
            p_low = np.cumsum(marks)[ends]
            low = ends + 1
            cuts = (values[ends] + values[ends + 1]) / 2
            for above, p, t in ((False, p_low, low), (True, p0 - p_low, len(values) - low)):
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / t) - before), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Test(name, above, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit &= best[1].holds(data)
    return tuple(rule)


def _worth(rule: Rule, data, bad) -> tuple[float, int]:
    hit = _covers(rule, data, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0, p


def learn(data: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """The ordered rules that reject. ``data`` has one array per feature, in a fixed order of rows."""
    rules: list[Rule] = []
    turn = np.arange(len(bad)) % 3 == 2  # a third of the rows prunes
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = left & ~turn, left & turn
        if not bad[grow].any() or not bad[prune].any():
            break
        rule = _grow({k: v[grow] for k, v in data.items()}, bad[grow])
        test = {k: v[prune] for k, v in data.items()}
        options = [rule[:n] for n in range(1, len(rule) + 1)]
        if not options:
            break
        rule = max(options, key=lambda r: (*_worth(r, test, bad[prune]), -len(r)))
        worth, covered = _worth(rule, test, bad[prune])
        if (worth + 1) / 2 < MIN_PRECISION or covered < MIN_COVER:
            break
        rules.append(rule)
        left &= ~_covers(rule, data, len(bad))
    return rules


def verdict(rules: list[Rule], prefix: str = "__") -> Column:
    """The list as one conditional expression: true keeps the row."""
    known, out = features(prefix), None
    for rule in rules:
        when = None
        for test in rule:
            when = test.column(known) if when is None else when & test.column(known)
        out = F.when(when, F.lit(False)) if out is None else out.when(when, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Learn from at most ``sample`` labelled rows; only their statistics reach the driver."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # bounded by ``sample``, so it may be broadcast
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "quality")
    wanted = [c.alias(n) for n, c in features().items()]
    got = with_counts(rows).filter(~base_failed()).select("doc_id", "quality", *wanted).toPandas()
    got = got.drop_duplicates().assign(key=lambda x: mix64(x["doc_id"].to_numpy().astype(np.uint64)))
    got = got.sort_values(["key", *got.columns[:-1]], kind="stable")
    data = {n: got[n].to_numpy(dtype=float) for n in features()}
    return learn(data, got["quality"].to_numpy() == 0)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with its statistics, ``__base_failed`` and ``__kept``."""
    return (
        with_counts(docs)
        .withColumn("__base_failed", base_failed())
        .withColumn("__kept", ~F.col("__base_failed") & verdict(rules))
    )
