"""Hierarchical packing of documents into training sequences of several context sizes.

Every document becomes token ids plus an end id. Whole windows of the longest size leave at
once; what remains of a document is routed to the least tier (context size) that holds it.
Tiers are packed from the longest down: the longest remainder opens a window of its tier, and
the gap is filled by the longest remainders of shorter tiers that fit. Where none fits, the
shortest one is cut, so every window closes exactly at its size. Each input task packs its own
documents and passes on less than one window; those ends of 64 tasks are packed together, and
only the last sequence of such a block is padded. Nothing but the ends is ever shuffled.

Nulls: a null text is empty and has the end id alone; a null document id is kept as it is.
Repeated rows are documents of their own, an empty table gives no pieces, other columns are
ignored. A text over ``LONG_TEXT`` characters is tokenized in parts cut at blanks, which no
token crosses.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mediacat.runtime import materialize

TIERS = (2048, 1024, 512, 256)
# Tokens of a training step; a step holds sequences of one tier.
STEP_TOKENS = 1 << 16
# Remainders that wait in a task until they are packed together, in tokens.
POOL_TOKENS = 1 << 21
# Ends of this many tasks are packed together.
TASKS_PER_BLOCK = 64
LONG_TEXT = 1 << 20
# Pieces that leave a task together.
ROWS_OUT = 4_000
# Words a Python worker remembers: how many, and their characters.
CACHED_WORDS, CACHED_CHARS = 1 << 20, 1 << 25
# New words encoded as one text; the tokenizer takes more time a word for longer texts.
WORDS_TOGETHER = 256
# Texts are tokenized together up to this many characters.
GROUP_CHARS = 1 << 20

_BLANK = re.compile(r"[\x20\x09-\x0D]")
_MARKS = tuple(".,;:!?)")
# Letters without combining marks, each with one lower-case letter, and marks that make one match
# of the pattern below behind them.
_LETTERS, _TAIL = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f", ".,;:!?)$%&#*"
_SIMPLE = rf"\A[{_LETTERS}]+[{_TAIL}]*\z"
# The steps before the model under which a word of such letters and marks has the ids of its
# lower-case letters and those of the marks.
_STEPS = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [
            {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
        ],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {
                "type": "Split", "behavior": "Removed", "invert": True,
                "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            },
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _cuts_words(file: str) -> bool:
    """Whether the file has these steps and no token of its own that such a word could hold."""
    with open(file, encoding="utf-8") as f:
        spec = json.load(f)
    own = [t["content"] for t in spec.get("added_tokens") or ()]
    return all(spec.get(k) == v for k, v in _STEPS.items()) and all(re.search(f"[^{_LETTERS}{_TAIL}]", t) for t in own)


def _matches(word: str) -> int:
    """1 for letters alone, 2 for letters and one mark, 0 for anything else."""
    if word.isalpha() and (word.isascii() or word.lower().isalpha()):
        return 1
    return 2 if word[-1:] in _MARKS and _matches(word[:-1]) == 1 else 0


class _Growing:
    """An array that is extended in place."""

    def __init__(self, kind: type):
        self._data, self._n = np.zeros(1 << 12, kind), 0

    def extend(self, more: np.ndarray) -> None:
        end = self._n + len(more)
        if end > len(self._data):
            self._data = np.concatenate([self._data, np.zeros(max(end, len(self._data)), self._data.dtype)])
        self._data[self._n : end] = more
        self._n = end

    def view(self) -> np.ndarray:
        return self._data[: self._n]


class WordIds(dict):
    """Token ids of words between blanks: word -> number, and their ids in one array.

    The tokenizer drops white space and no match of its pattern crosses it, so a text's ids
    are those of its words in turn. New words get their numbers first and are encoded together.
    A word of Latin letters with capitals or marks behind them is put together from its
    lower-case letters and its marks, which are words too: a text has far fewer of those.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Split
        from tokenizers.pre_tokenizers import Sequence as Steps

        self._tokenizer = Tokenizer.from_file(file)
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        self._ends = self._letters = None
        if suffix:
            vocabulary = self._tokenizer.get_vocab()
            self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self._ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            if _cuts_words(file):
                # the same model; on lower-case letters the steps before it only cut at blanks
                self._letters = Tokenizer(self._tokenizer.model)
                self._letters.pre_tokenizer = Steps([Split(" ", "removed"), ByteLevel(add_prefix_space=False, use_regex=False)])
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self._new: list[str] = []
        self._flat, self._starts, self._counts = _Growing(np.uint32), _Growing(np.int64), _Growing(np.int64)
        self._chars = 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self._new.append(word)
        return n

    def _codes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def _learn(self) -> None:
        """Give the new words their ids, and the words that they are put together from."""
        first = len(self) - len(self._new)
        others: list[int] = []  # words for the whole tokenizer
        letters: list[int] = []
        whole, cores, tails = [], [], []
        names: list[str] = []
        while self._new:
            new, self._new = self._new, []
            numbers = np.arange(first + len(names), first + len(names) + len(new))
            names += new
            if self._letters is None:
                others += numbers.tolist()
                continue
            words = pa.array(new, pa.string())
            bare = pc.utf8_rtrim(words, characters=_TAIL)
            low = pc.utf8_lower(bare)
            plain = pc.match_substring_regex(words, _SIMPLE).to_numpy(zero_copy_only=False)
            same = pc.equal(low, words).to_numpy(zero_copy_only=False)
            others += numbers[~plain].tolist()
            letters += numbers[plain & same].tolist()
            at = np.flatnonzero(plain & ~same)
            if len(at):
                parts = low.take(pa.array(at)).to_pylist()
                whole.append(numbers[at])
                cores.append(self._codes(parts))
                tails.append(self._codes([new[k][len(core) :] for k, core in zip(at.tolist(), parts)]))
        self._chars += sum(map(len, names))
        unset = np.zeros(len(names), np.int64)
        self._starts.extend(unset)
        self._counts.extend(unset)
        others += self._encode_letters(first, names, letters)
        self._encode(first, names, others)
        if whole:
            whole, pair = np.concatenate(whole), np.stack([np.concatenate(cores), np.concatenate(tails)], 1)
            ids, upto = self._gather(pair.ravel())
            self._store(whole, ids, np.diff(upto[::2]))

    def _store(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Keep the ids of some words, given one after the other."""
        self._starts.view()[numbers] = len(self._flat.view()) + np.cumsum(counts) - counts
        self._counts.view()[numbers] = counts
        self._flat.extend(ids)

    def _gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in turn, number of ids up to each word)."""
        counts = self._counts.view()[codes]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return self._flat.view()[np.arange(upto[-1]) + np.repeat(self._starts.view()[codes] - upto[:-1], counts)], upto

    def _encode_letters(self, first: int, names: list[str], numbers: list[int]) -> list[int]:
        """Encode words of lower-case letters, many as one text; those that do not add up are returned.

        A word ends at a token with the end-of-word suffix.
        """
        if not numbers:
            return []
        groups = [numbers[at : at + WORDS_TOGETHER] for at in range(0, len(numbers), WORDS_TOGETHER)]
        texts = [" ".join([names[n - first] for n in group]) for group in groups]
        left: list[int] = []
        for group, found in zip(groups, self._letters.encode_batch_fast(texts, add_special_tokens=False)):
            flat = np.array(found.ids, np.uint32)
            stops = np.flatnonzero(self._ends[flat]) + 1
            if len(stops) != len(group) or stops[-1] != len(flat):
                left += group
                continue
            self._store(np.array(group), flat, np.diff(stops, prepend=0))
        return left

    def _encode(self, first: int, names: list[str], numbers: list[int]) -> None:
        """Encode words by the whole tokenizer, many as one text, and deal its ids out.

        Letters alone are one match of the pattern, letters with one mark behind them are two, and a
        match ends at a token with the end-of-word suffix. Other words, and texts where the
        suffixes do not add up, are told apart by the places of their tokens, which takes longer.
        """
        numbers = np.array(numbers, np.int64)
        new = [names[n - first] for n in numbers.tolist()]
        matches = np.array([_matches(w) if self._ends is not None else 0 for w in new], np.int64)
        plain, odd = np.flatnonzero(matches), np.flatnonzero(matches == 0).tolist()
        groups = [plain[at : at + WORDS_TOGETHER] for at in range(0, len(plain), WORDS_TOGETHER)]
        texts = [" ".join([new[k] for k in group]) for group in groups]
        for group, found in zip(groups, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            flat = np.array(found.ids, np.uint32)
            ends = np.flatnonzero(self._ends[flat]) + 1
            upto = np.cumsum(matches[group])
            if len(ends) != upto[-1] or ends[-1] != len(flat):
                odd += group.tolist()
                continue
            self._store(numbers[group], flat, np.diff(ends[upto - 1], prepend=0))
        for at in range(0, len(odd), WORDS_TOGETHER):
            group = odd[at : at + WORDS_TOGETHER]
            found = self._tokenizer.encode(" ".join([new[k] for k in group]), add_special_tokens=False)
            edges = np.cumsum([len(new[k]) + 1 for k in group])
            owner = np.searchsorted(edges, np.array([o[0] for o in found.offsets], np.int64), "right")
            self._store(numbers[group], np.array(found.ids, np.uint32), np.bincount(owner, minlength=len(group)))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts in turn, number of ids up to each text)."""
        if len(self) > CACHED_WORDS or self._chars > CACHED_CHARS:
            self._forget()
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        known = self._codes(words.dictionary.to_pylist())
        if self._new:
            self._learn()
        ids, upto = self._gather(known[words.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return ids, upto[ends]

    def _long(self, text: str) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            blank = _BLANK.search(text, at + LONG_TEXT)
            stop = blank.start() if blank else len(text)
            out.append(self._words(pa.array([text[at:stop]]))[0])
            at = stop
        return np.concatenate(out)

    def ids(self, texts: Iterable[str] | pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text and ``end_id``."""
        end = np.array([end_id], np.uint32)
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        sizes = pc.utf8_length(texts).to_numpy().tolist()
        at = 0
        while at < len(sizes):
            stop, chars = at + 1, sizes[at]
            if chars > GROUP_CHARS:
                yield np.concatenate([self._long(texts[at].as_py()), end])
                at = stop
                continue
            while stop < len(sizes) and chars + sizes[stop] <= GROUP_CHARS:
                chars += sizes[stop]
                stop += 1
            ids, upto = self._words(texts[at:stop])
            for first, last in pairwise(upto.tolist()):
                yield np.concatenate([ids[first:last], end])
            at = stop


# One memory per Python worker, which serves many tasks.
_MEMORY: dict[str, WordIds] = {}


def _word_ids(file: str) -> WordIds:
    if file not in _MEMORY:
        _MEMORY[file] = WordIds(file)
    return _MEMORY[file]


class Packer:
    """Packs pieces (document, start, ids, document's tokens) into windows of the tiers.

    ``done`` gathers closed pieces: (doc, start, ids, tokens, sequence, offset, tier, nth of
    the tier). ``rest`` holds what waits, sorted by length.
    """

    def __init__(self, tiers: tuple[int, ...], first_sequence: int):
        self.tiers, self.up = tiers, sorted(tiers)
        self.sequence, self.nth = first_sequence, dict.fromkeys(tiers, 0)
        self.done: list[tuple] = []
        self.rest: list[tuple] = []  # (length, arrival, doc, start, ids, tokens)
        self.arrivals = self.waiting = 0

    def add(self, doc, ids: np.ndarray) -> None:
        """A whole document: full windows leave, the remainder waits in its tier."""
        top, n = self.tiers[0], len(ids)
        for start in range(0, n - top + 1, top):
            self._close(top, [(top, 0, doc, start, ids[start : start + top], n)])
        if n % top:
            self.wait(doc, n - n % top, ids[n - n % top :].copy(), n)  # a view would hold the whole document
        if self.waiting > POOL_TOKENS:
            self.pack()

    def wait(self, doc, start: int, ids: np.ndarray, tokens: int) -> None:
        self.rest.append((len(ids), self.arrivals, doc, start, ids, tokens))
        self.arrivals += 1
        self.waiting += len(ids)

    def _close(self, tier: int, pieces: list[tuple]) -> None:
        offset = 0
        for length, _, doc, start, ids, tokens in pieces:
            self.done.append((doc, start, ids, tokens, self.sequence, offset, tier, self.nth[tier]))
            offset += length
        self.sequence += 1
        self.nth[tier] += 1

    def _window(self, size: int, pieces: list[tuple]) -> bool:
        """Fill the gap behind ``pieces`` from the rest; False (all back) if the rest runs out."""
        gap = size - sum(p[0] for p in pieces)
        while gap and self.rest:
            k = bisect_right(self.rest, (gap + 1,)) - 1
            if k >= 0:
                piece = self.rest.pop(k)
            else:
                length, arrival, doc, start, ids, tokens = self.rest.pop(0)
                piece = (gap, arrival, doc, start, ids[:gap], tokens)
                insort(self.rest, (length - gap, arrival, doc, start + gap, ids[gap:], tokens), key=lambda p: p[:2])
            pieces.append(piece)
            gap -= piece[0]
        if gap:
            self.rest = sorted(pieces, key=lambda p: p[:2])
            return False
        self._close(size, pieces)
        return True

    def pack(self) -> None:
        """Close windows, longest tier first, until what waits does not fill one."""
        self.rest.sort(key=lambda p: p[:2])
        while self.rest:
            longest = self.rest.pop()
            size = next(t for t in self.up if t >= longest[0])
            if not self._window(size, [longest]):
                break
        self.waiting = sum(p[0] for p in self.rest)

    def finish(self) -> None:
        """Close everything: whole windows of ever shorter tiers, then one padded sequence."""
        self.pack()
        for size in self.tiers:
            while sum(p[0] for p in self.rest) >= size:
                self._window(size, [])
        if self.rest:
            self._close(self.tiers[0], self.rest)
            self.rest = []


def _rows(packer: Packer, doc_type: pa.DataType, part: int, most: int = ROWS_OUT) -> pa.RecordBatch:
    rows, packer.done = packer.done[:most], packer.done[most:]
    doc, start, ids, tokens, sequence, offset, tier, nth = [[row[k] for row in rows] for k in range(8)]
    arrays = [
        pa.array(doc, doc_type), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(tokens, pa.int64()),
        pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), pa.array(tier, pa.int32()), pa.array(nth, pa.int64()),
        pa.array([part] * len(doc), pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
    ]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "nth", "part", "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)


def _schema(doc_type: str) -> str:
    return (
        f"doc_id {doc_type}, start long, length long, doc_tokens long, sequence_id long, offset long, "
        "tier int, nth long, part long, ids binary"
    )


def _packed(file: str, end_id: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words, packer, kind = _word_ids(file), Packer(tiers, part << 32), None
        for batch in batches:
            kind = batch.column(0).type
            for doc, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1), end_id)):
                packer.add(doc, ids)
                while len(packer.done) >= ROWS_OUT:
                    yield _rows(packer, kind, part)
        if kind is not None:
            packer.pack()
            while len(packer.done) >= ROWS_OUT:
                yield _rows(packer, kind, part)
            packer.done += [(doc, start, ids, tokens, None, None, None, None) for _, _, doc, start, ids, tokens in packer.rest]
            yield _rows(packer, kind, part)

    return run


def _repacked(tiers: tuple[int, ...]):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = key[0].as_py()
        packer = Packer(tiers, (1 << 62) + (block << 24))
        table = table.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        for doc, start, tokens, ids in zip(*[table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")]):
            packer.wait(doc, start, np.frombuffer(ids, "<u4"), tokens)
        packer.finish()
        return pa.Table.from_batches([_rows(packer, table.schema.field("doc_id").type, -1 - block, len(packer.done))])

    return run


def pack_documents(
    docs: DataFrame, tokenizer_file: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS
) -> DataFrame:
    """Pieces of documents in sequences: (doc_id, start, length, doc_tokens, sequence_id, offset, tier, step, ids).

    ``ids`` are the piece's token ids, little-endian with 32 bits each. ``tier`` is the size
    that the sequence is padded to; all but one sequence in a block of tasks fill it exactly.
    ``step`` numbers the training steps of a tier: each holds ``step_tokens`` of its windows,
    so that steps weigh the same whatever their context size, the last of a tier aside.
    Tokenizer strings such as an end mark inside a text are read as the tokenizer file says.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    first = materialize(texts.mapInArrow(_packed(tokenizer_file, end_id, tiers), _schema(kind)), "packed")
    ends = first.filter("sequence_id IS NULL").withColumn("__block", F.expr(f"part div {TASKS_PER_BLOCK}"))
    second = materialize(ends.groupBy("__block").applyInArrow(_repacked(tiers), _schema(kind)), "ends")
    pieces = first.filter("sequence_id IS NOT NULL").unionByName(second)
    # one row per task that packed and tier, so its size is bounded by the tasks and it is broadcast
    sizes = pieces.filter("offset = 0").groupBy("part", "tier").agg(F.count("*").alias("__n"))
    earlier = W.partitionBy("tier").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("part", "tier", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    step = F.floor((F.col("__before") + F.col("nth")) * F.col("tier") / step_tokens).cast("long")
    out = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step", "ids"]
    return pieces.join(F.broadcast(before), ["part", "tier"]).withColumn("step", step).select(*out)
