"""Prefix trie, packing and structure repair against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from mediacat.llm import digests, packing, structure, trie
from mediacat.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
WORDS = public_tokenizers.path("word_bpe_49k.json")
NODE = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def odd_conversations(seed=7, convs=60):
    """Shared beginnings, nulls, ties, a long conversation and repeated rows, with odd roles."""
    rng = random.Random(seed)
    rows = []
    for c in range(-4, convs):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "üser"])
            text = rng.choice(["Yes.", "No!", "Perhaps ", "é?\n", "", " \t", None, "x" * 50 + "."])
            rows.append((c, None if turn == 0 and c % 7 == 0 else turn * rng.choice([1, 1, 1, 3]) if turn else 0, role, text))
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", "ok." if t % 5 else f"n {t}.") for t in range(300)]
    rows += [(1001, t, "user", f"n {t}." if t % 3 else f"n {t}") for t in range(300)]
    seen, out = set(), []
    for r in rows:  # turns are distinct, so that the order is given
        if r[:2] not in seen:
            seen.add(r[:2])
            out.append(r)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr(
        "*", "'x' AS at", "1 AS depth", "'k' AS plan", "array(1) AS ids", "2L AS nid", "'t' AS tie", "0 AS copy"
    ).drop("tie", "copy")


def trie_rows(nodes, ends):
    found = trie.with_ends_hash(nodes, ends).collect()
    out = {(r.conv_id, r.depth): tuple(r[c] for c in NODE) for r in found}
    assert len(out) == len(found)
    return out


@pytest.mark.parametrize("small", [False, True])
def test_trie(spark, monkeypatch, small):
    if small:  # many blocks, chunks and rounds
        monkeypatch.setattr(trie, "BLOCK", 4)
        monkeypatch.setattr(trie, "ARC_BLOCK", 32)
        monkeypatch.setattr(digests, "PIECE_BYTES", 8)
    rows = odd_conversations()
    rows += [(c, 0, "user", "Hello.") for c in range(2000, 2040)] + [(None, 0, "user", "x")]
    df = table(spark, rows)
    limits = {"local_rows": 16, "last": 20} if small else {}
    assert trie_rows(*trie.prefix_trie(df, **limits)) == brute.trie(rows)
    head, base = lambda c: zlib.crc32(str(c).encode()) % 9, lambda c: c - int(np.fmod(c, 5))
    got = trie.prefix_trie(df, F.crc32(F.col("conv_id").cast("string")) % 9, F.col("conv_id") - F.col("conv_id") % 5, **limits)
    assert trie_rows(*got) == brute.trie(rows, head, base)


def test_trie_of_equal_and_of_no_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    got = trie_rows(*trie.prefix_trie(table(spark, rows)))
    assert got == brute.trie(rows) and len(got) == 4
    nodes, ends = trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))
    assert trie.with_ends_hash(nodes, ends).count() == 0
    ties = table(spark, [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None)])
    assert len(trie_rows(*trie.prefix_trie(ties))) == 5


def test_list_ranks_of_a_long_chain(spark):
    n = 5000
    order = np.random.default_rng(3).permutation(n).tolist()
    arcs = [(a, b, a % 17, a % 5) for a, b in zip(order, order[1:] + [None])]
    arcs = spark.createDataFrame(arcs, "id long, succ long, conv_id long, depth long")
    ranks = {r.id: r["rank"] for r in trie.list_ranks(arcs, local_rows=64, last=10).collect()}
    assert [ranks[i] for i in order] == list(range(n))


def test_digests_of_groups_over_many_partitions(spark):
    rows = [(k, i, f"{k}-{i}" * (1 + i % 3)) for k, n in ((1, 2000), (2, 1), (None, 300), (3, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, item string").withColumn("item", digests.as_bytes("item"))
    for size in (1, 100, 1 << 20):
        got = {r.k: r.sha256 for r in digests.joined_digests(df, ["k"], ["i"], "item", b";", size).collect()}
        want = defaultdict(list)
        for k, _, item in rows:
            want[k].append(item)
        assert got == {k: brute.sha(";".join(items)) for k, items in want.items()}


def check_repair(spark, rows, segment_rows):
    df = table(spark, rows)
    found, lines = structure.repair(structure.damage(df), df, segment_rows)
    got = {r.conv_id: (tuple(r[c] for c in COUNTS), r.audit, r.repaired_sha256) for r in structure.with_repaired_hash(found, lines).collect()}
    convs = {c: [] for c, *_ in rows}
    for c, *rest in brute.damaged(rows):
        convs[c].append(rest)
    want = {c: brute.repair(sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0))) for c, turns in convs.items()}
    assert got == want


@pytest.mark.parametrize("segment_rows", [3, structure.SEGMENT])
def test_repair(spark, segment_rows):
    rows = odd_conversations(11, 120) + [(None, 0, "user", "x."), (None, 1, "assistant", "y.")]
    check_repair(spark, rows, segment_rows)


def test_repair_of_the_given_conversations(spark, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    found = QUERIES["op13_structure_repair"](spark, SF).collect()
    got = {r.conv_id: (tuple(r[c] for c in COUNTS), r.audit, r.repaired_sha256) for r in found}
    convs = {c: [] for c, *_ in rows}
    for c, *rest in brute.damaged(rows):
        convs[c].append(rest)
    assert got == {c: brute.repair(sorted(turns, key=lambda r: r[0])) for c, turns in convs.items()}


def test_repair_of_nothing(spark):
    none = table(spark, [])
    found, lines = structure.repair(structure.damage(none), none)
    assert structure.with_repaired_hash(found, lines).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = table(spark, [(5, gone, "user", "x.")])
    found, lines = structure.repair(structure.damage(df), df)
    (row,) = structure.with_repaired_hash(found, lines).collect()
    assert [row[c] for c in COUNTS] == [0] * 6 and row.audit == "" and row.repaired_sha256 == brute.sha("")


def test_runs_advance_as_single_rows():
    rng = random.Random(5)
    for _ in range(50):
        symbol, n = rng.randrange(16), rng.randint(1, 500)
        costs = structure.END
        for _ in range(n):
            costs = structure._back(symbol, costs)
        assert structure.run_costs(symbol, n, structure.END) == costs


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(pieces, want, key):
    """Every id in one piece, sequences gapless, padding rare; ``want`` lists each document's ids."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert sorted(docs, key=str) == sorted(want, key=str)
    for doc, ids in want.items():
        at = 0
        for p in sorted(docs[doc], key=lambda p: p.start):
            own = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(ids) and key(p) == (own if isinstance(key(p), (bytes, bytearray)) else zlib.crc32(own))
            at += p.length
        assert at == len(ids)
    padded = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and len({(p.tier, p.step) for p in own}) == 1
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded, sequences


def test_packing_of_the_given_documents(spark, duck):
    tokenizer = Tokenizer.from_file(WORDS)
    want = {i: ids_of(tokenizer, t) for i, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    pieces = QUERIES["op12_packing"](spark, SF).collect()
    padded, sequences = check_pieces(pieces, want, lambda p: p.ids_crc32)
    assert padded < 2048
    weights = defaultdict(int)
    for own in sequences.values():
        weights[own[0].tier, own[0].step] += own[0].tier
    last = {tier: max(s for t, s in weights if t == tier) for tier, _ in weights}
    assert all(w == packing.STEP_TOKENS for (t, s), w in weights.items() if s < last[t])


def test_packing_of_odd_documents(spark, odd, monkeypatch):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id not in (None, 8)]
    rows += [(100, "a b\x1cc\x85d é ́x İ ΣΑΣ it's 12ab　z"), (101, "x" * 300), (102, "<|endoftext|> y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(packing, "LONG_TEXT", 1000)  # in this process only; long texts are cut in test_long_texts
    pieces = packing.pack_documents(df, WORDS).collect()
    padded, _ = check_pieces(pieces, {i: ids_of(tokenizer, t) for i, t in rows}, lambda p: p.ids)
    assert padded < 2048
    assert packing.pack_documents(odd, WORDS).agg(F.sum("length")).first()[0] == sum(len(ids_of(tokenizer, r.text)) for r in odd.collect())
    again = {tuple(r) for r in packing.pack_documents(df, WORDS).collect()}
    assert again == {tuple(r) for r in pieces}


def test_packing_of_nothing(spark, nothing):
    assert packing.pack_documents(nothing, WORDS).count() == 0


def test_long_texts(monkeypatch):
    monkeypatch.setattr(packing, "LONG_TEXT", 100)
    monkeypatch.setattr(packing, "GROUP_CHARS", 500)
    monkeypatch.setattr(packing, "CACHED_WORDS", 50)
    rng = random.Random(2)
    words = ["Zq́", "ä", "it's", "x" * 70, "12ab", "\U0001f600", "a　b", "…"]
    texts = [" ".join(rng.choices(words, k=n)) for n in (3, 200, 0, 5, 1000, 40, 40)]
    tokenizer = Tokenizer.from_file(WORDS)
    got = packing.WordIds(WORDS).ids(texts, 1)
    assert [ids.tolist() for ids in got] == [ids_of(tokenizer, t) for t in texts]


class Counted:
    """A tokenizer that counts the words it is given."""

    def __init__(self, tokenizer, seen):
        self._tokenizer, self._seen = tokenizer, seen

    def encode(self, text, **options):
        self._seen += text.split()
        return self._tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        for text in texts:
            self._seen += text.split()
        return self._tokenizer.encode_batch_fast(texts, **options)


def test_capitals_and_marks_are_no_words_of_their_own():
    """A word is encoded once, however it is written and whatever marks follow it."""
    rng, seen = random.Random(4), []
    bare = ["".join(rng.choices("aeioubcdéüñœ", k=6)) for _ in range(40)]
    marks = ["", ".", ",", "!!", "$$$", ".%%%"]
    written = [write(w) + m for w in bare for m in marks for write in (str.lower, str.upper, str.capitalize)]
    rng.shuffle(written)
    words = packing.WordIds(WORDS)
    for name, held in list(vars(words).items()):
        if isinstance(held, Tokenizer):
            setattr(words, name, Counted(held, seen))
    got = [ids.tolist() for ids in words.ids([" ".join(written)], 1)]
    assert got == [ids_of(Tokenizer.from_file(WORDS), " ".join(written))]
    assert sorted(seen) == sorted(set(bare) | set(marks[1:]))


def test_every_letter_before_every_mark():
    tokenizer = Tokenizer.from_file(WORDS)
    letters = [chr(c) for c in (*range(0x41, 0x250), 0x391, 0x3A3, 0x3C2, 0x410, 0x1E9E, 0x301)]
    texts = [f"{c} a{c} {c}B{m} {c}{m} {m}{c} {c}{m}{c} {m}{m}{c}'s" for c in letters for m in ".$)'<|\u00b4"]
    got = packing.WordIds(WORDS).ids(texts, 1)
    assert [ids.tolist() for ids in got] == [ids_of(tokenizer, t) for t in texts]


def test_other_steps_before_the_model(tmp_path):
    """A tokenizer that keeps capitals, and one with a word of letters as a token of its own."""
    text = "Word word. WORD! Ärger ärger, end endless"
    for name in ("cased", "own"):
        tokenizer, file = Tokenizer.from_file(WORDS), str(tmp_path / name)
        if name == "cased":
            tokenizer.normalizer = NFC()
        else:
            tokenizer.add_special_tokens(["end"])
        tokenizer.save(file)
        assert [ids.tolist() for ids in packing.WordIds(file).ids([text], 1)] == [ids_of(tokenizer, text)]


def test_windows_take_whole_documents_first():
    packer = packing.Packer(packing.TIERS, 0)
    for doc, n in enumerate([2048 + 1000, 24, 600, 400, 24, 200]):
        packer.add(doc, np.arange(n, dtype=np.uint32))
    packer.finish()
    sequences = defaultdict(list)
    for doc, start, ids, *_, sequence, offset, tier, nth in packer.done:
        sequences[sequence].append((doc, len(ids)))
    assert [(0, 2048)] in sequences.values() and [(0, 1000), (4, 24)] in sequences.values()
    assert [(2, 600), (3, 400), (1, 24)] in sequences.values()
