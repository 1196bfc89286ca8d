"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs):
    """[(doc_id, text)] -> [(doc_id, n_lines, n_dropped, kept text)] in the same order."""
    holders = defaultdict(set)
    keys = []
    for i, text in docs:
        lines = (text or "").split("\n")
        keys.append([(x, x.strip(BLANKS).translate(LOWER)) for x in lines])
        for _, k in keys[-1]:
            if len(k) >= 20:
                holders[k].add(-1 if i is None else i)
    out = []
    for (i, _), lines in zip(docs, keys):
        own = -1 if i is None else i
        kept = [x for x, k in lines if len(k) < 20 or len(holders[k]) < 3 or max(holders[k]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= 5:
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def components(docs):
    """{doc_id: (n_shingles, component_id)} of documents with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    lead = {i: i for i in sets}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                lead[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    often = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = set()
    for k in range(len(words) - 7):
        if often[tuple(words[k : k + 8])] > 1:
            covered |= set(range(k, k + 8))
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_chars": len(text),
        "n_lines": text.count("\n") + 1,
        "n_upper": len(re.findall("[A-Z]", text)),
        "n_digits": len(re.findall("[0-9]", text)),
        "n_marks": len(re.findall("[!?.,;:]", text)),
        "n_distinct": len(set(words)),
    }


def substrings(docs):
    """[(doc_id, text)] -> [(doc_id, n_words, n_removed, kept_sha256)] in the same order."""
    first, words = {}, []
    for i, text in docs:
        own = -1 if i is None else i
        words.append(WORD.findall(text or ""))
        for k in range(len(words[-1]) - 12):
            gram = tuple(words[-1][k : k + 13])
            first[gram] = min(first.get(gram, own), own)
    out = []
    for (i, _), ws in zip(docs, words):
        own = -1 if i is None else i
        gone = [False] * len(ws)
        for k in range(len(ws) - 12):
            if first[tuple(ws[k : k + 13])] < own:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(ws), sum(gone), sha(" ".join(w for w, g in zip(ws, gone) if not g))))
    return out


def _by_turn(rows, tie):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))


def trie(rows, head=lambda c: 0, base=lambda c: c):
    """[(conv_id, turn, role, text)] -> {(conv_id, depth): the node's other columns}; turns are distinct."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, role or "", text or ""))
    convs = {c: [r[1:] for r in _by_turn(turns, lambda r: 0)] for c, turns in convs.items()}
    built = {c: tuple(convs.get(base(c), [])[: head(c)] + turns[head(c) :]) for c, turns in convs.items()}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children = Counter(n[:-1] for n in members if n)
    leaves, saved = Counter(), Counter()
    for n, own in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in children
            saved[n[:d]] += (len(own) - 1) * len(n[-1][1].encode()) if n else 0
    out = {}
    for n, own in members.items():
        ends = ",".join(str(c) for c in own if built[c] == n)
        parent = members[n[:-1]][0] if n else None
        out[own[0], len(n)] = (parent, len(own), children[n], leaves[n], saved[n], sha(ends))
    return out


def damaged(rows):
    """[(conv_id, turn, role, text)] -> the rows after damage, doubled ones side by side."""
    out = []
    for c, turn, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(key.encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(c, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def repair(turns):
    """Rows (turn, role, text) of one conversation in order -> (counts and cost, audit, hash), by trying all edits."""
    faults, seen = [], set()
    for _, role, text in turns:
        core = text.strip(BLANKS)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    known = [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    initials = [r[:1] for _, r, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    # Audits of one state after the same rows are followed by the same letters, so the least one of the cheapest stays.
    states = {("", 0, "", ())}
    for (_, role, text), fault in zip(turns, faults):
        grown = set()
        for state, cost, audit, lines in states:
            more = [(state, cost, audit, lines)]
            for s, c, a, ls in more:
                if c < cost + 10:
                    more += [(n[0], c + 5, a + "I", (*ls, f"{n}:")) for n in ("user", "assistant") if (s, n[0]) in step]
            for s, c, a, ls in more:
                grown.add((s, c + 2, a + "D", ls))
                if fault in ("", "truncated"):
                    extra = 5 if fault else 0
                    if role and (s, role[0]) in step:
                        grown.add((step[s, role[0]], c + extra, a + "K", (*ls, f"{role}:{text}")))
                    grown |= {(n[0], c + extra + 1, a + "R", (*ls, f"{n}:{text}")) for n in ("user", "assistant") if (s, n[0]) in step}
        states = {min((x for x in grown if x[0] == s), key=lambda x: x[1:3]) for s in {x[0] for x in grown}}
    ended = [(c, a, ls) for s, c, a, ls in states if s in ("", "a")]
    ended += [(c + 5, a + "I", (*ls, "assistant:")) for s, c, a, ls in states if s == "u"]
    ended += [(c + 10, a + "II", (*ls, "user:", "assistant:")) for s, c, a, ls in states if s == "s"]
    cost, audit, lines = min(ended)
    n = Counter(faults)
    return (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost), audit, sha("\n".join(lines))
