"""Documents with every odd case, and brute-force versions of the operators."""

import hashlib
import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _t string, keep_id string, score double, n int, h string, doc int, size string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(n=120, seed=5):
    """Rows of random prose with copies, near copies, shared passages, and nulls, empty, tiny and very long texts."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghiéß日") for _ in range(rnd.randint(1, 9))) for _ in range(300)]
    prose = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    passage, base = prose(40), prose(80)
    texts = [None, None, "", "", " \n\t ", "a", "a b", "x" * 30_000, "ab " * 9_000, prose(6_000), "日本語の文" * 50]
    texts += [base] * 6
    for i in range(8):  # near copies: some words replaced
        w = base.split()
        for _ in range(i % 3):
            w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{prose(5)} {passage} {prose(5)}" for _ in range(8)]
    texts += [prose(rnd.randint(1, 150)) for _ in range(n - len(texts))]
    ids = rnd.sample(range(-50, 10 * n), len(texts))
    rows = [(i, t, "en", rnd.choice(["s0", "s0", "s1", "S2", "é", None, ""]), None, "x", "y", 1.0, 2, "z", 3, "w") for i, t in zip(ids, texts)]
    return rows


def sets(text, k=5):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or {tuple(w)}) if w else set()


def components(docs, num=80, den=100):
    """id: (set size, component, links) by comparing all pairs."""
    s = {i: sets(t) for i, t in docs}
    parent = {i: i for i in s}
    links = dict.fromkeys(s, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b]:
                o = len(s[a] & s[b])
                if den * o >= num * (len(s[a]) + len(s[b]) - o):
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i), links[i]) for i in ids}


def repeats(docs, length):
    """id: (bytes, removed, spans, digest of the rest), by a set of all strings seen."""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out
