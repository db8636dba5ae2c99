"""Plain versions of the operators that SQL cannot check, for small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash


def suffix_dedup(texts, length):
    """Rows of ``(doc, n_bytes, n_removed, n_spans, kept)``; ``texts`` is a list of (doc, text)."""
    data = [(doc, (t or "").encode()) for doc, t in texts]
    seen = defaultdict(int)
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for doc, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((doc, len(b), int(gone.sum()), _spans(gone), bytes(x for x, g in zip(b, gone) if not g)))
    return out


def _spans(gone):
    return sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))


def substring_dedup(texts, length):
    """Rows of ``(doc, n_words, n_removed, kept)``; null ids come last."""
    rows = [(doc, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for doc, t in texts]
    order = lambda doc: (doc is None, doc or 0)
    first = {}
    for doc, w in rows:
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key not in first or order(doc) < first[key]:
                first[key] = order(doc)
    out = []
    for doc, w in rows:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] < order(doc):
                gone[i : i + length] = True
        out.append((doc, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone) if not g).encode()))
    return out


def fingerprint(text, shingle=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not w:
        return 0
    pieces = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    """``(id, fingerprint)`` rows -> list of the smallest id of each row's group."""
    group = list(range(len(prints)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= bits:
                group[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(prints):
        r = root(i)
        if doc is not None:
            smallest[r] = min(doc, smallest.get(r, doc))
    return [smallest.get(root(i)) for i in range(len(prints))]


def nearest(rows, k, every):
    """``{query: [(id, cosine)]}`` over usable rows of (id, vector)."""
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = [(-float(np.dot(v, w) / np.sqrt(np.dot(v, v)) / np.sqrt(np.dot(w, w))), i) for i, w in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_pii(text):
    """``kind:start:end`` of the base matches that pass their checks."""
    found = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0,
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}"))
    return [f for *_, f in sorted(found)]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def merkle_leaf(row, text):
    """Digest of a row of documents, ``text`` in place of its text."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha("".join(map(field, (row["doc_id"], row["source"], row["lang"], row["n_chars"], text))).encode())


def merkle(rows, tampered):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` per row; ``tampered(row)`` says which are."""

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 16]).encode()) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            start = i - i % 16
            out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 16])))
            i //= 16
        return out

    by_source = defaultdict(list)
    for r in rows:
        by_source[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, merkle_leaf(r, r["text"]), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: x[:3])
        trees[s] = levels([x[2] for x in by_source[s]])
    crown, out = levels([trees[s][-1][0] for s in order]), []
    for j, s in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(by_source[s]):
            steps, digest = path(trees[s], i) + path(crown, j), leaf
            if tampered(r) and r["text"] is not None:
                digest = merkle_leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
            for left, right in steps:
                digest = sha((left + digest + right).encode())
            proof, root = sha("".join(a + b for a, b in steps).encode()), crown[-1][0]
            out.append((r["doc_id"], leaf, trees[s][-1][0], root, proof, digest, digest == root))
    return out


def one_edit(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(counts, ratio=5):
    """``(word, form, root, n, n_near, form_n)`` for a dict of words and counts."""
    form, near = {}, {}
    for w, n in counts.items():
        found = [v for v in counts if one_edit(w, v)]
        near[w], best = len(found), min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], None if form[w] is None else counts[form[w]]))
    return out
