"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import re
from collections import defaultdict
from zlib import crc32


def repeated_bytes(docs, length=200, keep="none"):
    """{doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} for distinct ids."""
    texts = {i: (t or "").encode() for i, t in docs}
    seen = defaultdict(int)
    for b in texts.values():
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] += 1
    first, out = set(), {}
    for i in sorted(texts, key=lambda i: (i is not None, i or 0, crc32(texts[i]))):
        b = texts[i]
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if (seen[w] > 1) if keep == "none" else w in first:
                gone[s : s + length] = b"\1" * length
            first.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def near_groups(docs, k, percent):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs that share a shingle."""
    sets, at = {}, defaultdict(list)
    for i, t in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
        for g in sets[i]:
            at[g].append(i)
    both = defaultdict(int)
    for found in at.values():
        for x in range(len(found)):
            for y in range(x):
                both[found[y], found[x]] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def contamination(docs, items, window=10):
    """[(doc_id, n_words, n_hit, n_items, sha256)] in the order of ``docs``."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    found = defaultdict(set)
    sizes = set()
    for i, t in items:
        w = word.findall(lower(t))
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            found[tuple(w[s : s + n])].add(i)
            sizes.add(n)
    out = []
    for i, t in docs:
        w = word.findall(lower(t))
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if m := found.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    ids |= m
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
    return out


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows, fanout=2):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] sorted as text; rows: dicts of the five fields."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: _h(field(r[k]) for k in names)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([_h(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, i):
        out = []
        for level in tree[:-1]:
            run = i // fanout * fanout
            out.append((level[run:i], level[i + 1 : run + fanout]))
            i //= fanout
        return out

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((r for r in rows if r["lang"] == g), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for g in langs}
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in langs}
    top = levels([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, k)
            bent = r["doc_id"] is not None and crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None
            node = leaf(r | {"n_chars": r["n_chars"] + 1}) if bent else leaf(r)
            for a, b in steps:
                node = _h([*a, node, *b])
            root = top[-1][0]
            out.append((r["doc_id"], leaf(r), trees[g][-1][0], root, _h(x for a, b in steps for x in a + b), node, node == root))
    return sorted(out, key=str)
