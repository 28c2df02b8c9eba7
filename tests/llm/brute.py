"""Plain Python definitions that the corpus operators are tested against."""

import hashlib
import re


def sha(b) -> str:
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def substring_dedup(rows, width=20):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
        out[doc] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def suffix_dedup(rows, width=400):
    texts = {d: (t or "").encode() for d, t in rows}
    count = {}
    for b in texts.values():
        for i in range(len(b) - width + 1):
            h = b[i : i + width]
            count[h] = count.get(h, 0) + 1
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if count[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        runs = re.findall(rb"\x01+", bytes(gone))
        out[d] = (len(b), sum(gone), len(runs), sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def line_dedup(rows):
    space = " \t\n\r\x0b\x0c"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(space).translate(lower)
    docs = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                docs.setdefault(key(line), set()).add(d)
    out = {}
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(docs.get(key(x), ())) < 3 or max(docs[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(keep), sha("\n".join(keep)))
    return out


def near_dups(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for d in sorted(sets):
        for s in sets[d]:
            by.setdefault(s, []).append(d)
    shared = {}
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] = shared.get((a, b), 0) + 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def decontaminate(rows, items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out
