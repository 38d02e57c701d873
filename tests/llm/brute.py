"""Brute-force versions of the operators, by the contracts' own words."""

import re


def shingle_set(text, n=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1)))


def near_duplicates(rows, percent=85):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids, by = sorted(sets), {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    seen = set()
    for group in by.values():
        for x in range(len(group)):
            for y in group[:x]:
                seen.add((y, group[x]))
    for a, b in seen:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def remove_repeats(rows, length=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept bytes)."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g))
    return out
