"""Plain versions of operators that several tests use."""

import numpy as np


def naive_score(net, text: bytes) -> float:
    """Chunk by chunk and position by position, with the filters as they are."""
    logits = []
    for lo in range(0, max(len(text) - 32, 1), 480):
        chunk = text[lo : lo + 512]
        padded = chunk + (text[lo + 512 :] + bytes(16))
        best = np.zeros(16)
        for at in range(0, max(len(chunk) - 8, 0) + 4, 4):
            window = padded[at : at + 8]
            if at == 0 or at < len(chunk) - 8 + 4:
                best = np.maximum(best, np.sum([net.filters[256 * j + c].astype(np.float64) for j, c in enumerate(window)], axis=0))
        logits.append(best @ net.weights.astype(np.float64) + float(net.offset))
    return 1 / (1 + np.exp(-np.mean(logits)))


def brute_components(rows, width: int, percent: int) -> dict:
    """id -> (size of its set, smallest id it reaches, whether that is itself), by all pairs of full sets."""
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets.setdefault(i, set(zip(*(ws[j:] for j in range(width)), strict=False)) if len(ws) >= width else ({tuple(ws)} if ws else set()))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}
